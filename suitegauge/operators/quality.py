"""Rules that keep a batch going: a bad row becomes a reject with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from suitegauge.functions import scoring
from suitegauge.schemas import FAILURE_TYPES, TRACKS

Rules = list[tuple[Column | str, Column]]
"""(reason, violated) pairs, in the order they are checked; a null condition counts as not violated."""


def computed_once(df: DataFrame, *fields: Column) -> DataFrame:
    """Adds the aliased columns so that later filters and projections read them.

    A filter on an ordinary derived column is pushed below it by repeating its
    expression, and so is the not-empty filter that comes with exploding one.
    For pattern matching over long texts each repeat is another pass; a generator
    of exactly one row stays where it is and its column is read instead.
    """
    return df.select("*", F.inline(F.array(F.struct(*fields))))


def flag_rejects(df: DataFrame, rules: Rules, reason: str = "reason") -> DataFrame:
    """Adds the first violated rule (null for good rows). One pass, each condition read once; nothing is dropped."""
    chosen = F.lit(None).cast("string")
    for text, violated in reversed(rules):
        label = F.lit(text) if isinstance(text, str) else text
        chosen = F.when(F.coalesce(violated, F.lit(False)), label).otherwise(chosen)
    return computed_once(df.drop(reason), chosen.alias(reason))


def split_rejects(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``reason``).

    Both are filters over the same input; where both are written, write
    ``flag_rejects`` once, partitioned by ``reason is null``, or persist the input.
    """
    flagged = flag_rejects(df, rules)
    return flagged.filter("reason is null").drop("reason"), flagged.filter("reason is not null")


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("reason").agg(F.count("*").alias("n"))


def all_violations(df: DataFrame, rules: Rules, column: str = "violations") -> DataFrame:
    """Every violated rule per row, as an array in rule order."""
    marks = [F.when(F.coalesce(bad, F.lit(False)), F.lit(text) if isinstance(text, str) else text)
             for text, bad in rules]
    return df.withColumn(column, F.array_compact(F.array(*marks)))


def unit_range_rule(name: str) -> tuple[str, Column]:
    return f"{name} outside [0, 1]", F.expr("not " + scoring.in_unit(name))


def track_rule(name: str = "track") -> tuple[str, Column]:
    return f"{name} not one of {', '.join(TRACKS)}", ~F.coalesce(F.col(name).isin(*TRACKS), F.lit(False))


def failure_type_rule(name: str = "failure_type") -> tuple[str, Column]:
    return (f"{name} not one of {', '.join(FAILURE_TYPES)}",
            ~F.coalesce(F.col(name).isin(*FAILURE_TYPES), F.lit(False)))


def count_rule(name: str) -> tuple[str, Column]:
    return f"{name} is negative", F.coalesce(F.col(name) < 0, F.lit(True))


def validate_scores(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checks whichever of the score, track, class and count columns the frame has."""
    units = ("mutation_score", "fault_detection_rate", "composite_score", "score", "pass_rate")
    rules: Rules = [unit_range_rule(c) for c in units if c in df.columns]
    if "track" in df.columns:
        rules.append(track_rule())
    if "failure_type" in df.columns:
        rules.append(failure_type_rule())
    rules += [count_rule(c) for c in ("task_count",) if c in df.columns]
    return split_rejects(df, rules)


def exactly_one_rules(first: str, second: str, owner: Column) -> Rules:
    """Reasons for rows that give both or neither of two fields."""
    a, b = F.col(first).isNotNull(), F.col(second).isNotNull()
    return [
        (F.concat(owner, F.lit(f" has both '{first}' and '{second}'")), a & b),
        (F.concat(owner, F.lit(f" must have either '{first}' or '{second}'")), ~a & ~b),
    ]


def find_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their count; pre-aggregated before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
