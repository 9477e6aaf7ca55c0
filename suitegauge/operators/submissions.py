"""Submitted test code: picking it out of event and artifact records, and checking it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from suitegauge.functions import code


def completed_events(events: DataFrame) -> DataFrame:
    """Events that end a submission and bring artifacts. Works on batch and stream alike."""
    return events.filter((F.col("state") == "completed") & (F.col("n_artifacts") > 0))


def first_completed(events: DataFrame) -> DataFrame:
    """Earliest completed event per submission by (ts, event_id).

    The rank limit runs inside each partition first, so a submission that owns a
    large share of the events sends one row per partition through the shuffle.
    """
    order = Window.partitionBy("submission_id").orderBy("ts", "event_id")
    return (
        completed_events(events).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
    )


def never_completed(events: DataFrame) -> DataFrame:
    """Submissions without such an event, with the error a requester would see."""
    done = completed_events(events).select("submission_id").distinct()
    return (
        events.select("submission_id").distinct().join(done, "submission_id", "left_anti")
        .withColumn("error", F.lit("No tests returned"))
    )


def first_text(df: DataFrame, artifacts: str = "artifacts") -> DataFrame:
    """Adds ``tests``: the first text part over all artifacts in order, null if there is none."""
    parts = F.flatten(F.transform(artifacts, lambda a: a["parts"]))
    return df.withColumn("tests", F.get(F.filter(parts, lambda p: p["kind"] == "text"), F.lit(0))["text"])


def first_text_part(parts: DataFrame) -> DataFrame:
    """The same over one row per part (submission_id, part_no, kind, text)."""
    order = Window.partitionBy("submission_id").orderBy("part_no")
    return (
        parts.filter(F.col("kind") == "text")
        .withColumn("_n", F.row_number().over(order)).filter("_n = 1")
        .select("submission_id", "part_no", F.col("text").alias("tests"))
    )


def validate_syntax(df: DataFrame, column: str = "tests") -> DataFrame:
    """Adds syntax_valid by parsing the code in Arrow batches; the code is never run."""
    return df.withColumn("syntax_valid", code.syntax_valid(F.col(column)))


def lint_submissions(df: DataFrame, column: str = "tests", check_syntax: bool = True) -> DataFrame:
    """Adds has_import, has_test_function and lint_ok for the track's rules.

    The function track needs ``import pytest`` and a test function at line start;
    the scenario track needs an import from ``pytest_bdd``.
    """
    source, tdd = F.col(column), F.col("track") == "tdd"
    required = F.when(tdd, F.lit("import pytest")).when(F.col("track") == "bdd", F.lit("from pytest_bdd"))
    checked = (
        df.withColumn("has_import", F.coalesce(F.contains(source, required), F.lit(False)))
        .withColumn("has_test_function", F.coalesce(F.rlike(source, F.lit(r"(^|\n)def test_")), F.lit(False)))
    )
    ok = F.col("has_import") & (~tdd | F.col("has_test_function"))
    if check_syntax:
        checked = validate_syntax(checked, column)
        ok = ok & F.col("syntax_valid")
    return checked.withColumn("lint_ok", ok)


def request_metrics(requests: DataFrame) -> DataFrame:
    """Per track and status: count, mean spec and test length, mean generation time."""
    return requests.groupBy("track", "status").agg(
        F.count("*").alias("n"),
        F.avg(F.length("spec")).alias("avg_spec_length"),
        F.avg(F.length("tests")).alias("avg_test_length"),
        F.avg("generation_time").alias("avg_generation_time"))
