"""Columns for outcomes and scores, built from SQL expressions over named inputs.

Arguments are column names or SQL expressions; one parsed expression costs one
call to the JVM, where chained column methods cost one each.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from suitegauge.schemas import FAILURE_TYPES

NONE, ASSERTION, INFRASTRUCTURE, TIMEOUT = range(4)

# Weights of the composite and of the documented four-part composite.
WEIGHTS = {"mutation_score": 0.60, "fault_detection_rate": 0.40}
FOUR_WEIGHTS = {"mutation_score": 0.30, "spec_coverage": 0.25,
                "fault_detection_rate": 0.25, "impl_independence": 0.20}

# The summary lines a mutation log may hold, in order of precedence.
FRACTION_KILLED = r"([0-9]+/[0-9]+)\s+mutants?\s+killed"
COUNT_KILLED = r"[Kk]illed[:\s]+([0-9]+)"
COUNT_SURVIVED = r"[Ss]urvived[:\s]+([0-9]+)"

# 0 none, 1 assertion, 2 infrastructure, 3 timeout: the positions of FAILURE_TYPES.
FAILURE_CODE = (f"case when coalesce(timed_out, false) then {TIMEOUT} when exit_code = 0 then {NONE} "
                f"when exit_code = 1 then {ASSERTION} else {INFRASTRUCTURE} end")

# Halves of a hundredth whose nearest double lies below them, or that tie towards an
# even digit: Python's round() takes these down, rounding of the decimal notation up.
ROUNDED_DOWN = [k / 1000 for k in range(5, 1000, 10) if round(k / 1000, 2) < k / 1000]


def failure_type(code: str) -> Column:
    names = ", ".join(f"'{name}'" for name in FAILURE_TYPES)
    return F.expr(f"get(array({names}), {code})")


def _number(text: str) -> str:
    # Casting '' would raise and catch an error for every row without a match.
    return f"try_cast(nullif({text}, '') as bigint)"


def killed_fraction(output: str) -> Column:
    """``_fraction``: the text "X/Y" of a log's main summary line, '' where there is none."""
    return F.expr(f"regexp_extract({output}, r'{FRACTION_KILLED}', 1)").alias("_fraction")


def separate_counts(output: str) -> list[Column]:
    """``_killed_text`` and ``_survived_text``, looked for only in logs without a fraction."""
    return [F.expr(f"case when _fraction = '' then regexp_extract({output}, r'{pattern}', 1) end").alias(name)
            for name, pattern in (("_killed_text", COUNT_KILLED), ("_survived_text", COUNT_SURVIVED))]


def mutation_marks() -> list[str]:
    """The numbers of a log, null where absent."""
    return [f"{_number(text)} as {name}" for name, text in (
        ("_part", "substring_index(_fraction, '/', 1)"), ("_whole", "substring_index(_fraction, '/', -1)"),
        ("_killed", "_killed_text"), ("_survived", "_survived_text"))]


def mutation_counts(error: str) -> dict[str, str]:
    """killed, survived, total from the marks: the fraction, else the two counts, else killed alone, else zeros.

    A run that ended in an error counts as zeros whatever its log says.
    """

    def choose(from_fraction: str, from_counts: str) -> str:
        return (f"case when {error} is not null then 0L when _part is not null and _whole is not null then {from_fraction} "
                f"when _killed is not null then {from_counts} else 0L end")

    return {"killed": choose("_part", "_killed"), "survived": choose("_whole - _part", "coalesce(_survived, 0L)"),
            "total": choose("_whole", "_killed + coalesce(_survived, 0L)")}


def mutation_score(killed: str, total: str) -> Column:
    return F.expr(f"case when {total} > 0 then {killed} / {total} else 0D end")


def multi_class_counts(summary: str) -> Column:
    """Counts of a four-class summary; suspicious and timed-out mutants stay outside the score."""
    fields = ", ".join(
        "'%s', coalesce(%s, 0L)" % (label, _number(rf"regexp_extract({summary}, r'(?i)\b{label}[:\s]+([0-9]+)', 1)"))
        for label in ("killed", "survived", "suspicious", "timeout"))
    return F.expr(f"named_struct({fields})")


def weighted(parts: dict[str, str], weights: dict[str, float]) -> str:
    """Weighted sum; missing parts count as 0."""
    return " + ".join(f"{float(weight)!r}D * coalesce({parts[name]}, 0D)" for name, weight in weights.items())


def round_cents(value: str) -> Column:
    """Two decimals as Python's round() gives them, for values in [0, 1].

    The engine rounds the shortest decimal notation, half up. The two differ only
    where that notation ends in a 5 at the third decimal: the values listed above.
    """
    down = ", ".join(f"{v!r}D" for v in ROUNDED_DOWN)
    return F.expr(f"round(case when ({value}) in ({down}) then ({value}) - 0.001D else ({value}) end, 2)")


def round_scaled(value: str, digits: int) -> Column:
    """Scale, round halves away from zero, scale back: how the leaderboard's SQL dialect rounds doubles."""
    factor = f"{float(10 ** digits)!r}D"
    return F.expr(f"round(({value}) * {factor}) / {factor}")


def composite(mutation: str, fault_detection: str, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum to two decimals."""
    return round_cents(weighted({"mutation_score": mutation, "fault_detection_rate": fault_detection}, weights))


def in_unit(value: str) -> str:
    return f"({value} is not null and {value} between 0D and 1D)"
