"""Measures that are described for the benchmark but were never part of its scoring code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from suitegauge.functions import scoring as S
from suitegauge.functions.docstrings import raw_docstring
from suitegauge.functions.text import strip
from suitegauge.operators.quality import computed_once
from suitegauge.operators.scoring import BLOCK
from suitegauge.session import keep

# Fixed value: the keywords that open a scenario.
SCENARIO = r"(?m)^\s*(?:Scenario(?: Outline| Template)?|Example):[ \t]*([^\n]*)"
REQUIREMENT = r">>>\s+\w+\([^)]+\)\n\s+\S+"


def scenario_names(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """One row per scenario of a feature text: scenario_no from 1 and name."""
    read = computed_once(specs, F.regexp_extract_all(spec, F.lit(SCENARIO), F.lit(1)).alias("_names"))
    names = F.posexplode("_names").alias("_pos", "_name")
    return read.select(*[c for c in specs.columns if c != spec], names).select(
        "*", (F.col("_pos") + 1).alias("scenario_no"), strip(F.col("_name")).alias("scenario")).drop("_pos", "_name")


def requirements(spec: Column) -> Column:
    """Worked examples of a spec as discrete requirements."""
    return F.regexp_extract_all(spec, F.lit(REQUIREMENT), F.lit(0))


def docstring_requirements(spec: Column) -> Column:
    """Worked examples of the docstring alone, as it stands in the source: those of other strings and comments are none."""
    return requirements(raw_docstring(spec))


def spec_coverage(scenarios: DataFrame, executed: DataFrame, by: str = "task_id",
                  tasks: DataFrame | None = None) -> DataFrame:
    """Share of each task's scenarios that were executed; with ``tasks``, 0.0 for those that have no scenario.

    Executed names fold to one row each first.
    """
    ran = executed.select(by, "scenario").distinct().withColumn("_ran", F.lit(1))
    counted = scenarios.join(ran, [by, "scenario"], "left").groupBy(by).agg(
        F.count("*").alias("n_scenarios"), F.count("_ran").alias("n_covered"))
    if tasks is not None:
        counted = tasks.select(by).distinct().join(counted, by, "left").na.fill(0, ["n_scenarios", "n_covered"])
    return counted.withColumn("spec_coverage", F.when(
        F.col("n_scenarios") > 0, F.col("n_covered") / F.col("n_scenarios")).otherwise(0.0))


def impl_independence(pairs: DataFrame) -> DataFrame:
    """Adds impl_independence: 1.0 when the suite also passes on the alternative correct code.

    ``pairs`` comes from ``pair_runs`` with the third target ``alternative``.
    """
    return pairs.selectExpr("*", f"cast(coalesce(alternative_code = {S.NONE}, false) as double) as impl_independence")


def composite4(df: DataFrame, weights: dict[str, float] = S.FOUR_WEIGHTS) -> DataFrame:
    return df.withColumn("composite4", S.round_cents(S.weighted({name: name for name in weights}, weights)))


def baseline_delta(agent: DataFrame, baseline: DataFrame, measure: str) -> DataFrame:
    """Agent minus baseline for the same task; tasks only one of them has are left out."""
    a = agent.select("participant", "track", "ordinal", F.col(measure).alias("agent_value"))
    b = baseline.select("track", "ordinal", F.col(measure).alias("baseline_value"))
    return a.join(b, ["track", "ordinal"]).withColumn("delta", F.col("agent_value") - F.col("baseline_value"))


QUANTILES = (500, 950, 990)
"""Wanted quantiles in thousandths."""
SALTS = 32
"""Keys that a group is spread over."""


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on equal keys, nulls among them."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


BINS = 1_000
"""Bins of a bracket in one round of refinement."""
FEW = 4_096
"""Values of a bracket that are gathered, by distinct value, instead of being refined."""


def _bracketed(runs: DataFrame, brackets: DataFrame, by: list[str], value: str, label: str) -> DataFrame:
    """The values inside each bracket (by, _i, _lo, _hi) of their group, matched by salt so that a hot group is many keys."""
    salted = brackets.groupBy(*by).agg(F.collect_list(F.struct("_i", "_lo", "_hi")).alias("_brackets")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.xxhash64(label, value), F.lit(SALTS)).cast("int")
    rows = _matched(runs.select(*by, F.col(value).alias("_v"), salt.alias("_salt")), salted, [*by, "_salt"])
    return rows.selectExpr(*by, "_v", "inline(filter(_brackets, b -> _v between b._lo and b._hi))")


def _reached(parts: str, size: str) -> Column:
    """Of sorted parts with counts ``n``: the first at which the running count reaches ``_need``, and the count before it."""
    return F.expr(f"""aggregate({parts}, named_struct('before', 0L, 'part', cast(null as {size})),
        (s, p) -> if(s.part is null and s.before + p.n < _need, named_struct('before', s.before + p.n, 'part', s.part),
                     if(s.part is null, named_struct('before', s.before, 'part', p), s)))""")


def latency_summary(runs: DataFrame, by: list[str], value: str = "execution_time", label: str = "run_id",
                    accuracy: int = BINS, few: int = FEW) -> DataFrame:
    """Mean, exact quantiles (the smallest value whose share reaches p), extremes and the slowest entry per group.

    Each quantile has a bracket, at first all values of its group. A bracket of more than ``few`` values is cut into ``accuracy`` bins of like
    width, whose counts and extremes fold before the shuffle; the bin that holds the wanted rank is the next bracket. As both
    ends of a bracket are values of it, each round leaves some out; three rounds narrow a billion even values to one.
    Then the few left are gathered by distinct value. No step holds or orders more than ``accuracy`` or ``few`` entries of a group,
    however large the group. Among equally slow entries the smallest label is named. A null group is a group.
    """
    kind = f"{runs.schema[value].dataType.simpleString()}"
    # Written once: each round reads it, and its size on disk lets the planner broadcast it when it is small.
    stats = keep(runs.groupBy(*by).agg(*[F.expr(sql) for sql in (
        f"avg({value}) as avg_latency", f"min({value}) as min_latency", f"max({value}) as max_latency",
        f"count({value}) as total_steps", f"min_by({label}, case when {value} is not null then struct(-{value}, {label}) end) as slowest")]), "latency")
    marks = ", ".join(f"struct({i} as _i, (total_steps * {q} + 999) div 1000 as _need)" for i, q in enumerate(QUANTILES))
    brackets = stats.where("total_steps > 0").selectExpr(
        *by, f"inline(array({marks}))", "min_latency as _lo", "max_latency as _hi", "total_steps as _n")
    closed = "_lo = _hi or _n <= {few}".format(few=few)
    done = []
    while True:
        done.append(brackets.where(closed))
        if brackets.where(f"not ({closed})").limit(1).count() == 0:
            break
        wide = brackets.where(f"not ({closed})")
        width = f"least(cast((cast(_v as double) - _lo) / (cast(_hi as double) - _lo) * {accuracy} as int), {accuracy - 1})"
        counted = _bracketed(runs, wide, by, value, label).groupBy(*by, "_i", F.expr(width).alias("_bin")).agg(
            F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        folded = counted.groupBy(*by, "_i").agg(F.sort_array(F.collect_list(F.struct("_bin", "n", "lo", "hi"))).alias("_parts"))
        found = _matched(wide.select(*by, "_i", "_need"), folded, [*by, "_i"]).withColumn(
            "_r", _reached("_parts", f"struct<_bin:int,n:bigint,lo:{kind},hi:{kind}>"))
        brackets = keep(found.selectExpr(*by, "_i", "_need - _r.before as _need", "_r.part.lo as _lo", "_r.part.hi as _hi", "_r.part.n as _n"), "brackets")
    narrow = reduce(DataFrame.union, done)
    single = narrow.where("_lo = _hi").selectExpr(*by, "_i", "_lo as _q")
    several = narrow.where("_lo < _hi")
    values = _bracketed(runs, several, by, value, label).groupBy(*by, "_i", "_v").agg(F.count("*").alias("n")).groupBy(*by, "_i").agg(
        F.sort_array(F.collect_list(F.struct("_v", "n"))).alias("_parts"))
    exact = _matched(several.select(*by, "_i", "_need"), values, [*by, "_i"]).select(
        *by, "_i", _reached("_parts", f"struct<_v:{kind},n:bigint>")["part"]["_v"].alias("_q"))
    found = single.union(exact).groupBy(*by).agg(*[
        F.expr(f"max(case when _i = {i} then _q end) as p{q // 10}_latency") for i, q in enumerate(QUANTILES)])
    return _matched(stats, found, by, "left")


def multi_class_mutation(summaries: DataFrame, column: str = "summary") -> DataFrame:
    """Adds the four counts and killed / (killed + survived)."""
    counted = computed_once(summaries, S.multi_class_counts(column).alias("_c"))
    return counted.select(*summaries.columns, "_c.*",
                          S.mutation_score("_c.killed", "(_c.killed + _c.survived)").alias("mutation_score"))


def track_comparison(details: DataFrame, measures: tuple[str, ...] = ("mutation_score", "fault_detection_rate")) -> DataFrame:
    """Mean of each measure per task, one column per track: conditional means in one aggregation.

    Details are rows, or stretches of them (``task_details`` without ``spelled``): then zero rows are counted, not listed.
    """
    if "last" in details.columns:
        details = _means_of_stretches(details, measures)
    return details.groupBy("ordinal").agg(*[
        F.avg(F.when(F.col("track") == track, F.col(m))).alias(f"{track}_{m}")
        for m in measures for track in ("tdd", "bdd")])


def _means_of_stretches(stretches: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """(track, ordinal, the mean of each measure over all details there), from stretches that are summed up where they begin and end.

    How many details a task has is a running count over beginnings and ends. Stretches keep to their block, so each count
    runs over one block's numbers.
    """
    figures, zeros = ", ".join(measures), ", ".join(f"0D as {m}" for m in measures)
    changes = stretches.selectExpr("track", f"(ordinal - 1) div {BLOCK} as _block", f"""inline(array(
        struct(ordinal, 1L as _change, {figures}), struct(last + 1 as ordinal, -1L as _change, {zeros})))""").groupBy(
        "track", "_block", "ordinal").agg(F.sum("_change").alias("_change"), *[F.sum(m).alias(m) for m in measures])
    of_block = Window.partitionBy("track", "_block").orderBy("ordinal")
    counted = changes.select("*", F.sum("_change").over(of_block).alias("_n"), F.lead("ordinal").over(of_block).alias("_next")).filter("_n > 0")
    return counted.selectExpr("track", "ordinal as _first", "explode(sequence(ordinal, _next - 1)) as ordinal", "_n", *measures).selectExpr(
        "track", "ordinal", *[f"if(ordinal = _first, {m} / _n, 0D) as {m}" for m in measures])
