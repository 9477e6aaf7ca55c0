"""Queries for the documented measures that rest on scenario texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitegauge.operators import documented, scoring
from suitegauge.operators import preparation as prep
from suitegauge.operators.quality import computed_once
from suitegauge.plans.fixtures import view, with_views
from suitegauge.plans.preparation import BUILT, built, dealt
from suitegauge.plans.scoring import KEYS, _DETECT, _pairs_sql, _parsed_sql, cents, parsed_logs
from suitegauge.sources.tables import table


def _scenarios(spark, folder):
    bdd, _ = prep.derive_bdd(dealt(spark, folder))
    return documented.scenario_names(bdd.select("task_id", "ordinal", "spec"))


def scenario_names(spark, folder):
    return _scenarios(spark, folder).select("task_id", "scenario_no", "scenario")


def spec_requirements(spark, folder):
    return built(spark, folder).select("task_id", F.size(documented.requirements(F.col("spec"))).alias("n_requirements"))


def docstring_requirements(spark, folder):
    specs = view(spark, folder, "specs_v", "p_partkey")
    found = computed_once(specs, documented.docstring_requirements(F.col("spec")).alias("found"))
    return found.select("p_partkey", F.size("found").alias("n_requirements"), F.get("found", F.lit(0)).alias("requirement"))


def _coverage(spark, folder):
    # Other runs count for a scenario that no task has.
    executed = table(spark, folder, "lineitem").select((F.col("l_partkey") + 1).alias("ordinal"), F.when(
        F.expr("l_linestatus = 'F' and l_quantity > 40"),
        F.concat(F.lit("Example "), (1 + F.col("l_linenumber") % 2).cast("string"))).otherwise("none").alias("scenario"))
    # Every seventh task has lost its scenarios.
    return documented.spec_coverage(_scenarios(spark, folder).filter("ordinal % 7 <> 0"), executed, "ordinal", built(spark, folder))


def spec_coverage(spark, folder):
    return _coverage(spark, folder).select(
        "ordinal", "n_scenarios", "n_covered", F.round("spec_coverage", 9).alias("spec_coverage"))


def composite4(spark, folder):
    three = scoring.pair_runs(view(spark, folder, "runs3_v"), ("correct", "buggy", "alternative"))
    scored = documented.impl_independence(scoring.with_fault_detection(three))
    mutation = scoring.mutation_per_task(parsed_logs(spark, folder))
    joined = (scored.join(mutation, list(scoring.KEYS), "left")
              .join(_coverage(spark, folder).select("ordinal", "spec_coverage"), "ordinal", "left"))
    return documented.composite4(joined).select(*scoring.KEYS, "composite4")


QUERIES = {f.__name__: f for f in (scenario_names, spec_requirements, docstring_requirements, spec_coverage, composite4)}

_SCENARIOS = BUILT + r""",
scenarios as (select ordinal, task_id, unnest(generate_series(1, len(regexp_extract_all(spec, '>>> ')))) as scenario_no from built)"""
_COVERAGE = _SCENARIOS + """,
executed as (select distinct l_partkey + 1 as ordinal, 1 + l_linenumber % 2 as scenario_no from lineitem
  where l_linestatus = 'F' and l_quantity > 40),
coverage as (select s.ordinal, count(*) as n_scenarios, count(e.ordinal) as n_covered,
  count(e.ordinal) / count(*) as spec_coverage
  from scenarios s left join executed e using (ordinal, scenario_no) where s.ordinal % 7 <> 0 group by s.ordinal
  union all select ordinal, 0, 0, 0.0 from built where ordinal % 7 = 0)"""

ORACLES = {
    "scenario_names": _SCENARIOS + " select task_id, cast(scenario_no as int) as scenario_no, concat('Example ', scenario_no) as scenario from scenarios",
    "docstring_requirements": with_views("specs_v") + """
select p_partkey, case when kind in (2, 3) then 0 else 1 end as n_requirements,
  case when kind not in (2, 3) then concat('>>> f(', cast(size as string), ')', chr(10), '      2') end as requirement from specs_v""",
    "spec_requirements": BUILT + r"""
select task_id, cast(len(regexp_extract_all(spec, '>>>\s+\w+\([^)]+\)\n\s+\S+')) as int) as n_requirements from built""",
    "spec_coverage": _COVERAGE + """
select ordinal, n_scenarios, n_covered, round(spec_coverage, 9) as spec_coverage from coverage""",
    "composite4": with_views("runs3_v", "logs_v") + "," + _COVERAGE[len("with "):] + ","
    + _pairs_sql("runs3_v", ("correct", "buggy", "alternative")) + "," + _parsed_sql("logs_v") + ","
    + _DETECT.format(op="<> 0") + f"""
select {KEYS}, {cents("""0.3::double * coalesce(mutation_score, 0) + 0.25::double * coalesce(spec_coverage, 0)
  + 0.25::double * cast(passed_correct and failed_buggy as int)
  + 0.2::double * case when alternative_code = 0 then 1 else 0 end""")} as composite4
from detected left join mutations using (participant, track, ordinal) left join coverage using (ordinal)""",
}
