"""Scoring queries: run classes, fault detection, mutation scores, details, summaries, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from suitegauge.functions.scoring import failure_type
from suitegauge.operators import documented, quality, scoring
from suitegauge.plans.fixtures import view, with_views

KEYS = "participant, track, ordinal"


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.pair_runs(view(spark, folder, "runs_v"))


def parsed_logs(spark: SparkSession, folder: str, source: str = "logs_v") -> DataFrame:
    return scoring.parse_mutation_logs(view(spark, folder, source))


def outcomes(spark: SparkSession, folder: str, mode: str = "reference") -> DataFrame:
    return scoring.task_outcomes(
        pairs(spark, folder), scoring.mutation_per_task(parsed_logs(spark, folder)), mode)


def details(spark: SparkSession, folder: str, spelled: bool = True) -> DataFrame:
    return scoring.task_details(view(spark, folder, "evaluations_v"), outcomes(spark, folder), spelled=spelled)


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.summarize_outcomes(view(spark, folder, "evaluations_v"), outcomes(spark, folder))


def documents(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    lists = scoring.task_lists(view(spark, folder, "evaluations_v"), outcomes(spark, folder))
    return scoring.to_envelope(summary(spark, folder), lists, lines=lines)


def classify_runs(spark, folder):
    return scoring.classify_runs(view(spark, folder, "runs_v")).select(
        "run_id", "participant", "task_num", "target", "ts", "exit_code", "failure_type", "passed")


def failure_breakdown(spark, folder):
    return scoring.failure_breakdown(view(spark, folder, "runs_v"), "participant", "target")


def run_pairs(spark, folder):
    return pairs(spark, folder).select(*scoring.KEYS, *[
        F.coalesce(failure_type(f"{side}_code"), F.lit("never run")).alias(side) for side in ("correct", "buggy")])


def fault_detection(spark, folder):
    return _detection(spark, folder, "reference")


def fault_detection_strict(spark, folder):
    return _detection(spark, folder, "strict")


def _detection(spark, folder, mode):
    return scoring.with_fault_detection(pairs(spark, folder), mode).select(
        *scoring.KEYS, "passed_correct", "failed_buggy", "fault_detection_rate")


def mean_fault_detection(spark, folder):
    return scoring.with_fault_detection(pairs(spark, folder)).agg(
        F.round(F.coalesce(F.avg("fault_detection_rate"), F.lit(0.0)), 9).alias("mean_fault_detection"))


def mutation_parse(spark, folder):
    return parsed_logs(spark, folder).select("o_orderkey", "killed", "survived", "total", "error")


def mutation_score(spark, folder):
    return scoring.mutation_per_task(parsed_logs(spark, folder)).select(
        *scoring.KEYS, F.round("mutation_score", 9).alias("mutation_score"))


def task_details(spark, folder):
    return details(spark, folder).select(
        *scoring.KEYS, "task_id", F.round("mutation_score", 9).alias("mutation_score"),
        "fault_detection_rate", "composite_score", "passed_correct", "failed_buggy")


def composite_scores(spark, folder):
    return outcomes(spark, folder).select(*scoring.KEYS, "composite_score")


def _rounded(frame):
    return frame.select("participant", "track", *[F.round(c, 9).alias(c) for c in (
        "mutation_score", "fault_detection_rate", "pass_rate")], "task_count", "score")


def run_summary(spark, folder):
    return _rounded(summary(spark, folder))


def run_summary_from_details(spark, folder):
    return _rounded(scoring.summarize_runs(details(spark, folder, spelled=False)))


def result_envelope(spark, folder):
    flat = scoring.flatten_details(documents(spark, folder))
    return flat.select("id", "track", "task_id", F.round("mutation_score", 9).alias("mutation_score"),
                       "fault_detection_rate", "composite_score", "passed_correct", "failed_buggy")


def outcome_rejects(spark, folder):
    rejects = scoring.outcome_rejects(view(spark, folder, "evaluations_v").filter("participant % 7 <> 5"), outcomes(spark, folder))
    return rejects.select(*scoring.KEYS, "reason")


def score_rejects(spark, folder):
    _, rejects = quality.validate_scores(parsed_logs(spark, folder, "odd_logs_v"))
    return rejects.select("o_orderkey", "reason")


def score_reject_counts(spark, folder):
    _, rejects = quality.validate_scores(parsed_logs(spark, folder, "odd_logs_v"))
    return quality.reject_counts(rejects)


def impl_independence(spark, folder):
    three = scoring.pair_runs(view(spark, folder, "runs3_v"), ("correct", "buggy", "alternative"))
    return documented.impl_independence(three).select(*scoring.KEYS, "impl_independence")


def baseline_delta(spark, folder):
    scored = outcomes(spark, folder)
    return documented.baseline_delta(
        scored.filter("participant <> 0"), scored.filter("participant = 0"), "composite_score"
    ).select(*scoring.KEYS, F.round("delta", 6).alias("delta"))


def latency_summary(spark, folder):
    return documented.latency_summary(view(spark, folder, "runs_v"), ["participant", "target"]).withColumn(
        "avg_latency", F.round("avg_latency", 6))


def track_comparison(spark, folder):
    compared = documented.track_comparison(details(spark, folder, spelled=False))
    return compared.select("ordinal", *[F.round(c, 9).alias(c) for c in compared.columns if c != "ordinal"])


def multi_class_mutation(spark, folder):
    return documented.multi_class_mutation(view(spark, folder, "summaries_v")).select(
        "o_orderkey", "killed", "survived", "suspicious", "timeout", F.round("mutation_score", 9).alias("mutation_score"))


QUERIES = {f.__name__: f for f in (
    classify_runs, failure_breakdown, run_pairs, fault_detection, fault_detection_strict, mean_fault_detection,
    mutation_parse, mutation_score, task_details, composite_scores, run_summary, run_summary_from_details,
    result_envelope, outcome_rejects, score_rejects, score_reject_counts, impl_independence, baseline_delta,
    latency_summary, track_comparison, multi_class_mutation)}

_CODE = "case when timed_out then 3 when exit_code = 0 then 0 when exit_code = 1 then 1 else 2 end"
_TYPE = "case when timed_out then 'timeout' when exit_code = 0 then 'none' when exit_code = 1 then 'assertion' else 'infrastructure' end"


def _named(side: str) -> str:
    return (f"case {side}_code when 0 then 'none' when 1 then 'assertion' when 2 then 'infrastructure' "
            f"when 3 then 'timeout' else 'never run' end as {side}")


def cents(x: str) -> str:
    """Two decimals, correctly rounded from the binary value by number formatting."""
    return f"cast(printf('%.2f', {x}) as double)"


def _pairs_sql(runs: str, targets: tuple[str, ...], keys: str = KEYS) -> str:
    sides = ", ".join(f"max(case when target = '{t}' then code end) as {t}_code" for t in targets)
    return f"""
latest as (select *, {_CODE} as code, row_number() over (
    partition by {keys}, target order by ts desc, {_CODE} desc) as rn from {runs}),
pairs as (select {keys}, {sides} from latest where rn = 1 group by {keys})"""


def _parsed_sql(logs: str, keys: str = KEYS) -> str:
    frac, killed, survived = (r"([0-9]+)/([0-9]+)\s+mutants?\s+killed", r"[Kk]illed[:\s]+([0-9]+)",
                              r"[Ss]urvived[:\s]+([0-9]+)")
    return f"""
marks as (select *, try_cast(regexp_extract(output, '{frac}', 1) as bigint) as fk,
    try_cast(regexp_extract(output, '{frac}', 2) as bigint) as ft,
    try_cast(regexp_extract(output, '{killed}', 1) as bigint) as k,
    coalesce(try_cast(regexp_extract(output, '{survived}', 1) as bigint), 0) as s from {logs}),
counts as (select *,
    case when error is not null then 0 when fk is not null then fk when k is not null then k else 0 end as killed,
    case when error is not null then 0 when fk is not null then ft - fk when k is not null then s else 0 end as survived,
    case when error is not null then 0 when fk is not null then ft when k is not null then k + s else 0 end as total
  from marks),
parsed as (select *, case when total > 0 then killed / total else 0.0::double end as mutation_score from counts),
mutations as (select {keys}, max(case when mutation_score between 0 and 1 then mutation_score end) as mutation_score,
    bool_or(mutation_score between 0 and 1) as mutation_valid
  from parsed group by {keys})"""


_DETECT = """
detected as (select *, coalesce(correct_code = 0 and buggy_code is not null, false) as passed_correct,
    coalesce(correct_code is not null and buggy_code {op}, false) as failed_buggy from pairs)"""

OUTCOMES = with_views("runs_v", "logs_v", "evaluations_v") + "," + _pairs_sql("runs_v", ("correct", "buggy")) + "," \
    + _parsed_sql("logs_v") + "," + _DETECT.format(op="<> 0") + f""",
outcomes as (select {KEYS}, u * coalesce(m, 0) as mutation_score, u * fd as fault_detection_rate,
    {cents("0.6::double * (u * coalesce(m, 0)) + 0.4::double * (u * fd)")} as composite_score,
    u = 1 and passed_correct as passed_correct, u = 1 and failed_buggy as failed_buggy
  from (select d.participant, d.track, d.ordinal, m.mutation_score as m, passed_correct, failed_buggy,
      cast(passed_correct and failed_buggy as int)::double as fd,
      case when correct_code is not null and buggy_code is not null and coalesce(mutation_valid, true)
        then 1.0::double else 0.0::double end as u
    from detected d left join mutations m using (participant, track, ordinal))),
grid as (select participant, track, unnest(generate_series(1, task_count)) as ordinal from evaluations_v),
details as (select g.participant, g.track, g.ordinal, printf('task_%03d', g.ordinal) as task_id,
    coalesce(mutation_score, 0) as mutation_score, coalesce(fault_detection_rate, 0) as fault_detection_rate,
    coalesce(composite_score, 0) as composite_score, coalesce(passed_correct, false) as passed_correct,
    coalesce(failed_buggy, false) as failed_buggy
  from grid g left join outcomes o using (participant, track, ordinal)),
summary as (select *, {cents("0.6::double * mutation_score + 0.4::double * fault_detection_rate")} as score from (
  select participant, track, round(avg(mutation_score), 12) as mutation_score,
    round(avg(fault_detection_rate), 12) as fault_detection_rate,
    round(avg(case when passed_correct and failed_buggy then 1.0::double else 0.0::double end), 12) as pass_rate,
    count(*) as task_count from details group by participant, track))
"""

_RUNS = with_views("runs_v") + "," + _pairs_sql("runs_v", ("correct", "buggy"))
_RUNS3 = with_views("runs3_v") + "," + _pairs_sql("runs3_v", ("correct", "buggy", "alternative"))
_DETECTION = f"""select {KEYS}, passed_correct, failed_buggy,
  cast(passed_correct and failed_buggy as int)::double as fault_detection_rate from detected"""
_SUMMARY = OUTCOMES + """select participant, track, round(mutation_score, 9) as mutation_score,
  round(fault_detection_rate, 9) as fault_detection_rate, round(pass_rate, 9) as pass_rate, task_count, score from summary"""
_REJECTS = with_views("odd_logs_v") + f""",
scored as (select *, cast(regexp_extract(output, '^[0-9]+') as bigint) / 12 as mutation_score from odd_logs_v),
rejects as (select o_orderkey, case when mutation_score > 1 then 'mutation_score outside [0, 1]'
  when track not in ('tdd', 'bdd') then 'track not one of tdd, bdd'
  when task_count < 0 then 'task_count is negative' end as reason from scored)"""

ORACLES = {
    "classify_runs": with_views("runs_v") + f"""
select run_id, participant, task_num, target, ts, case when timed_out then 1 else exit_code end as exit_code,
  {_TYPE} as failure_type, not timed_out and exit_code = 0 as passed from runs_v""",
    "failure_breakdown": with_views("runs_v") + f"""
select participant, target, count(*) filter ({_CODE} = 0) as n_none, count(*) filter ({_CODE} = 1) as n_assertion,
  count(*) filter ({_CODE} = 2) as n_infrastructure, count(*) filter ({_CODE} = 3) as n_timeout
from runs_v group by participant, target""",
    "run_pairs": _RUNS + f" select {KEYS}, {_named('correct')}, {_named('buggy')} from pairs",
    "fault_detection": _RUNS + "," + _DETECT.format(op="<> 0") + _DETECTION,
    "fault_detection_strict": _RUNS + "," + _DETECT.format(op="= 1") + _DETECTION,
    "mean_fault_detection": _RUNS + "," + _DETECT.format(op="<> 0") + """
select round(coalesce(avg(cast(passed_correct and failed_buggy as int)), 0), 9) as mean_fault_detection from detected""",
    "mutation_parse": with_views("logs_v") + "," + _parsed_sql("logs_v") + """
select o_orderkey, killed, survived, total, error from parsed""",
    "mutation_score": with_views("logs_v") + "," + _parsed_sql("logs_v") + f"""
select {KEYS}, round(mutation_score, 9) as mutation_score from mutations""",
    "task_details": OUTCOMES + f"""select {KEYS}, task_id, round(mutation_score, 9) as mutation_score,
  fault_detection_rate, composite_score, passed_correct, failed_buggy from details""",
    "composite_scores": OUTCOMES + f"select {KEYS}, composite_score from outcomes",
    "run_summary": _SUMMARY,
    "run_summary_from_details": _SUMMARY,
    "result_envelope": OUTCOMES + """select cast(participant as varchar) as id, track, task_id,
  round(mutation_score, 9) as mutation_score, fault_detection_rate, composite_score, passed_correct, failed_buggy
from details""",
    "outcome_rejects": OUTCOMES + f"""
select {KEYS}, case when e.task_count is null then 'participant not evaluated' else 'task outside the run' end as reason
from outcomes o left join (select * from evaluations_v where participant % 7 <> 5) e using (participant, track)
where e.task_count is null or o.ordinal not between 1 and e.task_count""",
    "score_rejects": _REJECTS + " select o_orderkey, reason from rejects where reason is not null",
    "score_reject_counts": _REJECTS + """
select reason, count(*) as n from rejects where reason is not null group by reason""",
    "impl_independence": _RUNS3 + f"""
select {KEYS}, case when alternative_code = 0 then 1.0::double else 0.0::double end as impl_independence from pairs""",
    "baseline_delta": OUTCOMES + """
select a.participant, a.track, a.ordinal, round(a.composite_score - b.composite_score, 6) as delta
from outcomes a join outcomes b using (track, ordinal) where a.participant <> 0 and b.participant = 0""",
    "latency_summary": with_views("runs_v") + """
select participant, target, round(avg(execution_time), 6) as avg_latency,
  quantile_disc(execution_time, 0.5) as p50_latency, quantile_disc(execution_time, 0.95) as p95_latency,
  quantile_disc(execution_time, 0.99) as p99_latency, min(execution_time) as min_latency,
  max(execution_time) as max_latency, count(*) as total_steps, arg_min(run_id, (-execution_time, run_id)) as slowest
from runs_v group by participant, target""",
    "track_comparison": OUTCOMES + """
select ordinal, round(avg(mutation_score) filter (track = 'tdd'), 9) as tdd_mutation_score,
  round(avg(mutation_score) filter (track = 'bdd'), 9) as bdd_mutation_score,
  round(avg(fault_detection_rate) filter (track = 'tdd'), 9) as tdd_fault_detection_rate,
  round(avg(fault_detection_rate) filter (track = 'bdd'), 9) as bdd_fault_detection_rate
from details group by ordinal""",
    "multi_class_mutation": with_views("summaries_v") + r""",
c as (select o_orderkey, cast(regexp_extract(summary, 'killed: ([0-9]+)', 1) as bigint) as killed,
  cast(regexp_extract(summary, 'survived: ([0-9]+)', 1) as bigint) as survived,
  cast(regexp_extract(summary, 'suspicious: ([0-9]+)', 1) as bigint) as suspicious,
  cast(regexp_extract(summary, 'timeout: ([0-9]+)', 1) as bigint) as timeout from summaries_v)
select o_orderkey, killed, survived, suspicious, timeout,
  round(case when killed + survived > 0 then killed / (killed + survived) else 0 end, 9) as mutation_score from c""",
}
