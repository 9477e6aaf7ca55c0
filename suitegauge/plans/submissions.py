"""Submission queries, and the streaming jobs run once over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitegauge.functions import text
from suitegauge.operators import leaderboard as board
from suitegauge.operators import submissions as sub
from suitegauge.operators.scoring import with_trace
from suitegauge.plans.fixtures import view, with_views
from suitegauge.plans.leaderboards import BOARD
from suitegauge.plans.preparation import BUILT, built
from suitegauge.plans.scoring import documents
from suitegauge.session import work_folder
from suitegauge.sources.results import append_batch, append_log, progress_text, read_results, write_results
from suitegauge.sources.results import result_lines as read_result_lines
from suitegauge.sources.tables import table
from suitegauge.sources.tasks import dataset_lines as read_dataset_lines
from suitegauge.sources.tasks import write_tasks
from suitegauge.streaming import leaderboard as board_stream
from suitegauge.streaming.submissions import earliest_completed_stream, first_completed_stream, keyed_state, run_to_table


def first_completed(spark, folder):
    return sub.first_completed(view(spark, folder, "agent_events_v")).select("submission_id", "event_id", "ts", "props")


def never_completed(spark, folder):
    return sub.never_completed(view(spark, folder, "agent_events_v"))


def first_text(spark, folder):
    part = F.struct("kind", "text")
    nested = view(spark, folder, "submissions_v").withColumn("artifacts", F.array(
        F.struct(F.array(part).alias("parts")),
        F.struct(F.array(F.struct(F.lit("file").alias("kind"), F.lit("").alias("text")),
                         F.struct(F.lit("text").alias("kind"), F.col("kind").alias("text"))).alias("parts"))))
    return sub.first_text(nested).select("submission_id", "part_no", "tests")


def first_text_part(spark, folder):
    return sub.first_text_part(view(spark, folder, "submissions_v"))


def syntax_valid(spark, folder):
    return sub.validate_syntax(view(spark, folder, "code_v")).select("p_partkey", "syntax_valid")


def submission_lint(spark, folder):
    return sub.lint_submissions(view(spark, folder, "code_v")).select(
        "p_partkey", "has_import", "has_test_function", "syntax_valid", "lint_ok")


def request_text(spark, folder):
    return view(spark, folder, "tasks_v").select("ordinal", text.request_text(F.col("track"), F.col("prompt")).alias("request"))


def participant_names(spark, folder):
    raw = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit(" \n"), "c_name", F.lit("\t"))).when(
        F.col("c_nationkey") % 3 == 1, F.lit("  "))
    return table(spark, folder, "customer").select("c_custkey", text.participant(raw).alias("participant"))


def request_metrics(spark, folder):
    requests = (
        view(spark, folder, "code_v").join(
            view(spark, folder, "tasks_v").select((F.col("ordinal") - 1).alias("p_partkey"), F.col("prompt").alias("spec")),
            "p_partkey")
        .withColumn("generation_time", F.length("tests") / 4)
        .withColumn("status", F.when(F.contains("tests", F.lit("import os")), F.lit("error")).otherwise(F.lit("success"))))
    measured = sub.request_metrics(requests)
    return measured.select("track", "status", "n", *[F.round(c, 6).alias(c) for c in (
        "avg_spec_length", "avg_test_length", "avg_generation_time")])


def stream_first_completed(spark, folder):
    """The events table read as a stream; how many events passed of each submission that completed: one."""
    source = table(spark, folder, "events")
    events = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    shaped = events.selectExpr(
        "user_id as submission_id", "event_id", "ts",
        "case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'submitted' "
        "else 'working' end as state",
        "case when event_id % 7 = 0 then 0 else 1 end as n_artifacts")
    out, checkpoint = work_folder(spark, "first-completed"), work_folder(spark, "first-completed-log")
    run_to_table(first_completed_stream(shaped, "40 days"), out, checkpoint)
    return spark.read.parquet(out).groupBy("submission_id").agg(F.count("*").alias("n_passed"))


def stream_leaderboard(spark, folder):
    """Result documents written as files, then read as a stream into a board of buckets."""
    files, out, checkpoint = (work_folder(spark, name) for name in ("results", "board", "board-log"))
    write_results(documents(spark, folder, lines=True), files)
    stream = board_stream.read_result_stream(spark, files, files_per_batch=4)
    board_stream.keep_board(board_stream.newest_results(stream), out, checkpoint, buckets=8)
    return board.overall(board_stream.read_board(spark, out))


def stream_earliest_completed(spark, folder):
    """Events that arrive in four lots, some of them out of order and some too late, and at last one from the far future."""
    keyed_state(spark)
    lots, out, checkpoint = (work_folder(spark, name) for name in ("lots", "earliest", "earliest-log"))
    arriving = view(spark, folder, "arrivals_v")
    for lot in range(5):
        of_lot = arriving.filter(f"lot = {lot}").drop("lot") if lot < 4 else spark.sql(
            "select cast(null as bigint) as submission_id, -1L as event_id, timestamp_ntz '2100-01-01' as ts, 'end' as props, "
            "'completed' as state, 1 as n_artifacts")
        of_lot.write.mode("append").parquet(lots)
        run_to_table(earliest_completed_stream(spark.readStream.schema(of_lot.schema).parquet(lots), "1 day"), out, checkpoint)
    return spark.read.parquet(out)


def trace_latency(spark, folder):
    """Every line item as a timed run: latency, and whether it got a trace id of the usual form."""
    timed = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "cast(l_shipdate as timestamp) as started",
        "cast(l_shipdate as timestamp) + make_dt_interval(0, 0, 0, l_quantity / 8) as ended")
    return with_trace(timed, "started", "ended").select(
        "l_orderkey", "l_linenumber", "latency", F.rlike("trace_id", F.lit("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("traced"))


def results_round_trip(spark, folder):
    """Result documents written as JSON and read back by their schema."""
    path = work_folder(spark, "results")
    write_results(documents(spark, folder, lines=True), path)
    return board.overall(board.flatten_results(read_results(spark, path, heads=True)))


def prepared_round_trip(spark, folder):
    """Prepared tasks written by track; one track read back."""
    path = work_folder(spark, "prepared")
    write_tasks(built(spark, folder), path)
    return spark.read.parquet(path).filter("track = 'bdd'").select("task_id", "spec", "metadata")


def progress_log(spark, folder):
    """Attempts appended to a log in two goes and read back as text."""
    path = work_folder(spark, "progress")
    entries = table(spark, folder, "events").selectExpr(
        "event_id as iteration", "date_format(ts, 'yyyy-MM-dd') as logged_at", "concat('STORY-', user_id) as story_id",
        "case event_type when 'purchase' then 'PASS' when 'error' then 'FAIL' else 'RETRY' end as status", "props as notes")
    append_log(entries.filter("status = 'PASS'"), path)
    append_log(entries.filter("status <> 'PASS'"), path)
    return progress_text(spark.read.schema(entries.schema).json(path))


def progress_log_rerun(spark, folder):
    """Two batches of entries, the first appended again after the second: every entry is there once."""
    path = work_folder(spark, "progress")
    entries = table(spark, folder, "events").selectExpr(
        "event_id as iteration", "date_format(ts, 'yyyy-MM-dd') as logged_at", "concat('STORY-', user_id) as story_id",
        "case event_type when 'purchase' then 'PASS' when 'error' then 'FAIL' else 'RETRY' end as status", "props as notes")
    for batch in (0, 1, 0):
        append_batch(entries.filter(f"iteration % 2 = {batch}"), path, batch)
    return progress_text(spark.read.schema(entries.schema).json(path))


def dataset_lines(spark, folder):
    """Dataset lines written as text, some of them broken, and read once: each line is a record or a reject."""
    path = work_folder(spark, "dataset")
    view(spark, folder, "dataset_lines_v").select("line").write.text(path)
    return read_dataset_lines(spark, path).select("line", F.coalesce("n", F.lit(-1)).alias("n"), "entry_point", "reason")


def result_lines(spark, folder):
    """Result lines written as text, some of them broken, and read once."""
    path = work_folder(spark, "result-lines")
    view(spark, folder, "result_lines_v").select("line").write.text(path)
    return read_result_lines(spark, path).selectExpr("line", "get(results, 0).score as score", "reason")


QUERIES = {f.__name__: f for f in (
    progress_log_rerun, dataset_lines, result_lines, trace_latency, results_round_trip, prepared_round_trip, progress_log, first_completed, never_completed, first_text, first_text_part, syntax_valid, submission_lint, request_text,
    participant_names, request_metrics, stream_first_completed, stream_leaderboard,
    stream_earliest_completed)}

_LINT = with_views("code_v") + r""",
linted as (select *, contains(tests, case when track = 'tdd' then 'import pytest' else 'from pytest_bdd' end) as has_import,
  regexp_matches(tests, '(^|\n)def test_') as has_test_function, contains(tests, ':') as syntax_valid from code_v)"""
_DONE = with_views("agent_events_v") + """,
done as (select * from agent_events_v where state = 'completed' and n_artifacts > 0)"""

ORACLES = {
    "trace_latency": "select l_orderkey, l_linenumber, l_quantity / 8 as latency, true as traced from lineitem",
    "results_round_trip": BOARD + """select id, track, score, mutation_pct, fault_detection_pct, pass_rate, task_count
from board order by score desc, mutation_pct desc, id""",
    "prepared_round_trip": BUILT + """ select task_id, spec, concat('{"task_id":"', task_id, '","function_name":"', function_name,
  '","track":"tdd","source":"evalplus"}') as metadata from built where track = 'bdd'""",
    "dataset_lines": with_views("dataset_lines_v") + " select line, coalesce(n, -1) as n, entry_point, reason from dataset_lines_v",
    "result_lines": with_views("result_lines_v") + " select line, score, reason from result_lines_v",
    "progress_log": """select event_id as iteration, concat('## Iteration ', event_id, ' - ', strftime(ts, '%Y-%m-%d'), chr(10),
  'Story: STORY-', user_id, chr(10), 'Status: ',
  case event_type when 'purchase' then 'PASS' when 'error' then 'FAIL' else 'RETRY' end, chr(10), 'Notes: ', props, chr(10)) as entry
from events""",
    "first_completed": _DONE + """ select submission_id, event_id, ts, props from (
  select *, row_number() over (partition by submission_id order by ts, event_id) as n from done) where n = 1""",
    "never_completed": _DONE + """ select distinct submission_id, 'No tests returned' as error from agent_events_v
where submission_id not in (select submission_id from done)""",
    "first_text": with_views("submissions_v") + """ select submission_id, part_no,
  case when kind = 'text' then text else kind end as tests from submissions_v""",
    "first_text_part": with_views("submissions_v") + """ select submission_id, min(part_no) as part_no,
  arg_min(text, part_no) as tests from submissions_v where kind = 'text' group by submission_id""",
    "syntax_valid": _LINT + " select p_partkey, syntax_valid from linted",
    "submission_lint": _LINT + """ select p_partkey, has_import, has_test_function, syntax_valid,
  syntax_valid and has_import and (track <> 'tdd' or has_test_function) as lint_ok from linted""",
    "request_text": with_views("tasks_v") + " select ordinal, concat(track, ':', prompt) as request from tasks_v",
    "participant_names": "select c_custkey, case when c_nationkey % 3 = 0 then c_name else 'unknown' end as participant from customer",
    "request_metrics": with_views("code_v", "tasks_v") + """
select c.track, case when contains(tests, 'import os') then 'error' else 'success' end as status, count(*) as n,
  round(avg(length(prompt)), 6) as avg_spec_length, round(avg(length(tests)), 6) as avg_test_length,
  round(avg(length(tests) / 4), 6) as avg_generation_time
from code_v c join tasks_v t on t.ordinal = c.p_partkey + 1 group by 1, 2""",
    "stream_first_completed": _DONE + " select distinct submission_id, cast(1 as bigint) as n_passed from done",
    "stream_earliest_completed": with_views("arrivals_v") + """,
done as (select * from arrivals_v where state = 'completed' and n_artifacts > 0),
edges as (select lot, date_trunc('milliseconds', max(max(ts)) over (order by lot rows between unbounded preceding and 1 preceding)) - interval 1 day as edge
  from done group by lot),
judged as (select d.*, coalesce(ts >= edge, true) as in_time from done d join edges using (lot)),
firsts as (select *, row_number() over (partition by submission_id order by ts, event_id) as n from judged where in_time)
select submission_id, event_id, ts, props, 'first' as kind from firsts where n = 1
union all select submission_id, event_id, ts, props, 'late' from judged where not in_time""",
    "stream_leaderboard": BOARD + """select id, track, score, mutation_pct, fault_detection_pct, pass_rate, task_count
from board order by score desc, mutation_pct desc, id""",
}
ORACLES["progress_log_rerun"] = ORACLES["progress_log"]
