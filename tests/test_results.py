"""Result documents, leaderboards, submissions and the streaming jobs."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from suitegauge.operators import leaderboard as board
from suitegauge.operators import submissions as sub
from suitegauge.plans.catalog import QUERIES
from suitegauge.schemas import RESULT_DOCUMENT
from suitegauge.sources import results
from suitegauge.streaming import leaderboard as board_stream
from suitegauge.streaming.submissions import first_completed_stream, run_to_table

FOLDER = "/root/testdata/sf0.001"


def document(name, track="tdd", score=0.5, mutation=0.5, detection=0.5, passed=0.5, tasks=5):
    return {"participants": {"agent": name}, "results": [{
        "score": score, "pass_rate": passed,
        "task_rewards": {"mutation_score": mutation, "fault_detection_rate": detection, "track": track, "task_count": tasks},
        "detail": {"task_details": []}}]}


def write(folder, name, *documents, at=None):
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        f.write("\n".join(json.dumps(d) for d in documents))
    if at:
        os.utime(path, (at, at))


def test_absent_figures_are_zero(spark, tmp_path):
    write(tmp_path, "a.json", {"participants": {"agent": "bare"}, "results": [{"task_rewards": {"track": "tdd"}}]},
          {"participants": {"agent": "none"}, "results": []}, document("full", mutation=0.98765, detection=1.0, passed=0.65))
    rows = {r.id: r for r in board.overall(board.flatten_results(results.read_results(spark, str(tmp_path)))).collect()}
    assert set(rows) == {"bare", "full"}
    assert tuple(rows["bare"])[2:] == (0.0, 0.0, 0.0, 0.0, 0)
    assert (rows["full"].mutation_pct, rows["full"].fault_detection_pct, rows["full"].pass_rate) == (98.8, 100.0, 0.7)


def test_write_replaces_and_reads_back(spark, tmp_path):
    path = str(tmp_path / "out")
    frame = spark.createDataFrame([document("a") | {"trace_id": "t", "latency": 1.5, "part": 0}], RESULT_DOCUMENT)
    results.write_results(frame, path)
    results.write_results(frame, path)
    assert results.read_results(spark, path).collect() == frame.collect()


def test_boards_do_not_parse_details(spark, tmp_path):
    write(tmp_path, "a.json", document("a"))
    plan = board.overall(board.flatten_results(results.read_results(spark, str(tmp_path))))._jdf.queryExecution().toString()
    schema = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert schema and "task_details" not in schema[-1].split("ReadSchema")[1]


def test_rank_shares_and_top_k_numbers(spark):
    rows = spark.createDataFrame(
        [("a", "tdd", 0.9, 50.0), ("b", "tdd", 0.9, 50.0), ("c", "tdd", 0.8, 99.0), ("d", "tdd", 0.9, 60.0), ("e", "bdd", 0.1, 0.0)],
        "id string, track string, score double, mutation_pct double")
    assert {r.id: r["rank"] for r in board.ranked(rows).collect()} == {"d": 1, "a": 2, "b": 2, "c": 4, "e": 1}
    assert {r.id: r["rank"] for r in board.top_k(rows, 2).collect()} == {"d": 1, "a": 2, "e": 1}
    assert "WindowGroupLimit" in board.top_k(rows, 2)._jdf.queryExecution().executedPlan().toString()


def test_progress_log_is_only_appended(spark, tmp_path):
    entry = spark.createDataFrame([(1, "now", "STORY-001", "PASS", "fine")],
                                  "iteration int, logged_at string, story_id string, status string, notes string")
    for _ in range(2):
        results.append_log(entry, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert results.progress_text(entry).first().entry == "## Iteration 1 - now\nStory: STORY-001\nStatus: PASS\nNotes: fine\n"


EVENTS = "submission_id bigint, event_id bigint, ts timestamp_ntz, state string, n_artifacts int"


def events(spark, *rows):
    t = dt.datetime(2026, 1, 1)
    return spark.createDataFrame([(s, e, t + dt.timedelta(minutes=m), state, n) for s, e, m, state, n in rows], EVENTS)


def test_first_completed(spark):
    frame = events(spark, (1, 1, 0, "working", 1), (1, 2, 5, "completed", 1), (1, 3, 4, "completed", 1), (1, 4, 1, "completed", 0),
                   (2, 5, 0, "failed", 1), (3, 6, 7, "completed", 2), (3, 7, 7, "completed", 2))
    assert {r.submission_id: r.event_id for r in sub.first_completed(frame).collect()} == {1: 3, 3: 6}
    assert [r.submission_id for r in sub.never_completed(frame).collect()] == [2]
    assert "WindowGroupLimit" in sub.first_completed(frame)._jdf.queryExecution().executedPlan().toString()


def test_stream_of_events_agrees_with_batch(spark, tmp_path):
    source = str(tmp_path / "events")
    frame = events(spark, *[(n % 7, n, n, "completed" if n % 3 else "working", n % 2) for n in range(60)])
    for half in ("event_id < 30", "event_id >= 30"):
        frame.filter(half).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_to_table(first_completed_stream(stream, "2 hours"), str(tmp_path / "out"), str(tmp_path / "log"))
    seen = [r.submission_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(seen) == sorted(r.submission_id for r in sub.first_completed(frame).collect())


def test_board_follows_arriving_documents(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "board", "log"))
    os.makedirs(source)

    def refresh():
        stream = board_stream.read_result_stream(spark, source, files_per_batch=1)
        board_stream.keep_snapshots(board_stream.latest_per_participant(stream), out, log, slots=2)
        return {(r.id, r.track): r.score for r in board_stream.read_snapshot(spark, out).collect()}

    write(source, "1.json", document("a", score=0.1), at=1_000_000)
    write(source, "2.json", document("b", score=0.2), at=1_000_010)
    assert refresh() == {("a", "tdd"): 0.1, ("b", "tdd"): 0.2}
    # A later result replaces the former one of the same participant and track, and only that.
    write(source, "3.json", document("a", score=0.7), at=1_000_020)
    write(source, "4.json", document("a", track="bdd", score=0.4), at=1_000_030)
    assert refresh() == {("a", "tdd"): 0.7, ("b", "tdd"): 0.2, ("a", "bdd"): 0.4}
    batch = spark.read.schema(RESULT_DOCUMENT).json(source).withColumn(
        "arrived", F.struct("_metadata.file_modification_time", "_metadata.file_path"))
    twin = {(r.id, r.track): r.score for r in board_stream.latest_per_participant(batch).collect()}
    assert twin == {("a", "tdd"): 0.7, ("b", "tdd"): 0.2, ("a", "bdd"): 0.4}
    assert len([d for d in os.listdir(out) if d.startswith("slot=")]) == 2
    # A new checkpoint counts its batches from 0 again; its board is the newer one all the same.
    write(source, "5.json", document("b", score=0.9), at=1_000_040)
    again = board_stream.latest_per_participant(board_stream.read_result_stream(spark, source))
    board_stream.keep_snapshots(again, out, str(tmp_path / "other-log"), slots=2)
    assert {(r.id, r.track): r.score for r in board_stream.read_snapshot(spark, out).collect()}[("b", "tdd")] == 0.9


def test_first_text(spark):
    part = "struct<kind:string,text:string>"
    rows = [(1, [([("file", "x"), ("text", "first")],), ([("text", "second")],)]), (2, [([("file", "x")],)]), (3, [])]
    frame = spark.createDataFrame(rows, f"id int, artifacts array<struct<parts:array<{part}>>>")
    assert {r.id: r.tests for r in sub.first_text(frame).collect()} == {1: "first", 2: None, 3: None}


@pytest.mark.parametrize("track,code,ok", [
    ("tdd", "import pytest\ndef test_a():\n    pass\n", True), ("tdd", "def test_a():\n    pass\n", False),
    ("tdd", "import pytest\n  def test_a(): pass", False), ("tdd", "import pytest\nx = 1\n", False),
    ("bdd", "from pytest_bdd import given\n", True), ("bdd", "import pytest\n", False), ("other", "import pytest", False)])
def test_lint(spark, track, code, ok):
    frame = spark.createDataFrame([(track, code)], "track string, tests string")
    assert sub.lint_submissions(frame).first().lint_ok is ok


NO_PAIRS = ("CartesianProduct", "BroadcastNestedLoopJoin")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream_")])
def test_no_query_pairs_all_rows(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in NO_PAIRS)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data tables")
def test_scans_read_only_what_is_used(spark):
    plan = QUERIES["mutation_score"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan


def test_ranks_keep_rows_without_a_track(spark):
    rows = spark.createDataFrame([("a", None, 0.5, 10.0), ("b", None, 0.7, 10.0), ("c", "tdd", None, 1.0)],
                                 "id string, track string, score double, mutation_pct double")
    assert {r.id: r["rank"] for r in board.ranked(rows).collect()} == {"b": 1, "a": 2, "c": 1}


def test_lines_that_are_no_documents_are_rejects(spark, tmp_path):
    good = '{"participants":{"agent":"p"},"results":[{"score":0.5,"task_rewards":{"track":"tdd"}}],"part":0}'
    (tmp_path / "a.json").write_text("\n".join([good, good.replace("0.5", '"0.85"'), good[:40], "[]", ""]))
    found = {r.line: r.reason for r in results.result_rejects(spark, str(tmp_path)).collect()}
    assert found == {good.replace("0.5", '"0.85"'): "score is not a number", good[:40]: "not a result document", "[]": "not a result document"}


def test_boards_read_heads_and_make_their_rows_once(spark, tmp_path):
    detail = {"task_details": [{"task_id": "task_001", "mutation_score": 0.5}]}
    one = document("a")
    one["results"][0]["detail"] = detail
    write(tmp_path, "a.json", one, document("b", score=0.75))
    heads = results.read_results(spark, str(tmp_path), heads=True)
    assert "detail" not in heads.schema["results"].dataType.elementType.names
    found = board.overall(board.flatten_results(heads))
    assert [r.id for r in found.collect()] == ["b", "a"]
    assert found.collect() == board.overall(board.flatten_results(results.read_results(spark, str(tmp_path)))).collect()
    # Sorting samples its input: that is a shuffle, not the files.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("rangepartitioning") < plan.index("hashpartitioning(id")


def test_documents_that_are_text_are_written_as_they_are(spark, tmp_path):
    lines = spark.createDataFrame([(json.dumps(document(name)),) for name in ("a", "\u00e9\n")], "document string")
    results.write_results(lines, str(tmp_path / "r"))
    assert {r.participants["agent"] for r in results.read_results(spark, str(tmp_path / "r")).collect()} == {"a", "\u00e9\n"}
