"""Streams by event time and boards that are updated bucket by bucket."""

from __future__ import annotations

import datetime as dt
import json
import os

from suitegauge.operators import submissions as sub
from suitegauge.streaming import leaderboard as board_stream
from suitegauge.streaming.submissions import earliest_completed_stream, keyed_state, run_to_table

EVENT = "submission_id bigint, event_id bigint, ts timestamp_ntz, props string, state string, n_artifacts int"


def at(hours: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_earliest_by_event_time_whatever_the_order_of_files(spark, tmp_path):
    keyed_state(spark)
    lots = [
        [(1, 1, at(5), "a", "completed", 1), (1, 2, at(4.5), "b", "completed", 1), (2, 3, at(5), "c", "working", 1), (4, 9, at(5), "n", "completed", 0)],
        # Earlier than what came before, within the delay; two behind it; equal times go by id.
        [(1, 4, at(4.2), "d", "completed", 1), (2, 5, at(3), "late", "completed", 1), (1, 15, at(2), "late", "completed", 1),
         (2, 6, at(8), "x", "completed", 1), (3, 12, at(7.5), "p", "completed", 1), (3, 11, at(7.5), "q", "completed", 1)],
        # A second event of an answered submission is no second answer.
        [(2, 7, at(7.5), "y", "completed", 1), (1, 8, at(9), "z", "completed", 1)],
        [(None, 99, at(900), "end", "completed", 1)],
    ]
    source, out, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    for lot in lots:
        spark.createDataFrame(lot, EVENT).coalesce(1).write.mode("append").parquet(source)
        run_to_table(earliest_completed_stream(spark.readStream.schema(EVENT).parquet(source), "1 hour"), out, log)
    rows = spark.read.parquet(out).collect()
    late = {(r.submission_id, r.event_id) for r in rows if r.kind == "late"}
    assert late == {(2, 5), (1, 15)}
    in_time = spark.createDataFrame([e for lot in lots[:-1] for e in lot if e[:2] not in late], EVENT)
    first = [(r.submission_id, r.event_id, r.ts, r.props) for r in rows if r.kind == "first"]
    assert sorted(first) == sorted((r.submission_id, r.event_id, r.ts, r.props) for r in sub.first_completed(in_time).collect())
    assert {f[0]: f[1] for f in first} == {1: 4, 2: 7, 3: 11}


def document(name, track="tdd", score=0.5, trace="t"):
    return {"participants": {"agent": name}, "trace_id": trace, "results": [{
        "score": score, "pass_rate": 0.5, "task_rewards": {"mutation_score": 0.5, "fault_detection_rate": 0.5, "track": track, "task_count": 5},
        "detail": {"task_details": []}}]}


def test_board_rewrites_only_the_buckets_of_changed_participants(spark, tmp_path):
    source, out, log = (str(tmp_path / n) for n in ("in", "board", "log"))
    os.makedirs(source)
    clock = iter(range(1_000_000, 2_000_000, 10))

    def arrive(*documents):
        path = os.path.join(source, f"{(now := next(clock))}.json")
        with open(path, "w") as file:
            file.write("\n".join(json.dumps(d) for d in documents))
        os.utime(path, (now, now))

    def refresh(checkpoint=log):
        stream = board_stream.read_result_stream(spark, source)
        board_stream.keep_board(board_stream.newest_results(stream), out, checkpoint, buckets=8)
        return {(r.id, r.track): r.score for r in board_stream.read_board(spark, out).collect()}

    def files():
        return {os.path.join(folder, f) for folder, _, names in os.walk(os.path.join(out, "data")) for f in names if f.endswith(".parquet")}

    arrive(*[document(f"p{n}", score=n / 100) for n in range(40)])
    assert refresh() == {(f"p{n}", "tdd"): n / 100 for n in range(40)}
    first = files()
    assert 4 < len({os.path.dirname(f) for f in first}) <= 8
    # One participant's new result touches one bucket: its other slot is written, and nothing else.
    arrive(document("p7", score=0.9))
    board = refresh()
    assert board[("p7", "tdd")] == 0.9 and len(board) == 40 and len({os.path.dirname(f) for f in files() - first}) == 1 and first < files()
    # A further track is a row of its own, and an update of the same participant goes back to the first slot.
    arrive(document("p7", score=0.3), document("p7", track="bdd", score=0.2))
    board = refresh()
    assert board[("p7", "tdd")] == 0.3 and board[("p7", "bdd")] == 0.2 and len(board) == 41
    # A new checkpoint reads all files again: the newest results win and the board stays as it is.
    assert refresh(str(tmp_path / "other-log")) == board
    assert refresh() == board


def test_board_survives_a_batch_that_ran_twice(spark, tmp_path):
    """What a lost driver leaves: buckets written, and the map not yet; or both, and the batch not yet committed."""
    source, out = str(tmp_path / "in"), str(tmp_path / "board")
    os.makedirs(source)
    with open(os.path.join(source, "1.json"), "w") as file:
        file.write(json.dumps(document("a", score=0.4)))
    for run in range(3):
        stream = board_stream.read_result_stream(spark, source)
        board_stream.keep_board(board_stream.newest_results(stream), out, str(tmp_path / f"log{run}"), buckets=4)
        if run == 1:
            # The map of the second run is lost, its buckets are there.
            for name in os.listdir(os.path.join(out, "map", "entry=2")):
                os.remove(os.path.join(out, "map", "entry=2", name))
        assert [(r.id, r.score) for r in board_stream.read_board(spark, out).collect()] == [("a", 0.4)]
