from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from suitegauge.functions import scoring as S
from suitegauge.operators import documented, quality, scoring

RUN_COLUMNS = ("participant string, track string, ordinal bigint, target string, exit_code int, "
               "timed_out boolean, ts timestamp_ntz")
T0 = dt.datetime(2026, 1, 1)


def run(target, exit_code, timed_out=False, at=0, ordinal=1, participant="p"):
    return (participant, "tdd", ordinal, target, exit_code, timed_out, T0 + dt.timedelta(seconds=at))


def runs(spark, *rows):
    return spark.createDataFrame(list(rows), RUN_COLUMNS)


@pytest.mark.parametrize("exit_code,timed_out,expected,passed", [
    (0, False, "none", True), (1, False, "assertion", False), (2, False, "infrastructure", False),
    (5, False, "infrastructure", False), (0, True, "timeout", False), (1, None, "assertion", False)])
def test_classes(spark, exit_code, timed_out, expected, passed):
    row = scoring.classify_runs(runs(spark, run("correct", exit_code, timed_out))).first()
    assert (row.failure_type, row.passed) == (expected, passed)
    assert row.exit_code == (1 if timed_out else exit_code)


@pytest.mark.parametrize("correct,buggy,reference,strict", [
    (0, 1, 1.0, 1.0), (0, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 0, 0.0, 0.0), (0, 2, 1.0, 0.0), (0, None, 0.0, 0.0),
    (None, 1, 0.0, 0.0)])
def test_fault_detection(spark, correct, buggy, reference, strict):
    sides = [run(side, code) for side, code in (("correct", correct), ("buggy", buggy)) if code is not None]
    pairs = scoring.pair_runs(runs(spark, *sides))
    for mode, expected in (("reference", reference), ("strict", strict)):
        assert scoring.with_fault_detection(pairs, mode).first().fault_detection_rate == expected


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        scoring.with_fault_detection(scoring.pair_runs(runs(spark, run("correct", 0))), "lenient")


def test_latest_run_counts_and_ties_go_to_the_graver_class(spark):
    pairs = scoring.pair_runs(runs(
        spark, run("correct", 1, at=1), run("correct", 0, at=2), run("buggy", 0, at=3), run("buggy", 2, at=3))).first()
    assert (pairs.correct_code, pairs.buggy_code) == (S.NONE, S.INFRASTRUCTURE)


@pytest.mark.parametrize("output,error,counts,score", [
    ("4/4 mutants killed", None, (4, 0, 4), 1.0),
    ("0/4 mutants killed", None, (0, 4, 4), 0.0),
    ("3/4 mutants killed", None, (3, 1, 4), 0.75),
    ("1/1 mutant killed", None, (1, 0, 1), 1.0),
    ("Killed: 6\nSurvived: 2", None, (6, 2, 8), 0.75),
    ("killed 5", None, (5, 0, 5), 1.0),
    ("Survived: 2", None, (0, 0, 0), 0.0),
    ("nothing", None, (0, 0, 0), 0.0),
    ("Killed: 9\n1/2 mutants killed", None, (1, 1, 2), 0.5),
    ("5/4 mutants killed", None, (5, -1, 4), 1.25),
    ("4/4 mutants killed", "mutation testing timed out", (0, 0, 0), 0.0)])
def test_mutation_logs(spark, output, error, counts, score):
    logs = spark.createDataFrame([(output, error)], "output string, error string")
    row = scoring.parse_mutation_logs(logs).first()
    assert ((row.killed, row.survived, row.total), row.mutation_score, row.error) == (counts, score, error)


@pytest.mark.parametrize("mutation,detection,score", [
    (0.8, 0.5, 0.68), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.6), (0.0, 1.0, 0.4), (None, 1.0, 0.4),
    (0.75, None, 0.45), (None, None, 0.0)])
def test_composite(spark, mutation, detection, score):
    frame = spark.createDataFrame([(mutation, detection)], "m double, d double")
    assert frame.select(S.composite("m", "d")).first()[0] == score


def test_rounding_equals_python(spark):
    draw = random.Random(3)
    values = [k / 1000 for k in range(1001)] + [draw.random() for _ in range(3000)]
    values += [0.6 * a / 12 + 0.4 * b / 250 for a in range(13) for b in range(251)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    wrong = [(r.v, r.x) for r in frame.select("v", S.round_cents("v").alias("x")).collect() if r.x != round(r.v, 2)]
    assert wrong == []


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.booleans(), st.integers(0, 3), st.integers(0, 12)), min_size=1, max_size=12))
def test_scores_stay_in_range_and_are_monotone(spark, rows):
    data = [r for n, (code, late, buggy, killed) in enumerate(rows, 1) for r in (
        run("correct", code, late, ordinal=n), run("buggy", buggy, ordinal=n))]
    logs = [("p", "tdd", n, f"{k}/12 mutants killed", None) for n, (_, _, _, k) in enumerate(rows, 1)]
    frame = spark.createDataFrame(logs, "participant string, track string, ordinal bigint, output string, error string")
    outcomes = scoring.task_outcomes(
        scoring.pair_runs(runs(spark, *data)), scoring.mutation_per_task(scoring.parse_mutation_logs(frame)))
    for row in outcomes.collect():
        assert 0 <= row.mutation_score <= 1 and row.fault_detection_rate in (0.0, 1.0)
        assert row.composite_score == round(0.6 * row.mutation_score + 0.4 * row.fault_detection_rate, 2)
        assert row.fault_detection_rate == float(row.passed_correct and row.failed_buggy)


def sample(spark, n_tasks=7):
    data = [r for n in (1, 2, 4, 9) for r in (run("correct", 0, ordinal=n), run("buggy", n % 2, ordinal=n))]
    logs = spark.createDataFrame(
        [("p", "tdd", 1, "1/3 mutants killed", None), ("p", "tdd", 2, "2/3 mutants killed", None),
         ("p", "tdd", 4, "9/3 mutants killed", None), ("p", "tdd", 9, "3/3 mutants killed", None)],
        "participant string, track string, ordinal bigint, output string, error string")
    outcomes = scoring.task_outcomes(
        scoring.pair_runs(runs(spark, *data)), scoring.mutation_per_task(scoring.parse_mutation_logs(logs)))
    evaluations = spark.createDataFrame(
        [("p", "tdd", n_tasks), ("q", "bdd", 3), ("r", "tdd", 0)], "participant string, track string, task_count int")
    return evaluations, outcomes


def test_details_hold_every_expected_task_once(spark):
    evaluations, outcomes = sample(spark)
    rows = scoring.task_details(evaluations, outcomes).orderBy("participant", "ordinal").collect()
    assert [(r.participant, r.task_id) for r in rows] == [("p", f"task_{i:03d}") for i in range(1, 8)] + [
        ("q", f"task_{i:03d}") for i in range(1, 4)]
    by_task = {r.ordinal: r for r in rows if r.participant == "p"}
    assert by_task[1].fault_detection_rate == 1.0 and by_task[1].mutation_score == 1 / 3
    # A log that claims more kills than mutants makes its task a zero row.
    assert (by_task[4].mutation_score, by_task[4].passed_correct) == (0.0, False)
    assert by_task[3].composite_score == 0.0


def test_both_summaries_agree(spark):
    evaluations, outcomes = sample(spark)
    dense = {(r.participant, r.track): r for r in scoring.summarize_runs(scoring.task_details(evaluations, outcomes)).collect()}
    sparse = {(r.participant, r.track): r for r in scoring.summarize_outcomes(evaluations, outcomes).collect()}
    assert set(sparse) - set(dense) == {("r", "tdd")}
    for key, row in dense.items():
        assert row == sparse[key]
    assert sparse["r", "tdd"].score == 0.0 and sparse["r", "tdd"].task_count == 0
    assert dense["p", "tdd"].mutation_score == pytest.approx(1 / 7, abs=1e-12)
    assert dense["p", "tdd"].pass_rate == pytest.approx(1 / 7, abs=1e-12)


def test_blocks_of_tasks_join_up(spark):
    evaluations = spark.createDataFrame([("p", "tdd", 25)], "participant string, track string, task_count int")
    ordinals = [r.ordinal for r in scoring.expected_tasks(evaluations, block=10).collect()]
    assert sorted(ordinals) == list(range(1, 26))


def test_long_runs_continue_in_further_parts(spark):
    evaluations, outcomes = sample(spark)
    details = scoring.task_details(evaluations, outcomes)
    summary = scoring.summarize_outcomes(evaluations, outcomes)
    parts = scoring.to_envelope(summary, details, chunk=3)
    whole = scoring.to_envelope(summary, details)
    assert parts.count() == 3 + 1 + 1 and whole.count() == 3
    assert max(len(r.results[0].detail.task_details) for r in parts.collect()) == 3
    assert sorted(scoring.flatten_details(parts).collect()) == sorted(scoring.flatten_details(whole).collect())


def test_envelope_shape(spark):
    evaluations, outcomes = sample(spark)
    details = scoring.task_details(evaluations, outcomes)
    document = scoring.to_envelope(scoring.summarize_runs(details), details).filter("participants['agent'] = 'p'").first()
    result = document.results[0]
    assert document.participants == {"agent": "p"}
    assert result.task_rewards.track == "tdd" and result.task_rewards.task_count == 7
    assert [d.task_id for d in result.detail.task_details] == [f"task_{i:03d}" for i in range(1, 8)]
    assert result.score == round(0.6 * result.task_rewards.mutation_score + 0.4 * result.task_rewards.fault_detection_rate, 2)


def test_trace_and_latency(spark):
    frame = spark.createDataFrame([("p",), ("q",)], "participant string").withColumns({
        "a": F.to_timestamp(F.lit("2026-01-01 00:00:00")), "b": F.to_timestamp(F.lit("2026-01-01 00:00:01.5"))})
    rows = scoring.with_trace(frame, "a", "b").collect()
    assert {r.latency for r in rows} == {1.5} and len({r.trace_id for r in rows}) == 2


def test_validation_reasons(spark):
    frame = spark.createDataFrame(
        [(0.5, "tdd", 1), (1.5, "bdd", 1), (0.5, "other", 1), (0.5, "tdd", -1), (None, "tdd", 1), (0.1, None, 0)],
        "score double, track string, task_count int")
    good, rejects = quality.validate_scores(frame)
    assert good.count() == 1
    counts = {r.reason: r.n for r in quality.reject_counts(rejects).collect()}
    assert counts == {"score outside [0, 1]": 2, "track not one of tdd, bdd": 2, "task_count is negative": 1}


def test_all_violations_are_listed(spark):
    frame = spark.createDataFrame([(2.0, "x")], "score double, track string")
    rules = [quality.unit_range_rule("score"), quality.track_rule()]
    assert len(quality.all_violations(frame, rules).first().violations) == 2


def test_quantiles_are_exact(spark):
    draw = random.Random(5)
    rows = [("hot" if draw.random() < 0.7 else "cold", round(draw.expovariate(1), 3), n) for n in range(6000)]
    frame = spark.createDataFrame(rows, "g string, execution_time double, run_id bigint")
    for row in documented.latency_summary(frame, ["g"], accuracy=200).collect():
        values = sorted(v for g, v, _ in rows if g == row.g)
        for share, name in ((0.5, "p50_latency"), (0.95, "p95_latency"), (0.99, "p99_latency")):
            assert row[name] == values[-(-int(share * 1000) * len(values) // 1000) - 1]
        slowest = max((v, -n) for g, v, n in rows if g == row.g)
        assert row.slowest == -slowest[1] and row.total_steps == len(values)


@pytest.mark.parametrize("bins,few", [(2, 1), (10, 50), (1_000, 4_096)])
def test_quantiles_of_a_hot_group_pass_no_window(spark, bins, few):
    draw = random.Random(few)
    values = [draw.uniform(0, 1e-6) for _ in range(1500)] + [10.0 ** draw.uniform(-3, 9) for _ in range(500)] + [7.5] * 300
    frame = spark.createDataFrame([("hot", v, n) for n, v in enumerate(values)] + [("one", 4.0, 1), (None, 2.0, 5)],
                                  "g string, execution_time double, run_id bigint")
    summary = documented.latency_summary(frame, ["g"], accuracy=bins, few=few)
    assert "Window" not in summary._jdf.queryExecution().executedPlan().toString()
    rows, values = {r.g: r for r in summary.collect()}, sorted(values)
    for share, name in ((500, "p50_latency"), (950, "p95_latency"), (990, "p99_latency")):
        assert rows["hot"][name] == values[-(-share * len(values) // 1000) - 1]
        assert rows["one"][name] == 4.0 and rows[None][name] == 2.0


def test_multi_class_summary(spark):
    text = "Mutants:\n  - killed: 45 (caught)\n  - survived: 3\n  - suspicious: 1\n  - timeout: 2\n"
    row = documented.multi_class_mutation(spark.createDataFrame([(text,)], "summary string")).first()
    assert (row.killed, row.survived, row.suspicious, row.timeout, row.mutation_score) == (45, 3, 1, 2, 0.9375)


def test_four_part_composite(spark):
    frame = spark.createDataFrame([(1.0, 0.5, None, 1.0)],
                                  "mutation_score double, spec_coverage double, fault_detection_rate double, impl_independence double")
    assert documented.composite4(frame).first().composite4 == round(0.3 + 0.125 + 0.2, 2)


def test_latency_of_text_labels_and_null_groups(spark):
    frame = spark.createDataFrame([(None, 1.0, "step-002"), (None, 3.0, "step-009"), (None, 3.0, "step-007"), ("g", None, "step-001")],
                                  "g string, execution_time double, run_id string")
    rows = {r.g: r for r in documented.latency_summary(frame, ["g"]).collect()}
    assert (rows[None].slowest, rows[None].p50_latency, rows[None].p99_latency, rows[None].total_steps) == ("step-007", 3.0, 3.0, 3)
    assert rows["g"].total_steps == 0 and rows["g"].p50_latency is None and rows["g"].slowest is None


def test_outcomes_outside_runs_are_rejects(spark):
    evaluations = spark.createDataFrame([("p", "tdd", 25), ("q", "tdd", 0)], "participant string, track string, task_count int")
    outcomes = spark.createDataFrame([("p", "tdd", n, 1.0, 1.0, True, True) for n in (0, 1, 25, 26, 99)] + [("q", "tdd", 1, 1.0, 1.0, True, True),
                                      ("r", "tdd", 1, 1.0, 1.0, True, True)],
                                     "participant string, track string, ordinal bigint, mutation_score double, fault_detection_rate double, "
                                     "passed_correct boolean, failed_buggy boolean")
    found = {(r.participant, r.ordinal): r.reason for r in scoring.outcome_rejects(evaluations, outcomes, block=10).collect()}
    assert found == {("p", 0): "task outside the run", ("p", 26): "task outside the run", ("p", 99): "task outside the run",
                     ("q", 1): "task outside the run", ("r", 1): "participant not evaluated"}
    sums = {r.participant: r.pass_rate for r in scoring.summarize_outcomes(evaluations, outcomes, block=10).collect()}
    assert sums == {"p": 2 / 25, "q": 0.0}


def _sparse(spark, tasks=25_000):
    evaluations = spark.createDataFrame([("p", "tdd", tasks), ("q", "tdd", 0), ("r", "tdd", 3)], "participant string, track string, task_count long")
    outcomes = spark.createDataFrame(
        [("p", "tdd", n, 0.5, 1.0, 0.7, True, True) for n in (1, 2, 9_999, 10_000, 10_001, 20_500, tasks, tasks + 1)] + [("r", "tdd", 2, 0.25, 0.0, 0.15, True, False)],
        "participant string, track string, ordinal long, mutation_score double, fault_detection_rate double, composite_score double, "
        "passed_correct boolean, failed_buggy boolean")
    return evaluations, outcomes


def test_zero_rows_are_made_where_they_stand(spark):
    evaluations, outcomes = _sparse(spark)
    details = scoring.task_details(evaluations, outcomes)
    rows = {(r.participant, r.ordinal): r for r in details.collect()}
    assert sorted(rows) == [("p", n) for n in range(1, 25_001)] + [("r", n) for n in (1, 2, 3)]
    assert {n for (p, n), r in rows.items() if p == "p" and r.mutation_score == 0.5 and r.failed_buggy} == {1, 2, 9_999, 10_000, 10_001, 20_500, 25_000}
    assert sum(r.composite_score for r in rows.values()) == pytest.approx(7 * 0.7 + 0.15)
    assert (rows["p", 7].task_id, rows["p", 700].task_id, rows["p", 7_000].task_id) == ("task_007", "task_700", "task_7000")
    # Rows are spelled out behind the last shuffle.
    plan = details._jdf.queryExecution().executedPlan().toString()
    assert "sequence(first" in plan.split("Exchange")[0]


def test_documents_of_lists_equal_documents_of_rows(spark):
    evaluations, outcomes = _sparse(spark)
    summary = scoring.summarize_outcomes(evaluations, outcomes)

    def content(documents):
        return sorted((r.participants["agent"], r.part, r.results) for r in documents.collect())

    whole = content(scoring.to_envelope(summary, scoring.task_details(evaluations, outcomes), 5_000))
    assert content(scoring.to_envelope(summary, scoring.task_lists(evaluations, outcomes), 5_000)) == whole
    assert [(p, part) for p, part, _ in whole] == [("p", n) for n in range(5)] + [("q", 0), ("r", 0)]
    with pytest.raises(ValueError):
        scoring.to_envelope(summary, scoring.task_lists(evaluations, outcomes), 3_000)


def test_zero_rows_are_counted_where_they_need_not_be_listed(spark):
    evaluations, outcomes = _sparse(spark)
    rows, stretches = (scoring.task_details(evaluations, outcomes, spelled=spelled) for spelled in (True, False))
    assert sorted(scoring.summarize_runs(stretches).collect()) == sorted(scoring.summarize_runs(rows).collect())
    assert sorted(documented.track_comparison(stretches).collect()) == sorted(documented.track_comparison(rows).collect())
    assert stretches.count() < 20
    # Listed, these would be 300 million rows.
    long, _ = _sparse(spark, 300_000_000)
    run = {r.participant: r for r in scoring.summarize_runs(scoring.task_details(long, outcomes, spelled=False)).collect()}["p"]
    assert (run.task_count, run.mutation_score) == (300_000_000, pytest.approx(8 * 0.5 / 300_000_000))


@pytest.mark.parametrize("chunk,block", [(10_000, 10_000), (100, 10_000), (7, 9_996), (30, 9_990)])
def test_documents_as_lines_are_the_text_of_documents(spark, chunk, block):
    evaluations, outcomes = _sparse(spark, 12_345)
    summary = scoring.summarize_outcomes(evaluations, outcomes).withColumn("note", F.lit('a "task_details":[] b'))
    lists = scoring.task_lists(evaluations, outcomes, block)
    documents = scoring.to_envelope(summary, scoring.task_details(evaluations, outcomes), chunk, carry=("note",))
    lines = scoring.to_envelope(summary, lists, chunk, carry=("note",), block=block, lines=True)
    assert sorted(r.document for r in lines.collect()) == sorted(documents.toJSON().collect())
    assert sorted(scoring.to_envelope(summary, lists, chunk, carry=("note",), block=block).toJSON().collect()) == sorted(documents.toJSON().collect())
    with pytest.raises(ValueError):
        scoring.to_envelope(summary, lines=True)
