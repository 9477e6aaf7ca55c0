"""From run outcomes and mutation logs to task details, run summaries and result documents.

Runs carry (participant, track, ordinal, target, exit_code, timed_out, ts); logs
carry (participant, track, ordinal, output, error). Both are reduced to one row
per task by hash aggregation on the same keys, so the join between them needs no
further shuffle, and a hot task or participant is folded before it travels.

``run`` names the columns that tell one evaluation from another: participant and
track, unless evaluations have an identity of their own (``evaluations``).
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from suitegauge.functions import scoring as S
from suitegauge.operators.quality import computed_once
from suitegauge.schemas import FAILURE_TYPES

KEYS = ("participant", "track", "ordinal")
RUN = ("participant", "track")
BLOCK = 10_000
"""Tasks of a run that are one row until they are spelled out."""
SALTS = 1_024
"""Lots of runs that share what they have in common."""
PIECE = 20
"""Tasks, none of which ran, whose text is made as one."""


def classify_runs(runs: DataFrame) -> DataFrame:
    """Adds failure_type and passed; a timeout counts as exit code 1."""
    return runs.withColumns({
        "failure_type": S.failure_type(S.FAILURE_CODE),
        "passed": F.expr(f"{S.FAILURE_CODE} = {S.NONE}"),
        "exit_code": F.expr("case when coalesce(timed_out, false) then 1 else exit_code end"),
    })


def failure_breakdown(runs: DataFrame, *by: str) -> DataFrame:
    """Runs per failure class as columns: one aggregation, no pivot pass."""
    return runs.groupBy(*by).agg(*[
        F.expr(f"count_if({S.FAILURE_CODE} = {position}) as n_{name}") for position, name in enumerate(FAILURE_TYPES)])


def pair_runs(runs: DataFrame, targets: tuple[str, ...] = ("correct", "buggy"), run: tuple[str, ...] = RUN) -> DataFrame:
    """One row per task with the class of its latest run on each target (null: never run).

    Per target and class the latest time is kept, and the class with the latest
    of these wins; on equal times the graver class. All buffers are fixed-width,
    so this is a hash aggregation with a map-side part and no self-join.
    """
    codes = range(len(FAILURE_TYPES))
    latest = runs.groupBy(*run, "ordinal").agg(*[
        F.expr(f"max(case when target = '{t}' and {S.FAILURE_CODE} = {k} then ts end) as _{t}_{k}")
        for t in targets for k in codes])

    def winner(target: str) -> str:
        newest = "greatest(" + ", ".join(f"_{target}_{k}" for k in codes) + ")"
        cases = " ".join(f"when _{target}_{k} = {newest} then {k}" for k in reversed(codes))
        return f"case {cases} end as {target}_code"

    return latest.selectExpr(*run, "ordinal", *[winner(t) for t in targets])


def with_fault_detection(pairs: DataFrame, mode: str = "reference") -> DataFrame:
    """Adds passed_correct, failed_buggy and fault_detection_rate (1.0 or 0.0).

    ``reference``: passed on the correct code and did not pass on the buggy code,
    for whatever reason. ``strict``: the buggy side must have failed an assertion.
    A missing side scores 0.
    """
    failed = {"reference": f"buggy_code <> {S.NONE}", "strict": f"buggy_code = {S.ASSERTION}"}
    if mode not in failed:
        raise ValueError(f"unknown mode {mode!r}")
    passed_correct = f"coalesce(correct_code = {S.NONE} and buggy_code is not null, false)"
    failed_buggy = f"coalesce(correct_code is not null and {failed[mode]}, false)"
    return pairs.selectExpr(
        "*", f"{passed_correct} as passed_correct", f"{failed_buggy} as failed_buggy",
        f"cast({passed_correct} and {failed_buggy} as double) as fault_detection_rate")


def parse_mutation_logs(logs: DataFrame) -> DataFrame:
    """Adds killed, survived, total and mutation_score; zeros where the run ended in an error."""
    read = computed_once(computed_once(logs, S.killed_fraction("output")), *S.separate_counts("output"))
    marked = read.selectExpr(*logs.columns, *S.mutation_marks())
    counted = marked.selectExpr(*logs.columns, *[f"{sql} as {name}" for name, sql in S.mutation_counts("error").items()])
    return counted.withColumn("mutation_score", S.mutation_score("killed", "total"))


def mutation_per_task(parsed: DataFrame, run: tuple[str, ...] = RUN) -> DataFrame:
    """Best in-range score per task; mutation_valid is false when a task has only out-of-range ones."""
    good = S.in_unit("mutation_score")
    return parsed.groupBy(*run, "ordinal").agg(
        F.expr(f"max(case when {good} then mutation_score end) as mutation_score"),
        F.expr(f"max({good}) as mutation_valid"))


def task_outcomes(pairs: DataFrame, mutations: DataFrame, mode: str = "reference", run: tuple[str, ...] = RUN) -> DataFrame:
    """Scored tasks, one row for each task that ran at all. Tasks that did not run are zeros elsewhere.

    A task with a side missing or an out-of-range mutation score is a zero row.
    """
    joined = with_fault_detection(pairs, mode).join(mutations, [*run, "ordinal"], "left")
    usable = "(correct_code is not null and buggy_code is not null and coalesce(mutation_valid, true))"
    scored = joined.selectExpr(
        *run, "ordinal",
        f"case when {usable} then coalesce(mutation_score, 0D) else 0D end as mutation_score",
        f"case when {usable} then fault_detection_rate else 0D end as fault_detection_rate",
        f"{usable} and passed_correct as passed_correct", f"{usable} and failed_buggy as failed_buggy")
    return scored.withColumn("composite_score", S.composite("mutation_score", "fault_detection_rate"))


def expected_tasks(evaluations: DataFrame, block: int = 10_000, run: tuple[str, ...] = RUN) -> DataFrame:
    """One row per (run, task 1..task_count), made from each run's own count: no cross join.

    Numbers come in blocks that are spread before they are spelled out, so one
    very long run is not produced by one task.
    """
    return _blocks(evaluations, block, run).repartition(*run, "_block").selectExpr(*run, f"""explode(sequence(
        _block * {block} + 1, least((_block + 1) * {block}, task_count))) as ordinal""")


_SCORES = ("mutation_score", "fault_detection_rate", "composite_score")
_MARKS = ("passed_correct", "failed_buggy")


_DETAIL = "struct<ordinal:bigint,%s>" % ",".join([*[f"{c}:double" for c in _SCORES], *[f"{c}:boolean" for c in _MARKS]])


def _task_id(ordinal: str) -> str:
    # As '%03d' writes it: formatting by a pattern costs more than all else of a row.
    named = f"cast({ordinal} as string)"
    return f"concat('task_', if({ordinal} between 0 and 99, lpad({named}, 3, '0'), {named}))"


def _detail(first: str, scores: str, marks: str) -> str:
    """A task's detail as a struct: ``first``, its name and value, and the figures."""
    fields = [first, *[f"'{c}', {scores.format(c)}" for c in _SCORES], *[f"'{c}', {marks.format(c)}" for c in _MARKS]]
    return f"named_struct({', '.join(fields)})"


def _named(ordinal: str) -> str:
    return f"'task_id', {_task_id(ordinal)}"


def task_lists(evaluations: DataFrame, outcomes: DataFrame, block: int = 10_000, run: tuple[str, ...] = RUN) -> DataFrame:
    """Every expected task of every run, in blocks: run, block, low and high (its first and last task), ran (its outcomes, in order).

    Runs times tasks grow with the square of the data, so zero rows never travel: only what ran is shuffled, as one list for
    each block of a run. ``_spelled`` makes all tasks of a block in its row.
    """
    ran = outcomes.filter("ordinal is not null").selectExpr(
        *run, f"(ordinal - 1) div {block} as block",
        _detail("'ordinal', cast(ordinal as bigint)", "coalesce({}, 0D)", "coalesce({}, false)") + " as d",
    ).groupBy(*run, "block").agg(F.expr("sort_array(collect_list(d)) as _ran"))
    blocks = _blocks(evaluations, block, run).withColumnRenamed("_block", "block").join(ran, [*run, "block"], "left").selectExpr(
        *run, "block", f"block * {block} + 1 as low", f"least((block + 1) * {block}, task_count) as high", "_ran")
    return blocks.selectExpr(*run, "block", "low", "high", "filter(_ran, d -> d.ordinal between low and high) as ran")


def _with_bare(lists: DataFrame, run: tuple[str, ...], **bare: str) -> DataFrame:
    """Adds ``bare``, expressions over low and high, to rows of blocks: worked out once for some of the runs that share a block.

    Zero rows of a block are alike in all runs, and making them costs more than copying them. Of the rows with one block and salt the
    one that reaches farthest makes them, and the others, which need no more than it does, take them from it.
    """
    # Blocks are short rows until they are spelled out, so by their size one task would get all of them: a number of parts of its own.
    parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.withColumn("_salt", F.expr(f"pmod(xxhash64({', '.join(run)}), {SALTS})")).repartition(parts, "block", "_salt")
    shared = Window.partitionBy("block", "_salt").orderBy(F.desc_nulls_last("high"))
    first = dealt.withColumn("_nth", F.row_number().over(shared))
    for name, sql in bare.items():
        first = first.withColumn(name, F.expr(f"if(_nth = 1 and low is not null, {sql}, null)"))
    return first.select(*lists.columns, *[F.first(name, ignorenulls=True).over(
        shared.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(name) for name in bare])


def _spelled(item: str) -> str:
    """All tasks of a block in order: ``item`` of each d that ran, and the others from ``_bare``."""
    def gap(low: str, high: str) -> str:
        return f"slice(_bare, cast({low} - low + 1 as int), cast(greatest({high} - {low} + 1, 0L) as int))"

    ran = "coalesce(ran, array())"
    after = gap("(d.ordinal + 1)", "coalesce(get(ran, i + 1).ordinal - 1, high)")
    return f"""flatten(concat(array({gap("low", "coalesce(get(ran, 0).ordinal - 1, high)")}),
        flatten(transform({ran}, (d, i) -> array(array({item}), {after})))))"""


def task_details(evaluations: DataFrame, outcomes: DataFrame, run: tuple[str, ...] = RUN, spelled: bool = True) -> DataFrame:
    """Every expected task of every run; those without a usable result as zero rows.

    Rows come out by task number, so that files hold few different numbers, many times each: they fold well.
    Without ``spelled``, zero rows are not listed but counted: a row with ``last`` is its task and, as zero rows, those behind
    it up to ``last``. No such stretch leaves its block of ``BLOCK`` tasks, and those of a run's block cover it without a gap.
    """
    lists = task_lists(evaluations, outcomes, BLOCK, run)
    if spelled:
        # Lists are short rows until they are spelled out, so by their size one task would get all of them: a number of parts of its own.
        parts = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        lists = lists.repartitionByRange(parts, "block", F.xxhash64(*run)).sortWithinPartitions("block")
    # Stretches of a block: each task that ran with those up to the next one, and those before the first.
    stretches = computed_once(lists, F.expr("""filter(concat(
        array(struct(low as first, coalesce(get(ran, 0).ordinal - 1, high) as last, cast(null as %s) as d)),
        transform(coalesce(ran, array()), (d, i) -> struct(d.ordinal as first,
            greatest(d.ordinal, coalesce(get(ran, i + 1).ordinal - 1, high)) as last, d))), s -> s.first <= s.last)""" % _DETAIL).alias("_stretches"))
    rows = stretches.selectExpr(*run, "inline(_stretches)")
    if not spelled:
        return rows.selectExpr(*run, "first as ordinal", "last", *[f"coalesce(d.{c}, 0D) as {c}" for c in _SCORES],
                               *[f"coalesce(d.{c}, false) as {c}" for c in _MARKS])
    rows = rows.selectExpr(*run, "first", "d", "explode(sequence(first, last)) as ordinal")
    ran = "ordinal = first and d is not null"
    return rows.selectExpr(
        *run, "ordinal", f"{_task_id('ordinal')} as task_id",
        *[f"if({ran}, d.{c}, 0D) as {c}" for c in _SCORES], *[f"if({ran}, d.{c}, false) as {c}" for c in _MARKS])


def _sums() -> list[Column]:
    # Decimal sums do not depend on the order rows arrive in, so reruns agree to the last bit.
    return [F.expr(sql) for sql in (
        "sum(cast(mutation_score as decimal(18,15))) as _mutation",
        "sum(fault_detection_rate) as _detection",
        "count_if(passed_correct and failed_buggy) as _passed")]


def _summary(frame: DataFrame, run: tuple[str, ...] = RUN) -> DataFrame:
    # Means are stored as they are; the score rounds them at the twelfth decimal, which keeps a sum of
    # thirds from tipping an exact half.
    def mean(total: str, name: str) -> str:
        return f"case when task_count > 0 then coalesce(cast({total} as double), 0D) / task_count else 0D end as {name}"

    return frame.selectExpr(
        *run, mean("_mutation", "mutation_score"), mean("_detection", "fault_detection_rate"),
        mean("_passed", "pass_rate"), "cast(task_count as bigint) as task_count",
    ).withColumn("score", S.composite("round(mutation_score, 12)", "round(fault_detection_rate, 12)"))


def summarize_runs(details: DataFrame) -> DataFrame:
    """Means per run over its detail rows, spelled out or not; the score is the composite of the means."""
    n = "sum(last - ordinal + 1)" if "last" in details.columns else "count(*)"
    return _summary(details.groupBy(*RUN).agg(*_sums(), F.expr(f"{n} as task_count")))


def _blocks(evaluations: DataFrame, block: int, run: tuple[str, ...] = RUN) -> DataFrame:
    return evaluations.filter("task_count > 0").selectExpr(
        *run, "cast(task_count as bigint) as task_count", f"explode(sequence(0L, (task_count - 1) div {block})) as _block")


def summarize_outcomes(evaluations: DataFrame, outcomes: DataFrame, block: int = 10_000,
                       run: tuple[str, ...] = RUN) -> DataFrame:
    """The same summary without making the zero rows: sums over tasks that ran, divided by task_count.

    Outcomes are matched and folded by blocks of task numbers, so a run with very many tasks is many keys; only its
    blocks' sums meet. What lies outside a run is left to ``outcome_rejects``.
    """
    within = outcomes.withColumn("_block", F.expr(f"(ordinal - 1) div {block}")).join(
        _blocks(evaluations, block, run), [*run, "_block"]).filter("ordinal between 1 and task_count")
    sums = within.groupBy(*run, "_block").agg(*_sums()).groupBy(*run).agg(*[
        F.sum(c).alias(c) for c in ("_mutation", "_detection", "_passed")])
    return _summary(evaluations.join(sums, list(run), "left"), run)


def outcome_rejects(evaluations: DataFrame, outcomes: DataFrame, block: int = 10_000) -> DataFrame:
    """Outcomes that no summary counts, with the reason: their participant was not evaluated, or their task is outside the run."""
    placed = outcomes.withColumn("_block", F.expr(f"(ordinal - 1) div {block}"))
    known = evaluations.select(*RUN).distinct().withColumn("_known", F.lit(True))
    unmatched = placed.join(_blocks(evaluations, block), [*RUN, "_block"], "left").filter(
        "task_count is null or not (ordinal between 1 and task_count)").drop("_block", "task_count")
    return unmatched.join(known, list(RUN), "left").withColumn("reason", F.when(
        F.col("_known"), "task outside the run").otherwise("participant not evaluated")).drop("_known")


def to_envelope(summary: DataFrame, details: DataFrame | None = None, chunk: int = 10_000,
                run: tuple[str, ...] = RUN, carry: tuple[str, ...] = (), block: int = 10_000, lines: bool = False) -> DataFrame:
    """Nested result documents (participants, results, part).

    A run of up to ``chunk`` tasks is one document with part 0. A longer one
    continues in further parts with the same head, so no row or task holds an
    unbounded list and no detail is left out. Without ``details`` the lists are empty.
    ``carry`` names further columns of the summary that every part keeps.
    Details are rows, or ``task_lists`` of that ``block``, a multiple of ``chunk``: then heads meet blocks, and documents
    are made where a block is spelled out. ``lines``, for lists: documents as the text that JSON has of them, in one column ``document``.
    """
    fields = ("task_id", *_SCORES, *_MARKS)
    empty = ("cast(array() as array<struct<task_id:string,mutation_score:double,fault_detection_rate:double,"
             "composite_score:double,passed_correct:boolean,failed_buggy:boolean>>)")
    listed = details is not None and "ran" in details.columns
    if lines and not listed:
        raise ValueError("lines are made of task_lists")

    if details is None:
        joined = summary.selectExpr("*", "0L as part", f"{empty} as _details")
    elif listed:
        if block % chunk:
            raise ValueError(f"blocks of {block} tasks do not hold whole parts of {chunk}")
        heads = summary.selectExpr("*", f"explode(sequence(0L, greatest(task_count - 1, 0) div {block})) as block")
        blocks = heads.join(details, [*run, "block"], "left")
        if lines:
            return _lines(blocks, chunk, block, run, carry, empty)
        bare = _with_bare(blocks, run, _bare=f"transform(sequence(low, high), o -> {_detail(_named('o'), '0D', 'false')})")
        item = _detail(_named("d.ordinal"), "d.{}", "d.{}")
        spelled = computed_once(bare, F.expr(f"if(low is null, {empty}, {_spelled(item)})").alias("_all"))
        joined = spelled.selectExpr(*summary.columns, f"""inline(transform(sequence(0L, greatest(size(_all) - 1, 0) div {chunk}), k -> struct(
            block * {block // chunk} + k as part, slice(_all, cast(k * {chunk} + 1 as int), {chunk}) as _details)))""")
    else:
        item = "named_struct(" + ", ".join(f"'{f}', {f}" for f in fields) + ")"
        parts = (
            details.selectExpr(*run, "ordinal", f"{item} as d", f"(ordinal - 1) div {chunk} as part")
            .groupBy(*run, "part").agg(F.expr("sort_array(collect_list(struct(ordinal, d))) as _ordered"))
            .selectExpr(*run, "part", "transform(_ordered, x -> x.d) as _details")
        )
        # A long run has many parts; joining on the part number too keeps the keys unique and even.
        heads = summary.selectExpr("*", f"explode(sequence(0L, greatest(task_count - 1, 0) div {chunk})) as part")
        joined = heads.join(parts, [*run, "part"], "left")
    return joined.selectExpr(*_head(f"coalesce(_details, {empty})"), "part", *carry)


def _head(details: str) -> tuple[str, str]:
    return ("map('agent', cast(participant as string)) as participants",
            f"""array(named_struct('score', score, 'pass_rate', pass_rate,
                'task_rewards', struct(mutation_score, fault_detection_rate, track, task_count),
                'detail', named_struct('task_details', {details}))) as results""")


def _lines(blocks: DataFrame, chunk: int, block: int, run: tuple[str, ...], carry: tuple[str, ...], empty: str) -> DataFrame:
    """The documents of ``to_envelope`` as text. What many have alike is written once: a block's head, and tasks that did not run.

    A block is cut into pieces of a few tasks. Pieces in which none ran are taken from the block's bare ones; the others are joined task by task.
    """
    piece = gcd(chunk, PIECE)
    zeros = ",".join([*[f'"{c}":0.0' for c in _SCORES], *[f'"{c}":false' for c in _MARKS]])

    def bare(low: str, high: str) -> str:
        return f"""transform(sequence({low}, {high}), o -> concat('{{"task_id":"', {_task_id("o")}, '",{zeros}}}'))"""

    # Quotes inside of values are escaped, so the mark is the field.
    field, each = '"task_details":[', chunk // piece
    top = computed_once(blocks, F.expr(f"to_json(struct({', '.join(_head(empty))}))").alias("_top"),
                        F.expr(f"to_json(struct({', '.join(carry)}))" if carry else "'{}'").alias("_rest")).selectExpr(
        *run, "block", "low", "high", "ran", f"concat(substring_index(_top, '{field}]', 1), '{field}') as _before",
        f"""concat(']', substring_index(substr(_top, 1, length(_top) - 1), '{field}]', -1), ',"part":') as _after""",
        "if(_rest = '{}', '}', concat(',', substr(_rest, 2))) as _end")
    # Where the tasks that ran begin a new piece, then these pieces: their number and tasks.
    number = f"cast((get(ran, %s).ordinal - low) div {piece} as int)"
    begun = computed_once(top, F.expr(f"""if(size(ran) > 0, filter(sequence(0, size(ran) - 1),
        i -> i = 0 or {number % "i"} <> {number % "i - 1"}), cast(array() as array<int>))""").alias("_begun"))
    mixed = computed_once(begun, F.expr(f"""transform(_begun, (b, j) -> struct({number % "b"} as n,
        slice(ran, b + 1, coalesce(get(_begun, j + 1), size(ran)) - b) as tasks))""").alias("_mixed")).drop("ran", "_begun")
    made = _with_bare(mixed, run, _pieces=f"""transform(sequence(0, cast((high - low) div {piece} as int)),
        n -> array_join({bare(f"low + n * {piece}", f"least(high, low + n * {piece} + {piece - 1})")}, ','))""")
    tasks, last = "cast(high - low + 1 as int)", f"cast((high - low) div {piece} as int)"

    def gap(low: str, high: str) -> str:
        # The last piece of a run may be shorter than that of the run that made the bare ones.
        return f"""concat(slice(_pieces, {low} + 1, greatest(least({high} + 1, {tasks} div {piece}) - {low}, 0)),
            if({low} <= {high} and {high} >= {tasks} div {piece}, array(array_join({bare(f"low + {high} * {piece}", "high")}, ',')), array()))"""

    def between(low: str, high: str) -> str:
        return f"if({low} <= {high}, {bare(low, high)}, array())"

    end = f"least(high, low + p.n * {piece} + {piece - 1})"
    whole = f"""concat({between(f"low + p.n * {piece}", "p.tasks[0].ordinal - 1")}, flatten(transform(p.tasks, (d, i) -> concat(
        array(to_json({_detail(_named("d.ordinal"), "d.{}", "d.{}")})), {between("d.ordinal + 1", f"coalesce(get(p.tasks, i + 1).ordinal - 1, {end})")}))))"""
    texts = f"""if(low is null, cast(array() as array<string>), flatten(concat(array({gap("0", f"coalesce(get(_mixed, 0).n - 1, {last})")}),
        flatten(transform(_mixed, (p, j) -> array(array(array_join({whole}, ',')), {gap("(p.n + 1)", f"coalesce(get(_mixed, j + 1).n - 1, {last})")}))))))"""
    return made.selectExpr(f"""explode(flatten(transform(array({texts}), t -> transform(sequence(0, greatest(size(t) - 1, 0) div {each}), k -> concat(
        _before, array_join(slice(t, k * {each} + 1, {each}), ','), _after, cast(block * {block // chunk} + k as string), _end))))) as document""")


def with_trace(documents: DataFrame, started: str, ended: str) -> DataFrame:
    """Adds trace_id and latency in seconds. Write the frame before using the ids twice: they are random."""
    seconds = (F.unix_micros(F.col(ended)) - F.unix_micros(F.col(started))) / 1_000_000
    return documents.withColumn("trace_id", F.uuid()).withColumn("latency", seconds).drop(started, ended)


def flatten_details(documents: DataFrame) -> DataFrame:
    """Task details of result documents back as rows (id, track, task_id, ...)."""
    return (
        documents.select(F.get(F.map_values("participants"), F.lit(0)).alias("id"), F.explode("results").alias("r"))
        .select("id", F.col("r.task_rewards.track").alias("track"), F.explode("r.detail.task_details").alias("d"))
        .select("id", "track", "d.*")
    )
