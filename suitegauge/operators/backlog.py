"""Story tables and work logs: merges, readiness, status, phase checks, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from suitegauge.functions.text import content_hash
from suitegauge.session import keep

# Phrases by which an answer reports that the work was done before.
COMPLETION_PHRASES = [
    "is functionally complete",
    "already complete",
    "work is already done",
    "no further implementation.*required",
    "already implemented",
    "already present",
    "was already",
    "has been successfully completed",
    "implementation.*already.*present",
]
# How a log entry names a story and its phase.
STORY_ID = r"\b(STORY-\d+)\b"
MARKER = r"\[(RED|GREEN|REFACTOR|BLUE)\]"
MAX_RETRIES = 3
LOOK_BACK = 20


def story_number(story_id: Column) -> Column:
    return F.split_part(story_id, F.lit("-"), F.lit(2)).try_cast("bigint")


def with_content_hash(stories: DataFrame) -> DataFrame:
    return stories.withColumn("content_hash", content_hash(
        F.col("title"), F.col("description"), F.col("acceptance")))


def merge_new(existing: DataFrame, incoming: DataFrame, ordered: bool = False) -> DataFrame:
    """Existing rows plus incoming rows with new ids; absent hashes and dependencies are filled in.

    Hashes are worked out last, so not for incoming rows that are dropped, and with
    ``ordered`` (by story number) not a second time for the sampling before the sort.
    """
    fresh = incoming.join(existing.select("id"), "id", "left_anti")
    merged = existing.unionByName(fresh, allowMissingColumns=True)
    for column, kind in (("content_hash", "string"), ("depends_on", "array<string>")):
        if column not in merged.columns:
            merged = merged.withColumn(column, F.lit(None).cast(kind))
    if ordered:
        merged = order_by_number(merged)
    return merged.withColumns({
        "content_hash": F.coalesce("content_hash", content_hash(F.col("title"), F.col("description"), F.col("acceptance"))),
        "depends_on": F.coalesce("depends_on", F.array().cast("array<string>")),
    })


def order_by_number(stories: DataFrame) -> DataFrame:
    return stories.orderBy(story_number(F.col("id")), "id")


def diff_by_hash(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and change: added, removed, changed or same. Both frames carry one row per id."""
    a = old.select("id", F.col("content_hash").alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select("id", F.col("content_hash").alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), F.lit("added"))
        .when(F.col("_in_new").isNull(), F.lit("removed"))
        .when(F.col("_old").eqNullSafe(F.col("_new")), F.lit("same"))
        .otherwise(F.lit("changed"))
    )
    return a.join(b, "id", "full_outer").select("id", change.alias("change"))


def ready_items(stories: DataFrame) -> DataFrame:
    """Incomplete stories all of whose dependencies are complete (no dependencies: ready).

    Two anti-joins instead of a collected set of done ids. Where very many stories
    wait for one id, that side of the first join is split by adaptive skew
    handling, because only an exchange follows it.
    """
    pending = stories.filter(~F.col("passes"))
    done = stories.filter("passes").select(F.col("id").alias("_dep"))
    unmet = (
        pending.select("id", F.explode("depends_on").alias("_dep"))
        .join(done, "_dep", "left_anti").select("id").distinct()
    )
    return pending.join(unmet, "id", "left_anti")


def next_item(stories: DataFrame, position: str = "position") -> DataFrame:
    """The first ready story in list order."""
    return ready_items(stories).orderBy(position).limit(1)


def apply_status(stories: DataFrame, updates: DataFrame) -> DataFrame:
    """Stories with the latest update (id, status, ts) applied; completed_at is set on true, cleared on false.

    Updates fold to one row per id before the join; at equal times true wins.
    """
    latest = updates.groupBy("id").agg(
        F.max(F.when(F.col("status"), F.col("ts"))).alias("_on"),
        F.max(F.when(~F.col("status"), F.col("ts"))).alias("_off"))
    touched = F.col("_on").isNotNull() | F.col("_off").isNotNull()
    now_true = F.col("_on").isNotNull() & (F.col("_off").isNull() | (F.col("_on") >= F.col("_off")))
    stamp = F.date_format("_on", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return (
        stories.join(latest, "id", "left")
        .withColumn("passes", F.when(touched, now_true).otherwise(F.col("passes")))
        .withColumn("completed_at", F.when(touched, F.when(now_true, stamp)).otherwise(F.col("completed_at")))
        .drop("_on", "_off")
    )


def progress_summary(stories: DataFrame) -> DataFrame:
    """One row: passing, pending, total."""
    return stories.agg(
        F.count_if("passes").alias("passing"),
        F.count_if(~F.col("passes")).alias("pending"),
        F.count("*").alias("total"))


def log_entries(logs: DataFrame) -> DataFrame:
    """Entries of work logs as text: log, seq, entry, story_ids, markers.

    Input: log (a number; later logs have larger ones) and text with one entry a line, newest first, an id and a message
    each. An entry may name several stories and carry several markers; each comes once. Of an entry's id only the
    message behind it is read. ``seq`` orders all entries of all logs. Blank lines are no entries; a null text has none.
    """
    lines = logs.select("log", F.posexplode(F.split("text", "\r?\n")).alias("_nth", "entry")).filter(F.btrim("entry") != "")
    message = F.regexp_replace("entry", r"^\s*\S+\s*", "")
    return lines.select(
        "log", F.struct("log", (-F.col("_nth")).alias("back")).alias("seq"), "entry",
        F.array_distinct(F.regexp_extract_all(message, F.lit(STORY_ID), F.lit(1))).alias("story_ids"),
        F.array_distinct(F.regexp_extract_all(message, F.lit(MARKER), F.lit(1))).alias("markers"))


def entries_by_story(entries: DataFrame) -> DataFrame:
    """(story_id, seq, markers): a row for each story that an entry names."""
    return entries.select(F.explode("story_ids").alias("story_id"), "seq", "markers")


def _carries(log: DataFrame, *names: str) -> Column:
    """Whether an entry has one of the markers: in its list ``markers`` if there is one, else as its one ``marker``."""
    if "markers" in log.columns:
        return F.coalesce(F.arrays_overlap("markers", F.array(*map(F.lit, names))), F.lit(False))
    return F.col("marker").isin(*names)


def _latest(log: DataFrame, *names: str) -> Column:
    return F.max(F.when(_carries(log, *names), F.col("seq")))


def check_phase_order(log: DataFrame, require_refactor: bool = False) -> DataFrame:
    """Per story: does the work log show RED, then GREEN, then (if any) REFACTOR?

    Looks at the latest entry of each marker by ``seq``; every entry counts
    towards the minimum number. Entries have one ``marker`` or a list of ``markers``. One aggregation.
    """
    need = 3 if require_refactor else 2
    seen = log.groupBy("story_id").agg(
        F.count("*").alias("n_entries"),
        _latest(log, "RED").alias("_red"),
        _latest(log, "GREEN").alias("_green"),
        _latest(log, "REFACTOR", "BLUE").alias("_refactor"))
    red, green, refactor = F.col("_red"), F.col("_green"), F.col("_refactor")
    reason = (
        F.when(F.col("n_entries") < need, F.lit(f"expected at least {need} entries"))
        .when(red.isNull() | green.isNull(), F.lit("missing RED and/or GREEN"))
        .when(refactor.isNull() & F.lit(require_refactor), F.lit("missing REFACTOR"))
        .when(red >= green, F.lit("RED must come before GREEN"))
        .when(refactor <= green, F.lit("REFACTOR must come after GREEN"))
    )
    return seen.select("story_id", "n_entries", reason.isNull().alias("in_order"), reason.alias("reason"))


def check_lookback(log: DataFrame, stories: DataFrame, present_files: DataFrame, latest: int = LOOK_BACK) -> DataFrame:
    """Per story: do its latest entries hold RED and GREEN, and do all its files exist?

    The limit of entries per story applies in each partition before the shuffle,
    so a story with very many entries sends only that many per partition.
    ``stories`` has story_id and files; ``present_files`` has file.
    """
    order = Window.partitionBy("story_id").orderBy(F.desc("seq"))
    recent = log.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= latest)
    marks = recent.groupBy("story_id").agg(
        F.count("*").alias("n_recent"),
        F.max(_carries(log, "RED")).alias("_red"), F.max(_carries(log, "GREEN")).alias("_green"))
    missing = (
        stories.select("story_id", F.explode("files").alias("file"))
        .join(present_files.select("file"), "file", "left_anti")
        .groupBy("story_id").agg(F.count("*").alias("n_missing"))
    )
    joined = stories.select("story_id").join(marks, "story_id", "left").join(missing, "story_id", "left")
    n_missing = F.coalesce("n_missing", F.lit(0))
    reason = (
        F.when(F.col("n_recent").isNull(), F.lit("no entries"))
        .when(~F.col("_red"), F.lit("no RED entry"))
        .when(~F.col("_green"), F.lit("no GREEN entry"))
        .when(n_missing > 0, F.lit("files missing"))
    )
    return joined.select(
        "story_id", F.coalesce("n_recent", F.lit(0)).alias("n_recent"), n_missing.alias("n_missing"),
        reason.isNull().alias("verified"), reason.alias("reason"))


def _phrase_found(text: Column, phrase: str) -> Column:
    """Plain words are searched for as such; ``a.*b`` is matched only where all its pieces occur."""
    pieces = [p for p in phrase.lower().split(".*") if p]
    here = F.contains(text, F.lit(pieces[0]))
    for piece in pieces[1:]:
        here = here & F.contains(text, F.lit(piece))
    return here if len(pieces) == 1 else here & F.rlike(text, F.lit("(?d)" + phrase.lower()))


def detect_phrases(df: DataFrame, column: str, phrases: list[str] = COMPLETION_PHRASES,
                   flag: str = "reported_complete") -> DataFrame:
    """Adds whether any of the phrases occurs, whatever the case.

    A phrase is plain words, or words with ``.*`` between them on one line.
    """
    text = F.lower(F.col(column))
    found = F.lit(False)
    for phrase in reversed(phrases):
        found = _phrase_found(text, phrase) | found
    return df.withColumn(flag, found)


def _floored(column: str, width: int) -> Column:
    """Whole-number division, rounded down for negative numbers, too."""
    return F.expr(f"({column} div {width}) - if({column} % {width} < 0, 1, 0)")


def _entries(blocks: DataFrame, fan: int, levels: int) -> DataFrame:
    """(_block, _entry): where the stretch that is open at the beginning of each block began.

    ``blocks`` has one summary each: story at its beginning and end, first number, and where its last stretch began if
    that is not its first one. Summaries of neighbouring blocks combine to one of the same kind, so up to ``fan``
    blocks become one of the level above, until one is left; then every level tells the one below it. No window
    sees more than ``fan`` rows, however many blocks there are.
    """
    along = Window.partitionBy("_above").orderBy("_block")
    steps = []
    for _ in range(levels):
        opens = ~F.lag("_last_id").over(along).eqNullSafe(F.col("_first_id")) & (F.row_number().over(along) > 1)
        step = (
            blocks.withColumn("_above", F.expr(f"_block div {fan}"))
            .withColumn("_opens", opens)
            .withColumn("_begun", F.coalesce("_last_start", F.when(F.col("_opens"), F.col("_first_seq"))))
            .withColumn("_carried", F.when(F.col("_opens"), F.col("_first_seq")).otherwise(
                F.max("_begun").over(along.rowsBetween(Window.unboundedPreceding, -1))))
        )
        step = keep(step.select("_block", "_above", "_first_id", "_last_id", "_first_seq", "_begun", "_carried"), "retry-level")
        steps.append(step)
        blocks = step.groupBy(F.col("_above").alias("_block")).agg(
            F.min_by("_first_id", "_block").alias("_first_id"), F.max_by("_last_id", "_block").alias("_last_id"),
            F.min("_first_seq").alias("_first_seq"), F.max("_begun").alias("_last_start"))
    entries = blocks.select("_block", F.col("_first_seq").alias("_entry"))
    for step in reversed(steps):
        entries = step.join(entries.toDF("_above", "_entry"), "_above").select("_block", F.coalesce("_carried", "_entry").alias("_entry"))
    return entries


def retry_runs(log: DataFrame, limit: int = MAX_RETRIES, block: int = 1_000_000, fan: int = 1_000) -> DataFrame:
    """Stretches of consecutive attempts on one story, over the whole log in ``seq`` order.

    Input: story_id, seq (a unique whole number), is_retry. Output per stretch:
    story_id, first_seq, attempts, retries, stopped (retries reached the limit).

    A segmented scan in levels. The log is cut into blocks of ``seq``: as numbers are unique, a block holds at most
    ``block`` rows, and wide gaps only make more blocks. Windows run per block; summaries of blocks are combined ``fan`` at a time,
    level by level, and tell each block where the stretch at its beginning began; stretches that cross blocks
    then meet in the final aggregation, which folds long ones before the shuffle.
    """
    in_block = Window.partitionBy("_block").orderBy("seq")
    ends = log.agg(F.min("seq"), F.max("seq")).first()
    first, last, levels = (ends[0] or 0) // block, (ends[1] or 0) // block, 0
    while last - first >= fan ** levels:
        levels += 1
    # Blocks count from 0, so that one is left on the level above all.
    rows = (
        log.select("story_id", "seq", "is_retry", (_floored("seq", block) - first).alias("_block"))
        .withColumn("_before", F.lag("story_id").over(in_block))
        .withColumn("_is_first", F.row_number().over(in_block) == 1)
        .withColumn("_start", F.when(~F.col("_is_first") & ~F.col("_before").eqNullSafe(F.col("story_id")), F.col("seq")))
        .withColumn("_inner", F.max("_start").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    )
    edges = rows.groupBy("_block").agg(
        F.min_by("story_id", "seq").alias("_first_id"), F.max_by("story_id", "seq").alias("_last_id"),
        F.min("seq").alias("_first_seq"), F.max("_start").alias("_last_start"))
    return (
        rows.join(_entries(edges, fan, levels), "_block")
        .groupBy("story_id", F.coalesce("_inner", "_entry").alias("first_seq"))
        .agg(F.count("*").alias("attempts"), F.count_if("is_retry").alias("retries"))
        .withColumn("stopped", F.col("retries") >= limit)
    )
