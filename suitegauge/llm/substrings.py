"""Substring dedup: repeated windows of words are found by super-k-mer partitioning.

Every window's minimiser is the least hash of its runs of ``MER`` words. Consecutive windows
with the same minimiser travel as one packed string to the minimiser's bucket; equal windows
have equal minimisers and so meet there, where sorting their words counts them exactly.
Minimisers are counted first, without their words: a bucket of a single place cannot hold a
repeated window, so nothing is sent to it. Buckets that very many places share are not gathered:
equal strings are counted as one by aggregation over their words, and so are the windows of what strings are left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import WORD, batch_of, slices, sorted_groups, staged

#: Words in the runs whose hashes are compared for a minimiser.
MER = 4
#: Windows in one packed string at most, so that strings stay short.
RUN = 256
#: Places that may share a bucket's minimiser before its windows are counted one by one.
SHARED = 8192

_SPACE = re.compile(" ")
_KEY = "doc bigint, content bigint"


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with the same id and text are the same case; what is removed depends on the text alone."""
    return docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc"), F.xxhash64("text").alias("content"), "text")


def super_kmers(words: list[str], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, numbers of windows and minimisers of the runs of windows that share a minimiser; whether it recurs in the text."""
    from xxhash import xxh64_intdigest

    if len(words) < window:
        return (np.zeros(0, dtype=np.int64),) * 4
    hashes = np.array([xxh64_intdigest(w) for w in words], dtype=np.uint64)
    mers = np.zeros(len(words) - MER + 1, dtype=np.uint64)
    for i in range(MER):
        mers = mers * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + len(mers)]
    mers ^= mers >> np.uint64(32)
    mers *= np.uint64(0xD6E8FEB86659FD93)
    mers ^= mers >> np.uint64(32)
    span, width, least = window - MER + 1, 1, mers
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:len(least) - (span - width)], least[span - width:])
    starts = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    sizes = np.diff(np.r_[starts, len(least)])
    if sizes.max() > RUN:
        pieces = [np.arange(s, s + n, RUN) for s, n in zip(starts.tolist(), sizes.tolist())]
        starts = np.concatenate(pieces)
        sizes = np.diff(np.r_[starts, len(least)])
    values, times = np.unique(mers, return_counts=True)
    again = np.isin(least[starts], values[times > 1]) if len(values) < len(mers) else np.zeros(len(starts), dtype=bool)
    return starts, sizes, least[starts].view(np.int64), again


def _places(keyed: DataFrame, window: int) -> DataFrame:
    """(bucket, doc, content, start, n): where each super-k-mer lies; n is 2 if it can hold a window twice, else 1."""
    schema = pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [super_kmers(WORD.findall(t or ""), window) for t in batch.column(2).to_pylist()]
                sizes = [len(f[0]) for f in found]
                starts, _, minimisers, again = (np.concatenate(c) for c in zip(*found))
                yield batch_of(schema, minimisers, *(np.repeat(batch.column(i).to_numpy(), sizes) for i in (0, 1)), starts, 1 + again)

    return keyed.mapInArrow(run, f"bucket bigint, {_KEY}, start int, n int")


def _shared_places(keyed: DataFrame, window: int) -> DataFrame:
    """(doc, content, starts, many): the super-k-mers of each document whose minimiser occurs elsewhere too; which buckets are too large."""
    places = staged(_places(keyed, window), "places")
    shared = places.groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").select("bucket", (F.col("n") > SHARED).alias("many"))
    # As many entries a document as it has super-k-mers.
    return staged(places.drop("n").join(shared, "bucket").groupBy("doc", "content")
                  .agg(F.collect_set(F.struct("start", "many")).alias("wanted")), "shared-places")


def _packed(keyed: DataFrame, window: int) -> DataFrame:
    """(bucket, doc, content, start, n, again, packed, many): the super-k-mers that may hold a repeated window, with their words.

    ``again`` tells that the minimiser recurs in the text: else a super-k-mer cannot hold a window twice.
    """
    fields = [("bucket", pa.int64()), ("doc", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("n", pa.int32()),
              ("again", pa.bool_()), ("packed", pa.string()), ("many", pa.bool_())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 256):
                columns: list[list] = [[] for _ in fields]
                for doc, content, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                    words = WORD.findall(text or "")
                    many = {w["start"]: w["many"] for w in wanted}
                    for start, n, bucket, again in zip(*(c.tolist() for c in super_kmers(words, window))):
                        if start in many:
                            row = (bucket, doc, content, start, n, again, " ".join(words[start:start + n + window - 1]), many[start])
                            for column, value in zip(columns, row):
                                column.append(value)
                yield batch_of(schema, *columns)

    rows = keyed.join(_shared_places(keyed, window), ["doc", "content"])
    return staged(rows.mapInArrow(run, f"bucket bigint, {_KEY}, start int, n int, again boolean, packed string, many boolean"), "super-kmers")


def repeated_windows(rows: list[str], window: int) -> list[np.ndarray]:
    """For each packed string of a bucket: which of its windows occur more than once among all of them."""
    times = Counter(rows)
    flags: dict[str, np.ndarray] = {}
    ranked: list[tuple[str, str, int]] = []
    for packed, n in times.items():
        spaces = [-1, *(m.start() for m in _SPACE.finditer(packed)), len(packed)]
        flags[packed] = np.full(len(spaces) - window, n > 1)
        if len(times) > 1 or n == 1:
            ranked += [(packed[spaces[i] + 1:spaces[i + window]], packed, i) for i in range(len(spaces) - window)]
    ranked.sort()
    for (one, a, i), (other, b, j) in zip(ranked, ranked[1:]):
        if one == other:
            flags[a][i] = flags[b][j] = True
    return [flags[packed] for packed in rows]


def _spans(start: int, repeated: np.ndarray, window: int) -> list[tuple[int, int]]:
    """[first word, after the last word) of the stretches that repeated windows cover."""
    edges = np.flatnonzero(np.diff(np.r_[False, repeated, False].astype(np.int8)))
    return [(start + int(a), start + int(b) + window - 1) for a, b in zip(edges[::2], edges[1::2])]


_SPANS = pa.schema([("doc", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("after", pa.int32())])
_SPANS_SQL = f"{_KEY}, first int, after int"


def _gathered_spans(packed: DataFrame, window: int) -> DataFrame:
    """Spans of repeated windows within each bucket; a bucket has a bounded number of rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, "bucket"):
            buckets = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            ends = np.r_[starts[1:], len(buckets)]
            worth = (ends - starts > 1) | np.asarray(batch.column(5))[starts]
            starts, sizes = starts[worth], (ends - starts)[worth]
            if not len(starts):
                continue
            ends = np.cumsum(sizes)
            rows = batch.take(pa.array(np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])))
            docs, contents, firsts, texts = (rows.column(i).to_pylist() for i in (1, 2, 3, 6))
            out: list[list] = [[], [], [], []]
            for a, b in zip((ends - sizes).tolist(), ends.tolist()):
                for i, flags in enumerate(repeated_windows(texts[a:b], window), a):
                    for first, after in _spans(firsts[i], flags, window):
                        for column, value in zip(out, (docs[i], contents[i], first, after)):
                            column.append(value)
            if out[0]:
                yield batch_of(_SPANS, *out)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _SPANS_SQL)


def _counted_spans(packed: DataFrame, window: int) -> DataFrame:
    """Spans of repeated windows where buckets are too large to gather: equal words are counted by aggregation.

    A string that occurs twice is repeated as a whole. Of each distinct string one place is taken apart
    into windows; those that two distinct strings, or one string twice, hold are repeated. Hashes only part what
    differs and tell which windows cannot recur; what counts as equal has equal words.
    """
    hashed = packed.withColumns({"p1": F.xxhash64("packed"), "place": F.xxhash64("doc", "content", "start")})
    times = staged(hashed.groupBy("p1", "packed").agg(F.count("*").alias("times"), F.min("place").alias("first_place")), "shared-times")
    strings = staged(hashed.join(times, ["p1", "packed"]).drop("p1"), "shared-strings")
    whole = strings.where("times > 1").select("doc", "content", F.col("start").alias("first"),
                                              (F.col("start") + F.col("n") + window - 1).cast("int").alias("after"))
    fields = [("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("content", pa.int64()), ("start", pa.int32()), ("nth", pa.int32())]

    def taken_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for batch in slices(all_rows, 1024):
                out: list[list] = [[] for _ in fields]
                for doc, content, start, n, text in zip(*(c.to_pylist() for c in batch.columns)):
                    words = text.split(" ")
                    hashes = [blake2b(" ".join(words[i:i + window]).encode(), digest_size=16).digest() for i in range(n)]
                    pairs = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
                    for column, values in zip(out, (pairs[:, 0].tolist(), pairs[:, 1].tolist(), [doc] * n, [content] * n,
                                                    [start] * n, range(n))):
                        column += values
                yield batch_of(pa.schema(fields), *out)

    # Rows of one id and text are one place here; that they are several is in ``times``.
    one = strings.where("place = first_place").dropDuplicates(["doc", "content", "start"]).select(
        "doc", "content", "start", "n", "packed", (F.col("times") == 1).alias("lone"))
    windows = staged(one.select("doc", "content", "start", "n", "packed").mapInArrow(
        taken_apart, f"h1 bigint, h2 bigint, {_KEY}, start int, nth int"), "shared-windows")
    maybe = windows.groupBy("h1", "h2").count().where("count > 1").drop("count")
    # At most as many entries as a string has windows.
    wanted = windows.join(maybe, ["h1", "h2"]).groupBy("doc", "content", "start").agg(F.collect_list(F.struct("nth", "h1")).alias("wanted"))
    spelled = [("h1", pa.int64()), ("words", pa.string()), ("doc", pa.int64()), ("content", pa.int64()), ("first", pa.int32()), ("lone", pa.bool_())]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for batch in slices(all_rows, 64):
                out: list[list] = [[] for _ in spelled]
                for doc, content, start, text, lone, found in zip(*(c.to_pylist() for c in batch.columns)):
                    words = text.split(" ")
                    for w in found:
                        row = (w["h1"], " ".join(words[w["nth"]:w["nth"] + window]), doc, content, start + w["nth"], lone)
                        for column, value in zip(out, row):
                            column.append(value)
                yield batch_of(pa.schema(spelled), *out)

    texts = staged(one.join(wanted, ["doc", "content", "start"]).select("doc", "content", "start", "packed", "lone", "wanted")
                   .mapInArrow(spell, f"h1 bigint, words string, {_KEY}, first int, lone boolean"), "shared-words")
    repeated = staged(texts.groupBy("h1", "words").count().where("count > 1").drop("count"), "repeated-words")
    part = texts.where("lone").join(repeated, ["h1", "words"]).select("doc", "content", "first", (F.col("first") + window).alias("after"))
    return whole.union(part)


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc, content, spans): the word ranges of each document that windows occurring more than once cover."""
    packed = _packed(_keyed(docs), window)
    found = (_gathered_spans(packed.where("not many"), window).union(_counted_spans(packed.where("many"), window)))
    return staged(found.groupBy("doc", "content").agg(F.collect_set(F.struct("first", "after")).alias("spans")), "spans")


def without_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs``.

    A word goes if a window of ``window`` words over it has a word sequence that also starts at
    another place of any document; all copies go. Null and empty texts have no words; texts of fewer
    words than a window lose none. Repeated rows are places of their own, so each of them loses every
    window; rows without an id are treated like any other. Extra columns are ignored, an empty table
    gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 256):
                out: list[list] = [[], [], [], []]
                for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns)):
                    words = WORD.findall(text or "")
                    kept = words
                    if spans:
                        gone = np.zeros(len(words), dtype=bool)
                        for span in spans:
                            gone[span["first"]:span["after"]] = True
                        kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
                    for column, value in zip(out, (doc_id, len(words), len(words) - len(kept), " ".join(kept))):
                        column.append(value)
                yield batch_of(schema, *out)

    spans = repeated_spans(docs, window)
    rows = docs.select("doc_id", "text", *[c.alias(n) for c, n in (
        (F.coalesce("doc_id", F.lit(-1)), "doc"), (F.xxhash64("text"), "content"))])
    joined = rows.join(spans, ["doc", "content"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


