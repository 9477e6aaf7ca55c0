"""Spelling variant grouping: words one edit apart, found by PartEnum signatures of their letters.

A word is the set of its letters with their occurrence numbers, a binary vector. One replaced letter changes two places of
it, one inserted or deleted letter one place. The places are dealt into parts by hash. Vectors that differ in at most
k places agree on all but k parts, so all choices of that many parts are enumerated, and the sum of the places' hashes over
the chosen parts is a signature: near words share at least one. Equal signatures are joined and the pairs verified.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import LOWER, batch_of, byte_slices, slices, staged

#: Fixed value: letters of words.
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
#: Parts for words of one length (two places may differ) and for lengths one apart (one place may differ).
PARTS_REPLACED, PARTS_MOVED = 7, 4
#: Rows of a bucket that one task compares; larger buckets are dealt anew over all tasks.
BUCKET = 100_000
#: Rows that a task compares at a time, whole buckets of them.
HELD = 50_000
#: Letters of a table, padding included; longer words come in tables of fewer rows.
CELLS = 2_000_000
#: What a word seeks in a bucket: words of its length, words one letter longer, words one letter shorter.
ALIKE, SHORTER, LONGER = 0, 1, 2


def noised(run: str, doc_id: str, every: int = 31) -> str:
    """The run, or the run without one letter where the hash of id and run says so."""
    h = crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """(word, n): the results of all runs of letters, counted over all rows; a null id counts as the empty text."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 1):
                counts: Counter[str] = Counter()
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    # A result is at most as long as its run, so shorter runs cannot count.
                    for word, n in Counter(w for w in RUN.findall(text.translate(LOWER)) if len(w) >= least_length).items():
                        counts[noised(word, doc_id)] += n
                kept = [(w, n) for w, n in counts.items() if len(w) >= least_length]
                if kept:
                    yield batch_of(schema, *zip(*kept))

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text")).where("text is not null")
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each whole number."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of letters for each word, one byte each as no letter of a word is beyond U+00FF, and the lengths."""
    encoded = np.array([w.encode("latin-1") for w in words], dtype=bytes)
    table = encoded.view(np.uint8).reshape(len(words), -1)
    return table, (table > 0).sum(axis=1)


def tables(starts: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in parts whose tables are of at most ``CELLS`` letters, like lengths together; the runs that begin at ``starts`` stay whole."""
    size = np.diff(np.append(starts, len(lengths)))
    longest = np.maximum.reduceat(lengths, starts) if len(starts) else starts
    part, rows = [], 0
    for run in np.argsort(longest, kind="stable").tolist():
        if part and (rows + size[run]) * longest[run] > CELLS:
            yield np.concatenate(part)
            part, rows = [], 0
        part.append(np.arange(starts[run], starts[run] + size[run]))
        rows += int(size[run])
    if part:
        yield np.concatenate(part)


def signatures(table: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, signature, kind) arrays: all PartEnum signatures of all words.

    Words of one length share a signature that leaves two parts out. Of lengths one apart they share one under the lesser
    length that leaves one part out, ``kind`` telling the sides apart.
    """
    word, place = np.nonzero(table)
    letter = table[word, place]
    # The how-manieth of its letter each letter is: its rank in the run of equal letters of the word.
    order = np.lexsort((place, letter, word))
    run = word[order] * 256 + letter[order]
    first = np.r_[True, run[1:] != run[:-1]]
    rank = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
    hashes = _mixed((run % 256 << 20 | rank + 1).astype(np.uint64))
    words, found, kinds = [], [], []
    for slack, parts, sought in ((2, PARTS_REPLACED, ((ALIKE, 0),)), (1, PARTS_MOVED, ((SHORTER, 0), (LONGER, -1)))):
        sums = np.zeros((len(table), parts), dtype=np.uint64)
        np.add.at(sums, (word[order], (hashes >> np.uint64(40)) % np.uint64(parts)), hashes)
        for no, chosen in enumerate(combinations(range(parts), parts - slack)):
            kept = _mixed(sums[:, chosen].sum(axis=1, dtype=np.uint64) + np.uint64(no * 0x9E3779B9 + slack))
            for kind, less in sought:
                span = ((lengths + less) * 4 + slack).astype(np.uint64)
                words.append(np.arange(len(table)))
                found.append(_mixed(kept + span * np.uint64(0x9E3779B97F4A7C15)))
                kinds.append(np.full(len(table), kind, dtype=np.int8))
    return np.concatenate(words), np.concatenate(found), np.concatenate(kinds)


def _signed(words: DataFrame) -> DataFrame:
    """(bucket, kind, word) for each signature of each word."""
    schema = pa.schema([("bucket", pa.int64()), ("kind", pa.int8()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2000):
                words = batch.column(0).to_pylist()
                for part in tables(np.arange(len(words)), np.array([len(w) for w in words])):
                    word, signature, kind = signatures(*letters([words[i] for i in part.tolist()]))
                    yield pa.RecordBatch.from_arrays([pa.array(signature.view(np.int64)), pa.array(kind),
                                                      batch.column(0).take(pa.array(part[word]))], schema=schema)

    return words.select("word").mapInArrow(run, "bucket bigint, kind tinyint, word string")


def one_apart(table: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words b are words a with one letter replaced, or with one more letter."""
    one, other, longer = table[a], table[b], lengths[b] == lengths[a] + 1
    differ = (one != other).sum(axis=1)
    # With the letter at the first difference left out, the longer word is the shorter one.
    at = np.where(longer, np.argmax(one != other, axis=1), 0)
    places = np.arange(table.shape[1])
    moved = np.where(places < at[:, None], other, np.pad(other, ((0, 0), (0, 1)))[:, 1:])
    return np.where(longer, (moved == one).all(axis=1), (lengths[a] == lengths[b]) & (differ == 1))


def near_pairs(bucket: np.ndarray, kind: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) of one bucket whose words are one edit apart; a is the lesser or the shorter one.

    In a bucket, words are dealt by a hash of what is left without one letter (and of its place, for words of one
    length), and those that agree are verified.
    """
    table, lengths = letters(words)
    place = np.arange(table.shape[1])
    letter = _mixed(table.astype(np.uint64) + np.uint64(1)) * (table > 0)
    weight = _mixed(place.astype(np.uint64) + np.uint64(1000)) | np.uint64(1)
    # Sums of weighted letters before each place, and after it with each letter one place to the left.
    before = np.pad(np.cumsum(letter * weight, axis=1), ((0, 0), (1, 0)))
    moved = letter[:, 1:] * weight[:-1]
    after = np.pad(np.cumsum(moved[:, ::-1], axis=1)[:, ::-1], ((0, 0), (0, 1)))
    left = before[:, :-1] + after
    left = _mixed(left + np.where((kind == ALIKE)[:, None], place + 1, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    own, at = np.nonzero((table > 0) & (kind != SHORTER)[:, None])
    whole = np.flatnonzero(kind == SHORTER)
    row = np.concatenate([own, whole])
    key = np.concatenate([left[own, at], _mixed(before[whole, -1])]) + _mixed(bucket.view(np.uint64))[row]
    order = np.argsort(key)
    key, row = key[order], row[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(start, len(key)))
    # Each row of a run with each later one: what agrees here is one edit apart but for chance, so these are the pairs sought.
    several = np.flatnonzero(size > 1)
    members = np.repeat(start[several], size[several]) + _counting(size[several])
    later = np.repeat(start[several] + size[several], size[several]) - members - 1
    a, b = row[np.repeat(members, later)], row[np.repeat(members, later) + 1 + _counting(later)]
    swap = (kind[a] == LONGER) | (kind[a] == ALIKE) & (kind[b] == ALIKE) & _greater(table, a, b)
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    fit = (bucket[a] == bucket[b]) & ((kind[a] == ALIKE) & (kind[b] == ALIKE) | (kind[a] == SHORTER) & (kind[b] == LONGER))
    a, b = a[fit], b[fit]
    good = one_apart(table, lengths, a, b)
    return a[good], b[good]


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _greater(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = table[a] != table[b]
    at = np.argmax(differ, axis=1)
    rows = np.arange(len(a))
    return table[a][rows, at] > table[b][rows, at]


_PAIRS = pa.schema([("a", pa.string()), ("b", pa.string()), ("bucket", pa.int64()), ("kind", pa.int8())])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the buckets of a sorted stream; the rows of larger buckets go on as they are, without a partner."""
    held: list[tuple[np.ndarray, np.ndarray, list[str]]] = []
    rows, run, passing = 0, 0, None

    def found() -> Iterator[pa.RecordBatch]:
        bucket, kind = (np.concatenate(c) for c in list(zip(*held))[:2])
        words = [w for h in held for w in h[2]]
        # A bucket of one row has no pairs.
        same = np.r_[False, bucket[1:] == bucket[:-1], False]
        several = np.flatnonzero(same[1:] | same[:-1])
        bucket, kind, words = bucket[several], kind[several], [words[i] for i in several.tolist()]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
        for part in tables(starts, np.array([len(w) for w in words], dtype=np.int64)):
            own = [words[i] for i in part.tolist()]
            a, b = near_pairs(bucket[part], kind[part], own)
            pairs = {(own[i], own[j]) for i, j in zip(a.tolist(), b.tolist())}
            if pairs:
                yield batch_of(_PAIRS, *zip(*pairs), [None] * len(pairs), [None] * len(pairs))

    def passed(bucket: np.ndarray, kind: np.ndarray, words: list[str]) -> pa.RecordBatch:
        return batch_of(_PAIRS, words, [None] * len(words), bucket, kind)

    for whole in batches:
        bucket, kind, words = whole.column(0).to_numpy(), whole.column(1).to_numpy(), whole.column(2).to_pylist()
        for a, b in _cuts(bucket):
            part = bucket[a:b], kind[a:b], words[a:b]
            if bucket[a] == passing:
                yield passed(*part)
                continue
            fresh = not held or held[-1][0][-1] != bucket[a]
            if fresh and rows >= HELD:
                yield from found()
                held, rows = [], 0
            held.append(part)
            rows, run = rows + b - a, b - a + (0 if fresh else run)
            if run > BUCKET and bucket[a] == bucket[b - 1]:
                passing = bucket[a]
                yield from (passed(*h) for h in held if h[0][0] == passing)
                held = [h for h in held if h[0][0] != passing]
                rows -= run
    if held:
        yield from found()


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Parts of sorted rows: all that are sure to be whole buckets together, the first and last bucket alone."""
    if not len(bucket):
        return []
    inner = np.searchsorted(bucket, bucket[0], side="right"), np.searchsorted(bucket, bucket[-1], side="left")
    edges = sorted({0, int(inner[0]), int(inner[1]), len(bucket)}) if inner[0] < inner[1] else sorted({0, int(inner[0]), len(bucket)})
    return list(zip(edges, edges[1:]))


def links(words: DataFrame) -> DataFrame:
    """(a, b): each pair of distinct words one inserted, deleted or replaced letter apart, once; a is lesser or shorter.

    Each task compares the buckets of equal signatures it gets. The rows of a bucket that is too large for one task are dealt again,
    by what one edit leaves of the words: words that agree on that are one edit apart, so what is compared there is
    what is returned, however many words share a signature.
    """
    compared = staged(_signed(words).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _compared, "a string, b string, bucket bigint, kind tinyint"), "near-pairs")
    large = compared.where("b is null").selectExpr("bucket", "kind", "a as word", f"""inline(array_distinct(
        case when kind = {SHORTER} then array(struct(0 as place, a as rest)) else
          transform(sequence(1, char_length(a)), i -> struct(if(kind = {ALIKE}, i, 0) as place, concat(left(a, i - 1), substring(a, i + 1)) as rest)) end))""")
    keys = ["bucket", "place", "rest"]
    split = large.where(f"kind <> {LONGER}").selectExpr(*keys, "kind", "word as a").join(
        large.where(f"kind <> {SHORTER}").selectExpr(*keys, "kind as other", "word as b"), keys).where(
        f"if(kind = {ALIKE}, other = {ALIKE} and a < b, other = {LONGER}) and levenshtein(a, b, 1) = 1").select("a", "b")
    return compared.where("b is not null").select("a", "b").union(split).distinct()


def grouped(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs``.

    ``n_near`` words are one edit away. ``form`` is the most frequent of them (ties: the least by code points) where it
    occurs at least ``ratio`` times as often as the word; ``root`` is where forms lead, the word itself if it has none.

    Null and empty texts have no words; a null id counts as the empty text; each row counts, repeated rows too. Other columns are ignored
    and an empty table gives no rows. As each form is ``ratio`` times as frequent as its word, chains end, and
    roots are found by following twice as many forms in each round.
    """
    words = staged(word_counts(docs, least_length, least_count), "words")
    near = staged(links(words), "near-words")
    both = near.union(near.select("b", "a")).toDF("word", "other")
    counted = both.join(words.toDF("other", "other_n"), "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("other_n").alias("most"),
        F.min_by("other", F.struct(-F.col("other_n"), "other")).alias("other"))
    found = words.join(counted, "word", "left").selectExpr(
        "word", f"case when most >= {ratio} * n then other end as form", "n", "coalesce(n_near, 0L) as n_near",
        f"case when most >= {ratio} * n then most end as form_n")
    found = staged(found, "forms")
    chains = found.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = chains.toDF("root", "_next")
        chains = staged(chains.join(onward, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if not chains.where("moved").limit(1).count():
            break
        chains = chains.drop("moved")
    return found.join(chains.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
