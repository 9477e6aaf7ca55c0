"""SimHash near-dedup: fingerprints of word shingles, linked by pigeonring filtering.

The 64 bits lie on a ring of four 16-bit segments. If two fingerprints differ in at most
three bits, some segment starts a chain whose first 1, 2, 3 and 4 segments differ in at most
0, 1, 2 and 3 bits (each within its share of the budget). So equal values of that segment,
and of one half of the next, bring every such pair together; pairs without a viable chain
are pruned before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import LOWER, WORD, batch_of, components, slices, sorted_groups, staged

SEED = 42
SEGMENTS = 4
#: Members of a bucket that one task compares among each other; larger buckets are cut into pairs of parts.
PART = 2048


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; no words give 0."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    if len(words) < shingle:
        grams = [" ".join(words)]
    elif shingle == 3:
        grams = [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:])]
    else:
        grams = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)]
    hashes = np.array([xxh64_intdigest(g, SEED) for g in grams], dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    rows = hashes.view(np.uint8).reshape(-1, 8)
    for at in range(0, len(rows), 60_000):
        counts += np.unpackbits(rows[at:at + 60_000], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, *longs: str) -> DataFrame:
    """(doc_id, fp, and columns of longs): one row per row of ``docs``, fp being the unsigned fingerprint as a signed long."""
    schema = pa.schema([(name, pa.int64()) for name in ("doc_id", "fp", *longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = [fingerprint(t, shingle) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64)), *batch.columns[2:]], schema=schema)

    return docs.select("doc_id", "text", *longs).mapInArrow(run, ", ".join(f"{name} bigint" for name in schema.names))


def _ring_keys(fps: np.ndarray) -> np.ndarray:
    """Eight keys for each fingerprint: place, segment, and one half of the next segment."""
    keys = []
    for i in range(SEGMENTS):
        ring = np.left_shift(fps, np.uint64(16 * i)) | (np.right_shift(fps, np.uint64(64 - 16 * i)) if i else np.uint64(0))
        segment, following = ring >> np.uint64(48), (ring >> np.uint64(32)) & np.uint64(0xFFFF)
        for half in (0, 1):
            part = (following >> np.uint64(8)) if half == 0 else (following & np.uint64(0xFF))
            keys.append((np.uint64(2 * i + half) << np.uint64(24)) | (segment << np.uint64(8)) | part)
    return np.stack(keys, axis=1)


def viable(diff: np.ndarray, start: int, most: int) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps each prefix of it within its share of ``most`` bits."""
    ring = np.left_shift(diff, np.uint64(16 * start)) | (np.right_shift(diff, np.uint64(64 - 16 * start)) if start else np.uint64(0))
    good = np.ones(len(diff), dtype=bool)
    for length in range(1, SEGMENTS + 1):
        bits = np.bitwise_count(np.right_shift(ring, np.uint64(64 - 16 * length)))
        good &= bits <= (length * most) // SEGMENTS
    return good


def bucket_forest(fps: np.ndarray, start: int, most: int) -> list[tuple[int, int]]:
    """Links that connect all of a bucket's fingerprints which its links connect; fewer than its members."""
    links = []
    left = fps
    while len(left) > 1:
        edge, left = [left[0]], left[1:]
        while edge and len(left):
            one = edge.pop()
            diff = left ^ one
            hit = viable(diff, start, most)
            if hit.any():
                hit[hit] = np.bitwise_count(diff[hit]) <= most
                near = left[hit]
                links += [(int(one), int(x)) for x in near.view(np.int64)] if len(near) else []
                edge += list(near)
                left = left[~hit]
    return links


def links(classes: DataFrame, most: int = 3) -> DataFrame:
    """(u, v): for distinct fingerprints ``fp``, enough links of at most ``most`` bits to reach whatever links reach."""
    if not 0 <= most <= 3:
        raise ValueError("the keys are complete for distances from 0 to 3")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
        for batch in batches:
            fps = batch.column(0).to_numpy()
            keys = _ring_keys(fps.view(np.uint64))
            yield batch_of(schema, keys.reshape(-1).view(np.int64), np.repeat(fps, keys.shape[1]))

    keys = staged(classes.select("fp").mapInArrow(keyed, "key bigint, fp bigint"), "ring-keys")
    sizes = keys.groupBy("key").count()
    parts = staged(sizes.where(F.col("count") > PART).select("key", F.ceil(F.col("count") / PART).cast("int").alias("parts")),
                   "ring-parts")
    # A large bucket is cut into parts; each pair of parts is compared by a task of its own.
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1),
                        lambda other: F.struct(F.least("own", other).alias("a"), F.greatest("own", other).alias("b")))
    routed = (keys.join(parts, "key", "left").withColumn("own", own)
              .select("key", "fp", F.explode(pairs).alias("pair"))
              .select("key", "fp", F.xxhash64("key", "pair.a", "pair.b").alias("bucket"))
              .repartition("bucket").sortWithinPartitions("bucket"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for batch in sorted_groups(batches, "bucket"):
            buckets, fps, keys = (batch.column(c).to_numpy() for c in ("bucket", "fp", "key"))
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            ends = np.r_[starts[1:], len(buckets)]
            found = []
            for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
                found += bucket_forest(fps[a:b].view(np.uint64), int(keys[a]) >> 25, most)
            if found:
                u, v = np.array([[x if x < 1 << 63 else x - (1 << 64), y] for x, y in found], dtype=np.int64).T
                yield batch_of(schema, u, v)

    return routed.mapInArrow(compare, "u bigint, v bigint")


def _grouped(classes: DataFrame, most: int) -> DataFrame:
    """``classes`` (fp, least) with root: the least fingerprint that links reach."""
    reach = components(links(classes, most), "simhash")
    return classes.join(reach, classes.fp == reach.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links of at most ``most`` bits.

    Nulls and empty texts have fingerprint 0 and link like any other. One row for each row of ``docs``, repeated ids
    included; rows without an id are fingerprinted and linked, and a component of such rows alone has no id. Extra
    columns are ignored; an empty table gives no rows. Equal fingerprints are one class from the start, so copies,
    however many, cost one row each.
    """
    fps = staged(fingerprints(docs, shingle), "fingerprints")
    classes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    grouped = _grouped(classes, most)
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def kept_documents(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the least by doc_id, text and the other columns, rows without an id last.

    Rows are judged by their own texts, so an id that repeats with unlike texts is in several components, and a row without an
    id goes like any other if a near copy of it stays.
    """
    content = F.xxhash64("text")
    # Rows without an id come under the largest one; a row that really has it differs by its text, or is a copy.
    number = F.coalesce("doc_id", F.lit(2**63 - 1).cast("long"))
    # A text's fingerprint, once per id and text; ids that repeat a text cost one row.
    texts = docs.groupBy(number.alias("doc_id"), content.alias("content")).agg(F.count("*").alias("rows"), F.first("text").alias("text"))
    prints = staged(fingerprints(texts, shingle, "content", "rows"), "fingerprints")
    classes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    grouped = _grouped(classes, most)
    firsts = grouped.groupBy("root").agg(F.min("least").alias("first_id"))
    named = staged(prints.join(grouped.join(firsts, "root").select("fp", "root", "first_id"), "fp").drop("fp"), "named")
    sizes = named.where("doc_id = first_id").groupBy("root").agg(F.sum("rows").alias("size"))
    gone = staged(named.where("doc_id > first_id").select("doc_id", "content"), "gone")
    repeated = staged(named.where("doc_id = first_id").join(sizes.where("size > 1"), "root").select("doc_id", "content", "root"), "repeated")
    keyed = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    names = dict(zip(docs.columns, keyed.columns))
    keyed = keyed.withColumn("doc_id", F.coalesce(names["doc_id"], F.lit(2**63 - 1).cast("long"))).withColumn("content", F.xxhash64(names["text"]))
    alone = keyed.join(gone, ["doc_id", "content"], "left_anti").join(repeated, ["doc_id", "content"], "left_anti")
    others = [names[c] for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(F.col(names["doc_id"]).isNull(), *[names[c] for c in ("doc_id", "text")], *others)
    least = keyed.join(repeated, ["doc_id", "content"]).groupBy("root").agg(F.min(order).alias("row")).select(*[f"row.{c}" for c in names.values()])
    return alone.select(*keyed.columns[:len(names)]).unionByName(least).toDF(*docs.columns)
