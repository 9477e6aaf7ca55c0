"""Embedding near-dedup by NN-descent.

A graph of near neighbours starts from hashing by random hyperplanes and improves by comparing the neighbours
of each vector with each other, until rounds change little. A vector whose list is full of links is saturated:
its list is enlarged to the whole component that its links reach, compared in blocks that return counts, so that
large groups are counted exactly without listing their pairs. An audit compares a bounded number of vectors with
all others; if too many links of any class of vectors are missing, the graph is refined from further hash tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from suitegauge.llm.common import batch_of, components, slices, sorted_groups, staged

#: Length of neighbour lists; rounds at most; share of changed entries at which rounds end.
LIST, ROUNDS, SETTLED = 8, 5, 0.01
#: Vectors in a bucket of a hash table, on average; share of lone links, at the least cosine, that all tables may miss; tables in one shuffle.
BUCKET, MISSED, TOGETHER = 128, 0.001, 2
#: Vectors of a component that one task compares with as many others.
BLOCK = 1024
#: Vectors of each class of component size that the audit compares with all others, at most; the recall that it asks for
#: at every class of link counts; how often links are looked for before an error tells.
AUDITED, RECALL, TRIES = 500, 0.98, 3

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("cos", pa.float64())])
_EDGE_SQL = "u bigint, v bigint, cos double"


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec, raw): the vectors that can link, in their own precision as raw bytes, one per id.

    Null, empty and zero vectors and those with null or non-finite components cannot, nor can rows without an id. An id
    names one vector: where it repeats with several, the least of them counts.
    """
    narrow = "array<float>" in dict(vectors.dtypes)["embedding"]
    schema = pa.schema([("vec", pa.int64()), ("raw", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = [], []
            for vec, values in zip(*(c.to_pylist() for c in batch.columns)):
                if vec is None or not values or None in values:
                    continue
                row = np.array(values, dtype=np.float32 if narrow else np.float64) + 0
                if np.isfinite(row).all() and row.any():
                    ids.append(vec)
                    raws.append(row.tobytes())
            yield batch_of(schema, ids, raws)

    found = vectors.select("vec_id", "embedding").mapInArrow(run, "vec bigint, raw binary")
    return found.groupBy("vec").agg(F.min("raw").alias("raw"))


def _units(raws: list[bytes], dtype: type) -> np.ndarray:
    rows = np.frombuffer(b"".join(raws), dtype=dtype).reshape(len(raws), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _dtype(vectors: DataFrame) -> type:
    return np.float32 if "array<float>" in dict(vectors.dtypes)["embedding"] else np.float64


def tables(count: int, least: float) -> tuple[int, int]:
    """Bits of a hash, and how many tables leave no more than ``MISSED`` of lone pairs of cosine ``least`` without a common bucket."""
    bits = min(24, max(0, math.ceil(math.log2(max(1, count / BUCKET)))))
    together = (1 - math.acos(max(-1.0, min(1.0, least))) / math.pi) ** bits
    return bits, 1 if together >= 1 - MISSED else math.ceil(math.log(MISSED) / math.log1p(-max(together, 1e-6)))


def _groups(near: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The connected group of each vector, and links that connect the groups, fewer than vectors."""
    group, links = np.arange(len(near)), []
    left = near.any(axis=1)
    for seed in np.flatnonzero(left).tolist():
        if not left[seed]:
            continue
        left[seed], edge = False, np.array([seed])
        while len(edge):
            new = np.flatnonzero(near[edge].any(axis=0) & left)
            links += zip(edge[near[np.ix_(edge, new)].argmax(axis=0)].tolist(), new.tolist()) if len(new) else []
            left[new], group[new], edge = False, seed, new
    return group, links


def _compared(ids: np.ndarray, units: np.ndarray, first: np.ndarray, second: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a pair of parts: inside one part, the nearest few of each vector and links that connect; between two, links that connect them."""
    cos = units @ units.T
    np.fill_diagonal(cos, -2.0)
    near = cos >= least
    if (first & second).all():
        links = _groups(near)[1]
        few = min(LIST, len(ids) - 1)
        if few:
            nearest = np.argpartition(-cos, few - 1, axis=1)[:, :few]
            links += zip(np.repeat(np.arange(len(ids)), few).tolist(), nearest.ravel().tolist())
    else:
        # Parts are connected inside by tasks of their own, so one link for each pair of groups is enough.
        within = near & (first[:, None] == first[None, :])
        group = _groups(within)[0]
        a, b = np.nonzero(near & (first[:, None] & ~first[None, :]))
        _, at = np.unique(group[a] * len(ids) + group[b], return_index=True)
        links = list(zip(a[at].tolist(), b[at].tolist()))
    i, j = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return ids[i], ids[j], cos[i, j]


def _start(nodes: DataFrame, dtype: type, count: int, least: float, attempt: int) -> DataFrame:
    """Near pairs of vectors that some table of random hyperplanes puts into one bucket.

    Buckets are compared whole, large ones in pairs of parts: whatever links inside a bucket connect is connected.
    """
    bits, number = tables(count, least)
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("raw", pa.binary())])

    def keyed(chosen: range) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raws = batch.column(1).to_pylist()
                for width in {len(r) for r in raws}:
                    mine = [i for i, r in enumerate(raws) if len(r) == width]
                    units = _units([raws[i] for i in mine], dtype)
                    for table in chosen:
                        planes = np.random.default_rng([table, width]).normal(size=(units.shape[1], bits))
                        code = (units @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) + ((table - chosen.start) << 24) + (width << 32)
                        yield batch_of(schema, code.astype(np.int64), batch.column(0).take(pa.array(mine)), [raws[i] for i in mine])
        return run

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, "part"):
            parts, ids, first, second = (np.asarray(batch.column(c)) for c in ("part", "node", "first", "second"))
            raws = batch.column("raw").to_pylist()
            starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(parts)]):
                if b - a > 1:
                    yield batch_of(_EDGE, *_compared(ids[a:b], _units(raws[a:b], dtype), first[a:b], second[a:b], least))

    met = []
    for at in range(0, number, TOGETHER):
        chosen = range(attempt * number + at, attempt * number + min(number, at + TOGETHER))
        coded = nodes.select("node", "raw").mapInArrow(keyed(chosen), "bucket bigint, node bigint, raw binary")
        # Few rows of counts: buckets that are larger than a part.
        large = staged(coded.groupBy("bucket").count().where(F.col("count") > BLOCK).select(
            "bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "nn-large")
        own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda other: F.struct(
            F.least("own", other).alias("a"), F.greatest("own", other).alias("b")))
        routed = (coded.join(large, "bucket", "left").withColumn("own", own).select("bucket", "node", "raw", "own", F.explode(pairs).alias("pair"))
                  .select(F.xxhash64("bucket", "pair.a", "pair.b").alias("part"), "node", "raw",
                          (F.col("own") == F.col("pair.a")).alias("first"), (F.col("own") == F.col("pair.b")).alias("second")))
        met.append(staged(routed.repartition("part").sortWithinPartitions("part").mapInArrow(near, _EDGE_SQL), "nn-start"))
    return reduce(DataFrame.union, met)


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "cos").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos"))


def _lists(edges: DataFrame) -> DataFrame:
    """The nearest few of every vector."""
    order = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    return (_both(edges).groupBy("u", "v").agg(F.max("cos").alias("cos"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LIST).drop("rank"))


def _round(nodes: DataFrame, lists: DataFrame, before: DataFrame | None, dtype: type, least: float) -> DataFrame:
    """Compares the neighbours of each vector, in both directions of the graph, with each other.

    Pairs of which both were neighbours of it before are known. Returned are pairs that enter a list, and links.
    """
    worst = lists.groupBy("u").agg(F.when(F.count("*") >= LIST, F.min("cos")).otherwise(-2.0).alias("worst"))
    fresh = lists.withColumn("fresh", F.lit(True)) if before is None else (
        lists.join(before.select("u", "v", F.lit(False).alias("old")), ["u", "v"], "left")
        .select("u", "v", "cos", F.coalesce("old", F.lit(True)).alias("fresh")))
    turned = fresh.select(F.col("v").alias("u"), F.col("u").alias("v"), "cos", "fresh")
    order = Window.partitionBy("u").orderBy(F.desc("cos"), "v")
    near = (fresh.union(turned.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LIST).drop("rank"))
            .groupBy("u", "v").agg(F.max("fresh").alias("fresh")))
    named = nodes.select(F.col("node").alias("v"), "raw").join(worst.withColumnRenamed("u", "v"), "v", "left")
    rows = near.join(named, "v").select(F.col("u").alias("hub"), "v", "fresh", "raw", F.coalesce("worst", F.lit(-2.0)).alias("worst"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, "hub"):
            hubs, ids, fresh, worst = (np.asarray(batch.column(i)) for i in (0, 1, 2, 4))
            raws = batch.column(3).to_pylist()
            starts = np.flatnonzero(np.r_[True, hubs[1:] != hubs[:-1]])
            out: list[list[np.ndarray]] = [[], [], []]
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(hubs)]):
                if b - a < 2 or len({len(r) for r in raws[a:b]}) > 1:
                    continue
                units = _units(raws[a:b], dtype)
                cos = units @ units.T
                i, j = np.triu_indices(b - a, 1)
                c = cos[i, j]
                good = (fresh[a + i] | fresh[a + j]) & ((c > worst[a + i]) | (c > worst[a + j]) | (c >= least))
                if good.any():
                    for column, values in zip(out, (ids[a + i[good]], ids[a + j[good]], c[good])):
                        column.append(values)
            if out[0]:
                yield batch_of(_EDGE, *(np.concatenate(c) for c in out))

    return rows.repartition("hub").sortWithinPartitions("hub").mapInArrow(run, _EDGE_SQL)


def _descend(nodes: DataFrame, dtype: type, count: int, least: float, attempt: int) -> DataFrame:
    """(u, v, cos): the links at or over ``least`` that the graph met."""
    met = _start(nodes, dtype, count, least, attempt)
    links = [met.where(F.col("cos") >= least)]
    lists, before = staged(_lists(met), "nn-lists"), None
    for _ in range(ROUNDS):
        found = staged(_round(nodes, lists, before, dtype, least), "nn-round")
        links.append(found.where(F.col("cos") >= least))
        lists, before = staged(_lists(lists.union(found)), "nn-lists"), lists
        changed = lists.join(before, ["u", "v"], "left_anti").count()
        if changed <= SETTLED * LIST * max(1, count):
            break
    return reduce(DataFrame.union, links)


def _counts(nodes: DataFrame, links: DataFrame, dtype: type, least: float) -> DataFrame:
    """(node, linked, component): ids linked to each vector's class from other classes, and the root of its component.

    Every component with links is compared as a whole, in pairs of blocks.
    """
    reach = staged(components(links.select("u", "v"), "nn-components"), "nn-reach")
    sizes = reach.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(
        F.least("own", other).alias("a"), F.greatest("own", other).alias("b")))
    routed = (nodes.join(reach, "node").join(sizes, "root").withColumn("own", own)
              .select("root", "node", "raw", "ids", "own", F.explode(pairs).alias("pair"))
              .select("node", "raw", "ids", (F.col("own") == F.col("pair.a")).alias("first"), (F.col("own") == F.col("pair.b")).alias("second"),
                      F.xxhash64("root", "pair.a", "pair.b").alias("group")))
    schema = pa.schema([("node", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sorted_groups(batches, "group"):
            groups, ids, sizes, first, second = (np.asarray(batch.column(i)) for i in (5, 0, 2, 3, 4))
            raws = batch.column(1).to_pylist()
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(groups)]):
                units = _units(raws[a:b], dtype)
                x, y = np.flatnonzero(first[a:b]), np.flatnonzero(second[a:b])
                near = units[x] @ units[y].T >= least
                same = bool((first[a:b] & second[a:b]).any())
                if same:
                    near[np.arange(len(x)), np.arange(len(x))] = False
                yield batch_of(schema, ids[a:b][x], near @ sizes[a:b][y])
                if not same:
                    yield batch_of(schema, ids[a:b][y], near.T @ sizes[a:b][x])

    counted = (routed.repartition("group").sortWithinPartitions("group").mapInArrow(run, "node bigint, linked bigint")
               .groupBy("node").agg(F.sum("linked").alias("linked")))
    return staged(counted.join(reach, "node").select("node", "linked", F.col("root").alias("component")), "nn-counts")


def audit(nodes: DataFrame, counts: DataFrame, count: int, least: float, dtype: type) -> float:
    """The least recall of any class of vectors by their true number of links, in powers of two.

    Asked are a bounded number of vectors of each class of component size, those without links being one, and each
    stands for as many as its class has to one asked. So a large group says nothing about pairs and small groups.
    """
    sizes = counts.groupBy("component").agg(F.floor(F.log2(F.count("*").cast("double"))).cast("int").alias("class"))
    classed = staged(nodes.select("node").join(counts.join(sizes, "component").select("node", "class"), "node", "left")
                     .select("node", F.coalesce("class", F.lit(0)).alias("class")), "nn-classes")
    members = {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()}
    cut = reduce(lambda rest, c: F.when(F.col("class") == c, int(1_000_000_000 * min(1.0, AUDITED / members[c]))).otherwise(rest), members, F.lit(0))
    chosen = classed.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1_000_000_000)) < cut)
    asked = [(r["node"], bytes(r["raw"])) for r in nodes.join(chosen, "node").select("node", "raw").collect()]
    schema = pa.schema([("node", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4096):
                raws = batch.column(1).to_pylist()
                for width in {len(r) for _, r in asked}:
                    mine = [i for i, r in enumerate(raws) if len(r) == width]
                    queries = [(n, r) for n, r in asked if len(r) == width]
                    if mine and queries:
                        ids, sizes = batch.column(0).to_numpy()[mine], batch.column(2).to_numpy()[mine]
                        names = np.array([n for n, _ in queries])
                        near = (_units([raws[i] for i in mine], dtype) @ _units([r for _, r in queries], dtype).T >= least) & (ids[:, None] != names)
                        yield batch_of(schema, names, sizes @ near)

    true = nodes.select("node", "raw", "ids").mapInArrow(run, "node bigint, linked bigint").groupBy("node").agg(F.sum("linked").alias("true"))
    weight = F.greatest(F.lit(1.0), reduce(lambda rest, c: F.when(F.col("class") == c, members[c] / AUDITED).otherwise(rest), members, F.lit(1.0)))
    judged = (true.where(F.col("true") > 0).join(counts, "node", "left").join(classed, "node")
              .groupBy(F.floor(F.log2(F.col("true").cast("double"))).alias("links"))
              .agg((F.sum(weight * F.least("true", F.coalesce("linked", F.lit(0))) / F.col("true")) / F.sum(weight)).alias("recall")))
    worst = judged.agg(F.min("recall")).first()[0]
    return 1.0 if worst is None else worst


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding).

    Two vectors link if their cosine, in double precision, is at least ``least``; n_links counts the other
    ids linked directly, component_id is the least id reachable, kept tells that it is the row's own. What
    ``usable_vectors`` leaves out links with nothing, nor do vectors of different length. Rows without an id are kept, with no component.
    Repeated rows get the same result; extra columns, labels among them, are ignored; an empty table gives no rows.
    """
    dtype = _dtype(vectors)
    usable = staged(usable_vectors(vectors), "vectors")
    nodes = staged(usable.groupBy("raw").agg(F.min("vec").alias("node"), F.count("*").alias("ids")), "vector-classes")
    count = nodes.count()
    links, counts = None, None
    for attempt in range(TRIES):
        more = _descend(nodes, dtype, count, least, attempt)
        links = more if links is None else links.union(more)
        counts = _counts(nodes, links, dtype, least)
        recall = audit(nodes, counts, count, least, dtype)
        if recall >= RECALL:
            break
    else:
        raise RuntimeError(f"after {TRIES} sets of hash tables the audit's recall is {recall:.4f}, below {RECALL}")
    classes = nodes.join(counts, "node", "left").select(
        "raw", (F.col("ids") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    named = staged(usable.join(classes, "raw").select(F.col("vec").alias("vec_id"), "n_links", "component_id"), "vector-links")
    return vectors.select("vec_id").join(named, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))
