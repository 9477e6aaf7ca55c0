"""What the operators of this folder share: words, staged tables, held-out rows, connected components."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from types import ModuleType

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from suitegauge.session import work_folder

#: Fixed value: a word is a run of anything but space and the ASCII controls tab to carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Fixed value: ASCII capitals to small letters.
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"
EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LABELS).parquet(f"{folder}/labels.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves no remainder by 5; such rows never teach. Null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


@contextmanager
def _files_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go as soon as the query that wrote them has ended."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Writes a frame to the shared folder, frees its shuffle files and reads it back: computed once, lineage cut."""
    path = work_folder(df.sparkSession, purpose)
    with _files_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that what Python holds at a time stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def batch_of(schema: pa.Schema, *columns: Iterable) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, over all tasks it runs.

    Functions reach workers inside the plan, so their own modules start anew with each task.
    """
    holder = sys.modules.setdefault("_suitegauge_worker", ModuleType("_suitegauge_worker"))
    return holder.__dict__.setdefault(name, {})


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str, most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Cuts a stream sorted by a long ``key`` into batches that never part a group.

    A group stays whole however long it is, so callers split long groups before.
    """
    import numpy as np

    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if rest and (cut or rest[-1].column(key)[rest[-1].num_rows - 1].as_py() != keys[0]):
            head = [*rest, batch.slice(0, cut)] if cut else rest
            yield pa.Table.from_batches(head).combine_chunks().to_batches()[0]
            rest = []
            batch = batch.slice(cut)
        elif not rest and cut:
            yield batch.slice(0, cut)
            batch = batch.slice(cut)
        rest.append(batch)
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: longs), root being the smallest node it reaches.

    Alternating large and small stars; each round is one written table, and the rounds
    end when a round changes nothing. The number of rounds grows with the logarithm of
    the longest chain. Self links and repeated links are allowed; no links give no rows.
    """
    now = staged(edges.where("u <> v").select("u", "v").distinct(), purpose)
    seen = None
    while True:
        now = staged(_small_star(_large_star(now)), purpose)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def byte_slices(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``most`` bytes of a string column; a longer text is a piece of its own."""
    import numpy as np

    texts = batch.column(column)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else [0]
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, upto - at)
        at = upto
