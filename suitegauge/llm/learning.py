"""What both classifiers share: the labelled sample they learn from, and isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import WORD, batch_of, held_out, slices, staged

#: Parts that a sample is dealt into, and so parts whose sums the driver adds.
PARTS = 16
#: Score steps that calibration tells apart.
STEPS = 4096


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): at most about ``most`` rows with a label of 0 or 1 that are not held out, written once.

    Rows are chosen by hash of their id. Of texts that share their least-hashed run of three words with another, as
    near copies do, one is kept, so that a text with many copies does not teach its rare words. Ids labelled twice do not teach.
    """
    known = (labels.where(~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top"))
             .where("y = top and y in (0, 1)").select("doc_id", "y"))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n)))
    chosen = known.where(share)
    # The sample is bounded by ``most``, so it may be sent to every executor.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("y", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for whole in batches:
            for batch in slices(whole):
                texts = batch.column(1).to_pylist()
                least = ([], [])
                for text in texts:
                    words = WORD.findall(text or "")
                    runs = set(zip(words, words[1:], words[2:])) or {tuple(words)}
                    runs = [" ".join(r) for r in runs]
                    for seed, column in enumerate(least, 1):
                        column.append(min(xxh64_intdigest(r, seed) for r in runs) >> 1)
                yield batch_of(schema, batch.column(0), texts, batch.column(2), *least)

    marked = staged(rows.mapInArrow(run, "doc_id bigint, text string, y int, a bigint, b bigint"), "labelled")
    first = marked.groupBy("a").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    marked = marked.join(first, "doc_id", "left_semi")
    first = marked.groupBy("b").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return staged(marked.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text", "y")
                  .repartition(PARTS, "doc_id"), "sample")


def isotonic(scored: DataFrame) -> tuple[list[float], list[float]]:
    """From (score in 0..1, y): points of the calibrated curve, rising in both; one step's counts per row reach the driver."""
    steps = (scored.select(F.least(F.floor(F.col("score") * STEPS), F.lit(STEPS - 1)).alias("step"), "y")
             .groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).orderBy("step").collect())
    blocks: list[list[float]] = []
    for row in steps:
        blocks.append([(row["step"] + 0.5) / STEPS * row["n"], row["n"], row["hits"]])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    # Each block is drawn towards the overall rate by half a row, so that no score is quite 0 or 1.
    n, hits = sum(b[1] for b in blocks), sum(b[2] for b in blocks)
    rate = hits / n if n else 0.5
    xs, ys = [0.0], [0.0]
    for x, size, hit in blocks:
        xs.append(x / size)
        ys.append((hit + 0.5 * rate) / (size + 0.5))
    return [*xs, 1.0], [*ys, 1.0]


def calibrated(scores: np.ndarray, curve: tuple[list[float], list[float]]) -> np.ndarray:
    """Scores on the curve, drawn as a line between its points so that order is not lost within a block."""
    return np.interp(scores, *curve)
