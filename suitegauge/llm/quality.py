"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of the text. Each part of the sample adds up
its normal equations; the driver solves the sum of a bounded number of them. Four fifths of the sample fit
the ridge scores, the rest calibrates them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import WORD, batch_of, held_out, slices
from suitegauge.llm.learning import calibrated, isotonic, labelled_sample

#: Labelled rows that teach, at most.
SAMPLE = 30_000
FEATURES, WIDTH, RIDGE, SEED = 384, 3.0, 1.0, 20_240_607

_UPPER, _LOWER, _DIGIT = (np.arange(256) >= 65) & (np.arange(256) <= 90), (np.arange(256) >= 97) & (np.arange(256) <= 122), (np.arange(256) >= 48) & (np.arange(256) <= 57)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-?"])
_HIGH = np.arange(256) >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _SPACE | _STOP | _HIGH)
_GROUPS = np.stack([_UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL, _HIGH]).astype(np.float64)


def statistics(text: str | None) -> list[float]:
    """What the classifier sees of a text: sizes, shares of characters, and how much of it repeats."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    shares = (_GROUPS @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / max(1, len(raw))).tolist()
    words, lines = WORD.findall(text), text.split("\n")
    n = max(1, len(words))
    counts = Counter(words)
    most = max(counts.values(), default=0)
    short = sum(v for w, v in counts.items() if len(w) <= 3)
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    length = sum(map(len, words)) / n
    return [np.log1p(len(raw)), np.log1p(len(words)), *shares, length, np.log1p(len(counts)) / np.log1p(n), len(counts) / n, pairs, most / n,
            short / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)), max(map(len, lines)) / max(1, len(text)),
            text.count("|") / n, text.count("!") / n, sum(map(text.count, "#$%&*")) / n]


WIDTH_IN = len(statistics("a"))


@dataclass(frozen=True)
class Model:
    """Means and spreads of the statistics, weights of the Fourier features, and the calibration curve."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    curve: tuple[list[float], list[float]]

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(fourier((stats - self.centre) / self.spread) @ self.weights, 0, 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return calibrated(self.raw(stats), self.curve)


def fourier(x: np.ndarray) -> np.ndarray:
    """Cosines along random directions, whose inner products approximate exp(-|x-y|^2 / (2 WIDTH^2)); and a constant."""
    rng = np.random.default_rng(SEED)
    directions, phases = rng.normal(0, 1 / WIDTH, (WIDTH_IN, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    waves = np.sqrt(2 / FEATURES) * np.cos(np.clip(x, -6, 6) @ directions + phases)
    return np.hstack([waves, np.clip(x, -6, 6) / 10, np.ones((len(x), 1))])


def _sums(sample: DataFrame, of) -> np.ndarray:
    """The sum over the sample's parts of what ``of`` makes of each batch's statistics and labels."""
    schema = pa.schema([("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                stats = np.array(batch.column(0).to_pylist(), dtype=np.float64)
                total = total + of(stats, batch.column(1).to_numpy().astype(np.float64))
        if isinstance(total, np.ndarray):
            yield batch_of(schema, [total.tobytes()])

    parts = sample.select("stats", "y").mapInArrow(run, "part binary").collect()  # one row for each of PARTS parts
    return sum(np.frombuffer(r["part"], dtype=np.float64) for r in parts) if parts else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """Without labelled rows every score is the middle of the scale."""
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("stats", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                yield batch_of(schema, batch.column(0), batch.column(2), [statistics(t) for t in batch.column(1).to_pylist()])

    sample = labelled_sample(docs, labels, "quality", most).mapInArrow(run, "doc_id bigint, y int, stats array<double>")
    moments = _sums(sample, lambda s, y: np.concatenate([[len(s)], s.sum(0), (s * s).sum(0)]))
    if not len(moments):
        return Model(np.zeros(WIDTH_IN), np.ones(WIDTH_IN), np.zeros(FEATURES + WIDTH_IN + 1), ([0.0, 1.0], [0.5, 0.5]))
    n, centre = moments[0], moments[1:WIDTH_IN + 1] / moments[0]
    spread = np.sqrt(np.maximum(moments[WIDTH_IN + 1:] / n - centre ** 2, 1e-6))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)) == 0

    def normal(s: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = fourier((s - centre) / spread)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]]).ravel()

    width = FEATURES + WIDTH_IN + 1
    sums = _sums(sample.where(~calibrates), normal)
    sums = sums.reshape(width, width + 1) if len(sums) else np.zeros((width, width + 1))
    penalty = np.eye(width) * RIDGE
    penalty[-1, -1] = 1e-6
    model = Model(centre, spread, np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1]), ([], []))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column(0).to_pylist(), dtype=np.float64))
                yield batch_of(pa.schema([("score", pa.float64()), ("y", pa.int32())]), raw, batch.column(1))

    curve = isotonic(sample.where(calibrates).select("stats", "y").mapInArrow(score, "score double, y int"))
    return Model(centre, spread, model.weights, curve)


def classify(docs: DataFrame, model: Model, threshold: float = 0.3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score (0 to 1, higher: better) and predicted (1 from ``threshold`` on).

    Nulls score like empty texts, by the same statistics; repeated rows score alike. Extra columns are ignored,
    an empty table gives no rows. Texts are read whole.
    """
    kept = docs.select(*keep, F.col("text").alias("__text"))
    fields = kept.drop("__text").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                stats = np.array([statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
                columns = batch.columns[:-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(model.score(stats))], names=[*batch.schema.names[:-1], "score"])

    return kept.mapInArrow(run, ddl).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those that the classifier rejects; columns of any name keep their values."""
    coded = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.col("text"))
    names = [f"c{i}" for i in range(len(docs.columns))]
    return classify(coded, model, threshold, tuple(names)).where("predicted = 1").select(*names).toDF(*docs.columns)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    return classify(docs, fit(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
