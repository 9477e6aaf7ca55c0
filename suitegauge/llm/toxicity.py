"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make scores and offsets.

Labels are given for documents, so tokens are labelled first: in a toxic document, those are toxic that carry a
word or beginning of a word which the sample has almost only in toxic documents. The field has two tags, a weight for
each known word or beginning, and weights for pairs of neighbouring tags. Forward-backward marginals give each
token's probability; the probability that any token is toxic, calibrated on the sample, is the document's score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import batch_of, held_out, slices, staged
from suitegauge.llm.learning import calibrated, isotonic, labelled_sample

#: Labelled rows that teach, at most.
SAMPLE = 6_000
#: Fitting ends when a round moves no weight by more than ``SETTLED``, at the latest after ``ROUNDS`` rounds.
SETTLED, ROUNDS = 0.05, 60
#: Beginnings of these lengths are features, beside the whole word.
PREFIXES = (4, 5, 6, 7, 8, 9)
#: A feature marks toxic tokens if this share of its documents, after adding two that are not, are toxic.
MARKING = 0.7
#: A span is reported where the marginal is at least this.
TAGGED = 0.5

TOKEN = re.compile(r"\w+")
_CHUNK = 64


def features(word: str) -> list[str]:
    """The word in small letters, and its beginnings."""
    word = word.lower()
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass(frozen=True)
class Field:
    """Weights: of each feature and of every token for the toxic tag, and of tag pairs (from, to)."""

    weights: dict[str, float]
    bias: float
    pairs: np.ndarray
    curve: tuple[list[float], list[float]]

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in features(word))


def _scan(steps: np.ndarray) -> np.ndarray:
    """Running products steps[0], steps[0] @ steps[1], ... of 2x2 matrices, scaled; chunks of the chain advance together."""
    n = len(steps)
    if n <= _CHUNK:
        out = np.empty_like(steps)
        product = np.eye(2)
        for i in range(n):
            product = product @ steps[i]
            product = product / product.sum()
            out[i] = product
        return out
    chunks = -(-n // _CHUNK)
    padded = np.broadcast_to(np.eye(2), (chunks * _CHUNK, 2, 2)).copy()
    padded[:n] = steps
    padded = padded.reshape(chunks, _CHUNK, 2, 2)
    out = np.empty_like(padded)
    a, b, c, d = (np.ascontiguousarray(padded[:, 0, i, j]) for i in (0, 1) for j in (0, 1))
    for i in range(_CHUNK):
        if i:
            p, q, r, s = (padded[:, i, x, y] for x in (0, 1) for y in (0, 1))
            a, b, c, d = a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s
        total = a + b + c + d
        a, b, c, d = a / total, b / total, c / total, d / total
        out[:, i, 0, 0], out[:, i, 0, 1], out[:, i, 1, 0], out[:, i, 1, 1] = a, b, c, d
    before = _scan(out[:, -1].copy())
    (p, q), (r, s) = (([before[:-1, x, y][:, None] for y in (0, 1)]) for x in (0, 1))
    a, b, c, d = (out[1:, :, x, y].copy() for x in (0, 1) for y in (0, 1))
    out[1:, :, 0, 0], out[1:, :, 0, 1] = p * a + q * c, p * b + q * d
    out[1:, :, 1, 0], out[1:, :, 1, 1] = r * a + s * c, r * b + s * d
    out /= out.sum(axis=(2, 3), keepdims=True)
    return out.reshape(-1, 2, 2)[:n]


def marginals(emissions: np.ndarray, lengths: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over documents laid end to end: P(toxic) per token, and P(tag before, tag) per token but firsts.

    A document's first step forgets what was before it, which parts the documents exactly.
    """
    n = len(emissions)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    factor = np.stack([np.ones(n), np.exp(np.clip(emissions, -50, 50))], axis=1)
    move = np.exp(pairs)
    forward = move[None] * factor[:, None, :]
    forward[starts] = factor[starts][:, None, :]
    alpha = _scan(forward).sum(axis=1)
    alpha /= alpha.sum(axis=1, keepdims=True)
    backward = (move[None] * factor[:, None, :]).transpose(0, 2, 1)[::-1].copy()
    backward[n - 1 - starts] = 0.5  # what follows a document does not matter to it
    beta = np.ones((n, 2))
    if n > 1:
        beta[:-1] = _scan(backward).sum(axis=1)[::-1][1:]
    beta /= beta.sum(axis=1, keepdims=True)
    joint = alpha * beta
    toxic = joint[:, 1] / joint.sum(axis=1)
    both = np.zeros((n, 2, 2))
    if n > 1:
        both[1:] = alpha[:-1, :, None] * move[None] * (factor[1:] * beta[1:])[:, None, :]
        both /= np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)
        both[starts] = 0.0
    return toxic, both


def any_toxic(toxic: np.ndarray, both: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document the probability that some token is toxic, exactly as the chain has it; 0 without tokens.

    None is toxic if the first is not, and each next one is not given that the one before is not.
    """
    before = both[:, 0, 0] + both[:, 0, 1]
    none = np.where(before > 0, both[:, 0, 0] / np.where(before > 0, before, 1.0), 1.0 - toxic)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    none[starts] = 1.0 - toxic[starts]
    sums = np.r_[0.0, np.cumsum(np.log(np.maximum(none, 1e-12)))]
    ends = np.cumsum(lengths)
    return -np.expm1(sums[ends] - sums[ends - lengths])


def _vocabulary(sample: DataFrame) -> tuple[list[str], set[str]]:
    """Features seen in at least three toxic documents, the most telling first; and those that mark toxic tokens."""
    schema = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1024):
                counts = (Counter(), Counter())
                for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    counts[y].update({f for w in set(TOKEN.findall(text or "")) for f in features(w)})
                seen = list(counts[0] | counts[1])
                yield batch_of(schema, seen, [counts[1][f] for f in seen], [counts[0][f] for f in seen])

    seen = (sample.mapInArrow(run, "feature string, toxic bigint, other bigint").groupBy("feature")
            .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).where("toxic >= 3")
            .withColumn("share", F.col("toxic") / (F.col("toxic") + F.col("other") + 2))
            .orderBy(F.desc("share"), "feature").collect())  # bounded as the sample is
    return [r["feature"] for r in seen], {r["feature"] for r in seen if r["share"] >= MARKING}


def _read_once(sample: DataFrame, vocabulary: list[str], marking: set[str]) -> DataFrame:
    """The sample as numbers: tokens of each text, features of each token, their places in the vocabulary, and token labels."""
    ids = {f: i for i, f in enumerate(vocabulary)}
    names = ("lengths", "counts", "flat", "tags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[list[int], bool]] = {}
        for whole in batches:
            for batch in slices(whole, 256):
                lengths, counts, flat, tags = [], [], [], []
                for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    words = TOKEN.findall(text or "")
                    lengths.append(len(words))
                    for w in words:
                        if w not in known:
                            found = [f for f in features(w) if f in ids]
                            known[w] = ([ids[f] for f in found], any(f in marking for f in found))
                        mine, marks = known[w]
                        counts.append(len(mine))
                        flat += mine
                        tags.append(bool(y and marks))
                if counts:
                    columns = (np.array(lengths, np.int32), np.array(counts, np.int8), np.array(flat, np.int32), np.array(tags, np.int8))
                    yield batch_of(pa.schema([(n, pa.binary()) for n in names]), *([c.tobytes()] for c in columns))

    return staged(sample.mapInArrow(run, ", ".join(f"{n} binary" for n in names)), "toxicity-features")


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Field:
    """Gradients are added up over the sample's parts in each round; without labelled rows every score is the same."""
    sample = labelled_sample(docs, labels, "toxic", most)
    vocabulary, marking = _vocabulary(sample)
    numbers = _read_once(sample, vocabulary, marking)
    size = len(vocabulary)

    def gradient_of(theta: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size + 1 + 4)
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    lengths, counts, flat, tags = (np.frombuffer(b, kind).astype(np.int64)
                                                   for b, kind in zip(row, (np.int32, np.int8, np.int32, np.int8)))
                    owner = np.repeat(np.arange(len(counts)), counts)
                    emission = theta[-1] + np.bincount(owner, weights=theta[flat], minlength=len(counts))
                    toxic, both = marginals(emission, lengths, pairs)
                    gap = tags - toxic
                    total[:size] += np.bincount(flat, weights=gap[owner], minlength=size)[:size]
                    total[size] += gap.sum()
                    follows = np.ones(len(counts), dtype=bool)
                    follows[(np.cumsum(lengths) - lengths)[lengths > 0]] = False
                    at = np.flatnonzero(follows)
                    seen = np.bincount(2 * tags[at - 1] + tags[at], minlength=4)
                    total[size + 1:] += seen - both.sum(axis=0).ravel()
            yield batch_of(pa.schema([("part", pa.binary())]), [total.tobytes()])

        parts = numbers.mapInArrow(run, "part binary").collect()  # one row for each part of the sample
        return sum((np.frombuffer(p["part"]) for p in parts), np.zeros(size + 5))

    theta, pairs = np.zeros(size + 1), np.zeros((2, 2))
    theta[-1] = -6.0
    theta[:size] = [2.0 if f in marking else 0.0 for f in vocabulary]
    seen = np.full(size + 5, 1.0)
    for _ in range(ROUNDS if size else 0):
        gradient = gradient_of(theta, pairs)
        gradient[:size] -= 0.1 * theta[:size]
        seen += gradient ** 2
        step = gradient / np.sqrt(seen)
        theta = theta + np.r_[step[:size], 0.5 * step[size]]
        pairs = np.clip(pairs + 0.3 * step[size + 1:].reshape(2, 2), -3, 3)
        pairs -= pairs[0, 0]
        if np.abs(step).max() <= SETTLED:
            break
    field = Field({f: float(w) for f, w in zip(vocabulary, theta) if abs(w) > 1e-3}, float(theta[-1]), pairs, ([0.0, 1.0], [0.0, 1.0]))
    raw = tag(sample, field, ("y",)).select("score", "y")
    curve = isotonic(raw)
    return Field(field.weights, field.bias, field.pairs, curve if size else ([0.0, 1.0], [0.0, 1.0]))


def tag(docs: DataFrame, field: Field, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with score and spans: [start, end) in characters, and the token's marginal.

    Spans are the tokens whose marginal is at least one half, neighbours joined. Nulls and texts without
    tokens have no spans and score lowest; repeated rows score alike. Extra columns are ignored, an empty table
    gives no rows. Texts are read whole.
    """
    kept = docs.select(*keep, F.col("text").alias("__text"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("__text").schema)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for whole in batches:
            for batch in slices(whole, 256):
                texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
                words = [TOKEN.findall(t) for t in texts]
                if len(known) > 500_000:
                    known.clear()
                for w in set().union(*words).difference(known):
                    known[w] = field.emission(w)
                lengths = np.array([len(w) for w in words])
                emissions = np.fromiter((known[w] for ws in words for w in ws), dtype=np.float64, count=int(lengths.sum()))
                toxic, both = marginals(emissions, lengths, field.pairs) if len(emissions) else (emissions, np.zeros((0, 2, 2)))
                scores = calibrated(any_toxic(toxic, both, lengths), field.curve)
                first = np.cumsum(lengths) - lengths
                spans: list[list[dict]] = [[] for _ in texts]
                hits = np.flatnonzero(toxic >= TAGGED)
                for k in np.unique(np.searchsorted(first, hits, side="right") - 1).tolist() if len(hits) else []:
                    while not lengths[k]:
                        k -= 1
                    spans[k] = _spans(texts[k], toxic[first[k]:first[k] + lengths[k]])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(scores), pa.array(spans, pa.list_(span))],
                    names=[*batch.schema.names[:-1], "score", "spans"])

    return kept.mapInArrow(run, ddl + ", score double, spans array<struct<start:int,end:int,marginal:double>>")


def _spans(text: str, toxic: np.ndarray) -> list[dict]:
    out: list[dict] = []
    before = -2
    for i, match in enumerate(TOKEN.finditer(text)):
        if toxic[i] >= TAGGED:
            if before == i - 1:
                out[-1]["end"], out[-1]["marginal"] = match.end(), max(out[-1]["marginal"], float(toxic[i]))
            else:
                out.append({"start": match.start(), "end": match.end(), "marginal": float(toxic[i])})
            before = i
    return out


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for each row of ``docs``."""
    return tag(docs, fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
