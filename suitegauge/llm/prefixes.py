"""Document fingerprints by prefix polynomial hashes.

For a text the hashes of all its beginnings are kept, modulo two primes. The difference of two of them,
shifted, is the hash of the span between, so any two spans compare in constant time, and a
longest common extension is found by binary search. A text's fingerprint is its length and whole hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from suitegauge.llm.common import batch_of, slices, staged

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_249, 1_664_525_041)

Hash = tuple[int, int]


class Powers:
    """Powers of the bases, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.known = [np.ones(1, dtype=np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> list[np.ndarray]:
        while len(self.known[0]) <= n:
            for k, (prime, base) in enumerate(zip(PRIMES, BASES)):
                now = self.known[k]
                self.known[k] = np.concatenate([now, now * np.uint64(pow(base, len(now), prime)) % np.uint64(prime)])
        return self.known


POWERS = Powers()


class Prefixes:
    """Hashes of all beginnings of a text, by code points."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.length = len(points)
        powers = POWERS.upto(self.length)
        self.sums = []
        for prime, power in zip(PRIMES, powers):
            terms = points * power[:self.length] % np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms, dtype=np.uint64) % np.uint64(prime)]))

    def at(self, n: int) -> Hash:
        return int(self.sums[0][n]), int(self.sums[1][n])


class Joined:
    """The prefixes of ``left``'s first ``cut`` code points followed by ``right``'s first ``more``, without building them."""

    def __init__(self, left: Prefixes, cut: int, right: Prefixes, more: int):
        self.left, self.cut, self.right, self.length = left, cut, right, cut + more

    def at(self, n: int) -> Hash:
        if n <= self.cut:
            return self.left.at(n)
        head, tail, powers = self.left.at(self.cut), self.right.at(n - self.cut), POWERS.upto(self.cut)
        return tuple((h + t * int(power[self.cut])) % prime for h, t, power, prime in zip(head, tail, powers, PRIMES))


def equal_spans(a, i: int, b, j: int, n: int) -> bool:
    """Whether a[i:i+n] equals b[j:j+n]."""
    powers = POWERS.upto(max(i, j))
    a0, a1, b0, b1 = a.at(i), a.at(i + n), b.at(j), b.at(j + n)
    return all((a1[k] - a0[k]) * int(powers[k][j]) % prime == (b1[k] - b0[k]) * int(powers[k][i]) % prime for k, prime in enumerate(PRIMES))


def _longest(most: int, same: Callable[[int], bool]) -> int:
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if same(middle):
            low = middle
        else:
            high = middle - 1
    return low


def common_extension(a, i: int, b, j: int) -> int:
    """Length of the longest common beginning of a[i:] and b[j:]."""
    return _longest(min(a.length - i, b.length - j), lambda n: equal_spans(a, i, b, j, n))


def common_ending(a, b, most: int) -> int:
    """Length of the longest common ending of a and b, at most ``most``."""
    return _longest(most, lambda n: equal_spans(a, a.length - n, b, b.length - n, n))


def likeness(a, b) -> float:
    """The share of the longer text that common beginning and ending cover; equal texts have 1."""
    most = max(a.length, b.length)
    if not most:
        return 1.0
    begin = common_extension(a, 0, b, 0)
    return (begin + common_ending(a, b, min(a.length, b.length) - begin)) / most


def fingerprint(a) -> str:
    whole = a.at(a.length)
    return f"{a.length:x}-{whole[0]:08x}{whole[1]:08x}"


_RESULT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_RESULT_SQL = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
               "near_edited double, near_next double")


def _compared(doc_id: int | None, text: str, own: Prefixes, following_text: str, following: Prefixes) -> tuple:
    half = own.length // 2
    cut, more = own.length - half, min(half, following.length)
    edited = Joined(own, cut, following, more)
    edited_text = text[:cut] + following_text[:half]
    return (doc_id, own.length, sha256(edited_text.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(edited),
            likeness(own, edited), likeness(own, following))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of ``docs``.

    The next document is the one of the next smaller doc_id, rows of equal id in the order of their texts and those without an
    id last; after the last comes the first, and a lone document is next to itself. Nulls are empty texts: their
    edited text is empty too. Extra columns are ignored, an empty table gives no rows. Texts are sent once, by range; only
    those at the ends of a range are sent again to meet their neighbour in another.
    """
    schema = pa.schema([*_RESULT, ("part", pa.int32()), ("head", pa.bool_()), ("text", pa.string())])
    nothing = (None,) * (len(_RESULT) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        for whole in batches:
            for batch in slices(whole, 256):
                rows = []
                for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                    now = (doc_id, text or "", Prefixes(text or ""))
                    if last is None:
                        rows.append((doc_id, *nothing, part, True, now[1]))
                    else:
                        rows.append((*_compared(*last, *now[1:]), None, None, None))
                    last = now
                yield batch_of(schema, *zip(*rows))
        if last is not None:
            yield batch_of(schema, *zip((last[0], *nothing, part, False, last[1])))

    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ordered = docs.select("doc_id", "text").repartitionByRange(order[0]).sortWithinPartitions(*order)
    found = staged(ordered.mapInArrow(run, f"{_RESULT_SQL}, part int, head boolean, text string"), "prefix-ranges")

    # Two rows for each range: its last document meets the first of the next range, the very last the very first.
    parts = found.where("head").select("part")
    around = Window.orderBy("part")
    following = parts.select("part", F.coalesce(F.lead("part").over(around), F.first("part").over(around)).alias("next_part"))
    heads = found.where("head").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = found.where("not head").select("doc_id", "text", "part").join(following, "part").join(heads, "next_part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 16):
                yield batch_of(pa.schema(_RESULT), *zip(*[_compared(doc_id, text, Prefixes(text), other, Prefixes(other))
                                                          for doc_id, text, other in zip(*(c.to_pylist() for c in batch.columns))]))

    return (found.where("part is null").select(*[n for n, _ in _RESULT])
            .union(ends.select("doc_id", "text", "next_text").mapInArrow(close, _RESULT_SQL)))
