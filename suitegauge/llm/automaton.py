"""LM scoring with a weighted backoff automaton.

States are contexts: a word, the boundary of texts, and the empty one. A word pair seen in training is an arc of its first
word's state, weighted with the smoothed probability of the second; every state has a failure arc to the empty context with
the share it leaves to unseen words, and the empty context has an arc for any word. Reading a text from left to right
follows an arc, or fails once and then follows one, and adds up the logarithms. As the state is the word read last, a block's
steps are known beforehand and are taken as arrays.

The automaton of a whole corpus fits no machine. Texts are dealt into blocks, each with its own numbers for words and word pairs. The
blocks send hashes of both with their counts, and get totals back where these differ from their own: so each block has
the part of the automaton that its texts can reach.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suitegauge.llm.common import batch_of, byte_slices, sorted_groups, staged

#: Fixed value: ASCII capitals to small letters, all other bytes as they are.
FOLDED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Rounds in which word pairs are counted, by their first word, so that the files of one round are a share of all.
ROUNDS = 4
#: Rounds in which blocks get their totals and are read, for the same reason.
WALKS = 2
#: What is added to a word's count, and the weight of the word's own probability against the counts after a context.
ADDED, PRIOR = 0.1, 20.0

_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.binary()), ("ends", pa.binary()),
                     ("ids", pa.binary()), ("keys", pa.binary()), ("tags", pa.binary()), ("rounds", pa.binary())])
_BLOCKS_SQL = "block bigint, doc_ids array<bigint>, held binary, ends binary, ids binary, keys binary, tags binary, rounds binary"
_GRAMS = pa.schema([("key", pa.int64()), ("tag", pa.int32()), ("block", pa.int64()), ("idx", pa.int32()), ("n", pa.int64())])
_GRAMS_SQL = "key bigint, tag int, block bigint, idx int, n bigint"
_TOTALS = pa.schema([("block", pa.int64()), ("round", pa.int32()), ("idx", pa.binary()), ("n", pa.binary()),
                     ("kinds", pa.int64()), ("tokens", pa.int64())])
_TOTALS_SQL = "block bigint, round int, idx binary, n binary, kinds bigint, tokens bigint"
#: Totals that a task holds before it sends them, packed by block.
HELD = 2_000_000
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])
_SCORES_SQL = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts, each closed by the boundary 0, where each text ends, and the words by number.

    Texts are UTF-8. In bytes, letters fold by one table, and what splits words is just what ``split`` takes for white space.
    """
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    boundary = numbers[b" "]
    ids, ends = array("I"), array("q")
    for text in texts:
        ids.extend(map(numbers.__getitem__, text.translate(FOLDED).split()))
        ids.append(boundary)
        ends.append(len(ids))
    return np.frombuffer(ids, dtype=np.uint32), np.frombuffer(ends, dtype=np.int64), list(numbers)


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    from xxhash import xxh3_128_digest

    # A partition's number is the same whenever its task is run again.
    block = TaskContext.get().partitionId() << 32
    for whole in batches:
        for batch in byte_slices(whole, 2, BLOCK_BYTES):
            ids, ends, words = numbered(batch.column(2).cast(pa.binary()).to_pylist())
            prints = np.frombuffer(b"".join(map(xxh3_128_digest, words)), dtype=np.dtype([("key", "<u8"), ("tag", "<u4"), ("", "<u4")]))
            held = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip((
                block, batch.column(0).to_pylist(), held.tobytes(), ends.tobytes(),
                (ids.astype("<u2") if len(words) <= 1 << 16 else ids).tobytes(), prints["key"].tobytes(), prints["tag"].tobytes(),
                (prints["key"] % np.uint64(ROUNDS) + np.uint64(1)).astype(np.uint8).tobytes()), _BLOCKS)],
                schema=_BLOCKS)
            block += 1


class Block:
    """A block's texts as word numbers, and its words' hashes where they are read."""

    def __init__(self, row: dict):
        self.ends = np.frombuffer(row["ends"], dtype=np.int64)
        self.held = np.frombuffer(row["held"], dtype=bool)
        wide = len(row["ids"]) == 4 * self.ends[-1]
        self.ids = np.frombuffer(row["ids"], dtype="<u4" if wide else "<u2").astype(np.int64)
        self.starts = np.r_[0, self.ends[:-1]]
        self.taught = np.repeat(~self.held, self.ends - self.starts)
        self.before = np.r_[0, self.ids[:-1]]
        #: In which round the pairs that a word begins are counted.
        self.rounds = np.frombuffer(row["rounds"], dtype=np.uint8)
        self.width = len(self.rounds)

    def pairs(self, of: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Distinct word pairs, ascending, as first * width + second, and how often each is in training texts."""
        code = self.before[of] * self.width + self.ids[of]
        order = np.argsort(code)
        return self._counted(code[order], self.taught[of][order])

    def placed_pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All distinct pairs with their counts, and for each token the place of the pair that it ends."""
        code = self.before * self.width + self.ids
        order = np.argsort(code)
        code, at = code[order], np.empty(len(order), dtype=np.int64)
        at[order] = np.cumsum(np.r_[False, code[1:] != code[:-1]])
        return *self._counted(code, self.taught[order]), at

    @staticmethod
    def _counted(code: np.ndarray, taught: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, dtype=np.int64)
        return code[first], np.add.reduceat(taught, first, dtype=np.int64) if len(first) else first


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _grams(round_no: int) -> Callable:
    """Words (round 0), or the pairs whose first word falls to a round: hash, place in the block and count of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                block, keys, tags = Block(row), np.frombuffer(row["keys"], dtype="<u8"), np.frombuffer(row["tags"], dtype="<u4")
                if round_no == 0:
                    n = np.bincount(block.ids[block.taught], minlength=len(keys))
                else:
                    code, n = block.pairs(block.rounds[block.before] == round_no)
                    first, second = np.divmod(code, block.width)
                    both = tags[first].astype(np.uint64) << np.uint64(32) | tags[second]
                    keys, tags = _mixed(keys[first] * np.uint64(0x9E3779B97F4A7C15) + keys[second]), _mixed(both).astype(np.uint32)
                for a in range(0, len(keys), 100_000):
                    b = min(a + 100_000, len(keys))
                    yield batch_of(_GRAMS, keys[a:b].view(np.int64), tags[a:b].view(np.int32), np.full(b - a, row["block"]),
                                   np.arange(a, b, dtype=np.int32), n[a:b])

    return run


def _packed(round_no: int, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """One row for each block, with places ascending."""
    block, idx, n = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((idx, block))
    block, idx, n = block[order], idx[order], n[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    cuts = list(zip(first.tolist(), np.append(first[1:], len(block)).tolist()))
    for at in range(0, len(cuts), 1000):
        part = cuts[at:at + 1000]
        yield batch_of(_TOTALS, [int(block[a]) for a, _ in part], [round_no] * len(part),
                       [idx[a:b].astype("<i4").tobytes() for a, b in part], [n[a:b].astype("<i8").tobytes() for a, b in part],
                       [0] * len(part), [0] * len(part))


def _totals(round_no: int) -> Callable:
    """Totals of equal hashes for each block whose own count is another, and the numbers of words seen in training and of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = tokens = size = 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in sorted_groups(batches, "key"):
            key, tag, block, idx, n = (batch.column(c).to_numpy() for c in ("key", "tag", "block", "idx", "n"))
            if ((key[1:] == key[:-1]) & (tag[1:] != tag[:-1])).any():
                order = np.lexsort((tag, key))
                key, tag, block, idx, n = (c[order] for c in (key, tag, block, idx, n))
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])])
            sums = np.add.reduceat(n, first)
            if round_no == 0:
                kinds, tokens = kinds + int((sums > 0).sum()), tokens + int(sums.sum())
            total = np.repeat(sums, np.diff(np.append(first, len(n))))
            told = total != n
            if told.any():
                held.append((block[told], idx[told], total[told]))
                size += int(told.sum())
            if size > HELD:
                yield from _packed(round_no, held)
                held, size = [], 0
        if held:
            yield from _packed(round_no, held)
        if kinds:
            yield batch_of(_TOTALS, [None], [round_no], [None], [None], [kinds], [tokens])

    return run


class Automaton:
    """States are word numbers (0: the boundary); ``arcs`` has the weight of each of ``codes``, ``failure`` of a state, ``root`` of a word.

    A pair that training has not seen is no arc: its state fails, and the empty context's arc is taken.
    """

    def __init__(self, width: int, codes: np.ndarray, pair_counts: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, prior: float):
        share = (counts + ADDED) / (tokens + ADDED * (kinds + 1))
        self.width, self.codes, self.seen = width, codes, pair_counts > 0
        first, second = np.divmod(codes, width)
        # All that follows a word in training is one of the pairs that begin with it, so its count is their sum.
        self.arcs = np.log10((pair_counts + prior * share[second]) / (counts[first] + prior))
        self.root = np.log10(share)
        # By state: failing, then the empty context's arc of a word.
        self.failure = np.log10(prior / (counts + prior))

    def steps(self, before: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log-probability of each step. The state is the word before; ``places`` says where in ``codes`` the pair is, below 0 where it is not."""
        arc = (places >= 0) & self.seen[places]
        return np.where(arc, self.arcs[places], self.failure[before] + self.root[ids])

    def log10(self, ids: list[int]) -> float:
        """Log-probability of a text closed by the boundary, read from the boundary on."""
        words = np.array(ids, dtype=np.int64)
        before = np.r_[0, words[:-1]]
        code = before * self.width + words
        places = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return float(self.steps(before, words, np.where(self.codes[places] == code, places, -1)).sum())


def _walked(tokens: int, kinds: int, prior: float) -> Callable:
    """Scores of a block's texts from the block and the totals told to it."""

    def run(blocks: pa.Table, totals: pa.Table) -> pa.Table:
        row = {name: blocks.column(name)[0].as_py() for name in blocks.schema.names}
        block = Block(row)
        counts = np.bincount(block.ids[block.taught], minlength=block.width)
        codes, pair_counts, at = block.placed_pairs()
        round_of = block.rounds[codes // block.width]
        # Places are those of a round's own list, which is in the order of all pairs.
        places = [np.flatnonzero(round_of == round_no) for round_no in range(1, ROUNDS + 1)]
        for told in totals.to_pylist():
            idx, n = np.frombuffer(told["idx"], dtype="<i4"), np.frombuffer(told["n"], dtype="<i8")
            if told["round"] == 0:
                counts[idx] = n
            else:
                pair_counts[places[told["round"] - 1][idx]] = n
        automaton = Automaton(block.width, codes, pair_counts, counts, tokens, kinds, prior)
        scores = np.add.reduceat(automaton.steps(block.before, block.ids, at), block.starts)
        return pa.Table.from_batches([batch_of(
            _SCORES, row["doc_ids"], block.held, block.ends - block.starts,
            np.add.reduceat(counts[block.ids] > 0, block.starts, dtype=np.int64),
            np.add.reduceat(automaton.root[block.ids], block.starts), scores)])

    return run


def scored(docs: DataFrame, prior: float = PRIOR, every: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    Rows whose crc32 of the id as text is divisible by ``every`` are held out and never counted. Tokens are the words
    and one end; ``base_score`` is the sum of log10 of their smoothed shares, ``score`` the automaton's log10 probability.

    Null texts count as empty: they have the end alone. A null id counts as the empty text, so such rows are held out. Repeated rows
    count again. Without training rows every token has the same share and scores are base scores. Other columns
    are ignored; an empty table gives no rows. Word pairs are told apart by hashes of 96 bits.
    """
    texts = docs.select(F.col("doc_id"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % every == 0).alias("held"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    blocks = staged(texts.mapInArrow(_blocked, _BLOCKS_SQL), "text-blocks")
    told = []
    for round_no in range(ROUNDS + 1):
        grams = blocks.select("block", "held", "ends", "ids", "keys", "tags", "rounds").mapInArrow(_grams(round_no), _GRAMS_SQL)
        told.append(staged(grams.repartition("key").sortWithinPartitions("key").mapInArrow(_totals(round_no), _TOTALS_SQL), "gram-totals"))
    size = told[0].agg(F.sum("kinds"), F.sum("tokens")).first()
    kinds, tokens = size[0] or 0, size[1] or 0
    totals = told[0]
    for more in told[1:]:
        totals = totals.unionByName(more)
    totals, walked = totals.where("block is not null").drop("kinds", "tokens"), None
    for walk in range(WALKS):
        own = F.pmod(F.xxhash64("block"), F.lit(WALKS)) == walk
        read = staged(blocks.where(own).select("block", "doc_ids", "held", "ends", "ids", "rounds").groupBy("block").cogroup(
            totals.where(own).groupBy("block")).applyInArrow(_walked(tokens, kinds, prior), _SCORES_SQL), "scores")
        walked = read if walked is None else walked.unionByName(read)
    return walked.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
