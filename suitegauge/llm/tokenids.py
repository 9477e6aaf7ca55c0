"""Token ids in shards of raw payloads, with a minimal perfect hash index for keyed access.

Shards are ranges of doc_id in ascending order; a shard holds blocks, and a block the raw
little-endian unsigned 32-bit ids of whole documents one after the other. The index is cut
into buckets by key. In each, a minimal perfect hash sends every key to a slot of its own; the
slot holds the key's fingerprint and where its ids lie, so a lookup costs one probe and
unknown keys are told by their fingerprint.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from suitegauge.llm.common import batch_of, byte_slices, slices, staged, worker_cache

#: Ids after which a block is closed; a document is never cut.
BLOCK_IDS = 1 << 18
#: Keys in an index bucket, on average.
BUCKET_KEYS = 8192
#: Units of text whose ids a Python worker remembers.
REMEMBERED = 800_000
#: Bytes of text that are encoded at a time.
SLICE_BYTES = 4 << 20
END = b"\0\0\0\0"


#: White space other than space and line end, as ``str.isspace`` tells it, or a space or line end that is not alone between words.
UNEVEN = (r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
          r"|[ \n][ \n]|\A[ \n]|[ \n]\z")
#: Marks at the end of a unit that are encoded apart from the word before them.
MARKS = ".,;:!?$%&*#"


def even(texts: pa.Array) -> pa.Array:
    """Whether a text is words with single spaces and single line ends between them, and no other white space; not if empty."""
    return pc.and_(pc.not_equal(texts, ""), pc.invert(pc.match_substring_regex(texts, UNEVEN)))


def stem_of(unit: str) -> str:
    """A unit without the marks at its end if a Latin letter stands before them, else the unit."""
    stem = unit.rstrip(MARKS)
    return stem if stem and stem[-1] < "\u0250" and stem[-1].isalpha() else unit


class UnitEncoder:
    """Encodes texts with a byte-level tokenizer, each distinct unit of text once.

    Such a tokenizer splits before white space that follows other characters, so a text whose
    white space is single spaces and single line ends falls into units that are encoded independently:
    words, each with the space or line end before it. Texts with other white space are encoded whole.
    The pattern of byte-level tokenizers also splits between a letter and marks, so a word and the marks that end it are remembered apart.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for piece, i in vocabulary.items() if piece[0] in "ĠĊ"]] = True
        read = json.loads(model)
        splits = read["pre_tokenizer"] or {}
        added = "".join(t["content"] for t in read["added_tokens"])
        self.marked = splits.get("type") == "ByteLevel" and splits.get("use_regex", True) and not set(MARKS) & set(added)
        #: Ids of units met since the last turn, and of those met in the turn before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: Ids of what no white space precedes: first words of texts, and marks.
        self.bare: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, units: list[str]) -> None:
        """Many units are encoded as one text; ids that begin with white space show where each starts."""
        for at in range(0, len(units), 2000):
            part = units[at:at + 2000]
            spelled = [u if u[0] == "\n" else " " + u for u in part]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(spelled)], add_special_tokens=False)[0].ids, dtype="<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(part) and starts[0] == 0:
                raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
                self.known.update(zip(part, (raw[a:b] for a, b in zip((4 * starts).tolist(), ends))))
            else:
                self.known.update(zip(part, self._whole(spelled)))

    def _after_space(self, units: list[str]) -> list[bytes]:
        """Ids of units, each with the space or line end before it."""
        stems = [u if u[-1].isalpha() else stem_of(u) for u in units] if self.marked else units
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        missing = set(stems).difference(self.known)
        again = missing.intersection(self.older)
        self.known.update((u, self.older[u]) for u in again)
        self._learn(list(missing.difference(again)))
        ids = list(map(self.known.__getitem__, stems))
        ended = [i for i, (unit, stem) in enumerate(zip(units, stems)) if len(unit) != len(stem)]
        for i, marks in zip(ended, self._bare([units[i][len(stems[i]):] for i in ended])):
            ids[i] += marks
        return ids

    def _bare(self, texts: list[str]) -> list[bytes]:
        if len(self.bare) > REMEMBERED // 2:
            self.bare.clear()
        new = list(set(texts).difference(self.bare))
        self.bare.update(zip(new, self._whole(new)))
        return [self.bare[t] for t in texts]

    def _by_units(self, texts: pa.Array) -> Iterator[bytes]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        units, starts = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), split.offsets.to_numpy()
        at, heads = coded.indices.to_numpy().copy(), np.zeros(len(coded), dtype=bool)
        heads[starts[:-1]] = True
        inner = np.flatnonzero(np.bincount(at[~heads], minlength=len(units))).tolist()
        first, place = np.unique(at[heads], return_inverse=True)
        ids = [b""] * len(units)
        for i, found in zip(inner, self._after_space([units[i] for i in inner])):
            ids[i] = found
        at[heads] = len(units) + place
        spelled = pa.array(ids + self._bare([units[i] for i in first.tolist()]), pa.large_binary()).take(pa.array(at))
        cuts = np.frombuffer(spelled.buffers()[1], dtype=np.int64)[starts].tolist()
        raw = memoryview(spelled.buffers()[2] or b"")
        return (bytes(raw[a:b]) for a, b in zip(cuts, cuts[1:]))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        plain = even(texts)
        found = self._by_units(texts.filter(plain)) if pc.any(plain).as_py() else iter(())
        others = iter(self._whole(texts.filter(pc.invert(plain)).to_pylist()))
        return [next(found if good else others) for good in plain.to_pylist()]


def unit_encoder(model: str) -> UnitEncoder:
    """The encoder of this worker for a tokenizer given as JSON."""
    made = worker_cache("unit-encoders")
    key = hash(model)
    if key not in made:
        made[key] = UnitEncoder(model)
    return made[key]


@dataclass(frozen=True)
class Shards:
    """Written tables: ``blocks`` (shard, block, payload, entries), ``starts`` (shard, before) and ``index``."""

    blocks: DataFrame
    starts: DataFrame
    index: DataFrame
    buckets: int


_ENTRY = "array<struct<doc_id:bigint,copy:int,at:int,n:int>>"


def write_blocks(docs: DataFrame, model: str) -> DataFrame:
    """(shard, block, before, n_ids, payload, entries) in ascending doc_id order; ``before`` counts the shard's ids before."""
    entry = pa.struct([("doc_id", pa.int64()), ("copy", pa.int32()), ("at", pa.int32()), ("n", pa.int32())])
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                        ("payload", pa.binary()), ("entries", pa.list_(entry))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = unit_encoder(model), TaskContext.get().partitionId()
        block, before, size, payload, entries, last, copy = 0, 0, 0, [], [], (), 0
        for whole in batches:
            for batch in byte_slices(whole, 1, SLICE_BYTES):
                for doc_id, raw in zip(batch.column(0).to_pylist(), encoder.encode(pc.fill_null(batch.column(1), ""))):
                    copy = copy + 1 if (doc_id,) == last else 0
                    last = (doc_id,)
                    n = len(raw) // 4 + 1
                    entries.append({"doc_id": doc_id, "copy": copy, "at": size, "n": n})
                    payload += (raw, END)
                    size += n
                    if size >= BLOCK_IDS:
                        yield batch_of(schema, [shard], [block], [before], [size], [b"".join(payload)], [entries])
                        block, before, size, payload, entries = block + 1, before + size, 0, [], []
        if entries:
            yield batch_of(schema, [shard], [block], [before], [size], [b"".join(payload)], [entries])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return staged(ordered.mapInArrow(run, f"shard int, block int, before bigint, n_ids bigint, payload binary, entries {_ENTRY}"),
                  "token-blocks")


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + _ODD[0]
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def key_hashes(doc_ids: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key: the group's hash, the slot's hash and the 32-bit fingerprint, independent of each other."""
    base = _mixed(doc_ids.astype(np.int64).view(np.uint64)) ^ _mixed(copies.astype(np.int64).view(np.uint64) * _ODD[1])
    return _mixed(base), _mixed(base ^ _ODD[2]), (_mixed(base ^ _ODD[1]) >> np.uint64(32)).astype(np.uint32)


def _slots(slot_hash: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    """A pilot below zero names a slot outright; another one is mixed into the key's hash."""
    mixed = (_mixed(slot_hash ^ _mixed(pilots.astype(np.int64).view(np.uint64))) % np.uint64(n)).astype(np.int64)
    return np.where(pilots < 0, -1 - pilots, mixed)


def build_hash(doc_ids: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of a minimal perfect hash over distinct keys, and the slot of each key.

    Keys fall into groups of three on average. The largest groups first, each group takes the first
    pilot that sends its keys to free slots; lone keys at the end take what slots are left.
    """
    n = len(doc_ids)
    groups = max(1, n // 3)
    group_hash, slot_hash, _ = key_hashes(doc_ids, copies)
    group = (group_hash % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group, minlength=groups)
    ends = np.cumsum(sizes)
    pilots, taken = np.zeros(groups, dtype=np.int32), np.zeros(n, dtype=bool)
    slots = np.zeros(n, dtype=np.int64)
    for g in np.argsort(-sizes, kind="stable").tolist():
        members = order[ends[g] - sizes[g]:ends[g]]
        if len(members) < 2:
            break
        for first in range(0, 1 << 24, 64):
            tries = np.arange(first, first + 64, dtype=np.int64)
            at = (_mixed(slot_hash[members][None, :] ^ _mixed(tries.view(np.uint64))[:, None]) % np.uint64(n)).astype(np.int64)
            ranked = np.sort(at, axis=1)
            good = ~taken[at].any(axis=1) & (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                pilots[g], slots[members], taken[at[k]] = first + k, at[k], True
                break
        else:
            raise ValueError("two keys cannot be told apart")
    lone, free = np.flatnonzero(sizes == 1), np.flatnonzero(~taken)
    pilots[lone] = -1 - free
    slots[order[ends[lone] - 1]] = free
    return pilots, slots


_FIELDS = ("shard", "block", "at", "n")


def write_index(blocks: DataFrame, starts: DataFrame) -> tuple[DataFrame, int]:
    """(bucket, n_keys, pilots, prints, shard, block, at, n, start): a row of raw arrays in slot order for each bucket of keys."""
    entries = (blocks.join(starts, "shard")
               .select("shard", "block", (F.col("starts") + F.col("before")).alias("base"), F.explode("entries").alias("e"))
               .select("shard", "block", "e.*", (F.col("base") + F.col("e.at")).alias("start")))
    buckets = max(1, -(-entries.count() // BUCKET_KEYS))
    rows = entries.select(bucket_of(buckets), "*").groupBy("bucket").agg(
        F.collect_list(F.struct("doc_id", "copy", *_FIELDS, "start")).alias("keys"))
    names = ["pilots", "prints", *_FIELDS, "start"]
    schema = pa.schema([("bucket", pa.int32()), ("n_keys", pa.int32()), *((c, pa.binary()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, 1):
                keys = pa.StructArray.from_arrays(one.column(1).flatten().flatten(), names=["doc_id", "copy", *_FIELDS, "start"])
                ids, copies = _key_arrays(keys.field("doc_id"), keys.field("copy"))
                pilots, slots = build_hash(ids, copies)
                prints = key_hashes(ids, copies)[2]
                columns = [prints, *(keys.field(c).to_numpy(zero_copy_only=False) for c in (*_FIELDS, "start"))]
                stored = []
                for column in columns:
                    placed = np.empty_like(column)
                    placed[slots] = column
                    stored.append([placed.tobytes()])
                yield batch_of(schema, one.column(0).to_pylist(), [len(ids)], [pilots.tobytes()], *stored)

    made = rows.mapInArrow(run, "bucket int, n_keys int, " + ", ".join(f"{c} binary" for c in names))
    return staged(made, "token-index"), buckets


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int").alias("bucket")


def _key_arrays(ids: pa.Array, copies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys without an id count their copies below zero, which no other key does."""
    copy = copies.to_numpy(zero_copy_only=False).astype(np.int64)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), np.where(null, -1 - copy, copy)


def write_shards(docs: DataFrame, model: str) -> Shards:
    """Encodes every whole text (null: empty), appends id 0 and writes payload blocks and index to the shared folder.

    Rows with the same id are copies 0, 1, ... of that key; rows without an id come first and are copies of one key.
    Empty texts hold the end id alone. Extra columns are ignored; an empty table gives empty tables.
    """
    blocks = write_blocks(docs, model)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    # One row for each shard, thus for each task that wrote.
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(sizes.select("shard", F.coalesce(before, F.lit(0)).alias("starts")), "token-starts")
    index, buckets = write_index(blocks, starts)
    return Shards(blocks, starts, index, buckets)


def locate(shards: Shards, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, block, at, n, start) for those of the distinct keys (doc_id, copy) that the index knows."""
    wanted = keys.select(bucket_of(shards.buckets), "doc_id", "copy").groupBy("bucket").agg(
        F.collect_list(F.struct("doc_id", "copy")).alias("keys"))
    fields = [("doc_id", pa.int64()), ("copy", pa.int32()), *((c, pa.int32()) for c in _FIELDS), ("start", pa.int64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, 1):
                row = {c: one.column(i)[0] for i, c in enumerate(one.schema.names)}
                asked = pa.StructArray.from_arrays(row["keys"].values.flatten(), names=["doc_id", "copy"])
                ids, copies = _key_arrays(asked.field("doc_id"), asked.field("copy"))
                n = row["n_keys"].as_py()
                raw = {c: row[c].as_py() for c in ("pilots", "prints", *_FIELDS, "start")}
                pilots = np.frombuffer(raw["pilots"], dtype=np.int32)
                group_hash, slot_hash, prints = key_hashes(ids, copies)
                slots = _slots(slot_hash, pilots[(group_hash % np.uint64(len(pilots))).astype(np.int64)], n)
                slots = np.minimum(slots, n - 1)
                known = np.frombuffer(raw["prints"], dtype=np.uint32)[slots] == prints
                places = [np.frombuffer(raw[c], dtype=np.int32)[slots][known] for c in _FIELDS]
                yield pa.RecordBatch.from_arrays(
                    [asked.field("doc_id").filter(pa.array(known)), asked.field("copy").filter(pa.array(known)),
                     *map(pa.array, places), pa.array(np.frombuffer(raw["start"], dtype=np.int64)[slots][known])], schema=schema)

    joined = wanted.join(shards.index, "bucket").select("bucket", "keys", "n_keys", "pilots", "prints", *_FIELDS, "start")
    return joined.mapInArrow(run, "doc_id bigint, copy int, shard int, block int, at int, n int, start bigint")


def fetch(shards: Shards, keys: DataFrame) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids_crc32) read from the payload of each key that the index knows."""
    wanted = locate(shards, keys).groupBy("shard", "block").agg(
        F.collect_list(F.struct("doc_id", "copy", "at", "n", "start")).alias("asked"))
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in slices(batch, 1):
                payload = memoryview(one.column(0)[0].as_buffer())
                asked = one.column(1)[0].as_py()
                yield batch_of(schema, *zip(*[(a["doc_id"], a["copy"], a["start"], a["n"],
                                               zlib.crc32(payload[4 * a["at"]:4 * (a["at"] + a["n"])])) for a in asked]))

    return (shards.blocks.select("shard", "block", "payload").join(wanted, ["shard", "block"]).select("payload", "asked")
            .mapInArrow(run, "doc_id bigint, copy int, start bigint, n_tokens bigint, ids_crc32 bigint"))


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, copy): the keys under which the rows of ``docs`` are written."""
    counted = docs.groupBy("doc_id").count()
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("copy"))


def read_ids(payload: bytes, at: int, n: int) -> Iterable[int]:
    return np.frombuffer(payload, dtype="<u4", count=n, offset=4 * at)
