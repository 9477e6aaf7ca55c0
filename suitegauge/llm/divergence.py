"""Source divergence audit: how far each source's use of terms is from other sources of its language.

Terms are counted by length-bucketed packing. In UTF-8 a term of up to 8 bytes is one unsigned 64-bit word, one of
up to 16 is two; such terms are radix-sorted as numbers and counted by runs. Longer terms go to buckets of like
length, sorted as bytes. Spark adds the counts up, keeps the common terms and compares the sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from suitegauge.llm.common import batch_of, byte_slices, staged

#: Bytes of terms (ASCII letters and all of other scripts), and what each byte counts as.
INSIDE = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
FOLDED = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
#: Bytes of a word, and the longest term that is packed into words.
WORD_BYTES, PACKED = 8, 16
#: Sources of a language that one task compares at a time; more are compared tile by tile.
TILE = 256
#: Tile sums that a task holds before it sends them on.
HELD = 64
ONE = 1_000_000_000

COUNTS = "lang string, source string, hi bigint, lo bigint, rest binary, n bigint, docs bigint"
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("hi", pa.int64()), ("lo", pa.int64()),
                     ("rest", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def radix_order(*words: np.ndarray) -> np.ndarray:
    """The stable order of rows by unsigned words, the first weighing most: a pass for each 16 bits that differ."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        digits = np.ascontiguousarray(word, dtype="<u8").view("<u2").reshape(-1, 4)
        for place in range(4):
            digit = digits[:, place]
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes of all texts, padded, and start, length and row of each term. Runs of bytes never cross texts."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    size = int(ends[-1] - ends[0])
    data = np.zeros(size + PACKED, dtype=np.uint8)
    if size:
        data[:size] = FOLDED[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]]
    ends -= ends[0]
    # One place more than bytes, so that a change is seen at the very end, too.
    inside = np.zeros(size + 2, dtype=bool)
    inside[1:-1] = INSIDE[data[:size]]
    cut = np.zeros(size + 1, dtype=bool)
    cut[ends] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    stops = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return data, starts, stops - starts, np.searchsorted(ends, starts, side="right") - 1


def _word(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first ``size`` bytes (1 to 8) from ``at`` as an unsigned word that sorts as the bytes do."""
    eight = np.lib.stride_tricks.sliding_window_view(data, WORD_BYTES)[at].view(">u8").reshape(-1).astype(np.uint64)
    return eight & (np.uint64(0xFFFFFFFFFFFFFFFF) << (np.uint64(64) - np.uint64(8) * size.astype(np.uint64)))


def _runs(keys: list[np.ndarray], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: where each run starts, how many it has, and from how many rows (which ascend within a run)."""
    new = np.zeros(len(rows), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    fresh = new.copy()
    fresh[1:] |= rows[1:] != rows[:-1]
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(rows))), np.add.reduceat(fresh, starts, dtype=np.int64) if len(rows) else starts


def packed_counts(texts: pa.Array, group: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, hi, lo, rest, n, docs) arrays, one set for each bucket of lengths, each term of a group once."""
    data, starts, lengths, rows = terms(texts)
    for least, most in ((1, WORD_BYTES), (WORD_BYTES + 1, PACKED)):
        own = (lengths >= least) & (lengths <= most)
        at, size, row = starts[own], lengths[own], rows[own]
        words = [_word(data, at, np.minimum(size, WORD_BYTES))]
        if most > WORD_BYTES:
            words.append(_word(data, at + WORD_BYTES, size - WORD_BYTES))
        # Rows ascend, and the order is stable, so within a run they still do.
        order = radix_order(group[row].astype(np.uint64), *words)
        words, row = [w[order] for w in words], row[order]
        first, n, docs = _runs([group[row], *words], row)
        lo = words[1][first] if len(words) > 1 else np.zeros(len(first), dtype=np.uint64)
        yield group[row][first], words[0][first], lo, np.full(len(first), b"", dtype=object), n, docs
    width = 2 * PACKED
    while (lengths > width // 2).any():
        own = (lengths > width // 2) & (lengths <= width)
        at, size, row = starts[own], lengths[own], rows[own]
        if len(at):
            wide = np.lib.stride_tricks.sliding_window_view(np.pad(data, (0, width)), width)[at]
            wide[np.arange(width) >= size[:, None]] = 0
            whole = wide.view(f"S{width}").reshape(-1)
            order = np.argsort(whole, kind="stable")
            order = order[radix_order(group[row[order]].astype(np.uint64))]
            whole, row = whole[order], row[order]
            first, n, docs = _runs([group[row], whole], row)
            bytes_of = whole[first].tolist()
            heads = np.frombuffer(b"".join(b[:PACKED] for b in bytes_of), dtype=">u8").reshape(-1, 2).astype(np.uint64)
            rest = np.empty(len(first), dtype=object)
            rest[:] = [b[PACKED:] for b in bytes_of]
            yield group[row][first], heads[:, 0], heads[:, 1], rest, n, docs
        width *= 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in byte_slices(whole, 2):
            names = [c.dictionary_encode() for c in batch.columns[:2]]
            sources = len(names[1].dictionary)
            pair = names[0].indices.to_numpy().astype(np.int64) * sources + names[1].indices.to_numpy()
            groups, group = np.unique(pair, return_inverse=True)
            langs = names[0].dictionary.take(pa.array(groups // max(sources, 1)))
            named = names[1].dictionary.take(pa.array(groups % max(sources, 1)))
            # A row without a term marks each group, so that groups without terms are known.
            zeros = np.zeros(len(groups), dtype=np.uint64)
            marks = (np.arange(len(groups)), zeros, zeros, np.full(len(groups), b"", dtype=object), zeros, zeros)
            for g, hi, lo, rest, n, docs in (marks, *packed_counts(batch.column(2), group)):
                yield batch_of(_COUNTS, langs.take(pa.array(g)), named.take(pa.array(g)), hi.view(np.int64), lo.view(np.int64),
                               rest, n.astype(np.int64), docs.astype(np.int64))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, hi, lo, rest, n, docs): occurrences and rows of each term in each group, and one row of no term (hi = 0)."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return texts.mapInArrow(_counted, COUNTS).groupBy("lang", "source", "hi", "lo", "rest").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: str, total: str) -> str:
    """Smoothed share in billionths, rounded down, plus one; decimals hold any count exactly."""
    return (f"1 + (cast({ONE} as decimal(10,0)) * cast({count} + 5 as decimal(20,0))) "
            f"div (cast({total} as decimal(20,0)) + cast(5 * kept as decimal(20,0)))")


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over terms of the distances of all sources of one tile to all of another."""
    schema = pa.schema([("lang", pa.string()), ("i", pa.int32()), ("j", pa.int32()), ("value", pa.int64())])
    held: dict[tuple[str, int, int], np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, a, b), sums in held.items():
            i, j = (x.reshape(-1) for x in np.indices(sums.shape))
            i, j, value = i + a * TILE, j + b * TILE, sums.reshape(-1)
            if a != b:
                i, j, value = np.r_[i, j], np.r_[j, i], np.r_[value, value]
            other = i != j
            yield batch_of(schema, [lang] * int(other.sum()), i[other], j[other], value[other])
        held.clear()

    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        tiles = np.stack([langs.indices.to_numpy(), batch.column("a").to_numpy(), batch.column("b").to_numpy()], axis=1)
        for tile in np.unique(tiles, axis=0):
            own = batch.filter(pa.array((tiles == tile).all(axis=1)))
            left, right = (own.column(c).flatten().to_numpy().reshape(own.num_rows, -1) for c in ("left", "right"))
            key = langs.dictionary[int(tile[0])].as_py(), int(tile[1]), int(tile[2])
            if key not in held:
                if len(held) >= HELD:
                    yield from sent()
                held[key] = np.zeros((left.shape[1], right.shape[1]), dtype=np.int64)
            for i in range(left.shape[1]):
                held[key][i] += np.abs(right - left[:, i:i + 1]).sum(axis=0)
    yield from sent()


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): distances between sources of a language and the terms that mark each.

    A language keeps the terms of at least ``least_docs`` of its rows. Each source, and the language, gives each kept term
    a smoothed share in whole billionths. Part ``pair``: every other source of the language with the summed distance of
    shares over all kept terms (0 where none is kept). Part ``term``: the ``top`` kept terms that occur in the source and have
    a larger share there than in the language, with the difference.

    Null lang, source and text count as empty; a source without any term is a source. A row is a document, so
    repeated rows count again. Ties go to the smaller item by bytes. Other columns are ignored; an empty table gives no rows.
    A source's row of shares is as wide as its language has sources, as the result itself is.
    """
    counts = staged(term_counts(docs), "term-counts")
    bytes_of = "concat(unhex(lpad(hex(hi), 16, '0')), unhex(lpad(hex(lo), 16, '0')), rest)"
    kept = staged(
        counts.where("hi <> 0").groupBy("lang", "hi", "lo", "rest")
        .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source"))
        .where(F.col("docs") >= least_docs)
        .selectExpr("lang", f"rtrim(char(0), decode({bytes_of}, 'UTF-8')) as term", "total", "by_source"), "kept-terms")
    of_source = kept.selectExpr("lang", "inline(by_source)").groupBy("lang", "source").agg(F.sum("n").alias("size"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("size"))
    langs = staged(
        counts.where("hi = 0").select("lang", "source").join(of_source, ["lang", "source"], "left")
        .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", F.coalesce("size", F.lit(0)).alias("size")))).alias("sources"))
        .join(of_lang, "lang", "left").na.fill(0, ["kept", "size"]), "languages")
    terms_of = kept.join(langs, "lang").withColumn("counts", F.map_from_entries("by_source"))

    shares = terms_of.selectExpr("lang", f"transform(sources, s -> {_share('coalesce(counts[s.source], 0)', 's.size')}) as p")
    # A row of zeros for each language: it adds nothing and names all pairs where no term is kept.
    rows = shares.unionByName(langs.selectExpr("lang", "transform(sources, s -> 0L) as p"))
    tiles = rows.selectExpr("lang", "p", f"cast((size(p) - 1) div {TILE} as int) as last").selectExpr(
        "lang", "p", "inline(flatten(transform(sequence(0, last), a -> transform(sequence(a, last), b -> struct(a, b))))) as (a, b)")
    pairs = (
        tiles.selectExpr("lang", "a", "b", f"slice(p, a * {TILE} + 1, {TILE}) as left", f"slice(p, b * {TILE} + 1, {TILE}) as right")
        .mapInArrow(_tile_sums, "lang string, i int, j int, value bigint")
        .groupBy("lang", "i", "j").agg(F.sum("value").alias("value")).join(langs.select("lang", "sources"), "lang")
        .selectExpr("lang", "sources[i].source as source", "'pair' as part", "sources[j].source as item", "value"))

    sized = terms_of.selectExpr("lang", "term", f"{_share('total', 'size')} as q", "kept", "map_from_entries(sources) as sizes",
                                "inline(by_source) as (source, n)")
    marking = sized.selectExpr("lang", "source", "'term' as part", "term as item", f"{_share('n', 'sizes[source]')} - q as value").where("value > 0")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [df.withColumn("rank", F.row_number().over(order)) for df in (pairs, marking)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


#: The audit as SQL that the checking engine reads.
AUDIT_SQL = r"""
    with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row_no,
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
      occurring as (select lang, source, row_no, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
      kept as (select lang, term, count(*) as n from occurring group by all having count(distinct row_no) >= 30),
      counted as (select lang, source, term, count(*) as n from occurring semi join kept using (lang, term) group by all),
      groups as (select g.lang, g.source, coalesce(sum(c.n), 0) as total
        from (select distinct lang, source from d) g left join counted c using (lang, source) group by all),
      langs as (select l.lang, count(k.term) as v, coalesce(sum(k.n), 0) as total
        from (select distinct lang from d) l left join kept k using (lang) group by all),
      shares as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
          1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) as p,
          1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) as q
        from groups g join langs l using (lang) join kept k using (lang) left join counted c using (lang, source, term)),
      apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
        from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
      parts as (
        select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
        from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
        union all
        select lang, source, 'term', term, cast(p - q as bigint) from shares where n > 0 and p > q)
    select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from parts)
    where part = 'pair' or rank <= 50
"""
