"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

Sources are the leaves of a binary tree. At each of its nodes two sides with weights a and b share the node's slots: unit i of a side
with part p of the node is released at slot floor(i / p) and due by ceil((i + 1) / p), and the released unit that is due first goes
first. For two sides that order has a closed form: unit i of the first side stands behind the ceil((i + 1) b / a) - 1 units of
the other that are due before it. So every document's position follows from its number in its source and the path to the root, with no
schedule to walk through and for any number of sources and any weights.

Each node adds less than one unit of deviation to its part of the deviation above. Inner nodes below the root hold at most two thirds of
the node above them, so the sum stays below 1 + 1 + 2/3 + 4/9 + ... = 4 units, which are one block.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from suitegauge.llm.common import staged

#: Documents in a block; units in a block, by the bound above; what a tier's weights add up to.
BLOCK, UNITS, WHOLE = 16, 4, 10**18
#: Documents of one source that one task puts in order, on average.
CELL = 4_000

_PATH = "array<struct<own:bigint,other:bigint,first:boolean>>"


def _shares(counts: DataFrame, weights: dict[str, float] | None, power: float) -> DataFrame:
    """(source, docs, tier, share): whole shares of ``WHOLE``; tier 1 has the sources without a weight, which follow all others."""
    own = F.pow(F.col("docs").cast("double"), F.lit(power))
    given = F.lit(1.0)
    if weights is not None:
        if any(not math.isfinite(w) or w < 0 for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else F.lit(None).cast("map<string,double>")
        given = F.coalesce(F.element_at(table, F.coalesce("source", F.lit(""))), F.lit(0.0))
        own = F.when(given > 0, given).otherwise(own)
    tiers = counts.withColumns({"tier": F.when(given > 0, 0).otherwise(1), "weight": own})
    tiers = tiers.withColumn("sum", F.sum("weight").over(Window.partitionBy("tier")))
    share = F.greatest(F.lit(1), F.round(F.col("weight") / F.col("sum") * F.lit(float(WHOLE)))).cast("long")
    return tiers.select("source", "docs", "tier", share.alias("share"))


def _within_kinds(shares: DataFrame) -> DataFrame:
    """``shares`` with kind (the bit length of the share) and path, from the source to the top of its kind.

    Shares of a kind differ by less than a factor of two. In their order they are halved, the lighter half taking the odd one, until
    one is left.
    """
    shares = shares.withColumn("kind", F.length(F.bin("share")))
    group = Window.partitionBy("tier", "kind")
    ranked = shares.withColumns({"nth": F.row_number().over(group.orderBy("share", "source")) - 1, "members": F.count("*").over(group)})
    nodes = F.expr("""
        aggregate(sequence(1, length(bin(members))), array(named_struct('lo', 0L, 'size', members)), (all, k) -> transform(array(element_at(all, -1)),
            n -> if(n.size = 1, all, concat(all, array(if(nth < n.lo + (n.size + 1) div 2,
                named_struct('lo', n.lo, 'size', (n.size + 1) div 2), named_struct('lo', n.lo + (n.size + 1) div 2, 'size', n.size div 2))))))[0])""")
    placed = staged(ranked.withColumn("nodes", nodes), "mix-shares")
    each = placed.select("source", "tier", "kind", "nth", F.posexplode("nodes").alias("depth", "node")).select("tier", "kind", "nth", "depth", "node.*", "source")
    own = placed.select("tier", "kind", "share", F.explode("nodes").alias("node")).groupBy("tier", "kind", "node.lo", "node.size").agg(F.sum("share").alias("weight"))
    chain = (each.join(own, ["tier", "kind", "lo", "size"]).groupBy("tier", "kind", "nth")
             .agg(F.sort_array(F.collect_list(F.struct("depth", "lo", "weight")), asc=False).alias("chain")))
    path = F.expr(f"""cast(transform(sequence(1, size(chain)), k -> if(k = size(chain), null, named_struct('own', chain[k - 1].weight,
        'other', chain[k].weight - chain[k - 1].weight, 'first', chain[k - 1].lo = chain[k].lo))) as {_PATH})""")
    paths = chain.select("tier", "kind", "nth", F.filter(path, lambda p: p.isNotNull()).alias("inner"))
    return placed.join(paths, ["tier", "kind", "nth"]).select("source", "docs", "tier", "share", "kind", "inner")


def _over_kinds(shares: DataFrame) -> DataFrame:
    """(tier, whole, kind, outer): path from the top of each kind to the root, by joining the two lightest nodes until one is left.

    A share has 1 to 60 bits, so a tier has at most 60 kinds.
    """
    kinds = shares.groupBy("tier", "kind").agg(F.sum("share").alias("weight"))
    leaf = F.struct("weight", F.array(F.struct("kind", F.array().cast(_PATH).alias("path"))).alias("leaves"))
    tops = kinds.groupBy("tier").agg(F.sum("weight").alias("whole"), F.collect_list(leaf).alias("nodes"))
    root = F.expr("""
        aggregate(nodes, nodes, (now, n) -> if(size(now) < 2, now, transform(array(sort_array(now)), s -> concat(
            array(named_struct('weight', s[0].weight + s[1].weight, 'leaves', concat(
                transform(s[0].leaves, l -> named_struct('kind', l.kind, 'path',
                    concat(l.path, array(named_struct('own', s[0].weight, 'other', s[1].weight, 'first', true))))),
                transform(s[1].leaves, l -> named_struct('kind', l.kind, 'path',
                    concat(l.path, array(named_struct('own', s[1].weight, 'other', s[0].weight, 'first', false)))))))),
            slice(s, 3, size(s))))[0]))[0]""")
    return tops.select("tier", "whole", F.explode(root["leaves"]).alias("l")).select("tier", "whole", "l.kind", F.col("l.path").alias("outer"))


def _slot(unit: Column) -> Column:
    """The slot of a source's unit: through each node of ``path``, from the source to the root."""
    def through(at: Column, node: Column) -> Column:
        others = (at + 1).cast("decimal(19,0)") * node["other"].cast("decimal(19,0)")
        # Units of equal deadlines: the first side's goes first.
        before = F.when(node["first"], others - 1).otherwise(others)
        return at + F.call_function("div", before, node["own"].cast("decimal(19,0)"))

    return F.aggregate("path", unit.cast("long"), through)


def lanes(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, unit: int = BLOCK // UNITS) -> DataFrame:
    """(source, docs, tier, share, whole, path, base): a row per source, null included.

    A source's weight is that of ``weights`` where given (a null source's by ''), else its number of documents to the power ``power``; share / whole
    is its part. Sources without a weight, or of weight 0, form tier 1, which begins (``base``, a slot) when tier 0 has ended; by themselves
    they mix by their numbers of documents. Weights are held to 18 digits of their sum.
    """
    counts = staged(docs.groupBy("source").agg(F.count("*").alias("docs")), "sources")
    inner = staged(_within_kinds(_shares(counts, weights, power)), "mix-kinds")
    named = staged(inner.join(_over_kinds(inner), ["tier", "kind"]).select(
        "source", "docs", "tier", "share", "whole", F.concat("inner", "outer").alias("path")), "lanes")
    last = _slot(F.ceil(F.col("docs") / unit) - 1) + 1
    end = named.groupBy((F.col("tier") + 1).alias("tier")).agg(F.max(last).alias("base"))
    return named.join(end, "tier", "left").withColumn("base", F.coalesce("base", F.lit(0).cast("long")))


_ADDED = ("block", "release", "due", "slot", "position")


def _timed(docs: DataFrame, weights: dict[str, float] | None, power: float, block: int) -> DataFrame:
    """The columns of ``docs`` as c0, c1, ..., then what mixing adds."""
    if block < UNITS or block % UNITS:
        raise ValueError(f"a block is a multiple of {UNITS} documents")
    unit = block // UNITS
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    id_name, source, text = (names[c] for c in ("doc_id", "source", "text"))
    kept = docs.toDF(*names.values())
    named = staged(lanes(docs, weights, power, unit), "lane-paths")
    # Of id and text, so that rows without an id, or of one id, part; the text itself need not move.
    order = F.md5(F.concat_ws(":", F.coalesce(F.col(id_name).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))).cast("binary"))
    # As many leading digits as make cells of a bounded size; a cell follows the other in a source's order.
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("lane_docs") / CELL))).cast("int")
    small = named.select(F.col("source").alias("lane_source"), F.col("docs").alias("lane_docs"), "share", "whole", "path", "base")
    placed = (kept.join(small, F.col(source).eqNullSafe(F.col("lane_source")))
              .withColumn("order", order).withColumn("cell", F.substring("order", F.lit(1), digits)))
    sizes = placed.groupBy("lane_source", "cell").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("lane_source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = staged(sizes.select(F.col("lane_source").alias("cell_source"), F.col("cell").alias("nth_cell"), F.coalesce(before, F.lit(0)).alias("before")), "cells")
    within = Window.partitionBy("lane_source", "cell").orderBy("order", id_name, *[c for c in names.values() if c not in (id_name, text, source)])
    index = F.col("before") + F.col("row")
    numbered = (placed.withColumn("row", F.row_number().over(within) - 1)
                .join(cells, F.col("lane_source").eqNullSafe(F.col("cell_source")) & (F.col("cell") == F.col("nth_cell")))
                .withColumn("index", index).withColumn("nth", F.floor(F.col("index") / unit).cast("long")))

    def when(units: Column, up: Column | int) -> Column:
        """The slot by which so many units would have been read at the source's weight."""
        return F.call_function("div", units.cast("decimal(19,0)") * F.col("whole").cast("decimal(19,0)") + up, F.col("share").cast("decimal(19,0)"))

    slot = F.col("base") + _slot(F.col("nth"))
    release = F.col("base") + when(F.greatest(F.col("nth") - (UNITS - 1), F.lit(0)), 0)
    due = F.col("base") + when(F.col("nth") + UNITS, F.col("share") - 1)
    return (numbered.withColumns({"block": F.floor(F.col("index") / block).cast("long"), "release": release, "due": due, "slot": slot})
            .select(*names.values(), *_ADDED[:-1], (F.col("slot") * unit + F.col("index") % unit).alias("position")))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, source, text) with block, release, due, slot and position: the order in which to read them.

    Every row is placed once. Wherever reading stops before a source has run out, each source's documents differ from its part by less
    than ``block`` (a multiple of 4). Slots hold a unit of a quarter block; ``release`` and ``due`` are the slots between which the source's
    weight lets a unit stand. Where a source has run out its slots stay empty. Within a source documents follow in the order of a hash of id and
    text, equal rows side by side. Columns of ``docs`` with an added name give way to it; others are kept. An empty table gives
    no rows. Positions are longs: a source's documents by its part must stay below 2^63.
    """
    kept = [c for c in docs.columns if c not in _ADDED]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    return _timed(docs, weights, power, block).toDF(*kept, *_ADDED)


def in_mixed_order(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block: int = BLOCK) -> DataFrame:
    """``docs``, all columns, sorted by position, so that files written from it hold the mix in order."""
    timed = _timed(docs, weights, power, block).orderBy("position")
    return timed.select(*[f"c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def written_order(docs: DataFrame) -> DataFrame:
    """``docs`` with position: the place of each row in the Parquet files that ``docs`` reads, in the order of their names.

    So a mix that was written in order need not be worked out again. One row per file is counted before.
    A frame that does not read Parquet files has no such order: AnalysisException.
    """
    kept = [c for c in docs.columns if c != "position"]
    placed = docs.select(*[F.col(f"`{c}`") for c in kept], F.col("_metadata.file_path").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    files = placed.groupBy("mix_file").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.orderBy("mix_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(files.select("mix_file", F.coalesce(before, F.lit(0)).alias("start")), "mix-files")
    return placed.join(starts, "mix_file").select(*[F.col(f"`{c}`") for c in kept], (F.col("start") + F.col("mix_row")).alias("position"))
