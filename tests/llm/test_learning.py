"""Classifiers on held-out rows and odd rows, exact marginals, neighbours against brute force, and the pipeline."""

from __future__ import annotations

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from suitegauge.llm import learning, mixing, neighbours, quality, queries, toxicity
from suitegauge.llm.common import documents, labels

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "idiot " * 20_000), (4, "idiot"), (None, "text"), (None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(0).alias(c) for c in ("score", "y", "spans", "toxic", "stats")])


def accuracy(frame, column):
    known = duckdb.sql(f"select doc_id, {column} y from '{FOLDER}/labels.parquet'").df()
    rows = frame.toPandas().merge(known, on="doc_id")
    held = rows[rows.held_out]
    ranks = held.score.rank().to_numpy()
    ones = (held.y == 1).to_numpy()
    area = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert rows.score.between(0, 1).all()
    return (held.predicted == held.y).mean(), area


def test_quality_on_held_out_rows(spark):
    right, area = accuracy(queries.QUERIES["op2_quality"](spark, FOLDER), "quality")
    assert right > 0.93 and area > 0.95


def test_toxicity_on_held_out_rows(spark):
    found = queries.QUERIES["op1_toxicity"](spark, FOLDER)
    right, area = accuracy(found, "toxic")
    assert right > 0.9 and area > 0.8
    for row in found.where("size(spans) > 0").join(documents(spark, FOLDER), "doc_id").limit(20).collect():
        assert all(0 <= s["start"] < s["end"] <= len(row.text) and row.text[s["start"]].isalnum() for s in row.spans)


@pytest.mark.parametrize("known", [True, False])
def test_classifiers_odd_rows(spark, odd, known):
    marked = labels(spark, FOLDER) if known else labels(spark, FOLDER).limit(0)
    taught = documents(spark, FOLDER) if known else odd.select("doc_id", "text")
    model = quality.fit(taught, marked, most=300)
    field = toxicity.fit(taught, marked, most=300)
    for frame in (quality.classify(odd, model), toxicity.tag(odd, field)):
        rows = frame.collect()
        assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.classify(odd.limit(0), model).count() == 0 and toxicity.tag(odd.limit(0), field).count() == 0
    assert quality.good_documents(odd, model).columns == odd.columns


def test_sample_leaves_out_held_out_rows_and_near_copies(spark):
    text = " ".join(map(str, range(400)))
    docs = spark.createDataFrame([(i, text + f" {i}") for i in range(60)] + [(60 + i, f"own words {i} of text {i * 7}") for i in range(60)], "doc_id bigint, text string")
    marked = docs.select("doc_id", F.lit(1).alias("quality"))
    ids = [r.doc_id for r in learning.labelled_sample(docs, marked, "quality", 1000).collect()]
    assert 1 <= sum(i < 60 for i in ids) <= 3 and sum(i >= 60 for i in ids) > 30
    import zlib
    assert all(zlib.crc32(str(i).encode()) % 5 for i in ids)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 1, 5, 2, 200, 4, 0])
    emissions, pairs = rng.normal(0, 2, lengths.sum()), rng.normal(0, 1, (2, 2))
    toxic, both = toxicity.marginals(emissions, lengths, pairs)
    at = 0
    for n in lengths.tolist():
        if 0 < n <= 5:
            total, single, double = 0.0, np.zeros(n), np.zeros((n, 2, 2))
            for tags in itertools.product((0, 1), repeat=n):
                weight = np.exp(sum(e * y for e, y in zip(emissions[at:at + n], tags)) + sum(pairs[a, b] for a, b in zip(tags, tags[1:])))
                total, single = total + weight, single + weight * np.array(tags)
                for i in range(1, n):
                    double[i, tags[i - 1], tags[i]] += weight
            assert np.allclose(single / total, toxic[at:at + n]) and np.allclose(double / total, both[at:at + n])
        at += n


def test_any_toxic_equals_enumeration():
    rng = np.random.default_rng(4)
    lengths, pairs = np.array([0, 1, 6, 3, 0, 5]), np.array([[0.0, -2.0], [-1.5, 2.5]])
    emissions = rng.normal(-1, 2, lengths.sum())
    found = toxicity.any_toxic(*toxicity.marginals(emissions, lengths, pairs), lengths)
    at = 0
    for n, chance in zip(lengths.tolist(), found):
        weights = {tags: np.exp(sum(e * y for e, y in zip(emissions[at:at + n], tags)) + sum(pairs[a, b] for a, b in zip(tags, tags[1:])))
                   for tags in itertools.product((0, 1), repeat=n)}
        assert abs(chance - (1 - weights[(0,) * n] / sum(weights.values()))) < 1e-9
        at += n


def test_isotonic_rises(spark):
    rng = np.random.default_rng(1)
    rows = [(float(s), int(rng.random() < s)) for s in rng.random(500)]
    xs, ys = learning.isotonic(spark.createDataFrame(rows, "score double, y int"))
    assert xs == sorted(xs) and ys == sorted(ys) and abs(np.interp(0.8, xs, ys) - 0.8) < 0.2


def test_neighbours_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [centres[k % 30] + rng.normal(0, 0.04, 16) for k in range(90)]
    rows += [centres[0] + rng.normal(0, 0.05, 16) for _ in range(80)] + list(rng.normal(size=(100, 16)))
    rows += [rows[0].copy() for _ in range(5)]
    vectors = [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(rows)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [None] + [1.0] * 15),
           (None, [1.0] * 16), (3, vectors[3][1]), (906, [1.0] * 4), (907, [1.0] * 4)]
    frame = spark.createDataFrame(vectors + odd, "vec_id bigint, embedding array<float>").select("*", F.lit("x").alias("node"), F.lit(1).alias("kept"))
    units = np.array([v for _, v in vectors])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    near = units @ units.T >= 0.95
    least = brute.least_reachable(list(range(len(units))), [(a, b) for a, b in zip(*np.nonzero(near)) if a < b])
    found = neighbours.near_duplicates(frame).collect()
    assert len(found) == len(vectors) + len(odd)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert [by_id[k] for k in range(len(units))] == [(int(near[k].sum()) - 1, least[k], least[k] == k) for k in range(len(units))]
    assert all(by_id[k] == (0, k, True) for k in range(900, 906)) and by_id[None] == (0, None, True)
    assert by_id[906] == (1, 906, True) and by_id[907] == (1, 906, False)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0


def test_lost_pairs_beside_a_large_group_are_told(spark, monkeypatch):
    rng = np.random.default_rng(7)
    hot, lone = rng.normal(size=16), rng.normal(size=(60, 16))
    rows = [hot + rng.normal(0, 0.02, 16) for _ in range(120)] + [x + rng.normal(0, 0.02, 16) for x in lone for _ in range(2)]
    frame = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(rows)], "vec_id bigint, embedding array<float>")
    whole = neighbours._descend
    monkeypatch.setattr(neighbours, "_descend", lambda *a: whole(*a).where("u < 120 and v < 120"))
    monkeypatch.setattr(neighbours, "TRIES", 1)
    with pytest.raises(RuntimeError, match="recall"):
        neighbours.near_duplicates(frame)


def test_tables_and_parts_leave_no_pair_to_chance(spark, monkeypatch):
    for count in (2, 10_000, 3_000_000, 10**9):
        bits, number = neighbours.tables(count, 0.95)
        assert (1 - (1 - np.arccos(0.95) / np.pi) ** bits) ** number <= neighbours.MISSED
    monkeypatch.setattr(neighbours, "BLOCK", 8)
    rng = np.random.default_rng(8)
    rows = [x + rng.normal(0, 0.02, 16) for x in rng.normal(size=(50, 16)) for _ in range(2)]
    nodes = spark.createDataFrame([(k, bytearray(np.array(x, dtype=np.float32).tobytes())) for k, x in enumerate(rows)], "node bigint, raw binary")
    met = {(min(r.u, r.v), max(r.u, r.v)) for r in neighbours._start(nodes, np.float32, 100, 0.95, 0).where("cos >= 0.95").collect()}
    assert {(k, k + 1) for k in range(0, 100, 2)} <= met


def test_stages_keep_columns_and_rows(spark):
    docs = documents(spark, FOLDER)
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        if name in ("pii_surrogates", "source_mixing"):
            assert out.count() == n


def test_pipeline_loses_no_clean_document(spark):
    found = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).where("decoded").select("doc_id").collect()}
    good = {r.doc_id for r in labels(spark, FOLDER).where("quality = 1").collect()}
    groups = queries.QUERIES["op10_simhash_dedup"](spark, FOLDER).toPandas().set_index("doc_id").component_id
    alone = {i for i in good if groups[i] == i}
    assert len(found & alone) > 0.97 * len(alone) and not {i for i in found if groups[i] in found and groups[i] < i}


def test_ids_come_in_the_mixs_order_from_several_files(spark, tmp_path, monkeypatch):
    texts = [(k, f"text {k} " + "word " * (k % 7 * 200), "en", "ab"[k % 3 == 0], 0) for k in range(400)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = [r.doc_id for r in mixing.mixed(docs).orderBy("position").select("doc_id").collect()]
    docs.repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [s for s in corpus_pipeline.STAGES if s[0] in ("source_mixing", "sentence_pieces")])
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in found] == want and [r.position for r in found] == list(range(400))


def test_written_order_is_that_of_the_files(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(5000).repartition(6).orderBy(F.desc("id")).write.option("maxRecordsPerFile", 300).parquet(path)
    found = mixing.written_order(spark.read.parquet(path)).collect()
    assert {r.position: r.id for r in found} == {k: 4999 - k for k in range(5000)}
    assert mixing.written_order(spark.read.parquet(path).where("id < 0")).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{k % 977}x{k % 31}" for k in range(20_000))
    words = " ".join(f"y{k}" for k in range(50))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, words, "en", "a"), (None, words, "en", "b"), (None, words, None, None), (4, long, "en", "b"), (4, long, "en", "b"),
            (None, " ".join(reversed(long.split())), "de", None), (5, "日本 語　é\x00 \n\n end ", "ja", "a")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clashing = docs.select("*", *[F.lit("kept").alias(c) for c in ("position", "score", "slot", "fp", "content", "share", "row", "ids")])
    for name, table in (("odd", docs), ("empty", docs.limit(0))):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    # Without labels nothing is rejected; empty texts are one group, repeated rows one row.
    assert sorted((r.doc_id for r in found), key=str) == sorted([1, 3, 4, None, 5], key=str) and all(r.decoded for r in found)
    assert [r.position for r in found] == list(range(5))
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, clashing, f"{tmp_path}/odd")
        assert out.count() == (5 if name == "simhash_dedup" else len(rows)), name
        assert name == "sentence_pieces" or out.columns == clashing.columns
