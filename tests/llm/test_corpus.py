"""Operators on whole corpora (spelling variants, LM scores, source divergence) against plain versions, and odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from suitegauge.llm import automaton, divergence, queries, variants

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, None, None, None), (2, "", "en", "s1"), (3, " \t\n  ", "en", None), (4, "word", "en", "s1"), (5, LONG, "en", "s2"), (5, LONG, "en", "s2"),
    (7, "A b\x0bC d", "", "s1"), (8, "日本 語　テキスト é\x00 \n\n end ", "ja", "s1"), (None, "no id at all", "en", "s1"), (None, None, "fr", "s3"),
    (9, "Umfangreiche umfangreiche umfangreichen UMFANGREICHE ÄÖÜabcdef " * 3, "de", "s1"),
]
CLASHING = ["word", "form", "root", "n", "bucket", "kind", "key", "block", "held", "hi", "lo", "rest", "docs", "rank", "value", "part", "item"]


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    return frame.select("*", *[F.lit("kept").alias(c) for c in CLASHING]).repartition(3)


def rows_of(sf: str = FOLDER):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet'").fetchall()


# Spelling variants

def plain_words(rows) -> dict[str, int]:
    counts: Counter[str] = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def plain_groups(words: dict[str, int]) -> dict[str, tuple]:
    near, left = defaultdict(set), defaultdict(set)
    for word in words:
        for k in range(len(word)):
            left[k, word[:k] + word[k + 1:]].add(word)
            if (shorter := word[:k] + word[k + 1:]) in words:
                near[word].add(shorter)
                near[shorter].add(word)
    for group in left.values():
        for word in group:
            near[word] |= group - {word}
    form = {}
    for word, n in words.items():
        best = min(near[word], key=lambda w: (-words[w], w), default=None)
        form[word] = best if best and words[best] >= 10 * n else None
    found = {}
    for word, n in words.items():
        root = word
        while form[root]:
            root = form[root]
        found[word] = (form[word], root, n, len(near[word]), words.get(form[word]))
    return found


def groups_found(frame) -> dict[str, tuple]:
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("bucket", [2, 100_000])
def test_variants_equal_plain_groups(spark, monkeypatch, bucket):
    monkeypatch.setattr(variants, "BUCKET", bucket)
    monkeypatch.setattr(variants, "HELD", bucket)
    found = groups_found(queries.QUERIES["op11_spelling_variants"](spark, FOLDER))
    assert found == plain_groups(plain_words(rows_of())) and any(f for f, *_ in found.values())


@pytest.mark.parametrize("bucket", [5, 100_000])
def test_links_of_one_hot_bucket_are_whole(spark, monkeypatch, bucket):
    """Words of the same letters, and each with a letter replaced, left out or put in, share most signatures."""
    monkeypatch.setattr(variants, "BUCKET", bucket)
    rng = random.Random(3)
    words = set()
    for _ in range(150):
        word = "".join(rng.sample("abcdefg", 7)) + "hh"
        at = rng.randrange(9)
        words |= {word, word[:at] + "x" + word[at + 1:], word[:at] + word[at + 1:], word[:at] + "ÿ" + word[at:], word + "h"}
    found = {(r.a, r.b) for r in variants.links(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    groups = plain_groups(dict.fromkeys(words, 1))
    assert len(found) * 2 == sum(g[3] for g in groups.values()) > 0
    assert all(abs(len(a) - len(b)) <= 1 for a, b in found)


def test_very_long_words_come_in_small_tables(spark):
    long = "abcdefghij" * 4_000
    words = [long, long + "x", "y" + long[1:], *(f"short{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100))]
    found = {(r.a, r.b) for r in variants.links(spark.createDataFrame([(w,) for w in words], "word string").coalesce(1)).collect()}
    assert {p for p in found if len(p[0]) > 9} == {(long, long + "x"), (long, "y" + long[1:])}
    assert len(found) == 2 + 100 * 18 // 2


def test_near_words_share_a_signature():
    rng = random.Random(5)
    for _ in range(300):
        word = "".join(rng.choice("abcdeéÿ") for _ in range(rng.randint(7, 12)))
        at = rng.randrange(len(word))
        for other, mine, theirs in ((word[:at] + "z" + word[at + 1:], variants.ALIKE, variants.ALIKE),
                                    (word[:at] + "a" + word[at:], variants.SHORTER, variants.LONGER)):
            of, signature, kind = variants.signatures(*variants.letters([word, other]))
            assert set(signature[(of == 0) & (kind == mine)]) & set(signature[(of == 1) & (kind == theirs)])


def test_chains_of_forms_lead_to_the_root(spark):
    words = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    text = " ".join(w for k, w in enumerate(words) for _ in range(2 * 12 ** k))
    ids = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in words))
    found = groups_found(variants.grouped(spark.createDataFrame([(ids, text)], "doc_id bigint, text string")))
    assert {w: f[:2] for w, f in found.items()} == {w: (n, words[-1]) for w, n in zip(words, [*words[1:], None])}


# LM scores

def plain_scores(rows, prior: float) -> dict:
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", lowered(t)) + [" "] for _, t, *_ in rows]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, *_ in rows]
    counts, pairs = Counter(), Counter()
    for words, out in zip(tokens, held):
        if not out:
            counts.update(words)
            pairs.update(zip([" ", *words], words))
    total, kinds = sum(counts.values()), len(counts)

    def share(word):
        return (counts[word] + 0.1) / (total + 0.1 * (kinds + 1))

    found = []
    for (i, *_), words, out in zip(rows, tokens, held):
        score = sum(math.log10((pairs[a, b] + prior * share(b)) / (counts[a] + prior)) for a, b in zip([" ", *words], words))
        found.append((i, out, len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10(share(w)) for w in words), score))
    return found


def assert_scores(frame, rows):
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    found, wanted = sorted(map(tuple, frame.collect()), key=order), sorted(plain_scores(rows, automaton.PRIOR), key=order)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in wanted], rtol=1e-9, atol=1e-9)


def test_scores_equal_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(automaton, "BLOCK_BYTES", 40_000)
    assert_scores(queries.QUERIES["op12_lm_scores"](spark, FOLDER), rows_of())


def test_scores_of_odd_rows(odd):
    assert_scores(automaton.scored(odd), ODD)
    assert automaton.scored(odd.limit(0)).count() == 0


def test_scores_without_training_rows_are_base_scores(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    found = automaton.scored(spark.createDataFrame([(i, "a b") for i in held], "doc_id bigint, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in found} == {(3, 0, 0)} and all(r.score == r.base_score for r in found)


def test_texts_are_read_by_arrays(spark, monkeypatch):
    """A block's texts are read at once: no text walks by itself, and each token knows its pair's place."""
    monkeypatch.setattr(automaton.Automaton, "log10", None)
    ids, ends, words = automaton.numbered([b"a b a c", b"", b"b a b", b"c"])
    row = {"ends": ends.tobytes(), "held": np.array([False, False, True, False]).tobytes(), "ids": ids.astype("<u2").tobytes(),
           "rounds": np.ones(len(words), dtype=np.uint8).tobytes()}
    block = automaton.Block(row)
    codes, n, at = block.placed_pairs()
    assert all((a == b).all() for a, b in zip(block.pairs(), (codes, n)))
    assert (codes[at] == block.before * block.width + block.ids).all() and n.sum() == block.taught.sum()
    blocks = {"block": [0], "doc_ids": [[1, 2, 3, 4]], **{k: [v] for k, v in row.items()}}
    table = automaton._walked(9, 4, 20.0)(pa.table(blocks), pa.table({"round": pa.array([], pa.int32())}))
    counts, pairs = np.bincount(block.ids[block.taught], minlength=len(words)), dict(zip(codes.tolist(), n.tolist()))
    share = [(c + 0.1) / (9 + 0.1 * 5) for c in counts.tolist()]
    step = [math.log10((pairs[a * len(words) + b] + 20 * share[b]) / (counts[a] + 20)) for a, b in zip(block.before.tolist(), block.ids.tolist())]
    assert np.allclose(table.column("score").to_numpy(), [sum(step[a:b]) for a, b in zip(block.starts, block.ends)], rtol=1e-12)


def test_model_is_a_probability():
    """What follows a context sums to one over all known words and one unknown."""
    ids, ends, words = automaton.numbered([b"a b a c", b"b a"])
    counts = np.bincount(ids, minlength=len(words) + 1)
    before = np.r_[0, ids[:-1]].astype(np.int64)
    codes, n = np.unique(before * (len(words) + 1) + ids, return_counts=True)
    model = automaton.Automaton(len(words) + 1, codes, n, counts, int(counts.sum()), len(words), 20.0)
    for first in range(len(words) + 1):
        state = [] if first == 0 else [first]
        reached = model.log10(state) if state else 0.0
        assert math.isclose(sum(10 ** (model.log10([*state, w]) - reached) for w in range(len(words) + 1)), 1)


def test_unlike_tags_part_equal_hashes():
    columns = {"key": [1, 1, 1, 2], "tag": [5, 6, 5, 5], "block": [0, 0, 1, 0], "idx": [0, 1, 0, 2], "n": [2, 4, 3, 1]}
    batch = pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in automaton._GRAMS], schema=automaton._GRAMS)
    found = [r for b in automaton._totals(1)(iter([batch])) for r in b.to_pylist()]
    assert [(r["block"], np.frombuffer(r["idx"], "<i4").tolist(), np.frombuffer(r["n"], "<i8").tolist()) for r in found] == [
        (0, [0], [5]), (1, [0], [5])]


# Source divergence

@pytest.mark.parametrize("tile", [3, 256])
def test_divergence_equals_sql(spark, monkeypatch, tile):
    monkeypatch.setattr(divergence, "TILE", tile)
    found = queries.QUERIES["op13_source_divergence"](spark, FOLDER).collect()
    wanted = duckdb.sql(divergence.AUDIT_SQL.replace(" from documents", f" from '{FOLDER}/documents.parquet'")).fetchall()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found) == sorted(wanted) and wanted


def test_divergence_of_odd_rows(odd):
    found = {(r.lang, r.source, r.item): r.value for r in divergence.audit(odd).where("part = 'pair'").collect()}
    # No term is in 30 rows, so all sources of a language are alike; sources without a term are sources.
    sources = {"en": ("", "s1", "s2"), "": ("", "s1")}
    assert found == {(lang, a, b): 0 for lang, names in sources.items() for a in names for b in names if a != b}
    assert divergence.audit(odd).where("part = 'term'").count() == 0 and divergence.audit(odd.limit(0)).count() == 0


def test_divergence_with_few_rows_needed(odd):
    found = divergence.audit(odd, least_docs=1, top=2).where("part = 'term'").collect()
    assert max(r["rank"] for r in found) == 2 and {r.lang for r in found} == {"en"}
    assert all(r.value > 0 for r in found)


def test_packed_counts_equal_plain_counts():
    rng = random.Random(2)
    texts = ["", None, *("".join(rng.choice(["Ab", "é", "日本語", " ", "x" * 9, "1", "\x7f", "ÿ" * 40, "q" * 17, "q" * 16, "z" * 8]) for _ in range(60))
                         for _ in range(30))]
    group = np.array([i % 3 for i in range(len(texts))])
    plain, docs = Counter(), Counter()
    for g, text in zip(group.tolist(), texts):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        plain.update((g, t) for t in terms)
        docs.update((g, t) for t in set(terms))
    found = {}
    for g, hi, lo, rest, n, d in divergence.packed_counts(pa.array([t or "" for t in texts]), group):
        for k in range(len(g)):
            term = (int(hi[k]).to_bytes(8, "big") + int(lo[k]).to_bytes(8, "big")).rstrip(b"\0") + rest[k]
            assert (int(g[k]), term.decode()) not in found
            found[int(g[k]), term.decode()] = int(n[k]), int(d[k])
    assert found == {k: (n, docs[k]) for k, n in plain.items()}


def test_radix_order_is_stable_and_unsigned():
    words = np.array([1 << 63, 3, 1 << 63, 0, 3], dtype=np.uint64)
    assert divergence.radix_order(words).tolist() == [3, 1, 4, 0, 2]
    assert divergence.radix_order(words, np.array([2, 9, 1, 0, 8], dtype=np.uint64)).tolist() == [3, 4, 1, 2, 0]
