"""Operators on texts: odd rows with a defined result, brute force on whole tables, round trips."""

from __future__ import annotations

import hashlib
import ipaddress
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from suitegauge.llm import mixing, pieces, prefixes, queries, simhash, substrings, surrogates, tokenids

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(40))
ROWS = [
    (1, None), (2, ""), (3, " \t\n  "), (4, "word"), (5, LONG), (6, LONG + " end"), (7, "A b C d"), (8, "a B c d"), (9, "a B c d"),
    (10, f"before {PASSAGE} after"), (11, f"{PASSAGE}"), (12, PASSAGE.replace("p39", "q")), (13, "x " * 60), (14, "日本 語　テキスト é\x00 \n\n end "),
    (5, LONG), (7, "A b C d"), (None, "no id"), (None, None), (15, "<|endoftext|> a  b\r\n"),
]
CLASHING = ["score", "predicted", "start", "n", "bucket", "spans", "position", "lane", "fp", "key", "row", "text_", "share", "index", "ids"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame([(i, t, "src0" if i != 4 else None) for i, t in ROWS], "doc_id bigint, text string, source string")
    return frame.select("*", *[F.lit("kept").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def byte_bpe():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def numbered(rows=ROWS):
    return dict(enumerate(t for _, t in rows))


# Substring dedup

@pytest.mark.parametrize("shared", [1, 8192])
def test_substrings_odd_rows(docs, monkeypatch, shared):
    monkeypatch.setattr(substrings, "SHARED", shared)
    want = brute.substring_dedup(numbered())
    found = sorted((str(r.doc_id), r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest())
                   for r in substrings.without_repeats(docs).collect())
    assert found == sorted((str(ROWS[k][0]), *v) for k, v in want.items())


@pytest.mark.parametrize("shared", [2, 8192])
def test_substrings_table(spark, texts, monkeypatch, shared):
    monkeypatch.setattr(substrings, "SHARED", shared)
    want = brute.substring_dedup(texts)
    found = queries.QUERIES["op5_substring_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == want and len(found) == len(want)


def test_super_kmers_cover_each_window_once():
    rng = random.Random(1)
    for n in (34, 35, 36, 90, 700):
        words = [rng.choice("abcdefgh") for _ in range(n)]
        starts, sizes, _, _ = substrings.super_kmers(words, 35)
        assert [s + i for s, k in zip(starts.tolist(), sizes.tolist()) for i in range(k)] == list(range(max(0, n - 34)))


# SimHash

def test_simhash_odd_rows(docs):
    found = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = [brute.simhash(t) for _, t in ROWS]
    ids = [i for i, _ in ROWS]
    links = [(a, b) for a, b in itertools.combinations(range(len(ROWS)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = brute.least_reachable(list(range(len(ROWS))), links)
    least = {r: min(ids[k] for k in roots if roots[k] == r and ids[k] is not None) for r in set(roots.values())
             if any(ids[k] is not None for k in roots if roots[k] == r)}
    assert found == sorted((str(ids[k]), prints[k], least.get(roots[k])) for k in range(len(ROWS)))


def test_simhash_table(spark, texts):
    found = queries.QUERIES["op10_simhash_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == brute.simhash_components(texts)


def test_simhash_links_are_complete_at_any_bucket_size(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 4)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(12):
            fps.add(int(b) ^ sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(1, 6)))))
    fps = sorted(fps)
    want = brute.least_reachable(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])
    classes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    links = [(r.u % 2**64, r.v % 2**64) for r in simhash.links(classes).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    assert brute.least_reachable(fps, links) == want


def test_simhash_keeps_one_document_of_each_group(docs):
    kept = simhash.kept_documents(docs)
    assert kept.columns == docs.columns
    found = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in found if i is not None) == [1, 4, 5, 7, 10, 13, 14, 15] or len({*found}) == len([i for i in found if i is not None]) + 1
    assert found.count(None) == 1 and found.count(7) == 1 and 8 not in found and 2 not in found


def test_simhash_judges_rows_of_a_repeated_id_by_their_own_texts(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    rows = [(1, x, "a"), (5, x, "b"), (5, y, "c"), (9, y, "d"), (5, z, "f"), (5, z, "e"), (7, "w", "g"), (None, "v", "h")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    found = sorted(map(tuple, simhash.kept_documents(frame).collect()), key=str)
    assert found == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=str)


def test_simhash_keeps_rows_without_an_id_only_where_nothing_like_them_stays(spark):
    x, y = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(None, x, "a"), (3, x, "b"), (None, x, "c"), (None, y, "d"), (None, y, "c"), (None, y + "\n", "a"), (2**63 - 1, x, "e"), (None, None, "f")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(3)
    found = simhash.kept_documents(frame).collect()
    assert sorted(map(tuple, found), key=str) == sorted([rows[1], rows[4], rows[7]], key=str)


# Token ids

def test_token_ids_odd_rows(docs, byte_bpe):
    tokenizer = Tokenizer.from_str(byte_bpe)
    shards = tokenids.write_shards(docs, byte_bpe)
    found = tokenids.fetch(shards, tokenids.keys_of(docs)).collect()
    assert len(found) == len(ROWS)
    want = sorted((str(i), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
                  for i, ids in ((i, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in ROWS))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == want
    placed = sorted((r.start, r.n_tokens, r.doc_id) for r in found)
    assert all(a[0] + a[1] == b[0] for a, b in zip(placed, placed[1:])) and placed[0][0] == 0
    ids = [p[2] for p in placed]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


def test_units_of_uneven_white_space(byte_bpe):
    tokenizer, encoder = Tokenizer.from_str(byte_bpe), tokenids.UnitEncoder(byte_bpe)
    wide = ["\t", "\u00a0", "\u3000", "\x1c", "\x85", "\r"]
    uneven = ["{}b  c d", "{}b ", " {}b", "{}b{}c\n\n", "{}b{}c\n\n\nd", "\n{}b", "{}b\n c", "{}b\n", "{}b c\nd"]
    texts = ["", " ", "\n", "a b\nc d"] + ["a" + t.replace("{}", w) for w in wide for t in uneven] + [t.replace("{}", w) for w in wide for t in uneven]
    for text in texts:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist() == want, text
    assert [len(r) // 4 for r in encoder.encode(texts)] == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_words_and_marks_are_encoded_as_in_whole_texts(byte_bpe):
    tokenizer, encoder = Tokenizer.from_str(byte_bpe), tokenids.UnitEncoder(byte_bpe)
    words = ["a", "É", "it's", "a'", "a’", "2", "²", "ª", "漢", "ɐ", "e\u0301", "\u00b7", "<|endoftext|>", "\x00", "..."]
    texts = [f"{first}{tail} {word}{tail}\n{word}" for first in words for word in words for tail in ("", ".", "...", ",'", "?!", "$&", ".2", "'")]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    spaces = [chr(c) for c in range(0x110000) if chr(c).isspace() and chr(c) not in " \n"]
    assert not pc.any(tokenids.even(pa.array([f"a{c}b" for c in spaces] + ["", " a", "a ", "\na", "a\n", "a  b", "a \nb"]))).as_py()
    assert tokenids.even(pa.array(["a b\nc", "a"])).to_pylist() == [True, True]


def test_units_are_encoded_once(byte_bpe, monkeypatch):
    """A word with other marks is no new word, and words met since the turn before the last are kept when the worker forgets others."""
    monkeypatch.setattr(tokenids, "REMEMBERED", 20)
    encoder, learnt = tokenids.UnitEncoder(byte_bpe), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda units: (learnt.extend(units), learn(units)))
    for k in range(20):
        encoder.encode([f"x often often, often. often;\n{'a' * (k + 1)} {'b' * (k + 1)}."])
        assert len(encoder.known) + len(encoder.older) <= 26
    assert sorted(learnt) == sorted(["often"] + ["\n" + "a" * k for k in range(1, 21)] + ["b" * k for k in range(1, 21)])


def test_unknown_keys_are_told(spark, docs, byte_bpe):
    shards = tokenids.write_shards(docs, byte_bpe)
    asked = spark.createDataFrame([(4, 0), (4, 1), (99, 0), (10**12, 0)], "doc_id bigint, copy int")
    assert [(r.doc_id, r.copy) for r in tokenids.fetch(shards, asked).collect()] == [(4, 0)]


def test_token_ids_table(spark, texts, byte_bpe):
    tokenizer = Tokenizer.from_str(byte_bpe)
    found = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.QUERIES["op3_token_ids"](spark, FOLDER).collect()}
    start = 0
    for i in sorted(texts):
        ids = tokenizer.encode(texts[i] or "", add_special_tokens=False).ids + [0]
        assert found.pop(i) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert not found


@pytest.mark.parametrize("n", [1, 2, 3, 7, 5000])
def test_perfect_hash_is_minimal(n):
    keys = np.random.default_rng(n).choice(10**9, n, replace=False)
    copies = np.zeros(n, dtype=np.int64)
    pilots, slots = tokenids.build_hash(keys, copies)
    assert sorted(slots.tolist()) == list(range(n))
    group, slot, _ = tokenids.key_hashes(keys, copies)
    assert tokenids._slots(slot, pilots[(group % np.uint64(len(pilots))).astype(np.int64)], n).tolist() == slots.tolist()


# SentencePiece

@pytest.fixture(scope="module")
def model():
    return pieces.Model.load(public_tokenizers.path("piece_bpe_32k.model"))


def best_path(model, text):
    """All positions, all pieces, at once; of equal paths the one whose last piece is longest."""
    scores = {p: (s, i) for i, (p, s, good) in enumerate(zip(model.pieces, model.scores, model.ordinary)) if good}
    best = [(0.0, [])] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - model.longest), end):
            piece = text[start:end]
            if piece in scores:
                score, ids = scores[piece][0], [scores[piece][1]]
            elif end - start == 1:
                score, ids = model.unknown, [model.byte_ids[b] for b in piece.encode()]
            else:
                continue
            total = best[start][0] + score
            if best[end] is None or total > best[end][0]:
                best[end] = (total, best[start][1] + ids)
    return best[-1][1]


def test_streaming_equals_whole_viterbi(model, texts):
    lines = [line for t in list(texts.values())[:40] for line in (t or "").split("\n")][:150]
    lines += ["a  b", "  x", "é日本\n\n x", "thethethethe" * 9]
    encoder = pieces.Encoder(model)
    for line in lines:
        want = best_path(model, pieces.MARK + line.replace(" ", pieces.MARK)) if line else []
        assert np.frombuffer(encoder.encode(line), dtype="<u4").tolist() == want, line


def test_ids_are_committed_early(model):
    text = (pieces.MARK + "international") * 500
    parts = list(pieces.viterbi(model, text))
    assert len(parts) > 400 and max(map(len, parts)) < 4 * model.longest


def test_pieces_odd_rows(docs, empty, model):
    found = pieces.encode_documents(docs, model).collect()
    assert len(found) == len(ROWS) and all(r.decoded for r in found)
    assert {r.n_ids for r in found if r.doc_id in (1, 2)} == {0}
    assert pieces.encode_documents(empty, model).count() == 0


def test_literal_marks_round_trip(model):
    encoder = pieces.Encoder(model)
    for text in ("▁", "a▁b ▁", "\n", " ", "\ta\n b", "𝔘nicode ☃ ​"):
        assert encoder.decode(encoder.encode(text)) == text


# Prefix fingerprints

def next_texts(rows):
    from xxhash import xxh64_intdigest

    def turn(row):
        digest = 42 if row[1] is None else xxh64_intdigest(row[1].encode(), 42)
        return (row[0] is None, -(row[0] or 0), digest - 2**64 if digest >= 2**63 else digest)

    ordered = sorted(rows, key=turn)
    return [(a[0], a[1] or "", b[1] or "") for a, b in zip(ordered, [*ordered[1:], ordered[0]])]


def plain_likeness(a, b):
    most = max(len(a), len(b))
    if not most:
        return 1.0
    begin = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = min(len(a), len(b)) - begin
    return (begin + next((i for i in range(rest) if a[-1 - i] != b[-1 - i]), rest)) / most


def test_prefix_odd_rows(docs, empty):
    found = sorted((str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in prefixes.fingerprints(docs).collect())
    want = []
    for doc_id, text, other in next_texts(ROWS):
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        want.append((str(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_likeness(text, edited), plain_likeness(text, other)))
    assert found == sorted(want)
    assert prefixes.fingerprints(empty).count() == 0


def test_prefix_table(spark, texts):
    found = {r.doc_id: r for r in queries.QUERIES["op8_prefix_fingerprints"](spark, FOLDER).collect()}
    assert len(found) == len(texts)
    by_text = {}
    for doc_id, text, other in next_texts(list(texts.items())):
        row, half = found[doc_id], len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        assert (row.near_edited, row.near_next) == (plain_likeness(text, edited), plain_likeness(text, other))
        assert by_text.setdefault(text, row.fingerprint) == row.fingerprint
        assert by_text.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
    assert len(set(by_text.values())) == len(by_text)


def test_spans_and_extensions():
    rng = random.Random(2)
    a, b = ("".join(rng.choice("ab") for _ in range(200)) for _ in range(2))
    x, y = prefixes.Prefixes(a), prefixes.Prefixes(b)
    for _ in range(300):
        i, j, n = rng.randrange(150), rng.randrange(150), rng.randrange(6)
        assert prefixes.equal_spans(x, i, y, j, n) == (a[i:i + n] == b[j:j + n])
        want = next((k for k, (p, q) in enumerate(zip(a[i:], b[j:])) if p != q), min(200 - i, 200 - j))
        assert prefixes.common_extension(x, i, y, j) == want


# Mixing

def test_mixing_odd_rows(docs, empty):
    found = mixing.mixed(docs.drop("position"), block=4).collect()
    assert len(found) == len(ROWS) and len({r.position for r in found}) == len(ROWS)
    assert all(r.release <= r.slot < r.due for r in found)
    ordered = mixing.in_mixed_order(docs)
    assert ordered.columns == docs.columns and ordered.count() == len(ROWS) and {r.lane for r in ordered.collect()} == {"kept"}
    assert mixing.mixed(empty).count() == 0


def read_order(spark, sizes, weights, block=16):
    rows = [(k, s, "t") for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    found = mixing.mixed(docs, weights, block=block).select("position", "source", "doc_id", "release", "slot", "due").collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows))) and len({r.position for r in found}) == len(rows)
    assert all(r.release <= r.slot < r.due for r in found)
    return sorted(found)


def far_off(order, sizes, parts):
    """The largest difference, in documents, of any source from its part, at any place until a source has run out."""
    end = min(max(r.position for r in order if r.source == s) for s in parts)
    slots, worst = dict.fromkeys(parts, 0), 0.0
    names = list(parts)
    share, counts = np.array([parts[s] for s in names]), np.zeros(len(names))
    at = {s: k for k, s in enumerate(names)}
    for place, row in enumerate(order):
        if row.position > end:
            break
        assert row.position == place
        counts[at[row.source]] += 1
        worst = max(worst, np.abs(counts - (place + 1) * share).max())
    return worst


@pytest.mark.parametrize("case", ["default", "three", "many", "tiny", "heavy"])
def test_no_source_is_a_block_away_from_its_given_weight(spark, case):
    sizes, weights = {"a": 4000, "b": 900, "c": 90, None: 700}, None
    if case == "three":
        sizes, weights = {"a": 4000, "b": 900, "c": 90}, {"a": 0.6, "b": 0.3, "c": 0.1}
    elif case == "many":
        sizes = {f"s{k}": 40 + k % 90 for k in range(301)}
        weights = {s: 1 + k * k % 37 / 7 for k, s in enumerate(sizes)}
    elif case == "tiny":
        sizes, weights = {"a": 30_000, "b": 11, "c": 500}, {"a": 0.9896, "b": 0.0004, "c": 0.01}
    elif case == "heavy":
        sizes, weights = {f"s{k}": 5000 >> min(k, 12) for k in range(20)}, {f"s{k}": 2.0 ** -k for k in range(20)}
        sizes = {s: n + 3 for s, n in sizes.items()}
    parts = {s: n ** 0.5 for s, n in sizes.items()} if weights is None else weights
    whole = sum(parts.values())
    order = read_order(spark, sizes, weights)
    assert 0 < far_off(order, sizes, {s: w / whole for s, w in parts.items()}) < 16


def test_sources_of_weight_zero_follow_all_others(spark):
    order = read_order(spark, {"a": 300, "b": 100, "z": 50, "y": 30, None: 20}, {"a": 0.75, "b": 0.25, "z": 0.0}, block=4)
    places = {s: [k for k, r in enumerate(order) if r.source == s] for s in ("a", "b", "z", "y", None)}
    assert max(places["a"] + places["b"]) == 399 and min(places["z"] + places["y"] + places[None]) == 400
    assert [r.source for r in read_order(spark, {"a": 3, "b": 2}, {}, block=4)].count("a") == 3
    with pytest.raises(ValueError, match="negative"):
        mixing.mixed(spark.createDataFrame([(1, "a", "t")], "doc_id bigint, source string, text string"), {"a": -1.0})


def test_two_sources_follow_the_plain_earliest_deadline_schedule(spark):
    for a, b in ((7, 3), (1, 1), (19, 1), (3, 5)):
        order = read_order(spark, {"a": 40 * a, "b": 40 * b}, {"a": a, "b": b}, block=4)
        done, plain = {"a": 0, "b": 0}, []
        for slot in range(40 * (a + b)):
            share = {"a": Fraction(a, a + b), "b": Fraction(b, a + b)}
            ready = [(Fraction(done[s] + 1) / share[s], -share[s] if a != b else 0, s) for s in "ab" if math.floor(done[s] / share[s]) <= slot]
            # Equal deadlines: the lighter side is the first of its node.
            chosen = min((due, -key, s) for due, key, s in ready)[2]
            done[chosen] += 1
            plain.append(chosen)
        assert [r.source for r in order] == plain


def test_cells_keep_a_sources_order(docs, monkeypatch):
    monkeypatch.setattr(mixing, "CELL", 2)
    rows = mixing.mixed(docs.where("source is not null")).orderBy("position").select("doc_id", "text", "position").collect()
    keys = [hashlib.md5(f"{'' if r.doc_id is None else r.doc_id}:{hashlib.md5((r.text or '').encode()).hexdigest()}".encode()).hexdigest() for r in rows]
    assert keys == sorted(keys) and [r.position for r in rows] == list(range(len(rows)))


# PII

def test_surrogates_keep_kind_format_and_coreference(spark):
    rows = [
        (1, "Mail anna.b@Mail7.example.com or ANNA.B@mail7.example.com now."),
        (2, "Call +1 (487) 555-7209 or 487-555-7209, card 4111 1111 1111 1111 / 4111111111111111, 7536784127813050."),
        (3, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ip 97.51.17.173. SSN 123-45-6789 IBAN DE89370400440532013000'),
        (4, "Mr. John Smith met Mrs Smith and MARIA and Maria Smith; Frau Müller. Анна Петрова."), (5, "plain 12345 2024-01-01 v1.2.3"),
    ]
    found = {r.doc_id: r for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()}
    mail = re.fullmatch(r"Mail (\S+) or (\S+) now\.", found[1].text)
    assert mail[1].lower() == mail[2].lower() and mail[1].endswith(".com") and mail[2].split("@")[0].isupper() and mail[1].lower() != "anna.b@mail7.example.com"
    call = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4}), card ([\d ]{19}) / (\d{16}), (\d{16})\.", found[2].text)
    assert call.groups()[:3] == call.groups()[3:6] and call[7].replace(" ", "") == call[8] and call[1] + call[2] != "487555"
    assert sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(call[8]))) % 10 == 0
    other = re.fullmatch(r'token = "([0-9a-f]{40})" ip ([\d.]+)\. SSN (\d{3}-\d{2}-\d{4}) IBAN DE\d{20}', found[3].text)
    assert all(1 <= int(x) <= 254 for x in other[2].split(".")) and other[2] != "97.51.17.173"
    names = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and MARIA and (\w+) (\w+); Frau (\w+)\. (\w+) (\w+)\.", found[4].text)
    assert names[1] in surrogates.GIVEN["male"] and names[4] in surrogates.GIVEN["female"] and names[7] in surrogates.GIVEN["female_cyrillic"]
    assert names[2] == names[3] == names[5] != "Smith" and re.fullmatch("[А-я]+", names[8]) and names[1] != "John" and names[4] != "Maria"
    assert (found[5].text, found[5].pii_count) == (rows[4][1], 0) and [found[i].pii_count for i in (1, 2, 3, 4)] == [2, 5, 4, 5]


def test_colliding_surrogates_are_drawn_again(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "_like", lambda value, stream, classes: F.concat(F.substring(value, F.lit(1), F.length(value) - 1), surrogates._byte(stream, F.lit(9)).cast("string")))
    rows = [(k, f"at x{'y' * (k % 2)}@a{k % 40}.example.com") for k in range(200)]
    found = surrogates.replaced(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()
    pairs = {(rows[r.doc_id][1], r.text) for r in found}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and not {a for a, _ in pairs} & {b for _, b in pairs}


def test_given_names_are_permuted(spark):
    names = [n for listed in surrogates.GIVEN.values() for n in listed]
    found = surrogates.replaced(spark.createDataFrame([(n, f"{n} Smith") for n in names], "doc_id string, text string"), "k").collect()
    assert len({r.text.lower() for r in found}) == len(names)
    for listed in surrogates.GIVEN.values():
        given = {r.doc_id: r.text.split()[0] for r in found if r.doc_id in listed}
        assert sorted(given.values()) == sorted(listed) and all(a != b for a, b in given.items())


def test_letters_of_any_script_and_crowded_formats_are_replaced(spark):
    crowded = [f"Mr {a}{b}" for a in "AEIOU" for b in "bcdfghjklmnpqrstvwxyz"] + [f"{a}@{b}.co" for a in "aeiou" for b in "aeiou"] + ["-@-.co", "_@-.co"]
    scripts = ["Dr Παπαδόπουλος", "Dr Ավետիսյան", "Dr Łęçñß", "Herr Ѓорѓиев", "Ms Ꭰꭰꭱ"]
    rows = list(enumerate(crowded + scripts))
    found = {r.doc_id: r.text for r in surrogates.replaced(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()}
    atoms = [t.split(" ")[-1].lower() for _, t in rows]
    new = [found[k].split(" ")[-1].lower() for k, _ in rows]
    assert len(set(new)) == len(new) and not {*atoms} & {*new}
    assert re.fullmatch("Dr [Α-Ω][α-ω]+", found[len(crowded)]) and re.fullmatch("Dr [Ա-Ֆ][ա-ֆ]+", found[len(crowded) + 1])
    assert all(re.fullmatch(r"[a-z_-]+@[a-z-]+\.co", t) for t in (found[k] for k, c in rows if "@" in c))


def test_pii_odd_rows(docs, empty):
    found = surrogates.replaced(docs, "k")
    assert found.columns == [*docs.columns, "pii_count"]
    assert sorted((str(r.doc_id), str(r.text)) for r in found.collect()) == sorted((str(i), str(t)) for i, t in ROWS)
    assert surrogates.replaced(empty, "k").count() == 0


def test_no_entity_survives(spark, texts):
    found = {r.doc_id: r for r in queries.QUERIES["op7_pii_surrogates"](spark, FOLDER).collect()}
    plain = [r"[\w.]+@[\w.]+\.com", r"\b[0-9a-f]{40}\b", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\b\d{16}\b", r"\+1 \(\d{3}\) 555-\d{4}"]
    for i, text in texts.items():
        hits = [m for p in plain for m in re.findall(p, text)]
        assert found[i].pii_count == len(hits) and not any(h in found[i].text for h in hits) and (hits or found[i].text == text)


# Empty tables

def test_empty_tables(empty, byte_bpe):
    assert substrings.without_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.kept_documents(empty).count() == 0
    assert tokenids.fetch(tokenids.write_shards(empty, byte_bpe), tokenids.keys_of(empty)).count() == 0


def test_accounts_stay_valid_and_private_addresses_private(spark):
    accounts = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "DE00370400440532013000"]
    addresses = ["10.0.0.1", "127.0.0.1", "192.168.7.9", "172.16.0.4", "172.32.0.4", "8.8.8.8", "224.0.0.1"]
    frame = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(accounts + addresses)], "doc_id int, text string")
    found = {r.doc_id: r.text[4:-6] for r in surrogates.replaced(frame, "k").collect()}

    def remainder(account):
        return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97

    for i, account in enumerate(accounts):
        assert found[i] != account and found[i][:2] == account[:2] and len(found[i]) == len(account)
        assert remainder(account) != 1 or remainder(found[i]) == 1
    for i, address in enumerate(addresses, len(accounts)):
        new = ipaddress.ip_address(found[i])
        assert found[i] != address and new.is_private == (ipaddress.ip_address(address).is_private) and not new.is_multicast


def test_texts_that_hold_the_mark(spark):
    mark = surrogates.MARK
    texts = [f"{mark} a@b.com {mark}{mark} then 10.1.2.3{mark}", f"{mark}none{mark}", "a@b.com", "a@b.com 10.1.2.3"]
    found = [r.text for r in surrogates.replaced(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "k").orderBy("doc_id").collect()]
    mail, machine = found[3].split(" ")
    assert found == [f"{mark} {mail} {mark}{mark} then {machine}{mark}", texts[1], mail, f"{mail} {machine}"]
    parts = surrogates.detected(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    assert all(r.pii_parts is None or "".join(r.pii_parts) == r.text for r in parts) and [bool(r.pii_parts) for r in parts] == [True, False, True, True]
