from __future__ import annotations

import datetime as dt
import hashlib
import json
import random
import re
from itertools import groupby

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from suitegauge.functions import text
from suitegauge.operators import backlog, sections

STORY = ("id string, title string, description string, acceptance array<string>, passes boolean, "
         "completed_at string, depends_on array<string>, position int")


def stories(spark, *rows):
    return spark.createDataFrame(
        [(i, "t" + i, "d", ["x"], p, None, deps, n) for n, (i, p, deps) in enumerate(rows)], STORY)


def test_ready_items(spark):
    table = stories(spark, ("S-1", True, None), ("S-2", False, ["S-1"]), ("S-3", False, ["S-1", "S-2"]), ("S-4", False, []),
                    ("S-5", False, ["S-9"]), ("S-6", False, None))
    assert sorted(r.id for r in backlog.ready_items(table).collect()) == ["S-2", "S-4", "S-6"]
    assert backlog.next_item(table).first().id == "S-2"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(max_size=6), max_size=4), st.text(max_size=8))
def test_hash_equals_the_plain_definition(spark, acceptance, title):
    frame = spark.createDataFrame([(title, "d", acceptance)], "t string, d string, a array<string>")
    expected = hashlib.sha256(f"{title}|d|{json.dumps(acceptance)}".encode("utf-8", "surrogatepass")).hexdigest()
    assert frame.select(text.content_hash(F.col("t"), F.col("d"), F.col("a"))).first()[0] == expected


def test_hash_of_unusual_characters(spark):
    odd = ['q"b\\', "é ü 漢 😀", "\x00\x1f\x7f\t\r\n\b\f", ""]
    frame = spark.createDataFrame([(odd,)], "a array<string>")
    assert frame.select(text.json_ascii_list(F.col("a"))).first()[0] == json.dumps(odd)


def test_merge_is_idempotent_and_back_fills(spark):
    old = stories(spark, ("S-10", True, None), ("S-2", False, None)).drop("depends_on")
    new = backlog.with_content_hash(stories(spark, ("S-2", False, ["S-1"]), ("S-3", False, ["S-2"])))
    once = backlog.merge_new(old, new)
    twice = backlog.merge_new(once, new)
    rows = backlog.order_by_number(once).collect()
    assert [r.id for r in rows] == ["S-2", "S-3", "S-10"]
    assert [r.depends_on for r in rows] == [[], ["S-2"], []] and all(r.content_hash for r in rows)
    assert sorted(twice.select("id", "content_hash").collect()) == sorted(once.select("id", "content_hash").collect())


def test_diff(spark):
    def table(**hashes):
        return spark.createDataFrame(list(hashes.items()), "id string, content_hash string")

    changes = backlog.diff_by_hash(table(a="1", b="2", c="3"), table(a="1", b="9", d="4")).collect()
    assert {r.id: r.change for r in changes} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}


def test_status(spark):
    t = dt.datetime(2026, 2, 3, 4, 5, 6)
    updates = spark.createDataFrame(
        [("S-1", True, t), ("S-2", True, t), ("S-2", False, t + dt.timedelta(hours=1)), ("S-9", True, t)],
        "id string, status boolean, ts timestamp_ntz")
    rows = {r.id: (r.passes, r.completed_at) for r in backlog.apply_status(
        stories(spark, ("S-1", False, None), ("S-2", True, None), ("S-3", True, None)), updates).collect()}
    assert rows == {"S-1": (True, "2026-02-03T04:05:06Z"), "S-2": (False, None), "S-3": (True, None)}


@pytest.mark.parametrize("markers,need_refactor,reason", [
    (["RED", "GREEN"], False, None), (["RED", "GREEN", "BLUE"], False, None),
    (["RED"], False, "expected at least 2 entries"), (["RED", "OTHER"], False, "missing RED and/or GREEN"),
    (["GREEN", "RED"], False, "RED must come before GREEN"),
    (["RED", "REFACTOR", "GREEN"], False, "REFACTOR must come after GREEN"),
    (["RED", "GREEN", "RED"], False, "RED must come before GREEN"),
    (["RED", "GREEN"], True, "expected at least 3 entries"), (["RED", "GREEN", "OTHER"], True, "missing REFACTOR"),
    (["RED", "GREEN", "REFACTOR"], True, None)])
def test_phase_order(spark, markers, need_refactor, reason):
    log = spark.createDataFrame([("s", n, m) for n, m in enumerate(markers)], "story_id string, seq bigint, marker string")
    row = backlog.check_phase_order(log, need_refactor).first()
    assert (row.reason, row.in_order) == (reason, reason is None)


def test_lookback_takes_the_latest_entries_only(spark):
    log = [("old", 0, "RED"), ("old", 1, "GREEN")] + [("old", n, "OTHER") for n in range(2, 25)]
    log += [("new", 100, "RED"), ("new", 101, "GREEN"), ("gone", 200, "RED"), ("gone", 201, "GREEN")]
    wanted = [("old", ["a"]), ("new", ["a"]), ("gone", ["a", "b"]), ("none", [])]
    rows = {r.story_id: r.reason for r in backlog.check_lookback(
        spark.createDataFrame(log, "story_id string, seq bigint, marker string"),
        spark.createDataFrame(wanted, "story_id string, files array<string>"),
        spark.createDataFrame([("a",)], "file string")).collect()}
    assert rows == {"old": "no RED entry", "new": None, "gone": "files missing", "none": "no entries"}


@pytest.mark.parametrize("block", [1, 3, 50, 10_000])
def test_retry_stretches_whatever_the_block_size(spark, block):
    draw = random.Random(block)
    seqs = sorted(draw.sample(range(2000), 300))
    log, story = [], "a"
    for seq in seqs:
        # One stretch is long enough to fill many blocks.
        if not 500 < seq < 1200 and draw.random() < 0.4:
            story = draw.choice("abc")
        log.append((story, seq, draw.random() < 0.5))
    expected = set()
    for key, group in groupby(log, key=lambda r: r[0]):
        group = list(group)
        retries = sum(r[2] for r in group)
        expected.add((key, group[0][1], len(group), retries, retries >= 3))
    frame = spark.createDataFrame(log, "story_id string, seq bigint, is_retry boolean")
    found = {tuple(r) for r in backlog.retry_runs(frame, block=block).select(
        "story_id", "first_seq", "attempts", "retries", "stopped").collect()}
    assert found == expected


@pytest.mark.parametrize("block,fan", [(1, 2), (7, 3), (1_000_000, 4)])
def test_sparse_retry_stretches_pass_no_wide_window(spark, block, fan):
    draw, log, story = random.Random(fan), [], "a"
    for seq in range(-40, 160):
        story = story if 0 < seq < 80 or draw.random() < 0.5 else draw.choice("ab")
        log.append((story, seq * 1_000_003, draw.random() < 0.5))
    groups = [list(g) for _, g in groupby(log, key=lambda r: r[0])]
    expected = {(g[0][0], g[0][1], len(g), sum(r[2] for r in g)) for g in groups}
    frame = spark.createDataFrame(log, "story_id string, seq bigint, is_retry boolean").repartition(3)
    runs = backlog.retry_runs(frame, block=block, fan=fan)
    assert {tuple(r) for r in runs.select("story_id", "first_seq", "attempts", "retries").collect()} == expected
    assert "SinglePartition" not in runs._jdf.queryExecution().executedPlan().toString()
    assert backlog.retry_runs(frame.limit(0), block=block, fan=fan).count() == 0


@pytest.mark.parametrize("answer,found", [
    ("The work is Already Done.", True), ("It WAS ALREADY there", True), ("not yet", False), (None, None),
    ("No further implementation is required", True), ("no further implementation\nrequired", False),
    ("implementation of x already in y present", True), ("present already implementation", False)])
def test_phrases(spark, answer, found):
    frame = spark.createDataFrame([(answer,)], "answer string")
    assert backlog.detect_phrases(frame, "answer").first().reported_complete is found


PLAN = """\
Intro about #### Feature plans
#### Feature 3: Old name

**Description**: replaced later.

#### Feature 12: Checks

**Description**: Watch the
numbers.

**Acceptance Criteria**:
- [ ] First
- [x] Second
- [ ] First

**Technical Requirements**:
- Second
- Third
- Third

**Files Implemented**:
- `src/a.py - main part`
- `src/b.py`

#### Feature 3: New name

**Description**: kept. **Acceptance Criteria**:
- [ ] Only

#### Feature 10: Deploy

**Description**: Ship.

##### 10.1 Docker setup
**Acceptance Criteria**:
- [ ] Builds

**Files**:
- `Dockerfile` (CREATE)

##### 10.2 A2A wiring
**Files**:
- `src/wire.py (extend)` and more

##### 10.1b ignored

#### Feature 2: Base

**Description**: Done by hand.

Story Breakdown - Phase 2 (4 stories total):

- **Feature 10 (Deploy)** → STORY-040: Docker parameter file (v2), STORY-041: Run the A2A task loop (depends: STORY-040, STORY-012), STORY-042: Rest
- **Feature 99 (Unknown)** → STORY-050: Dropped

## Other

Story Breakdown - Phase 3 (1 stories):
- **Feature 12 (Checks)** → STORY-060: Late one
"""


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([(1, PLAN), (2, "no features here")], "doc_id int, text string").repartition(2)


def test_sections(spark, plan):
    rows = {r.number: r for r in sections.extract_sections(plan).collect()}
    assert set(rows) == {2, 3, 10, 12}
    assert (rows[3].name, rows[3].description, rows[3].acceptance) == ("New name", "kept.", ["Only"])
    assert rows[12].description == "Watch the\nnumbers."
    assert rows[12].acceptance == ["First", "Second", "First", "Third"]
    assert rows[12].files == ["src/a.py", "src/b.py"]


def test_subsections(spark, plan):
    rows = {r.number: r for r in sections.extract_subsections(sections.extract_sections(plan)).collect()}
    assert rows["10.1"].acceptance == ["Builds"] and rows["10.1"].files == ["Dockerfile"]
    assert rows["10.2"].name == "A2A wiring" and rows["10.2"].files == ["src/wire.py"]


def test_odd_subsections_are_cut_as_by_plain_search(spark):
    """Repeated names, marks inside lines, empty bodies, wide space: as the lazy pattern cuts them, with each text split once."""
    rng = random.Random(20)
    parts = ["##### 5.1 A", "##### 5.2 B", "##### 5.10 A ", "\n", "\n", "\n\n", "#####", " \n", "x", "**Acceptance Criteria**:\n- [ ] c\n", "\r", "\t\n", "é\u2003", "###### "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(3000)]
    lazy = re.compile(r"(?s)##### ([0-9]+\.[0-9]+) ([^\n]+)[ \t\n\x0b\f\r]*\n(.*?)(?=\n#####|\Z)")
    frame = spark.createDataFrame([(i, "#### Feature 5:" + t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(2)
    read = sections.extract_sections(frame)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    found = {r.doc_id: [(s.number, s.name, s.acceptance) for s in r.subsections] for r in read.collect()}
    for i, text in enumerate(texts):
        want = {}
        for number, name, body in lazy.findall(text):
            want[name.strip()] = (number, name.strip(), ["c"] if "**Acceptance Criteria**:\n- [ ] c\n" in body else [])
        assert found[i] == list(want.values()), text


def test_story_lists(spark, plan):
    rows = {r.id: r for r in sections.extract_stories(plan).collect()}
    assert rows["STORY-040"].title == "Docker parameter file (v2)" and rows["STORY-040"].depends_on == []
    assert rows["STORY-041"].depends_on == ["STORY-040", "STORY-012"] and rows["STORY-041"].title == "Run the A2A task loop"
    assert rows["STORY-060"].number == 12 and len(rows) == 5


def test_breakdown(spark, plan):
    made = sections.break_down(plan)
    assert "hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    rows = {r.id: r for r in made.collect()}
    assert set(rows) == {"STORY-003", "STORY-040", "STORY-041", "STORY-042", "STORY-060"}
    assert rows["STORY-003"].title == "New name"
    assert rows["STORY-040"].acceptance == ["Builds"] and rows["STORY-040"].files == ["Dockerfile"]
    assert rows["STORY-041"].files == ["src/wire.py"] and rows["STORY-041"].description == "Ship. - Run the A2A task loop"
    # A section's own checklist is the first one in its text, even inside a subsection.
    assert rows["STORY-042"].acceptance == ["Builds"] and rows["STORY-060"].files == ["src/a.py", "src/b.py"]
    assert rows["STORY-060"].content_hash == hashlib.sha256(
        ("Late one|Watch the\nnumbers.|" + json.dumps(["First", "Second", "First", "Third"])).encode()).hexdigest()


def test_long_checklists_do_not_overflow(spark):
    lines = "".join(f"- [ ] item {n}\n" for n in range(20_000))
    plan = spark.createDataFrame([(1, f"#### Feature 7: Long\n**Acceptance Criteria**:\n{lines}\n")], "doc_id int, text string")
    assert len(sections.extract_sections(plan).first().acceptance) == 20_000


def test_overrides(spark):
    base = stories(spark, ("S-1", False, None), ("S-2", False, None))
    over = spark.createDataFrame([("S-1", "new", []), ("S-2", "", ["y", "z"])], "id string, title string, acceptance array<string>")
    rows = {r.id: (r.title, r.acceptance) for r in sections.apply_overrides(base, over).collect()}
    assert rows == {"S-1": ("new", ["x"]), "S-2": ("tS-2", ["y", "z"])}


def test_log_text_gives_stories_and_several_markers(spark):
    texts = [(1, "a1 [RED] STORY-1 first\n\nb2 [GREEN] merge for STORY-1 and STORY-12\r\n[RED] STORY-3"), (2, "c3 [RED] [GREEN] STORY-7 both [RED]\n  d4 chore"), (3, None), (4, "")]
    entries = backlog.log_entries(spark.createDataFrame(texts, "log bigint, text string"))
    found = {r.entry.split()[0]: (r.story_ids, r.markers) for r in entries.collect()}
    assert found == {"a1": (["STORY-1"], ["RED"]), "b2": (["STORY-1", "STORY-12"], ["GREEN"]), "[RED]": (["STORY-3"], []),
                     "c3": (["STORY-7"], ["RED", "GREEN"]), "d4": ([], [])}
    checked = {r.story_id: r.reason for r in backlog.check_phase_order(backlog.entries_by_story(entries)).collect()}
    # The newest entry stands first: RED of STORY-1 came after its GREEN; both in one entry are in no order.
    assert checked["STORY-1"] == "RED must come before GREEN" and checked["STORY-7"] == "expected at least 2 entries"
    more = spark.createDataFrame([(1, "x [GREEN] STORY-9\ny [RED] STORY-9"), (2, "z [RED] [GREEN] STORY-8"), (0, "w STORY-8")], "log bigint, text string")
    checked = {r.story_id: r.reason for r in backlog.check_phase_order(backlog.entries_by_story(backlog.log_entries(more))).collect()}
    assert checked == {"STORY-9": None, "STORY-8": "RED must come before GREEN"}


def test_lookback_counts_matching_entries_only(spark):
    lines = ["n [RED] [GREEN] STORY-2 both"] + [f"k{i} STORY-1 more" for i in range(30)] + ["o [RED] STORY-2"]
    log = backlog.entries_by_story(backlog.log_entries(spark.createDataFrame([(1, "\n".join(lines))], "log bigint, text string")))
    stories = spark.createDataFrame([("STORY-1", []), ("STORY-2", ["a"]), ("STORY-4", [])], "story_id string, files array<string>")
    found = {r.story_id: (r.n_recent, r.reason) for r in backlog.check_lookback(log, stories, spark.createDataFrame([("a",)], "file string")).collect()}
    assert found == {"STORY-1": (20, "no RED entry"), "STORY-2": (2, None), "STORY-4": (0, "no entries")}
