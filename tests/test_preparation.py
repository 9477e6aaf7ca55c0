from __future__ import annotations

import ast
import json
import textwrap

import pytest
from pyspark.sql import functions as F

from suitegauge.functions import code, docstrings, text
from suitegauge.operators import preparation as prep
from suitegauge.operators import quality
from suitegauge.plans.catalog import QUERIES
from suitegauge.sources import tasks as source

PAIR = '''from typing import List


def widest_gap(values: List[float], least: float) -> bool:
    """Tell whether two neighbours lie further apart than
    the least gap.
    >>> widest_gap([1.0, (2.0), 9.0], 0.5)
    True
    >>> widest_gap([], 3)
    False
    """
'''
PLAIN = "def double(x):\n    '''  Twice x.  '''\n    return x * 2\n"
LATE = "def helper(x):\n    return x\n\n\ndef shown():\n    \"\"\"\n    Shown here.\n\n    >>> shown()\n    {'a': 1,\n     'b': 2}\n    \"\"\"\n"
BARE = "value = 1\n"


def specs(spark, *rows):
    return spark.createDataFrame(list(rows), "task_id string, spec string, metadata string, correct_implementation string")


def test_ids_metadata_and_code(spark):
    records = spark.createDataFrame(
        [(1, "double", "def double(x):\n", "    return x * 2\n"), (1000, "f", "p", "s")],
        "ordinal bigint, function_name string, prompt string, canonical_solution string")
    rows = {r.ordinal: r for r in prep.build_tasks(records).collect()}
    assert rows[1].task_id == "task_001_double" and rows[1000].task_id == "task_1000_f"
    assert rows[1].correct_implementation == "def double(x):\n    return x * 2\n"
    assert json.loads(rows[1].metadata) == {
        "task_id": "task_001_double", "function_name": "double", "track": "tdd", "source": "evalplus"}


def test_examples(spark):
    rows = prep.extract_examples(specs(spark, ("a", PAIR, None, ""), ("b", LATE, None, ""), ("c", BARE, None, ""))).orderBy(
        "task_id", "example_no").collect()
    assert [(r.task_id, r.example_no, r.call, r.expected) for r in rows] == [
        ("a", 1, "widest_gap([1.0, (2.0), 9.0], 0.5)", "True"), ("a", 2, "widest_gap([], 3)", "False"),
        # Only the first line of a longer output is taken.
        ("b", 1, "shown()", "{'a': 1,")]


@pytest.mark.parametrize("call,name,expected", [
    ("f(1, (2), 3)", "f", "1, (2), 3"), ("f()", "f", ""), ("g(1)", "f", ""), ("f(1", "f", ""), ("x = f(1)", "f", ""),
    ("f(1) + g(2)", "f", "1) + g(2"), ("f(1) # note", "f", "1")])
def test_call_arguments(spark, call, name, expected):
    frame = spark.createDataFrame([(call, name)], "call string, name string")
    assert frame.select(text.call_arguments(F.col("call"), F.col("name"))).first()[0] == expected


@pytest.mark.parametrize("metadata,spec,directory,expected", [
    ('{"function_name": "named"}', PAIR, "task_001_other", "named"), ("{}", PAIR, "task_001_other", "widest_gap"),
    (None, LATE, "task_001_other", "helper"), (None, BARE, "task_001_two_words", "two_words"), (None, BARE, "task_001", None)])
def test_function_name_precedence(spark, metadata, spec, directory, expected):
    frame = spark.createDataFrame([(metadata, spec, directory)], "m string, s string, d string")
    assert frame.select(text.function_name(F.col("m"), F.col("s"), F.col("d"))).first()[0] == expected


@pytest.mark.parametrize("spec", [PAIR, PLAIN, LATE, BARE, "def f(a=')'):\n    r\"\"\"Raw.\"\"\"\n"])
def test_docstring_readings_agree(spark, spec):
    row = spark.createDataFrame([(spec,)], "spec string").select(
        text.first_line(docstrings.docstring(F.col("spec"))).alias("by_text"), code.parsed_spec("spec").alias("p")).first()
    assert row.by_text == row.p.docstring.split("\n")[0].strip()


ODD_SPECS = [
    "def f(x={1: \"v\"}):\n    return x\n", "x = {1: 'v'}\n", "def f(): 'short'\n", "def f():\n    'a' 'b'.upper()\n", "def f():\n    ''\n",
    "def f():\n    '''\n\n    '''\n", "def f():\n    f'no {1}'\n", "def f():\n    b'no'\n", "def f():\n    u'yes'  # so\n", "def f():\n    \"it's\"; x = 1\n", "",
    "def f(\n    a: dict = {'(': 1},  # (\n    b='):',\n) -> dict[str, int]:\n\n    # note\n    \"\"\"One \"two\" three.\n\n      four\n\tfive\n    \"\"\"\n",
    "def f():\n    return '''\ndef g():\n    \"no\"\n'''\n\ndef h():\n    '''yes'''\n",
    "def f():\n    def g():\n        'inner'\n    return g\ndef h():\n    'outer'\n",
    "class A:\n    'of the class'\n    def m(self):\n        pass\n", "def f():\n    x = 'a'; y = \"b\"\n    \"\"\"late\"\"\"\n",
    "def f(a=''):\n    \"\"\"  " + "long word " * 3000 + "\n   end  \n\n    \"\"\"\n", "def f():\r\n    '''a\r\n    b'''\r\n"]


def test_docstrings_are_those_of_the_grammar(spark):
    frame = spark.createDataFrame([(s,) for s in [*ODD_SPECS, PAIR, PLAIN, LATE, BARE]], "spec string")
    for row in frame.select("spec", docstrings.docstring(F.col("spec")).alias("by_lines"), code.parsed_spec("spec").alias("p")).collect():
        assert (row.by_lines.rstrip(), row.p.valid) == (row.p.docstring.rstrip(), True), row.spec
    assert spark.createDataFrame([(None,)], "spec string").select(docstrings.docstring(F.col("spec"))).first()[0] is None


def test_feature_text_and_metadata(spark):
    tdd = specs(spark, ("task_001_widest_gap", PAIR, '{"source": "evalplus"}', "c"), ("task_002_double", PLAIN, "{}", "c"))
    for by_grammar in (False, True):
        good, rejects = prep.derive_bdd(tdd, by_grammar=by_grammar)
        rows = {r.task_id: r for r in good.collect()}
        assert rejects.count() == 0
        assert rows["task_001_widest_gap"].spec == textwrap.dedent("""\
            Feature: widest_gap
              Tell whether two neighbours lie further apart than

              Scenario: Example 1
                Given the function widest_gap
                When called with [1.0, (2.0), 9.0], 0.5
                Then the result should be True

              Scenario: Example 2
                Given the function widest_gap
                When called with [], 3
                Then the result should be False
            """)
        assert rows["task_002_double"].spec == "Feature: double\n  Twice x.\n"
        assert json.loads(rows["task_001_widest_gap"].metadata) == {
            "task_id": "task_001_widest_gap", "function_name": "widest_gap", "track": "bdd",
            "tdd_source": "data/tasks/tdd/python/task_001_widest_gap", "source": "evalplus"}
        assert "source" not in json.loads(rows["task_002_double"].metadata)


def test_one_bad_spec_does_not_stop_the_batch(spark):
    tdd = specs(spark, ("task_001_a", "def a(:\n", "{}", "c"), ("task_002_double", PLAIN, "{}", "c"), ("task_003", BARE, "{}", "c"))
    good, rejects = prep.derive_bdd(tdd, by_grammar=True)
    assert [r.task_id for r in good.collect()] == ["task_002_double"]
    assert {r.task_id: r.reason for r in rejects.collect()} == {
        "task_001_a": "invalid Python in spec", "task_003": "Could not extract function name from task_003"}


@pytest.mark.parametrize("source_code,buggy,effective", [
    ("return True\nreturn True", "return False\nreturn True", True),
    ("return False", "return True", True),
    ("return x\nreturn y", "return not x\nreturn y", True),
    ("return False\nreturn True", "return False\nreturn False", True),
    ("pass", "# BUGGY VERSION\npass", False)])
def test_fallback_patterns(spark, source_code, buggy, effective):
    row = prep.inject_bugs(specs(spark, ("task_900_x", "", "{}", source_code)), prep.default_patterns(spark)).first()
    assert (row.buggy_implementation, row.is_effective, row.reason) == (buggy, effective, None)


def test_own_pattern_replaces_all_and_must_hit(spark):
    tasks = specs(spark, ("task_004_below_zero", "", "{}", "if balance < 0:\n  a\nif balance < 0:\n  b"),
                  ("task_003_truncate_number", "", "{}", "return number % 1.0"), ("task_900_x", "", "{}", None))
    rows = {r.task_id: r for r in prep.inject_bugs(tasks, prep.default_patterns(spark)).collect()}
    assert rows["task_004_below_zero"].buggy_implementation == "if balance <= 0:\n  a\nif balance <= 0:\n  b"
    assert "Pattern 'return int(number" in rows["task_003_truncate_number"].reason
    assert rows["task_900_x"].reason == "correct.py not found in task_900_x"


def test_syntax(spark):
    frame = spark.createDataFrame([("x = 1",), ("def f(:",), ("a\x00b",), (None,), ("print('\\d')",)], "tests string")
    valid = [r[0] for r in frame.select(code.syntax_valid("tests")).collect()]
    assert valid == [True, False, False, False, True]


@pytest.fixture
def tree(tmp_path):
    def write(track, task, **files):
        for name, body in files.items():
            place = tmp_path / track / "python" / task
            path = {"metadata": place / "metadata.json", "spec": place / ("spec.py" if track == "tdd" else "spec.feature"),
                    "correct": place / "implementation" / "correct.py", "buggy": place / "implementation" / "buggy.py"}[name]
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(body)

    meta = json.dumps({"task_id": "task_001_double", "function_name": "double", "track": "tdd"})
    write("tdd", "task_001_double", metadata=meta, spec=PLAIN, correct="c\n", buggy="b\n")
    write("bdd", "task_001_double", metadata=meta, spec="Feature: double\n", correct="c\n", buggy="b\n")
    write("tdd", "task_002_x", spec="s", correct="c", buggy="b")
    write("tdd", "task_003_x", metadata="{broken", spec="s", correct="c", buggy="b")
    write("bdd", "task_004_x", metadata="{}", correct="c", buggy="b")
    write("tdd", "task_005_x", metadata="{}", spec="s", buggy="b")
    write("tdd", "task_006_x", metadata="{}", spec="s", correct="c")
    return str(tmp_path)


def test_tree_scan_and_completeness(spark, tree):
    good, rejects = prep.check_tasks(source.read_tasks(spark, tree))
    assert {(r.track, r.task_id, r.spec) for r in source.to_task_records(good).collect()} == {
        ("tdd", "task_001_double", PLAIN), ("bdd", "task_001_double", "Feature: double\n")}
    reasons = {r.task: r.reason.split(" in ")[0] for r in rejects.collect()}
    assert reasons == {"task_002_x": "Missing metadata.json", "task_003_x": "Failed to read metadata.json",
                       "task_004_x": "Missing spec.feature", "task_005_x": "Missing correct.py", "task_006_x": "Missing buggy.py"}


def test_folders_read_in_place_are_those_of_the_scan(spark, tree):
    def rows(frame):
        return sorted(((r.track, r.task, r.metadata, r.spec, r.correct, r.buggy) for r in frame.collect()), key=str)

    assert rows(source.read_task_folders(spark, tree)) == rows(source.read_tasks(spark, tree))
    assert rows(source.read_task_folders(spark, tree, "bdd")) == rows(source.read_tasks(spark, tree, "bdd"))
    assert source.read_task_folders(spark, tree + "/none").count() == 0


def test_written_tree_comes_back_and_may_be_written_again(spark, tmp_path):
    given = [("tdd", "task_001_a", "{}", "sp\u00e9c\n", "c", ""), ("bdd", "task_001_a", None, "Feature", "c\r\n", None)]
    tasks = spark.createDataFrame(given, "track string, task string, metadata string, spec string, correct string, buggy string")
    assert source.write_task_tree(tasks, str(tmp_path)) == source.write_task_tree(tasks, f"file:{tmp_path}") == 6
    read = source.read_task_folders(spark, str(tmp_path)).select("track", "task", "metadata", "spec", "correct", "buggy")
    assert sorted(tuple(r) for r in read.collect()) == sorted(given)
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == [
        "buggy.py", "correct.py", "correct.py", "metadata.json", "spec.feature", "spec.py"]


def test_the_other_track_and_other_files_are_never_read(spark, tree):
    import pathlib

    (pathlib.Path(tree) / "bdd" / "python" / "task_004_x" / "notes.md").write_text("n")
    files = source.read_tasks(spark, tree, "bdd").inputFiles()
    assert files and all("/bdd/" in f and not f.endswith("notes.md") for f in files)


def test_one_track_of_the_tree(spark, tree):
    assert {r.track for r in source.read_tasks(spark, tree, "bdd").collect()} == {"bdd"}


def test_dataset_range(spark, tmp_path):
    lines = [json.dumps({"task_id": f"HumanEval/{n}", "entry_point": f"f{n}", "prompt": "p", "canonical_solution": "s"})
             for n in (0, 1, 3, 7)]
    (tmp_path / "data.jsonl").write_text("\n".join(lines))
    chosen, missing = source.select_range(source.read_dataset(spark, str(tmp_path / "data.jsonl")), 0, 5)
    assert sorted(r.n for r in missing.collect()) == [2, 4]
    tasks = prep.build_tasks(source.to_records(chosen))
    assert sorted(r.task_id for r in tasks.collect()) == ["task_001_f0", "task_002_f1", "task_004_f3"]
    assert [r.task_id for r in prep.first_tasks(tasks, 1).collect()] == ["task_001_f0"]


def test_prepared_tasks_are_pruned_by_track(spark, tmp_path):
    frame = spark.createDataFrame([("tdd", "a"), ("bdd", "b")], "track string, task_id string")
    source.write_tasks(frame, str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t")).filter("track = 'bdd'")
    assert [r.task_id for r in read.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(track" in read._jdf.queryExecution().executedPlan().toString()


def test_placeholders_and_defaults(spark):
    frame = spark.createDataFrame([("A=${ONE} B=${TWO}${ONE} $THREE ${}", {"X": "1", "D": "own"}), ("", None)],
                                  "t string, m map<string,string>")
    rows = frame.select(text.placeholders(F.col("t")).alias("p"),
                        text.with_map_defaults(F.col("m"), {"D": "std", "E": "e"}).alias("m")).collect()
    assert rows[0].p == ["ONE", "TWO"] and rows[1].p == []
    assert rows[0].m == {"D": "own", "E": "e", "X": "1"}
    assert rows[1].m == {"D": "std", "E": "e"}


def test_exactly_one(spark):
    frame = spark.createDataFrame([("a", "i", None), ("b", None, "x"), ("c", "i", "x"), ("d", None, None)],
                                  "name string, image string, ref string")
    _, rejects = quality.split_rejects(frame, quality.exactly_one_rules("image", "ref", F.col("name")))
    assert {r.name: r.reason for r in rejects.collect()} == {
        "c": "c has both 'image' and 'ref'", "d": "d must have either 'image' or 'ref'"}


def test_grammar_is_only_read():
    assert "exec(" not in open(code.__file__).read() and "eval(" not in open(code.__file__).read()
    assert ast.parse(PAIR)


def test_dataset_rejects_and_missing_numbers(spark, tmp_path):
    good = '{"task_id": "HumanEval/%d", "entry_point": "f", "prompt": "p", "canonical_solution": "s"}'
    (tmp_path / "d.jsonl").write_text("\n".join([good % 0, good % 3, '{"task_id": "Other/1"}', '{"task_id": "Hum', "text"]))
    assert sorted(r.reason for r in source.dataset_rejects(spark, str(tmp_path)).collect()) == ["no number in task_id", "not a record", "not a record"]
    data = source.read_dataset(spark, str(tmp_path)).filter("n is not null")
    assert sorted(r.n for r in source.missing_numbers(data, block=2).collect()) == [1, 2]
    assert [r.n for r in source.before_last(data, 0).collect()] == [0] and source.missing_numbers(data.limit(0)).count() == 0


def test_strip_takes_whitespace_of_any_script(spark):
    odd = "\u3000\xa0 bob \x1f\u2028"
    assert spark.createDataFrame([(odd,)], "t string").select(text.strip(F.col("t"))).first()[0] == odd.strip() == "bob"


def test_docstrings_are_read_once_per_text_on_dealt_rows(spark):
    frame = spark.createDataFrame([('def f():\n    """a\n      b\n    c"""',)], "spec string").select(docstrings.docstring(F.col("spec")).alias("doc"))
    assert frame.first()[0] == "a\n  b\nc"
    assert frame._jdf.queryExecution().analyzed().toString().count("aggregate(") == 1
    for name in ("docstrings", "docstring_texts", "gherkin_features", "scenario_names", "spec_coverage"):
        assert "RepartitionByExpression [p_partkey" in QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString(), name


def test_a_scan_in_lots_is_that_of_the_whole(spark, tree, monkeypatch):
    import pathlib

    for n in range(20):
        place = pathlib.Path(tree) / "bdd" / "python" / f"task_{n}_[a]{{b}}*"
        place.mkdir()
        (place / "spec.feature").write_text(f"s{n}")

    def rows(frame):
        return sorted(((r.track, r.task, r.metadata, r.spec, r.correct, r.buggy) for r in frame.collect()), key=str)

    whole, given, scan = rows(source.read_tasks(spark, tree, "bdd")), [], source.read_tasks

    def counted(spark, root, track, folders):
        given.append(len(folders))
        return scan(spark, root, track, folders)

    monkeypatch.setattr(source, "read_tasks", counted)
    assert rows(source.read_tasks_in_lots(spark, tree, "bdd", lot=4)) == whole and len(whole) == 22
    assert sum(given) == 22 and max(given) < 22
    assert source.read_tasks_in_lots(spark, tree + "/none", "bdd").count() == 0


def test_a_tree_is_written_by_many_tasks(spark, monkeypatch):
    from suitegauge.plans import preparation as plans

    given = []
    monkeypatch.setattr(plans.task_source, "write_task_tree", lambda tasks, path: given.append(tasks))
    plans._tree(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression [p_partkey" in given[0]._jdf.queryExecution().optimizedPlan().toString()


def test_a_scan_has_as_many_tasks_as_shuffles(spark, tree):
    import pathlib

    for n in range(40):
        home = pathlib.Path(tree) / "bdd" / "python" / f"task_{n + 500}_z"
        home.mkdir()
        (home / "spec.feature").write_text("f" * 10)
    key, former = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    listing = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    known, tracker = spark.conf.get(listing), spark.sparkContext.statusTracker()
    spark.conf.set(key, "4m")
    spark.sparkContext.setJobGroup("scan", "scan")
    try:
        names = [p.name for p in (pathlib.Path(tree) / "bdd" / "python").iterdir()]
        read = source.read_tasks(spark, tree, "bdd", names)
        assert len(read.collect()) == len(names) > 40
    finally:
        spark.conf.set(key, former)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup("scan") for s in tracker.getJobInfo(job).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4
    assert spark.conf.get(listing) == known
