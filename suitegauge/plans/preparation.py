"""Preparation queries: task records, worked examples, scenario texts, injected bugs, completeness."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitegauge.functions import text
from suitegauge.functions.docstrings import docstring
from suitegauge.operators import preparation as prep
from suitegauge.operators import quality
from suitegauge.plans.fixtures import view, with_views
from suitegauge.session import work_folder
from suitegauge.sources import tasks as task_source


def built(spark, folder, deal_by=None):
    return prep.build_tasks(view(spark, folder, "tasks_v", deal_by))


def dealt(spark, folder):
    """The same dealt out, for work on the texts: the table's file may be one task."""
    return built(spark, folder, "p_partkey")


def task_ids(spark, folder):
    return built(spark, folder).select("ordinal", "task_id", "function_name", "track")


def correct_impl(spark, folder):
    return built(spark, folder).select("task_id", "correct_implementation")


def metadata_json(spark, folder):
    return built(spark, folder).select("task_id", "metadata")


def first_tasks(spark, folder):
    return prep.first_tasks(built(spark, folder), 100).select("task_id", "track")


def function_names(spark, folder):
    named = view(spark, folder, "named_v")
    return named.select("p_partkey", text.function_name(
        F.col("metadata"), F.col("spec"), F.col("directory")).alias("function_name"))


def doctest_examples(spark, folder):
    return prep.extract_examples(built(spark, folder).select("task_id", "spec"))


def docstrings(spark, folder):
    return dealt(spark, folder).select("task_id", text.first_line(docstring(F.col("spec"))).alias("feature"))


def docstring_texts(spark, folder):
    """Whole texts, from specs with strings in other places than the docstring's."""
    return view(spark, folder, "specs_v", "p_partkey").select("p_partkey", docstring(F.col("spec")).alias("doc"))


def gherkin_features(spark, folder):
    bdd, _ = prep.derive_bdd(dealt(spark, folder))
    return bdd.select("task_id", "spec")


def derive_bdd(spark, folder):
    bdd, _ = prep.derive_bdd(dealt(spark, folder))
    return bdd.select("task_id", "track", "function_name", "metadata", "correct_implementation")


def derive_bdd_by_grammar(spark, folder):
    bdd, _ = prep.derive_bdd(dealt(spark, folder), by_grammar=True)
    return bdd.select("task_id", "function_name", "spec")


def _injected(spark, folder):
    return prep.inject_bugs(built(spark, folder), view(spark, folder, "patterns_v"))


def inject_bugs(spark, folder):
    good, _ = prep.split_injected(_injected(spark, folder))
    return good.select("task_id", "buggy_implementation", "is_effective")


def inject_rejects(spark, folder):
    _, rejects = prep.split_injected(_injected(spark, folder))
    return rejects.select("task_id", "reason")


def inject_reject_counts(spark, folder):
    flagged = _injected(spark, folder)
    return flagged.groupBy("track", F.col("reason").isNull().alias("ok")).agg(F.count("*").alias("n"))


def _dataset(spark, folder):
    # Numbers with a gap after every seventh record.
    return view(spark, folder, "tasks_v").select(
        (F.col("ordinal") + F.floor((F.col("ordinal") - 1) / 7)).alias("n"), "function_name")


def dataset_range(spark, folder):
    return task_source.before_last(_dataset(spark, folder), 10)


def missing_ids(spark, folder):
    return task_source.missing_numbers(_dataset(spark, folder))


def _checked(spark, folder):
    return prep.check_tasks(view(spark, folder, "folders_v"))


def task_completeness(spark, folder):
    return _checked(spark, folder)[1].select("task", "track", "reason")


def complete_tasks(spark, folder):
    return task_source.to_task_records(_checked(spark, folder)[0]).select(
        "function_name", "track", "spec", "correct_implementation", "buggy_implementation")


def completeness_counts(spark, folder):
    rejects = _checked(spark, folder)[1].withColumn("reason", F.regexp_extract("reason", r"^\w+(?: to read)? [\w.]+", 0))
    return quality.reject_counts(rejects)


def track_tasks(spark, folder):
    return built(spark, folder).filter(F.col("track") == "tdd").select("task_id", "track")


def _tree(spark, folder):
    path = work_folder(spark, "tree")
    # Dealt out: the table's file may be one task, and a folder is some dozen calls of the store.
    task_source.write_task_tree(view(spark, folder, "tree_v", "p_partkey"), path)
    return path


def task_tree(spark, folder):
    """A tree of task folders, written and read back folder by folder, both tracks."""
    return task_source.read_task_folders(spark, _tree(spark, folder)).drop("directory")


def task_tree_scan(spark, folder):
    """The same through Spark's own scan; one track, the other is never listed."""
    return task_source.read_tasks_in_lots(spark, _tree(spark, folder), "bdd").drop("directory")


def task_tree_rejects(spark, folder):
    """Folders of the tree that lack a file, by reason."""
    _, rejects = prep.check_tasks(task_source.read_task_folders(spark, _tree(spark, folder)))
    return rejects.select("task", "track", F.regexp_replace("reason", " in .*$", "").alias("reason"))


QUERIES = {f.__name__: f for f in (
    task_ids, correct_impl, metadata_json, first_tasks, function_names, doctest_examples, docstrings, docstring_texts, gherkin_features,
    derive_bdd, derive_bdd_by_grammar, inject_bugs, inject_rejects, inject_reject_counts, dataset_range, missing_ids,
    task_completeness, complete_tasks, completeness_counts, track_tasks,
    task_tree, task_tree_scan, task_tree_rejects)}

BUILT = with_views("tasks_v") + """,
built as (select *, printf('task_%03d_%s', ordinal, function_name) as task_id, prompt as spec,
  concat(prompt, canonical_solution) as correct from tasks_v)"""
_EXAMPLES = BUILT + r""",
found as (select task_id, function_name, spec, unnest(regexp_extract_all(spec, '>>> ([^\n]+)\n\s*(\S[^\n]*)', 1)) as call,
  unnest(regexp_extract_all(spec, '>>> ([^\n]+)\n\s*(\S[^\n]*)', 2)) as expected,
  unnest(generate_series(1, len(regexp_extract_all(spec, '>>> ([^\n]+)\n\s*(\S[^\n]*)', 1)))) as example_no from built)"""
_GHERKIN = _EXAMPLES + r""",
blocks as (select task_id, function_name, spec, example_no, concat(chr(10), '  Scenario: Example ', example_no, chr(10), '    Given the function ',
  function_name, chr(10), '    When called with ', regexp_extract(call, '\((.*)\)', 1), chr(10),
  '    Then the result should be ', expected, chr(10)) as block from found),
features as (select task_id, function_name, concat('Feature: ', function_name, chr(10), '  ',
  trim(split_part(regexp_extract(any_value(spec), '(?s)def .*?\"\"\"(.*?)\"\"\"', 1), chr(10), 1)), chr(10),
  string_agg(block, '' order by example_no)) as spec from blocks group by task_id, function_name)""".replace('\\"', '"')
_INJECT = BUILT.replace("with tasks_v", with_views("patterns_v") + ",\ntasks_v") + """,
joined as (select b.*, p.old, p.new from built b left join patterns_v p using (task_id)),
injected as (select *, case when old is not null then replace(correct, old, new)
    when contains(correct, 'return True') then regexp_replace(correct, 'return True', 'return False')
    when contains(correct, 'return False') then regexp_replace(correct, 'return False', 'return True')
    when contains(correct, 'return ') then regexp_replace(correct, 'return ', 'return not ')
    else concat('# BUGGY VERSION', chr(10), correct) end as buggy from joined),
judged as (select *, case when old is not null and buggy = correct then concat('Bug injection failed for ', task_id,
    ': Pattern ''', old, ''' not found in correct.py') end as reason from injected)"""
_DATASET = with_views("tasks_v") + """,
ds as (select ordinal + cast(floor((ordinal - 1) / 7) as bigint) as n, function_name from tasks_v)"""
_FOLDERS = with_views("folders_v") + """,
judged as (select *, case when metadata is null then concat('Missing metadata.json in ', directory)
  when metadata = 'not json' then concat('Failed to read metadata.json in ', directory)
  when spec is null then concat('Missing ', case when track = 'tdd' then 'spec.py' else 'spec.feature' end, ' in ', directory)
  when correct is null then concat('Missing correct.py in ', directory, '/implementation')
  when buggy is null then concat('Missing buggy.py in ', directory, '/implementation') end as reason from folders_v)"""

ORACLES = {
    "task_ids": BUILT + " select ordinal, task_id, function_name, track from built",
    "correct_impl": BUILT + " select task_id, correct as correct_implementation from built",
    "metadata_json": BUILT + """ select task_id, concat('{"task_id":"', task_id, '","function_name":"', function_name,
  '","track":"tdd","source":"evalplus"}') as metadata from built""",
    "first_tasks": BUILT + " select task_id, track from built where ordinal between 1 and 100",
    "function_names": with_views("named_v") + r"""
select p_partkey, coalesce(json_extract_string(metadata, '$.function_name'),
  nullif(regexp_extract(spec, '(?m)^\s*def\s+(\w+)', 1), ''),
  nullif(regexp_extract(directory, '^[^_]*_[^_]*_(.*)$', 1), '')) as function_name from named_v""",
    "doctest_examples": _EXAMPLES + " select task_id, cast(example_no as int) as example_no, call, expected from found",
    "docstrings": BUILT + " select task_id, trim(split_part(regexp_extract(spec, '(?s)def .*?\"\"\"(.*?)\"\"\"', 1), chr(10), 1)) as feature from built",
    "docstring_texts": with_views("specs_v") + " select p_partkey, doc from specs_v",
    "gherkin_features": _GHERKIN + " select task_id, spec from features",
    "derive_bdd": BUILT + """ select task_id, 'bdd' as track, function_name, concat('{"task_id":"', task_id, '","function_name":"',
  function_name, '","track":"bdd","tdd_source":"data/tasks/tdd/python/', task_id, '","source":"evalplus"}') as metadata,
  correct as correct_implementation from built""",
    "derive_bdd_by_grammar": _GHERKIN + " select task_id, function_name, spec from features",
    "inject_bugs": _INJECT + """ select task_id, buggy as buggy_implementation,
  old is not null or contains(correct, 'return ') as is_effective from judged where reason is null""",
    "inject_rejects": _INJECT + " select task_id, reason from judged where reason is not null",
    "inject_reject_counts": _INJECT + " select track, reason is null as ok, count(*) as n from judged group by 1, 2",
    "dataset_range": _DATASET + " select n, function_name from ds where n >= 10 and n < (select max(n) from ds)",
    "missing_ids": _DATASET + """ select g.n from (select unnest(generate_series(0, (select max(n) from ds))) as n) g
anti join ds on ds.n = g.n""",
    "task_completeness": _FOLDERS + " select task, track, reason from judged where reason is not null",
    "complete_tasks": _FOLDERS + """ select json_extract_string(metadata, '$.function_name') as function_name, track, spec,
  correct as correct_implementation, buggy as buggy_implementation from judged where reason is null""",
    "completeness_counts": _FOLDERS + r""" select regexp_extract(reason, '^\w+(?: to read)? [\w.]+') as reason, count(*) as n
from judged where reason is not null group by 1""",
    "task_tree": with_views("tree_v") + " select task, track, metadata, spec, correct, buggy from tree_v",
    "task_tree_scan": with_views("tree_v") + """
select task, track, metadata, spec, correct, nullif(buggy, '') as buggy from tree_v where track = 'bdd'""",
    "task_tree_rejects": with_views("tree_v") + """
select * from (select task, track, case when metadata is null then 'Missing metadata.json'
  when spec is null then concat('Missing ', case when track = 'tdd' then 'spec.py' else 'spec.feature' end)
  when correct is null then 'Missing correct.py' when buggy is null then 'Missing buggy.py' end as reason from tree_v)
where reason is not null""",
    "track_tasks": BUILT + " select task_id, track from built where track = 'tdd'",
}
