"""From dataset records to task tables: ids, metadata, scenario specs, injected bugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from suitegauge.functions import code, docstrings, text
from suitegauge.operators.quality import Rules, computed_once, split_rejects

# The task-specific bug patterns.
TASK_PATTERNS = [
    ("task_001_has_close_elements", "if idx != idx2:", "if idx == idx2:"),
    ("task_002_separate_paren_groups", "depth += 1", "depth += 2"),
    ("task_003_truncate_number", "return int(number * 10 ** decimals) / 10 ** decimals",
     "return int(number * 10 ** decimals)"),
    ("task_004_below_zero", "if balance < 0:", "if balance <= 0:"),
    ("task_005_intersperse", "for i in range(len(numbers) - 1):", "for i in range(len(numbers)):"),
]

# The patterns tried in turn on tasks without one of their own, and the last resort.
FALLBACK_PATTERNS = [
    ("return True", "return False"),
    ("return False", "return True"),
    ("return ", "return not "),
]
COMMENT_MARK = "# BUGGY VERSION\n"


def build_tasks(records: DataFrame) -> DataFrame:
    """Task rows from (ordinal, function_name, prompt, canonical_solution): narrow, no shuffle."""
    task, name = F.col("task_id"), F.col("function_name")
    return (
        records
        .withColumn("task_id", text.task_id(F.col("ordinal"), name))
        .withColumn("spec", F.col("prompt"))
        .withColumn("correct_implementation", text.correct_code(F.col("prompt"), F.col("canonical_solution")))
        .withColumn("metadata", text.tdd_metadata(task, name))
        .drop("prompt", "canonical_solution")
    )


def first_tasks(tasks: DataFrame, n: int) -> DataFrame:
    """Tasks 1..n by the number in their id: a filter, not a sort with a limit."""
    return tasks.filter(text.task_ordinal(F.col("task_id")).between(1, n))


COMPLETENESS_FILES = ("metadata", "spec", "correct", "buggy")


def completeness_rules(directory: Column, spec_file: Column) -> Rules:
    """What a task row lacks, in the order a loader meets it."""

    def missing(file: Column, place: Column) -> Column:
        return F.concat(F.lit("Missing "), file, F.lit(" in "), place)

    code_place = F.concat(directory, F.lit("/implementation"))
    return [
        (missing(F.lit("metadata.json"), directory), F.col("metadata").isNull()),
        (F.concat(F.lit("Failed to read metadata.json in "), directory),
         F.try_parse_json("metadata").isNull()),
        (missing(spec_file, directory), F.col("spec").isNull()),
        (missing(F.lit("correct.py"), code_place), F.col("correct").isNull()),
        (missing(F.lit("buggy.py"), code_place), F.col("buggy").isNull()),
    ]


def check_tasks(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(complete tasks, rejects with the first missing or unreadable file)."""
    spec_file = F.when(F.col("track") == "tdd", F.lit("spec.py")).otherwise(F.lit("spec.feature"))
    return split_rejects(tasks, completeness_rules(F.col("directory"), spec_file))


def extract_examples(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """One row per worked example: example_no from 1, call, expected."""
    read = computed_once(specs, text.examples(F.col(spec)).alias("_examples"))
    return (
        read.select(*[c for c in specs.columns if c != spec], F.posexplode("_examples").alias("pos", "example"))
        .select("*", (F.col("pos") + 1).alias("example_no"),
                F.col("example.call").alias("call"), F.col("example.expected").alias("expected"))
        .drop("pos", "example")
    )


def derive_bdd(tasks: DataFrame, source_root: str = "data/tasks/tdd/python",
               by_grammar: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scenario tasks, rejects) from function tasks: same id and implementations, new spec and metadata.

    ``by_grammar`` parses each spec with Python's grammar in Arrow batches and
    rejects the unparsable ones; the default reads names and docstrings with
    built-in expressions and stays in generated code.
    """
    if by_grammar:
        parsed = computed_once(tasks, code.parsed_spec("spec").alias("_parsed"))
        name_in_spec, doc = F.col("_parsed.function_name"), F.col("_parsed.docstring")
        named = F.coalesce(F.get_json_object("metadata", "$.function_name"), name_in_spec,
                           F.get(F.split("task_id", "_", 3), F.lit(2)))
        rules: Rules = [("invalid Python in spec", ~F.col("_parsed.valid"))]
    else:
        parsed = tasks
        doc = docstrings.docstring(F.col("spec"))
        named = text.function_name(F.col("metadata"), F.col("spec"), F.col("task_id"))
        rules = []
    rules.append((F.concat(F.lit("Could not extract function name from "), F.col("task_id")),
                  F.col("function_name").isNull()))

    prepared = computed_once(parsed.drop("function_name"), named.alias("function_name")).withColumn("_doc", doc)
    good, rejects = split_rejects(prepared, rules)
    location = F.concat(F.lit(source_root.rstrip("/") + "/"), F.col("task_id"))
    bdd = (
        good
        .withColumn("track", F.lit("bdd"))
        .withColumn("metadata", text.bdd_metadata(
            F.col("task_id"), F.col("function_name"), location, F.get_json_object("metadata", "$.source")))
        .withColumn("spec", text.feature_text(F.col("function_name"), F.col("_doc"), text.examples(F.col("spec"))))
    )
    return bdd.drop("_doc", "_parsed"), rejects.drop("_doc", "_parsed")


def default_patterns(spark: SparkSession) -> DataFrame:
    """The task-specific patterns as a table (task_id, old, new)."""
    rows = F.array(*[F.struct(F.lit(t).alias("task_id"), F.lit(o).alias("old"), F.lit(n).alias("new"))
                     for t, o, n in TASK_PATTERNS])
    return spark.range(1).select(F.inline(rows))


def _replace_first(source: Column, old: str, new: str) -> Column:
    return F.overlay(source, F.lit(new), F.instr(source, old), F.lit(len(old)))


def inject_bugs(tasks: DataFrame, patterns: DataFrame) -> DataFrame:
    """Adds buggy_implementation, is_effective and reason (null when the injection worked).

    A task's own pattern replaces every occurrence and must hit; other tasks get
    the first fallback pattern that hits, at its first occurrence; as a last
    resort a comment line, which is marked as not effective.

    No broadcast is forced: the planner broadcasts a pattern table only below its
    size threshold and otherwise joins by a shuffle on ``task_id``.
    """
    source = F.col("correct_implementation")
    fallback = F.concat(F.lit(COMMENT_MARK), source)
    effective = F.lit(False)
    for old, new in reversed(FALLBACK_PATTERNS):
        hit = F.contains(source, F.lit(old))
        fallback = F.when(hit, _replace_first(source, old, new)).otherwise(fallback)
        effective = hit | effective

    own = F.col("_old").isNotNull()
    joined = tasks.join(
        patterns.select("task_id", F.col("old").alias("_old"), F.col("new").alias("_new")), "task_id", "left")
    buggy = F.when(own, F.replace(source, F.col("_old"), F.col("_new"))).otherwise(fallback)
    reason = (
        F.when(source.isNull(), F.concat(F.lit("correct.py not found in "), F.col("task_id")))
        .when(own & (F.col("buggy_implementation") == source), F.concat(
            F.lit("Bug injection failed for "), F.col("task_id"), F.lit(": Pattern '"), F.col("_old"),
            F.lit("' not found in correct.py")))
    )
    return (
        computed_once(joined, buggy.alias("buggy_implementation"),
                      F.when(own, F.lit(True)).otherwise(effective).alias("is_effective"))
        .withColumn("reason", reason)
        .drop("_old", "_new")
    )


def split_injected(injected: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = injected.filter("reason is null").drop("reason")
    return good, injected.filter("reason is not null")
