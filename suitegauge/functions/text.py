"""Columns for task records: ids, metadata, worked examples, scenario text, fingerprints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed value: the characters that Python's strip() removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")

# The pattern that finds worked examples in a specification, the
# provenance label of dataset tasks and the default participant name.
EXAMPLE_PATTERN = r'(?msdU)>>> (.+?)\n\s*(.+?)(?=\n\s*(?:>>>|""")|$)'
DATASET_SOURCE = "evalplus"
UNKNOWN_PARTICIPANT = "unknown"

_DEF_PATTERN = r"(?m)^\s*def\s+(\w+)"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Both ends freed of whitespace of any script (SQL ``trim`` only removes blanks)."""
    return F.btrim(text, F.lit(WHITESPACE))


def first_line(text: Column) -> Column:
    return strip(F.substring_index(text, "\n", 1))


def task_id(ordinal: Column, function_name: Column) -> Column:
    """``task_001_name``; the number widens past 999."""
    return F.format_string("task_%03d_%s", ordinal, function_name)


def task_ordinal(task: Column) -> Column:
    """The number inside a task id; null when there is none."""
    return F.nullif(F.regexp_extract(task, r"^task_(\d+)", 1), F.lit("")).try_cast("bigint")


def correct_code(prompt: Column, solution: Column) -> Column:
    return F.concat(prompt, solution)


def tdd_metadata(task: Column, function_name: Column) -> Column:
    return F.to_json(F.struct(
        task.alias("task_id"),
        function_name.alias("function_name"),
        F.lit("tdd").alias("track"),
        F.lit(DATASET_SOURCE).alias("source"),
    ))


def bdd_metadata(task: Column, function_name: Column, tdd_source: Column, source: Column) -> Column:
    """``source`` is left out of the JSON when it is null."""
    return F.to_json(F.struct(
        task.alias("task_id"),
        function_name.alias("function_name"),
        F.lit("bdd").alias("track"),
        tdd_source.alias("tdd_source"),
        source.alias("source"),
    ))


def function_name(metadata: Column, spec: Column, directory: Column) -> Column:
    """Metadata first, then the first ``def`` in the spec, then the directory name; null if all fail."""
    parts = F.split(directory, "_", 3)
    return F.coalesce(
        F.get_json_object(metadata, "$.function_name"),
        F.nullif(F.regexp_extract(spec, _DEF_PATTERN, 1), F.lit("")),
        F.get(parts, F.lit(2)),
    )


def examples(spec: Column) -> Column:
    """Array of {call, expected}; the expected value is the first output line only."""
    pattern = F.lit(EXAMPLE_PATTERN)
    pairs = F.arrays_zip(
        F.regexp_extract_all(spec, pattern, F.lit(1)).alias("call"),
        F.regexp_extract_all(spec, pattern, F.lit(2)).alias("expected"),
    )
    return F.transform(pairs, lambda p: F.struct(
        strip(p["call"]).alias("call"), strip(p["expected"]).alias("expected")))


def call_arguments(call: Column, name: Column) -> Column:
    """Text between ``name(`` at the start and the last ``)`` of that line, else ''."""
    line = F.substring_index(call, "\n", 1)
    rest = F.substring(line, F.length(name) + 2, F.length(line))
    from_end = F.instr(F.reverse(rest), ")")
    return F.when(
        F.startswith(line, F.concat(name, F.lit("("))) & (from_end > 0),
        F.substring(rest, F.lit(1), F.length(rest) - from_end),
    ).otherwise(F.lit(""))


def feature_text(name: Column, doc: Column, example_array: Column) -> Column:
    """Gherkin text: a header, then one scenario per example in order. No shuffle: all in the row."""

    def scenario(example: Column, index: Column) -> Column:
        return F.concat(
            F.lit("\n  Scenario: Example "), (index + 1).cast("string"),
            F.lit("\n    Given the function "), name,
            F.lit("\n    When called with "), call_arguments(example["call"], name),
            F.lit("\n    Then the result should be "), example["expected"],
            F.lit("\n"),
        )

    header = F.concat(F.lit("Feature: "), name, F.lit("\n  "), first_line(doc), F.lit("\n"))
    return F.concat(header, F.array_join(F.transform(example_array, scenario), ""))


def request_text(track: Column, spec: Column) -> Column:
    return F.concat(track, F.lit(":"), spec)


def participant(name: Column) -> Column:
    return F.coalesce(F.nullif(strip(name), F.lit("")), F.lit(UNKNOWN_PARTICIPANT))


def placeholders(text: Column) -> Column:
    """Distinct ``${NAME}`` names in one text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[$][{]([^}]+)[}]"), F.lit(1)))


def with_map_defaults(values: Column, defaults: dict[str, str]) -> Column:
    """Map of defaults overlaid by the row's own entries; default keys come first."""
    own = F.coalesce(values, F.create_map().cast("map<string,string>"))
    base = F.array(*[
        F.struct(F.lit(k).alias("key"),
                 F.coalesce(F.try_element_at(own, F.lit(k)), F.lit(v)).alias("value"))
        for k, v in defaults.items()
    ])
    rest = F.filter(F.map_entries(own), lambda e: ~e["key"].isin(*defaults))
    return F.map_from_entries(F.concat(base, rest))


def _json_char(char: Column) -> Column:
    """One character as ASCII-only JSON writes it inside a string."""
    code = F.ascii(char)

    def escaped(number: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(number)), 4, "0"))

    beyond = code - 0x10000
    return (
        F.when(char == "\\", F.lit("\\\\"))
        .when(char == '"', F.lit('\\"'))
        .when(char == "\n", F.lit("\\n"))
        .when(char == "\r", F.lit("\\r"))
        .when(char == "\t", F.lit("\\t"))
        .when(char == "\b", F.lit("\\b"))
        .when(char == "\f", F.lit("\\f"))
        .when(code.between(32, 126), char)
        .when(code < 0x10000, escaped(code))
        .otherwise(F.concat(
            escaped(F.shiftright(beyond, 10) + 0xD800),
            escaped(beyond.bitwiseAND(F.lit(0x3FF)) + 0xDC00),
        ))
    )


def json_ascii_list(items: Column) -> Column:
    """``["a", "b"]`` in ASCII-only JSON with a blank after each comma."""

    def quoted(item: Column) -> Column:
        plain = ~F.rlike(item, F.lit(r"[^ !#-\[\]-~]"))
        spelled = F.array_join(F.transform(F.split(item, ""), _json_char), "")
        return F.concat(F.lit('"'), F.when(plain, item).otherwise(spelled), F.lit('"'))

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def content_hash(title: Column, description: Column, acceptance: Column) -> Column:
    """SHA-256 over title, description and the acceptance list, for change detection."""
    return F.sha2(F.concat(title, F.lit("|"), description, F.lit("|"), json_ascii_list(acceptance)), 256)
