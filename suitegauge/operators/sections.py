"""Planning documents to story tables: sections, subsections, story lists, defaults, overrides.

Everything about one document is read inside its row, the pairing of sections with story lists
included; only the join of stories with overrides moves rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from suitegauge.functions.text import bound, content_hash, strip
from suitegauge.operators.quality import computed_once

# Headings and markers of a planning document. The repetitions are
# possessive (they give nothing back), which matches the same lists without
# recursing once per line.
SECTION_MARK = "#### Feature "
SECTION_NUMBER = r"^([0-9]+):"
DESCRIPTION = r"(?s)\*\*Description\*\*:\s*(.+?)(?:\n\n|\*\*)"
ACCEPTANCE = r"\*\*Acceptance Criteria\*\*:\s*\n((?:- \[[x ]\][^\n]++\n)++)"
REQUIREMENTS = r"\*\*Technical Requirements\*\*:\s*\n((?:- [^\n]++\n)++)"
FILES = r"\*\*Files(?:\s+Implemented)?\*\*:\s*\n((?:- `[^`]++`\n?)++)"
# Of a subsection, whole lines are taken up to one that begins with five marks: one look ahead a line, none a character.
SUBSECTION = r"##### [0-9]+\.[0-9]+ [^\n]+\s*\n(?:[^\n]++|\n(?!#####))*+"
SUBSECTION_NUMBER = r"^##### ([0-9]+\.[0-9]+) "
SUBSECTION_NAME = r"^##### [0-9]+\.[0-9]+ ([^\n]+)"
SUBSECTION_BODY = r"(?s)^[^\n]+\s*\n(.*)\z"
SUBSECTION_FILES = r"\*\*Files\*\*:\s*\n((?:- `[^`]++`[^\n]*+\n)++)"
BREAKDOWN = r"(?s)Story Breakdown[^\n]*\([0-9]+ stories[^\n]*?\):?\s*\n(.*?)(?=##|\z)"
BREAKDOWN_FEATURE = r"(?s)\*\*Feature [0-9]+[^→]+→\s*.+?(?=\n\s*-\s*\*\*|\z)"
BREAKDOWN_FEATURE_PARTS = r"(?s)^\*\*Feature ([0-9]+)[^→]+→\s*(.+)\z"
BREAKDOWN_STORY = r"(?d)STORY-[0-9]+:\s*.+?(?:\s*\(depends:\s*[^)]+\))?(?=\s*,\s*STORY-|\n|\z)"
BREAKDOWN_STORY_PARTS = r"(?d)^STORY-([0-9]+):\s*(.+?)(?:\s*\(depends:\s*([^)]+)\))?\z"

# Features that have subsections, and for each the words a story
# title must all hold and the word the subsection name must hold.
FEATURES_WITH_SUBSECTIONS = (5, 10)
KEYWORD_RULES = [
    (5, ["trivial"], "trivial"),
    (5, ["statistical"], "statistical"),
    (5, ["held-out", "test set"], "contamination"),
    (5, ["limitations"], "flaw"),
    (10, ["a2a", "task"], "a2a"),
    (10, ["docker", "parameter"], "docker"),
    (10, ["task isolation"], "isolation"),
]
FEATURES_BROKEN_DOWN_BY_HAND = 2


def _items(content: Column, block: str, item: str) -> Column:
    """Group 1 of ``item`` on each line of the list that ``block`` finds, stripped, without empty ones."""
    found = F.regexp_extract_all(F.regexp_extract(content, block, 1), F.lit(item), F.lit(1))
    return F.filter(F.transform(found, strip), lambda text: text != "")


def _checklist(content: Column) -> Column:
    return _items(content, ACCEPTANCE, r"(?m)^- \[[x ]\][^\S\n]*([^\n]*)")


def _requirements(content: Column) -> Column:
    return _items(content, REQUIREMENTS, r"(?m)^- ([^\n]*)")


def _files(content: Column, block: str = FILES) -> Column:
    """First quoted name of each line, without a remark after `` - ``."""
    quoted = F.regexp_extract_all(F.regexp_extract(content, block, 1), F.lit(r"(?m)^[^`\n]*`([^`\n]+)`"), F.lit(1))
    return F.transform(quoted, lambda name: strip(F.substring_index(name, " - ", 1)))


def _last_of_each(ordered: Column, key: str) -> Column:
    """Of an array sorted by ``key``, the last item of each key."""
    return F.filter(ordered, lambda x, i: F.coalesce(F.get(ordered, i + 1)[key] != x[key], F.lit(True)))


def _first_of_each(ordered: Column, key: str) -> Column:
    return F.filter(ordered, lambda x, i: (i == 0) | F.coalesce(F.get(ordered, i - 1)[key] != x[key], F.lit(True)))


def extract_sections(docs: DataFrame, parents: tuple[int, ...] = FEATURES_WITH_SUBSECTIONS, *keep: str) -> DataFrame:
    """One row per numbered feature section: doc_id, number, name, description, acceptance, files, subsections.

    ``keep`` carries further columns of the document.

    A number that occurs again replaces the earlier section. The acceptance list
    keeps its own repeats; requirements are added once each and only if new.
    """
    # Text before the first mark, and marks without a number, only end the section before them.
    numbered = F.filter(bound(F.split("text", SECTION_MARK), lambda pieces: F.slice(pieces, F.lit(2), F.size(pieces))),
                        lambda p: F.rlike(p, F.lit(SECTION_NUMBER)))
    found = F.transform(numbered, lambda p, i: F.struct(
        F.substring_index(p, ":", 1).try_cast("int").alias("number"), i.alias("pos"),
        F.substring(p, F.instr(p, ":") + 1, F.length(p)).alias("content")))
    kept = computed_once(docs.select("doc_id", "text", *keep), bound(
        F.sort_array(found), lambda ordered: _last_of_each(ordered, "number")).alias("_kept"))
    content, number = F.col("content"), F.col("number")
    name = F.nullif(strip(F.regexp_extract(content, r"^\s*([^\n]+)", 1)), F.lit(""))
    checklist = _checklist(content)
    return kept.select("doc_id", *keep, F.inline("_kept")).select(
        "doc_id", *keep, "number",
        F.coalesce(name, F.concat(F.lit("Feature "), number.cast("string"))).alias("name"),
        strip(F.regexp_extract(content, DESCRIPTION, 1)).alias("description"),
        F.concat(checklist, F.array_except(_requirements(content), checklist)).alias("acceptance"),
        _files(content).alias("files"),
        F.when(number.isin(*parents), bound(_sorted_subsections(content), _subsections)).alias("subsections"),
    )


def _sorted_subsections(content: Column) -> Column:
    return F.sort_array(F.transform(F.regexp_extract_all(content, F.lit(SUBSECTION), F.lit(0)), lambda s, i: F.struct(
        strip(F.regexp_extract(s, SUBSECTION_NAME, 1)).alias("name"), i.alias("pos"),
        F.regexp_extract(s, SUBSECTION_NUMBER, 1).alias("number"),
        F.regexp_extract(s, SUBSECTION_BODY, 1).alias("body"))))


def _subsections(ordered: Column) -> Column:
    """Subsections in order of first appearance; a repeated name keeps its place and takes the later text."""
    pairs = F.zip_with(_first_of_each(ordered, "name"), _last_of_each(ordered, "name"), lambda first, last: F.struct(
        first["pos"].alias("pos"), last["number"].alias("number"), last["name"].alias("name"),
        _checklist(last["body"]).alias("acceptance"),
        F.transform(_files(last["body"], SUBSECTION_FILES),
                    lambda f: F.regexp_replace(f, r"\s*\([^)]+\)\s*$", "")).alias("files")))
    return F.transform(F.sort_array(pairs), lambda s: F.struct(
        s["number"].alias("number"), s["name"].alias("name"),
        s["acceptance"].alias("acceptance"), s["files"].alias("files")))


def extract_subsections(sections: DataFrame) -> DataFrame:
    """One row per subsection: doc_id, feature, number, name, acceptance, files."""
    read = computed_once(sections.select("doc_id", F.col("number").alias("feature"), "subsections"),
                         F.col("subsections").alias("_subsections"))
    return read.select("doc_id", "feature", F.inline("_subsections"))


def _listed(text: Column) -> Column:
    """Array of all listed stories: number (of the feature), place, id, title, depends_on."""
    def stories(feature: Column, place: tuple[Column, Column]) -> Column:
        number = F.regexp_extract(feature, BREAKDOWN_FEATURE_PARTS, 1).try_cast("int")
        found = F.regexp_extract_all(strip(F.regexp_extract(feature, BREAKDOWN_FEATURE_PARTS, 2)), F.lit(BREAKDOWN_STORY), F.lit(0))
        return F.transform(found, lambda story, at: F.struct(
            number.alias("number"), F.struct(place[0].alias("_b"), place[1].alias("_f"), at.alias("_s")).alias("place"),
            F.concat(F.lit("STORY-"), F.regexp_extract(story, BREAKDOWN_STORY_PARTS, 1)).alias("id"),
            strip(F.regexp_extract(story, BREAKDOWN_STORY_PARTS, 2)).alias("title"),
            F.regexp_extract_all(F.regexp_extract(story, BREAKDOWN_STORY_PARTS, 3), F.lit("STORY-[0-9]+"), F.lit(0)).alias("depends_on")))

    lists = F.regexp_extract_all(text, F.lit(BREAKDOWN), F.lit(1))
    return F.flatten(F.transform(lists, lambda part, b: F.flatten(F.transform(
        F.regexp_extract_all(part, F.lit(BREAKDOWN_FEATURE), F.lit(0)), lambda feature, f: stories(feature, (b, f))))))


def extract_stories(docs: DataFrame) -> DataFrame:
    """Story lists of all breakdown parts: doc_id, number (of the feature), place, id, title, depends_on."""
    found = computed_once(docs.select("doc_id", "text"), _listed(F.col("text")).alias("_stories"))
    return found.select("doc_id", F.inline("_stories"))


def _paired(docs: DataFrame, parents: tuple[int, ...]) -> DataFrame:
    """Sections of each document with _listed, the stories of their number, all read from the same row."""
    found = computed_once(docs.select("doc_id", "text"), _listed(F.col("text")).alias("_stories"))
    return extract_sections(found, parents, "_stories").withColumn(
        "_listed", F.filter("_stories", lambda story: story["number"] == F.col("number"))).drop("_stories")


def matching_subsection(title: Column, number: Column, subsections: Column,
                        rules: list[tuple[int, list[str], str]] = KEYWORD_RULES) -> Column:
    """First subsection for which some rule holds: all its words in the title and its key in the name."""
    table = F.array(*[F.struct(F.lit(f).alias("feature"), F.array(*map(F.lit, words)).alias("words"),
                               F.lit(key).alias("key")) for f, words, key in rules])
    low = F.lower(title)
    held = F.filter(table, lambda r: (r["feature"] == number)
                    & F.forall(r["words"], lambda w: F.contains(low, w)))
    keys = F.transform(held, lambda r: r["key"])
    return F.get(F.filter(subsections, lambda s: F.exists(
        keys, lambda k: F.contains(F.lower(s["name"]), k))), F.lit(0))


def keyword_matches(docs: DataFrame, rules: list[tuple[int, list[str], str]] = KEYWORD_RULES,
                    parents: tuple[int, ...] = FEATURES_WITH_SUBSECTIONS) -> DataFrame:
    """Stories with the number and name of the subsection they match; unmatched ones are left out."""
    listed = _paired(docs, parents).select("doc_id", "number", "subsections", F.explode("_listed").alias("_story"))
    return (
        computed_once(listed, matching_subsection(
            F.col("_story.title"), F.col("number"), F.col("subsections"), rules).alias("_sub"))
        .filter("_sub is not null")
        .select("doc_id", "number", "_story.id", "_story.title", F.col("_sub.number").alias("subsection"),
                F.col("_sub.name").alias("subsection_name"))
    )


def break_down(docs: DataFrame, rules: list[tuple[int, list[str], str]] = KEYWORD_RULES,
               parents: tuple[int, ...] = FEATURES_WITH_SUBSECTIONS) -> DataFrame:
    """Story records: the listed stories of each section, or one default story for a section without any.

    Sections up to 2 without a list yield nothing. A listed story takes the
    checklist and files of the subsection its title matches, else the section's. No row leaves its place.
    """
    listed = _paired(docs, parents)
    columns = [c for c in listed.columns if c != "_listed"]
    opened = listed.select(*columns, F.explode_outer("_listed").alias("_story")).filter(
        F.col("_story").isNotNull() | (F.col("number") > FEATURES_BROKEN_DOWN_BY_HAND))
    joined = opened.select(*columns, F.col("_story.place").alias("place"), F.col("_story.id").alias("_id"),
                           F.col("_story.title").alias("_title"), F.col("_story.depends_on").alias("_deps"))
    own = F.col("_id").isNotNull()
    described = computed_once(joined, F.when(own, matching_subsection(
        F.col("_title"), F.col("number"), F.col("subsections"), rules)).alias("_sub"))
    matched = F.col("_sub").isNotNull()
    shaped = described.select(
        "doc_id", "number", "place",
        F.coalesce("_id", F.format_string("STORY-%03d", "number")).alias("id"),
        F.when(own, F.col("_title")).otherwise(F.col("name")).alias("title"),
        F.when(own, F.concat("description", F.lit(" - "), "_title")).otherwise(F.col("description")).alias("description"),
        F.col("description").alias("_section_description"),
        F.when(matched, F.col("_sub.acceptance")).otherwise(F.col("acceptance")).alias("acceptance"),
        F.when(matched, F.col("_sub.files")).otherwise(F.col("files")).alias("files"),
        F.coalesce("_deps", F.array().cast("array<string>")).alias("depends_on"),
    )
    return (
        shaped.withColumn("content_hash", content_hash(
            F.col("title"), F.col("_section_description"), F.col("acceptance")))
        .withColumn("passes", F.lit(False)).withColumn("completed_at", F.lit(None).cast("string"))
        .drop("_section_description")
    )


def apply_overrides(stories: DataFrame, overrides: DataFrame, key: str = "id") -> DataFrame:
    """Fields of ``overrides`` replace those of the story where they are not empty."""
    fields = [c for c in overrides.columns if c != key]
    types = dict(overrides.dtypes)
    renamed = overrides.select(key, *[F.col(c).alias(f"_{c}") for c in fields])

    def merged(name: str) -> Column:
        value = F.col(f"_{name}")
        given = F.size(value) > 0 if types[name].startswith("array") else value != F.lit("")
        return F.when(F.coalesce(given, F.lit(False)), value).otherwise(F.col(name)).alias(name)

    joined = stories.join(renamed, key, "left")
    return joined.select(*[merged(c) if c in fields else F.col(c) for c in stories.columns])
