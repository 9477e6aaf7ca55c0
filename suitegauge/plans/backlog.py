"""Backlog queries: story tables, work logs, planning documents, service entries."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitegauge.functions import text
from suitegauge.operators import backlog, phrases, quality, sections
from suitegauge.plans.fixtures import view, with_views
from suitegauge.sources.tables import table

# Fixed value: the variable every service gets unless it sets its own.
DEFAULT_ENVIRONMENT = {"PYTHONUNBUFFERED": "1"}
LICENSE_PHRASES = ["all rights reserved", "license", "copyright"]


def _stories(spark, folder):
    return view(spark, folder, "stories_v")


def content_hash(spark, folder):
    return backlog.with_content_hash(_stories(spark, folder)).select("id", "content_hash")


def merge_new(spark, folder):
    stories = _stories(spark, folder)
    existing = stories.filter("o_totalprice < 250000").drop("depends_on")
    incoming = stories.filter("o_orderdate >= '1996-01-01' or o_totalprice >= 250000").withColumn("title", F.upper("title"))
    return backlog.merge_new(existing, incoming, ordered=True).select(
        "id", "title", "content_hash", F.size("depends_on").alias("n_depends_on"))


def diff_by_hash(spark, folder):
    stories = _stories(spark, folder)
    old = backlog.with_content_hash(stories.filter("position % 11 <> 3"))
    new = backlog.with_content_hash(stories.filter("position % 11 <> 5").withColumn(
        "title", F.when(F.col("passes"), F.upper(F.concat("title", F.lit("!")))).otherwise(F.col("title"))))
    return backlog.diff_by_hash(old, new)


def ready_items(spark, folder):
    return backlog.ready_items(_stories(spark, folder)).select("id", "title")


def next_item(spark, folder):
    return backlog.next_item(_stories(spark, folder)).select("id", "title")


def apply_status(spark, folder):
    return backlog.apply_status(_stories(spark, folder), view(spark, folder, "updates_v")).select("id", "passes", "completed_at")


def progress_summary(spark, folder):
    return backlog.progress_summary(_stories(spark, folder))


def phase_order(spark, folder):
    return backlog.check_phase_order(view(spark, folder, "work_log_v"))


def phase_order_refactor(spark, folder):
    return backlog.check_phase_order(view(spark, folder, "work_log_v"), require_refactor=True)


def lookback(spark, folder):
    return backlog.check_lookback(view(spark, folder, "work_log_v"), view(spark, folder, "expected_files_v"),
                                  view(spark, folder, "present_files_v"))


def _logged(spark, folder):
    """Work logs as text, newest entry first, read into entries by story."""
    lines = view(spark, folder, "log_lines_v")
    newest = F.sort_array(F.collect_list(F.struct("nth", "line")), asc=False)
    # A log has 200 lines.
    logs = lines.groupBy("log").agg(F.array_join(newest["line"], "\n").alias("text"))
    return backlog.entries_by_story(backlog.log_entries(logs))


def phase_order_from_text(spark, folder):
    return backlog.check_phase_order(_logged(spark, folder), require_refactor=True)


def lookback_from_text(spark, folder):
    stories = view(spark, folder, "expected_files_v").withColumn("story_id", F.concat(F.lit("STORY-"), F.col("story_id").cast("string")))
    return backlog.check_lookback(_logged(spark, folder), stories, view(spark, folder, "present_files_v"))


def retry_runs(spark, folder):
    return backlog.retry_runs(view(spark, folder, "attempts_v"))


def retry_runs_sparse(spark, folder):
    """Numbers with gaps of a million and more: nearly every attempt is a block of its own."""
    return backlog.retry_runs(view(spark, folder, "sparse_attempts_v"))


def phrase_hits(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    flagged = backlog.detect_phrases(documents, "text")
    return backlog.detect_phrases(flagged, "text", LICENSE_PHRASES, "names_license").drop("text")


def phrase_table_hits(spark, folder):
    """A table of phrases that grows with the data, found in all documents."""
    return phrases.find_phrases(table(spark, folder, "documents"), view(spark, folder, "phrases_v"))


def placeholders(spark, folder):
    found = quality.computed_once(view(spark, folder, "services_v"), text.placeholders(F.col("env_text")).alias("names"))
    return found.select(F.explode("names").alias("name")).distinct().orderBy("name")


def duplicates(spark, folder):
    return quality.find_duplicates(view(spark, folder, "services_v"), "name")


def exactly_one(spark, folder):
    services = view(spark, folder, "services_v")
    _, rejects = quality.split_rejects(services, quality.exactly_one_rules("image", "external_id", F.col("name")))
    return rejects.select("s_suppkey", "reason")


def env_defaults(spark, folder):
    own = F.when(F.col("image").isNotNull(), F.create_map(F.lit("BALANCE"), F.col("balance"))).when(
        F.col("external_id").isNotNull(), F.create_map(F.lit("PYTHONUNBUFFERED"), F.col("external_id")))
    merged = text.with_map_defaults(own, DEFAULT_ENVIRONMENT)
    entries = F.transform(F.map_entries(merged), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return view(spark, folder, "services_v").select("s_suppkey", F.array_join(entries, ";").alias("environment"))


def _plans(spark, folder):
    return view(spark, folder, "plans_v", deal_by="o_orderkey")


def plan_sections(spark, folder):
    return sections.extract_sections(_plans(spark, folder)).select(
        "doc_id", "number", "name", "description", F.array_join("acceptance", "|").alias("acceptance"),
        F.array_join("files", "|").alias("files"))


def plan_subsections(spark, folder):
    return sections.extract_subsections(sections.extract_sections(_plans(spark, folder))).select(
        "doc_id", "feature", "number", "name", F.array_join("acceptance", "|").alias("acceptance"),
        F.array_join("files", "|").alias("files"))


def plan_stories(spark, folder):
    return sections.extract_stories(_plans(spark, folder)).select(
        "doc_id", "number", "id", "title", F.array_join("depends_on", "|").alias("depends_on"))


def keyword_match(spark, folder):
    return sections.keyword_matches(_plans(spark, folder))


def breakdown(spark, folder):
    made = sections.break_down(_plans(spark, folder))
    return made.select("doc_id", "id", "title", "description", F.array_join("acceptance", "|").alias("acceptance"),
                       F.array_join("files", "|").alias("files"), F.array_join("depends_on", "|").alias("depends_on"))


def overrides(spark, folder):
    return sections.apply_overrides(_stories(spark, folder), view(spark, folder, "overrides_v")).select(
        "id", "title", F.array_join("acceptance", "|").alias("acceptance"))


QUERIES = {f.__name__: f for f in (
    content_hash, merge_new, diff_by_hash, ready_items, next_item, apply_status, progress_summary, phase_order,
    phase_order_refactor, lookback, phase_order_from_text, lookback_from_text, retry_runs, retry_runs_sparse, phrase_hits, phrase_table_hits, placeholders, duplicates, exactly_one, env_defaults,
    plan_sections, plan_subsections, plan_stories, keyword_match, breakdown, overrides)}

_STORIES = with_views("stories_v")


def _hash(title: str) -> str:
    return (f"sha256(concat({title}, '|', description, '|[\"', acceptance[1], '\", \"', acceptance[2], '\"]'))")


#: Entries of the logs by story, from the lines themselves: seq is the line's number, r, g, f whether it has the markers.
_LOGGED = """,
parts as (select nth as seq, regexp_replace(line, '^\\S+ ', '') as message from log_lines_v),
logged as (select distinct unnest(regexp_extract_all(concat(' ', message), '[^A-Z](STORY-[0-9]+)', 1)) as story_id, seq,
  contains(message, '[RED]') as r, contains(message, '[GREEN]') as g,
  contains(message, '[REFACTOR]') or contains(message, '[BLUE]') as f from parts)"""


def _phases(need: int, refactor_needed: bool) -> str:
    extra = "when f is null then 'missing REFACTOR'" if refactor_needed else ""
    return with_views("work_log_v") + f""",
seen as (select story_id, count(*) as n_entries, max(seq) filter (marker = 'RED') as r,
  max(seq) filter (marker = 'GREEN') as g, max(seq) filter (marker = 'REFACTOR') as f from work_log_v group by story_id),
judged as (select *, case when n_entries < {need} then 'expected at least {need} entries'
  when r is null or g is null then 'missing RED and/or GREEN' {extra} when r >= g then 'RED must come before GREEN'
  when f <= g then 'REFACTOR must come after GREEN' end as reason from seen)
select story_id, n_entries, reason is null as in_order, reason from judged"""


_READY = _STORIES + """,
waits as (select id, unnest(depends_on) as dep from stories_v where not passes),
unmet as (select id from waits where dep not in (select id from stories_v where passes)),
ready as (select * from stories_v where not passes and id not in (select id from unmet))"""
_PLANS = with_views("plans_v") + r""",
pieces as (select doc_id, unnest(string_split(text, '#### Feature ')[2:]) as piece from plans_v),
bodies as (select doc_id, cast(regexp_extract(piece, '^([0-9]+):', 1) as int) as number,
  regexp_replace(piece, '^[0-9]+:', '') as body from pieces),
lists as (select *, list_transform(list_filter(string_split(regexp_extract(body,
    '\*\*Acceptance Criteria\*\*:\s*\n((?:- \[[x ]\][^\n]+\n)+)', 1), chr(10)), lambda l: l <> ''),
    lambda l: regexp_replace(l, '^- \[[x ]\]\s*', '')) as checks,
  list_transform(list_filter(string_split(regexp_extract(body,
    '\*\*Technical Requirements\*\*:\s*\n((?:- [^\n]+\n)+)', 1), chr(10)), lambda l: l <> ''), lambda l: l[3:]) as needs,
  list_transform(list_filter(string_split(regexp_extract(body,
    '\*\*Files(?:\s+Implemented)?\*\*:\s*\n((?:- `[^`]+`\n?)+)', 1), chr(10)), lambda l: l <> ''),
    lambda l: split_part(regexp_extract(l, '`([^`]+)`', 1), ' - ', 1)) as files from bodies),
sections as (select doc_id, number, trim(split_part(trim(body), chr(10), 1)) as name,
  trim(regexp_extract(body, '(?s)\*\*Description\*\*:\s*(.+?)(?:\n\n|\*\*)', 1)) as description,
  array_to_string(list_concat(checks, list_filter(needs, lambda n: not list_contains(checks, n))), '|') as acceptance,
  array_to_string(files, '|') as files, body from lists),
subpieces as (select doc_id, number as feature, unnest(string_split(body, '##### ')[2:]) as sub from sections where number = 5),
subsections as (select doc_id, feature, regexp_extract(sub, '^([0-9]+\.[0-9]+) ', 1) as number,
  trim(regexp_extract(sub, '^[0-9]+\.[0-9]+ ([^\n]+)', 1)) as name,
  array_to_string(list_transform(list_filter(string_split(regexp_extract(sub,
    '\*\*Acceptance Criteria\*\*:\s*\n((?:- \[[x ]\][^\n]+\n)+)', 1), chr(10)), lambda l: l <> ''),
    lambda l: regexp_replace(l, '^- \[[x ]\]\s*', '')), '|') as acceptance,
  array_to_string(list_transform(list_filter(string_split(regexp_extract(sub,
    '\*\*Files\*\*:\s*\n((?:- `[^`]+`[^\n]*\n)+)', 1), chr(10)), lambda l: l <> ''),
    lambda l: regexp_replace(split_part(regexp_extract(l, '`([^`]+)`', 1), ' - ', 1), '\s*\([^)]+\)\s*$', '')), '|') as files
  from subpieces),
feature_lines as (select doc_id, unnest(regexp_extract_all(text, '\*\*Feature [0-9]+ [^\n]*→[^\n]*')) as line from plans_v),
story_texts as (select doc_id, cast(regexp_extract(line, 'Feature ([0-9]+)', 1) as int) as number,
  unnest(regexp_extract_all(line, 'STORY-[0-9]+: [^,(]+(?:\(depends: [^)]+\))?')) as story from feature_lines),
stories as (select doc_id, number, regexp_extract(story, '^STORY-[0-9]+') as id,
  trim(regexp_extract(story, '^STORY-[0-9]+: ([^,(]+)', 1)) as title,
  array_to_string(regexp_extract_all(regexp_extract(story, '\(depends: (.*)\)', 1), 'STORY-[0-9]+'), '|') as depends_on
  from story_texts),
matched as (select s.doc_id, s.number, s.id, s.title, b.number as subsection, b.name as subsection_name,
  b.acceptance, b.files from stories s join subsections b on b.doc_id = s.doc_id and b.feature = s.number and (
  (s.title ilike '%trivial%' and b.name ilike '%trivial%') or (s.title ilike '%statistical%' and b.name ilike '%statistical%')))"""


def _retries(attempts: str) -> str:
    return with_views(attempts) + f""",
marked as (select *, case when lag(story_id) over (order by seq) is distinct from story_id then 1 else 0 end as opens from {attempts}),
runs as (select *, sum(opens) over (order by seq) as run from marked)
select story_id, min(seq) as first_seq, count(*) as attempts, count(*) filter (is_retry) as retries,
  count(*) filter (is_retry) >= 3 as stopped from runs group by story_id, run"""


ORACLES = {
    "content_hash": _STORIES + f" select id, {_hash('title')} as content_hash from stories_v",
    "merge_new": _STORIES + f""",
old as (select *, {_hash('title')} as content_hash from stories_v where o_totalprice < 250000),
new as (select *, {_hash('upper(title)')} as content_hash from stories_v where o_orderdate >= '1996-01-01' or o_totalprice >= 250000)
select id, title, content_hash, 0::int as n_depends_on from old union all
select id, upper(title), content_hash, cast(coalesce(len(depends_on), 0) as int) from new where id not in (select id from old)""",
    "diff_by_hash": _STORIES + f""",
old as (select id, {_hash('title')} as h from stories_v where position % 11 <> 3),
new as (select id, case when passes then {_hash("upper(concat(title, '!'))")} else {_hash('title')} end as h
  from stories_v where position % 11 <> 5)
select coalesce(o.id, n.id) as id, case when o.id is null then 'added' when n.id is null then 'removed'
  when o.h = n.h then 'same' else 'changed' end as change from old o full join new n on o.id = n.id""",
    "ready_items": _READY + " select id, title from ready",
    "next_item": _READY + " select id, title from ready order by position limit 1",
    "apply_status": with_views("stories_v", "updates_v") + """,
latest as (select id, max(ts) filter (status) as t_on, max(ts) filter (not status) as t_off from updates_v group by id)
select s.id, case when l.id is null then passes else t_on is not null and (t_off is null or t_on >= t_off) end as passes,
  case when t_on is not null and (t_off is null or t_on >= t_off) then strftime(t_on, '%Y-%m-%dT%H:%M:%SZ') end as completed_at
from stories_v s left join latest l using (id)""",
    "progress_summary": _STORIES + """ select count(*) filter (passes) as passing, count(*) filter (not passes) as pending,
  count(*) as total from stories_v""",
    "phase_order": _phases(2, False),
    "phase_order_refactor": _phases(3, True),
    "lookback": with_views("work_log_v", "expected_files_v", "present_files_v") + """,
recent as (select * from (select *, row_number() over (partition by story_id order by seq desc) as n from work_log_v) where n <= 20),
marks as (select story_id, count(*) as n_recent, bool_or(marker = 'RED') as r, bool_or(marker = 'GREEN') as g
  from recent group by story_id),
wanted as (select story_id, unnest(files) as file from expected_files_v),
missing as (select story_id, count(*) as n_missing from wanted where file not in (select file from present_files_v) group by story_id),
judged as (select e.story_id, coalesce(n_recent, 0) as n_recent, coalesce(n_missing, 0) as n_missing,
  case when n_recent is null then 'no entries' when not r then 'no RED entry' when not g then 'no GREEN entry'
    when n_missing > 0 then 'files missing' end as reason
  from expected_files_v e left join marks using (story_id) left join missing using (story_id))
select story_id, n_recent, n_missing, reason is null as verified, reason from judged""",
    "phase_order_from_text": with_views("log_lines_v") + _LOGGED + """,
seen as (select story_id, count(*) as n_entries, max(seq) filter (r) as r, max(seq) filter (g) as g, max(seq) filter (f) as f from logged group by story_id),
judged as (select *, case when n_entries < 3 then 'expected at least 3 entries' when r is null or g is null then 'missing RED and/or GREEN'
  when f is null then 'missing REFACTOR' when r >= g then 'RED must come before GREEN' when f <= g then 'REFACTOR must come after GREEN' end as reason from seen)
select story_id, n_entries, reason is null as in_order, reason from judged""",
    "lookback_from_text": with_views("log_lines_v", "expected_files_v", "present_files_v") + _LOGGED + """,
recent as (select * from (select *, row_number() over (partition by story_id order by seq desc) as n from logged) where n <= 20),
marks as (select story_id, count(*) as n_recent, bool_or(r) as r, bool_or(g) as g from recent group by story_id),
stories as (select concat('STORY-', cast(story_id as string)) as story_id, files from expected_files_v),
missing as (select story_id, count(*) as n_missing from (select story_id, unnest(files) as file from stories)
  where file not in (select file from present_files_v) group by story_id),
judged as (select s.story_id, coalesce(n_recent, 0) as n_recent, coalesce(n_missing, 0) as n_missing,
  case when n_recent is null then 'no entries' when not r then 'no RED entry' when not g then 'no GREEN entry'
    when n_missing > 0 then 'files missing' end as reason
  from stories s left join marks using (story_id) left join missing using (story_id))
select story_id, n_recent, n_missing, reason is null as verified, reason from judged""",
    "retry_runs": _retries("attempts_v"),
    "retry_runs_sparse": _retries("sparse_attempts_v"),
    "phrase_table_hits": with_views("phrases_v") + r""",
p as (select distinct trim(regexp_replace(lower(phrase), '[\x20\x09-\x0D]+', ' ', 'g')) as phrase from phrases_v),
d as (select doc_id, concat(' ', trim(regexp_replace(lower(text), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') as t from documents)
select distinct doc_id, phrase from p, d where phrase <> '' and contains(t, concat(' ', phrase, ' '))""",
    "phrase_hits": r"""select doc_id, regexp_matches(text, '(?i)is functionally complete|already complete|work is already done|no further implementation.*required|already implemented|already present|was already|has been successfully completed|implementation.*already.*present') as reported_complete,
  regexp_matches(text, '(?i)all rights reserved|license|copyright') as names_license from documents""",
    "placeholders": with_views("services_v") + r"""
select distinct unnest(regexp_extract_all(env_text, '[$][{]([^}]+)[}]', 1)) as name from services_v order by 1""",
    "duplicates": with_views("services_v") + " select name, count(*) as n from services_v group by name having count(*) > 1",
    "exactly_one": with_views("services_v") + """ select s_suppkey, case when image is not null and external_id is not null
  then concat(name, ' has both ''image'' and ''external_id''')
  else concat(name, ' must have either ''image'' or ''external_id''') end as reason
from services_v where (image is null) = (external_id is null)""",
    "env_defaults": with_views("services_v") + """ select s_suppkey, case
  when image is not null then concat('PYTHONUNBUFFERED=1;BALANCE=', balance)
  else concat('PYTHONUNBUFFERED=', coalesce(external_id, '1')) end as environment from services_v""",
    "plan_sections": _PLANS + " select doc_id, number, name, description, acceptance, files from sections",
    "plan_subsections": _PLANS + " select doc_id, feature, number, name, acceptance, files from subsections",
    "plan_stories": _PLANS + " select doc_id, number, id, title, depends_on from stories",
    "keyword_match": _PLANS + " select doc_id, number, id, title, subsection, subsection_name from matched",
    "breakdown": _PLANS + """
select f.doc_id, coalesce(s.id, printf('STORY-%03d', f.number)) as id, coalesce(s.title, f.name) as title,
  case when s.id is null then f.description else concat(f.description, ' - ', s.title) end as description,
  coalesce(m.acceptance, f.acceptance) as acceptance, coalesce(m.files, f.files) as files,
  coalesce(s.depends_on, '') as depends_on
from sections f left join stories s on s.doc_id = f.doc_id and s.number = f.number
left join matched m on m.doc_id = s.doc_id and m.number = s.number and m.id = s.id
where s.id is not null or f.number > 2""",
    "overrides": with_views("stories_v", "overrides_v") + """
select s.id, coalesce(nullif(o.title, ''), s.title) as title,
  array_to_string(case when len(o.acceptance) > 0 then o.acceptance else s.acceptance end, '|') as acceptance
from stories_v s left join overrides_v o using (id)""",
}
