"""The record shapes of the operators, derived from the data tables.

Each view is SQL that Spark and the checking engine read alike; ``{name}`` stands
for a table or for an earlier view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from suitegauge.sources.tables import SCHEMAS, table

# Participants, tasks of a run and runs all grow with the tables: five suppliers are a participant, eight parts
# a task of either track, as are seventy-five customers and sixty orders.
_TASK_COUNT = "(select cast(floor(max(p_partkey) / 8) as bigint) + 1 from {part})"

_TASK_ID = ("concat('task_', lpad(cast(p_partkey + 1 as string), "
            "cast(greatest(3, length(cast(p_partkey + 1 as string))) as int), '0'), '_', replace(p_name, ' ', '_'))")

_RUN_ID = "concat('run-', cast(p as string), '-', track, '-', cast(y as string))"

_RUN_PARTS = """cast(floor(l_suppkey / 5) as int) as p, case when l_partkey % 2 = 0 then 'tdd' else 'bdd' end as track,
          year(l_shipdate) as y, cast(floor(l_partkey / 8) as bigint) + 1 as ordinal,
          case when l_linestatus = 'F' then 'correct' else 'buggy' end as target,
          case l_returnflag when 'N' then 0 when 'R' then 1 else 2 end as exit_code,
          l_quantity >= 45 as timed_out, l_shipdate as ts"""

VIEWS: dict[str, str] = {
    # Task records.
    "tasks_v": """
        select p_partkey + 1 as ordinal, replace(p_name, ' ', '_') as function_name,
          case when p_type in ('PROMO', 'ECONOMY', 'SMALL') then 'tdd' else 'bdd' end as track,
          concat('def ', replace(p_name, ' ', '_'), '(x):', chr(10), '    \"\"\"', p_type, ' size.', chr(10),
                 '    >>> ', replace(p_name, ' ', '_'), '(', cast(p_size as string), ')', chr(10),
                 '    ', cast(p_size * 2 as string), chr(10),
                 case when p_partkey % 2 = 0
                   then concat('    >>> ', replace(p_name, ' ', '_'), '(0)', chr(10), '    0', chr(10)) else '' end,
                 '    \"\"\"', chr(10)) as prompt,
          case p_partkey % 4 when 0 then concat('    return True', chr(10), '    return True')
            when 1 then '    return False' when 2 then '    return x * 2' else '    pass' end as canonical_solution
        from {part}""",
    # Specs with strings where no docstring is, and the docstring that each has: in a header, above it, after it, inside, none.
    "specs_v": """
        select p_partkey, size, case kind
            when 0 then concat('def f(a,', chr(10), '      b={{1: "', p_name, ' (:"}}):  # "no"', chr(10), '    # first', chr(10), chr(10), '    \"\"\"', body, '\"\"\"', chr(10), '    return a')
            when 1 then concat('\"\"\"Of the module.', chr(10), 'def g():', chr(10), '    "no"', chr(10), '\"\"\"', chr(10), 'X = {{1: "v"}}', chr(10), 'def f(x) -> str:', chr(10), '    r\"\"\"', body, '\"\"\"')
            when 2 then concat('def f(x={{1: "v"}}):', chr(10), '    y = \"\"\"', body, '\"\"\"', chr(10), '    return {{"a": "', p_name, '"}}')
            when 3 then concat('def f(x): return x', chr(10), 'def g(x): "', p_name, '"  # so', chr(10), 'def h(x):', chr(10), '    \"\"\"', body, '\"\"\"')
            when 4 then concat('class C:', chr(10), '    def m(self):', chr(10), '        "', p_name, ' inside"', chr(10), chr(10), 'def f(x):', chr(10), '    \"\"\"', body, '\"\"\"')
            else concat('def f(x):', chr(10), '    "', p_name, '".join(x)', chr(10), 'def g(x):', chr(10), '    \"\"\"', body, '\"\"\"; return x') end as spec,
          case kind when 2 then '' when 3 then p_name else text end as doc, kind
        from (select p_partkey, p_name, p_size as size, p_partkey % 6 as kind,
          concat(p_type, ' size.', chr(10), chr(10), '      >>> f(', cast(p_size as string), ')', chr(10), '      2', chr(10), '    ', p_brand, chr(10), '    ') as body,
          concat(p_type, ' size.', chr(10), chr(10), '  >>> f(', cast(p_size as string), ')', chr(10), '  2', chr(10), p_brand) as text from {part})""",
    # Bug patterns of single tasks; some of them do not occur in their task.
    "patterns_v": f"""
        select {_TASK_ID} as task_id, 'return x * 2' as old, 'return x * 3' as new
        from {{part}} where p_size <= 10
        union all
        select {_TASK_ID} as task_id, 'return True' as old, 'return None' as new
        from {{part}} where p_size > 45""",
    # Task folders with parts missing.
    "folders_v": f"""
        select {_TASK_ID} as task, case when p_partkey % 2 = 0 then 'tdd' else 'bdd' end as track,
          concat('data/tasks/', {_TASK_ID}) as directory,
          case when p_size = 1 then null when p_size = 2 then 'not json'
            else concat('{{{{"function_name": "', replace(p_name, ' ', '_'), '"}}}}') end as metadata,
          case when p_size <> 3 then p_name end as spec,
          case when p_size <> 4 then p_brand end as correct,
          case when p_size <> 5 then p_type end as buggy
        from {{part}}""",
    # Name sources of differing completeness.
    "named_v": f"""
        select p_partkey,
          case when p_size % 3 = 0 then concat('{{{{"function_name": "m_', lower(p_type), '"}}}}')
            when p_size % 3 = 1 then '{{{{"track": "tdd"}}}}' end as metadata,
          case when p_size % 2 = 0 then concat('import re', chr(10), 'def s_', lower(p_type), '(x):', chr(10), '    pass')
            else 'x = 1' end as spec,
          case when p_size > 40 then 'task_007' else {_TASK_ID} end as directory
        from {{part}}""",
    # Test runs: participant, task, target, outcome.
    "runs_v": """
        select cast(floor(l_suppkey / 5) as int) as participant, l_partkey as task_num,
          case when l_partkey % 2 = 0 then 'tdd' else 'bdd' end as track,
          cast(floor(l_partkey / 8) as bigint) + 1 as ordinal,
          case when l_linestatus = 'F' then 'correct' else 'buggy' end as target,
          case l_returnflag when 'N' then 0 when 'R' then 1 else 2 end as exit_code,
          l_quantity >= 45 as timed_out, l_quantity / 10 as execution_time, l_shipdate as ts,
          l_orderkey * 10 + l_linenumber as run_id
        from {lineitem}""",
    # The same with runs on alternative correct code.
    "runs3_v": """
        select cast(floor(l_suppkey / 5) as int) as participant,
          case when l_partkey % 2 = 0 then 'tdd' else 'bdd' end as track,
          cast(floor(l_partkey / 8) as bigint) + 1 as ordinal,
          case when l_linestatus = 'F' then 'correct' when l_linenumber <= 3 then 'buggy' else 'alternative' end as target,
          case l_returnflag when 'N' then 0 when 'R' then 1 else 2 end as exit_code,
          l_quantity >= 45 as timed_out, l_shipdate as ts
        from {lineitem}""",
    # Who was evaluated on what, and over how many tasks.
    "evaluations_v": """
        select distinct cast(floor(s_suppkey / 5) as int) as participant, 'tdd' as track, %s as task_count
        from {supplier}
        union all
        select distinct cast(floor(s_suppkey / 5) as int) as participant, 'bdd' as track, %s - 1 as task_count
        from {supplier}""" % (_TASK_COUNT, _TASK_COUNT),
    # Mutation logs.
    "logs_v": """
        select cast(floor(o_custkey / 75) as int) as participant, o_orderkey as task_num, o_orderkey,
          case when o_orderkey % 2 = 0 then 'tdd' else 'bdd' end as track,
          cast(floor(o_orderkey / 60) as bigint) + 1 as ordinal,
          case o_orderkey % 4 when 0 then concat(cast(o_orderkey % 15 as string), '/12 mutants killed')
            when 1 then concat('Killed: ', cast(o_orderkey % 13 as string), chr(10),
                               'Survived: ', cast(o_orderkey % 5 as string))
            when 2 then concat('killed ', cast(o_orderkey % 13 as string)) else 'no summary' end as output,
          case when o_orderkey % 29 = 0 then 'mutation testing timed out' end as error
        from {orders}""",
    # Logs some of which claim more kills than mutants, or an unknown track.
    "odd_logs_v": """
        select o_orderkey, concat(cast(o_orderkey % 17 as string), '/12 mutants killed') as output,
          cast(null as string) as error,
          case when o_orderpriority = '5-LOW' then 'other' when o_orderkey % 2 = 0 then 'tdd' else 'bdd' end as track,
          cast(o_custkey % 7 as int) - 1 as task_count
        from {orders}""",
    # Four-class mutation summaries.
    "summaries_v": """
        select o_orderkey, concat('Mutants:', chr(10), '  - killed: ', cast(o_orderkey % 50 as string), ' (caught)', chr(10),
          '  - survived: ', cast(o_custkey % 7 as string), ' (missed)', chr(10),
          '  - suspicious: ', cast(o_orderkey % 3 as string), chr(10),
          '  - timeout: ', cast(o_custkey % 4 as string)) as summary
        from {orders}""",
    # Agent events.
    "agent_events_v": """
        select user_id as submission_id, event_id, ts,
          case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'submitted'
            else 'working' end as state,
          case when event_id % 7 = 0 then 0 else 1 end as n_artifacts, props
        from {events}""",
    # Parts of submissions.
    "submissions_v": """
        select conv_id as submission_id, turn as part_no,
          case when role = 'assistant' then 'text' else 'data' end as kind, text
        from {conversations}""",
    # Code as submitted: some without colon, import or test function.
    "code_v": """
        select p_partkey, case when p_partkey % 2 = 0 then 'tdd' else 'bdd' end as track,
          concat(case when p_size % 4 = 0 then 'import os' when p_partkey % 2 = 0 then 'import pytest'
                   else 'from pytest_bdd import given' end, chr(10),
                 'def ', case when p_size % 3 = 0 then 'check_' else 'test_' end, replace(p_name, ' ', '_'), '()',
                 case when p_size % 5 = 0 then '' else ':' end, chr(10), '    assert ', cast(p_size as string), ' > 0') as tests
        from {part}""",
    # Stories.
    "stories_v": """
        select o_orderkey as position, concat('STORY-', cast(o_orderkey as string)) as id,
          o_orderpriority as title, concat('for customer ', cast(o_custkey as string)) as description,
          array(o_orderpriority, concat('status ', o_orderstatus)) as acceptance,
          array(concat('src/', lower(o_orderstatus), '.py')) as files,
          o_orderstatus = 'F' as passes, cast(null as string) as completed_at,
          case when o_orderkey % 3 = 0 then null
            when o_orderkey % 3 = 1 then array(concat('STORY-', cast(o_orderkey - 1 as string)))
            else array(concat('STORY-', cast(o_orderkey - 2 as string)), concat('STORY-', cast(o_orderkey - 1 as string)))
          end as depends_on,
          o_orderdate, o_totalprice
        from {orders}""",
    # Status updates.
    "updates_v": """
        select concat('STORY-', cast(user_id as string)) as id, event_type = 'purchase' as status, ts
        from {events} where event_type in ('purchase', 'error')""",
    # Work log: markers, attempts.
    "work_log_v": """
        select user_id as story_id, event_id as seq, ts,
          case event_type when 'signup' then 'RED' when 'click' then 'GREEN' when 'purchase' then 'REFACTOR'
            when 'error' then 'FAIL' else 'OTHER' end as marker
        from {events}""",
    # Lines of work logs, 200 a log: entries with several markers, several stories, or none, markers elsewhere than in the message.
    "log_lines_v": """
        select cast(floor(event_id / 200) as bigint) as log, event_id as nth,
          concat(case when event_id % 23 = 0 then '[RED]' else concat('c', cast(event_id as string)) end, ' ',
            case event_type when 'signup' then '[RED] ' when 'click' then '[GREEN] ' when 'purchase' then '[REFACTOR] ' when 'error' then '[BLUE] '
              else 'red green ' end,
            case when event_id % 6 = 0 then '[GREEN] [GREEN] ' when event_id % 7 = 0 then '[RED] ' else '' end,
            case when event_id % 11 = 0 then 'chore' else concat('STORY-', cast(user_id as string), ': ', event_type) end,
            case when event_id % 5 = 0 then concat(' after STORY-', cast(user_id + 1 as string)) else '' end,
            case when event_id % 9 = 0 then concat(', NOSTORY-', cast(user_id + 2 as string)) else '' end) as line
        from {events}""",
    # Events in the lots they arrive in, eight days each: every fifth twelve hours behind its time, every hundred-and-first 25 days.
    "arrivals_v": """
        select user_id as submission_id, event_id, ts, props,
          case event_type when 'purchase' then 'completed' when 'error' then 'failed' when 'signup' then 'submitted' else 'working' end as state,
          case when event_id % 7 = 0 then 0 else 1 end as n_artifacts,
          cast(least(3, floor((dayofyear(ts) - 1
            + case when event_id % 101 = 0 then 25 when event_id % 5 = 0 and hour(ts) >= 12 then 1 else 0 end) / 8)) as int) as lot
        from {events}""",
    "attempts_v": """
        select event_type as story_id, event_id as seq, value < 50 as is_retry from {events}""",
    # Numbers far apart, from below zero on; stretches of one story are long, so that they cross blocks.
    "sparse_attempts_v": """
        select case when event_id % 97 = 0 then event_type when event_id % 500 < 300 then 'long' else cast(user_id % 3 as string) end as story_id,
          (event_id - 5000) * 1000003 as seq, value < 50 as is_retry from {events}""",
    # Lines of datasets and results, with what a reader makes of them: cut off, a list, without an id, an id without a number.
    "dataset_lines_v": """
        select replace(replace(case p_partkey % 7 when 0 then concat('<"task_id": "HumanEval/', cast(p_partkey as string), '", "entry_point": "', p_name)
            when 1 then concat('[', cast(p_partkey as string), ']')
            when 2 then concat('<"entry_point": "', p_name, '">')
            when 3 then concat('<"task_id": "Other/', cast(p_partkey as string), '", "entry_point": "', p_name, '">')
            else concat('<"task_id": "HumanEval/', cast(p_partkey as string), '", "entry_point": "', p_name, '", "more": 1>') end, '<', chr(123)), '>', chr(125)) as line,
          case when p_partkey % 7 > 3 then p_partkey end as n,
          case when p_partkey % 7 in (0, 1) then null else p_name end as entry_point,
          case when p_partkey % 7 < 3 then 'not a record' when p_partkey % 7 = 3 then 'no number in task_id' end as reason
        from {part}""",
    "result_lines_v": """
        select replace(replace(case s_suppkey % 4 when 0 then concat('<"participants": <"agent": "', s_name, '">, "results": [<"score"')
            when 1 then concat('<"participants": <"agent": "', s_name, '">, "results": [<"score": "high">]>')
            else concat('<"participants": <"agent": "', s_name, '">, "results": [<"score": 0.', cast(s_suppkey % 4 as string), '5>]>') end, '<', chr(123)), '>', chr(125)) as line,
          case s_suppkey % 4 when 2 then cast(0.25 as double) when 3 then cast(0.35 as double) end as score,
          case s_suppkey % 4 when 0 then 'not a result document' when 1 then 'score is not a number' end as reason
        from {supplier}""",
    # Expected and present files of stories.
    "expected_files_v": """
        select c_custkey as story_id,
          array(concat('src/m', cast(c_nationkey as string), '.py'), concat('tests/', c_mktsegment, '.py')) as files
        from {customer}""",
    "present_files_v": """
        select concat('src/m', cast(n_nationkey as string), '.py') as file from {nation} where n_regionkey <> 2
        union all select distinct concat('tests/', c_mktsegment, '.py') as file from {customer}""",
    # Service entries.
    "services_v": """
        select s_suppkey, concat('svc_', cast(s_nationkey as string)) as name,
          case when s_suppkey % 3 <> 0 then s_name end as image,
          case when s_suppkey % 2 = 0 then cast(s_suppkey as string) end as external_id,
          concat('KEY=$', chr(123), upper(s_name), chr(125), ' MODE=$', chr(123), 'MODE_',
                 cast(s_nationkey as string), chr(125)) as env_text,
          cast(s_acctbal as string) as balance
        from {supplier}""",
    # Planning documents: three features, one with subsections, and a story list.
    "plans_v": """
        select o_orderkey as doc_id, concat(
          '# Plan ', cast(o_orderkey as string), chr(10), chr(10),
          '#### Feature 2: Base ', o_orderpriority, chr(10), chr(10),
          '**Description**: Groundwork.', chr(10), chr(10), '---', chr(10),
          '#### Feature ', cast(3 + o_orderkey % 2 as string), ': Orders of ', o_orderstatus, chr(10), chr(10),
          '**Description**: Handle ', cast(o_custkey as string), ' well.', chr(10), chr(10),
          '**Acceptance Criteria**:', chr(10), '- [ ] Status ', o_orderstatus, chr(10), '- [x] Priority ', o_orderpriority, chr(10), chr(10),
          '**Technical Requirements**:', chr(10), '- Status ', o_orderstatus, chr(10), '- Fast', chr(10), chr(10),
          '**Files**:', chr(10), '- `src/', lower(o_orderstatus), '.py - main`', chr(10), '- `tests/t.py`', chr(10), chr(10),
          '#### Feature 5: Rigor', chr(10), chr(10), '**Description**: Be strict.', chr(10), chr(10),
          '##### 5.1 Trivial answers ', o_orderstatus, chr(10), '**Acceptance Criteria**:', chr(10), '- [ ] No trivial', chr(10), chr(10),
          '**Files**:', chr(10), '- `src/trivial.py` (extend)', chr(10), chr(10),
          '##### 5.2 Statistical tests', chr(10), '**Acceptance Criteria**:', chr(10), '- [ ] Wide', chr(10), '- [ ] ', o_orderpriority, chr(10), chr(10),
          '**Files**:', chr(10), '- `src/stat.py - new (CREATE)` x', chr(10), chr(10),
          '## Notes', chr(10), chr(10),
          'Story Breakdown - Phase 1 (3 stories total):', chr(10), chr(10),
          '- **Feature 3 (Orders)** → STORY-003: Take orders, STORY-004: Ship ', o_orderstatus,
          ' (depends: STORY-003, STORY-002)', chr(10),
          '- **Feature 5 (Rigor)** → STORY-005: Trivial guard, STORY-006: Statistical power (depends: STORY-005), STORY-007: Other',
          chr(10)) as text
        from {orders}""",
    # Evaluations with an identity: one a year for each participant and track, some by nobody, some failed, some still at work;
    # their test runs and mutation logs.
    "requests_v": f"""
        select {_RUN_ID} as run_id,
          case when p % 3 = 1 then '   ' else concat(' agent ', cast(p as string), chr(10)) end as requester, track, task_count, started,
          case when (p + y) % 5 <> 4 then ended end as ended,
          case when (p + y) % 7 = 3 then 'Scenario file not found' end as error
        from (select p, track, y, min(ts) as started, max(ts) as ended, max(ordinal) + 2 as task_count
          from (select {_RUN_PARTS} from {{lineitem}}) r group by p, track, y) g""",
    "requested_runs_v": f"""
        select {_RUN_ID} as run_id, ordinal, target, exit_code, timed_out, ts from (select {_RUN_PARTS} from {{lineitem}}) r""",
    "requested_logs_v": f"""
        select {_RUN_ID} as run_id, ordinal, concat(cast(l_orderkey % 14 as string), '/12 mutants killed') as output,
          case when l_orderkey % 31 = 0 then 'mutation testing timed out' end as error
        from (select {_RUN_PARTS}, l_orderkey, l_linenumber from {{lineitem}}) r where l_linenumber < 3""",
    # What tasks' folders hold.
    "tree_v": """
        select concat('task_', lpad(cast(p_partkey + 1 as string), 7, '0')) as task,
          case when p_type in ('PROMO', 'ECONOMY', 'SMALL') then 'tdd' else 'bdd' end as track,
          case when p_size <> 1 then concat('[', cast(p_partkey as string), ']') end as metadata,
          case when p_size <> 3 then concat('spec of ', p_name, chr(10), 'line two') end as spec,
          case when p_size <> 4 then p_brand end as correct,
          case when p_size % 10 = 5 then '' when p_size <> 6 then p_type end as buggy
        from {part}""",
    # Phrases: words 3 to 6 of every document, and the first three of conversations, in capitals; some of them are there many times.
    "phrases_v": """
        select regexp_extract(text, '^[^ ]+ [^ ]+ ([^ ]+ [^ ]+ [^ ]+ [^ ]+)', 1) as phrase from {documents}
        union all select upper(regexp_extract(text, '^([^ ]+ [^ ]+ [^ ]+)', 1)) as phrase from {conversations}
        union all select regexp_extract(text, '^[^ ]+ ([^ ]+)', 1) as phrase from {conversations}""",
    # Field overrides, some of them empty.
    "overrides_v": """
        select concat('STORY-', cast(c_custkey as string)) as id,
          case when c_nationkey % 2 = 0 then '' else c_name end as title,
          case when c_nationkey % 3 = 0 then array(c_mktsegment) else array() end as acceptance
        from {customer}""",
}

def _inputs(sql: str) -> list[str]:
    return [name for name in SCHEMAS if "{" + name + "}" in sql]


def view(spark: SparkSession, folder: str, name: str, deal_by: str | None = None) -> DataFrame:
    """A view by name. ``deal_by`` deals the input rows out by a column first: for views that make long texts of short
    rows, so that the work on the texts is spread while only the short rows travel.
    """
    sql = VIEWS[name]
    inputs = {t: table(spark, folder, t) for t in _inputs(sql)}
    if deal_by:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        inputs = {t: df.repartition(parts, deal_by) for t, df in inputs.items()}
    return spark.sql(sql, **inputs)


def with_views(*names: str) -> str:
    """The same views as the head of a checking query: ``with a as (...), b as (...)``."""
    parts = []
    for name in names:
        sql = VIEWS[name]
        body = sql.format(**{t: t for t in _inputs(sql)}).replace("array(", "list_value(")
        parts.append(f"{name} as ({body})")
    return "with " + ",\n".join(parts)
