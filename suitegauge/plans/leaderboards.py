"""Leaderboard queries over result documents made from runs and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from suitegauge.operators import leaderboard as board
from suitegauge.operators.scoring import to_envelope
from suitegauge.plans.scoring import OUTCOMES, summary

TOP = 3


def rows(spark, folder):
    # Boards read no task details, so the documents are made without them.
    return board.flatten_results(to_envelope(summary(spark, folder)))


def leaderboard_main(spark, folder):
    """The display form. Boards read document heads only; details belong to ``result_envelope``."""
    return board.main_board(rows(spark, folder))


def leaderboard_overall(spark, folder):
    return board.overall(rows(spark, folder))


def leaderboard_mutation(spark, folder):
    return board.by_mutation(rows(spark, folder))


def leaderboard_fault(spark, folder):
    return board.by_fault_detection(rows(spark, folder))


def leaderboard_tdd(spark, folder):
    return board.of_track(rows(spark, folder), "tdd")


def leaderboard_bdd(spark, folder):
    return board.of_track(rows(spark, folder), "bdd")


def leaderboard_passrate(spark, folder):
    return board.by_pass_rate(rows(spark, folder))


def leaderboard_topk(spark, folder):
    return board.top_k(rows(spark, folder), TOP)


def leaderboard_ranked(spark, folder):
    """With every participant whose name ends in 3 on no track."""
    return board.ranked(rows(spark, folder).withColumn("track", F.when(~F.col("id").endswith("3"), F.col("track"))))


QUERIES = {f.__name__: f for f in (
    leaderboard_main, leaderboard_overall, leaderboard_mutation, leaderboard_fault, leaderboard_tdd,
    leaderboard_bdd, leaderboard_passrate, leaderboard_topk, leaderboard_ranked)}

BOARD = OUTCOMES + """,
board as (select cast(participant as varchar) as id, track, round(score, 2) as score,
  round(mutation_score * 100, 1) as mutation_pct, round(fault_detection_rate * 100, 1) as fault_detection_pct,
  round(pass_rate, 1) as pass_rate, cast(task_count as int) as task_count from summary)
"""

ORACLES = {
    "leaderboard_main": BOARD + """select id, track as "Track", score as "Score", mutation_pct as "Mutation %",
  fault_detection_pct as "Fault Detection %", pass_rate as "Pass Rate", task_count as "# Tasks"
from board order by score desc, mutation_pct desc, id""",
    "leaderboard_overall": BOARD + """select id, track, score, mutation_pct, fault_detection_pct, pass_rate, task_count
from board order by score desc, mutation_pct desc, id""",
    "leaderboard_mutation": BOARD + """select id, track, mutation_pct, score, fault_detection_pct, task_count
from board order by mutation_pct desc, score desc, id""",
    "leaderboard_fault": BOARD + """select id, track, fault_detection_pct, score, mutation_pct, task_count
from board order by fault_detection_pct desc, score desc, id""",
    "leaderboard_tdd": BOARD + """select id, score, mutation_pct, fault_detection_pct, pass_rate, task_count
from board where track = 'tdd' order by score desc, mutation_pct desc, id""",
    "leaderboard_bdd": BOARD + """select id, score, mutation_pct, fault_detection_pct, pass_rate, task_count
from board where track = 'bdd' order by score desc, mutation_pct desc, id""",
    "leaderboard_passrate": BOARD + """select id, track, pass_rate, score, mutation_pct, task_count
from board order by pass_rate desc, score desc, id""",
    "leaderboard_topk": BOARD + f"""select * from (select *, cast(row_number() over (
  partition by track order by score desc, mutation_pct desc, id) as int) as rank from board) where rank <= {TOP}""",
    "leaderboard_ranked": BOARD + """select *, rank() over (
  partition by track order by score desc, mutation_pct desc) as rank
from (select * replace (case when id not like '%3' then track end as track) from board)""",
}
