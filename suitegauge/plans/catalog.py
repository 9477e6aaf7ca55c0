"""All named queries and their checks."""

from suitegauge.plans import backlog, documented, evaluations, leaderboards, preparation, scoring, submissions

_PARTS = (scoring, leaderboards, preparation, submissions, backlog, documented, evaluations)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
