"""All queries by name, with the SQL that checks them."""

from emberframe.plans import layer_queries, model_queries, source_queries, workflow_queries  # noqa: F401  (they register themselves)
from emberframe.plans.metric_queries import SQL, Q

QUERIES = dict(Q)
ORACLE_SQL = dict(SQL)
