"""Every driver query by name, with the SQL that must give the same rows."""

from arrears.plans import eval_queries, graph_queries, stage_queries, text_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (text_queries, graph_queries, eval_queries, stage_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
