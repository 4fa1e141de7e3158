"""All registered queries outside the llm subpackage, and their SQL."""

from stratalens.plans import facts, graphs, ingest, runtime, scores, upkeep

FLAGSHIP = "p2_found"
PARTS = (upkeep, graphs, scores, runtime, facts, ingest)
QUERIES = {name: q for part in PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in PARTS for name, q in part.SQL.items()}
