"""All registered queries of the core and their SQL twins."""

from runefold.plans import engine, kv, problems

QUERIES = {**problems.QUERIES, **kv.QUERIES, **engine.QUERIES}
SQL = {**problems.SQL, **kv.SQL, **engine.SQL}
