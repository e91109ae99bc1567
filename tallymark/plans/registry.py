"""Named queries over the given tables, each with the SQL that must give the same rows where SQL can say it."""
from ..sources.fixtures import Tables

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn
    return register
