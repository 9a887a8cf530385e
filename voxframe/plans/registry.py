"""Collects the registered queries and their SQL twins."""

from voxframe.plans.fixtures import load, oracle

QUERIES = {}
ORACLES = {}


class Source:
    """Lazy access to source tables and fixtures by attribute."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        return load(self.spark, self.sf_dir, name)


def query(name, uses="", sql=None):
    """Register ``fn(source)`` as a query; ``sql`` is the equivalent text."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle(uses, sql)
        return fn

    return wrap
