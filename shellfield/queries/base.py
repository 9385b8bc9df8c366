"""Registration of queries together with their SQL checks."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries = {}
        self.oracles = {}

    def query(self, name: str, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql:
                self.oracles[name] = sql
            return fn

        return keep


def plain_names(df):
    """Dots in column names replaced, so that results need no back-quotes."""
    return df.toDF(*[c.replace(".", "_") for c in df.columns])
