"""Plugins as table functions: each gives rows for one query, and all are called laterally for a table of queries.

A plugin is a SQL table function, whose body the optimizer sees through, or a Python class with eval(query) that yields
rows.  The answers of all plugins to all queries are one plan: no query is sent by itself.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANSWER = "id string, title string, score double"


@dataclass
class Plugins:
    """Table functions of one query by name, registered in a session."""

    spark: SparkSession
    known: dict[str, str] = field(default_factory=dict)

    def register_sql(self, name: str, body: str) -> None:
        """body: a SELECT of (id, title, score) that may use the parameter query."""
        function = f"plugin_{name}_{uuid.uuid4().hex[:8]}"
        self.spark.sql(f"CREATE TEMPORARY FUNCTION {function}(query STRING) RETURNS TABLE ({ANSWER}) RETURN {body}")
        self.known[name] = function

    def register_class(self, name: str, plugin: type) -> None:
        """plugin: a class with eval(self, query) that yields (id, title, score)."""
        function = f"plugin_{name}_{uuid.uuid4().hex[:8]}"
        self.spark.udtf.register(function, F.udtf(plugin, returnType=ANSWER))
        self.known[name] = function

    def answers(self, queries: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
        """(query, plugin_id, id, title, score): what each plugin gives for each distinct query of the column query."""
        asked = queries.select("query").distinct()
        parts = [
            self.spark.sql(f"SELECT q.query, '{name}' AS plugin_id, a.id, a.title, a.score FROM {{asked}} AS q, LATERAL {function}(q.query) AS a", asked=asked)
            for name, function in self.known.items()
            if name not in disabled
        ]
        if not parts:
            raise ValueError("no plugin can answer")
        return reduce(DataFrame.unionByName, parts)
