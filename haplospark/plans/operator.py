"""Relational operators as declarative SQL over named DataFrames.

An operator's text names its inputs in braces and its parameters as ``:name``.
It runs on any DataFrames through Catalyst; :func:`duck` renders the same plan
for another engine, which is how results are compared.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_INPUT = re.compile(r"\{(\w+)\}")
_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")
_IDIV = re.compile(r"IDIV\(([^|]*)\|([^)]*)\)")
_SERIES = re.compile(r"SERIES\[([^|\]]*)\|([^\]]*)\]")
_LAGG = re.compile(r"LAGG\(([^|]*)\|([^)]*)\)")


def render(sql: str, spark: bool) -> str:
    """IDIV(a|b) whole division, SERIES[a|b] a row for each whole number from a to b, LAGG(x|order) comma list, ELEM(array, 1-based); decimals are doubles."""
    sql = _DECIMAL.sub(r"\1e0", sql)
    sql = _IDIV.sub(r"((\1) div (\2))" if spark else r"((\1) // (\2))", sql)
    sql = _SERIES.sub(r"explode(sequence(\1, \2))" if spark else r"unnest(generate_series(\1, \2))", sql)
    sql = _LAGG.sub(r"listagg(CAST(\1 AS STRING), ',') WITHIN GROUP (ORDER BY \2)" if spark else r"string_agg(CAST(\1 AS STRING), ',' ORDER BY \2)", sql)
    return sql.replace("ELEM(", "element_at(" if spark else "list_extract(")


@dataclass(frozen=True)
class Operator:
    name: str
    sql: str
    out: str  #: result columns, "name type, ..."; types long, int, double, string
    params: dict = field(default_factory=dict)
    spark: str | Callable[..., DataFrame] | None = None  #: the plan on Spark where it is another than the comparison's: a text, or a function of the session, the frames and the parameters (with ``rounded``: its rows are final)

    @property
    def inputs(self) -> list[str]:
        return list(dict.fromkeys(_INPUT.findall(self.sql + (self.spark if isinstance(self.spark, str) else ""))))

    def text(self, params: dict | None = None, spark: bool = False) -> str:
        sql = self.spark if spark and isinstance(self.spark, str) else self.sql
        for k, v in sorted((self.params | (params or {})).items(), key=lambda x: -len(x[0])):
            sql = re.sub(rf":{k}\b", repr(v), sql)
        cols = []
        for c in self.out.split(", "):
            name, kind = c.split()
            cast = {"long": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "STRING"}[kind]
            cols.append(f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}" if kind == "double" else f"CAST({name} AS {cast}) AS {name}")
        return f"SELECT {', '.join(cols)} FROM ({sql}) AS body"

    def run(self, spark: SparkSession, frames: dict[str, DataFrame], **params) -> DataFrame:
        """Apply to DataFrames named as the operator's inputs."""
        if callable(self.spark):
            made = self.spark(spark, frames, **self.params | params)
            return made if getattr(self.spark, "rounded", False) else Operator(self.name, "SELECT * FROM {made}", self.out).run(spark, {"made": made})
        return spark.sql(render(self.text(params, True), True), **{k: frames[k] for k in self.inputs})


REGISTRY: dict[str, Operator] = {}


def define(name: str, out: str, sql: str, spark: str | Callable[..., DataFrame] | None = None, **params) -> Operator:
    op = REGISTRY[name] = Operator(name, sql.strip(), " ".join(out.split()), params, spark)
    return op
