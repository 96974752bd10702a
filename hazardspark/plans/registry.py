"""Queries with their SQL twins, over tables and views that both engines derive alike."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hazardspark.plans.views import TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WRITTEN_SQL: dict[str, str] = {}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Base tables and derived views of one data folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = re.sub(r"EPOCH\(", "unix_timestamp(", VIEWS[name])
                self._made[name] = self.spark.sql(text, **{n: getattr(self, n) for n in _names(text)})
        return self._made[name]


def twin(sql: str) -> str:
    """The SQL for DuckDB: views that it names become common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for n in _names(text):
            if n in VIEWS and n not in order:
                need(VIEWS[n])
                order.append(n)

    need(sql)
    plain = lambda text: re.sub(r"EPOCH\(", "epoch_s(", re.sub(r"\{(\w+)\}", r"\1", text))
    epoch = lambda text: re.sub(r"epoch_s\(((?:[^()]|\([^()]*\))*)\)", r"CAST(floor(epoch(\1)) AS BIGINT)", text)
    body = epoch(plain(sql)).strip().replace("\x01", "{").replace("\x02", "}")
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({epoch(plain(VIEWS[n]))})" for n in order)
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE):
        return f"WITH {m[1] or ''}{ctes},\n{body[m.end():]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None) -> Callable:
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name], WRITTEN_SQL[name] = twin(sql), sql
        return build

    return register
