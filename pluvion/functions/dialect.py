"""SQL builders speak two dialects: Spark's, which runs, and DuckDB's, which checks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..storage import materialise


class Spark:
    name = "spark"

    def hour_index(self, ts: str) -> str:
        return f"CAST(FLOOR(unix_timestamp({ts}) / 3600) AS BIGINT)"

    def series(self, low: str, high: str) -> str:
        """In a SELECT list: a row for each integer from low to high."""
        return f"explode(sequence({low}, {high}))"

    def percentile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def last_value(self, x: str, window: str) -> str:
        return f"last_value({x}) IGNORE NULLS OVER ({window})"

    def first_value(self, x: str, window: str) -> str:
        return f"first_value({x}) IGNORE NULLS OVER ({window})"

    def list_sorted(self, x: str) -> str:
        return f"array_join(array_sort(collect_set(CAST({x} AS STRING))), ';')"

    def number(self, text: str) -> str:
        return f"try_cast({text} AS DOUBLE)"

    def extract(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    def timestamp(self, text: str, formats: tuple[str, ...]) -> str:
        return "coalesce(" + ", ".join(f'try_to_timestamp({text}, "{f}")' for f in formats) + ")"

    def round_even(self, x: str) -> str:
        return f"rint({x})"

    def values(self, rows: str, columns: str) -> str:
        return f"SELECT * FROM VALUES {rows} AS v({columns})"


class DuckDB(Spark):
    name = "duckdb"

    def hour_index(self, ts: str) -> str:
        return f"CAST(FLOOR(epoch({ts}) / 3600) AS BIGINT)"

    def series(self, low: str, high: str) -> str:
        return f"unnest(generate_series({low}, {high}))"

    def percentile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def last_value(self, x: str, window: str) -> str:
        return f"last_value({x} IGNORE NULLS) OVER ({window})"

    def first_value(self, x: str, window: str) -> str:
        return f"first_value({x} IGNORE NULLS) OVER ({window})"

    def list_sorted(self, x: str) -> str:
        return f"array_to_string(list_sort(list_distinct(list(CAST({x} AS VARCHAR)))), ';')"

    def extract(self, text: str, pattern: str, group: int) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    def timestamp(self, text: str, formats: tuple[str, ...]) -> str:
        turn = {"yyyy": "%Y", "MM": "%m", "dd": "%d", "HH": "%H", "mm": "%M", "ss": "%S", "'T'": "T"}
        out = []
        for f in formats:
            for a, b in turn.items():
                f = f.replace(a, b)
            out.append(f"try_strptime({text}, '{f}')")
        return "coalesce(" + ", ".join(out) + ")"

    def round_even(self, x: str) -> str:
        return f"round_even({x}, 0)"

    def values(self, rows: str, columns: str) -> str:
        return f"SELECT * FROM (VALUES {rows}) AS v({columns})"


SPARK, DUCKDB = Spark(), DuckDB()
Builder = Callable[[Spark], str]


#: After "AS (" of a table expression: where Spark's later ones use it more than once, it is written to the shared folder
#: and read, as Spark would otherwise work it out anew at each use.
KEEP = "/*keep*/"


def expressions(text: str) -> tuple[list[tuple[str, str]], str]:
    """(name, body) of the table expressions of "WITH name AS (body), ... SELECT", and the last SELECT."""
    if not text.startswith("WITH "):
        return [], text
    found, at = [], len("WITH ")
    while True:
        name, _, _ = text[at:].partition(" AS (")
        start = at = at + len(name) + len(" AS (")
        depth, quote = 1, ""
        while depth:
            c = text[at]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            at += 1
        found.append((name.strip(), text[start : at - 1]))
        rest = text[at:].lstrip()
        at = len(text) - len(rest)
        if not rest.startswith(","):
            return found, rest
        at += 1


def frame(spark: SparkSession, builder: Builder, **tables: DataFrame) -> DataFrame:
    """Run a builder's SQL; ``{name}`` in it stands for the table of that name."""
    text = builder(SPARK)
    if KEEP not in text:
        return spark.sql(text, **tables)
    found, last = expressions(text)
    uses = lambda name, body: len(re.findall(rf"(?:FROM|JOIN) {name}\b", body))
    done: list[tuple[str, str]] = []

    def run(query: str) -> DataFrame:
        needed, wanted = [], query
        for name, body in reversed(done):
            if uses(name, wanted):
                needed.insert(0, f"{name} AS ({body})")
                wanted += " " + body
        return spark.sql(("WITH " + ",\n".join(needed) + "\n" if needed else "") + query, **{k: v for k, v in tables.items() if "{" + k + "}" in wanted})

    for i, (name, body) in enumerate(found):
        later = sum(uses(name, b) for _, b in found[i + 1 :]) + uses(name, last)
        if body.startswith(KEEP) and later > 1:
            tables[f"kept_{name}"] = materialise(run(body), f"plan-{name}")
            body = f"SELECT * FROM {{kept_{name}}}"
        done.append((name, body))
    return run(last)


def pmod(a: str, n: str) -> str:
    return f"((({a}) % {n}) + {n}) % {n}"
