"""Sinks.  Tables stay distributed; only documents of bounded size pass through the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path) if by else df.write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """Arrays and structs as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def json_safe(df: DataFrame) -> DataFrame:
    """``df`` with NaN and infinite numbers as null."""
    return df.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})


def json_document(df: DataFrame, path: str, most: int = 10_000) -> None:
    """A small result as one indented JSON list; more than ``most`` rows are an error."""
    rows = json_safe(df).limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows; write them as a table")
    Path(path).write_text(json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False), encoding="utf-8")


def run_summary(path: str, parameters: dict, tables: dict[str, DataFrame], **results) -> dict:
    """A run's parameters, the rows of its tables, and further results, as one JSON document; returns it."""
    document = {"parameters": parameters, "rows": {name: df.count() for name, df in tables.items()}, **results}
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False, default=str), encoding="utf-8")
    return document


def records(df: DataFrame, columns: list[str], scores: list[str]) -> DataFrame:
    """The columns and those of the scores that ``df`` has."""
    return df.select(*columns, *[c for c in scores if c in df.columns])


def text_report(sections: dict[str, DataFrame], path: str, most: int = 10_000) -> None:
    """Sections of a text report, each a table; one of more than ``most`` rows is an error."""
    out = []
    for title, df in sections.items():
        rows = df.limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{title}: more than {most} rows; write them as a table")
        out += [title, "-" * max(len(title), 8), "  ".join(df.columns), *["  ".join("" if v is None else str(v) for v in r) for r in rows], ""]
    Path(path).write_text("\n".join(out), encoding="utf-8")
