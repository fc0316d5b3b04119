"""Checks that stop a pipeline: each counts violations in one aggregation and raises with a few examples."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks a contract."""


def assert_none(violations: DataFrame, what: str, show: int = 3) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise ContractError(f"{what}: {violations.count()} rows, such as {[r.asDict() for r in rows]}")


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    assert_none(df.groupBy(*keys).count().filter("count > 1"), f"repeated {keys}")


def assert_present(df: DataFrame, columns: list[str]) -> None:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    assert_none(df.filter(bad), f"empty {columns}")


def assert_same_set(a: DataFrame, b: DataFrame, what: str) -> None:
    assert_none(a.distinct().exceptAll(b.distinct()), f"{what}: only left")
    assert_none(b.distinct().exceptAll(a.distinct()), f"{what}: only right")


def assert_disjoint(a: DataFrame, b: DataFrame, keys: list[str], what: str) -> None:
    assert_none(a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi"), what)


def run_violations(run: DataFrame, depth: int | None = None) -> DataFrame:
    """(route, query_id, n, items, low, high) of lists whose ranks are not 1 to n of different items (to depth, if set)."""
    t = run.groupBy("route", "query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("comment_id").alias("items"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("ranks"))
    bad = (F.col("items") != F.col("n")) | (F.col("ranks") != F.col("n")) | (F.col("low") != 1) | (F.col("high") != F.col("n"))
    return t.filter(bad | (F.col("n") != depth) if depth else bad).drop("ranks")


def finite(c: Column) -> Column:
    """As a double, null where it is no number, NaN or infinite."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def judgment_reasons(labels: list[str]) -> Column:
    """What a judgment lacks, joined by "|": ids, utility, labels of 1 to 7, provenance, status. Empty if complete."""
    low = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    parts = [F.when(low("query_id") | low("comment_id"), "identity"), F.when(finite(F.col("utility")).isNull(), "utility")]
    bad = F.lit(False)
    for c in labels:
        bad = bad | ~F.coalesce(F.col(c).between(1, 7), F.lit(False))
    parts += [F.when(bad, "labels"), F.when(low("judge_model"), "model"), F.when(low("judge_version"), "version"), F.when(F.coalesce(F.col("validation_status"), F.lit("")) != "ok", "status")]
    return F.concat_ws("|", *parts)


def forbidden_fields(schema: T.StructType, names: set[str], at: str = "") -> list[str]:
    """Paths of fields, however nested, whose names are forbidden."""
    out = []
    for f in schema.fields:
        path = f"{at}{f.name}"
        if f.name.lower() in names:
            out.append(path)
        kind = f.dataType
        while isinstance(kind, (T.ArrayType, T.MapType)):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType
        if isinstance(kind, T.StructType):
            out += forbidden_fields(kind, names, f"{path}.")
    return out


def file_digest(path: str) -> str:
    h = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def verify_artifact(df: DataFrame, path: str | None = None, digest: str | None = None, rows: int | None = None, ids: tuple[str, int] | None = None) -> None:
    """Raises unless the file's digest, the number of rows and the number of distinct ids are as locked."""
    if digest and file_digest(path) != digest:
        raise ContractError(f"{path} has another digest")
    if rows is not None and df.count() != rows:
        raise ContractError(f"{df.count()} rows, not {rows}")
    if ids and df.select(ids[0]).distinct().count() != ids[1]:
        raise ContractError(f"not {ids[1]} distinct {ids[0]}")


def fold_leaks(folds: DataFrame) -> DataFrame:
    """Items that are in training and validation of the same repeat and fold: rows (repeat, fold, query_id, role)."""
    return folds.groupBy("repeat", "fold", "query_id").agg(F.count_distinct("role").alias("roles")).filter("roles > 1")


def reject_path(path: str, words: tuple[str, ...] = ("test", "heldout")) -> str:
    if any(w in Path(path).name.lower() for w in words):
        raise ContractError(f"{path} looks like held-out material")
    return path
