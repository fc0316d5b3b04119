"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import numpy as np
import pandas as pd
import pytest

from rankloom.plans import catalog

DATA = os.environ.get("RANKLOOM_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, float, np.number, Decimal)):
        return None if math.isnan(float(v)) else round(float(v), 5)
    return str(pd.Timestamp(v)) if isinstance(v, datetime.datetime) else str(v)


def rows(data, columns):
    order = np.argsort(columns)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    found = con.execute(catalog.ORACLE[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert catalog.FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
    assert catalog.QUERIES[catalog.FLAGSHIP](spark, DATA).count() > 0


def test_seed_distances_walk_three_hops_from_every_seed(spark):
    from rankloom.plans import tables as t

    near = {}
    for r in t.comments(spark, DATA).filter("parent_id IS NOT NULL").select("comment_id", "parent_id").collect():
        near.setdefault(f"t1_{r.comment_id}", set()).add(r.parent_id)
        near.setdefault(r.parent_id, set()).add(f"t1_{r.comment_id}")
    expected = {}
    for p in t.pool(spark, DATA).collect():
        distance = front = {f"t1_{p.comment_id}": 0}
        for hop in range(1, 4):
            front = {b: hop for a in front for b in near.get(a, ()) if b not in distance}
            distance = distance | front
        for node, n in distance.items():
            seeds, least, weighted = expected.get((p.query_id, node), (0, 9, 0.0))
            expected[p.query_id, node] = seeds + 1, min(least, n), weighted + max(p.sbert or 0.0, 0.0) / (1 + n)
    found = {(r.query_id, r.node): (r.seeds, r.distance, r.weighted) for r in catalog.QUERIES["g43_seed_distances"](spark, DATA).collect()}
    assert found.keys() == expected.keys() and max(r[1] for r in found.values()) == 3
    assert all(found[k][:2] == v[:2] and math.isclose(found[k][2], v[2], abs_tol=1e-5) for k, v in expected.items())


def test_redaction_covers_all_comments(spark, tmp_path):
    import hashlib
    import re

    steps = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"https?://[^\s)\]>]+", "[URL]"), (r"(?i)(?<![\w/])/?u/[A-Za-z0-9_-]+", "[USER]"), (r"(?i)(?<![\w/])/?r/[A-Za-z0-9_]+", "[COMMUNITY]"), (r"(?<!\d)\+?\d(?:[ ().-]{0,2}\d){6,14}(?!\d)", "[NUMBER]")]
    texts = ["thanks u/some-one", "see /R/adhd and and/r/x", "call +49 (30) 123-4567 now", "in 2024 and 12 3", "a@b.org u/a r/b https://x.org/r/y 555 123 4567", "", "plain"]
    stored = spark.read.parquet(f"{DATA}/comments.parquet")
    names = [r[0] for r in stored.select("comment_id").distinct().orderBy("comment_id").limit(len(texts)).collect()]
    made = spark.createDataFrame(list(zip(names, texts)), "comment_id string, new string")
    one = stored.filter(stored.comment_id.isin(names)).dropDuplicates(["comment_id"]).join(made, "comment_id")
    one.withColumn("comment_text", one.new).select(*stored.columns).write.parquet(f"{tmp_path}/comments.parquet")
    for d in (str(tmp_path), DATA):
        from rankloom.plans import tables as t

        expected = {}
        for r in t.comments(spark, d).filter("comment_text IS NOT NULL").collect():
            x = r.comment_text
            for pattern, placeholder in steps:
                x = re.sub(pattern, placeholder, x, flags=re.A)
            expected[r.comment_id] = hashlib.sha256(x.encode()).hexdigest()
        assert {r.comment_id: r.digest for r in catalog.QUERIES["g49_redaction"](spark, d).collect()} == expected
        assert d == DATA or len(expected) == len(texts)


def test_median_on_a_tie_is_rounded_without_noise(spark, monkeypatch):
    from rankloom.plans import audit_queries

    rows = spark.createDataFrame([("k", q, v) for q, v in (("a", -0.12925), ("b", -0.08337499999999), ("c", -0.1292500000000003), ("d", -0.0833749999999995))], "key string, query_id string, delta double")
    assert -0.1063125 < (-0.12925 - 0.08337499999999) / 2
    monkeypatch.setattr(audit_queries, "over_base", lambda spark, d: rows)
    assert catalog.QUERIES["o96_paired_summary"](spark, DATA).first().median == -0.106313


def test_rated_cards_on_a_cluster(spark, con, monkeypatch):
    import tempfile

    from rankloom.base import shared_folder

    shared_folder(spark, "x")  # the checkpoint folder is set, as on a cluster
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(tempfile, "mkdtemp", lambda *a, **k: pytest.fail("a folder of the driver's machine"))
    name = "a15_rated_cards"
    assert rows([tuple(r) for r in catalog.QUERIES[name](spark, DATA).collect()], ["split_name", "cards", "answerable", "chars"]) == rows(con.execute(f"SELECT split_name, cards, answerable, chars FROM ({catalog.ORACLE[name]})").fetchall(), ["split_name", "cards", "answerable", "chars"])


def test_walk_trace_reads_comments_once(spark, monkeypatch):
    from rankloom.operators import graph

    plans, walk = [], graph.pagerank
    monkeypatch.setattr(graph, "pagerank", lambda e, s, *rest: plans.extend(x._jdf.queryExecution().toString().lower() for x in (e, s)) or walk(e, s, *rest))
    catalog.QUERIES["o84_walk_trace"](spark, DATA)
    assert len(plans) == 2 and not any("parquet" in p for p in plans)


@pytest.mark.parametrize("name", ["a1_dump_of_comments", "a3_wanted_threads"])
def test_dumps_have_the_rights_of_spark_folders(spark, con, tmp_path, monkeypatch, name):
    """Executors of several users write into one folder and read each other's files."""
    from rankloom.plans import scan_queries

    conf, folder = spark.sparkContext._jsc.hadoopConfiguration(), tmp_path / "dump"
    monkeypatch.setattr(scan_queries, "shared_folder", lambda spark, name: f"file:{folder}")
    conf.set("fs.permissions.umask-mode", "000")
    conf.set("fs.file.impl.disable.cache", "true")
    try:
        found = catalog.QUERIES[name](spark, DATA)
    finally:
        conf.unset("fs.permissions.umask-mode")
        conf.unset("fs.file.impl.disable.cache")
    assert {oct(p.stat().st_mode & 0o777) for p in folder.glob("part-*.zst")} == {"0o666"} and oct(folder.stat().st_mode & 0o777) == "0o777"
    expected = con.execute(catalog.ORACLE[name])
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(expected.fetchall(), [c[0] for c in expected.description])


@pytest.mark.parametrize("name", ["of a day", "50%25", "no#1", "why?", "[täg]"])
def test_wanted_threads_in_a_folder_of_any_name(spark, con, tmp_path, monkeypatch, name):
    from rankloom.plans import scan_queries

    folder = tmp_path / name / "dump"
    monkeypatch.setattr(scan_queries, "shared_folder", lambda spark, name: f"file:{folder}")
    monkeypatch.setattr(scan_queries, "table", lambda spark, d, name, table=scan_queries.table: table(spark, d, name).repartition(3))
    found = catalog.QUERIES["a3_wanted_threads"](spark, DATA)
    assert [p.name for p in tmp_path.iterdir()] == [name] and len([*folder.glob("part-*.zst")]) == 3
    expected = con.execute(catalog.ORACLE["a3_wanted_threads"])
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(expected.fetchall(), [c[0] for c in expected.description])


def test_wanted_threads_open_no_file_in_tasks(spark, con, monkeypatch):
    """Spark stores and fetches the dump, so that tasks need no rights in the shared folder beyond those of Spark."""
    from rankloom.plans import scan_queries

    def no(*_):
        raise PermissionError("a task's own file")

    monkeypatch.setattr(scan_queries.io, "opened", no)
    found = catalog.QUERIES["a3_wanted_threads"](spark, DATA)
    expected = con.execute(catalog.ORACLE["a3_wanted_threads"])
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(expected.fetchall(), [c[0] for c in expected.description])
