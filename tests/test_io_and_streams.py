import json
import sqlite3

import pytest
import zstandard
from pyspark.sql import functions as F

from rankloom.sources import io
from rankloom.streaming import judging


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    assert io.read_jsonl(spark, str(p), "a int", strict=False).filter("a IS NOT NULL").count() == 2
    with pytest.raises(Exception):
        io.read_jsonl(spark, str(p), "a int").collect()


def test_dumps_go_through_sparks_own_files(spark, tmp_path, monkeypatch):
    """No task opens a file; frames and files of a dump are those of the format, and are streamed where they are long."""
    import zstandard

    def no(*_):
        raise PermissionError("a task's own file")

    opened = io.opened
    monkeypatch.setattr(io, "opened", no)
    monkeypatch.setattr(io, "FRAME_BYTES", 500, raising=False)
    monkeypatch.setattr(io, "FRAMES", 2, raising=False)
    rows = spark.range(1000).selectExpr("id", "concat('täg\n', id) AS body", "CAST(NULL AS string) AS none").repartition(2)
    paths = io.write_zstd_jsonl(rows, str(tmp_path / "z"))
    assert len(paths) > 4 and all(p.endswith(".jsonl.zst") for p in paths)
    held = b"".join(zstandard.ZstdDecompressor().stream_reader(open(p, "rb"), read_across_frames=True).read() for p in paths)
    assert len(held.splitlines()) == 1000
    expected = sorted(rows.select("id", "body").collect())
    assert sorted(io.read_zstd_jsonl(spark, paths, "id long, body string").collect()) == expected
    monkeypatch.setattr(io, "opened", opened)
    monkeypatch.setattr(io, "WHOLE_BYTES", 1200)
    assert sorted(io.read_zstd_jsonl(spark, paths, "id long, body string").collect()) == expected


def test_zstd_dump(spark, tmp_path):
    paths = []
    for n in range(3):
        p = tmp_path / f"d{n}.zst"
        lines = "\n".join([*(json.dumps({"id": f"{n}-{i}", "body": "é" * i}) for i in range(50)), "{broken", ""])
        p.write_bytes(zstandard.ZstdCompressor().compress(lines.encode()))
        paths.append(str(p))
    df = io.read_zstd_jsonl(spark, paths, "id string, body string")
    assert df.count() == 150 and df.agg(F.max(F.length("body"))).first()[0] == 49


def test_tables_and_manifests(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "x,\n\"y\"")], "id int, l array<string>, t string")
    io.write_table(df, str(tmp_path), "t")
    assert io.read_table(spark, str(tmp_path), "t").first().l == ["a", "b"]
    assert io.read_csv(spark, str(tmp_path / "t_preview.csv")).first().t == 'x,\n"y"'
    io.write_jsonl(df, str(tmp_path / "j"))
    assert io.read_jsonl(spark, str(tmp_path / "j"), "id int, l array<string>, t string").count() == 1
    with pytest.raises(Exception):
        io.write_jsonl(df, str(tmp_path / "j"), create_only=True)
    io.write_csv(df, str(tmp_path / "c"), ["l", "id"])
    assert io.read_csv(spark, str(tmp_path / "c")).columns == ["l", "id"]
    io.write_manifest(str(tmp_path / "m.json"), {"b": 1, "a": 2})
    assert list(json.loads((tmp_path / "m.json").read_text())) == ["a", "b"]
    assert "| 1 |" in io.markdown_table(df.select("id"))
    with pytest.raises(FileNotFoundError):
        io.read_table(spark, str(tmp_path), "none")


def test_runs_of_many_shapes(spark):
    nested = spark.createDataFrame([("q", ["a", "b"], [0.5])], "query_id string, retrieved_titles array<string>, retrieved_scores array<double>")
    assert [(r.comment_id, r.rank, r.score) for r in io.nested_run(nested, "r").collect()] == [("a", 1, 0.5), ("b", 2, None)]
    odd = spark.createDataFrame([("q", "a", 2.0)], "qid string, cid string, raw_score double")
    assert io.tolerant_run(odd, "r").first()[1:] == ("q", "a", None, 2.0)
    ids = spark.createDataFrame([("", "p1"), ("q", "p2"), (None, None), ("q", "p3")], "query_id string, post_id string")
    assert {r.id for r in io.read_ids(ids).collect()} == {"p1", "q"}


def test_sqlite(spark, tmp_path):
    p = tmp_path / "r.db"
    with sqlite3.connect(p) as c:
        c.execute("create table t (id integer, s text)")
        c.executemany("insert into t values (?, ?)", [(i, f"s{i}") for i in range(25)])
    assert io.read_sqlite(spark, str(p), "select id, s from t", "id long, s string", batch=10).count() == 25


def test_judging_resumes_and_writes_once(spark, tmp_path):
    source, out, at = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    rows = lambda a, b: spark.createDataFrame([("q", f"c{i}") for i in range(a, b)], "query_id string, comment_id string")
    judge = lambda df: df.withColumn("utility", F.lit(3.0))
    rows(0, 5).coalesce(1).write.parquet(source)
    judging.append_new(judging.replay(spark, source), out, at, judging.PAIR, judge).awaitTermination()
    rows(3, 9).coalesce(1).write.mode("append").parquet(source)
    judging.append_new(judging.replay(spark, source), out, at, judging.PAIR, judge).awaitTermination()
    done = spark.read.parquet(out)
    assert done.count() == 9 == done.dropDuplicates(judging.PAIR).count()
    assert judging.pending(rows(0, 12), done).count() == 3


def test_payload_changes_are_seen(spark):
    a = judging.hashed(spark.createDataFrame([("q", "a", "x"), ("q", "b", None)], "query_id string, comment_id string, text string"), ["text"])
    b = judging.hashed(spark.createDataFrame([("q", "a", "y"), ("q", "b", None)], "query_id string, comment_id string, text string"), ["text"])
    assert [r.comment_id for r in judging.changed(b, a).collect()] == ["a"]


def test_windows_in_stream_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 {i % 5:02d}:30:00", "ab"[i % 2]) for i in range(40)], "id long, t string, kind string").select("id", F.to_timestamp("t").alias("ts"), "kind")
    events.write.parquet(str(tmp_path / "e"))
    q = judging.windowed_counts(judging.replay(spark, str(tmp_path / "e")), "ts", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = judging.windowed_counts(events, "ts", ["kind"])
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
    assert judging.gated(events, lambda a: a.count() > 99, lambda: events) is None


def test_vectors_by_position(spark, tmp_path):
    import numpy as np

    df = spark.createDataFrame([(f"v{i}", [float(i), 1.0]) for i in range(25)] + [(None, [1.0, 1.0]), ("n", None)], "id string, vec array<float>").repartition(3)
    paths = io.write_npy(df, str(tmp_path / "v"), "id", "vec")
    assert {r.id: list(r.vec) for r in io.read_npy(spark, paths, 2).collect()} == {f"v{i}": [float(i), 1.0] for i in range(25)}
    np.save(paths[0], np.zeros((1, 3), dtype=np.float32))
    with pytest.raises(Exception):
        io.read_npy(spark, paths, 2).collect()


def test_verified_tables_and_dumps(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(10).write.parquet(folder)
    manifest = io.file_digests(spark, folder)
    assert io.verified_parquet(spark, folder, manifest).count() == 10
    with pytest.raises(ValueError):
        io.verified_parquet(spark, folder, {**manifest, "part-more": "0"})
    rows = spark.createDataFrame([("a", "line\nend \u2028 “q”"), ("b", None)], "id string, body string")
    back = io.read_zstd_jsonl(spark, io.write_zstd_jsonl(rows.repartition(2), str(tmp_path / "z")), "id string, body string")
    assert sorted(back.collect()) == sorted(rows.collect()) and io.write_zstd_jsonl(rows.limit(0), str(tmp_path / "e")) == []


def test_no_machine_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from rankloom import base

    empty = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="yarn", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(RuntimeError):
        base._checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))
