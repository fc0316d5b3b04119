"""Readers and writers of runs, judgments and dumps. Schemas are stated, never inferred."""

from __future__ import annotations

import contextlib
import io
import json
import re
import shutil
import sqlite3
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _located(path: str):
    """(file system, path in it) of a path as Spark writes it. A local name is taken as it stands, as Spark takes it: in a URI
    blanks and letters beyond ASCII are refused, "%" is decoded and what follows "#" or "?" is cut off."""
    from pyarrow import fs

    if local := re.fullmatch(r"(?:file://|file:(?!//))?(/.*)", path, re.DOTALL):
        return fs.LocalFileSystem(), local[1]
    for spark_name in ("s3a://", "s3n://"):
        path = path.replace(spark_name, "s3://", 1) if path.startswith(spark_name) else path
    return fs.FileSystem.from_uri(path)


def opened(path: str, mode: str = "rb"):
    """A file of any file system that pyarrow knows (local, HDFS, object stores), on the driver or in a task."""
    system, at = _located(path)
    if mode == "rb":
        return system.open_input_stream(at, compression=None)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(at, compression=None)


def _as_uri(path: str) -> str:
    """The path for Spark; a bare name is one of a local file, as for `opened`, whatever file system is Spark's default."""
    return f"file:{path}" if path.startswith("/") else path


def _spark_path(spark: SparkSession, path: str):
    """(Hadoop's file system, its path) of a path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_as_uri(path))
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Lines of JSON objects; strict raises on a broken line, else broken lines are left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


#: A zstd frame that readers skip. It stands after each frame of a dump that is written here, where Spark's text writer puts a line end.
_BETWEEN = "P*M\x18\b\0\0\0rankloom"
#: Bytes of JSON lines in a frame, and frames in a file, of a dump that is written here.
FRAME_BYTES, FRAMES = 4 << 20, 8
#: Dumps up to this size are read whole by Spark's file source, longer ones as a stream by pyarrow.
WHOLE_BYTES = 32 << 20


def read_zstd_jsonl(spark: SparkSession, paths: list[str], schema: str, window_log: int = 31) -> DataFrame:
    """Lines of zstd-compressed dumps, one task per file, streamed in blocks; broken lines are left out.

    The format cannot be split, so a dump should come as many files. Long windows are allowed as the dumps need them.
    Files of up to WHOLE_BYTES are fetched by Spark itself, so that no task needs rights or a file system of its own.
    """
    import pyspark.sql.types as T

    wanted = T._parse_datatype_string(schema)

    def lines_of(f) -> Iterator[pd.DataFrame]:
        import zstandard

        lines = io.TextIOWrapper(zstandard.ZstdDecompressor(max_window_size=1 << window_log).stream_reader(f, read_across_frames=True), encoding="utf-8", errors="replace")
        held: list[str] = []
        for line in lines:
            held.append(line.rstrip("\n"))
            if len(held) >= 10_000:
                yield pd.DataFrame({"value": held})
                held = []
        yield pd.DataFrame({"value": held})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b["content"]:
                yield from lines_of(io.BytesIO(content))

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                with opened(path) as f:
                    yield from lines_of(f)

    small, long = [], []
    for p in paths:
        system, at = _spark_path(spark, p)
        (small if system.getFileStatus(at).getLen() <= WHOLE_BYTES else long).append(p)
    lines = None
    if small:
        names = [re.sub(r"([\\{}\[\]*?])", r"\\\1", _as_uri(p)) for p in small]  # each is a name, not a pattern
        lines = spark.read.format("binaryFile").load(names).select("content").mapInPandas(whole, "value string")
    if long or not small:
        files = spark.createDataFrame([(p,) for p in long], "path string").repartition(max(1, len(long)))
        rest = files.mapInPandas(streamed, "value string")
        lines = rest if lines is None else lines.unionByName(rest)
    lines = lines.filter(F.trim("value").startswith("{"))
    parsed = lines.select(F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"), F.try_parse_json("value").isNotNull().alias("ok"))
    return parsed.filter("ok").select("r.*")


def write_zstd_jsonl(df: DataFrame, folder: str) -> list[str]:
    """Zstd-compressed files of JSON lines, one or more for each task that has rows; the paths.

    Tasks only compress. Spark's own writer stores the frames, so that the files have the rights and the file system of its
    other tables, and those of lost tasks go with them; the driver then gives them the names of a dump.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        held, size = [], 0
        for b in batches:
            for x in b["value"]:
                held.append(f"{x}\n".encode())
                size += len(held[-1])
                if size >= FRAME_BYTES:
                    yield pd.DataFrame({"frame": [zstandard.ZstdCompressor().compress(b"".join(held))]})
                    held, size = [], 0
        if held:
            yield pd.DataFrame({"frame": [zstandard.ZstdCompressor().compress(b"".join(held))]})

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    frames = lines.mapInPandas(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.mode("append").option("lineSep", _BETWEEN).option("compression", "none").option("maxRecordsPerFile", FRAMES).text(_as_uri(folder))
    system, at = _spark_path(df.sparkSession, folder)
    hadoop, names = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs, []
    for f in system.listStatus(at):
        name = f.getPath().getName()
        if name.startswith("part-") and name.endswith(".txt") and f.getLen():
            names.append(name.removesuffix("txt") + "jsonl.zst")
            if not system.rename(f.getPath(), hadoop.Path(at, names[-1])):
                raise OSError(f"{folder}/{name} cannot be renamed")
    return sorted(f"{folder}/{name}" for name in names)


def write_npy(df: DataFrame, folder: str, item: str, vector: str) -> list[str]:
    """Vectors as one .npy matrix for each task, and their ids in the same order beside it; the paths of the matrices."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            path = f"{folder}/part-{uuid.uuid4().hex}"
            both = pd.concat(parts)
            for end, values in (("npy", np.array(list(both[vector]), dtype=np.float32)), ("ids.npy", np.array(both[item].astype(str), dtype=np.str_))):
                with opened(f"{path}.{end}", "wb") as f:
                    held = io.BytesIO()
                    np.save(held, values)
                    f.write(held.getvalue())
            yield pd.DataFrame({"path": [f"{path}.npy"]})

    return sorted(r["path"] for r in df.select(item, vector).filter(F.col(item).isNotNull() & F.col(vector).isNotNull()).mapInPandas(run, "path string").collect())


def read_npy(spark: SparkSession, paths: list[str], width: int) -> DataFrame:
    """(id, vec) of matrices and the ids beside them, joined by position; another number of ids or columns raises."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                with opened(path) as f, opened(path.removesuffix(".npy") + ".ids.npy") as g:
                    m, ids = np.load(io.BytesIO(f.read())), np.load(io.BytesIO(g.read()))
                if m.shape != (len(ids), width):
                    raise ValueError(f"{path}: {m.shape} for {len(ids)} ids of width {width}")
                for at in range(0, len(ids), 10_000):
                    yield pd.DataFrame({"id": ids[at : at + 10_000], "vec": list(m[at : at + 10_000])})

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInPandas(run, "id string, vec array<float>")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, line_ends: bool = True) -> DataFrame:
    """Every field a string, quotes inside fields allowed. line_ends: also line ends, for which a file has to be read by
    one task; without them files are split."""
    df = spark.read.option("header", True).option("multiLine", line_ends).option("escape", '"').csv(path)
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, folder: str, stem: str) -> DataFrame:
    """The parquet table, else the whole CSV table, else its preview."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name, kind in ((f"{stem}.parquet", "parquet"), (f"{stem}.csv", "csv"), (f"{stem}_preview.csv", "csv")):
        path = hadoop.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(f"{folder}/{name}") if kind == "parquet" else read_csv(spark, f"{folder}/{name}")
    raise FileNotFoundError(f"{folder}/{stem}")


def read_ids(df: DataFrame, fields: tuple[str, ...] = ("query_id", "post_id")) -> DataFrame:
    """(id): distinct first non-empty of the fields that the table has."""
    have = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in fields if c in df.columns]
    return df.select(F.coalesce(*have, F.lit(None).cast("string")).alias("id")).filter("id IS NOT NULL").distinct()


def nested_run(df: DataFrame, route: str, query: str = "query_id", items: str = "retrieved_titles", scores: str = "retrieved_scores") -> DataFrame:
    """Arrays of items and scores as a flat run; the place in the array is the rank; shorter arrays give null."""
    each = df.select(F.lit(route).alias("route"), F.col(query).alias("query_id"), F.posexplode(F.arrays_zip(F.col(items).alias("i"), F.col(scores).alias("s"))).alias("pos", "x"))
    return each.select("route", "query_id", F.col("x.i").alias("comment_id"), (F.col("pos") + 1).alias("rank"), F.col("x.s").cast("double").alias("score"))


def tolerant_run(df: DataFrame, route: str) -> DataFrame:
    """A flat run from rows whose columns may be named in several ways; what is missing is null."""
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns], F.lit(None))
    return df.select(F.lit(route).alias("route"), pick("query_id", "qid", "id").cast("string").alias("query_id"), pick("comment_id", "cid", "candidate_id").cast("string").alias("comment_id"),
                     pick("rank", "rank_pos").cast("int").alias("rank"), F.coalesce(pick("score", "raw_score").cast("double"), F.lit(0.0)).alias("score"))


def read_sqlite(spark: SparkSession, path: str, query: str, schema: str, batch: int = 10_000) -> DataFrame:
    """The result of a query on a SQLite file of ratings; read in batches by one task, as the file has one reader.

    SQLite opens files of its own machine only, so the task first copies the file from wherever it lies."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            with tempfile.NamedTemporaryFile(suffix=".sqlite") as own:
                with opened(path) as f:
                    shutil.copyfileobj(f, own)
                own.flush()
                with contextlib.closing(sqlite3.connect(f"file:{own.name}?mode=ro", uri=True)) as c:
                    yield from pd.read_sql_query(query, c, chunksize=batch)

    return spark.range(1).mapInPandas(lambda it: run(it), schema)


def write_table(df: DataFrame, folder: str, stem: str, preview: int = 50) -> None:
    """Parquet and a CSV preview."""
    df.write.mode("overwrite").parquet(f"{folder}/{stem}.parquet")
    flat(df).limit(preview).coalesce(1).write.mode("overwrite").option("header", True).option("escape", "\"").csv(f"{folder}/{stem}_preview.csv")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, as CSV has no others."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])


def write_jsonl(df: DataFrame, path: str, create_only: bool = False) -> None:
    """Fields in the order of their names; create_only never replaces an earlier file."""
    df.select(*sorted(df.columns)).write.mode("errorifexists" if create_only else "overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str] | None = None) -> None:
    flat(df.select(*fields) if fields else df).write.mode("overwrite").option("header", True).option("escape", "\"").csv(path)


def write_manifest(path: str, value: dict) -> None:
    """One JSON document, sorted, written beside and then renamed."""
    with opened(f"{path}.part", "wb") as f:
        f.write((json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n").encode())
    system, at = _located(path)
    system.move(f"{at}.part", at)


def read_manifest(path: str) -> dict:
    with opened(path) as f:
        return json.loads(f.read())


def file_digests(spark: SparkSession, folder: str) -> dict[str, str]:
    """SHA-256 of every data file below a folder by its name; files are hashed in tasks, a row of a name and a digest each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return {r["name"]: r["digest"] for r in files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("digest")).collect()}


def verified_parquet(spark: SparkSession, folder: str, manifest: dict[str, str]) -> DataFrame:
    """The parquet table, only if its files are those of the manifest."""
    if (found := file_digests(spark, folder)) != manifest:
        raise ValueError(f"{folder}: {sorted(set(found.items()) ^ set(manifest.items()))[:3]} differ from the manifest")
    return spark.read.parquet(folder)


def write_dataset(df: DataFrame, folder: str, stem: str, order: str) -> None:
    """One table in the same order as CSV (nested columns as JSON text), JSON lines and parquet."""
    rows = df.repartitionByRange(order).sortWithinPartitions(order)
    write_csv(rows, f"{folder}/{stem}.csv")
    write_jsonl(rows, f"{folder}/{stem}.jsonl")
    rows.write.mode("overwrite").parquet(f"{folder}/{stem}.parquet")


def markdown_table(df: DataFrame, rows: int = 100, digits: int = 4) -> str:
    """A report of the first rows."""
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    body = [[show(v) for v in r] for r in df.limit(rows).collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *body])
