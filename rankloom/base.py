"""Session helpers shared by every operator: tables, lineage cuts and skew-safe lookups."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of `data_dir`."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; see `cut`."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            configured = tempfile.mkdtemp(prefix="rankloom-checkpoint-")
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        sc.setCheckpointDir(configured)
        held = sc._jsc.sc().getCheckpointDir()
    return held.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables beside the checkpoints, which all executors share."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder, so that lost executors cost no long recomputation.

    The folder is the cluster's spark.checkpoint.dir; only where that is unset and Spark runs on one machine (tests) a
    temporary one is made, which goes with the process. On a cluster without the setting this raises, as a machine's own
    folder would lose data.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cast_void(df: DataFrame) -> DataFrame:
    """Columns of the void type as strings, which every sink can store."""
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})


def lookup_skewed(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner", hot_keys: int = 512) -> DataFrame:
    """`left` joined with `right` (unique in `key`, with the number of left rows of each key in `weight`).

    A key that holds more than 1/hot_keys of the left rows is hot; there can be no more than `hot_keys` of them, so
    that part of `right` is broadcast whatever the data. All other keys are shuffled and hold a bounded share each.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    limit = max(10_000, total // hot_keys)
    hot = right.filter(F.col(weight) > limit)
    if hot.isEmpty():
        return left.join(right, key, how)
    mark = F.broadcast(hot.select(key).withColumn("__hot", F.lit(True)))
    tagged = left.join(mark, key, "left")
    warm = tagged.filter(F.col("__hot")).drop("__hot").join(F.broadcast(hot), key, how)
    cold = tagged.filter(F.col("__hot").isNull()).drop("__hot").join(right.filter(F.col(weight) <= limit), key, how)
    return warm.unionByName(cold)


def unit_hash(*cols: Column | str) -> Column:
    """A number in [0, 1) from a 64-bit hash of the columns; the same on every machine and in every run."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double")) / F.lit(float(1 << 53))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))
