"""Helpers for driver loops over DataFrames.

Each round is written to the shared checkpoint folder, so the plan stays short and a lost
executor costs a re-read. The driver sees one number per round.
"""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from knotwork.session import ensure_checkpoint_dir


#: Setting by which Spark deletes the shuffle files of a job when it ends, not when the driver collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def releasing(spark: SparkSession):
    """Jobs of frames made in here give their shuffle files back as soon as what they write is there."""
    before = spark.conf.get(RELEASE)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder. Its partitioning is kept.

    A checkpoint carries constraints on columns of the old plan, which a union right above it cannot resolve. The
    columns go by other names in it, so that the optimizer does not strip the projection that stands between them.
    """
    ensure_checkpoint_dir(df.sparkSession)
    inner = [f"c{i}" for i in range(len(df.columns))]
    with releasing(df.sparkSession):
        done = df.toDF(*inner).checkpoint(eager=True)
    named = done.select(*[done[i].alias(c) for i, c in zip(inner, df.columns)])
    named._checkpoint = done
    return named


def cut_counting(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """Checkpoint and read aggregate ``metrics`` of the same pass, without a second job."""
    seen = Observation()
    done = cut(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return done, seen.get


def forget(*done: DataFrame | None) -> None:
    """Delete the files of tables that ``cut`` or ``stored`` gave and that nothing reads any more; others are left alone."""
    for df in done:
        if getattr(df, "_folder", None) is not None:
            _delete(df.sparkSession, df._folder)
        kept = getattr(df, "_checkpoint", None)
        if kept is not None:
            file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                _delete(df.sparkSession, file.get())


def folder(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder; what is written there goes when the driver's Python ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder, where its partitioning is of no use: a tenth of a checkpoint's disk."""
    path = folder(df.sparkSession)
    with releasing(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    done = df.sparkSession.read.schema(df.schema).parquet(path)
    done._folder = path
    return done


def stored_counting(df: DataFrame, **metrics) -> tuple[DataFrame, dict]:
    """``stored`` and aggregate ``metrics`` of the same pass."""
    seen = Observation()
    done = stored(df.observe(seen, *[c.alias(n) for n, c in metrics.items()]))
    return done, seen.get


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``folder`` that nothing reads any more."""
    _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is None:
        return  # the session has ended; its shared folder is the cluster's to clear
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the one with the greatest ``order`` tuple.

    Written as an aggregate, so each map task sends one row per key and a hot key is no problem.
    """
    return _pick(df, keys, order, F.max_by)


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the one with the least ``order`` tuple."""
    return _pick(df, keys, order, F.min_by)


def _pick(df, keys, order, agg):
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*order)
    if not rest:
        return df.select(*keys).distinct()
    picked = df.groupBy(*keys).agg(agg(F.struct(*rest), by).alias("_row"))
    return picked.select(*[F.col(k) if k in keys else F.col(f"_row.`{k}`").alias(k) for k in df.columns])
