"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from knotwork.session import ensure_checkpoint_dir

#: White space of the word definition used throughout: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read back.

    Cuts the lineage as a checkpoint does, but takes less disk and reads single columns. The folder, ``path`` if it is
    named, goes when the driver's Python ends.
    """
    path = path or scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder. What is written there goes when the driver's Python ends."""
    if not _made:
        atexit.register(_remove)
    _made.append((spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"))
    return _made[-1][1]


def settled(df: DataFrame) -> DataFrame:
    """``df`` stored, and the shuffle files of what led to it given back at once.

    With several executors the files of the last job were seen to stay until another job had run, so a job of one row
    follows before the collection.
    """
    done = stored(df)
    df.sparkSession.range(0, 1, 1, 1).collect()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ``scratch`` that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove() -> None:
    for spark, path in _made:
        try:
            removed(spark, path)
        except Exception:  # noqa: BLE001  the session has ended; its shared folder is the cluster's to clear
            return


def source_key(column: str = "source"):
    """A key that tells a null source from every text, and sorts by code point with null last."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column)))


def map_texts(df: DataFrame, carry: list[str], compute: Callable[[list], dict], schema: str, text: str = "text") -> DataFrame:
    """The ``carry`` columns of ``df`` as they are, and the columns that ``compute`` makes of a batch of texts.

    ``schema`` describes the columns of ``compute``. Texts of any length come whole; a batch has few rows, so that
    long ones do not add up.
    """
    kept = df.select(*[F.col(f"`{c}`") for c in carry], F.col(text).alias("_text"))
    made = df.sparkSession.createDataFrame([], schema).schema
    out = StructType([*kept.schema[: len(carry)], *made])
    from pyspark.sql.pandas.types import to_arrow_schema

    types = to_arrow_schema(made)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                columns = compute(part.column(part.num_columns - 1).to_pylist())
                arrays = part.columns[:-1] + [pa.array(columns[f.name], f.type) for f in types]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], *types.names])

    return kept.mapInArrow(scan, out)
