"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillspark.scratch import delete_at_end, shared_root
from quillspark.shipping import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the standard tables; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, which cuts the lineage.

    The files outlive lost executors, and every later use reads one and the same set of rows. What discard() leaves goes when the application ends.
    """
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    delete_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialized_parts(df: DataFrame, name: str, column: str) -> str:
    """Write df to the shared folder, with a folder for each value of a column, to be read and deleted by itself; the path."""
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(column).parquet(path)
    delete_at_end(df.sparkSession, path)
    return path


def fold(key: str | Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    col = F.col(key) if isinstance(key, str) else key
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def ascii_lower(col: str | Column) -> Column:
    """A-Z to a-z; no other character changes."""
    return F.translate(col if isinstance(col, Column) else F.col(col), UPPER, LOWER)


def fresh(df: DataFrame | Iterable[str], *names: str) -> list[str]:
    """Column names that don't clash with those of df, compared without case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without its columns of these names, compared without case."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


def map_columns(df: DataFrame, fn, schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """Apply fn to lists of the columns of df, `rows` rows at a time; fn returns a list for each column of schema.

    Arrow carries the rows to Python and back; no more than one slice of one batch is held as Python objects.
    """
    ship_package(df.sparkSession)
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def map_arrays(df: DataFrame, fn, schema: str | T.StructType, rows: int = 512) -> DataFrame:
    """map_columns() with Arrow arrays in and out instead of lists."""
    ship_package(df.sparkSession)
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(*batch.slice(at, rows).columns)
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(out, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def with_fields(kept: DataFrame, more: str) -> T.StructType:
    """The columns of kept and then those of a DDL text, whatever the names."""
    return T.StructType([*kept.schema.fields, *T.StructType.fromDDL(more).fields])


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/quillspark/" in path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of frames that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
