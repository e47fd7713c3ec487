"""What the corpus operators share: the common folder, materialised cuts, and passes over texts.

Results that are read more than once are written as Parquet below
``spark.checkpoint.dir``, the folder that the driver and all executors see. That
cuts the lineage, survives the loss of an executor and keeps only the columns
that are needed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.session import fresh_path

#: Rows in an Arrow batch, so that a worker holds a few MB of text at a time.
BATCH_ROWS = 1024


def prepare(spark: SparkSession, rows: int = BATCH_ROWS) -> SparkSession:
    """Keep Arrow batches of whole texts small; a smaller setting of the caller's stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    return spark


def forget(df: DataFrame) -> None:
    """Delete the files of a cut that no later step reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Narrow rows in a file, about, and the fewest files that a table is still written to by.
FILE_ROWS, FEWEST_FILES = 250_000, 8


def cut(df: DataFrame, name: str, most_rows: int | None = None, per_file: int = FILE_ROWS) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files.

    most_rows: a bound of its rows, if known; a small table then goes to a few files
    whatever the number of shuffle partitions. It never makes more of them.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(FEWEST_FILES, -(-most_rows // per_file)))
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    object.__setattr__(out, "_cut_path", path)
    return out


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow over single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def lower_ascii(text: Column | str) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
