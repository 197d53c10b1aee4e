"""What the operators share: table access, batch sizes, checkpoints and bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes and rows of one Arrow batch handed to a Python worker; the bytes hold whatever a row's length.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000
#: A key with over one in HOT_KEYS of the rows, and over HOT_ROWS, is handled apart.
HOT_KEYS, HOT_ROWS = 10_000, 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by bytes, so that long texts need no other setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where none is set, a temporary one if Spark runs in this process, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, without lineage. ``discard`` removes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_path", None):
            spark = df.sparkSession
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left_semi) of ``rows`` and ``keyed``, which has a row for each key and in ``n`` its number of rows, all together ``total`` at most.

    Keys of over one in HOT_KEYS of the rows, and over HOT_ROWS, are broadcast, so that
    none of them lands in one task; others are shuffled. As counts of more than
    HOT_KEYS such keys would add up to over ``total``, the broadcast is bounded.
    """
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    few = F.broadcast(keyed.where(hot).drop("n"))
    rest = rows.join(F.broadcast(keyed.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys, how).unionByName(rest.join(keyed.where(~hot).drop("n"), keys, how))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clean(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and text, under fixed names: columns beside them can't clash with an operator's own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def crc_fold(col) -> F.Column:
    """Remainder that puts a document into a fold: crc32 of the id as text, modulo 5."""
    return F.crc32(col.cast("string")) % 5
