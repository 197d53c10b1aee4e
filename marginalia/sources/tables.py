"""Tables in the shared folder: results computed once, for jobs that read them several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where none is set, a temporary one if Spark runs in this process, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, without lineage and of a known size. ``discard`` removes it."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_path = path
    return back


def _at(spark: SparkSession, path: str):
    """The path and its file system, as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def finished(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path`` that a job has written to its end."""
    at, files = _at(spark, path)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if files.exists(_at(spark, f"{path}/{n}/_SUCCESS")[0]))


def remove(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.written_path)
