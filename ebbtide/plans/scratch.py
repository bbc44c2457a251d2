"""Written intermediate tables, in the folder that driver and executors share.

A table written to ``spark.checkpoint.dir`` cuts the lineage, survives lost
executors and is read back with column pruning.  A folder is chosen here only
where a local session names none, as in tests; on a cluster none can be guessed.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new temporary one where a local session names none.

    Executors on other machines could not write to a folder chosen here, so a
    session that isn't local must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-ebbtide-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ebbtide-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    where, store = _place(spark, path)
    store.deleteOnExit(where)
    held = spark.read.schema(schema).parquet(path)
    held.written_to = path
    return held


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``materialize`` returned and nothing reads any more."""
    for table in tables:
        where, store = _place(table.sparkSession, table.written_to)
        store.delete(where, True)
