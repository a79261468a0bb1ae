"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only where that is unset, as in
    local tests, a temporary folder is created and set as checkpoint folder; on a cluster that is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a checkpoint the columns can be read one by one, and nothing is assumed about how the rows lie.
    """
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(df: DataFrame, rows: int, each: int = 16, *by: str) -> DataFrame:
    """Deal out ``rows`` small rows that each stand for much work: a task has ``each`` of them at most, or fewer than a task's share.

    The number is given, so adaptive execution keeps it; by the size of the rows it would merge all of them into one task.
    With ``by``, groups stay together and ``each`` holds on average.
    """
    return df.repartition(max(1, min(rows, max(shuffle_partitions(df.sparkSession), -(-rows // each)))), *by)
