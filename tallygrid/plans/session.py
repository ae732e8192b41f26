"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallygrid")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; make one only for a local master that names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


#: Rows of a table for each partition that a shuffle of it starts from, and the bytes that adaptive execution puts together.
ROWS_A_TASK, BYTES_A_TASK = 500_000, 16 << 20
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def room_for(table: DataFrame) -> DataFrame:
    """The table, after the session's shuffles have been given enough partitions for it.

    With a fixed number a task's share, and with it its memory and what it spills, grows with the table.
    Only the number that adaptive execution starts from is raised; small shuffles are still put together,
    to parts of ``BYTES_A_TASK``. The rows are counted from the files' footers."""
    conf = table.sparkSession.conf
    wanted = -(-table.count() // ROWS_A_TASK)
    if wanted > int(conf.get(START, None) or conf.get("spark.sql.shuffle.partitions")):
        conf.set(START, str(wanted))
        conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(BYTES_A_TASK))
    return table


_written: list[str] = []


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared folder; ``clear_written`` removes what is written there."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Evaluated once into a table in the shared folder: survives the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Remove the intermediate tables that this application has written so far; results that are still
    read from them must have been stored elsewhere. Returns how many there were."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count
