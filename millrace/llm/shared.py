"""What the operators share: the folder all executors see, written tables, Arrow batch sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a local session without one (tests) a temporary folder of this process."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="millrace-"))
        place = _own[0]
    return place.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def written(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Removes the files of a table that written() made; for tables that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
