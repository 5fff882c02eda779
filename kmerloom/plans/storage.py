"""Tables in the folder that driver and executors share: they cut lineage, so a lost executor costs no earlier stage."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset in local mode (tests): an own temporary folder, which is then set; unset on a cluster: an error."""
    if found := spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="kmerloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spool(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns that table."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spooled = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes spooled tables that no later step reads."""
    for df in frames:
        if path := getattr(df, "_spooled", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
