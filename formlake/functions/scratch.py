"""Tables that several steps read: written once to the shared folder of the session."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _ready(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="formlake-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """The name of a folder of one's own in the shared folder, not made yet."""
    return f"{_ready(spark).rstrip('/')}/{uuid.uuid4().hex}"


class Table:
    """df by way of parquet files in the shared folder, smaller than a checkpoint and removed by drop()."""

    def __init__(self, df: DataFrame):
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame) -> DataFrame:
    """df by way of a reliable checkpoint in the shared folder."""
    _ready(df.sparkSession)
    return df.checkpoint()
