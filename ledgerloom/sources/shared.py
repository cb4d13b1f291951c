"""Tables that one plan writes and another reads: in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, with its scheme: spark.checkpoint.dir; only where it is unset, one in the warehouse."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    path = spark._jvm.org.apache.hadoop.fs.Path(given or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not given and found.startswith("file:") and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share; {found} is local to each machine")
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or folder, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Tables:
    """Written tables under one folder, which goes when the block ends: with Tables(spark, "name") as kept: ..."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/ledgerloom/{owner}-{uuid.uuid4().hex}"

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        remove(self.spark, self.root)

    def save(self, df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
        """The table, written and read again: what follows doesn't make it anew, even where an executor is lost."""
        path = f"{self.root}/{name}"
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
