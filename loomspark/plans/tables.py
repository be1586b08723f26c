"""Reading the tables, with the columns that a query needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Columns of the message stream that ``events`` stands for.
MESSAGES = {"id": "event_id", "conversation": "user_id", "kind": "event_type", "value": "value", "metadata": "props"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column | str) -> Column:
    """Epoch milliseconds of a timestamp taken as UTC."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(F.to_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ``ms``, its time in epoch milliseconds."""
    return read(spark, sf_dir, "events").withColumn("ms", millis("ts"))


def state(df: DataFrame) -> tuple:
    """What tells one state of a table's files from another: paths, sizes and times of change."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    found = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append((name, status.getLen(), status.getModificationTime()))
    return tuple(found)
