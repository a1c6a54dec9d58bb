"""Sessions, test tables and the cutting of lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events embeddings media_info keyframes vectors docs queries "
    "candidates review_frames documents eval_items mix_targets doc_labels"
).split()


def session(app: str = "sightline", master: str | None = None, cores: int | None = None, memory: str = "8g") -> SparkSession:
    """The submitter's session where there is one, else a local one for tests and benches.

    Under spark-submit nothing that the submitter has set is changed: neither the
    master nor the number of shuffle partitions.
    """
    settings = {
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if "PYSPARK_GATEWAY_PORT" in os.environ or SparkSession.getActiveSession() is not None:
        given = SparkConf()
        settings = {k: v for k, v in settings.items() if not given.contains(k)}
    else:
        n = cores or os.cpu_count() or 8
        builder = builder.master(master or f"local[{n}]")
        settings |= {"spark.sql.shuffle.partitions": n, "spark.driver.memory": memory, "spark.ui.enabled": "false"}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local session may do without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sightline-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder and read back.

    Ends the lineage, survives the loss of executors, and lets later plans read
    single columns.  An empty ``df`` comes back empty with its columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete what ``cut`` wrote in this application, once its results are used."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
