"""What the training-data operators share: the shared folder, written tables and Arrow settings."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder (as a URI) below the one the cluster names in spark.checkpoint.dir. It goes when the driver ends.

    Only a local session may lack that setting: it then gets a temporary folder of its own.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.lectern.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.lectern.shared.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, place = _place(spark, folder)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return folder


def _place(spark: SparkSession, folder: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder and read them again."""
    spark = df.sparkSession
    folder = shared_dir(spark, name)
    df.write.parquet(f"{folder}/rows")
    out = spark.read.schema(df.schema).parquet(f"{folder}/rows")
    out._lectern_folder = folder
    return out


def discard(df: DataFrame) -> None:
    """Remove what materialise wrote for a table that nothing reads any more."""
    fs, place = _place(df.sparkSession, df._lectern_folder)
    fs.delete(place, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small, whatever the length of the texts; Python workers find this package.

    On a cluster whose machines lack this folder, ship the package with --py-files.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """A vocabulary file; folder overrides where the public_tokenizers package keeps them."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
