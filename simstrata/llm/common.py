"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java pattern of the white space that separates words: space and \x09 to \x0D.
WS = "[ \\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place if the driver runs all tasks itself (tests); on a cluster
    that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="simstrata-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Remove tables made by ``written`` once nothing will read them again."""
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark)
    for parent in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        if parent.split("://")[-1].lstrip("/").startswith(root.split("://")[-1].lstrip("/").removeprefix("file:").lstrip("/")):
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def words_of(text: Column) -> Column:
    """Array of the words (runs of anything but space and \\x09-\\x0D) of a text; empty for null."""
    trimmed = F.regexp_replace(text, f"^{WS}|{WS}$", "")
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, WS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
