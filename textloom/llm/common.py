"""Session, storage and column-name helpers of the training-text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.session import shared_path

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tuned(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and bytes, so that long texts don't swell them."""
    for key, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)),
    ):
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the storage that all executors share, as a URI."""
    return shared_path(spark)


def saved(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**{"compression": compression} if compression else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """Arrow file system and path of a folder named by a URI."""
    import pyarrow.fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of its file system; a plain one is of fs.defaultFS, as for Spark."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jpath).toString()


def type_of(df: DataFrame, name: str) -> str:
    """DDL type of a column, so that ids keep theirs through steps in Python."""
    return df.select(F.col(f"`{name}`")).schema[0].dataType.simpleString()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the input doesn't have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def need(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; clashing extra columns never get in the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])
