"""What the operators share: the shared folder, written tables, the integer test of a fold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white spaces, as a regular-expression class body.
WS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a local one in local mode and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gyre-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/gyre-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Deletes the files of a table of ``written`` that nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A table of a few numbers a row is broadcast up to so many rows (some 20 MB); beyond, Spark joins it by a shuffle.
FEW_ROWS = 200_000


def few(table: DataFrame, entries: Column | None = None) -> DataFrame:
    """A written table, marked for broadcast if its rows (or the sum of ``entries``, where rows hold arrays) are counted to be few."""
    n = table.count() if entries is None else table.agg(F.coalesce(F.sum(entries), F.lit(0))).first()[0]
    return F.broadcast(table) if n <= FEW_ROWS else table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids: null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
