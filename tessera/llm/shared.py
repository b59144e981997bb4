"""Folders that every executor sees, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one is set only where none is named.

    The temporary folder is for single-machine sessions (tests): on a cluster the setting must be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if not jsc.getCheckpointDir().isDefined():
        if not jsc.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (reliable checkpoint); later plans start there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Written:
    """A table written as Parquet to the shared folder; ``drop()`` deletes it, as the end of the driver does."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/tessera-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.parquet(self.path)
        atexit.register(self._drop_at_exit)

    def _drop_at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone
            self.drop()

    def drop(self) -> None:
        atexit.unregister(self._drop_at_exit)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch: with Spark's own 10,000, batches of long texts outgrow a Python worker.
BATCH_ROWS = 1000


def documents(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns asked for, by name, of rows that have an id; other columns of any name are left aside."""
    conf = docs.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.where(docs["doc_id"].isNotNull()).select(*[docs[c] for c in columns])


def sample(docs: DataFrame, most: int, *columns: str, by: str | None = None) -> list:
    """``columns`` of at most ``most`` documents in which none is null or empty, those whose ids have the smallest hashes.

    With ``by``, one of the columns, its values take turns until there are ``most``, so that rare ones are there too.
    Ids are chosen first, without texts: those of many tasks' candidates would be too much for the driver.
    An id that repeats counts once, with the values that sort first, ``by`` before the others.
    """
    rows = documents(docs, "doc_id", *columns)
    for c in columns:
        rows = rows.where(F.col(c) != "")
    h = F.xxhash64("doc_id").alias("h")
    if by:
        each = rows.groupBy("doc_id").agg(F.min(by).alias("by")).select("doc_id", h, "by")
        turn = F.row_number().over(Window.partitionBy("by").orderBy("h", "doc_id"))
        chosen = each.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", "h", "doc_id").select("doc_id")
    else:
        chosen = rows.select("doc_id", h).distinct().orderBy("h", "doc_id").select("doc_id")
    ids = [r.doc_id for r in chosen.limit(most).collect()]
    first = F.min(F.struct(*([by] if by else []), F.struct(*columns).alias("v")))
    found = rows.where(F.col("doc_id").isin(ids)).groupBy("doc_id").agg(first.alias("first"))
    return [r.first.v for r in found.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
