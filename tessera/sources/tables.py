"""Versions of keyed tables: upserts, deletions, dirty rows. Each gives the table's next version as a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import normalise, phonetic_tokens


def upsert(old: DataFrame, new: DataFrame, at: Column) -> DataFrame:
    """Documents ``id, scope, data, content_hash, enriched, indexed_at, ingested_at`` with new ones put in (SNK1).

    What was derived from a document is cleared only if its content hash changed. A new document under another
    scope's id is a takeover: it raises at run time.
    """
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    both = o.join(new, o["o_id"] == new["id"], "full")
    taken = new["id"].isNotNull() & o["o_id"].isNotNull() & ~o["o_scope"].eqNullSafe(new["scope"])
    same = new["id"].isNull() | o["o_content_hash"].eqNullSafe(new["content_hash"])
    key = F.when(taken, F.raise_error(F.concat(F.lit("id of another scope: "), F.col("o_id")))).otherwise(F.coalesce(new["id"], F.col("o_id")))
    take = lambda c: F.when(new["id"].isNotNull(), new[c]).otherwise(F.col(f"o_{c}")).alias(c)
    return both.select(key.alias("id"), take("scope"), take("data"), take("content_hash"), F.when(same, F.col("o_enriched")).alias("enriched"), F.when(same, F.col("o_indexed_at")).alias("indexed_at"), F.when(new["id"].isNotNull(), at).otherwise(F.col("o_ingested_at")).alias("ingested_at"))


def delete(old: DataFrame, ids: DataFrame, scope: str | None = None) -> DataFrame:
    """Without the ids, of one scope if given (SNK2)."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    at = old["id"] == gone["_gone"]
    return old.join(gone, at & (old["scope"] == scope) if scope else at, "left_anti")


def dirty(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose content hash is new or other than the one seen (FLT23)."""
    known = seen.select(F.col("id").alias("_id"), F.col("content_hash").alias("_hash"))
    return rows.join(known, (rows["id"] == known["_id"]) & rows["content_hash"].eqNullSafe(known["_hash"]), "left_anti")


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key (STR1)."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def backoff(attempts: Column) -> Column:
    """Seconds until a failed row is tried again: 2^attempts, an hour at most (SC28)."""
    return F.least(F.lit(3600.0), F.pow(F.lit(2.0), F.least(attempts, F.lit(12))))


def after_failure(rows: DataFrame, now: Column, most: int = 5) -> DataFrame:
    """Rows ``id, attempts`` that failed once more: dead after ``most`` attempts, else failed and due later (STR2)."""
    tried = rows.withColumn("attempts", F.col("attempts") + 1)
    return tried.withColumn("status", F.when(F.col("attempts") >= most, "dead").otherwise("failed")).withColumn("due", F.when(F.col("attempts") < most, F.timestamp_seconds(F.unix_timestamp(now) + backoff(F.col("attempts")))))


def row(table: DataFrame, id_: str) -> DataFrame:
    """The data of one document; the filter reaches the scan (SRC10)."""
    return table.where(F.col("id") == id_).select("id", "data").limit(1)


def index_status(table: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, indexed`` of a set of ids: whether they are there and indexed (SRC11)."""
    known = table.select("id", F.col("indexed_at").isNotNull().alias("_indexed"))
    return ids.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("_indexed", F.lit(False)).alias("indexed"))


def stale(table: DataFrame) -> DataFrame:
    """Documents that were never indexed, or were enriched since (FLT22)."""
    return table.where(F.col("indexed_at").isNull() | (F.col("indexed_at") < F.col("enriched_at")))


def oldest(table: DataFrame, n: int, pending: Column) -> DataFrame:
    """A batch of work: the ``n`` documents that have waited longest (TK10)."""
    return table.where(pending).orderBy(F.asc("ingested_at"), F.asc("id")).limit(n)


def vocabulary(counts: DataFrame, field: str, n: int = 1000) -> DataFrame:
    """The most frequent values of a field, a list for prompts and pickers (TK9)."""
    return counts.where(F.col("field") == field).orderBy(F.desc("n"), F.asc("value")).limit(n).select("value", "n")


def with_indexed(table: DataFrame, made: DataFrame, at: Column) -> DataFrame:
    """Documents with the surfaces, vector and status that indexing made for some of them (SNK3)."""
    new = [c for c in made.columns if c != "id"]
    m = made.select("id", *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_made"))
    both = table.join(m, "id", "left")
    take = {c: F.when(F.col("_made"), F.col(f"_{c}")).otherwise(F.col(c) if c in table.columns else F.lit(None)) for c in new}
    return both.withColumns(take | {"indexed_at": F.when(F.col("_made"), at).otherwise(F.col("indexed_at"))}).drop("_made", *[f"_{c}" for c in new])


def with_evidence(evidence: DataFrame, made: DataFrame, ids: DataFrame) -> DataFrame:
    """Child rows with those of the ids replaced by the ones made anew; an id without new ones loses its old ones (SNK3)."""
    return evidence.join(ids.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").unionByName(made)


def with_enrichment(table: DataFrame, made: DataFrame, at: Column) -> DataFrame:
    """Documents with what enrichment gave for some of them: output and confidence, or the failure (SNK7)."""
    m = made.select("id", F.col("output").alias("_output"), F.col("failure").alias("_failure"), F.lit(True).alias("_made"))
    good = F.col("_made") & F.col("_failure").isNull()
    failure = F.when(F.col("_made"), F.col("_failure")).otherwise(F.col("failure") if "failure" in table.columns else F.lit(None))
    return table.join(m, "id", "left").withColumns({"enriched": F.when(good, F.col("_output")).otherwise(F.col("enriched")), "enriched_at": F.when(good, at).otherwise(F.col("enriched_at")), "failure": failure}).drop("_output", "_failure", "_made")


def ingest(old: DataFrame, pulled: DataFrame, scope: str, at: Column) -> DataFrame:
    """The table's next version with a pull of feeds ``id, data, content_hash`` put in; of rows that repeat an id the one
    with the smallest hash counts (SNK4)."""
    first = pulled.where("id is not null").groupBy("id").agg(F.min_by(F.struct("data", "content_hash"), F.struct("content_hash", "data")).alias("x"))
    return upsert(old, first.select("id", F.lit(scope).alias("scope"), "x.data", "x.content_hash"), at)


def upsert_entities(old: DataFrame, new: DataFrame, name: str = "name") -> DataFrame:
    """Entities by ``external_id`` with new ones put in, and the columns that matching reads: ``name_normalised`` and
    ``name_phonetic`` (SNK5). New values win, nulls among them; of rows that repeat an id the first by name counts."""
    made = new.groupBy("external_id").agg(F.min_by(F.struct(*[c for c in new.columns if c != "external_id"]), F.coalesce(F.col(name), F.lit(""))).alias("x")).select("external_id", "x.*")
    out = old.select(*new.columns).join(made.select("external_id"), "external_id", "left_anti").unionByName(made.select(*new.columns))
    return out.withColumns({"name_normalised": normalise(F.col(name)), "name_phonetic": F.nullif(phonetic_tokens(F.col(name)), F.lit(""))})


def unexpired(cache: DataFrame, now: Column, days: float) -> DataFrame:
    """Entries of a cache ``key, value, at`` that are younger than so many days, of each key the latest (STR6)."""
    young = cache.where(F.unix_timestamp(now) - F.unix_timestamp("at") < days * 86400)
    return young.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"), F.max("at").alias("at"))


class Store:
    """A keyed table in versions under a folder, each written whole before it counts: what enrichment and matching need of
    a durable store, on whatever file system Spark reads (SNK6, SNK8)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keep: int = 2):
        self.spark, self.folder, self.schema, self.keep = spark, folder.rstrip("/"), schema, keep
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The complete versions, oldest first."""
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = [(f.getPath().getName(), f.getPath()) for f in self._fs.listStatus(root)]
        return sorted(int(n[2:]) for n, p in names if n.startswith("v=") and self._fs.exists(self._path(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={found[-1]}") if found else self.spark.createDataFrame([], self.schema)

    def write(self, following: DataFrame) -> int:
        """Writes the next version and removes old ones, but the ``keep`` latest, which readers may still hold."""
        found = self.versions()
        n = found[-1] + 1 if found else 0
        following.write.mode("overwrite").parquet(f"{self.folder}/v={n}")
        for old in [*found, n][: -self.keep]:
            self._fs.delete(self._path(f"{self.folder}/v={old}"), True)
        return n
