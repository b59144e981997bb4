"""Change events applied to a table of documents, batch by batch or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.tables import latest

#: Kinds of change that alter what is indexed.
REINDEX = ("upsert", "variant", "image")


def apply(old: DataFrame, events: DataFrame) -> DataFrame:
    """``id, data, needs_reindex`` with a batch of events ``id, kind, data, ts, event_id`` applied (STR1).

    ``data`` is a map. Events of one id merge in order, later keys over earlier ones, from the last deletion on; a
    deletion that comes last removes the document.
    """
    parts = F.sort_array(F.collect_list(F.struct("ts", "event_id", "kind", F.map_entries("data").alias("entries"))))
    each = events.groupBy(F.col("id").alias("_id")).agg(parts.alias("list"))
    cut = F.coalesce(F.array_max(F.transform("list", lambda x, i: F.when(x["kind"] == "delete", i + 1))), F.lit(0))
    live = F.slice("list", cut + 1, F.size("list"))
    empty = F.create_map().cast("map<string,string>")
    merge = lambda acc, m: F.map_concat(F.map_filter(acc, lambda k, _: ~F.array_contains(F.map_keys(m), k)), m)
    made = each.select("_id", cut.alias("_cut"), F.aggregate(live, empty, lambda acc, x: merge(acc, F.coalesce(F.map_from_entries(x["entries"]), empty))).alias("_data"), (F.size(live) > 0).alias("_live"), F.exists(live, lambda x: x["kind"].isin(*REINDEX)).alias("_re"))
    both = old.join(made, old["id"] == made["_id"], "full")
    base = F.when(F.coalesce("_cut", F.lit(0)) == 0, F.coalesce("data", empty)).otherwise(empty)
    kept = both.where(F.col("_id").isNull() | F.col("_live"))
    return kept.select(F.coalesce("_id", "id").alias("id"), merge(base, F.coalesce("_data", empty)).alias("data"), (F.coalesce("needs_reindex", F.lit(False)) | F.coalesce("_re", F.lit(False))).alias("needs_reindex"))


def follow(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """A stream of events applied to versions of a table under ``folder``, each batch once: batch n writes version n,
    again if it is repeated, from the version before it."""
    spark = events.sparkSession
    schema = "id string, data map<string,string>, needs_reindex boolean"

    def write(batch: DataFrame, n: int) -> None:
        old = spark.read.schema(schema).parquet(f"{folder}/v={n - 1}") if n else spark.createDataFrame([], schema)
        apply(old, batch).write.mode("overwrite").parquet(f"{folder}/v={n}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vocabulary(changes: DataFrame) -> DataFrame:
    """``field, value, n`` from rows ``field, old, new``: minus one for the old value, plus one for the new (STR4); also of
    a stream, in update mode."""
    pairs = F.array(F.struct(F.col("old").alias("value"), F.lit(-1).alias("by")), F.struct(F.col("new").alias("value"), F.lit(1).alias("by")))
    return changes.select("field", F.explode(pairs).alias("x")).select("field", "x.*").where("value is not null").groupBy("field", "value").agg(F.sum("by").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``user_id, start, end, n`` of sessions by gap; an extension to the reference, for batch and stream."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_events(events: DataFrame) -> DataFrame:
    return latest(events, "user_id", "ts", "event_id")
