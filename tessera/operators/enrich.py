"""Enrichment of documents by stages with an injected model, review of what is unsure, and its failures."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.sources import tables


def stage(rows: DataFrame, name: str, prompt: Column, generate: Callable[[list[str]], list[str | None]], seen: DataFrame | None = None, version: str = "1") -> DataFrame:
    """Rows ``id, ...`` with ``output`` and ``failure`` of a stage (PP1).

    ``generate`` takes prompts and gives JSON texts; it runs once for each distinct prompt that ``seen``
    (``key, output``) lacks, batch by batch in the workers. A prompt that raises fails alone.
    """
    keyed = rows.withColumn("_prompt", prompt).withColumn("_key", F.sha1(F.concat_ws("|", F.lit(name), F.lit(version), F.coalesce("_prompt", F.lit("")))))
    asked = keyed.where("_prompt is not null").groupBy("_key").agg(F.min("_prompt").alias("_prompt"))
    if seen is not None:
        asked = asked.join(seen.select(F.col("key").alias("_key")), "_key", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            try:
                out = [(o, None) for o in generate(b["_prompt"].tolist())]
            except Exception:  # noqa: BLE001 - one by one, to tell which
                for p in b["_prompt"]:
                    try:
                        out.append((generate([p])[0], None))
                    except Exception as e:  # noqa: BLE001
                        out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"_key": b["_key"].tolist(), "output": [o for o, _ in out], "failure": [f for _, f in out]})

    made = asked.mapInPandas(run, "_key string, output string, failure string")
    if seen is not None:
        made = made.unionByName(seen.select(F.col("key").alias("_key"), "output", F.lit(None).cast("string").alias("failure")))
    return keyed.join(made, "_key", "left").withColumnRenamed("_key", "key").drop("_prompt")


def aborts(outcomes: DataFrame, least: int = 10, most: float = 0.5) -> bool:
    """Whether a batch of ``failure`` (null for success) went so wrong that the run should stop (STR3)."""
    r = outcomes.agg(F.count("*").alias("n"), F.count("failure").alias("bad")).first()
    return r.n >= least and r.bad / r.n > most


def review(rows: DataFrame, most: float = 0.6, limit: int = 100) -> DataFrame:
    """Rows whose enrichment is unsure, the least confident first, unknown confidence last (FLT24, TK12)."""
    sure = F.get_json_object("enriched", "$.confidence").try_cast("double")
    unsure = F.from_json(F.get_json_object("enriched", "$.uncertain_fields"), "array<string>")
    return rows.where((sure < most) | (F.coalesce(F.size(unsure), F.lit(0)) > 0)).withColumn("confidence", sure).orderBy(F.asc_nulls_last("confidence"), "id").limit(limit)


def corrected(enriched: Column, correction: Column) -> Column:
    """A JSON object with another's keys put over its own (PP5)."""
    kind = "map<string,string>"
    old, new = F.coalesce(F.from_json(enriched, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(correction, kind), F.create_map().cast(kind))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new))


def revalidated(rows: DataFrame, tokens: DataFrame, feeds_enrichment: bool = False) -> DataFrame:
    """Rows whose image has another token than before lose ``indexed_at``, and ``enriched_at`` if images feed it (STR7)."""
    both = rows.join(tokens.select("id", F.col("token").alias("_token")), "id", "left")
    changed = F.col("_token").isNotNull() & ~F.col("_token").eqNullSafe(F.col("image_token"))
    out = both.withColumn("indexed_at", F.when(~changed, F.col("indexed_at")))
    if feeds_enrichment:
        out = out.withColumn("enriched_at", F.when(~changed, F.col("enriched_at")))
    return out.withColumn("image_token", F.coalesce("_token", "image_token")).drop("_token")


def embedded(rows: DataFrame, text: Column, embed: Callable[[list[str]], list[list[float]]], dims: int, size: int = 24) -> DataFrame:
    """Rows ``id, ...`` with ``vec`` and ``failure`` from an injected embedder, ``size`` texts at a time (UD1, PP3, PP17).

    Null and blank texts have neither. A vector of another length is a failure, as is whatever a text raises alone.
    """
    kept = rows.withColumn("_text", text)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for i in range(0, len(f), size):
                ids, texts = f["id"].tolist()[i : i + size], f["_text"].tolist()[i : i + size]
                try:
                    got = [(v, None) for v in embed(texts)]
                    if len(got) != len(texts):
                        raise ValueError("a vector for each text")
                except Exception:  # noqa: BLE001 - one by one, to tell which
                    got = []
                    for x in texts:
                        try:
                            got.append((embed([x])[0], None))
                        except Exception as e:  # noqa: BLE001
                            got.append((None, f"{type(e).__name__}: {e}"))
                out += [(k, [float(y) for y in v], None) if v is not None and len(v) == dims else (k, None, why or f"a vector of {dims} expected") for k, (v, why) in zip(ids, got)]
            yield pd.DataFrame(out, columns=["id", "vec", "failure"])

    kind = rows.schema["id"].dataType.simpleString()
    made = kept.where(F.trim("_text") != "").select("id", "_text").mapInPandas(run, f"id {kind}, vec array<double>, failure string")
    return rows.join(made, "id", "left")


def graded(pairs: DataFrame, judge: Callable[[str, list[str]], list[int]], cache: DataFrame | None = None, version: str = "1", size: int = 10) -> DataFrame:
    """``query, text, key, grade`` of distinct pairs ``query, text`` by an injected judge, ``size`` texts of one query at a
    time (PP7, PP20). Grades that ``cache`` (``key, grade``) has aren't asked for again (PP21); an error or an answer that
    is no grade from 0 to 3 counts 0 and, as other failures, stays out of what is worth caching (``sure``)."""
    keyed = pairs.select("query", "text").distinct().withColumn("key", F.sha1(F.concat_ws("|", F.lit(version), "query", "text")))
    known = cache.select("key", F.col("grade").alias("_grade")) if cache is not None else None
    asked = keyed.join(known, "key", "left_anti") if known is not None else keyed
    lots = asked.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("key"))).groupBy("query", F.floor((F.col("_n") - 1) / size).alias("_lot")).agg(F.sort_array(F.collect_list(F.struct("key", "text"))).alias("list"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for q, rows in zip(f["query"], f["list"]):
                try:
                    got = list(judge(q, [r["text"] for r in rows]))
                except Exception:  # noqa: BLE001 - counted as 0
                    got = []
                for i, r in enumerate(rows):
                    g = got[i] if i < len(got) else None
                    good = isinstance(g, int) and not isinstance(g, bool) and 0 <= g <= 3
                    out.append((r["key"], g if good else 0, good))
            yield pd.DataFrame(out, columns=["key", "grade", "sure"])

    new = lots.mapInPandas(run, "key string, grade int, sure boolean")
    if known is not None:
        new = new.unionByName(known.select("key", F.col("_grade").cast("int").alias("grade"), F.lit(True).alias("sure")))
    return keyed.join(new, "key")


def apart(judge: str, model: str) -> bool:
    """Whether a judge is of another family than the model that it judges, by the first word of their names (PP8)."""
    first = lambda n: re.split(r"[^a-z]", n.lower().rsplit("/", 1)[-1])[0]
    return first(judge) != first(model)


def few_shots(reviewed: DataFrame, most: int = 5) -> list[str]:
    """Lines of the latest corrections ``id, before, after, at``, to go before a prompt (PP5)."""
    rows = reviewed.orderBy(F.desc("at"), "id").limit(most).collect()
    return [f"Not {r.before} but {r.after}" for r in rows]


class Enricher:
    """Documents ``id, data`` from ingestion to enrichment over one keyed table (PP2, PP4, PP6): what was changed is enriched,
    what failed waits longer each time, and results are measured against gold values."""

    def __init__(self, store: tables.Store, prompt: Column, generate: Callable[[list[str]], list[str | None]], version: str = "1"):
        self.store, self.prompt, self.generate, self.version = store, prompt, generate, version

    #: Columns of the table.
    SCHEMA = "id string, scope string, data string, content_hash string, enriched string, enriched_at timestamp, indexed_at timestamp, ingested_at timestamp, attempts int, status string, due timestamp"

    def upsert(self, rows: DataFrame, scope: str, at: Column) -> None:
        """Puts in ``id, data``; those whose text changed are to be enriched again."""
        old = self.store.read()
        made = tables.ingest(old, rows.select("id", "data", F.sha1("data").alias("content_hash")), scope, at)
        rest = old.select("id", F.col("content_hash").alias("_hash"), "enriched_at", "attempts", "status", "due")
        both = made.join(rest, "id", "left")
        same = F.col("_hash").eqNullSafe(F.col("content_hash"))
        self._write(both.withColumns({"enriched_at": F.when(same, F.col("enriched_at")), "attempts": F.when(same, F.col("attempts")).otherwise(0), "status": F.when(same, F.col("status")).otherwise("dirty"), "due": F.when(same, F.col("due"))}))

    def remove(self, ids: DataFrame) -> None:
        self._write(tables.delete(self.store.read(), ids))

    def run(self, now: Column, most: int = 5) -> DataFrame:
        """Enriches what is dirty or due and gives the outcomes ``id, output, failure``."""
        old = self.store.read()
        due = (F.col("status") == "dirty") | ((F.col("status") == "failed") & (F.col("due") <= now))
        made = stage(old.where(due).select("id", "data"), "enrich", self.prompt, self.generate, version=self.version).select("id", "output", "failure")
        made = made.checkpoint() if old.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else made.persist()
        good = made.where("failure is null").select("id", F.col("output").alias("_output"))
        bad = tables.after_failure(old.join(made.where("failure is not null").select("id"), "id", "left_semi").select("id", "attempts"), now, most).select("id", F.col("attempts").alias("_attempts"), F.col("status").alias("_status"), F.col("due").alias("_due"))
        both = old.join(good.withColumn("_good", F.lit(True)), "id", "left").join(bad, "id", "left")
        done, failed = F.col("_good"), F.col("_status").isNotNull()
        self._write(both.withColumns({"enriched": F.when(done, F.col("_output")).otherwise(F.col("enriched")), "enriched_at": F.when(done, now).otherwise(F.col("enriched_at")), "attempts": F.when(done, 0).when(failed, F.col("_attempts")).otherwise(F.col("attempts")).cast("int"), "status": F.when(done, "ready").when(failed, F.col("_status")).otherwise(F.col("status")), "due": F.when(failed, F.col("_due")).otherwise(F.when(~F.coalesce(done, F.lit(False)), F.col("due")))}))
        return made

    def evaluate(self, gold: DataFrame, attributes: list[str]) -> DataFrame:
        """Precision and recall of the attributes of ``gold`` (``id`` and an array for each) (PP6)."""
        got = self.store.read().select("id", *[F.coalesce(F.from_json(F.get_json_object("enriched", f"$.{a}"), "array<string>"), F.array_compact(F.array(F.get_json_object("enriched", f"$.{a}")))).alias(f"_{a}") for a in attributes])
        return metrics.accuracy(gold.join(got, "id", "left"), {a: (F.col(a), F.col(f"_{a}")) for a in attributes})

    def _write(self, df: DataFrame) -> None:
        names = [x.split()[0] for x in self.SCHEMA.split(", ")]
        self.store.write(df.select(*[F.col(n) for n in names]))
