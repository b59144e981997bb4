"""Evaluation as aggregations: ranking quality, extraction accuracy, thresholds, agreement, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(judged: DataFrame, k: int = 10, linear: bool = False) -> DataFrame:
    """``query_id, ndcg`` of hits ``query_id, rank, grade``: gains 2^grade - 1, or the grade itself, against the same grades
    in best order (AG17)."""
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), F.asc("rank")))
    gain = F.col("grade").cast("double") if linear else F.pow(F.lit(2.0), F.col("grade")) - 1
    rows = judged.withColumn("ideal", best)
    got = F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    most = F.sum(F.when(F.col("ideal") <= k, gain / F.log2(F.col("ideal") + 1.0)).otherwise(0.0))
    return rows.groupBy("query_id").agg(F.coalesce(F.try_divide(got, F.nullif(most, F.lit(0.0))), F.lit(0.0)).alias("ndcg"))


def reciprocal(judged: DataFrame, least: int, k: int = 10) -> DataFrame:
    """``query_id, mrr, hit``: 1 over the rank of the first good hit, and whether one is among the first k (AG18)."""
    first = F.min(F.when(F.col("grade") >= least, F.col("rank")))
    return judged.groupBy("query_id").agg(first.alias("first")).select("query_id", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias("hit"))


def by_type(rows: DataFrame, kind: str, *measures: str) -> DataFrame:
    """Means by type, and over all under ``all`` (AG19)."""
    named = F.when(F.grouping(kind) == 1, "all").otherwise(F.col(kind).cast("string"))
    return rows.rollup(kind).agg(named.alias("type"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in measures]).select("type", "n", *measures)


def calibrate(decided: DataFrame, steps: int = 50) -> DataFrame:
    """``threshold, tp, fp, fn, f1`` for thresholds from 0.50 up by 0.01 of ``score, accepted`` (AG22).

    Scores are first counted by the thresholds they reach, so that only counts meet the grid.
    """
    reached = F.least(F.floor((F.col("score") - 0.5) * 100 + 1e-9), F.lit(steps - 1))
    counted = decided.groupBy(reached.alias("reached")).agg(F.sum(F.col("accepted").cast("long")).alias("yes"), F.sum((~F.col("accepted")).cast("long")).alias("no"))
    grid = decided.sparkSession.range(steps).select(F.col("id").alias("step"))
    above = F.col("reached") >= F.col("step")
    out = counted.crossJoin(F.broadcast(grid)).groupBy("step").agg(F.sum(F.when(above, F.col("yes")).otherwise(0)).alias("tp"), F.sum(F.when(above, F.col("no")).otherwise(0)).alias("fp"), F.sum(F.when(above, 0).otherwise(F.col("yes"))).alias("fn"))
    return out.select(((F.col("step") + 50) / 100.0).alias("threshold"), "tp", "fp", "fn", F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def kappa(rated: DataFrame, one: Column, two: Column) -> DataFrame:
    """``n, observed, expected, kappa``: Cohen's agreement of two raters (AG23)."""
    cells = rated.select(one.cast("string").alias("x"), two.cast("string").alias("y")).where("x is not null and y is not null").groupBy("x", "y").agg(F.count("*").alias("c"))
    all_ = Window.partitionBy()
    total = F.sum("c").over(all_)
    # The table of classes is small; its margins are windows over it.
    margins = cells.select("c", (F.col("x") == F.col("y")).alias("same"), total.alias("n"), "x", "y")
    px = cells.groupBy(F.col("x").alias("k")).agg(F.sum("c").alias("cx"))
    py = cells.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("cy"))
    chance = px.join(py, "k").agg(F.coalesce(F.sum(F.col("cx").cast("double") * F.col("cy")), F.lit(0.0)).alias("chance"))
    seen = margins.agg(F.max("n").alias("n"), F.sum(F.when(F.col("same"), F.col("c")).otherwise(0)).alias("agree"))
    out = seen.crossJoin(F.broadcast(chance)).select("n", (F.col("agree") / F.col("n")).alias("observed"), (F.col("chance") / F.col("n") / F.col("n")).alias("expected"))
    return out.withColumn("kappa", F.when(F.col("expected") == 1, 1.0).otherwise((F.col("observed") - F.col("expected")) / (1 - F.col("expected"))))


def accuracy(rows: DataFrame, attributes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``attribute, tp, fp, fn, p, r, f1`` of gold and predicted value sets (AG21); measures without cases are 1."""
    made = [F.struct(F.lit(k).alias("attribute"), F.coalesce(g, F.array()).alias("gold"), F.coalesce(p, F.array()).alias("got")) for k, (g, p) in attributes.items()]
    each = rows.select(F.explode(F.array(*made)).alias("x")).select("x.*")
    n = lambda c: F.sum(F.size(c))
    counts = each.groupBy("attribute").agg(n(F.array_intersect("gold", "got")).alias("tp"), n(F.array_except("got", "gold")).alias("fp"), n(F.array_except("gold", "got")).alias("fn"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col("tp").cast("double"), (a + b).cast("double")), F.lit(1.0))
    out = counts.withColumn("p", share(F.col("tp"), F.col("fp"))).withColumn("r", share(F.col("tp"), F.col("fn")))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def lower_percentiles(rows: DataFrame, value: Column, *percents: int) -> DataFrame:
    """``percent, n, value``: the entry at ``floor((n - 1) p / 100)`` in order (AG26).

    Exact, and without all values in one task: values are counted by range, the ranges' counts tell where each entry
    is, and only ranges that hold one are ranked, each in a task of its own.
    """
    x = rows.select(value.cast("double").alias("x")).where("x is not null")
    counts = x.groupBy("x").agg(F.count("*").alias("c"))
    edges = x.select(F.percentile_approx("x", [i / 64 for i in range(65)], 1000).alias("e"))  # one row, for cuts of like size
    ranged = counts.crossJoin(F.broadcast(edges)).select("x", "c", F.size(F.filter("e", lambda v: v < F.col("x"))).alias("part"))
    parts = ranged.groupBy("part").agg(F.sum("c").alias("c"))  # 66 rows at most
    before = F.sum("c").over(Window.orderBy("part")) - F.col("c")
    parts = parts.select("part", before.alias("before"), "c", F.sum("c").over(Window.partitionBy()).alias("n"))
    asked = F.explode(F.array(*[F.lit(p) for p in percents])).alias("percent")
    wanted = parts.select("part", "before", "c", "n", asked).withColumn("at", F.floor((F.col("n") - 1) * F.col("percent") / 100)).where("at >= before and at < before + c")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy("part", "percent").orderBy("x"))
    inside = ranged.join(F.broadcast(wanted.drop("c")), "part").withColumn("upto", upto)
    return inside.where("upto > at").groupBy("percent", "n").agg(F.min("x").alias("value"))


def null_rate(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``n, null_rate``: the share of queries without any hit (AG18)."""
    found = hits.select("query_id").distinct().withColumn("_hit", F.lit(1))
    return queries.select("query_id").distinct().join(found, "query_id", "left").agg(F.count("*").alias("n"), F.avg(F.col("_hit").isNull().cast("int")).alias("null_rate"))


def gate(means: DataFrame, least: dict[str, float], most: dict[str, float] = {}) -> DataFrame:  # noqa: B006
    """Means with ``failed``: the measures below their least or above their most value; unknown ones fail (AG19)."""
    bad = [F.when(~F.coalesce(F.col(k) >= v, F.lit(False)), F.lit(k)) for k, v in least.items()] + [F.when(~F.coalesce(F.col(k) <= v, F.lit(False)), F.lit(k)) for k, v in most.items()]
    return means.withColumn("failed", F.filter(F.array(*bad), lambda x: x.isNotNull()))


def attribution(fused: DataFrame, graded: DataFrame, legs: list[str], least: int = 2) -> DataFrame:
    """``leg, n``: for each relevant hit the leg that had it highest, ties by name; ``none`` where no leg ranked it (AG20,
    JN19). ``fused`` has ``query_id, doc_id`` and a ``<leg>_rank`` for each leg, ``graded`` has ``grade``."""
    hits = fused.join(graded.where(F.col("grade") >= least).select("query_id", "doc_id"), ["query_id", "doc_id"])
    ranks = F.filter(F.array(*[F.struct(F.col(f"{k}_rank").cast("long").alias("rank"), F.lit(k).alias("leg")) for k in sorted(legs)]), lambda x: x["rank"].isNotNull())
    return hits.groupBy(F.coalesce(F.array_min(ranks)["leg"], F.lit("none")).alias("leg")).agg(F.count("*").alias("n"))


def macro(by_attribute: DataFrame, digits: int = 3) -> DataFrame:
    """``p, r, f1`` over all attributes together, and ``macro_f1``, the mean of theirs, to three digits (AG21)."""
    tp, fp, fn = F.sum("tp").cast("double"), F.sum("fp"), F.sum("fn")
    share = lambda a, b: F.coalesce(F.try_divide(a, (a + b).cast("double")), F.lit(1.0))
    out = by_attribute.agg(share(tp, fp).alias("p"), share(tp, fn).alias("r"), F.avg("f1").alias("macro_f1"))
    f1 = F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    return out.select(*[F.round(c, digits).alias(n) for n, c in (("p", F.col("p")), ("r", F.col("r")), ("f1", f1), ("macro_f1", F.col("macro_f1")))])


def best_threshold(grid: DataFrame) -> DataFrame:
    """The first threshold with the highest F1 (AG22)."""
    return grid.agg(F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("x")).select("x.*")


def binary(rated: DataFrame, gold: Column, got: Column) -> DataFrame:
    """``tp, fp, fn, p, r, f1`` of one judge's yes against another's (AG23); rows with a null on either side don't count."""
    rows = rated.select(gold.alias("g"), got.alias("p")).where("g is not null and p is not null")
    n = lambda c: F.count_if(c)
    c = rows.agg(n(F.col("g") & F.col("p")).alias("tp"), n(~F.col("g") & F.col("p")).alias("fp"), n(F.col("g") & ~F.col("p")).alias("fn"))
    share = lambda a: F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(a)).cast("double")), F.lit(1.0))
    out = c.withColumns({"p": share("fp"), "r": share("fn")})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))


def pairwise(gold: DataFrame, got: DataFrame) -> DataFrame:
    """``tp, fp, fn, p, r`` of the pairs within clusters ``id, cluster`` (AG24).

    Pairs aren't listed: a cluster of n has n (n - 1) / 2 of them, and so has each part that two clusterings share.
    """
    pairs = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("long").alias("x"))
    both = gold.select("id", F.col("cluster").alias("g")).join(got.select("id", F.col("cluster").alias("p")), "id")
    same, all_g, all_p = pairs(both, "g", "p").withColumnRenamed("x", "tp"), pairs(gold, "cluster").withColumnRenamed("x", "g"), pairs(got, "cluster").withColumnRenamed("x", "p_")
    c = same.crossJoin(all_g).crossJoin(all_p).select("tp", (F.col("p_") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))  # one row each
    share = lambda a: F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col(a)).cast("double")), F.lit(1.0))
    return c.withColumns({"p": share("fp"), "r": share("fn")})


def recall(hits: DataFrame, relevant: DataFrame | Column, k: int = 10) -> DataFrame:
    """``query_id, recall, precision`` among the first ``k`` hits; queries without hits have 0 (AG25).

    What is relevant is a frame, or a flag of the hits if only hits are relevant, which then are read once.
    """
    if isinstance(relevant, Column):
        each = hits.groupBy("query_id", "doc_id").agg(F.max(F.coalesce(relevant, F.lit(False))).alias("_good"), (F.min("rank") <= k).alias("_head"))
        rows = each.groupBy("query_id").agg(F.count_if("_good").alias("_all"), F.count_if(F.col("_good") & F.col("_head")).alias("_hit"), F.count_if("_head").alias("_shown")).where("_all > 0")
        return rows.select("query_id", (F.col("_hit") / F.col("_all")).alias("recall"), F.coalesce(F.try_divide(F.col("_hit"), F.col("_shown")), F.lit(0.0)).alias("precision"))
    head = hits.where(F.col("rank") <= k).select("query_id", "doc_id").distinct()
    good = relevant.select("query_id", "doc_id").distinct()
    n = good.groupBy("query_id").agg(F.count("*").alias("_all"))
    found = head.join(good, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count("*").alias("_hit"))
    shown = head.groupBy("query_id").agg(F.count("*").alias("_shown"))
    rows = n.join(found, "query_id", "left").join(shown, "query_id", "left")
    return rows.select("query_id", (F.coalesce("_hit", F.lit(0)) / F.col("_all")).alias("recall"), F.coalesce(F.try_divide(F.col("_hit"), F.col("_shown")), F.lit(0.0)).alias("precision"))


def violates(value: Column, op: str, wanted: object, is_array: bool = False) -> Column:
    """Whether a value contradicts a constraint; a missing one never does (FLT21). ``contains`` asks for all of a list."""
    low = lambda c: F.lower(F.trim(c.cast("string")))
    own = F.transform(value, low) if is_array else F.array(low(value))
    many = [F.lit(str(w).lower().strip()) for w in (wanted if isinstance(wanted, list) else [wanted])]
    some = F.coalesce(F.arrays_overlap(F.filter(own, lambda v: v.isNotNull()), F.array(*many)), F.lit(False))
    missing = value.isNull() | ((F.size(value) == 0) if is_array else (value.cast("string") == ""))
    if op in ("gt", "gte", "lt", "lte"):
        n, w = value.try_cast("double"), float(wanted)  # type: ignore[arg-type]
        held = {"gt": n > w, "gte": n >= w, "lt": n < w, "lte": n <= w}[op]
        return ~missing & F.coalesce(~held, F.lit(False))
    bad = {"eq": ~some, "in": ~some, "ne": some, "nin": some, "exclude": some, "contains": F.size(F.array_except(F.array(*many), own)) > 0}[op]
    return ~missing & bad


def compliance(hits: DataFrame, wanted: list[Column]) -> DataFrame:
    """``query_id, n, violated``: how many of a query's hits contradict any of the constraints (FLT21, AG25)."""
    any_ = F.lit(False)
    for w in wanted:
        any_ = any_ | w
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(any_).alias("violated"))


def errors(gold: DataFrame, predicted: DataFrame, attribute: str) -> DataFrame:
    """``id, missed, invented``: values of an attribute that a prediction lacks or made up; every gold row stays (JN18)."""
    both = gold.select("id", F.col(attribute).alias("_g")).join(predicted.select("id", F.col(attribute).alias("_p")), "id", "left")
    own = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return both.select("id", F.array_except(own("_g"), own("_p")).alias("missed"), F.array_except(own("_p"), own("_g")).alias("invented"))
