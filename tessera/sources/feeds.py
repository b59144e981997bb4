"""Product feeds as documents ``id, data`` (JSON text), by kind of feed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import content_hash, strip_html

_SHOPIFY = "products array<struct<id:bigint,title:string,handle:string,body_html:string,vendor:string,product_type:string,tags:string,variants:array<struct<price:string,available:boolean>>,images:array<struct<src:string>>>>"
_WOO = "array<struct<id:bigint,name:string,permalink:string,description:string,is_in_stock:boolean,prices:struct<price:string,currency_minor_unit:int,currency_code:string>,categories:array<struct<name:string>>,images:array<struct<src:string>>>>"


def _documents(rows: DataFrame, key: Column) -> DataFrame:
    """Rows of fields as ``id, data, content_hash``; those without an id or title drop out (SRC1)."""
    data = F.struct(*rows.columns)
    hashed = content_hash(*[F.col(c) if c in rows.columns else F.lit(None) for c in ("title", "description", "price", "image", "available", "type")], F.array_join("tags", ",") if "tags" in rows.columns else F.lit(None))
    return rows.select(key.cast("string").alias("id"), F.to_json(data).alias("data"), hashed.alias("content_hash"), F.col("title").alias("_title")).where("id is not null and _title is not null").drop("_title")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One object a line, ``{"id": ..., "data": {...}}``; the id falls back to ``data.external_id`` (SRC1)."""
    rows = spark.read.text(path)
    return lines(rows.select("value"))


def lines(rows: DataFrame) -> DataFrame:
    """As :func:`json_lines`, from a column ``value`` (SRC2)."""
    at = lambda p: F.get_json_object("value", p)
    key, data = F.coalesce(at("$.id"), at("$.data.external_id")), at("$.data")
    out = rows.select(key.alias("id"), data.alias("data"), at("$.data.title").alias("_title")).where("id is not null and _title is not null").drop("_title")
    part = lambda p: F.get_json_object("data", f"$.{p}")
    return out.withColumn("content_hash", content_hash(*[part(p) for p in ("title", "description", "price", "image", "available", "type", "tags")]))


def _tags(c: Column) -> Column:
    """Tags as an array, given as one or as one text with commas (PRJ11); blank ones drop out."""
    many = F.coalesce(F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>")), F.split(c, ","))
    return F.filter(F.transform(many, lambda x: F.trim(x)), lambda x: x != "")


def shopify(pages: DataFrame, shop: str) -> DataFrame:
    """Documents of a column ``value`` of product pages as a shop gives them (SRC3, SRC4, PRJ11)."""
    p = pages.select(F.explode(F.from_json("value", T._parse_datatype_string(_SHOPIFY))["products"]).alias("p"))
    rows = p.select(
        F.col("p.id").alias("external_id"),
        F.col("p.title").alias("title"),
        strip_html(F.col("p.body_html")).alias("description"),
        F.col("p.vendor").alias("brand"),
        F.col("p.product_type").alias("type"),
        _tags(F.col("p.tags")).alias("tags"),
        F.get("p.variants", F.lit(0))["price"].try_cast("double").alias("price"),
        F.coalesce(F.exists("p.variants", lambda v: v["available"]), F.lit(False)).alias("available"),
        F.get("p.images", F.lit(0))["src"].alias("image"),
        F.concat(F.lit(f"https://{shop}/products/"), F.col("p.handle")).alias("url"),
    )
    return _documents(rows, F.col("external_id"))


def woo(pages: DataFrame) -> DataFrame:
    """Documents of a column ``value`` of store pages; prices come in minor units (SRC5, PRJ12)."""
    p = pages.select(F.explode(F.from_json("value", _WOO)).alias("p"))
    rows = p.select(
        F.col("p.id").alias("external_id"),
        F.col("p.name").alias("title"),
        strip_html(F.col("p.description")).alias("description"),
        (F.col("p.prices.price").try_cast("double") / F.pow(F.lit(10.0), F.coalesce("p.prices.currency_minor_unit", F.lit(2)))).alias("price"),
        F.col("p.is_in_stock").alias("available"),
        F.array_join(F.transform("p.categories", lambda c: c["name"]), ", ").alias("type"),
        F.get("p.images", F.lit(0))["src"].alias("image"),
        F.col("p.permalink").alias("url"),
    )
    return _documents(rows, F.col("external_id"))


#: Readers by kind, each of (spark, definition) (SRC6).
READERS = {
    "jsonl": lambda spark, d: json_lines(spark, d["path"]),
    "shopify": lambda spark, d: shopify(spark.read.text(d["path"], wholetext=True), d.get("shop", "")),
    "woocommerce": lambda spark, d: woo(spark.read.text(d["path"], wholetext=True)),
}


def pull(spark: SparkSession, definitions: list[dict]) -> DataFrame:
    """Documents of several feeds; of an id that several have, the first feed's stays (SRC7)."""
    for d in definitions:
        if d["kind"] not in READERS:
            raise ValueError(f"{d['kind']} is no kind of feed")
    parts = [READERS[d["kind"]](spark, d).withColumn("_feed", F.lit(i)) for i, d in enumerate(definitions)]
    nth = F.row_number().over(Window.partitionBy("id").orderBy("_feed", "content_hash"))
    return reduce(DataFrame.unionByName, parts).withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_feed")


def grid(rows: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Lines of a sheet given as ``seq, cells``: the first row that names all required columns is the header (SRC9).

    Rows below it with a part number and a quantity above 0 stay.
    """
    low = F.transform("cells", lambda c: F.lower(F.trim(c)))
    place = {k: F.coalesce(*[F.nullif(F.array_position(low, a.lower()), F.lit(0)) for a in names]) for k, names in aliases.items()}
    heads = rows.select("seq", F.struct(*[v.alias(k) for k, v in place.items()]).alias("at"))
    for k in required:
        heads = heads.where(F.col(f"at.{k}").isNotNull())
    first = heads.agg(F.min_by("at", "seq").alias("at"), F.min("seq").alias("head"))
    body = rows.crossJoin(F.broadcast(first)).where("seq > head")
    out = body.select("seq", *[F.trim(F.get("cells", F.col(f"at.{k}").cast("int") - 1)).alias(k) for k in aliases])
    return out.where((F.coalesce(F.col("sku"), F.lit("")) != "") & (F.col("qty").try_cast("double") > 0))
