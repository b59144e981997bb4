"""Ready-made collections: fields, surfaces and the gate of a vertical, as Columns over ``data`` and ``enriched`` (UD9, PP28)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound, first_filled, overlaps
from tessera.plans.model import Field

#: The least confidence of an enrichment that is indexed, by preset.
SURE = {"products": 0.4, "fashion": 0.5}
#: Fields of which an unsure one keeps a garment out.
BEARING = ["category", "gender", "colors"]
#: Categories of garments, and words that name them.
GARMENTS = {
    "tops": "shirt blouse top tee t-shirt sweater hoodie",
    "bottoms": "trousers jeans skirt shorts leggings pants",
    "dresses": "dress gown frock",
    "outerwear": "jacket coat blazer parka",
    "footwear": "shoe sneaker sandal boot heel",
    "accessories": "belt scarf hat cap bag watch",
}


@dataclass(frozen=True)
class Preset:
    """What an author of a preset gives: typed fields, texts by surface, and why a document isn't indexed (null if it is)."""

    fields: tuple[Field, ...]
    surfaces: dict[str, Callable[[], Column]]
    reason: Callable[[], Column]


def _data(path: str) -> Column:
    return F.get_json_object("data", f"$.{path}")


def _enriched(path: str) -> Column:
    return F.get_json_object("enriched", f"$.{path}")


def _many(path: str) -> Column:
    """Texts of an array, or of a single text; none where there is neither."""
    return bound(_enriched(path), lambda raw: F.coalesce(F.from_json(raw, "array<string>"), F.when(raw != "", F.array(raw)), F.array().cast("array<string>")))


def _sentence(lead: str, c: Column, end: str = ".") -> Column:
    return F.when(F.trim(c) != "", F.concat(F.lit(lead), c, F.lit(end)))


def _joined(*parts: Column, by: str = " ") -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(by, *[F.when(F.trim(p) != "", p) for p in parts]), r"\s+", " "))


def named_category(text: Column) -> Column:
    """The first category that a text names, by itself or by one of its garments; null if none."""

    def first(low: Column) -> Column:
        out = F.lit(None).cast("string")
        for category, names in reversed(GARMENTS.items()):
            hit = low.contains(category)
            for n in names.split():
                hit = hit | low.contains(n)
            out = F.when(hit, category).otherwise(out)
        return out

    return bound(F.lower(text), first)


def unsure(preset: str) -> Column:
    """Whether an enrichment's confidence is below the preset's least; an unknown one isn't."""
    return F.coalesce(_enriched("confidence").try_cast("double"), F.lit(1.0)) < SURE[preset]


def products_reason() -> Column:
    """Why a product isn't indexed: little confidence (PRJ10)."""
    return F.when(unsure("products"), "low-confidence")


def fashion_reason() -> Column:
    """Why a garment isn't indexed, the first that holds (PRJ9): no garment, no category, a price that isn't above 0, little
    confidence, doubt about what others rest on, or a text that names another category."""
    price = _data("price")
    said = named_category(_joined(F.coalesce(_data("title"), F.lit("")), F.concat_ws(" ", F.coalesce(F.from_json(_data("tags"), "array<string>"), F.array(F.coalesce(_data("tags"), F.lit(""))))), first_filled(_data("raw_type"), _data("product_type"))))
    found = first_filled(_enriched("category"))
    return (
        F.when(_enriched("is_apparel_product") == "false", "non-apparel")
        .when(found == "other", "category-other")
        .when((price != "") & (price.try_cast("double") <= 0), "invalid-price")
        .when(unsure("fashion"), "low-confidence")
        .when(overlaps(_many("uncertain_fields"), F.array(*map(F.lit, BEARING))), "uncertain-load-bearing")
        .when(said != found, "cross-signal-disagree")
    )


def fashion_text(rerank: bool = False) -> Column:
    """What a garment's vector is made of, graded traits only; for reranking with its plain attributes too (PRJ9)."""
    listed = lambda path, most=None: F.array_join(F.slice(_many(path), 1, most) if most else _many(path), ", ")
    known = lambda path, *no: F.when(~_enriched(path).isin(*no), _enriched(path))
    plain = [_sentence("Category: ", F.concat_ws(", ", _enriched("category"), F.concat(F.lit("type: "), _enriched("product_type")), F.concat(F.lit("for "), _enriched("gender")))), _sentence("Colors: ", listed("colors")), _sentence("Color name: ", _enriched("raw_color"))]
    fabric = [_sentence("Material: ", known("material", "unknown")), _sentence("Fit: ", known("fit", "unknown"))]
    return _joined(
        _sentence("", _data("title")),
        F.coalesce(_enriched("search_document"), F.lit("")),
        *(plain if rerank else [_sentence("Type: ", _enriched("product_type"))]),
        _sentence("Pattern: ", known("pattern", "solid")),
        *(fabric if rerank else []),
        _sentence("Occasions: ", listed("occasions")),
        _sentence("Style: ", listed("styles")),
        _sentence("Details: ", listed("details", 6)),
        F.when(_enriched("modesty") == "modest", "Modest coverage."),
    )


PRODUCTS = Preset(
    (Field("title", searchable=True), Field("category", "enum", "enriched.category", filterable=True, facet=True), Field("brand", filterable=True, facet=True), Field("price", "number", filterable=True, facet=True)),
    {"embed_doc": lambda: _joined(_data("title"), _enriched("search_document"), _enriched("category")), "fts_doc": lambda: _joined(_data("title"), _enriched("category"), _data("brand"))},
    products_reason,
)
FASHION = Preset(
    (Field("title", searchable=True), Field("category", "enum", "enriched.category", filterable=True, facet=True), Field("gender", "enum", "enriched.gender", filterable=True, facet=True), Field("colors", "array", "enriched.colors", filterable=True, facet=True, soft=True), Field("price", "number", filterable=True, facet=True)),
    {"embed_doc": fashion_text, "rerank_doc": lambda: fashion_text(True), "fts_doc": lambda: _joined(_data("title"), _enriched("product_type"), _enriched("raw_color"), F.array_join(_many("styles"), " "))},
    fashion_reason,
)
PRESETS = {"products": PRODUCTS, "fashion": FASHION}
