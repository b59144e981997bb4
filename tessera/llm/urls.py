"""URL filtering by path templates: variable segments become wildcards, templates are judged by labelled purity.

Per host, paths form a tree of segments. Segments are generalised bottom-up by what they look like (numbers, hashes,
dates, slugs), then a set of sibling branches that are statistically alike is merged into a wildcard: siblings are
alike where there are many of them, each rarely seen, or where a chi-square test can't tell their labelled purity
apart. Every template then has a smoothed share of bad labels; those above the bound are rejected, except where there
are too few labelled pages to tell, so that a template without evidence is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import cut

#: A path position with more distinct segments than this, each seen in fewer than RARE of the host's pages on average, is a wildcard.
MANY, RARE = 8, 0.05
#: Beta prior of the share of bad pages: so many pages at the share of the whole corpus.
PRIOR = 4.0
#: Templates whose smoothed share of bad pages is above this are rejected, and least labelled pages for that.
IMPURE, LEAST = 0.5, 3
#: The chi-square value at one degree of freedom beyond which two branches differ (5 %).
CHI = 3.841
#: Forms of segments and what stands for them.
GENERAL = ((r"^\d{4}-\d{1,2}-\d{1,2}(\.[a-z]{2,5})?$", "<date>"), (r"^\d+(\.[a-z]{2,5})?$", "<n>"), (r"^[0-9a-f]{12,}(\.[a-z]{2,5})?$", "<hex>"), (r"^[^-<>]+(?:-[^-.]+){2,}(\.[a-z]{2,5})?$", "<slug>"))
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"
_NUMBER = r"^[^?#]*/(\d{1,18})(?:\.[A-Za-z]+)?/?(?:[?#]|$)"


def host_of(url: Column) -> Column:
    """The host in lower case without port, user and a leading ``www.``; null where there is none."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def segments_of(url: Column) -> Column:
    """The path's segments, without empty ones, query and fragment, each in a general form.

    Numbers become ``<n>``, long hexadecimal ones ``<hex>``, dates ``<date>``, and words of three parts or more joined by
    hyphens ``<slug>``; a file ending stays. Case is folded.
    """
    path = F.lower(F.regexp_extract(url, _PATH, 1))
    parts = F.filter(F.split(path, "/"), lambda s: s != "")

    def general(s: Column) -> Column:
        for pattern, name in GENERAL:
            s = F.regexp_replace(s, pattern, f"{name}$1")
        return s

    return F.transform(parts, general)


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, url, bad``: a page's label is that of the document whose number ends its path; null if there is none.

    Bad is of low quality or toxic. Labels that repeat an id count as bad if any is; those with a null id, or with
    nulls in both columns, say nothing. Null and malformed URLs have no label. Repeated pages stay; tables may be empty.
    """
    verdict = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    number = F.regexp_extract(pages["url"], _NUMBER, 1)
    rows = pages.select("page_id", "url", F.when(number != "", number).cast("long").alias("doc_id"))
    return rows.join(verdict, "doc_id", "left").select("page_id", "url", "bad")


def templates(pages: DataFrame) -> DataFrame:
    """``page_id, host, template, bad`` of each labelled page, from the tree of its host, level by level.

    At each level the children of a node are counted with their labels. A child is merged into ``*`` where its node
    has more than ``MANY`` children and the child has less than ``RARE`` of its pages, or where it has siblings and a
    chi-square test finds its purity no different from that of all siblings together, provided both have labelled
    pages. All levels of a path count. Only counts are shuffled between levels. A node that one path alone has is a
    chain without siblings, which nothing merges: its path is done, so that the number of rounds is the depth at
    which different paths of a host still share a node, not the length of the longest path. Pages without a host have
    a null template.
    """
    paths = pages.select("page_id", "bad", host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("parts"))
    counted = paths.where("host is not null").groupBy("host", "parts").agg(F.count("*").alias("n"), F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).withColumn("template", F.lit(""))
    counted = cut(counted)  # each level reads the one before twice
    columns = ("host", "parts", "n", "known", "bad", "template")
    done, live, level = counted.where(F.size("parts") == 0), counted.where(F.size("parts") > 0), 0
    while not live.isEmpty():
        level += 1
        child = F.element_at("parts", level)
        nodes = live.groupBy("host", "template", child.alias("segment")).agg(F.sum("n").alias("n"), F.sum("known").alias("known"), F.sum("bad").alias("bad"), F.count("*").alias("rows"))
        total = nodes.groupBy("host", "template").agg(F.count("*").alias("k"), F.sum("n").alias("all_n"), F.sum("known").alias("all_known"), F.sum("bad").alias("all_bad"), (F.sum("rows") == 1).alias("alone"))
        both = nodes.join(total, ["host", "template"])
        rest_known, rest_bad = F.col("all_known") - F.col("known"), F.col("all_bad") - F.col("bad")
        one = F.lit(1.0)
        mean = F.try_divide("all_bad", "all_known")
        gap = F.try_divide("bad", "known") - F.try_divide(rest_bad, rest_known)
        chi = F.when((mean > 0) & (mean < 1), F.try_divide(gap * gap, mean * (1 - mean) * (F.try_divide(one, F.col("known")) + F.try_divide(one, rest_known)))).otherwise(0.0)
        rare = (F.col("k") > MANY) & (F.col("n") < RARE * F.col("all_n"))
        alike = (F.col("k") > 1) & (F.col("known") > 0) & (rest_known > 0) & (chi < CHI)
        merged = both.select("host", "template", "segment", "alone", F.when(rare | F.coalesce(alike, F.lit(False)), "*").otherwise(F.col("segment")).alias("name"))
        longer = F.when(F.col("alone"), F.array_join(F.slice("parts", level, F.size("parts")), "/")).otherwise(F.col("name"))
        following = live.withColumn("segment", child).join(merged, ["host", "template", "segment"]).withColumn("template", F.concat("template", F.lit("/"), longer))
        following = cut(following.select(*columns, (F.col("alone") | (F.size("parts") == level)).alias("ends")))
        done = done.unionByName(following.where("ends").select(*columns))
        live = following.where("not ends").select(*columns)
    named = done.select("host", "parts", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"))
    return paths.join(named, ["host", "parts"], "left").select("page_id", "host", "template", "bad")


def url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, host, template, known, bad_share, keep`` of each page.

    ``bad_share`` is the template's share of bad pages, smoothed by ``PRIOR`` pages at the share of the corpus. A page
    is kept unless its template has ``LEAST`` labelled pages or more and a share above ``IMPURE``; a share equal to it
    is kept. Pages without a host (null, empty and malformed URLs) have no template and aren't kept. Repeated rows give
    repeated results and count as pages each. Paths are read whole, whatever their length. Other columns don't matter;
    an empty table gives an empty result, and without labels all pages with a host are kept.
    """
    rows = templates(labelled(pages, labels))
    each = rows.where("host is not null").groupBy("host", "template").agg(F.count("bad").alias("known"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad"))
    corpus = each.agg(F.try_divide(F.sum("n_bad"), F.sum("known")).alias("base"))  # one row
    share = (F.col("n_bad") + PRIOR * F.coalesce("base", F.lit(0.0))) / (F.col("known") + PRIOR)
    judged = each.crossJoin(F.broadcast(corpus)).select("host", "template", "known", F.round(share, 6).alias("bad_share"), ((F.col("known") < LEAST) | (share <= IMPURE)).alias("keep"))
    out = rows.select("page_id", "host", "template").join(judged, ["host", "template"], "left")
    return out.select("page_id", "host", "template", "known", "bad_share", F.coalesce("keep", F.lit(False)).alias("keep"))


def url_filter_sql() -> str:
    """:func:`url_filter` in DuckDB's SQL over ``pages`` and ``labels``."""
    general = "s"
    for pattern, name in GENERAL:
        general = f"regexp_replace({general}, '{pattern}', '{name}\\1')"
    ctes = [
        "verdict AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id)",
        f"numbered AS (SELECT page_id, url, try_cast(nullif(regexp_extract(url, '{_NUMBER}', 1), '') AS BIGINT) AS doc_id FROM pages)",
        f"paths AS (SELECT page_id, bad, nullif(regexp_replace(lower(regexp_extract(url, '{_HOST}', 1)), '^www[.]', ''), '') AS host,"
        f" list_transform(list_filter(string_split(lower(regexp_extract(url, '{_PATH}', 1)), '/'), lambda s: s <> ''), lambda s: {general}) AS parts FROM numbered LEFT JOIN verdict USING (doc_id))",
        # One round for each level, over the paths that reach it.
        "t AS (SELECT 0 AS level, host, parts, count(*)::BIGINT AS n, count(bad)::BIGINT AS known, coalesce(sum(bad), 0)::BIGINT AS bad, '' AS template FROM paths WHERE host IS NOT NULL GROUP BY host, parts UNION ALL"
        f" SELECT level + 1, host, parts, n, known, bad, template || '/' || CASE WHEN (k > {MANY} AND s_n < {RARE} * all_n) OR (k > 1 AND s_known > 0 AND all_known > s_known AND CASE WHEN all_bad > 0 AND all_bad < all_known THEN"
        " (s_bad::DOUBLE / s_known - (all_bad - s_bad)::DOUBLE / (all_known - s_known)) ^ 2 / ((all_bad::DOUBLE / all_known) * (1 - all_bad::DOUBLE / all_known) * (1.0::DOUBLE / s_known + 1.0::DOUBLE / (all_known - s_known))) ELSE 0 END"
        f" < {CHI}) THEN '*' ELSE segment END FROM (SELECT *, max(nth) OVER (PARTITION BY host, template) AS k FROM (SELECT *, parts[level + 1] AS segment, dense_rank() OVER (PARTITION BY host, template ORDER BY parts[level + 1]) AS nth,"
        " sum(n) OVER b AS s_n, sum(known) OVER b AS s_known, sum(bad) OVER b AS s_bad, sum(n) OVER a AS all_n, sum(known) OVER a AS all_known, sum(bad) OVER a AS all_bad"
        " FROM t WHERE len(parts) > level WINDOW a AS (PARTITION BY host, template), b AS (PARTITION BY host, template, parts[level + 1]))))",
        "rows AS (SELECT p.page_id, p.host, p.bad, CASE WHEN t.template = '' THEN '/' ELSE t.template END AS template FROM paths p LEFT JOIN t ON p.host = t.host AND p.parts = t.parts AND t.level = len(t.parts))",
        "each AS (SELECT host, template, count(bad) AS known, coalesce(sum(bad), 0)::DOUBLE AS n_bad FROM rows WHERE host IS NOT NULL GROUP BY host, template)",
        "base AS (SELECT sum(n_bad) / sum(known) AS base FROM each)",
        f"judged AS (SELECT host, template, known, (n_bad + {PRIOR} * coalesce(base, 0)) / (known + {PRIOR}) AS share FROM each, base)",
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT r.page_id, r.host, r.template, j.known, round(j.share, 6) AS bad_share, coalesce(j.known < {LEAST} OR j.share <= {IMPURE}, false) AS keep FROM rows r LEFT JOIN judged j ON r.host = j.host AND r.template = j.template"
