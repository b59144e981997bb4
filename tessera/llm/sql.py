"""DuckDB's SQL for operators that SQL can express over whole tables."""

from __future__ import annotations

from tessera.llm.minhash import NEAR, SHINGLE
from tessera.llm.repetition import MOST, MOST_LINES, ONCE
from tessera.llm.suffixes import PASSAGE
from tessera.llm.urls import url_filter_sql

_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
_WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{_WORD}')"


def repetition_sql() -> str:
    """Shares of repeated n-grams and lines, by windows over positions."""
    ctes = [
        f"d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL)",
        "w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d)",
        "t AS (SELECT rid, sum(strlen(word)) AS whole FROM w GROUP BY rid)",
        "l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)",
        "l1 AS (SELECT rid, strlen(line) AS size, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS later FROM l0 WHERE regexp_matches(line, '[^ \\t\\r]'))",
        "l AS (SELECT rid, sum(CASE WHEN later THEN size ELSE 0 END)::DOUBLE / greatest(sum(size), 1) AS share, count_if(later) = 1 AS once FROM l1 GROUP BY rid)",
    ]
    for n in MOST:
        gram = " || ' ' || ".join(["word", *(f"lead(word, {j}) OVER p" for j in range(1, n))])
        ctes += [
            f"a{n} AS (SELECT rid, pos, word, {gram} AS gram FROM w WINDOW p AS (PARTITION BY rid ORDER BY pos))",
            f"b{n} AS (SELECT rid, pos, word, CASE WHEN gram IS NOT NULL THEN row_number() OVER (PARTITION BY rid, gram ORDER BY pos) ELSE 1 END AS nth FROM a{n})",
            f"c{n} AS (SELECT rid, word, nth, nth > 1 AND coalesce(lag(nth) OVER (PARTITION BY rid ORDER BY pos), 1) = 1 AS begins, max((nth > 1)::INT) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS inside FROM b{n})",
            f"g{n} AS (SELECT rid, sum(CASE WHEN inside = 1 THEN strlen(word) ELSE 0 END)::DOUBLE AS covered, count_if(begins) = 1 AND max(nth) < 3 AS once FROM c{n} GROUP BY rid)",
        ]
    shares = {"line_share": ("coalesce(l.share, 0)", MOST_LINES, "l.once")} | {f"gram{n}_share": (f"coalesce(g{n}.covered / t.whole, 0)", m, f"g{n}.once") for n, m in MOST.items()}
    fine = " AND ".join(f"({x} <= {m} OR ({once} AND {x} < {ONCE}))" for x, m, once in shares.values())
    joins = " ".join(f"LEFT JOIN {x} ON {x}.rid = d.rid" for x in ("t", "l", *(f"g{n}" for n in MOST)))
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, len(ws)::INT AS n_words, {', '.join(f'{x} AS {k}' for k, (x, *_) in shares.items())}, len(ws) > 0 AND {fine} AS keep FROM d {joins}"


def near_groups_sql() -> str:
    """Groups from the exact Jaccard coefficient of all pairs that share a shingle."""
    s = SHINGLE
    return (
        f"WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS ws FROM (SELECT doc_id, min(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY 1)),"
        f" s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {s} THEN list_transform(range(1, len(ws) - {s - 2}), lambda i: array_to_string(ws[i:i + {s - 1}], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM d),"
        " n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),"
        f" p AS (SELECT a, b FROM c JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE c::DOUBLE / (m.n + o.n - c) >= {NEAR}),"
        " e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, b AS root FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.root = e.a),"
        " f AS (SELECT node AS doc_id, least(node, min(root)) AS group_id FROM r GROUP BY node) SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM f"
    )


def repeated_passages_sql() -> str:
    """Spans of all windows of PASSAGE words that are there twice; words' places from the lengths of words and gaps."""
    n = PASSAGE
    return (
        f"WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL), k AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws, regexp_split_to_array(lower(text), '{_WORD}') AS gaps FROM d),"
        " w AS (SELECT rid, pos, sum(length(gap) + length(word)) OVER (PARTITION BY rid ORDER BY pos) AS e, length(word) AS size FROM (SELECT rid, unnest(ws) AS word, unnest(gaps[1:len(ws)]) AS gap, generate_subscripts(ws, 1) AS pos FROM k WHERE len(ws) > 0)),"
        f" g AS (SELECT rid, i, md5(array_to_string(ws[i:i + {n - 1}], ' ')) AS h FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS i FROM k WHERE len(ws) >= {n})),"
        " t AS (SELECT h FROM g GROUP BY 1 HAVING count(*) > 1),"
        f" s AS (SELECT g.rid, a.e - a.size AS b, z.e AS e FROM g JOIN t USING (h) JOIN w a ON a.rid = g.rid AND a.pos = g.i JOIN w z ON z.rid = g.rid AND z.pos = g.i + {n - 1}),"
        " m AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY rid ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s), o AS (SELECT *, sum(new) OVER (PARTITION BY rid ORDER BY b, e) AS island FROM m)"
        ' SELECT doc_id, min(b)::INT AS "start", max(e)::INT AS "end" FROM o JOIN k USING (rid) GROUP BY rid, doc_id, island'
    )


ORACLE_SQL = {"op1_near_duplicates": near_groups_sql(), "op2_repetition": repetition_sql(), "op4_urls": url_filter_sql(), "op9_repeated_passages": repeated_passages_sql()}
