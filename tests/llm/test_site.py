import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tessera.llm.site import Node, _pack, _unpack, content, importances, main_text, nodes, parse


def test_parse_mends_what_is_broken():
    root = parse('<p>a<p>b<b>c</p>d<!-- <i>x</i> --><script>var t="</p>";</script><br>e</div>&amp;<img src=x>f')
    shape = lambda n: (n.tag, [shape(c) if isinstance(c, Node) else c for c in n.children])
    assert shape(root) == ("", [("p", ["a"]), ("p", ["b", ("b", ["c"])]), "d", ("br", []), "e", "&amp;", ("img", []), "f"])
    assert content('<p>a<p>b&amp;c<script>x</script> d\n e', set()) == "a\nb&c d e"
    for text in (None, "", "<", "<<p>", "no tags", "<p" * 50, "<div>" * 3000 + "x"):
        assert isinstance(content(text, set()), str)


def test_packing():
    word, n, weight = np.array([0, 5, 2**32 - 1], np.uint32), np.array([1.0, 3, 1]), np.array([0, 1.5, 0])
    assert all((a == b).all() for a, b in zip(_unpack(_pack(word, n, weight)), (word, n, weight)))


def site(pages=60, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioustnrl") for _ in range(rng.randint(3, 8)))
    out = []
    for i in range(pages):
        body = "".join(f"<p>{' '.join(word() for _ in range(rng.randint(20, 60)))}</p>" for _ in range(rng.randint(1, 5)))
        html = f'<html><head><title>t</title></head><body><nav class="menu{i}"><a href="/a">Home</a><a href="/b">About us</a></nav><div id="main"><h1>{word()} {word()}</h1>{body}</div><footer>&copy; Example Company</footer></body></html>'
        out.append((i, f"https://site.example.com/{i}", html))
    return out


def brute_force(rows):
    """Leaf importance of each path by the definition, from all pages at once."""
    pages, at = {}, {}
    for i, _, html in rows:
        for node in nodes(parse(html)):
            own = " ".join(c for c in node.children if isinstance(c, str))
            pages.setdefault(node.key, set()).add(i)
            for w in re.findall(r"\w+", own.lower()):
                counts = at.setdefault(node.key, {}).setdefault(w, {})
                counts[i] = counts.get(i, 0) + 1
    out = {}
    for key, features in at.items():
        m = len(pages[key])
        h = [-sum(c / sum(by.values()) * math.log(c / sum(by.values()), m) for c in by.values()) for by in features.values()]
        out[key] = 1 - sum(h) / len(h)
    return out


def test_importance_against_the_definition(spark):
    rows = [(i, u, re.sub(' href="[^"]*"', "", h)) for i, u, h in site()]
    from tessera.llm import site as module

    df = spark.createDataFrame([("site.example.com", h) for _, _, h in rows], "host string, html string").repartition(4)
    raw = df.mapInArrow(module._counts, module._KINDS).repartition("host", "node", "part").sortWithinPartitions("host", "node", "part")
    each = raw.mapInArrow(module._nodes, "host string, node long, pages double, styles double, tags double, content double, features long, parent long")
    node = each.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("pages", "styles", "content", "features")), F.max("tags").alias("tags"), F.max("parent").alias("parent"))
    table = [r.asDict() for r in node.collect()]
    got = importances(table)
    children = {r["parent"] for r in table}
    for key, want in brute_force(rows).items():
        signed = key - (1 << 64) if key >= 1 << 63 else key
        if signed not in children:
            assert abs(got[signed] - want) < 1e-5


def test_main_content_stays_and_template_goes(spark):
    rows = site()
    extra = [(900, None, "<p>x"), (901, "no url", "<p>y<script>z</script>"), (902, "https://site.example.com/x", None), (903, "https://site.example.com/y", ""), (904, "https://tiny.example.com/", "<nav>menu</nav><p>text"), (None, "https://tiny.example.com/", "<p>z"), rows[0]]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows + extra], "page_id long, url string, html string, host string, text string").repartition(4)
    got = {}
    for r in main_text(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[900] == ["x"] and got[901] == ["y"] and got[902] == got[903] == [""] and got[904] == ["menu\ntext"] and got[None] == ["z"] and len(got[0]) == 2
    for i, _, html in rows:
        want = [t for t in re.findall(r"<(?:h1|p)>([^<]*)<", html)]
        assert got[i][0].split("\n") == want


def test_hosts_of_few_pages(spark):
    rows = [(10 * n + i, f"https://few{n}.example.com/{i}", h) for n in (2, 3) for i, _, h in site(n, seed=n)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, _, html in rows:
        want = re.findall(r"<(?:h1|p)>([^<]*)<", html)
        assert [x for x in got[i].split("\n") if x not in ("Home About us", "HomeAbout us")] == want and "Example Company" not in got[i], got[i]


def test_parsing_takes_time_in_proportion():
    import time

    for made in (lambda n: "<i>" * n + "</x>" * n, lambda n: "<li><div>" + "<i>" * n + "<li></li>" * n):
        took = []
        for n in (4000, 16000):
            began = time.process_time()
            parse(made(n))
            took.append(time.process_time() - began)
        assert took[1] < 10 * took[0] + 0.5


def test_empty_table(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
