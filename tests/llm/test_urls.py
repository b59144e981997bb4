import duckdb
import pytest

from tessera.llm.urls import host_of, segments_of, url_filter, url_filter_sql


def pages():
    rows = [(i, f"https://www.good.example.org/en/{i}.html?x=1#top") for i in range(40)]
    rows += [(100 + i, f"http://mixed.example.net:80/spam/{100 + i}/") for i in range(12)]
    rows += [(200 + i, f"http://mixed.example.net/news/2024-01-0{1 + i % 9}/a-long-title-{i}/{200 + i}") for i in range(12)]
    rows += [(300 + i, f"http://u@deep.example.com/a/b/c/d/e/f/{i}") for i in range(3)] + [(400 + i, f"https://tags.example.com/tag{i}/{400 + i}") for i in range(30)]
    for i in range(12):  # branches that differ only at the eighth level of ten
        rows += [(600 + i, f"http://far.example.com/1/a/b/c/d/e/f/spam/x/{600 + i}"), (700 + i, f"http://far.example.com/1/a/b/c/d/e/f/sport/x/{700 + i}")]
    rows += [(800, "http://long.example.com/" + "s/" * 600 + "1"), (801, "http://long.example.com/" + "s/" * 2 + "2")]
    return rows + [(500, None), (501, ""), (502, "not a url"), (503, "http://good.example.org"), (504, "http:///x/1"), (None, "https://good.example.org/en/5"), (0, rows[0][1]), (0, rows[0][1])]


def labels():
    rows = [(i, 1, 0) for i in range(0, 40, 2)] + [(100 + i, 0, 0) for i in range(8)] + [(200 + i, 1, 0) for i in range(9)] + [(400 + i, 1, i % 2) for i in range(30)] + [(600 + i, 0, 0) for i in range(8)] + [(700 + i, 1, 0) for i in range(9)]
    return rows + [(100, 1, 0), (None, 0, 1), (7, None, None)]


def both(spark, pages_, labels_):
    df = spark.createDataFrame([(*r, "x") for r in pages_], "page_id long, url string, host string").repartition(3)
    tags = spark.createDataFrame([(*r, "x") for r in labels_], "doc_id long, quality int, toxic int, url string")
    return url_filter(df, tags)


@pytest.mark.parametrize("some", [slice(None), slice(0)])
def test_against_sql(spark, some):
    names = ["page_id", "host", "template", "known", "bad_share", "keep"]
    got = [tuple(r) for r in both(spark, pages()[some], labels()[some]).select(names).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR); CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    for table, rows, signs in (("pages", pages()[some], "?, ?"), ("labels", labels()[some], "?, ?, ?")):
        for row in rows:
            con.execute(f"INSERT INTO {table} VALUES ({signs})", row)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({url_filter_sql()})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_verdicts(spark):
    got = {r.page_id: r for r in both(spark, pages(), labels()).collect()}
    assert got[0].template == "/en/*" or got[0].template == "/en/<n>.html"
    assert got[0].keep and got[200].keep and not got[100].keep and not got[111].keep  # unlabelled pages follow their template
    assert got[100].template.startswith("/spam/") and got[200].template != got[100].template
    assert got[400].template == got[429].template == "/*/<n>" and got[300].template == "/a/b/c/d/e/f/<n>"
    assert not got[611].keep and got[711].keep and got[600].template == "/<n>/a/b/c/d/e/f/spam/x/<n>"
    assert got[800].template == "/" + "s/" * 600 + "<n>" and got[801].template == "/s/s/<n>"
    assert not any(got[i].keep for i in (500, 501, 502, 504)) and got[503].template == "/"


def test_forms(spark):
    df = spark.createDataFrame([("HTTPS://User@WWW.Ex.org:8/A/1.HTML/deadbeef12345/x-y-z/2020-1-2?q",)], "url string")
    row = df.select(host_of(df.url).alias("h"), segments_of(df.url).alias("s")).first()
    assert row.h == "ex.org" and row.s == ["a", "<n>.html", "<hex>", "<slug>", "<date>"]
