"""Users' columns named like working columns pass through."""

from geoloom.llm import simhash, urlfilter
from geoloom.llm.names import free_names

OWN = "_id _n1 _N2 _nth fp root canonical _canonical _rule _block _w0 _hit _found __hit"


def table(spark, rows, schema):
    own = OWN.split()
    return spark.createDataFrame([(*r, *(["own"] * len(own))) for r in rows], schema + "".join(f", {c} string" for c in own))


def test_free_names(spark):
    docs = table(spark, [(1,)], "a int")
    names = free_names("a hit", docs)
    assert len(set(names)) == 2 and not {n.lower() for n in names} & {c.lower() for c in docs.columns}


def test_urls(spark):
    pages = table(spark, [(1, "http://a.com/x"), (2, "http://b.com/"), (3, None)], "page_id int, url string")
    got = urlfilter.filter_urls(pages, pages.where("page_id = 2"), urlfilter.RULES)
    assert got.columns == [*pages.columns, *urlfilter.RESULTS]
    rows = got.collect()
    assert {r.page_id: r.verdict for r in rows} == {1: "allow", 2: "block", 3: "allow"} and all(r[c] == "own" for r in rows for c in OWN.split())


def test_near_duplicates(spark):
    docs = table(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, "other words here and there"), (4, None)], "doc_id long, text string")
    rows = simhash.keep_one(docs).collect()
    assert {r.doc_id for r in rows} == {1, None, 4} and all(r[c] == "own" for r in rows for c in OWN.split())
