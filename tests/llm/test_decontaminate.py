"""Benchmark items without an id."""

from geoloom.llm import decontaminate as dc


def test_items_without_id_hit_words(spark):
    ws = [f"w{k}" for k in range(60)]
    docs = spark.createDataFrame([(1, " ".join(ws[:20])), (2, " ".join(ws[20:40])), (3, "clean words only")], "doc_id long, text string")
    items = [(None, " ".join(ws[2:16])), ("a", " ".join(ws[3:18])), (None, " ".join(ws[20:34])), ("b", None)]
    items = spark.createDataFrame(items, "item_id string, text string")
    for chars in (dc.BLOCK_CHARS, 10):
        found = dc.find_spans(docs, items, block_chars=chars)
        got = {r.doc_id: r for r in found.select("doc_id", "contamination.items", dc.hit_words().alias("n"), dc.is_contaminated().alias("bad")).collect()}
        assert {k: (r["items"], r.n, r.bad) for k, r in got.items()} == {1: (["a", None], 16, True), 2: ([None], 14, True), 3: ([], 0, False)}
