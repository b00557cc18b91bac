"""Queries with SQL, on the smallest given tables and on a folder of hard rows."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from llm_compare import TABLES, differences

from geoloom.llm import registry

WITH_SQL = [name for name, (_, sql) in registry.load().items() if sql]


def hard_vectors() -> dict:
    rng = np.random.default_rng(9)
    rows = rng.normal(0, 1, (60, 64)).round(3).tolist()
    rows += [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, *([[0.25] * 64] * 40), rows[0]]
    return {"vec_id": pa.array([*range(len(rows) - 2), None, 3], pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": [0] * len(rows)}


def hard_tables(empty: bool) -> dict:
    rng = np.random.default_rng(4)
    words = ["The", "and", "ünder", "x1", "über", "of", "A", "b", "c", "d_e", "É", "ß"]

    def prose(n):
        return " ".join(rng.choice(words, n))

    item = prose(20)
    texts = [None, "", " \t\n\r\x0b\x0c ", item, item.upper(), "pre " + item[:40] + " post", "short item", "SHORT\nITEM", prose(500) + item + prose(400),
             "a\n\na\nb\n \nb\nb", "same words here again " * 30, "# * $ % & | < >", "x" * 40000, item + "\x00" + item, prose(60), prose(60)]
    texts += [f"Line {k} of a text\n" * 3 + prose(40) for k in range(120)] + [prose(30) + " ###" * 40]
    n = len(texts)
    docs = {
        "doc_id": [*range(n - 2), None, 3], "text": texts, "lang": [None if k % 50 == 7 else ("en" if k % 3 else "de") for k in range(n)],
        "source": [None if k % 40 == 9 else ("big" if k % 4 else f"s{k % 7}") for k in range(n)], "n_chars": [len(t or "") for t in texts],
    }
    bench = {"item_id": [0, 1, 2, 3, 3, 10, 11], "text": [item, None, "", "short ITEM", "short ITEM", "x1", prose(25)]}
    urls = [None, "", "no scheme", "http://Example.ORG/es/x", "https://a.b.example.org/en/12?q=/de/", "ftp://COM", "http://x.com/de/", "http://x.com/fr/#a",
            "http://notcom.net/de/", "http://spam-farm.example.net/a/", "http://spam-farm.example.net/a?x", "http://www.spam-farm.example.net/a", "://", "http://h://b/c",
            "http://x.com\n/de/", "HTTP://org", "http://org/", "http://a.net/é?", "http://example.org/en/1", "http://casino-win.example.net"]
    html = "<html><body><nav>menu</nav><article><h1>T &amp; t</h1><p>one  two<br>three<p>four &quot;x&quot;</article></body></html>"
    pages = {"page_id": [*range(len(urls) - 1), 4], "url": urls, "html": [None, "", html, html * 1] + [html.replace("four", f"four {k}") for k in range(len(urls) - 4)]}
    conv = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, None, None), (3, 0, "", ""), (4, 5, "user", "alone"),
            (6, 0, "user", "q"), (6, 0, "user", "q"), (6, 0, "assistant", "é"), (7, 0, "assistant", "é"), (7, None, "user", "q"), (None, 0, "user", "lost"),
            (8, 0, "user", "same"), (9, 0, "user", "same"), (11, 0, "assistant", "only rejected")]
    out = {
        "documents": docs, "benchmark": bench, "pages": pages,
        "conversations": dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*conv)))),
        "labels": {"doc_id": [1, 2], "quality": [0, 1], "toxic": [0, 1]}, "embeddings": hard_vectors(),
    }
    tables = {k: pa.table(v) for k, v in out.items()}
    return {k: t.slice(0, 0) for k, t in tables.items()} if empty else tables


@pytest.fixture(scope="module", params=["hard", "empty"])
def folder(request, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    for name, table in hard_tables(request.param == "empty").items():
        pq.write_table(table, path / f"{name}.parquet")
    assert set(TABLES) == {p.stem for p in path.iterdir()}
    return str(path)


@pytest.mark.parametrize("name", WITH_SQL)
def test_given_tables(spark, name):
    assert differences(spark, name, "/root/testdata/sf0.001") == []


@pytest.mark.parametrize("name", WITH_SQL)
def test_hard_tables(spark, folder, name):
    assert differences(spark, name, folder) == []


def test_every_query_runs_on_hard_tables(spark, folder):
    for name in [n for n in registry.load() if n not in WITH_SQL]:
        rows = registry.load()[name][0](spark, folder).count()
        assert rows == (spark.read.parquet(f"{folder}/documents.parquet").count() if name != "pipeline" else rows)
