"""Every stage of the pipeline against the operator it calls, on one small folder."""

from collections import Counter

import corpus_pipeline as cp
import pytest
from test_suffixdedup import brute

from geoloom.llm import decontaminate, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.collect()]
    for _, stage in cp.STAGES:
        columns = docs.columns
        docs = spark.createDataFrame(stage(spark, docs, FOLDER).collect(), stage(spark, docs, FOLDER).schema)
        if stage is not cp.mix_sources:
            assert docs.columns == columns
        out.append(docs.collect())
    return out


def test_toxic_documents_go(spark, steps):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score_documents(docs, model).collect() if not r.rejected}
    assert {r.doc_id for r in steps[1]} == want and len(want) > 0.7 * len(steps[0])


def test_one_of_each_group_stays(steps):
    fps = [(r.doc_id, simhash.fingerprint(r.text) & (2**64 - 1)) for r in steps[1]]
    kept = {r.doc_id for r in steps[2]}
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 4 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert kept == set(label.values()) and len(kept) == len(steps[2])


def passages(texts, n=51):
    """Word strings of length n that begin in two places."""
    seen = Counter()
    for t in texts:
        ws = (t or "").encode().split()
        seen.update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    return {p for p, k in seen.items() if k > 1}


def test_repeats_are_cut(steps):
    texts = [(r.text or "").encode() for r in steps[2]]
    want = brute(texts, 400)
    after = {r.doc_id: r for r in steps[3]}
    assert len(after) == len(steps[2])
    untouched = 0
    for r, (n, removed, _, _) in zip(steps[2], want):
        got = after[r.doc_id].text
        assert len(got.encode()) <= n - removed and got.split() == [w for w in got.split() if w]
        assert after[r.doc_id].n_chars == len(got)
        untouched += got == r.text
    assert untouched > 0.4 * len(texts)
    assert len(passages([r.text for r in steps[2]])) > 100 and not passages([r.text for r in steps[3]])


def test_contaminated_documents_go(spark, steps):
    items = [decontaminate.words(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    grams = {}
    for ws in items:
        n = min(13, len(ws))
        grams.setdefault(n, set()).update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1) if n)
    kept = set()
    for r in steps[3]:
        ws, hit = decontaminate.words(r.text), set()
        for n, own in grams.items():
            for i in range(len(ws) - n + 1):
                if tuple(ws[i : i + n]) in own:
                    hit |= set(range(i, i + n))
        if not (hit and 20 * len(hit) >= len(ws)):
            kept.add(r.doc_id)
    assert {r.doc_id for r in steps[4]} == kept


def test_mixing_keeps_all(steps):
    assert sorted(r.doc_id for r in steps[5]) == sorted(r.doc_id for r in steps[4])
    assert [r.mix_slot for r in steps[5]] == sorted(r.mix_slot for r in steps[5])


def test_clashing_columns_and_hard_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    same = "A passage of some words that goes on and on in more than one text. " * 12
    rows = {
        "doc_id": [1, 2, 3, 3, None, 5], "text": [None, "", same + "one", same + "one", "two " * 30 + same, "kept text of a few words"],
        "lang": [None, "en", "en", "en", "de", "fr"], "source": ["a", None, "a", "a", "b", "b"], "n_chars": [0, 0, 1, 1, 2, 3],
    }
    more = {c: [c] * 6 for c in ("score", "rejected", "contamination", "spans", "k1", "fp", "component_id", "a.b", "_id", "_s", "_n1", "_score", "_spans", "_host")}
    for name, table in (("documents", rows | more), ("labels", {"doc_id": [1, 2], "toxic": [0, 1]}), ("benchmark", {"item_id": [1], "text": ["no such words"]})):
        pq.write_table(pa.table(table), tmp_path / f"{name}.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} >= {1, 5} and all(r[c] == c for r in got for c in more)
    assert all(same not in (r.text or "") for r in got) or len([r for r in got if r.doc_id in (3, None)]) == 1


def test_short_repeated_passages_are_cut(spark):
    def ws(a, n):
        return " ".join(f"w{k}" for k in range(a, a + n))

    long, short = ws(0, 51), ws(200, 50)
    assert len(long) < 400
    texts = [f"one  {long} {ws(1000, 30)}", f"{ws(2000, 30)}\n{long.replace(' ', '  ')} end", f"a {short} b", f"c {short} d", None, ""]
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.text for r in dict(cp.STAGES)["suffix_array_dedup"](spark, docs, FOLDER).collect()}
    assert got == {0: f"one   {ws(1000, 30)}", 1: f"{ws(2000, 30)}\n end", 2: texts[2], 3: texts[3], 4: None, 5: ""}


def test_run_leaves_no_repeated_passage(spark):
    texts = [r.text for r in cp.run(spark, FOLDER).collect()]
    assert texts and not passages(texts)


def hard_rows(spark, n):
    rows = [
        (1, None, None, "a", 0), (1, None, None, "a", 0), (None, "", "en", None, 0), (2, "one two three", "en", "b", 13), (2, "one two three", "en", "b", 13),
        (None, "x" * 5000, "xx", "b", 5000), (3, " \t\n", "de", "b", 3),
    ][:n]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_each_stage_takes_hard_rows(spark, name, stage):
    docs = hard_rows(spark, 7)
    got = stage(spark, docs, FOLDER).collect()
    count = {"simhash_near_dedup": 3}.get(name, 7)  # no words, three words, one long word
    assert len(got) == count
    if name == "suffix_array_dedup":
        assert all(len(r.text or "") == (r.n_chars or 0) for r in got)
    none = stage(spark, hard_rows(spark, 0), FOLDER)
    assert none.collect() == [] and none.columns[:5] == docs.columns
