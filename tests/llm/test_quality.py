"""Adaptive fences: they differ between groups, follow the sketches, keep clean documents and reject junk."""

from pyspark.sql import functions as F

from geoloom.llm import quality as q

FOLDER = "/root/testdata/sf0.1"


def test_fences_differ_and_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    judged = q.judge(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {r.quality: r.share for r in judged.collect()}
    assert share[1] > 0.995 and share[0] < 0.1


def rows(group, spread, n=80):
    """Counted documents of one group; stutter between 0 and ``spread`` words of 200."""
    return [("=en", f"={group}", False, 200, 1000, 0, 10, 0, 0, k % (spread + 1)) for k in range(n)]


def test_fences_follow_the_group(spark):
    schema = "lang_key string, source_key string, base_failed boolean, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_stutter long"
    counted = spark.createDataFrame(rows("calm", 0) + rows("wild", 20) + rows("few", 3, 10), schema)
    found = {r.source_key: r for r in q.fences(q.sketch(counted)).collect()}
    assert found["=wild"].hi_stutter > found["=calm"].hi_stutter
    # an even group: the margin of its language, or one event of a text of median size where that is even too
    assert found["=calm"].hi_symbols == q.SPREAD * (1000 // 200) and found["=calm"].hi_dup_lines == q.SPREAD * 100
    assert found["=calm"].hi_stutter > q.SPREAD * 5 and found["=calm"].hi_word_length == 5000 >> 6 << 6
    whole = spark.createDataFrame([r[:1] + ("=all",) + r[2:] for r in rows("calm", 0) + rows("wild", 20) + rows("few", 3, 10)], schema)
    assert found["=few"].hi_stutter == q.fences(q.sketch(whole)).first().hi_stutter  # too small: its language decides
