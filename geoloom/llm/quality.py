"""Quality rules with thresholds adapted to each language and source.

Per document a few counts are taken with built-in functions. Their rates and sizes go into quantile sketches: counts
by bucket, exact below 128 and within 1/64 above, which merge by adding. Sketches are kept by language and
source, and merged into sketches by language and of all. A group with fewer than ``LEAST`` documents takes
the sketch of its language, then that of all.

Every fence comes from the sketches; there is no fixed cutoff. The upper fence of a rate is its 7/8 quantile plus
``SPREAD`` margins. A margin is the distance from the median to that quantile, the larger of the group's and its language's
(of all documents, where both are zero), and at least what one event (a symbol, an equal line, a stuttered word, a
repeated window of words) adds to the rate of a text of the group's median size, so an even group does not
reject a text for a single event. The mean word length has a lower fence from the 1/8 quantile as well.
The table of fences, one row a group, is joined back and decides.

Equal 8-word windows are found by 64-bit hashes inside one text. Defined cases: a null text has no words;
an empty text fails the base rule; null languages and sources are groups of their own; repeated rows count
as often as they occur; an empty table gives no rows; other columns are left out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.plans.scratch import materialize

REPEAT = 8
LEAST, SPREAD = 50, 5
#: rate -> (size it is a share of, how much of that one event makes up)
EVENT = {
    "symbols": ("n_words", 1), "dup_lines": ("n_lines", 1), "stutter": ("n_words", 1), "repeat": ("n_words", 2 * REPEAT),
    "word_length": ("n_words", 0),
}
SIZES = ("n_words", "n_lines")
_SPACE = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without ``text`` but with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stutter.

    n_stutter: words equal to the word before them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    core = F.btrim(body, F.lit(_SPACES))
    one = docs.withColumn("_words", F.when(F.length(core) > 0, F.split(core, _SPACE)).otherwise(F.array().cast("array<string>")))
    one = one.withColumn("_lines", F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACES))) > 0))
    n = F.size("_words")
    at = F.when(n >= REPEAT, F.sequence(F.lit(1), n - (REPEAT - 1))).otherwise(F.array().cast("array<int>"))
    two = one.withColumn("_grams", F.transform(at, lambda i: F.xxhash64(F.slice("_words", i, REPEAT))))
    # only texts with an equal pair are sorted
    pairs = F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), F.array_sort(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    three = two.withColumn("_pairs", pairs)

    def twin(x: Column, k: Column) -> Column:
        return F.get("_pairs", k - 1)["g"].eqNullSafe(x["g"]) | F.get("_pairs", k + 1)["g"].eqNullSafe(x["g"])

    four = three.withColumn("_twins", F.array_sort(F.transform(F.filter("_pairs", twin), lambda x: x["i"])))
    steps = F.zip_with("_twins", F.slice("_twins", 2, F.greatest(F.size("_twins"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(REPEAT)), F.lit(REPEAT)))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0))
    pairwise = F.zip_with("_words", F.slice("_words", 2, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
    kept = [c for c in docs.columns if c != text]
    return four.select(
        *(F.col(f"`{c}`") for c in kept),
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size(F.filter(pairwise, lambda x: x)).cast("long").alias("n_stutter"),
    )


def _rates() -> dict[str, Column]:
    """Whole numbers per thousand."""

    def rate(count: str, of: str) -> Column:
        return F.expr(f"{count} * 1000 div greatest({of}, 1)")

    return {
        "symbols": rate("n_symbols", "n_words"), "dup_lines": rate("n_dup_lines", "n_lines"),
        "stutter": rate("n_stutter", "n_words"), "repeat": rate("n_repeat_words", "n_words"),
        "word_length": rate("word_chars", "n_words"),
    }


def bucket(x: Column) -> Column:
    """The lower border of the bucket of a whole number: exact below 128, seven leading bits above."""
    shift = F.greatest(F.length(F.bin(x)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketch(counted: DataFrame) -> DataFrame:
    """(lang_key, source_key, rate, bucket, n) over the documents that pass the base rule; sizes are sketched as rates are."""
    measures = _rates() | {k: F.col(k) for k in SIZES}
    rates = F.array(*(F.struct(F.lit(k).alias("rate"), bucket(v).alias("bucket")) for k, v in measures.items()))
    each = counted.where("not base_failed").select("lang_key", "source_key", F.explode(rates).alias("x"))
    return each.groupBy("lang_key", "source_key", "x.rate", "x.bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame) -> DataFrame:
    """(l, s, <measure>_lo, _mid, _hi): eighth, median and seven eighths of each group, each language (s '*') and of all."""
    every = F.lit("*")
    levels = F.array(
        F.struct(F.col("lang_key").alias("l"), F.col("source_key").alias("s")),
        F.struct(F.col("lang_key").alias("l"), every.alias("s")),
        F.struct(every.alias("l"), every.alias("s")),
    )
    merged = sketches.withColumn("x", F.explode(levels)).groupBy("x.l", "x.s", "rate", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("l", "s", "rate")
    ranked = merged.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("total", F.sum("n").over(whole))
    out = []
    for name in (*EVENT, *SIZES):
        for part, eighths in (("lo", 1), ("mid", 4), ("hi", 7)):
            reached = (F.col("rate") == name) & (F.col("upto") * 8 >= F.col("total") * eighths)
            out.append(F.min(F.when(reached, F.col("bucket"))).alias(f"{name}_{part}"))
    return ranked.groupBy("l", "s").agg(*out)


def fences(sketches: DataFrame) -> DataFrame:
    """(lang_key, source_key, hi_<rate> ..., lo_word_length): thresholds for every group with documents."""
    groups = sketches.where(F.col("rate") == SIZES[0]).groupBy("lang_key", "source_key").agg(F.sum("n").alias("own"))
    groups = groups.withColumn("of_lang", F.sum("own").over(Window.partitionBy("lang_key")))
    every, large = F.lit("*"), F.col("of_lang") >= LEAST
    groups = groups.withColumn("use_source", F.when(F.col("own") >= LEAST, F.col("source_key")).otherwise(every))
    groups = groups.withColumn("use_lang", F.when(large, F.col("lang_key")).otherwise(every))
    at = materialize(quantiles(sketches), "quantiles")

    def level(mark: str, lang: Column, source: Column) -> tuple[DataFrame, Column]:
        named = at.select(*(F.col(c).alias(f"{mark}{c}") for c in at.columns))
        return named, (F.col(f"{mark}l") == lang) & (F.col(f"{mark}s") == source)

    met = groups
    for mark, lang, source in (("own_", "use_lang", F.col("use_source")), ("lang_", "use_lang", every), ("all_", None, every)):
        met = met.join(*level(mark, every if lang is None else F.col(lang), source))

    def margin(name: str, low: bool = False) -> Column:
        def reach(mark: str) -> Column:
            near, far = ("lo", "mid") if low else ("mid", "hi")
            return F.col(f"{mark}{name}_{far}") - F.col(f"{mark}{name}_{near}")

        spread = F.greatest(reach("own_"), reach("lang_"))
        spread = F.when(spread == 0, reach("all_")).otherwise(spread)
        size, event = EVENT[name]
        return F.greatest(spread, F.expr(f"{1000 * event} div greatest(own_{size}_mid, 1)")) * SPREAD

    out = [(F.col(f"own_{name}_hi") + margin(name)).alias(f"hi_{name}") for name in EVENT]
    return met.select("lang_key", "source_key", *out, (F.col("own_word_length_lo") - margin("word_length", low=True)).alias("lo_word_length"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per document: doc_id, its counts, base_failed and kept."""
    key = {"lang_key": lang, "source_key": source}
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *(F.coalesce(F.concat(F.lit("="), F.col(v)), F.lit("?")).alias(k) for k, v in key.items()))
    counted = base_counts(rows).withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))
    counted = materialize(counted, "counts")
    limits = materialize(fences(sketch(counted)), "fences")
    met = counted.join(limits, ["lang_key", "source_key"], "left")
    rates = _rates()
    good = (rates["word_length"] >= F.col("lo_word_length"))
    for name in EVENT:
        good = good & (rates[name] <= F.col(f"hi_{name}"))
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(good, F.lit(False))).alias("kept"),
    )


def report(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


_RATES_SQL = "unnest([" + ", ".join(
    f"{{'rate': '{k}', 'x': {v}}}" for k, v in {
        "symbols": "n_symbols * 1000 // greatest(n_words, 1)", "dup_lines": "n_dup_lines * 1000 // greatest(n_lines, 1)",
        "stutter": "n_stutter * 1000 // greatest(n_words, 1)", "repeat": "n_repeat_words * 1000 // greatest(n_words, 1)",
        "n_words": "n_words", "n_lines": "n_lines", "word_length": "word_chars * 1000 // greatest(n_words, 1)",
    }.items()) + "])"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p:p + {REPEAT - 1}], ' ')) AS c
      FROM d, unnest(range(1, len(w) - {REPEAT - 2})) t(p) WHERE len(w) >= {REPEAT}),
rep AS (SELECT r, count(DISTINCT q) AS k FROM g, unnest(range(p, p + {REPEAT})) t(q) WHERE c > 1 GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM d, unnest(string_split(text, chr(10))) t(line)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT r, doc_id, coalesce('=' || lang, '?') AS l, coalesce('=' || source, '?') AS s, CAST(len(w) AS BIGINT) AS n_words,
             CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(k, 0) AS n_repeat_words,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
      FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
b AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
v AS (SELECT r, l, s, u.rate, u.x FROM (SELECT *, {_RATES_SQL} AS u FROM b WHERE NOT base_failed)),
k AS (SELECT l, s, rate, (x >> greatest(length(bin(x)) - 7, 0)) << greatest(length(bin(x)) - 7, 0) AS x FROM v),
own AS (SELECT l, s, count(*) AS n FROM b WHERE NOT base_failed GROUP BY l, s),
pick AS (SELECT l, s, CASE WHEN sum(n) OVER (PARTITION BY l) >= {LEAST} THEN l ELSE '*' END AS ul,
                CASE WHEN n >= {LEAST} THEN s ELSE '*' END AS us FROM own),
lev AS (SELECT l, s, rate, x FROM k UNION ALL SELECT l, '*', rate, x FROM k UNION ALL SELECT '*', '*', rate, x FROM k),
q AS MATERIALIZED (SELECT l, s, rate, quantile_disc(x, 0.125) AS lo, quantile_disc(x, 0.5) AS mid, quantile_disc(x, 0.875) AS hi FROM lev GROUP BY l, s, rate),
f AS (SELECT p.l, p.s, o.rate, o.hi + {SPREAD} * greatest(CASE WHEN greatest(o.hi - o.mid, g.hi - g.mid) = 0 THEN a.hi - a.mid
               ELSE greatest(o.hi - o.mid, g.hi - g.mid) END, coalesce(e.event * 1000 // greatest(z.mid, 1), 0)) AS hi,
             CASE WHEN o.rate = 'word_length' THEN o.lo - {SPREAD} * CASE WHEN greatest(o.mid - o.lo, g.mid - g.lo) = 0 THEN a.mid - a.lo
               ELSE greatest(o.mid - o.lo, g.mid - g.lo) END ELSE -1 END AS lo
      FROM pick p JOIN q o ON o.l = p.ul AND o.s = p.us JOIN q g ON g.l = p.ul AND g.s = '*' AND g.rate = o.rate
      JOIN q a ON a.l = '*' AND a.s = '*' AND a.rate = o.rate
      JOIN (VALUES {", ".join(f"('{k}', '{of}', {n})" for k, (of, n) in EVENT.items())}) e(rate, size, event) ON e.rate = o.rate
      JOIN q z ON z.l = p.ul AND z.s = p.us AND z.rate = e.size),
ok AS (SELECT v.r, bool_and(v.x BETWEEN f.lo AND f.hi) AS good FROM v JOIN f ON f.l = v.l AND f.s = v.s AND f.rate = v.rate GROUP BY v.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(good, false) AS kept
FROM b LEFT JOIN ok USING (r)"""
