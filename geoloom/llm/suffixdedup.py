"""Removal of long byte strings that occur more than once, by two-stage suffix sorting.

A string of ``window`` bytes is charged to the least hashed k-gram inside it, its anchor, which depends
on the string alone: equal strings have equal anchors at equal offsets. A document becomes stretches of
window starts with one anchor each. Anchors seen once cannot repeat and go; stretches that are equal byte
for byte are counted as one class, so copies cost one row. Where an anchor has several classes their
bytes meet in one task: the suffixes smaller than their successors are sorted directly, the others are
induced from them by scanning the buckets of first bytes, and neighbours with a common prefix of a whole
window are repeats. The classes of an anchor with more than ``GROUP`` of them are cut into shorter
stretches, which meet by the hash of the core that all windows of a stretch share, equal ones counted
once; where even these are more than ``GROUP``, windows are counted one by one through a shuffle. The
answer is the same whichever way an anchor goes.

Texts may be read as symbols of several bytes: passages of ``words`` words are found in texts of one 8-byte
symbol a word, where windows start at symbols only.

Texts are named by two 64-bit hashes; equal texts share all work. Defined cases: a null text is empty; a
text shorter than the window keeps all; equal rows and repeated ids are judged row by row (each copy of a
long text is removed whole); an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.names import free_names
from geoloom.plans.scratch import discard, materialize

WINDOW, GRAM = 400, 64
#: words of a repeated passage, words of its grams, and bytes that stand for a word
PASSAGE, PASSAGE_GRAM, SYMBOL = 51, 8, 8
#: bytes hashed at once, and bytes of stretches sorted at once
PIECE, SORTED_AT_ONCE = 1 << 19, 1 << 18
#: word codes that a task keeps
CODES = 1 << 19
#: stretches that share an anchor, or a core, sorted in one task
GROUP = 512

_TABLE = np.random.default_rng(20240).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}

CLASS = ["kh", "sh", "rel", "run"]
STRETCH = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("p", T.IntegerType()),
    T.StructField("run", T.IntegerType()), T.StructField("rel", T.IntegerType()), T.StructField("kh", T.LongType()),
    T.StructField("sh", T.LongType()),
])
FOUND = T.StructType([
    T.StructField("kh", T.LongType()), T.StructField("sh", T.LongType()), T.StructField("rel", T.IntegerType()),
    T.StructField("run", T.IntegerType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()),
])


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x)
    return _powers["up"][:n], _powers["down"][:n]


def symbol_values(data: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte, or each 8-byte symbol."""
    if data.dtype == np.uint8:
        return _TABLE[data]
    h = data * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h * _BASE


def gram_hashes(values: np.ndarray, gram: int) -> np.ndarray:
    """Mixed 64-bit hash of the ``gram`` symbols from each place."""
    up, down = _power(len(values))
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(values) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the least hash (the first of equal ones) among the next ``width``."""
    n = len(h) - width + 1
    keys = np.full(-(-len(h) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    keys[: len(h)] = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    rows = keys.reshape(-1, width)
    ahead = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    behind = np.minimum.accumulate(rows, axis=1).reshape(-1)
    return (np.minimum(ahead[:n], behind[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def stretches(data: bytes | memoryview, starts: np.ndarray, ends: np.ndarray, window: int, gram: int, symbol: int = 1):
    """(document number, first start, starts, anchor offset, anchor hash, stretch hash) of texts lying in ``data``.

    All places and lengths are counted in symbols of 1 or 8 bytes.
    """
    raw = np.frombuffer(data, dtype=np.uint8 if symbol == 1 else np.uint64)
    first = 0
    while first < len(starts):
        # whole documents up to a piece; one longer than that is cut, its pieces sharing window - 1 bytes
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        for at in range(a, max(a + 1, b - window + 1), PIECE):
            to = min(b, at + PIECE + window - 1)
            if to - at < window:
                continue
            h = gram_hashes(symbol_values(raw[at:to]), gram)
            place = least_places(h, window - gram + 1)
            inside = np.zeros(len(place) + 1, dtype=np.int8)
            lows = np.clip(starts[first:last] - at, 0, None)
            highs = np.minimum(ends[first:last] - at, to - at) - window + 1
            good = (highs > lows) & (lows < len(place))
            inside[lows[good]] += 1
            inside[highs[good]] -= 1
            valid = np.cumsum(inside[:-1]).astype(bool)
            new = valid.copy()
            new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
            begin = np.flatnonzero(new)
            if not len(begin):
                continue
            over = valid.copy()
            over[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
            end = np.flatnonzero(over)
            anchor = place[begin]
            doc = np.searchsorted(starts[first:last], begin + at, "right") - 1 + first
            view = memoryview(data)
            cut = [xxhash.xxh3_64_intdigest(view[x:y]) for x, y in zip(((begin + at) * symbol).tolist(), ((end + at + window) * symbol).tolist())]
            yield doc, begin + at - starts[doc], end - begin + 1, anchor - begin, h[anchor], np.array(cut, dtype=np.uint64)
        first = last


def _stretcher(window: int, gram: int, symbol: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(2).cast(pa.large_string())
            offsets = np.frombuffer(body.buffers()[1], dtype=np.int64)[body.offset : body.offset + len(body) + 1]
            if not len(body) or offsets[-1] - offsets[0] < window * symbol:
                continue
            data = memoryview(body.buffers()[2])[offsets[0] : offsets[-1]]
            offsets = (offsets - offsets[0]) // symbol
            k1, k2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for doc, p, run, rel, kh, sh in stretches(data, offsets[:-1], offsets[1:], window, gram, symbol):
                columns = [k1[doc], k2[doc], p.astype(np.int32), run.astype(np.int32), rel.astype(np.int32)]
                columns += [kh.view(np.int64), sh.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=STRETCH.names)

    return cut


def suffix_order(text: np.ndarray, limits: np.ndarray, wanted: np.ndarray, window: int) -> np.ndarray:
    """Places with ``wanted``, in suffix order as far as ``window`` bytes, by two-stage sorting.

    ``text``: stretches one after the other as bytes, with ``window`` spare bytes at the end; ``limits``:
    the places where each stretch ends. Only suffixes smaller than their successors are compared.
    """
    n = int(limits[-1])
    codes = np.empty(n + 1, dtype=np.int16)
    codes[:n] = text[:n]
    after = np.empty(n, dtype=np.int16)
    after[:-1] = codes[1:n]
    after[limits - 1] = -1  # the end of a stretch comes before every byte
    step = np.sign(after - codes[:n])
    # equal bytes take the answer of the next unequal pair
    nearest = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    small = step[nearest] > 0
    # needed: wanted places and, after each, the falling bytes up to the first small suffix or the end
    number = np.cumsum(np.bincount(limits, minlength=n + 1)[:n])
    stop = np.where(small, np.arange(n), n)
    stop = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], limits[number] - 1)
    spread = np.zeros(n + 1, dtype=np.int32)
    at = np.flatnonzero(wanted)
    np.add.at(spread, at, 1)
    np.add.at(spread, stop[at] + 1, -1)
    needed = np.cumsum(spread[:n]) > 0
    strings = np.ndarray((n,), dtype=f"S{window}", buffer=text, strides=(1,))
    direct = np.flatnonzero(needed & small)
    direct = direct[np.argsort(strings[direct], kind="stable")]
    cuts = np.searchsorted(codes[direct], np.arange(257)) if len(direct) else np.zeros(257, dtype=np.int64)
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[needed[before] & ~small[before] & (number[before] == number[np.minimum(before + 1, n - 1)])]
        send(before)

    def send(places: np.ndarray) -> None:
        if not len(places):
            return
        c = codes[places]
        order = np.argsort(c, kind="stable")
        places, c = places[order], c[order]
        edges = np.flatnonzero(np.diff(c)) + 1
        for part in np.split(places, edges):
            waiting[codes[part[0]]].append(part)

    ends = limits - 1
    send(ends[needed[ends] & ~small[ends]])  # the empty suffixes come first
    out = []
    for c in range(256):
        while waiting[c]:
            found = waiting[c].pop(0)
            out.append(found)
            induce(found)
        found = direct[cuts[c] : cuts[c + 1]]
        if len(found):
            out.append(found)
            induce(found)
    order = np.concatenate(out) if out else np.empty(0, dtype=np.int64)
    return order[wanted[order]]


def repeated_starts(parts: list[bytes], runs: list[int], window: int, symbol: int = 1) -> list[np.ndarray]:
    """For each stretch a mask of its first ``run`` symbols: whether the window there occurs elsewhere among them."""
    window *= symbol
    text = np.frombuffer(b"".join(parts) + bytes(window), dtype=np.uint8)
    limits = np.cumsum([len(x) for x in parts])
    begins = limits - [len(x) for x in parts]
    wanted = np.zeros(int(limits[-1]), dtype=bool)
    for b, r in zip(begins.tolist(), runs):
        wanted[b : b + r * symbol : symbol] = True
    order = suffix_order(text, limits, wanted, window)
    strings = np.ndarray((int(limits[-1]),), dtype=f"S{window}", buffer=text, strides=(1,))
    hit = np.zeros(int(limits[-1]), dtype=bool)
    for a in range(0, max(0, len(order) - 1), 1 << 16):  # common prefixes of neighbours, some at a time
        near = strings[order[a : a + (1 << 16) + 1]]
        same = near[1:] == near[:-1]
        hit[order[a : a + len(same)][same]] = True
        hit[order[a + 1 : a + 1 + len(same)][same]] = True
    return [hit[b : b + r * symbol : symbol] for b, r in zip(begins.tolist(), runs)]


def _sorter(window: int, symbol: int):
    """Columns: group, the class, base, n, single, part; a part is sorted with the others of its group."""

    def rows(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        masks = repeated_starts([x[8] for x in held], [x[6] for x in held], window, symbol)
        out = []
        for (_, kh, sh, rel, run, base, _, single, _), mask in zip(held, masks):
            if single and mask.any():
                edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)) + base
                out += [(kh, sh, rel, run, a, b - 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        if out:
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame(out, columns=FOUND.names).astype({c: "int32" for c in ("rel", "run", "lo", "hi")}), preserve_index=False
            )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and held[-1][:6] == row[:6]:
                    continue  # the same stretch from a repeated document row
                if size >= SORTED_AT_ONCE and held[-1][0] != row[0]:
                    yield from rows(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[8])
        if held:
            yield from rows(held)

    return work


PART = ["group", *CLASS, "base", "n", "single", "part"]


def _sorted_spans(parts: DataFrame, window: int, symbol: int) -> DataFrame:
    met = parts.select(*PART).repartition("group").sortWithinPartitions("group", *CLASS, "base")
    return met.mapInArrow(_sorter(window, symbol), FOUND)


def _crowded_spans(parts: DataFrame, window: int, symbol: int) -> DataFrame:
    """Spans of anchors with very many classes: shorter stretches grouped by the core that all their windows hold."""
    step = max(1, window // 12)
    core = window - step + 1
    # the anchor lies between block * step and block * step + step - 1 bytes into the windows of a block
    last = F.col("rel") - F.col("block") * step
    blocks = F.sequence(F.expr(f"greatest(rel - run + 1, 0) div {step}").cast("int"), F.expr(f"rel div {step}").cast("int"))
    cut = parts.dropDuplicates(CLASS).select(*CLASS, "single", "part", F.explode(blocks).alias("block"))
    cut = cut.withColumns({"base": F.greatest(last - (step - 1), F.lit(0)), "upto": F.least(last, F.col("run") - 1)})
    cut = cut.filter("base <= upto").withColumn("n", F.col("upto") - F.col("base") + 1)
    held = F.xxhash64("kh", "block", F.substring("part", last * symbol + 1, F.lit(core * symbol)))
    cut = cut.select(held.alias("group"), *CLASS, "base", "n", "single", F.substring("part", F.col("base") * symbol + 1, (F.col("n") + (window - 1)) * symbol).alias("part"))
    cut = materialize(cut.withColumn("ph", F.xxhash64("part")), "cut")
    same = ["group", "ph", "n"]
    counted = cut.groupBy(*same).agg(
        F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("times"), F.min(F.struct(*CLASS, "base")).alias("at")
    )
    counted = materialize(counted, "counted")
    wide = materialize(counted.groupBy("group").agg(F.count("*").alias("v"), F.min("times").alias("least")), "wide")
    met = cut.join(counted, same).withColumn("first", F.struct(*CLASS, "base") == F.col("at"))
    twice = met.where("times >= 2 and single").select(*CLASS, F.col("base").alias("lo"), (F.col("base") + F.col("n") - 1).alias("hi"))
    ones = met.where("first").withColumn("single", F.col("times") == 1).join(wide.where("v >= 2 and least = 1"), "group")
    ones = materialize(ones.select(*PART, "v"), "ones")
    spans = twice.unionByName(_sorted_spans(ones.where(F.col("v") <= GROUP), window, symbol))
    return spans.unionByName(_count_windows(ones.where(F.col("v") > GROUP), window, symbol))


def _name(docs: DataFrame, text: str) -> DataFrame:
    """Adds the two hashes that name a text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("k1", F.xxhash64(body)).withColumn("k2", F.xxhash64(F.lit(1), body))


def find_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, symbol: int = 1):
    """Written tables (texts, marks): marks has (k1, k2, spans of repeated window starts); texts the bodies of all texts in it.

    Windows, grams and spans are counted in symbols.
    """
    key = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("row_id")
    named = _name(docs.select(key, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")), "body")
    long = named.where(F.octet_length("body") >= window * symbol)
    cut = materialize(long.select("k1", "k2", "body").mapInArrow(_stretcher(window, gram, symbol), STRETCH), "stretches")
    shared = materialize(cut.groupBy("kh").count().where("count >= 2").select("kh"), "shared")
    # counted by their whole name first: a join on an anchor that very many texts hold is one that Spark can split
    met = materialize(cut.groupBy(*CLASS, "k1", "k2", "p").agg(F.count("*").alias("c")).join(shared, "kh"), "met")
    discard(cut)
    discard(shared)
    classes = materialize(met.groupBy(*CLASS).agg(F.sum("c").alias("n"), F.min(F.struct("k1", "k2", "p")).alias("at")), "classes")
    width = materialize(classes.groupBy("kh").agg(F.count("*").alias("v"), F.min("n").alias("least")), "width")
    judged = classes.join(width, "kh")
    # one row of each text that shares an anchor, with the stretches wanted from it
    rows = named.select("k1", "k2", "row_id").groupBy("k1", "k2").agg(F.min("row_id").alias("row_id"))
    wants = judged.where("v >= 2 and least = 1").groupBy("at.k1", "at.k2").agg(
        F.collect_list(F.struct(*CLASS, "n", "v", F.col("at.p").alias("p"))).alias("wants")
    )
    touched = met.select("k1", "k2").distinct().join(wants, ["k1", "k2"], "left").join(rows, ["k1", "k2"])
    touched = materialize(touched, "touched")
    texts = materialize(named.join(touched, ["k1", "k2", "row_id"]).select("k1", "k2", "body", "wants"), "texts")
    discard(touched)
    body = F.encode("body", "utf-8")
    part = F.transform("wants", lambda x: F.struct(
        x["kh"].alias("kh"), x["sh"].alias("sh"), x["rel"].alias("rel"), x["run"].alias("run"), (x["n"] == 1).alias("single"),
        F.substring(F.col("bytes"), x["p"] * symbol + 1, (x["run"] + (window - 1)) * symbol).alias("part"), x["v"].alias("v")))
    parts = texts.where("wants is not null").select(body.alias("bytes"), "wants").select(F.explode(part).alias("x")).select("x.*")
    plain = parts.where(F.col("v") <= GROUP).select(
        F.col("kh").alias("group"), *CLASS, F.lit(0).alias("base"), F.col("run").alias("n"), "single", "part"
    )
    whole = judged.where("n >= 2").select(*CLASS, F.lit(0).alias("lo"), (F.col("run") - 1).alias("hi"))
    spans = materialize(whole.unionByName(_sorted_spans(plain, window, symbol)), "spans")
    if not judged.where((F.col("v") > GROUP) & (F.col("least") == 1)).isEmpty():
        spans = materialize(spans.unionByName(_crowded_spans(parts.where(F.col("v") > GROUP), window, symbol)), "spans")
    marks = (
        met.select(*CLASS, "k1", "k2", "p").join(spans, CLASS)
        .groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("p") + F.col("lo")).alias("lo"), (F.col("p") + F.col("hi")).alias("hi"))).alias("spans"))
    )
    marks = materialize(marks, "marks")
    for table in (met, classes, width, spans):
        discard(table)
    return texts, marks


def _count_windows(parts: DataFrame, window: int, symbol: int) -> DataFrame:
    """Repeated windows of groups of very many stretches, each window counted through a shuffle."""
    one = parts.select("group", *CLASS, "base", "single", "part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
    string = F.substring(F.col("part"), F.col("o") * symbol + 1, F.lit(window * symbol))
    lo = F.col("base") + F.col("o")
    one = materialize(one.select("group", *CLASS, "single", lo.alias("lo"), F.xxhash64(string).alias("w1"), F.xxhash64(F.lit(1), string).alias("w2")), "windows")
    key = ["group", "w1", "w2"]
    twice = materialize(one.groupBy(*key).agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n")).where("n >= 2").select(*key), "twice")
    return one.where("single").join(twice, key).select(*CLASS, "lo", F.col("lo").alias("hi"))


def removed_runs(spans, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows whose starts lie in ``spans`` of (lo, hi), both included."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] + window) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept_bytes(text: str | None, runs: list[tuple[int, int]]) -> bytes:
    data, at, out = (text or "").encode(), 0, []
    for a, b in runs:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


_MEASURE = T.StructType().add("n_removed", T.LongType()).add("n_spans", T.LongType()).add("kept_sha256", T.StringType())


def _measurer(window: int):
    @F.pandas_udf(_MEASURE)
    def measure(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, found in zip(texts, spans):
            runs = removed_runs(found, window)
            rows.append((sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept_bytes(text, runs)).hexdigest()))
        return pd.DataFrame(rows, columns=_MEASURE.names)

    return measure


def measure_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, words: int | None = None
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, of repeated strings of ``window`` bytes.

    With ``words`` also n_passage_words and n_passage_spans: words inside passages of so many words that occur
    more than once, and the maximal runs of them.
    """
    texts, marks = find_repeats(docs, doc_id, text, window, gram)
    measured = texts.join(marks, ["k1", "k2"]).select("k1", "k2", _measurer(window)("body", "spans").alias("m"))
    measured = materialize(measured.dropDuplicates(["k1", "k2"]), "measured")
    discard(texts)
    discard(marks)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.octet_length(body).cast("long").alias("n_bytes")
    small = _name(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("body"), size), "body")
    small = small.select("doc_id", "k1", "k2", "n_bytes", F.sha2("body", 256).alias("whole"))
    none = F.lit(0).cast("long")
    out = small.join(measured, ["k1", "k2"], "left").select(
        "k1", "k2", "doc_id", "n_bytes", F.coalesce("m.n_removed", none).alias("n_removed"), F.coalesce("m.n_spans", none).alias("n_spans"),
        F.coalesce("m.kept_sha256", "whole").alias("kept_sha256"),
    )
    if words is not None:
        found = find_passages(docs, words, doc_id, text).select("k1", "k2", _passage_measurer(words)("spans").alias("p"))
        out = out.join(materialize(found, "passages"), ["k1", "k2"], "left")
        out = out.withColumns({"n_passage_words": F.coalesce("p.w", none), "n_passage_spans": F.coalesce("p.r", none)}).drop("p")
    return out.drop("k1", "k2")


def _passage_measurer(words: int):
    @F.pandas_udf(T.StructType().add("w", T.LongType()).add("r", T.LongType()))
    def measure(spans: pd.Series) -> pd.DataFrame:
        runs = [removed_runs(found, words) for found in spans]
        return pd.DataFrame([(sum(b - a for a, b in r), len(r)) for r in runs], columns=["w", "r"])

    return measure


def _cleaner(window: int):
    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [t if s is None else kept_bytes(t, removed_runs(s, window)).decode(errors="ignore") for t, s in zip(texts, spans)], dtype=object
        )

    return clean


def _cut(docs: DataFrame, marks: DataFrame, text: str, cleaner) -> DataFrame:
    """``docs`` with ``text`` cut by the spans of its name (k1, k2) in ``marks``."""
    n1, n2, m1, m2, spans = free_names("n1 n2 m1 m2 spans", docs)
    marks = marks.select(F.col("k1").alias(m1), F.col("k2").alias(m2), F.col("spans").alias(spans))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = docs.withColumns({n1: F.xxhash64(body), n2: F.xxhash64(F.lit(1), body)})
    met = named.join(marks, (F.col(n1) == F.col(m1)) & (F.col(n2) == F.col(m2)), "left")
    cut = cleaner(F.col(f"`{text}`"), F.col(spans)).alias(text)
    return met.select(*(cut if c == text else F.col(f"`{c}`") for c in docs.columns))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; part of a character left at a cut goes too."""
    texts, marks = find_repeats(docs, doc_id, text, window, gram)
    discard(texts)
    return _cut(docs, marks, text, _cleaner(window))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Codes(dict):
    """Word -> ``SYMBOL`` characters that stand for 48 bits of its hash."""

    def __missing__(self, word: bytes) -> str:
        code = self[word] = base64.b64encode(xxhash.xxh3_64_digest(word)[:6]).decode()
        return code


@F.pandas_udf(T.StringType())
def _coded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The words of each text as symbols."""
    codes = _Codes()
    for texts in batches:
        out = []
        for text in texts:
            out.append("".join(map(codes.__getitem__, text.encode().split())))  # at the same white space as _WORD
            if len(codes) > CODES:
                codes.clear()
        yield pd.Series(out, dtype=object)


def find_passages(docs: DataFrame, words: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, spans) of the texts, by name, that hold passages of ``words`` words that occur more than once, whatever
    white space parts them; spans are of words where such a passage begins."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    named = _name(docs.select(F.col(f"`{doc_id}`").alias("row_id"), body.alias("body")), "body")
    symbols = materialize(named.select("row_id", F.col("k1").alias("t1"), F.col("k2").alias("t2"), _coded("body").alias("code")), "coded")
    bodies, marks = find_repeats(symbols, "row_id", "code", words, min(PASSAGE_GRAM, words), SYMBOL)
    discard(bodies)
    texts = _name(symbols.select("t1", "t2", "code"), "code").drop("code").distinct()
    found = texts.join(marks, ["k1", "k2"]).select(F.col("t1").alias("k1"), F.col("t2").alias("k2"), "spans")
    found = materialize(found, "passages")
    discard(symbols)
    discard(marks)
    return found


def word_runs(text: str, spans, words: int) -> list[tuple[int, int]]:
    """Byte runs covered by windows of ``words`` words; ``spans`` of words where windows start."""
    at = [m.span() for m in _WORD.finditer(text.encode())]
    return [(at[s["lo"]][0], at[s["hi"] + words - 1][1]) for s in spans]


def _passage_cleaner(words: int):
    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans):
            runs = word_runs(text, found, words) if found is not None else []
            runs = removed_runs([{"lo": a, "hi": b} for a, b in runs], 0)
            out.append(kept_bytes(text, runs).decode() if runs else text)
        return pd.Series(out, dtype=object)

    return clean


def remove_passages(docs: DataFrame, words: int = PASSAGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without passages of ``words`` words that occur more than once, however few their bytes and whatever
    white space parts their words."""
    return _cut(docs, find_passages(docs, words, doc_id, text), text, _passage_cleaner(words))


def report(spark, sf_dir: str) -> DataFrame:
    """The 400-byte contract, and beside it the words inside repeated passages of over 50 words."""
    return measure_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), words=PASSAGE)
