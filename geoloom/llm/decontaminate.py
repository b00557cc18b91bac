"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words form one automaton; a document streams through it and the length of the longest
match ending at each word says which words lie inside an item window. Items are dealt into blocks
of bounded size by a hash of their id, so that an automaton always fits a worker; a document goes
through the blocks one after the other without a shuffle and its spans add up.

Defined cases: a null text has no words; an item without words has no window; repeated items count
once by id; items with a null id hit words and count as one item, whose name is null and last in the list and
left out of its digest; equal windows in several items name all of them; an empty item table hits nothing; other
columns of the documents pass through, and one named like the result column is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.plans.scratch import materialize

WINDOW = 13
#: characters of item text in one automaton; bounds what is sent to each worker
BLOCK_CHARS = 4_000_000
#: blocks that one pass over the documents holds at once
BLOCKS_PER_PASS = 4

FOUND = (
    T.StructType()
    .add("n_words", T.LongType())
    .add("starts", T.ArrayType(T.IntegerType()))
    .add("ends", T.ArrayType(T.IntegerType()))
    .add("items", T.ArrayType(T.StringType()))
)

# words are runs of ASCII letters and digits (folded to lower case) and of anything beyond ASCII
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton over word numbers of all items, with what each state says about windows."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ids = [name for name, _ in items]
        coded = []
        for _, ws in items:
            codes = [self.number.setdefault(w, len(self.number) + 1) for w in ws]
            state = 0
            for c in codes:
                state = self._extend(state, c)
            coded.append(codes)
        self.shortest = min((min(window, len(x)) for x in coded if x), default=0)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        cur = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        new = self._state(dict(self.next[q]), self.len[p] + 1, self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.next.append(moves)
        self.len.append(length)
        self.link.append(link)
        return len(self.len) - 1

    def _mark(self, coded: list[list[int]]) -> None:
        """at_window: the state's suffix of window length; owners of such states; whole short items by state."""
        n, link, length, window = len(self.len), self.link, self.len, self.window
        order = sorted(range(1, n), key=length.__getitem__)
        self.at_window = [-1] * n
        for s in order:
            if length[s] >= window:
                self.at_window[s] = s if length[link[s]] < window else self.at_window[link[s]]
        self.owners: dict[int, set[int]] = {}
        short: dict[int, list[tuple[int, int]]] = {}
        for k, codes in enumerate(coded):
            state = 0  # walked again: later items may have split the states
            for c in codes:
                state = self.next[state][c]
                if (at := self.at_window[state]) >= 0:
                    self.owners.setdefault(at, set()).add(k)
            if 0 < len(codes) < window:
                short.setdefault(state, []).append((len(codes), k))
        self.short = short
        self.short_up = [-1] * n  # nearest state on the suffix path, itself included, that is a whole short item
        for s in order:
            self.short_up[s] = s if s in short else self.short_up[link[s]]

    def match(self, codes: list[int], offset: int, hits: list[tuple[int, int]], found: set[int]) -> None:
        """Stream word numbers; add windows found as (start, end) and their items."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        state = size = 0
        for j, c in enumerate(codes, offset + 1):
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                size = 0
                continue
            state = to
            size += 1
            if size >= window:
                hits.append((j - window, j))
                found |= self.owners[self.at_window[state]]
            up = self.short_up[state]
            while up >= 0:
                for n, k in self.short[up]:
                    if n <= size:
                        hits.append((j - n, j))
                        found.add(k)
                up = self.short_up[link[up]] if link[up] >= 0 else -1


def build(items: list[tuple[str, str | None]], window: int = WINDOW) -> Automaton:
    return Automaton([(name, words(text)) for name, text in items], window)


_built: dict[str, Automaton] = {}  # automatons of this worker process, by the name of their block


def _finder(items, window: int):
    name = uuid.uuid4().hex

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _built:
            _built.clear()
            _built[name] = build(items.value, window)
        auto = _built[name]
        get, least = auto.number.get, max(1, auto.shortest)
        for texts in batches:
            rows = []
            for text in texts:
                ws = words(text)
                codes = np.fromiter(map(get, ws, repeat(0)), dtype=np.int32, count=len(ws))
                edges = np.flatnonzero(np.diff(codes > 0, prepend=False, append=False))
                hits: list[tuple[int, int]] = []
                found: set[int] = set()
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if b - a >= least:
                        auto.match(codes[a:b].tolist(), a, hits, found)
                starts, ends = merge(hits)
                rows.append((len(ws), starts, ends, _sorted({auto.ids[k] for k in found})))
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])

    return find


def _sorted(names: set[str | None]) -> list[str | None]:
    return sorted(names, key=lambda x: (x is None, x or ""))


def merge(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Union of half-open spans as sorted starts and ends."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


@F.pandas_udf(FOUND)
def _united(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for n, s1, e1, i1, s2, e2, i2 in zip(
        one["n_words"], one["starts"], one["ends"], one["items"], two["starts"], two["ends"], two["items"]
    ):
        starts, ends = merge([*zip(s1, e1), *zip(s2, e2)])
        rows.append((n, starts, ends, _sorted({*i1, *i2})))
    return pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])


def find_spans(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    into: str = "contamination", window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with a struct ``into``: word count, spans of hit words (half open) and ids of the items hit."""
    spark = docs.sparkSession
    named = items.select(F.col(item_id).cast("string").alias("name"), F.col(item_text).alias("body")).where("body is not null")
    total = named.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    named = named.withColumn("block", F.pmod(F.xxhash64(F.coalesce("name", "body")), F.lit(blocks)))
    out = docs
    for b in range(blocks):
        held = [tuple(r) for r in named.where(F.col("block") == b).select("name", "body").collect()]  # about block_chars
        found = _finder(spark.sparkContext.broadcast(held), window)(F.col(text))
        if b == 0:
            out = out.withColumn(into, found)
            continue
        out = out.withColumn("_more_spans", found).withColumn(into, _united(into, "_more_spans")).drop("_more_spans")
        if b % BLOCKS_PER_PASS == 0:
            out = materialize(out, "decontaminate")
    return out


def hit_words(into: str = "contamination") -> Column:
    pairs = F.zip_with(f"{into}.starts", f"{into}.ends", lambda a, b: (b - a).cast("long"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x)


def is_contaminated(into: str = "contamination", percent: int = 5) -> Column:
    """Some word is hit, and hit words are at least ``percent`` of all."""
    hit = hit_words(into)
    return (hit > 0) & (hit * 100 >= F.col(into)["n_words"] * percent)


def _cut(least: int):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series, found: pd.DataFrame) -> pd.Series:
        out = []
        for text, starts, ends in zip(texts, found["starts"], found["ends"]):
            spans = [(a, b) for a, b in zip(starts, ends) if b - a >= least]
            if text and spans:
                at = [m.span() for m in word.finditer(text)]
                kept, last = [], 0
                for a, b in spans:
                    kept.append(text[last : at[a][0]])
                    last = at[b - 1][1]
                text = "".join([*kept, text[last:]])
            out.append(text)
        return pd.Series(out, dtype=object)

    return cut


def remove_spans(docs: DataFrame, text: str = "text", into: str = "contamination", least: int = WINDOW) -> DataFrame:
    """Cut every span of at least ``least`` hit words out of ``text``; needs the struct of ``find_spans``."""
    return docs.withColumn(text, _cut(least)(F.col(text), F.col(into)))


def digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def report(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    return found.select(
        "doc_id",
        "contamination.n_words",
        hit_words().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        digest(F.col("contamination.items")).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS g
       FROM i, unnest(range(1, len(w) - least(len(w), 13) + 2)) t(p) WHERE len(w) > 0),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM iw) k, unnest(range(1, len(w) - n + 2)) t(p)),
hit AS MATERIALIZED (SELECT DISTINCT dw.r, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)),
word AS (SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) t(q) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)"""
