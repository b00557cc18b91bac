"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the mean of hashed embeddings of the word and its first bytes; filters one, two and
three words wide slide over the whole text, their largest answers feed one logistic unit. It is fitted on
a bounded sample of labelled rows (``TRAIN_ROWS`` of each label), of which a fifth only calibrates: the score
is moved so that 0.7 is the best cut by F1, and each language with enough rows gets its own threshold. Texts of
up to ``WHOLE_CHARS`` characters are sent whole to the driver. Longer ones are read whole where they lie by the model trained so far, and
the words around the largest answer of each filter, which are all that max pooling sees of them, train it
further; a fifth of them calibrates by their whole texts. A sample of any size trains once for each of five folds, so that
each row calibrates once by a model that has not seen it, and then on all rows. Scoring reads every whole text; the filters are multiplied into the embedding
table once, so a text costs one table row for each word.

Labels come only from rows whose crc32 of the id is not 1 modulo 3; language, source and id never enter a
score. Defined cases: a null or empty text scores as no words; without labels of both kinds every score
is the share of toxic labels (0 without labels); a null id is not held out; repeated label rows count
once by the largest value; other columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.decontaminate import words

TRAIN_ROWS, WHOLE_CHARS = 4000, 20_000
#: words on either side of a filter's largest answer that are sent of a longer text
AROUND = 4
CUT = 0.7
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 17, 12, 6, (1, 2, 3)
HEADS = (4, 5, 6, 7)
EPOCHS, BATCH, RATE = 4, 64, 0.05
#: words whose answers a worker keeps
CACHE = 100_000


def hashed(ws: list[bytes]) -> np.ndarray:
    """Buckets of each word: itself and its first bytes."""
    out = [[zlib.crc32(w, 97) & (BUCKETS - 1), *(zlib.crc32(w[:k], k) & (BUCKETS - 1) for k in HEADS)] for w in ws]
    return np.array(out, dtype=np.int32).reshape(-1, len(HEADS) + 1)


@dataclass
class Model:
    table: np.ndarray  # buckets x dims
    filters: list[np.ndarray]  # for each width: filters x width x dims
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    cuts: dict[str, float] = field(default_factory=dict)
    ready: np.ndarray | None = None

    def packed(self) -> Model:
        """What scoring needs: the answers instead of the table."""
        return replace(self, table=self.table[:0], ready=self.answers())

    def answers(self) -> np.ndarray:
        """Every filter column of every bucket: buckets x (sum of widths x filters)."""
        if self.ready is not None:
            return self.ready
        return np.concatenate([self.table @ f[:, j, :].T for f in self.filters for j in range(f.shape[1])], axis=1).astype(np.float32)

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -30, 30)))


def _pad(texts: list[np.ndarray], none: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts with two empty words after each, and where each text starts."""
    gap = np.full(max(WIDTHS) - 1, none, dtype=np.int64)
    parts, starts, at = [], [], 0
    for t in texts:
        t = t if len(t) else gap[:1]
        starts.append(at)
        parts += [t, gap]
        at += len(t) + len(gap)
    return np.concatenate(parts), np.array(starts)


def _new_model(rng: np.random.Generator) -> Model:
    table = rng.normal(0, 0.1, (BUCKETS, DIMS))
    filters = [rng.normal(0, 0.1, (FILTERS, w, DIMS)) for w in WIDTHS]
    for f in filters:
        f[0, :, 0] = 1.0 / f.shape[1]  # the first filter follows the first dimension
    return Model(table, filters, np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.1, FILTERS * len(WIDTHS)))


def _pooled(model: Model, emb: np.ndarray, at: np.ndarray, starts: np.ndarray):
    """Largest answers (texts x filters) and the places where they are."""
    ends = np.append(starts[1:], len(at)) - (max(WIDTHS) - 1)
    best, place = [], []
    for f in model.filters:
        width = f.shape[1]
        conv = sum((emb @ f[:, j, :].T)[at[j : len(at) - (max(WIDTHS) - 1) + j]] for j in range(width))
        where = np.stack([s + conv[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
        place.append(where)
        best.append(conv[where, np.arange(f.shape[0])])
    return np.concatenate(best, axis=1) + model.bias, place


def _logits(model: Model, texts: list[np.ndarray], feats: np.ndarray) -> np.ndarray:
    out = []
    for a in range(0, len(texts), BATCH):
        ids, starts = _pad(texts[a : a + BATCH], len(feats))
        some, at = np.unique(ids, return_inverse=True)
        emb = _embed(model, some, feats)
        best, _ = _pooled(model, emb, at, starts)
        out.append(np.maximum(best, 0) @ model.weights + model.offset)
    return np.concatenate(out) if out else np.empty(0)


def _embed(model: Model, some: np.ndarray, feats: np.ndarray) -> np.ndarray:
    emb = np.zeros((len(some), DIMS))
    real = some < len(feats)
    emb[real] = model.table[feats[some[real]]].mean(axis=1)
    return emb


def fit(
    texts: list[str], labels: list[int], langs: list[str | None], seed: int = 5,
    more: Callable[[Model], list[tuple[float, int, str | None]]] | None = None,
    long: Callable[[Model], list[tuple[list[list[bytes]], int]]] | None = None,
) -> Model:
    """Train on all rows; each fifth calibrates by a model trained on the others.

    ``long`` gives further rows (pieces of a text as words, label) for the training, ``more`` further rows (logit, label,
    language) for the calibration.
    """
    y = np.array(labels, dtype=np.float64)
    if len(y) < 10 or min(np.sum(y == 1), np.sum(y == 0)) < 2:
        model = _new_model(np.random.default_rng(seed))
        model.constant = float(y.mean()) if len(y) else 0.0
        return model
    number: dict[bytes, int] = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in words(t)], dtype=np.int64) for t in texts]
    feats = hashed(list(number))
    order = np.random.default_rng(seed).permutation(len(y))
    order = order[np.argsort(y[order], kind="stable")]  # both labels in each fold
    folds = [order[k::5] for k in range(5)]
    every = np.arange(len(y))
    z = np.zeros(len(y))
    for fold in folds:
        model = _train(coded, feats, y, np.setdiff1d(every, fold), seed)
        z[fold] = _logits(model, [coded[k] for k in fold], feats)
    model = _train(coded, feats, y, every, seed)
    far = long(model) if long is not None else []
    if far:
        pieces = [[[number.setdefault(w, len(number)) for w in piece] for piece in row] for row, _ in far]
        feats = hashed(list(number))
        gap = [len(feats)] * (max(WIDTHS) - 1)  # no filter reaches from one piece into the next
        coded += [np.array([x for piece in row for x in (*piece, *gap)], dtype=np.int64) for row in pieces]
        model = _train(coded, feats, np.append(y, [float(label) for _, label in far]), np.arange(len(coded)), seed, model)
    rows = more(model) if more is not None else []
    z = np.append(z, [r[0] for r in rows])
    _calibrate(model, z, np.append(y, [r[1] for r in rows]), [*langs, *(r[2] for r in rows)])
    return model


def _start(model: Model, coded: list[np.ndarray], feats: np.ndarray, y: np.ndarray, used: np.ndarray, n: np.ndarray) -> None:
    """First dimension: smoothed log ratio of the shares of toxic and other texts with the bucket."""
    seen = np.zeros((2, BUCKETS))
    for k in used:
        seen[int(y[k]), np.unique(feats[np.unique(coded[k])])] += 1
    share = (seen + 2 * n[:, None] / n.sum()) / n[:, None]  # a bucket never seen has equal shares
    model.table[:, 0] = np.log(share[1]) - np.log(share[0])
    model.weights[[k * FILTERS for k in range(len(WIDTHS))]] = 1.0


def _step(model: Model, coded: list, feats: np.ndarray, y: np.ndarray, weight: np.ndarray, rows: np.ndarray, params: list, square: list) -> None:
    ids, starts = _pad([coded[k] for k in rows], len(feats))
    some, at = np.unique(ids, return_inverse=True)
    emb = _embed(model, some, feats)
    best, place = _pooled(model, emb, at, starts)
    pooled = np.maximum(best, 0)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.offset, -30, 30)))
    dz = (p - y[rows]) * weight[rows] / len(rows)
    dp = dz[:, None] * model.weights * (best > 0)
    emb_grad = np.zeros_like(emb)
    grads = []
    for k, f in enumerate(model.filters):
        own = dp[:, k * FILTERS : (k + 1) * FILTERS]
        g = np.zeros_like(f)
        for j in range(f.shape[1]):
            at_word = at[place[k] + j]
            g[:, j, :] = np.einsum("bf,bfd->fd", own, emb[at_word])
            np.add.at(emb_grad, at_word, own[:, :, None] * f[None, :, j, :])
        grads.append(g)
    touched = np.flatnonzero(np.abs(emb_grad).sum(axis=1) > 0)
    touched = touched[some[touched] < len(feats)]
    buckets = feats[some[touched]]
    table_grad = np.repeat(emb_grad[touched] / buckets.shape[1], buckets.shape[1], axis=0)
    flat, where = np.unique(buckets.ravel(), return_inverse=True)
    summed = np.zeros((len(flat), DIMS))
    np.add.at(summed, where, table_grad)
    square[0][flat] += summed**2
    model.table[flat] -= RATE * summed / np.sqrt(square[0][flat])
    for p_, g, s in zip(params[1:], [*grads, dp.sum(axis=0), pooled.T @ dz, dz.sum(keepdims=True)], square[1:]):
        s += g**2
        p_ -= RATE * g / np.sqrt(s)


def _train(coded: list[np.ndarray], feats: np.ndarray, y: np.ndarray, used: np.ndarray, seed: int, model: Model | None = None) -> Model:
    """A new model of ``EPOCHS`` rounds, or ``model`` after one round more."""
    rng = np.random.default_rng(seed)
    epochs, model = (EPOCHS, _new_model(rng)) if model is None else (1, model)
    used = rng.permutation(used)
    n = np.array([np.sum(y[used] == 0), np.sum(y[used] == 1)])
    if epochs > 1:
        _start(model, coded, feats, y, used, n)
    weight = np.where(y == 1, len(used) / (2 * n[1]), len(used) / (2 * n[0]))
    params = [model.table, *model.filters, model.bias, model.weights, model.offset]
    square = [np.full(p.shape, 1e-2 if epochs > 1 else 1.0) for p in params]
    for _ in range(epochs):
        for a in range(0, len(used), BATCH):
            _step(model, coded, feats, y, weight, used[a : a + BATCH], params, square)
    return model


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the widest of the best gaps."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    hits = np.cumsum(y[::-1])[::-1]  # toxic rows at or above each place
    score = 2 * hits / (np.arange(len(z), 0, -1) + y.sum())
    low = np.concatenate([[z[0] - 2], z[:-1]])
    gap = np.where(score >= score.max() - 1e-12, z - low, -1)
    k = int(gap.argmax())
    return float((z[k] + low[k]) / 2)


def _calibrate(model: Model, z: np.ndarray, y: np.ndarray, langs: list[str | None]) -> None:
    cut = best_cut(z, y)
    apart = z[y == 1].mean() - z[y == 0].mean()
    model.scale = float(np.clip(8 / max(apart, 1e-6), 0.05, 20))
    model.shift = float(np.log(CUT / (1 - CUT)) - model.scale * cut)
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        if min(np.sum(y[own] == 1), np.sum(y[own] == 0)) >= 20:
            model.cuts[lang] = float(model.score(np.array([best_cut(z[own], y[own])]))[0])


def sampled_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most ``TRAIN_ROWS`` labelled rows of each label."""
    usable = labels.where("doc_id is not null and toxic is not null").where(~is_held_out(F.col("doc_id")))
    one = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [one.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS) for k in (0, 1)]
    return F.broadcast(parts[0].unionByName(parts[1]))  # at most twice TRAIN_ROWS rows


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, lang, text) of the bounded sample; ``docs`` has doc_id, text, lang."""
    short = docs.where(F.length("text") <= WHOLE_CHARS)
    return short.join(sampled_ids(labels), "doc_id").groupBy("doc_id", "toxic").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))


def long_texts(docs: DataFrame, labels: DataFrame, calibrating: bool) -> DataFrame:
    """The sample's longer texts: a fifth of them by id for the calibration, or the others."""
    fifth = F.crc32(F.concat(F.lit("long"), F.col("doc_id").cast("string"))) % 5 == 0
    return docs.where(F.length("text") > WHOLE_CHARS).where(fifth if calibrating else ~fifth).join(sampled_ids(labels), "doc_id")


def long_rows(docs: DataFrame, labels: DataFrame, model: Model) -> list[tuple[float, int, str | None]]:
    """(logit, label, language) of the calibrating longer texts, scored where they lie."""
    far = long_texts(docs, labels, True)
    scored = far.withColumn("z", _scorer(docs.sparkSession.sparkContext.broadcast(model.packed()), plain=True)(F.col("text")))
    rows = scored.groupBy("doc_id", "toxic").agg(F.min("lang").alias("lang"), F.max("z").alias("z")).collect()
    return [(r.z, int(r.toxic), r.lang) for r in sorted(rows, key=lambda r: str(r.doc_id))]


def long_pieces(docs: DataFrame, labels: DataFrame, model: Model) -> list[tuple[list[list[bytes]], int]]:
    """(pieces around the largest answers, label) of the training longer texts, found where they lie."""
    far = long_texts(docs, labels, False).groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = far.select("doc_id", "toxic", _peaker(docs.sparkSession.sparkContext.broadcast(model.packed()))("text").alias("pieces")).collect()
    rows = sorted(rows, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id)))
    return [([words(p) for p in r.pieces], int(r.toxic)) for r in rows]


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    rows = sorted(training_rows(docs, labels).collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    more = lambda model: long_rows(docs, labels, model)
    long = lambda model: long_pieces(docs, labels, model)
    return fit([r.text for r in rows], [int(r.toxic) for r in rows], [r.lang for r in rows], more=more, long=long)


class Scorer:
    """Scores texts in a worker; keeps the answers of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.answers = model.answers()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.rows = np.zeros((1 << 14, self.answers.shape[1]), dtype=np.float32)  # row 0: no word

    def _learn(self, ws: set[bytes]) -> None:
        new = list(ws)
        first = len(self.number) + 1
        while first + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for a in range(0, len(new), 8192):
            part = hashed(new[a : a + 8192])
            self.rows[first + a : first + a + len(part)] = sum(self.answers[part[:, k]] for k in range(part.shape[1])) / part.shape[1]
        self.number.update(zip(new, range(first, first + len(new))))

    def pooled(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Largest answer of each filter without its bias, and the word where it begins."""
        best = np.full(FILTERS * len(WIDTHS), -np.inf, dtype=np.float32)
        place = np.zeros(len(best), dtype=np.int64)
        for a in range(0, max(1, len(ws)), 1 << 15):  # a long text in parts that overlap by two words
            part = ws[a : a + (1 << 15) + max(WIDTHS) - 1]
            unknown = set(part).difference(self.number)
            if unknown:
                if len(self.number) + len(unknown) > CACHE:
                    self._clear()
                    unknown = set(part)
                self._learn(unknown)
            ids = np.zeros(max(1, len(part)) + max(WIDTHS) - 1, dtype=np.int64)
            ids[: len(part)] = np.fromiter(map(self.number.__getitem__, part), dtype=np.int64, count=len(part))
            rows = self.rows[ids]
            n, column = max(1, min(len(part), 1 << 15)), 0
            for k, width in enumerate(WIDTHS):
                conv = rows[:n, column : column + FILTERS]
                for j in range(1, width):
                    conv = conv + rows[j : n + j, column + j * FILTERS : column + (j + 1) * FILTERS]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                at = conv.argmax(axis=0)
                top = conv[at, np.arange(FILTERS)]
                place[own] = np.where(top > best[own], a + at, place[own])
                best[own] = np.maximum(best[own], top)
                column += width * FILTERS
        return best, place

    def logit(self, text: str | None) -> float:
        best, _ = self.pooled(words(text))
        return float(np.maximum(best + self.model.bias, 0) @ self.model.weights + self.model.offset[0])

    def pieces(self, text: str | None) -> list[bytes]:
        """Words around the largest answers, pieces that touch as one."""
        ws = words(text)
        out: list[list[int]] = []
        for at in sorted(set(self.pooled(ws)[1].tolist())):
            lo, hi = max(0, at - AROUND), min(len(ws), at + max(WIDTHS) + AROUND)
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return [b" ".join(ws[lo:hi]) for lo, hi in out]


def _peaker(model):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def peaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for texts in batches:
            yield pd.Series([[p.decode(errors="replace") for p in scorer.pieces(t)] for t in texts], dtype=object)

    return peaks


def _scorer(model, plain: bool = False):
    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for texts in batches:
            logits = np.array([scorer.logit(t) for t in texts], dtype=np.float64)
            yield pd.Series(logits if plain else scorer.model.score(logits))

    return score


def score_documents(
    docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", score: str = "score", rejected: str = "rejected"
) -> DataFrame:
    """``docs`` with ``score``, and ``rejected`` by the threshold of the row's language; columns so named are replaced."""
    if model.constant is not None:
        scored = docs.withColumn(score, F.lit(model.constant))
    else:
        scored = docs.withColumn(score, _scorer(docs.sparkSession.sparkContext.broadcast(model.packed()))(F.col(text)))
    cut = F.lit(CUT)
    for name, value in sorted(model.cuts.items()):
        cut = F.when(F.col(lang) == name, F.lit(value)).otherwise(cut)
    return scored.withColumn(rejected, F.col(score) >= cut)


def report(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), "rejected",
    )
