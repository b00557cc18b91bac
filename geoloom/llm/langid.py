"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy.

A text's words (runs of letters, lower case) are cut into subwords: the word in brackets and its 2- to 4-grams.
Each subword hashes to a row of an embedding table; a word is the mean of its subwords and a text the mean of
its words, over the whole text. Table and softmax are trained together by stochastic gradient descent on a
bounded sample: at most ``SAMPLE_ROWS`` rows over all languages, evenly by language, and of each the ``TRAIN_WORDS`` words
that the text's own hash order puts first, so any part of a text is as likely as another. A fifth of the sample only
calibrates: one temperature makes the score the chance of being right, and the rejection threshold is the
lowest score above which ``PRECISION`` of the calibrating rows are right. Scoring multiplies
the softmax into the table once, so a word costs one row of as many numbers as there are languages.

Learned from text and language of rows whose crc32 of the id is not 0 modulo 5; language, source and id never
enter a prediction. Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; a null id is not held out and does not train; repeated rows train as one by their least language and text; without
training rows every text is ``und``; with one language every text with a letter has it, at score 1; equal scores take the
first language by name; other columns pass through, those named like the results are replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS, TRAIN_WORDS = 4000, 250
BUCKETS, DIMS, GRAMS = 1 << 16, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 3, 32, 0.5
PRECISION = 0.98
UNKNOWN = "und"
#: words whose numbers a worker keeps
CACHE = 200_000
#: characters whose words are listed at once
SEGMENT = 1 << 20

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def subwords(words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the subwords of some words, one kind after the other: (buckets in the order of the words, how many each
    has), first the words themselves in brackets, then the grams of each length."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    whole = np.fromiter((zlib.crc32(w.encode(), 7) for w in words), dtype=np.int64, count=len(words)) & (BUCKETS - 1)
    out = [(whole, np.ones(len(words), dtype=np.int64))]
    ahead = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # characters up to the end of the word
    h = codes
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            here = ahead[: len(h)] >= n
            out.append(((mixed >> np.uint64(64 - BUCKETS.bit_length() + 1))[here].astype(np.int64), np.maximum(size - n + 1, 0)))
    return out


def word_counts(text: str | None) -> Counter:
    """Lower-case words of a whole text."""
    out: Counter = Counter()
    at = 0
    while text and at < len(text):
        end = at + SEGMENT
        while end < len(text) and text[end - 1] > " ":  # a segment ends behind white space
            end += 1
        out.update(_WORD.findall(text[at:end].lower()))
        at = end
    return out


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x dims
    weights: np.ndarray  # dims x languages
    bias: np.ndarray
    sharpness: float = 1.0
    reject_below: float = 0.0

    def answers(self) -> np.ndarray:
        return (self.table @ self.weights).astype(np.float32)

    def shares(self, logits: np.ndarray) -> np.ndarray:
        z = logits * self.sharpness
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)


class Bags:
    """Texts as distinct words with their shares; the buckets of a word are held once."""

    def __init__(self, texts: list[dict[str, int]]):
        known: dict[str, int] = {}
        self.words, self.shares = [], []
        for counts in texts:
            self.words.append(np.array([known.setdefault(w, len(known)) for w in counts], dtype=np.int32))
            n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
            self.shares.append((n / n.sum()).astype(np.float32))
        kinds = subwords(list(known))
        owner = np.concatenate([np.repeat(np.arange(len(known)), n) for _, n in kinds])
        self.size = sum(n for _, n in kinds)
        self.first = np.cumsum(self.size) - self.size
        self.buckets = np.concatenate([b for b, _ in kinds])[np.argsort(owner, kind="stable")].astype(np.int32)

    def batch(self, rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: text and word (among the distinct ones) and share of each entry, then buckets of those words and their sizes."""
        text = np.repeat(np.arange(len(rows)), [len(self.words[k]) for k in rows])
        some, word = np.unique(np.concatenate([self.words[k] for k in rows]), return_inverse=True)
        size, first = self.size[some], self.first[some]
        place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return text, word, np.concatenate([self.shares[k] for k in rows]), self.buckets[place], size


def _means(model: Model, n: int, text, word, share, buckets, size) -> np.ndarray:
    words = np.add.reduceat(model.table[buckets], np.cumsum(size) - size, axis=0) / size[:, None]
    out = np.zeros((n, DIMS))
    np.add.at(out, text, share[:, None] * words[word])
    return out


def _logits(model: Model, bags: Bags, rows) -> np.ndarray:
    parts = [rows[a : a + BATCH] for a in range(0, len(rows), BATCH)]
    return np.concatenate([_means(model, len(part), *bags.batch(part)) @ model.weights + model.bias for part in parts])


def fit(texts: list[dict[str, int]], langs: list[str], seed: int = 11) -> Model:
    """Train on four fifths of the rows (word counts, language); the others calibrate."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    model = Model(names, rng.normal(0, 0.1, (BUCKETS, DIMS)), np.zeros((DIMS, len(names))), np.zeros(len(names)))
    if len(names) < 2:
        return model
    y = np.searchsorted(names, langs)
    bags = Bags(texts)
    order = rng.permutation(len(y))
    order = order[np.argsort(y[order], kind="stable")]  # every language in each part
    held, used = order[::5], np.delete(order, slice(None, None, 5))
    if len(used) == 0:
        used = held
    model.weights = rng.normal(0, 0.1, model.weights.shape)
    steps, total = 0, EPOCHS * -(-len(used) // BATCH)
    for _ in range(EPOCHS):
        used = rng.permutation(used)
        for a in range(0, len(used), BATCH):
            rows = used[a : a + BATCH]
            rate = RATE * (1 - steps / total)
            steps += 1
            text, word, share, buckets, size = bags.batch(rows)
            mean = _means(model, len(rows), text, word, share, buckets, size)
            p = model.shares(mean @ model.weights + model.bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            back = p @ model.weights.T
            model.weights -= rate * mean.T @ p
            model.bias -= rate * p.mean(axis=0)
            of_word = np.zeros((len(size), DIMS))
            np.add.at(of_word, word, share[:, None] * back[text])
            some, where = np.unique(buckets, return_inverse=True)
            grad = np.zeros((len(some), DIMS))
            np.add.at(grad, where, np.repeat(of_word / size[:, None], size, axis=0))
            model.table[some] -= rate * grad * len(names)
    _calibrate(model, _logits(model, bags, held), y[held])
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    """The temperature of the least log loss, then the rejection threshold."""
    loss = {}
    for sharpness in 2.0 ** np.arange(-4, 6.25, 0.25):
        model.sharpness = float(sharpness)
        loss[model.sharpness] = -np.log(model.shares(logits)[np.arange(len(y)), y] + 1e-12).mean()
    model.sharpness = min(loss, key=loss.get)
    shares = model.shares(logits)
    score, right = shares.max(axis=1), shares.argmax(axis=1) == y
    order = np.argsort(-score, kind="stable")
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    if len(good) and good[-1] + 1 < len(y):
        model.reject_below = float((score[order[good[-1]]] + score[order[good[-1] + 1]]) / 2)
    elif not len(good):
        model.reject_below = float(score.max())


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _sampled_words(texts: pd.Series) -> pd.Series:
    """The ``TRAIN_WORDS`` words of each text whose places hash lowest."""
    out = []
    for text in texts:
        ws = _WORD.findall((text or "").lower())
        if len(ws) > TRAIN_WORDS:
            place = np.random.default_rng(zlib.crc32(text.encode())).permutation(len(ws))[:TRAIN_WORDS]
            ws = [ws[i] for i in sorted(place.tolist())]
        out.append(ws)
    return pd.Series(out, dtype=object)


def training_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, words) of the bounded sample; ``docs`` has doc_id, text and lang."""
    usable = docs.where("doc_id is not null and lang is not null").where(~is_held_out(F.col("doc_id")))
    langs = usable.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang")
    n = max(1, langs.select("lang").distinct().count())
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id"))
    some = langs.distinct().withColumn("nth", first).where(F.col("nth") <= max(5, SAMPLE_ROWS // n)).drop("nth")
    met = usable.join(F.broadcast(some), ["doc_id", "lang"])  # SAMPLE_ROWS rows, or five a language
    one = met.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x")).select("doc_id", "x.*")
    return one.select("doc_id", "lang", _sampled_words("text").alias("words"))


def train(docs: DataFrame) -> Model:
    rows = sorted(training_rows(docs).collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id)))
    rows = [r for r in rows if r.words]
    return fit([Counter(r.words) for r in rows], [r.lang for r in rows])


class Scorer:
    """Logits of whole texts; keeps the answers of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.answers = model.answers()
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(model.langs)), dtype=np.float32)

    def _learn(self, new: list[str]) -> None:
        at, end = len(self.known), len(self.known) + len(new)
        while end > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        total, count = np.zeros((len(new), self.rows.shape[1])), np.zeros(len(new))
        for buckets, n in subwords(new):
            upto = np.zeros((len(buckets) + 1, total.shape[1]))
            np.cumsum(self.answers[buckets], axis=0, out=upto[1:], dtype=np.float64)
            last = np.cumsum(n)
            total += upto[last] - upto[last - n]
            count += n
        self.rows[at:end] = total / count[:, None]
        self.known.update(zip(new, range(at, end)))

    def many(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Logits of each text, None without a letter; new words of some texts are learned together."""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and (not held or size <= SEGMENT):
                held.append(word_counts(texts[at]))
                size += len(texts[at] or "")
                at += 1
            new = set().union(*held).difference(self.known)
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
                new = set().union(*held)
            if new:
                self._learn(list(new))
            for counts in held:
                if not counts:
                    yield None
                    continue
                rows = np.fromiter(map(self.known.__getitem__, counts), dtype=np.int64, count=len(counts))
                share = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
                yield (share / share.sum()) @ self.rows[rows] + self.model.bias

    def logits(self, text: str | None) -> np.ndarray | None:
        return next(self.many([text]))


_FOUND = T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType())


def _predictor(model):
    @F.pandas_udf(_FOUND)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.value)
        langs = model.value.langs
        for texts in batches:
            out = []
            for z in scorer.many(list(texts)):
                if z is None or not langs:
                    out.append((UNKNOWN, 0.0))
                else:
                    shares = model.value.shares(z)
                    k = int(shares.argmax())
                    out.append((langs[k], float(min(1.0, shares[k]))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score", rejected: str = "rejected") -> DataFrame:
    """``docs`` with the predicted language, its calibrated score, and whether the score is too low to be trusted."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (pred, score, rejected)]
    free = next(n for n in (f"found_{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    found = docs.withColumn(free, _predictor(docs.sparkSession.sparkContext.broadcast(model))(F.col(f"`{text}`").cast("string")))
    doubt = (F.col(f"{free}.lang_pred") == UNKNOWN) | (F.col(f"{free}.score") < model.reject_below)
    return found.select(*kept, F.col(f"{free}.lang_pred").alias(pred), F.col(f"{free}.score").alias(score), doubt.alias(rejected))


def report(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
