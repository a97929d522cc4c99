"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams, trained with
follow-the-regularised-leader and elastic-net penalties, then temperature calibration.

Characters are letters, each lower-cased by itself; all else is a blank, blanks in a row are one. N-grams of one to three
characters (not blanks alone) are hashed to ``FEATURES`` features; a text's vector is (1 + ln tf) * idf, of length one.
Document frequencies count all rows to learn from. The regression is fitted, with per-coordinate FTRL-proximal steps, on a
bounded sample: of each language at most ``sample_rows`` / number of languages documents of lowest hash of their ids,
however often rows repeat; of the ``max_languages`` languages with most ids (the weights of more would not fit the driver:
rarer ones are not learned). Of each language, every fifth document of the sample is held back to fit the temperature by
which all scores are divided; languages with fewer than five documents are learned from whole, and if no language has five,
the temperature is 1.

Scale: two narrow passes over the texts: frequencies (each task sends at most one number for each feature) and
predictions. The sample, the frequencies and the weights have sizes that don't depend on the corpus. A text's n-grams are
counted in sections, so a long text takes some 30 bytes for each of its characters.

Defined cases: a text that is null or has no letter is ``und`` with score 0; with nothing to learn from, all are; ties go
to the language first in order of code points; rows with a null doc_id are not learned from, but predicted; repeated rows
are predicted alike; an empty table gives no rows; other columns are not read by ``predicted`` and carried by
``identified``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runfield.llm import textops
from runfield.llm.common import bounded_batches, id_and_text, map_batches, passed_through, tidied

FEATURES = 1 << 15
SAMPLE_ROWS = 2_400
MAX_LANGUAGES = 1_000
#: Characters whose n-grams are counted at a time.
SECTION = 1 << 18
#: Rows whose crc32(doc_id as text) mod FOLDS is HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
LEAST_SCORE = 0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            small = c.lower()
            out[i] = ord(small) if len(small) == 1 else i
    return out


def _block_counts(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each row has each feature (rows x FEATURES, flat), and for each row whether it has a letter."""
    n = len(at) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)))
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(before[at]))
    c = _letters()[points]
    kept = np.ones(len(c), bool)
    if len(c):
        kept[1:] = (c[1:] != 0) | (c[:-1] != 0) | (row[1:] != row[:-1])
    c, row = c[kept], row[kept]
    count = None
    # n-grams that end in each section; two characters before it belong to some of them
    for s in range(0, len(c), SECTION):
        lo = max(0, s - 2)
        x, r, new = c[lo : s + SECTION].astype(np.uint64), row[lo : s + SECTION], s - lo
        with np.errstate(over="ignore"):
            there = x[new:] != 0
            rows, hashed = [r[new:][there]], [x[new:][there] * textops.constant(0x9E3779B97F4A7C15)]
            a = max(new, 1)
            same = r[a:] == r[a - 1 : -1]
            rows.append(r[a:][same])
            hashed.append(((x[a - 1 : -1] << np.uint64(21) | x[a:]) * textops.constant(0xC2B2AE3D27D4EB4F))[same])
            a = max(new, 2)
            same = r[a:] == r[a - 2 : -2]
            rows.append(r[a:][same])
            hashed.append(((x[a - 2 : -2] << np.uint64(42) | x[a - 1 : -1] << np.uint64(21) | x[a:]) * textops.constant(0x165667B19E3779F9))[same])
        place = np.concatenate(rows).astype(np.int64) * FEATURES + (np.concatenate(hashed) >> np.uint64(64 - 15)).astype(np.int64)
        more = np.bincount(place, minlength=n * FEATURES)
        count = more if count is None else count + more
    return np.zeros(n * FEATURES, np.int64) if count is None else count, np.bincount(row[c != 0], minlength=n) > 0


def term_counts(texts: pa.Array, most: int = 32) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of at most ``most`` rows: first row, row after the last, then row, feature and count of each pair found, and whether rows have a letter."""
    for i, j, data, at in textops.blocks(texts):
        for a in range(i, j, most):
            b = min(j, a + most)
            lo, hi = at[a - i], at[b - i]
            count, has = _block_counts(data[lo:hi], at[a - i : b - i + 1] - lo)
            there = np.flatnonzero(count)
            yield a, b, there // FEATURES, there % FEATURES, count[there], has


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # FEATURES + 1 (the intercept last) x languages
    temperature: float

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, score
        for a, b, row, feature, count, has in term_counts(texts):
            logits = _logits(row, feature, count, self.idf, self.weights, b - a) / self.temperature
            chance = _softmax(logits)
            best = chance.argmax(axis=1)
            for k in np.flatnonzero(has).tolist():
                names[a + k], score[a + k] = self.languages[best[k]], min(1.0, float(chance[k, best[k]]))
        return names, score


def _vectors(row: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    value = (1 + np.log(count)) * idf[feature]
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    return value / np.where(norm > 0, norm, 1)[row]


def _logits(row, feature, count, idf, weights, n) -> np.ndarray:
    value = _vectors(row, feature, count, idf, n)
    return np.stack([np.bincount(row, value * weights[feature, k], minlength=n) + weights[-1, k] for k in range(weights.shape[1])], axis=1)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FtrlProximal:
    """Per-coordinate FTRL for multinomial logistic loss with L1 and L2 penalties."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        error = _softmax(x @ w)
        error[y] -= 1
        g = x[:, None] * error[None, :]
        more = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(more) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = more


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda t: -np.log(np.maximum(_softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT


def fitted(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and doc_id is not null").where(~held_out())
    # an estimate of the distinct ids that have a text; repeated rows are one
    common = rows.where("text is not null").groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "lang").limit(max_languages).collect()
    languages = sorted(r["lang"] for r in common)
    if not languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in tidied(batches):
            for _, _, _, feature, _, has in term_counts(batch.column(0)):
                df += np.bincount(feature, minlength=FEATURES)
                n += int(has.sum())
        there = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*there.tolist(), -1], pa.int32()), pa.array([*df[there].tolist(), n], pa.int64())], names=["feature", "n"])

    df = np.zeros(FEATURES + 1)
    for r in bounded_batches(rows.select("text")).mapInArrow(frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # FEATURES + 1 rows
        df[r["feature"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    per = max(1, sample_rows // len(languages))
    # Of each language, about four times as many ids as wanted lie under a bound on their hashes; only those are ranked.
    # Where the bound leaves too few, all ids of the language are.
    low, order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    bounds, known = {r["lang"]: min(1 << 30, (1 << 30) * 4 * (per + 25) // r["ids"]) for r in common}, {}
    while bounds:
        bound = F.create_map(*(F.lit(x) for pair in bounds.items() for x in pair))
        ids = rows.where("text is not null").select("doc_id", "lang").where(low <= F.try_element_at(bound, F.col("lang"))).distinct()
        drawn = ids.withColumn("k", F.row_number().over(order)).where(F.col("k") <= per).select("doc_id", "lang").collect()  # at most sample_rows
        known |= {r["doc_id"]: r["lang"] for r in drawn}
        got = Counter(r["lang"] for r in drawn)
        bounds = {lang: 1 << 30 for lang, b in bounds.items() if b < 1 << 30 and got[lang] < per}

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b, row, feature, count, _ in term_counts(batch.column(1)):
            ends = np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(count.astype(np.int32)))], names=["doc_id", "lang", "feature", "count"])

    sampled = map_batches(rows.where(F.col("doc_id").isin(list(known))), work, "doc_id long, lang string, feature array<int>, count array<int>")
    examples = {}
    each = sampled.groupBy("doc_id").agg(F.min(F.struct("lang", "feature", "count")).alias("x")).select("doc_id", "x.*")  # repeated ids count once
    for r in each.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():  # at most sample_rows
        if r["feature"] and r["lang"] in languages:
            examples[r["doc_id"]] = (np.array(r["feature"]), np.array(r["count"]), languages.index(r["lang"]))
    return _trained(list(examples.values()), languages, idf, epochs)


def _trained(examples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray, epochs: int) -> Model:
    seen, back = Counter(), []
    for _, _, y in examples:
        seen[y] += 1
        back.append(seen[y] % 5 == 0)
    learner = FtrlProximal(FEATURES + 1, len(languages))
    prepared = [(np.append(f, FEATURES), np.append(_vectors(np.zeros(len(f), int), f, c, idf, 1), 1.0), y) for f, c, y in examples]
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(prepared)):
            if not back[k]:
                learner.step(*prepared[k])
    weights = learner.weights()
    checked = [(x @ weights[f], y) for (f, x, y), b in zip(prepared, back, strict=True) if b]
    logits = np.array([c[0] for c in checked]).reshape(len(checked), len(languages))
    return Model(languages, idf, weights, _temperature(logits, np.array([c[1] for c in checked], int)))


def predicted(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``, by ``model`` or one fitted to ``docs``."""
    model = model or fitted(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, score = shared.value.predict(batch.column(2))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_batches(rows, work, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, least_score: float = LEAST_SCORE, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is of a learned language with at least ``least_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, **options))

    def keep(ids: pa.Array, texts: pa.Array) -> list[bool]:
        names, score = shared.value.predict(texts)
        return [n != "und" and s >= least_score for n, s in zip(names, score, strict=True)]

    return passed_through(docs, keep)
