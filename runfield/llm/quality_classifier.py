"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Tokens are runs of word characters and runs of other printing characters, case kept. Single tokens and pairs are hashed
to ``buckets``; each occurrence of three tokens in a row also counts as new or as seen before in its document (all as new
unless more than ``REPEATS`` of a document's are seen before: a line said twice is no fault). Two multinomial models are counted: of all documents (raw, with ``alpha`` added to each count) and of documents labelled good
(target, with ``prior`` n-grams added that are spread as the raw ones are, so that a rare n-gram says little). The log weight of a document is the sum of log(target / raw) over its n-grams. Each document gets its log weight
plus Gumbel noise drawn from its doc_id and ``seed``, and the k largest are kept: a sample without replacement in which
chances are in proportion to the weights. By default k is the number of documents of weight 1 or more, that is, as likely
under the target's model as under the raw one.

Scale: two narrow passes over the texts, one to count and one to weigh. Of counts, each task sends one number for each
bucket at most; the models (two numbers a bucket) are all that reaches the driver and is broadcast. The target model is
fitted on a bounded sample: at most ``target_rows`` labelled documents, those of lowest hash. The raw model counts every
document. The k-th largest key is found by counting keys in ever finer intervals of a narrow table, never by sorting all.

Defined cases: null, empty and blank texts have no n-grams and weight 1, so they are kept unless k cuts them off; a null
doc_id draws its noise as id 0 would; rows that tie with the k-th key are all kept; without target rows or documents every
weight is 1; a very long text is a block of its own, whose n-grams are held at once, some 50 bytes for each token; other columns are carried by ``kept_documents`` and not read by ``scored``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.llm import textops
from runfield.llm.common import bounded_batches, id_and_text, map_batches, passed_through, tidied
from runfield.sources.shared import written

BUCKETS = 10_000
ALPHA = 0.5
PRIOR = 1_000_000
TARGET_ROWS = 20_000
SEED = 7
REPEATS = 0.4
#: 0: white space, 1: words, 2: the rest.
_KIND = np.where(textops.SPACE, 0, np.where(textops.WORD, 1, 2)).astype(np.uint8)


def features(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram in a block; buckets ``buckets`` and ``buckets`` + 1 are for triples new and seen."""
    starts, ends = textops.spans(_KIND[data], at)
    hashes = textops.span_hashes(data, starts, ends)
    first = textops.word_rows(starts, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    two, three = textops.windows(hashes, 2), textops.windows(hashes, 3)
    in_two, in_three = row[: len(two)] == row[1:] if len(two) else np.zeros(0, bool), row[: len(three)] == row[2:] if len(three) else np.zeros(0, bool)
    row3 = row[: len(three)][in_three]
    with np.errstate(over="ignore"):
        keyed = textops.mix(three[in_three] + (row3.astype(np.uint64) + np.uint64(1)) * textops.constant(0xD6E8FEB86659FD93))
    new = np.zeros(len(row3), bool)
    new[np.unique(keyed, return_index=True)[1]] = True
    triples, seen = np.bincount(row3, minlength=len(at) - 1), np.bincount(row3[~new], minlength=len(at) - 1)
    new |= (seen <= REPEATS * triples)[row3]
    size = np.uint64(buckets)
    rows = np.concatenate((row, row[: len(two)][in_two], row3))
    return rows, np.concatenate(((hashes % size).astype(np.int64), (two[in_two] % size).astype(np.int64), np.where(new, buckets, buckets + 1)))


def target_ids(labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Ids of the documents labelled good, at most ``target_rows`` of lowest hash."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return np.sort(np.array([r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).collect()], np.int64))


def fitted(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, prior: float = PRIOR, target_rows: int = TARGET_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log(target / raw) for each bucket."""
    ids = docs.sparkSession.sparkContext.broadcast(target_ids(labels, target_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets + 2, np.int64), np.zeros(buckets + 2, np.int64)
        for batch in tidied(batches):
            known = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            good = np.isin(known, ids.value) & np.asarray(batch.column(0).is_valid())
            for i, j, data, at in textops.blocks(batch.column(1)):
                row, bucket = features(data, at, buckets)
                raw += np.bincount(bucket, minlength=buckets + 2)
                target += np.bincount(bucket[good[i:j][row]], minlength=buckets + 2)
        there = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(raw[there]), pa.array(target[there])], names=["bucket", "raw", "target"])

    counted = bounded_batches(id_and_text(docs, id_col, text_col)).mapInArrow(work, "bucket long, raw long, target long")
    raw, target = np.full(buckets + 2, alpha), np.zeros(buckets + 2)
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # buckets + 2 rows
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    if not target.any():
        return np.zeros(buckets + 2)
    out = np.zeros(buckets + 2)
    for part in (slice(0, buckets), slice(buckets, None)):  # two models: of n-grams, and of triples new or seen
        of_raw = raw[part] / raw[part].sum()
        out[part] = np.log((target[part] + prior * of_raw) / (target[part].sum() + prior) / of_raw)
    return out


def _gumbel(ids: pa.Array, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        drawn = textops.mix(ids.fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64) * textops.constant(0x9E3779B97F4A7C15) + textops.constant(seed * 0xC2B2AE3D27D4EB4F + 1))
    return -np.log(-np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)))


def _weigher(weights, seed: int) -> Callable[[pa.Array, pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function of ids and texts that gives the numbers of n-grams, log weights and keys."""

    def run(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        table, n, total = weights.value, np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, j, data, at in textops.blocks(texts):
            row, bucket = features(data, at, len(table) - 2)
            n[i:j] = np.bincount(row, minlength=j - i)
            total[i:j] = np.bincount(row, table[bucket], minlength=j - i)
        return n, total, total + _gumbel(ids, seed)

    return run


def scored(docs: DataFrame, labels: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_features, log_weight, gumbel_key for every row of ``docs``."""
    weights = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, id_col=id_col, text_col=text_col, **options))
    return _scored(docs, weights, seed, id_col, text_col)


def _scored(docs: DataFrame, weights, seed: int, id_col: str, text_col: str) -> DataFrame:
    weigh = _weigher(weights, seed)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, total, key = weigh(batch.column(0), batch.column(1))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), pa.array(key)], names=["doc_id", "n_features", "log_weight", "gumbel_key"])

    return map_batches(id_and_text(docs, id_col, text_col), work, "doc_id long, n_features long, log_weight double, gumbel_key double")


def kth_largest(values: DataFrame, column: str, k: int, few: int = 5_000, cells: int = 2_048) -> float:
    """The k-th largest value of a double column, by counts in ever finer intervals; -inf if k is at least the number of rows, inf for k = 0."""
    if k <= 0:
        return float("inf")
    lo, hi, n = values.agg(F.min(column), F.max(column), F.count(column)).first()
    if k >= n:
        return float("-inf")
    above = 0  # rows greater than hi
    while n > few and lo < hi:
        width = (hi - lo) / cells
        cell = F.least(F.floor((F.col(column) - lo) / width), F.lit(cells - 1))
        inside = values.where(F.col(column).between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        for r in sorted(inside.collect(), key=lambda r: -r["cell"]):  # one row for each cell
            if above + r["n"] >= k:
                break
            above += r["n"]
        if (r["lo"], r["hi"]) == (lo, hi):
            break  # only equal values, or two neighbours that no width can part
        lo, hi, n = r["lo"], r["hi"], r["n"]
    if lo == hi:
        return lo
    counts = values.where(F.col(column).between(lo, hi)).groupBy(column).count().orderBy(F.desc(column)).limit(few)
    for r in counts.collect():
        above += r["count"]
        if above >= k:
            return r[column]
    raise AssertionError("the k-th value lies within the last interval")


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, **options) -> DataFrame:
    """``scored`` with kept: whether the row is among the k largest keys."""
    found = written(scored(docs, labels, **options), "weights")
    least = kth_largest(found, "gumbel_key", found.where("log_weight >= 0").count() if k is None else k)
    return found.withColumn("kept", F.col("gumbel_key") >= F.lit(least))


def kept_documents(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``resampled`` keeps: weighed once for the threshold, once to filter."""
    weights = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, **options))
    found = written(_scored(docs, weights, seed, "doc_id", "text"), "weights")
    least = kth_largest(found, "gumbel_key", found.where("log_weight >= 0").count() if k is None else k)
    weigh = _weigher(weights, seed)
    return passed_through(docs, lambda ids, texts: weigh(ids.cast(pa.int64()), texts)[2] >= least)
