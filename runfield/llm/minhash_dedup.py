"""Near-duplicates by ProbMinHash: weighted shingles, banding, and verification.

A shingle is five words in a row (words as in benchmark decontamination, A-Z lower-cased); a text of one to four words is
one shingle. A shingle found c times in a text has weight 1 + SPREAD (1 - 1 / c), less than 1 + SPREAD. Each shingle is the source of a Poisson process whose
rate is its weight and whose arrivals, drawn from the shingle's hash, each fall into one of ``REGISTERS`` registers; a
register keeps the shingle that arrived first. The chance that two texts agree in a register is their probability Jaccard
similarity. Arrivals are drawn in order of time, and a shingle is left as soon as its next arrival is later than all
registers' first ones, so most shingles of a long text are drawn but once or so.

Signatures are cut into ``BANDS`` bands of ``ROWS`` registers. Texts that share a band are candidates; candidates are
verified by the exact Jaccard similarity of their sets of shingles, ``similarity`` or more. With weights from 1 to 1 + SPREAD,
a register's sum over the union of both texts is at most (1 + SPREAD) times its number of shingles, so texts whose sets have
a similarity of 0.8 agree in a register with a chance of 0.8 / 1.05 or more, however often either repeats what: they share
no band with a chance of at most 7e-6.

Steps, each written to the shared folder:

1. One pass over the texts: fingerprint of the words, number of shingles, bands.
2. Texts with equal words are one class from the start; only their least doc_id goes on.
3. Bands held by two or more such texts are buckets. In each bucket, all are verified against its least doc_id (its hub),
   in blocks of ``BLOCK`` that meet the hub one by one, and the links found are joined to components.
4. Where a bucket still has texts of several components, all texts outside its largest component are verified against
   all texts of other components: the former, in blocks of ``BLOCK``, are a query set, and the bucket's texts are dealt
   in blocks to meet them. No link between candidates is lost, and no pairs are emitted.
5. Components again, over all links.

Scale: texts are read twice (the second time only candidates' shingles are kept). Groups of copies are collapsed by
partial aggregation. Where a bucket or a group of copies meets what is known of it as a whole, that is one row of a written
table on the other side of a join, with nothing after it but a write or an exchange, so a skew join splits it however large
it is; sizes of buckets are sums of sizes by component. Sets of shingles travel once for each block. Components come from
contraction of links only, whose number is that of linked texts; its rounds grow with their logarithm, however long a chain
of versions is. A text is hashed in sections, but its distinct shingles are held at once: 8 bytes for each word.

Defined cases: null and wordless texts belong to no group (class_id = doc_id, unless another row of the id has words); rows with a null doc_id are left out, as
no row could name them; repeated rows and ids are one document, whose texts, if they differ, are all its own; an empty
table gives no rows; other columns are not read by ``classes`` and carried by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.llm import textops
from runfield.llm.common import id_and_text, map_batches
from runfield.operators.components import connected
from runfield.sources.shared import written

SHINGLE = 5
SIMILARITY = 0.8
#: How much more a shingle repeated without end weighs than one found once. BANDS are chosen for it: see above.
SPREAD = 0.05
BANDS = 40
ROWS = 5
REGISTERS = BANDS * ROWS
#: Texts of a bucket that meet in one task at a time, on either side.
BLOCK = 256
_STEP = textops.constant(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, ascending, and how often each is found."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(hashes) < SHINGLE:
        with np.errstate(over="ignore"):
            return textops.windows(hashes, len(hashes)) + textops.constant(len(hashes)), np.ones(1, np.int64)
    return np.unique(textops.windows(hashes, SHINGLE), return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    return 1 + SPREAD * (1 - 1 / counts)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (n x m) of n texts with at least one shingle each; row[i] has element[i] with weight[i]."""
    first = np.full(n * m, np.inf)
    holder = np.zeros(n * m, np.uint64)
    limit = np.full(n, np.inf)
    time, drawn = np.zeros(len(row)), np.zeros(len(row), np.uint64)
    draws = 1
    while len(row):
        # texts of few shingles need many arrivals of each: draw more at a time, up to a bounded matrix
        k = int(min(draws, max(1, (1 << 18) // len(row))))
        with np.errstate(over="ignore"):
            number = drawn[:, None] + np.arange(1, k + 1, dtype=np.uint64)[None, :]
            bits = textops.mix(element[:, None] + number * _STEP)
            place = textops.mix(bits ^ textops.constant(0xA0761D6478BD642F))
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))) / weight[:, None]
        when = time[:, None] + (np.cumsum(gap, axis=1) if k > 1 else gap)
        early = when <= limit[row][:, None]
        r, _ = np.nonzero(early)
        at = row[r] * m + ((place[early] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        t = when[early]
        np.minimum.at(first, at, t)
        won = first[at] == t
        holder[at[won]] = element[r[won]]
        limit = first.reshape(n, m).max(axis=1)
        time, drawn = when[:, -1], drawn + np.uint64(k)
        going = time < limit[row]
        row, element, weight, time, drawn = row[going], element[going], weight[going], time[going], drawn[going]
        draws *= 2
    return holder.reshape(n, m)


def bands(signature: np.ndarray) -> np.ndarray:
    """n x BANDS hashes of the registers of each band, the band's number included."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            out = textops.mix(out * textops.constant(0xE7037ED1A0B428DB) + signature[:, k::ROWS][:, :BANDS])
        return textops.mix(out + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _STEP)


def _block_words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, data, at in textops.blocks(texts):
        low, starts, ends, first = textops.lowered_words(data, at)
        yield i, j, textops.span_hashes(low, starts, ends), first


def _fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each text's sequence of words."""
    out, inside = [], np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    with np.errstate(over="ignore"):
        for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(textops.mix(hashes + textops.mix(inside + textops.constant(salt))), dtype=np.uint64)))
            out.append(textops.mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64) * _STEP))
    return out[0], out[1]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp1, fp2 (of the words in order; null without words), bands (array of BANDS hashes)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, hashes, first in _block_words(batch.column(1)):
            one, two = _fingerprints(hashes, first)
            found = [shingles(hashes[first[k] : first[k + 1]]) for k in range(j - i)]
            there = [k for k in range(j - i) if len(found[k][0])]
            out = np.zeros((j - i, BANDS), np.uint64)
            if there:
                sizes = [len(found[k][0]) for k in there]
                weight = weights(np.concatenate([found[k][1] for k in there]))
                out[there] = bands(signatures(np.repeat(np.arange(len(there)), sizes), np.concatenate([found[k][0] for k in there]), weight, len(there)))
            none = np.diff(first) == 0
            keys = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * BANDS), pa.array(out.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(one.view(np.int64), mask=none), pa.array(two.view(np.int64), mask=none), keys], names=["doc_id", "fp1", "fp2", "bands"])

    return map_batches(id_and_text(docs, id_col, text_col).where("doc_id is not null"), work, "doc_id long, fp1 long, fp2 long, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, shingles (binary, ascending 64-bit hashes) of the documents whose doc_id is among ``ids`` (distinct)."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, hashes, first in _block_words(batch.column(1)):
            sets = [shingles(hashes[first[k] : first[k + 1]])[0].tobytes() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return map_batches(id_and_text(docs).join(ids, "doc_id", "left_semi"), work, "doc_id long, shingles binary")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending arrays of distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def components(links: DataFrame) -> DataFrame:
    """doc_id, class_id for every doc_id in ``links`` (a, b): the least doc_id that it is joined to."""
    return connected(links).select(F.col("v").alias("doc_id"), F.col("root").alias("class_id"))


def _met(bucket_rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between texts of different components in a bucket; ``bucket_rows``: key, doc_id, comp, query, n_query, n_target.

    Texts are dealt at random to blocks of about BLOCK; each pair of a query block and a target block meets in one task.
    """
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    deal = F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 30))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), blocks(n) - 1))
    queries = bucket_rows.where("query").select("key", "doc_id", "comp", F.lit(True).alias("query"), (deal % blocks("n_query")).alias("q"), every("n_target").alias("t"))
    targets = bucket_rows.select("key", "doc_id", "comp", F.lit(False).alias("query"), every("n_query").alias("q"), (deal % blocks("n_target")).alias("t"))
    dealt = queries.unionAll(targets).join(sets, "doc_id").select("key", "q", "t", "doc_id", "comp", "query", "shingles")

    def work(rows: pa.Table) -> pa.Table:
        asked, ids, comps = (rows[c].to_numpy() for c in ("query", "doc_id", "comp"))
        held = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["shingles"]]  # views of the rows' own bytes
        sizes, target = np.array([len(x) for x in held]), ~asked
        a, b = [], []
        for i in np.flatnonzero(asked).tolist():
            own = held[i]
            near = target & (comps != comps[i]) & (np.minimum(sizes, len(own)) >= least * np.maximum(sizes, len(own)))
            found = [k for k in np.flatnonzero(near).tolist() if similarity(own, held[k]) >= least]
            a += [int(ids[i])] * len(found)
            b += ids[found].tolist()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.groupBy("key", "q", "t").applyInArrow(work, "a long, b long")


def in_buckets(keyed: DataFrame) -> DataFrame:
    """key, doc_id, hub (the least doc_id of the key), n (its rows): rows of ``keyed`` (key, doc_id) whose key has several.

    Buckets are written, so that both sides of the join are exchanges and a skew join splits a hot key.
    """
    buckets = written(keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1"), "buckets")
    return keyed.join(buckets, "key")


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the least doc_id of its group): a row for each distinct doc_id."""
    source = id_and_text(docs, id_col, text_col)
    sketch = written(sketches(source), "sketches")
    worded = sketch.where("fp1 is not null")
    # One row for each distinct text, under the least doc_id that has it.
    texts = written(worded.groupBy("fp1", "fp2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("rep")), "distinct-texts")
    keyed = written(texts.select(F.col("rep").alias("doc_id"), F.explode("bands").alias("key")).distinct(), "band-keys")
    shared = written(in_buckets(keyed), "shared-buckets")
    sets = written(shingle_sets(source, shared.select("doc_id").distinct()).dropDuplicates(["doc_id", "shingles"]), "shingle-sets")
    # First round: a hub is the one query of all texts that share a bucket of its.
    members = written(shared.where("doc_id <> hub").select(F.col("hub").alias("key"), "doc_id").distinct(), "members")
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n_target")), "hub-sizes")
    asking = sizes.select("key", F.col("key").alias("doc_id"), F.lit(True).alias("query"), "n_target").unionByName(members.join(sizes, "key").select("key", "doc_id", F.lit(False).alias("query"), "n_target"))
    links = written(_met(asking.select("key", "doc_id", F.col("doc_id").alias("comp"), "query", F.lit(1).cast("long").alias("n_query"), "n_target"), sets, similarity), "links")
    # What the first round leaves: texts outside the largest component of their bucket, other than the hub.
    comps = components(links)
    open_rows = written(shared.where("n > 2").join(comps, "doc_id", "left").select("key", "hub", "doc_id", F.coalesce("class_id", "doc_id").alias("comp")), "open-rows")
    parts = open_rows.groupBy("key", "comp").agg(F.count("*").alias("k"), F.max(F.col("doc_id") == F.col("hub")).alias("has_hub"))
    left = parts.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.count("*").alias("comps"), F.sum("k").alias("n_target"), F.max(F.when(F.col("has_hub"), F.col("comp"))).alias("of_hub")).where("comps > 1")
    left = written(left.select("key", F.col("top.comp").alias("top"), "n_target", (F.col("n_target") - F.col("top.k") - (F.col("of_hub") != F.col("top.comp")).cast("long")).alias("n_query")).where("n_query > 0"), "open-buckets")
    rows = open_rows.join(left, "key").withColumn("query", (F.col("comp") != F.col("top")) & (F.col("doc_id") != F.col("hub")))
    more = written(_met(rows, sets, similarity).distinct(), "more-links")
    # Copies are named by their text's representative after components are found, so they are no edges. Rows of one
    # doc_id with different texts are one document: they join the representatives of those texts.
    named = written(worded.join(texts.select("fp1", "fp2", "rep"), ["fp1", "fp2"]).select("doc_id", "rep"), "copies")
    several = named.groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most")).where("least <> most")
    across = named.join(several, "doc_id").select(F.col("least").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    found = components(links.unionAll(more).unionAll(across))
    of_texts = named.join(found.select(F.col("doc_id").alias("rep"), "class_id"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("class_id", "rep")).alias("class_id"))
    rest = sketch.where("fp1 is null").select("doc_id").distinct().join(of_texts, "doc_id", "left_anti")
    return of_texts.unionAll(rest.select("doc_id", F.col("doc_id").alias("class_id")))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all columns, without those of later doc_ids of a group; of repeated rows one stays.

    Rows with a null doc_id stay.
    """
    later = written(classes(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("_later")), "later")
    left = docs.join(later, docs["doc_id"].cast("long") == later["_later"], "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return left
    return left.where("doc_id is null").unionAll(left.where("doc_id is not null").dropDuplicates(["doc_id"]))
