"""Sharding by extendible hashing.

A document goes to the bucket named by the leading bits of its hash. The directory starts with one bucket of no bits; a
bucket over its byte limit, and no other, splits on the next bit, until all fit. So the shard of a document is the shortest
prefix of its hash whose documents together fit the limit.

The directory is grown from sums of bytes by prefix, not by moving documents: one pass gives the sums for prefixes of
``step`` bits, at most 2^step of them for each bucket still too large; sums of shorter prefixes follow from those, and the
shortest that fits is the bucket. Only buckets too large at that depth are refined by a further ``step`` bits. A join gives
each document its bucket.

Scale: texts are read once for their sizes (doc_id, hash and bytes are then a written table); each round aggregates on the
map side before its shuffle and joins on a bounded prefix of the hash, so neither a source nor a key is hot. A document is
larger than the limit, or documents share all bits of the hash (repeated ids): such a bucket can't split. It stays one
shard, marked ``oversize``.

Defined cases: a null text has 0 bytes; a null doc_id hashes as the empty string; repeated rows share a bucket; an empty
table gives no rows; other columns are not read. A bucket of exactly the limit fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.llm.common import id_and_text
from runfield.sources.shared import written

#: Bytes of text in a shard at most.
LIMIT = 1 << 20
#: Bits of the hash that are used; a BIGINT holds them without sign.
BITS = 60
STEP = 12


def hashed_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, h: the first 60 bits of the MD5 of the id's digits."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return id_and_text(docs, id_col, text_col).select("doc_id", size.alias("n_bytes"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("h"))


def _prefix(h, depth: int):
    return F.shiftright(h, BITS - depth) if depth else F.lit(0).cast("long")


def directory(sizes: DataFrame, limit: int = LIMIT, step: int = STEP) -> DataFrame:
    """depth, prefix, shard_bytes, n_docs, oversize: the buckets that extendible hashing ends with."""
    found, left, base = None, sizes, 0
    while True:
        deep = min(BITS, base + step)
        fine = left.groupBy(_prefix(F.col("h"), deep).alias("fine")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        fine = written(fine, "prefix-sums")  # at most 2^step rows for each bucket that is still too large
        levels = F.explode(F.sequence(F.lit(base), F.lit(deep))).alias("depth")
        sums = fine.select("fine", "b", "n", levels).groupBy("depth", F.expr(f"shiftright(fine, {deep} - depth)").alias("prefix")).agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("n_docs"), F.max("fine").alias("fine"))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == BITS)
        # The shortest prefix that fits: it fits, and the next shorter one doesn't.
        above = sums.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), (F.col("shard_bytes") <= limit).alias("up_fits"))
        near = sums.withColumn("up", F.shiftright("prefix", 1)).join(above, ["depth", "up"], "left")
        leaves = near.where(fits & ~F.coalesce("up_fits", F.lit(False))).select("depth", "prefix", "shard_bytes", "n_docs", (F.col("shard_bytes") > limit).alias("oversize"))
        found = leaves if found is None else found.unionAll(leaves)
        if deep == BITS:
            return written(found, "directory")
        large = written(sums.where((F.col("depth") == deep) & (F.col("shard_bytes") > limit)).select(F.col("prefix").alias("p")), "too-large")
        if large.isEmpty():
            return written(found, "directory")
        left = left.withColumn("p", _prefix(F.col("h"), deep)).join(large, "p", "left_semi").drop("p")
        base = deep


def shards(docs: DataFrame, limit: int = LIMIT, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, depth, prefix, shard (the prefix as bits, '' for a lone shard), shard_bytes, oversize: a row for each of ``docs``."""
    sizes = written(hashed_sizes(docs, id_col, text_col), "sizes")
    return _placed(sizes, directory(sizes, limit, step))


def _placed(sizes: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each row with its bucket: one join by the prefix of as many bits as the shallowest bucket has.

    Of the buckets below that prefix, as many as extendible hashing split it into, a row is in the one whose whole prefix it
    has; rows go into the shuffle once each, whatever depths are in use.
    """
    least = buckets.agg(F.min("depth")).first()[0] or 0
    rows = sizes.withColumn("key", _prefix(F.col("h"), least))
    named = buckets.withColumn("key", F.expr(f"shiftright(prefix, depth - {least})"))
    bits = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(conv(prefix, 10, 2), depth, '0')"))
    met = rows.join(named, "key").where(F.expr(f"shiftright(h, {BITS} - depth) = prefix"))
    return met.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", bits.alias("shard"), "shard_bytes", "oversize")


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT, step: int = STEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns as Parquet at ``path``, a folder ``_shard=<bits>`` for each shard; returns the placement.

    Rows are shuffled once, by shard; a shard is at most ``limit`` bytes of text, so no task holds more than a few. Where
    ``docs`` has a column ``_shard`` of its own, that of the folders is named with one more ``_`` at its end, or as many as
    it takes.
    """
    placed = shards(docs, limit, step, id_col, text_col)
    which = placed.select(F.struct(F.col("doc_id").alias("id"), F.concat(F.lit("b"), "shard").alias("shard")).alias("w")).distinct()
    name = "_shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    one = docs.select(F.struct("*").alias("d"), F.col(id_col).cast("long").alias("k"))
    out = one.join(which, F.col("k").eqNullSafe(F.col("w.id"))).select("d.*", F.col("w.shard").alias(name))
    out.repartition(name).sortWithinPartitions(name).write.partitionBy(name).parquet(path)
    return placed
