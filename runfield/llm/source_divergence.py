"""How far each source's words stand from those of the other sources of its language, by dominance skybands.

Terms are runs of letters (A-Z lower-cased; every character beyond ASCII counts as one). A language keeps the V terms that
are in at least ``LEAST_DOCS`` of its documents. A group (lang, source), and likewise each language as a whole, gives a
kept term found ``count`` times there p = 1 + floor(SCALE (count + 1) / (N + V)), N being the sum of its counts. The
divergence of p from q is floor((p - q)^2 / q). Numbers are whole, from decimals where a product could leave 64 bits.

1. Counts: one pass over the texts; a task adds up what its batches hold before anything is shuffled. One shuffle, by
   (lang, term), serves the sums by source, the document frequency and the language's count alike.
2. Part ``pair``: for each pair of sources of a language the divergence summed over all kept terms. Counts are dealt to
   blocks of (terms, tile of sources, tile of sources), where they are rows of small matrices; terms that neither tile
   has are counted and have one value. Only sums by pair leave a block.
3. Part ``term``: the 200 terms that tell most of a group. A term dominates another if its count in the group is not lower,
   its count in the language not higher, and its UTF-8 earlier: it then comes first in any order by divergence, ties
   included. So each part of a group's terms keeps only those that fewer than k others of it dominate, its k-skyband. Skybands
   of parts are put together, dealt again and thinned again; what is left is ranked exactly. Parts have ``PART`` rows or
   fewer, however many terms a group has.

Defined cases: a null text, lang or source is the empty string; groups without terms are in all pairs of their language,
with count 0 for every term (value 0 where V is 0); a language of one source has no pairs; repeated rows count as often as
they occur; a null doc_id changes nothing, as ids are not read; an empty table gives no rows; very long texts are cut into
terms by block, and a very long term is a term; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runfield.llm import textops
from runfield.llm.common import bounded_batches, tidied
from runfield.sources.shared import written

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
#: Rows that one task compares for dominance at a time.
PART = 1 << 14
#: Terms and sources of a block of the pairs.
TERMS, TILE = 4096, 64
#: Rows of counts that a task holds before it adds them up.
HELD = 1 << 20

_byte = np.arange(256)
#: Bytes of terms: letters and all of characters beyond ASCII.
LETTER = ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
_COUNTS = "lang string, source string, term string, n long, docs long"


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a block of texts, and the text that each is of."""
    mask = LETTER[data]
    starts, ends = textops.spans(mask.view(np.uint8), at)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    # without what stands between them, terms lie next to each other, as an Arrow array of strings has them
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(textops.LOWER[data[mask]]))
    return words.dictionary_encode(), np.repeat(np.arange(len(at) - 1), np.diff(textops.word_rows(starts, at)))


def _added(parts: list[pa.Table]) -> pa.Table:
    """Counts of equal (g, term) added up; ``g`` numbers groups."""
    return pa.concat_tables(parts).group_by(["g", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["g", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a key may have several rows, one for each part of the input."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def given() -> Iterator[pa.RecordBatch]:
            whole, keys = _added(held), list(names)
            lang, source = (pa.array([k[c] for k in keys], pa.string()) for c in (0, 1))
            g = whole["g"]
            out = pa.table([lang.take(g.combine_chunks()), source.take(g.combine_chunks()), whole["term"], whole["n"], whole["docs"]], names=["lang", "source", "term", "n", "docs"])
            return iter(out.combine_chunks().to_batches(max_chunksize=1 << 16))

        rows = 0
        for batch in tidied(batches):
            groups = np.array([names.setdefault(k, len(names)) for k in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
            for i, j, data, at in textops.blocks(batch.column(0), 8 * textops.BLOCK):
                words, doc = _terms(data, at)
                if not len(words):
                    continue
                size = len(words.dictionary)
                in_doc, times = np.unique(doc * size + words.indices.to_numpy(), return_counts=True)
                term = in_doc % size
                key = groups[i:j][in_doc // size] * size + term
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                found = key[order][first]
                held.append(pa.table([pa.array(found // size), words.dictionary.take(pa.array(found % size)), pa.array(np.add.reduceat(times[order], first)), pa.array(np.diff(np.append(first, len(key))).astype(np.int64))], names=["g", "term", "n", "docs"]))
                rows += len(found)
            if rows > HELD:
                merged = _added(held)
                held, rows = [merged], merged.num_rows
                if rows > HELD // 2:
                    yield from given()
                    held, rows = [], 0
        if held:
            yield from given()

    return bounded_batches(docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))).mapInArrow(work, _COUNTS)


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, in_lang (the language's count), one (true on one row of each term of a language), of kept terms."""
    by_source = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = term.orderBy("source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = by_source.withColumns({"in_lang": F.sum("n").over(whole), "all_docs": F.sum("docs").over(whole), "k": F.row_number().over(term.orderBy("source"))})
    return summed.where(F.col("all_docs") >= least_docs).select("lang", "source", "term", "n", "in_lang", (F.col("k") == 1).alias("one"))


def _p(n: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE (n + 1) / (total + terms)), exact for all longs; 1 where there are no terms."""
    return F.expr(f"1 + coalesce(cast({n} + 1 as decimal(20,0)) * {SCALE} div nullif(cast({total} + {terms} as decimal(20,0)), 0), 0)")


def groups_of(docs: DataFrame, kept: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, total (N of the group), lang_total (N of the language), terms (V), sources (of the language): every group that occurs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = written(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct(), "groups")
    of_groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("one"), 1)).alias("terms"))
    of_langs = named.groupBy("lang").agg(F.count("*").alias("sources")).join(of_langs, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return written(named.join(of_groups, ["lang", "source"], "left").join(of_langs, "lang").select("lang", "source", *map(zero, ("total", "lang_total", "terms", "sources"))), "group-sizes")


def _blocked(rows: pa.Table) -> pa.Table:
    """Sums of divergences between the sources of two tiles over the terms of one block; rows without a term name sources."""
    named = rows.filter(pc.is_null(rows["term"]))
    source, tile, zero = named["source"].combine_chunks(), named["tile"].to_numpy(), named["p"].to_numpy()
    rest = rows.filter(pc.is_valid(rows["term"]))
    term = rest["term"].combine_chunks().dictionary_encode()
    at = pc.index_in(rest["source"].combine_chunks(), value_set=source).to_numpy()
    size = len(term.dictionary)
    p = np.repeat(zero[:, None], size, axis=1)
    p[at, term.indices.to_numpy()] = rest["p"].to_numpy()
    one, other = rows["ta"][0].as_py(), rows["tb"][0].as_py()
    a, b, value = [], [], []
    for left, right in {(one, other), (other, one)}:
        others = np.flatnonzero(tile == right)
        q = p[others]
        for s in np.flatnonzero(tile == left).tolist():
            found = ((p[s] - q) ** 2 // q).sum(axis=1)
            apart = others != s
            a += [s] * int(apart.sum())
            b += others[apart].tolist()
            value += found[apart].tolist()
    take = lambda column, k: column.combine_chunks().take(pa.array(k, pa.int64()))
    lang = pa.array([rows["lang"][0].as_py()] * len(a), pa.string())
    present = pa.array([size] * len(a), pa.int64())
    return pa.table([lang, take(named["source"], a), take(named["source"], b), pa.array(value, pa.int64()), present, take(named["p"], a), take(named["p"], b), take(named["terms"], a)], names=["lang", "source", "item", "value", "present", "p", "q", "terms"])


def pairs(kept: DataFrame, groups: DataFrame, terms: int = TERMS, tile: int = TILE) -> DataFrame:
    """lang, source, item, value: the divergence of each source from each other one of its language, over all kept terms."""
    sized = groups.withColumns({
        "tiles": F.ceil(F.col("sources") / tile).cast("long"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("terms") / terms)).cast("long"),
        "zero": _p("0L", "total", "terms"),
    })
    sized = sized.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")))
    none = sized.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("lang", "source", "tile", "tiles", "block", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "terms")
    found = kept.join(sized, ["lang", "source"]).select("lang", "source", "tile", "tiles", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", _p("n", "total", "terms").alias("p"), "terms")
    met = found.unionByName(none).withColumn("o", F.explode(F.expr("sequence(0L, tiles - 1)"))).select("lang", "source", "tile", "block", "term", "p", "terms", F.least("tile", "o").alias("ta"), F.greatest("tile", "o").alias("tb"))
    sums = met.groupBy("lang", "block", "ta", "tb").applyInArrow(_blocked, "lang string, source string, item string, value long, present long, p long, q long, terms long")
    added = sums.groupBy("lang", "source", "item").agg(*(F.sum(c).alias(c) for c in ("value", "present")), *(F.max(c).alias(c) for c in ("p", "q", "terms")))
    return added.select("lang", "source", "item", F.expr("value + (terms - present) * ((p - q) * (p - q) div q)").cast("long").alias("value"))


def skyband(n: np.ndarray, in_lang: np.ndarray, terms: pa.Array, k: int) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate: n not lower, in_lang not higher, UTF-8 earlier."""
    order = pc.sort_indices(terms).to_numpy()
    # of terms with both counts equal, the k earliest are enough
    same = np.lexsort((np.arange(len(order)), in_lang[order], n[order]))
    new = np.flatnonzero(np.any(np.diff(np.stack((n[order][same], in_lang[order][same])), prepend=-1), axis=0))
    place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
    order = order[np.sort(same[place < k])]
    n, in_lang = n[order], in_lang[order]
    by_lang = np.argsort(in_lang, kind="stable")
    bit = np.empty(len(order), np.int64)
    bit[by_lang] = np.arange(len(order))
    upto = np.searchsorted(in_lang[by_lang], in_lang, "right").tolist()
    # for each count, the set of terms with it or more, as bits in the order of in_lang
    sets, flags = {}, np.zeros(len(order), np.uint8)
    for c in np.unique(n)[::-1].tolist():
        flags[bit[n == c]] = 1
        sets[c] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    kept, seen = [], 0
    for i, (c, at, most) in enumerate(zip(n.tolist(), bit.tolist(), upto, strict=True)):
        # terms that k others dominate need not be counted: k that are kept dominate what they do
        if len(kept) < k or (sets[c] & seen & ((1 << most) - 1)).bit_count() < k:
            kept.append(i)
            seen |= 1 << at
    return order[kept]


def thinned(items: DataFrame, k: int = TOP, part: int = PART) -> DataFrame:
    """``items`` (lang, source, term, n, in_lang, value) without terms that k others of their group and part dominate."""
    schema = items.schema

    def work(rows: pa.Table) -> pa.Table:
        held = rows.drop_columns("part").combine_chunks()
        return held.take(pa.array(np.sort(skyband(held["n"].to_numpy(), held["in_lang"].to_numpy(), held["term"].combine_chunks(), k))))

    sizes = written(items.groupBy("lang", "source").agg(F.ceil(F.count("*") / part).cast("long").alias("parts")), "parts")
    dealt = items.join(sizes, ["lang", "source"]).select(*items.columns, F.pmod(F.xxhash64("term", "parts"), F.col("parts")).alias("part"))
    return written(dealt.groupBy("lang", "source", "part").applyInArrow(work, schema), "skyband")


def top_terms(kept: DataFrame, groups: DataFrame, k: int = TOP, part: int = PART) -> DataFrame:
    """lang, source, item, value, rank: the k terms of each group that diverge most from its language."""
    scored = kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "in_lang", _p("n", "total", "terms").alias("p"), _p("in_lang", "lang_total", "terms").alias("q"))
    items = written(scored.where("p > q").select("lang", "source", "term", "n", "in_lang", F.expr("(p - q) * (p - q) div q").alias("value")), "items")
    band = thinned(thinned(items, k, part), k, part)
    return _ranked(band.withColumnRenamed("term", "item")).where(F.col("rank") <= k)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = TOP, part: int = PART, terms: int = TERMS, tile: int = TILE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item (a source or a term), value, rank."""
    kept = written(kept_counts(term_counts(docs, text_col, lang_col, source_col), least_docs), "kept-terms")
    groups = groups_of(docs, kept, lang_col, source_col)
    named = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return named(_ranked(pairs(kept, groups, terms, tile)), "pair").unionAll(named(top_terms(kept, groups, k, part), "term"))
