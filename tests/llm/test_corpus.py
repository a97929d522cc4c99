"""Source divergence, exact duplicates and fill-in-the-middle, against brute force in plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runfield.llm import boundary_set, exact_dedup, fill_in_middle, source_divergence
from runfield.llm.boundary_set import ArrayContainer, BitmapContainer, BoundarySet, RunContainer
from tests.llm import helpers

# Exact duplicates


def plain_groups(rows):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text) rows."""
    of, out = defaultdict(list), []
    for i, (doc, text) in enumerate(rows):
        of[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc is None, doc or 0, i, doc))
    for text, members in of.items():
        least = min(members)
        out += [(m[3], least[3], len(members), m == least, hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return sorted(map(repr, out))


@pytest.mark.parametrize(("counters", "least"), [(4096, 200), (3, 2), (1, 1)])
def test_exact_groups_against_brute_force(spark, counters, least):
    draw = random.Random(counters)
    texts = ["a b", "a  b", "a\tb", " a b", "", None, "   ", "c", "x y", "日本 語", helpers.prose(30_000, 4)]
    rows = [(draw.choice([None, *range(60)]), draw.choice(texts[:4] if draw.random() < 0.5 else texts)) for _ in range(300)]
    got = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), counters, least).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain_groups(rows)


def test_frequent_digests_are_always_candidates(spark):
    draw, counters = random.Random(3), 20
    rows = [(f"{draw.randrange(3)}" if draw.random() < 0.7 else f"r{draw.randrange(2000)}",) for _ in range(4000)]
    table = spark.createDataFrame(rows, "d string").select(F.col("d").cast("binary").alias("digest")).repartition(6)
    found = {bytes(r[0]).decode() for r in exact_dedup.candidates(table, counters, least=30).collect()}
    counts = Counter(r[0] for r in rows)
    assert {d for d, n in counts.items() if n >= max(3 * len(rows) / (counters + 1), 30)} <= found and len(found) <= counters + 1
    assert {"0", "1", "2"} <= found


def test_exact_duplicates_of_odd_rows(spark):
    odd = helpers.odd(spark)
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    # both rows of id 5 are one; the null, the empty text and the second null are one, kept under id 1
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    got = exact_dedup.groups(odd)
    assert got.count() == odd.count() and got.where("kept").count() == 8
    assert exact_dedup.groups(helpers.none(spark)).count() == 0 and exact_dedup.deduplicated(helpers.none(spark)).count() == 0


def test_rows_of_one_id_with_other_texts_are_judged_apart(spark):
    rows = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (None, "z"), (None, "z")]
    kept = exact_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r[0] or 0), r[1]) for r in kept) == [(0, "z"), (1, "a"), (2, "b")]


def test_frequent_texts_are_joined_by_broadcast(spark):
    docs = spark.createDataFrame([(i, "same") for i in range(500)] + [(1000 + i, str(i)) for i in range(300)], "doc_id long, text string")
    plan = exact_dedup.groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


# Fill in the middle


@pytest.mark.parametrize(
    ("values", "kinds"),
    [
        ([], []), ([0], [ArrayContainer]), ([5, 70_000, 70_001], [ArrayContainer, ArrayContainer]), (list(range(100, 9000)), [RunContainer]),
        (list(range(0, 60_000, 3)), [BitmapContainer]), (list(range(0, 12_000, 3)) + list(range(65_536, 140_000)), [ArrayContainer, RunContainer, RunContainer]), ([65_535, 65_536, 1 << 33], [ArrayContainer] * 3),
    ],
)
def test_boundary_sets(values, kinds):
    made = BoundarySet(np.array(values, np.int64))
    assert [type(c) for c in made.containers] == kinds and len(made) == len(values)
    picked = range(len(values)) if len(values) < 500 else [*range(0, len(values), 97), len(values) - 1]
    assert [made.select(k) for k in picked] == [values[k] for k in picked]
    for k in (-1, len(values)):
        with pytest.raises(IndexError):
            made.select(k)


def test_random_boundary_sets():
    draw = np.random.default_rng(5)
    for density in (0.001, 0.05, 0.3, 0.9, 0.999):
        values = np.flatnonzero(draw.random(200_000) < density)
        made = BoundarySet(values)
        for k in draw.integers(0, len(values), 200).tolist():
            assert made.select(k) == values[k]
    assert boundary_set.container(np.arange(4096) * 2).__class__ is ArrayContainer


def plain_cut(doc, text, seed=7, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    h = hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
    n, text = len(units), text or ""
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100)])
def test_cuts_against_brute_force(spark, rate, spm):
    draw = random.Random(rate + spm)
    pieces = ["\n", "\n\n", "eins", "日本", "<", "<P", "S>", "\r\n", " ", "é\n", "<S>x", "\x00", "𝄞\n"]
    weights = [4, 2, 6, 3, 3, 2, 2, 2, 1, 4, 0.2, 1, 2]
    rows = [(draw.choice([None, *range(99)]), draw.choice([None, "", "a", "\n", "a\n", "<P>", "".join(draw.choices(pieces, weights, k=draw.randrange(1, 40)))])) for _ in range(400)]
    rows += [(5000, "l\n" * 90_000), (5001, "\n" * 70_000 + "end"), (5002, "x" * 300_000)]
    found = fill_in_middle.transformed(spark.createDataFrame(rows, "doc_id long, text string"), rate=rate, spm_rate=spm)
    got = found.select("*", fill_in_middle.restored().alias("back")).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr(plain_cut(d, t, rate=rate, spm=spm)) for d, t in rows)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)


def test_cuts_of_odd_rows(spark):
    found = fill_in_middle.digested(fill_in_middle.transformed(helpers.odd(spark)))
    assert found.count() == helpers.odd(spark).count()
    expected = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in helpers.odd(spark).collect())
    assert sorted(r["restored_sha256"] for r in found.collect()) == expected
    assert fill_in_middle.transformed(helpers.none(spark)).count() == 0


# Source divergence


def plain_divergences(rows, least_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))) for text, lang, source in rows]
    df, in_lang, n = Counter(), Counter(), Counter()
    for lang, source, words in docs:
        df.update((lang, w) for w in set(words))
        in_lang.update((lang, w) for w in words)
        n.update((lang, source, w) for w in words)
    out = []
    for lang in {d[0] for d in docs}:
        terms = [w for (x, w), k in df.items() if x == lang and k >= least_docs]
        sources, v = {d[1] for d in docs if d[0] == lang}, len(terms)
        share = lambda count: {w: 1 + 10**9 * (count(w) + 1) // (sum(map(count, terms)) + v) for w in terms}  # noqa: E731, B023
        p, q = {s: share(lambda w: n[lang, s, w]) for s in sources}, share(lambda w: in_lang[lang, w])  # noqa: B023
        apart = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(apart(p[s][w], p[o][w]) for w in terms), o.encode(), o) for o in sources - {s}]
            told = [(-apart(p[s][w], q[w]), w.encode(), w) for w in terms if n[lang, s, w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", told, top)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def drawn_documents(seed, docs=150, sources=6):
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdé日ü", k=draw.randint(1, 4))) for _ in range(90)] + ["Ab", "aB", "AB", "Éa"]
    text = lambda s: draw.choice([" ", "-", "1", "\n"]).join(draw.choices(words[s * 7 :] + words[:40], k=draw.randrange(0, 60)))
    rows = []
    for _ in range(docs):
        s = min(draw.randrange(sources), draw.randrange(sources))
        rows.append((draw.choice([text(s)] * 9 + [None]), draw.choice(["en", "en", "de", None]), f"s{s}" if s else None))
    return [*rows, ("alone", "xx", "one"), ("", "yy", "a"), (None, "yy", "b")]


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"part": 16, "terms": 8, "tile": 2, "k": 5}), (3, {"part": 50, "terms": 16, "tile": 1, "k": 12})])
def test_divergences_against_brute_force(spark, seed, options):
    rows = drawn_documents(seed)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = source_divergence.divergences(docs, **options)
    assert sorted(tuple(r) for r in got.collect()) == plain_divergences(rows, top=options.get("k", 200))
    assert got.schema["value"].dataType.simpleString() == "bigint" and got.schema["rank"].dataType.simpleString() == "int"


def test_skybands_against_brute_force():
    draw = random.Random(4)
    for size, k in ((0, 3), (1, 1), (60, 1), (300, 7), (300, 400), (500, 20)):
        terms = sorted({"".join(draw.choices("abcé", k=5)) for _ in range(size)})
        draw.shuffle(terms)
        n = np.array([draw.randint(1, 12) for _ in terms], np.int64)
        in_lang = n + np.array([draw.randint(0, 30) for _ in terms], np.int64)
        rank = {w: i for i, w in enumerate(sorted(terms, key=str.encode))}
        dominated = [sum(n[j] >= n[i] and in_lang[j] <= in_lang[i] and rank[terms[j]] < rank[terms[i]] for j in range(len(terms))) for i in range(len(terms))]
        found = source_divergence.skyband(n, in_lang, pa.array(terms, pa.string()), k)
        assert sorted(found.tolist()) == [i for i, d in enumerate(dominated) if d < k]


def test_counts_are_given_out_in_parts(spark, monkeypatch):
    rows = drawn_documents(8)
    monkeypatch.setattr(source_divergence, "HELD", 40)
    counts = source_divergence.term_counts(spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1))
    found = counts.groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")).collect()
    n, docs = Counter(), Counter()
    for text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        n.update((lang or "", source or "", w) for w in words)
        docs.update((lang or "", source or "", w) for w in set(words))
    assert sorted(tuple(r) for r in found) == sorted((*k, n[k], docs[k]) for k in n)


def test_large_counts_are_exact(spark):
    rows = spark.createDataFrame([(10**15, 3 * 10**15, 7), (0, 0, 0), (2**62, 2**62, 5)], "n long, total long, terms long")
    got = [r["p"] for r in rows.select(source_divergence._p("n", "total", "terms").alias("p")).collect()]
    assert got == [1 + 10**9 * (10**15 + 1) // (3 * 10**15 + 7), 1, 1 + 10**9 * (2**62 + 1) // (2**62 + 5)]


def test_divergences_of_odd_rows(spark):
    got = source_divergence.divergences(helpers.odd(spark).withColumn("rank", F.lit("x")), least_docs=1)
    rows = [(r["text"], r["lang"], r["source"]) for r in helpers.odd(spark).collect()]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergences(rows, least_docs=1)
    assert source_divergence.divergences(helpers.none(spark)).count() == 0
