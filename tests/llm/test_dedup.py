from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from runfield.llm import minhash_dedup as M
from tests.llm import helpers


def shingle_set(text):
    w = helpers.words_of(text)
    return set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """class of each doc_id, by all pairs that share a shingle."""
    sets, holders = {i: shingle_set(t) for i, t in rows}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    both = Counter((a, b) for h in holders.values() for k, b in enumerate(h) for a in h[:k])
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), n in both.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= M.SIMILARITY:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def edited(text, seed, n):
    words = text.split(" ")
    rng = np.random.default_rng(seed)
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"w{seed}x{k}"
    return " ".join(words)


def test_equals_brute_force(spark):
    docs = helpers.table(spark, "documents", "sf0.01")
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_group_of_copies_astride_the_limit(spark):
    # copies of one text with 0 to 8 words changed: some pairs are linked, some only through others
    base = helpers.prose(300, 1)
    rows = [(i, edited(base, i, i % 9)) for i in range(120)] + [(500 + i, helpers.prose(40, i)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in M.classes(docs).collect()}
    assert got == brute(rows) and len(set(got.values())) < 120


def test_blocks_meet_all(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    base = helpers.prose(200, 2)
    rows = [(i, edited(base, i, 3 + i % 5)) for i in range(40)]
    got = {r["doc_id"]: r["class_id"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_signatures_estimate_probability_jaccard():
    x = np.array([1, 2, 3, 4], np.uint64)
    a, b = np.array([1.0, 2, 3, 4]), np.array([4.0, 1, 2, 2])
    exact = sum(1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in range(4)) for i in range(4))
    s = M.signatures(np.repeat([0, 1], 4), np.concatenate((x, x)), np.concatenate((a, b)), 2, 8192)
    assert abs((s[0] == s[1]).mean() - exact) < 0.02
    many = np.random.default_rng(0).integers(0, 1 << 62, 900).astype(np.uint64)
    s = M.signatures(np.repeat([0, 1], [800, 800]), np.concatenate((many[:800], many[100:])), np.ones(1600), 2, 4096)
    assert abs((s[0] == s[1]).mean() - 700 / 900) < 0.03


def test_copies_that_repeat_a_passage_are_found(spark):
    rows = []
    for k in range(100):
        words = helpers.prose(104, 1000 + k).split()
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words[:80], f"other{k}", *words[81:], *(100 * words[:54])]))]
    got = {r["doc_id"]: r["class_id"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) and sum(got[2 * k + 1] == 2 * k for k in range(100)) > 90


def test_odd_rows(spark):
    got = [(r["doc_id"], r["class_id"]) for r in M.classes(helpers.odd(spark)).collect()]
    assert sorted(got) == [(i, i) for i in range(1, 9)]
    kept = M.deduplicated(helpers.odd(spark))
    assert kept.columns == helpers.odd(spark).columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 8]
    assert M.classes(helpers.none(spark)).count() == 0 and M.deduplicated(helpers.none(spark)).count() == 0


def test_copies_and_case(spark):
    text = helpers.prose(50, 9)
    rows = [(3, text), (1, text.upper()), (2, text + " !"), (9, "one two three"), (8, "One two, three"), (7, "one two")]
    got = {r["doc_id"]: r["class_id"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 7: 7}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["doc_id"]: r["class_id"] for r in M.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_a_long_chain_of_versions_is_one_group(spark):
    # each version has 8 words of 100 other than the one before it, so only neighbours are alike
    draw = np.random.default_rng(11)
    words, rows = [f"w{k}" for k in range(100)], []
    order = draw.permutation(1500)
    for k in range(1500):
        for at in draw.choice(100, 4, replace=False).tolist():
            words[at] = f"v{k}x{at}"
        rows.append((int(order[k]), " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_a_hot_bucket_is_split(spark):
    keyed = spark.range(60_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 20_000).alias("key"), F.col("id").alias("doc_id"))
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        met = M.in_buckets(M.written(keyed, "keyed"))
        assert len(met.collect()) == 60_000
        assert "skew=true" in met._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_id_with_several_texts_joins_them(spark):
    a, b = helpers.prose(60, 1), helpers.prose(60, 2)
    rows = [(5, a), (5, b), (7, a), (3, b), (5, None), (5, a), (9, None), (9, None)]
    got = sorted((r["doc_id"], r["class_id"]) for r in M.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3), (5, 3), (7, 3), (9, 9)]
