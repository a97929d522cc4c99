"""Decontamination, quality classifier and quality rules."""

import hashlib

import numpy as np
import pytest

from runfield.llm import decontaminate as D
from runfield.llm import quality_classifier as C
from runfield.llm import quality_rules as R
from tests.llm import helpers


def brute_hits(text, items):
    words, hit, found = helpers.words_of(text), set(), set()
    for item, body in items:
        w = helpers.words_of(body)
        if item is None or not w:
            continue
        grams = {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)}
        n = min(10, len(w))
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("part_windows", [D.PART_WINDOWS, 30])
def test_hits_equal_brute_force(spark, part_windows):
    long = helpers.prose(40, 7)
    items = [(1, long), (2, "Short one, here"), (3, None), (4, "..."), (None, "no id at all"), (10, long), (5, " ".join(long.split()[5:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = long.split()
    texts = ["a " + " ".join(words[3:14]) + " b", "x SHORT, one here. short one here", " ".join(words[:9]), long + " " + long, None, "", "no id at all", " ".join(words[2:12]) + " z " + " ".join(words[20:31]), "short one", "short one here" * 2]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in D.benchmark_hits(docs, bench, part_windows=part_windows).collect())
    assert got == sorted(((-1 if i is None else i), *brute_hits(t, items)) for i, t in rows)


@pytest.mark.parametrize("part_bytes", [D.PART_BYTES, 20_000])
def test_a_window_in_very_many_items(spark, part_bytes):
    passage = helpers.prose(14, 7)
    items = [(k, passage if k % 2 else helpers.prose(12, k)) for k in range(600)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    parts, _ = D.window_sets(bench, part_bytes=part_bytes)
    assert (parts > 5) == (part_bytes < D.PART_BYTES)
    rows = [(1, "x " + passage), (2, helpers.prose(12, 4) + " " + passage), (3, "none"), (1, "x " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:6] for r in D.benchmark_hits(docs, bench, part_windows=500_000 if part_bytes == D.PART_BYTES else 100).collect())
    assert got == sorted((i, *brute_hits(t, items)) for i, t in rows)


def test_windows_do_not_cross_texts(spark):
    words = helpers.prose(12, 3).split()
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words[:6])), (2, " ".join(words[6:]))], "doc_id long, text string").coalesce(1)
    assert not any(r["contaminated"] for r in D.benchmark_hits(docs, bench).collect())


def test_spans_and_documents_are_removed(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = helpers.odd(spark).selectExpr("doc_id", "text", "lang", "kept").unionAll(spark.createDataFrame([(90, "Été. Alpha, beta (gamma)! fin", "x", 1)], "doc_id long, text string, lang string, kept int"))
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, bench, mode="span").collect() if r["doc_id"]}
    assert cut[90] == "Été. )! fin" and cut[1] is None
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    with pytest.raises(ValueError):
        D.decontaminate(docs, bench, mode="else")


def test_spans_do_not_depend_on_parts(spark):
    passage = helpers.prose(60, 7)
    bench = spark.createDataFrame([(1, passage), (2, helpers.prose(30, 8))], "item_id long, text string")
    rows = [(1, "Été before. " + passage + " after", 5), (2, passage + " ½ mid " + passage, 5), (3, "nothing here", 5), (4, None, None), (1, passage, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _ranges int")
    one, many = (D.decontaminate(docs, bench, mode="span", part_windows=n) for n in (500_000, 30))
    assert many.schema == docs.schema and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    assert sorted(r["text"] or "" for r in many.collect()) == sorted(["Été before. . after", ". ½ mid .", "nothing here", "", "."])


def test_empty_benchmark_and_tables(spark):
    bench = helpers.table(spark, "benchmark")
    assert not any(r["contaminated"] for r in D.benchmark_hits(helpers.odd(spark), bench.limit(0)).collect())
    assert D.benchmark_hits(helpers.none(spark), bench).count() == 0


def plain_features(text):
    """Tokens by a plain loop."""
    out, last = [], 0
    for c in text.encode():
        kind = 0 if c in b" \t\n\r\x0b\x0c" else 1 if chr(c).isascii() and chr(c).isalnum() or c >= 128 else 2
        if kind and kind == last:
            out[-1] += bytes([c])
        elif kind:
            out.append(bytes([c]))
        last = kind
    return out


def test_features_count_tokens_pairs_and_triples():
    from runfield.llm import textops
    import pyarrow as pa

    texts = ["The### end, x", "", "a b a b a b a b a b", "one"]
    (_, _, data, at), = textops.blocks(pa.array(texts))
    row, bucket = C.features(data, at, 1000)
    for i, t in enumerate(texts):
        n = len(plain_features(t))
        assert (row == i).sum() == n + max(0, n - 1) + max(0, n - 2)
    assert (bucket[row == 2] == 1001).sum() == 6 and (bucket[row == 0] >= 1000).sum() == 3 and not (bucket[row == 0] == 1001).any()


def test_weights_equal_plain_ones(spark):
    """log(target / raw) and its sum over a document, counted once more without arrays."""
    import math
    from collections import Counter

    from runfield.llm import textops

    texts = {1: "a b c, a b c, a b c", 2: "good plain words here", 3: "other words, here and there", 4: None, 5: "a b"}
    labels = spark.createDataFrame([(2, 1), (3, 1), (1, 0), (99, 1)], "doc_id long, quality int")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["log_weight"] for r in C.scored(docs, labels, buckets=50).collect()}

    def key(text):
        raw = text.encode()
        return int(textops.span_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])

    def grams(text):
        tokens = [key(t.decode()) for t in plain_features(text or "")]
        out = [t % 50 for t in tokens]
        out += [int(textops.windows(np.array(tokens[k : k + 2], np.uint64), 2)[0]) % 50 for k in range(len(tokens) - 1)]
        seen, fresh = set(), []
        for k in range(len(tokens) - 2):
            fresh.append(tuple(tokens[k : k + 3]) not in seen)
            seen.add(tuple(tokens[k : k + 3]))
        repeats = fresh.count(False) > C.REPEATS * len(fresh)
        return out + [50 if f or not repeats else 51 for f in fresh]

    raw, target = Counter({b: C.ALPHA for b in range(52)}), Counter()
    for i, t in texts.items():
        for b in grams(t):
            raw[b] += 1
            target[b] += i in (2, 3)

    def weight(b):
        part = range(50) if b < 50 else range(50, 52)
        share = raw[b] / sum(raw[x] for x in part)
        return math.log((target[b] + C.PRIOR * share) / (sum(target[x] for x in part) + C.PRIOR) / share)

    assert all(abs(got[i] - sum(map(weight, grams(t)))) < 1e-9 for i, t in texts.items()) and got[4] == 0


def test_classifier_keeps_good_and_drops_bad(spark):
    docs, labels = helpers.table(spark, "documents", "sf0.01"), helpers.table(spark, "labels", "sf0.01")
    got = C.resampled(docs, labels).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.05
    kept = C.kept_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in C.resampled(docs, labels).where("kept").collect()}


def test_top_k_is_exact_and_reproducible(spark):
    docs, labels = helpers.table(spark, "documents"), helpers.table(spark, "labels")
    rows = C.resampled(docs, labels, k=37).toPandas()
    assert set(rows[rows.kept].doc_id) == set(rows.nlargest(37, "gumbel_key").doc_id)
    again = C.resampled(docs.repartition(5), labels, k=37).toPandas()
    assert set(again[again.kept].doc_id) == set(rows[rows.kept].doc_id)


@pytest.mark.parametrize("k", [0, 1, 7, 50, 99, 100, 101, 500])
def test_kth_largest(spark, k):
    values = [float(v % 40) for v in range(100)]
    found = C.kth_largest(spark.createDataFrame([(v,) for v in values], "v double"), "v", k, few=5, cells=4)
    assert found == (float("inf") if k == 0 else float("-inf") if k >= 100 else sorted(values, reverse=True)[k - 1])


def test_gumbel_noise_has_its_distribution():
    import pyarrow as pa

    noise = C._gumbel(pa.array(np.arange(20_000)), 3)
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.std() - 1.2825) < 0.03


def test_classifier_odd_rows(spark):
    labels = helpers.table(spark, "labels")
    for docs in (helpers.odd(spark), helpers.none(spark)):
        assert C.resampled(docs, labels).count() == docs.count() and C.kept_documents(docs, labels.limit(0)).count() == docs.count()


def plain_repeats(words):
    from collections import Counter

    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)})


def test_repeat_words_equal_a_plain_count():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 10, 60, 300):
        for size in (2, 5, 40):
            words = [b"w%d" % k for k in rng.integers(0, size, n)]
            assert R.repeat_words(words) == plain_repeats(words)


def test_line_rules():
    good = b"This is a plain sentence with quite a few words in it."
    assert R.failing(good, 12, False) is None and R.failing(good, 12, True) == "repeated"
    assert R.failing(b"a ### line $$ of *** junk.", 6, False) == "symbols"
    assert R.failing("Home » About » Contact us now please.".encode(), 7, False) == "navigation" and R.failing(b"Read more", 2, False) == "navigation"
    assert R.failing(b"THE WHOLE LINE IS SHOUTED!!", 5, False) == "shouting"
    assert R.failing(b"We use it; All Rights Reserved by us.", 8, False) == "boilerplate"
    assert R.failing(b"a line that simply stops without any", 7, False) == "punctuation"
    assert R.closes(b'he said "no."  ') and not R.closes(b"")


def test_judging_odd_rows(spark):
    got = {(r["doc_id"] or -1): r for r in R.judged(helpers.odd(spark), cleaned=True).collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[1]["kept"] and got[1]["cleaned"] == ""
    assert got[4]["n_words"] == 30_000 and got[4]["kept"]
    assert got[6]["n_words"] == 1 and got[6]["word_chars"] == 50_000
    assert R.judged(helpers.none(spark)).count() == 0


def test_losing_too_much():
    good = [helpers.prose(12, i) for i in range(6)]
    endless = [helpers.prose(12, i).rstrip(".") for i in range(20, 24)]
    keep, drop = R.judge("\n".join(good + endless[:1])), R.judge("\n".join(good[:4] + endless))
    assert keep[6] and keep[8] == 1 and endless[0] not in keep[10] and good[5] in keep[10]
    assert not drop[6] and not drop[5] and drop[8] == 4
