import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from runfield.llm import language_id as L
from tests.llm import helpers


def test_held_out_accuracy(spark):
    docs = helpers.table(spark, "documents", "sf0.01")
    got = L.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.99
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= set(got.lang)


def test_counts_equal_a_plain_count():
    texts = pa.array(["Ab  c1d", None, "", "ÉÉ é", "123"])
    found = {}
    for a, _, row, feature, count, has in L.term_counts(texts):
        for r, f, c in zip(row, feature, count, strict=True):
            found.setdefault(a + int(r), {})[int(f)] = int(c)
        assert has.tolist() == [True, False, False, True, False]
    # "ab c d": 4 letters, pairs ab b_ _c c_ _d, triples ab_ b_c _c_ c_d
    assert sum(found[0].values()) == 4 + 5 + 4
    # "éé é": one letter three times, pairs éé é_ _é, triples éé_ é_é
    assert sorted(found[3].values()) == [1, 1, 1, 1, 1, 3]


def test_odd_rows_are_predicted(spark):
    docs = helpers.table(spark, "documents", "sf0.01")
    model = L.fitted(docs)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["held_out"]) for r in L.predicted(helpers.odd(spark), model).collect()]
    assert len(got) == len(helpers.odd_rows())
    blank = [g for g in got if g[0] in (1, 2, 3)]
    assert all(g[1] == "und" and g[2] == 0 for g in blank) and len(blank) == 3
    assert all(not g[3] for g in got if g[0] is None)


def test_nothing_to_learn_from(spark):
    docs = helpers.odd(spark).drop("lang").selectExpr("*", "cast(null as string) AS lang")
    assert {r["lang_pred"] for r in L.predicted(docs).collect()} == {"und"}
    assert L.predicted(helpers.none(spark)).count() == 0
    assert L.identified(docs).count() == 0


def test_ftrl_learns_and_stays_sparse():
    rng = np.random.default_rng(0)
    learner = L.FtrlProximal(50, 2, l1=0.5)
    for _ in range(400):
        y = int(rng.integers(2))
        learner.step(np.array([y, 2 + int(rng.integers(48))]), np.array([1.0, 0.3]), y)
    w = learner.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and np.mean(w == 0) > 0.2


def test_temperature_lowers_confidence_of_wrong_logits():
    logits = np.array([[4.0, 0.0]] * 100)
    y = np.array([0] * 70 + [1] * 30)
    assert L._temperature(logits, y) > 2


def test_temperature_is_the_one_of_least_loss():
    rng = np.random.default_rng(1)
    for true in (0.4, 1.0, 2.5):
        logits = rng.normal(0, 3, (6000, 4))
        chance = np.exp(logits / true)
        chance /= chance.sum(axis=1, keepdims=True)
        y = (chance.cumsum(axis=1) < rng.random((6000, 1))).sum(axis=1)

        def loss(t):
            e = logits / t
            return float(np.mean(np.log(np.exp(e).sum(axis=1)) - e[np.arange(len(y)), y]))

        found = L._temperature(logits, y)
        assert abs(found / true - 1) < 0.1
        assert loss(found) <= min(loss(t) for t in np.geomspace(0.1, 10, 60)) + 1e-9


def test_languages_beyond_the_limit_are_not_learned(spark):
    docs = helpers.table(spark, "documents")
    model = L.fitted(docs, max_languages=2)
    counts = docs.where(~L.held_out()).where("lang is not null").groupBy("lang").count().orderBy(F.desc("count")).limit(2).collect()
    assert model.languages == sorted(r["lang"] for r in counts)
    assert {r["lang_pred"] for r in L.predicted(docs, model).collect()} <= {*model.languages, "und"}


def test_idf_counts_every_row_to_learn_from(spark):
    docs = helpers.table(spark, "documents")
    more = docs.unionByName(docs.where("doc_id < 40")).unionByName(docs.where("doc_id < 9").withColumn("text", F.lit(None).cast("string")))
    model = L.fitted(more)
    df, n = np.zeros(L.FEATURES), 0
    for r in more.where("lang is not null").collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2:
            continue
        for _, _, _, feature, _, has in L.term_counts(pa.array([r["text"]], pa.string())):
            df[feature] += 1
            n += int(has.sum())
    assert np.allclose(model.idf, np.log((1 + n) / (1 + df)) + 1) and n > 100
    assert model.temperature > 0 and model.weights.shape == (L.FEATURES + 1, len(model.languages))


def test_stage_keeps_all_columns(spark):
    docs = helpers.table(spark, "documents")
    kept = L.identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_sections_do_not_change_counts(monkeypatch):
    texts = pa.array(["Ab  c1d " * 9 + "é", "x", helpers.prose(50)])
    whole = [x[2:5] for x in L.term_counts(texts)]
    for section in (1, 2, 3, 7):
        monkeypatch.setattr(L, "SECTION", section)
        for a, b in zip(whole, [x[2:5] for x in L.term_counts(texts)], strict=True):
            assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_repeated_rows_of_a_rare_language_do_not_hide_it(spark):
    docs = helpers.table(spark, "documents").select("doc_id", "text", "lang")
    text = "zzqa wvok zzur qipz wvaxx zzok urqa. " * 3
    rare = spark.range(200_000).selectExpr("cast(1000003 as bigint) AS doc_id", f"'{text}' AS text", "'zz' AS lang")
    assert zlib.crc32(b"1000003") % 4 != 2
    model = L.fitted(docs.unionByName(rare))
    assert "zz" in model.languages
    assert model.predict(pa.array([text]))[0] == ["zz"]


def test_model_equals_a_plain_one():
    """Features, weights and scores once more, number by number."""
    mask, keys = (1 << 64) - 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

    def features(text):
        chars, out = [], {}
        for c in text:
            x = ord(c.lower()) if c.isalpha() else 0
            if x or not chars or chars[-1]:
                chars.append(x)
        for n in (1, 2, 3):
            for k in range(len(chars) - n + 1):
                gram = chars[k : k + n]
                if any(gram):
                    code = 0
                    for x in gram:
                        code = code << 21 | x
                    f = (code * keys[n - 1] & mask) >> 49
                    out[f] = out.get(f, 0) + 1
        return out

    def vector(counts, idf):
        value = {f: (1 + math.log(c)) * idf[f] for f, c in counts.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        return {f: v / norm for f, v in value.items()}

    texts = ["the cat sat on the mat.", "le chat est sur le lit", "the dog and the cat", "un chat, un chien!", "a dog on a mat", "le chien et le chat"]
    languages, y = ["en", "fr"], [0, 1, 0, 1, 0, 1]
    rng = np.random.default_rng(4)
    idf = rng.uniform(1, 3, L.FEATURES)
    examples = []
    for _, _, row, feature, count, _ in L.term_counts(pa.array(texts)):
        examples += [(feature[row == k], count[row == k], y[k]) for k in range(len(texts))]
    model = L._trained(examples, languages, idf, epochs=2)
    # five or more of neither language: all are learned from and the temperature is 1
    assert model.temperature == 1
    z, n = {}, {}

    def weight(f, k):
        a, b = z.get((f, k), 0.0), n.get((f, k), 0.0)
        return 0.0 if abs(a) <= 0.02 else -(a - math.copysign(0.02, a)) / ((1 + math.sqrt(b)) / 0.5 + 0.1)

    def chances(x):
        e = [math.exp(sum(v * weight(f, k) for f, v in x.items())) for k in range(2)]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(len(texts)):
            x = vector(features(texts[i]), idf) | {L.FEATURES: 1.0}
            p = chances(x)
            steps = [(f, k, v * (p[k] - (y[i] == k)), weight(f, k)) for f, v in x.items() for k in range(2)]
            for f, k, g, w in steps:
                old = n.get((f, k), 0.0)
                z[f, k] = z.get((f, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / 0.5 * w
                n[f, k] = old + g * g
    new = ["the cat and a chien", "le mat", "Ünknown dog"]
    names, scores = model.predict(pa.array(new))
    for text, name, score in zip(new, names, scores, strict=True):
        p = chances(vector(features(text), idf) | {L.FEATURES: 1.0})
        assert name == languages[int(np.argmax(p))] and abs(score - max(p)) < 1e-9
