import corpus_pipeline
from tests.llm import helpers

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = helpers.table(spark, "documents")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n, name
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
    whole = {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length", "ids_crc32").collect()}
    assert whole == {tuple(r) for r in packed.select("doc_id", "piece", "length", "ids_crc32").collect()}


def ids_of(df):
    return sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in df.collect())


def test_stages_take_odd_and_empty_tables(spark):
    odd = helpers.odd(spark)
    # what each stage keeps of the odd rows; the short text that a tiny model can't place may go either way
    want = {
        "quality classifier": [-1, -1, 1, 2, 3, 4, 5, 5, 6, 7, 8], "near-duplicates": [-1, -1, 1, 2, 3, 4, 5, 6, 7, 8], "decontamination": [-1, -1, 1, 2, 3, 4, 5, 5, 6, 7, 8],
        "language id": [-1, 4, 5, 5, 6, 7, 8], "packing": None,
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, SF)
        if name == "packing":
            assert set(ids_of(out)) == {-1, 1, 2, 3, 4, 5, 6, 7, 8} and out.where("piece = 0").count() == odd.count()
        elif name == "quality classifier":
            assert set(ids_of(out)) <= set(want[name]) and out.columns == odd.columns
        else:
            assert ids_of(out) == want[name] and out.columns == odd.columns, name
        assert stage(spark, helpers.none(spark), SF).count() == 0, name


def test_odd_rows_go_through_the_chain(spark):
    docs = helpers.table(spark, "documents")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    clash = [(1_000_000 + k, r[1], r[2], r[3], r[4]) for k, r in enumerate(helpers.odd_rows())] + [(None, helpers.prose(90, 5), "en", None, None)]
    rows = plain.unionByName(spark.createDataFrame(clash, plain.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SF).cache()
        assert rows.columns == plain.columns, name
    left = set(ids_of(rows))
    # null, empty and blank texts have no language; of the two equal rows one goes
    assert not left & {1_000_001, 1_000_002, 1_000_003, 1_000_009} and not {1_000_005, 1_000_006} <= left
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
    assert set(ids_of(packed)) == left and packed.where("piece = 0").count() == rows.count()
