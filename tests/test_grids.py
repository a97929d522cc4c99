import math
import random

import pytest
from pyspark.sql import functions as F

from runfield.functions import scalars
from runfield.operators import components, features, relabel, rle, unify, validate
from runfield.plans import pipeline
from runfield.sources import volumes
from runfield.sources.volumes import Dims
from tests import grids


def voxels(spark, cells):
    return spark.createDataFrame(cells, "slice int, row int, col int")


def labels_of(df):
    return {(r["slice"], r["row"], r["col"]): r["label"] for r in df.collect()}


#: All hand-made grids as one volume, far enough apart along the slices, so that one job covers them.
def stacked():
    cells, base, parts = [], 0, {}
    for name, text in grids.HAND_MADE.items():
        parts[name] = [(z + base, y, x) for z, y, x in grids.cells_of(text)]
        cells += parts[name]
        base += 10
    return cells, Dims(5, 5, base)


@pytest.mark.parametrize("strategy", pipeline.STRATEGIES)
def test_hand_made_grids(spark, strategy):
    cells, dims = stacked()
    found = pipeline.labelled_runs(voxels(spark, cells), strategy, dims, slices=2)
    expected = grids.flood(cells)
    assert labels_of(relabel.label_cells(found)) == expected
    got = {r["label"]: tuple(r)[1:] for r in features.of_runs(found).collect()}
    assert got == grids.features(expected)


@pytest.mark.parametrize("strategy", pipeline.STRATEGIES)
@pytest.mark.parametrize("density", [0.08, 0.3])
def test_random_grids(spark, strategy, density):
    draw = random.Random(int(density * 100))
    dims = Dims(17, 9, 7)
    cells = [(z, y, x) for z in range(7) for y in range(9) for x in range(17) if draw.random() < density]
    found = labels_of(pipeline.label_image(voxels(spark, cells), strategy=strategy, dims=dims, slices=3))
    assert found == grids.flood(cells)


def test_small_blocks_contract_to_the_same_roots(spark):
    draw = random.Random(5)
    cells = [(z, y, x) for z in range(4) for y in range(12) for x in range(20) if draw.random() < 0.25]
    seg = rle.segments(voxels(spark, cells))
    links = unify.contacts(seg)
    one = {tuple(r) for r in components.roots(seg.select("seg_id"), links).select("seg_id", "root").collect()}
    many = {tuple(r) for r in components.roots(seg.select("seg_id"), links, block=7).select("seg_id", "root").collect()}
    assert one == many and len(one) == len({s for s, _ in one})


def test_many_equal_runs_of_neighbouring_slices(spark):
    # rows in which most runs of a slice are those of the slice before, so that intervals tie
    draw = random.Random(9)
    cells, row = [], {x for x in range(300) if draw.random() < 0.5}
    for z in range(12):
        row = row ^ {draw.randrange(300)}
        cells += [(z, y, x) for y in range(3) for x in row]
    grid = voxels(spark, cells)
    for parts in (1, 7):
        found = {}
        for r in unify.double_lines(rle.runs(grid.repartition(parts))).collect():
            found.setdefault((r["slice"], r["row"]), []).append((r["line"], r["x0"], r["x1"]))
        for (z, y), lines in found.items():
            want, covered = [], sorted({x for a, b, x in cells if b == y and a in (z, z - 1)})
            runs = {(x0, x1) for s in (z, z - 1) for x0, x1 in plain_runs({x for a, b, x in cells if (a, b) == (s, y)})}
            for x0, x1 in sorted(runs):
                if want and x0 <= want[-1][1]:
                    want[-1][1] = max(want[-1][1], x1)
                else:
                    want.append([x0, x1])
            assert covered and sorted(lines) == [(k, *w) for k, w in enumerate(want)]
    assert labels_of(pipeline.label_image(grid, strategy="double")) == grids.flood(cells)


def plain_runs(columns):
    return [(x, next(e for e in range(x, 10_000) if e not in columns)) for x in sorted(columns) if x - 1 not in columns]


def test_numbering_over_parts_of_slices(spark, monkeypatch):
    monkeypatch.setattr(rle, "SLICES", 3)
    draw = random.Random(6)
    cells = [(z, y, x) for z in range(20) for y in range(4) for x in range(9) if draw.random() < 0.4]
    found = sorted((r["slice"], r["row"], r["x0"], r["seg_id"]) for r in rle.segments(voxels(spark, cells)).collect())
    assert [f[3] for f in found] == list(range(1, len(found) + 1))


def test_every_cell_of_a_grid(spark):
    cells = [(0, 0, 0), (0, 0, 2), (2, 1, 3), (2, 1, 2), (9, 0, 0), (0, 7, 1)]
    got = {(r["slice"], r["row"], r["col"]): r["val"] for r in pipeline.dense(voxels(spark, cells), Dims(4, 2, 3)).collect()}
    assert got == {(z, y, x): int((z, y, x) in cells) for z in range(3) for y in range(2) for x in range(4)}


def test_an_empty_box_has_no_features(spark):
    found = pipeline.labelled_runs(voxels(spark, [(0, 0, 0), (5, 5, 5)]))
    assert features.in_box(found, (1, 4), (0, 9)).count() == 0 and features.in_box(found, (0, 9), (0, 9), (1, 2)).count() == 1


def test_wide_rows_cross_tiles(spark):
    # runs that span, end at and begin at borders of tiles
    edges = [(0, 0, 600), (0, 1, 255), (1, 255, 258), (1, 511, 512), (2, 100, 700)]
    cells = [(0, y, x) for y, a, b in edges for x in range(a, b)] + [(0, 3, 700), (0, 4, 702)]
    assert labels_of(pipeline.label_image(voxels(spark, sorted(set(cells))))) == grids.flood(sorted(set(cells)))


def test_empty_grid(spark):
    none = voxels(spark, [])
    assert pipeline.component_features(none).count() == 0
    assert volumes.dimensions(none).first().asDict() == {"width": 0, "height": 0, "depth": 0}
    assert unify.statistics(rle.segments(none)).first().asDict() == {"runs": 0, "contacts": 0, "inherits": 0, "unions": 0, "new_labels": 0}
    assert validate.area_has(none.withColumn("label", F.lit(1)), (0, 0, 0), (9, 9, 9), 1).first()["ok"] is True


def test_transpose_keeps_volumes(spark):
    cells = grids.cells_of(grids.HAND_MADE["split"]) + [(5, 1, 3), (5, 2, 4)]
    grid = voxels(spark, cells)
    sizes = lambda v: sorted(r["S"] for r in pipeline.component_features(v).collect())
    assert sizes(grid) == sizes(volumes.transpose(grid))


def test_low_bit_is_foreground(spark):
    dense = spark.createDataFrame([(0, 0, 0, 255), (0, 0, 1, 2), (0, 0, 2, 3), (0, 0, 3, 0)], "slice int, row int, col int, val int")
    assert [r["col"] for r in volumes.foreground(dense).orderBy("col").collect()] == [0, 2]
    assert [(r["edge"], r["er"]) for r in rle.edges(dense).join(rle.relative_labels(dense).select("col", "er"), "col").orderBy("col").collect()] == [(1, 1), (1, 2), (1, 3), (1, 4)]


def test_two_dimensional_bounds(spark):
    found = features.of_runs_2d(pipeline.labelled_runs(voxels(spark, grids.cells_of(grids.HAND_MADE["late_union"]))))
    assert found.first().asDict() == {"slice": 0, "label": 1, "S": 11, "Sx": 22, "Sy": 13, "lo_col": 0, "lo_row": 0, "hi_col": 5, "hi_row": 2}


def test_feature_config_selects_columns(spark):
    grid = voxels(spark, [(0, 0, 0)])
    assert pipeline.component_features(grid, features.FeatureConfig(moments=False, box=False)).columns == ["label", "S"]


def test_merge_normalize_and_equality(spark):
    found = pipeline.component_features(voxels(spark, grids.cells_of(grids.HAND_MADE["gap"]))).cache()
    names = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "src long, dst long")
    assert sorted((r["label"], r["Sx"]) for r in features.normalized(found, names).collect()) == [(10, 0), (20, 0)]
    into = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "label long, into long")
    assert sorted((r["label"], r["S"], r["Sx"]) for r in features.merged(found, into).collect()) == [(1, 2, 3), (3, 2, 2)]
    assert features.equal(found, found).first()["equal"]
    assert features.equal(found, found.where("label < 4")).first().asDict() == {"equal": False, "n_differing": 1}


def test_fill_pad_and_random(spark):
    base = volumes.fill(spark, Dims(3, 2), 1)
    boxed = volumes.fill_box(base, 8, (0, 0, 1), (0, 1, 1))
    assert sorted(r["val"] for r in boxed.collect()) == [1, 1, 1, 1, 8, 8]
    padded = volumes.pad(base, Dims(3, 2), 1)
    assert padded.count() == 5 * 4 and padded.agg(F.sum("val")).first()[0] == 6
    bits = volumes.random_bits(spark, Dims(64, 64), 3, 0.3)
    assert abs(bits.agg(F.avg("val")).first()[0] - 0.3) < 0.05
    assert bits.exceptAll(volumes.random_bits(spark, Dims(64, 64), 3, 0.3)).isEmpty()


def test_scalars(spark):
    n = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 1), (5, 2), (9, 2), (10, 3), (16, 3), (17, 4)], "n long, r long")
    assert n.where(scalars.isqrt_below(F.col("n")) != F.col("r")).isEmpty()
    large = [2**62, 3037000499**2, 3037000499**2 + 1, 94906267**2, 94906267**2 + 1, 2**53 + 1, 2**63 - 1]
    roots = {r["n"]: r["r"] for r in spark.createDataFrame([(x,) for x in large], "n long").select("n", scalars.isqrt_below(F.col("n")).alias("r")).collect()}
    assert roots == {x: math.isqrt(x - 1) for x in large}
    row = spark.range(1)
    least = lambda *v: row.select(scalars.least_positive(*map(F.lit, v)).alias("m")).first()["m"]
    assert (least(3, 0, 2, 5), least(0, 0, 0, 0), least(0, 7, 0, 0)) == (2, 0, 7)
    ups = [row.select(scalars.round_up(F.lit(a), F.lit(64)).alias("u")).first()["u"] for a in (1, 64, 65)]
    assert ups == [64, 64, 128]
    assert row.select(scalars.round_up(F.lit(2**60 + 1), F.lit(64)).alias("u")).first()["u"] == 2**60 + 64
    pairs = spark.createDataFrame([(0, 0.1, 0.9), (1, 0.5, 0.5), (2, 0.6, 0.5)], "pos int, threshold double, density double")
    assert scalars.closest(pairs, "threshold", F.abs(F.col("density") - 0.5), "pos").first()[0] == 0.5
    assert scalars.closest(pairs.limit(0), "threshold", F.abs(F.col("density") - 0.5), "pos").first()[0] is None
    assert row.select(scalars.dot(F.expr("array(1L,2L)"), F.expr("array(3L,4L)")).alias("d")).first()["d"] == 11


def test_differences_of_images(spark):
    a = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 1, 2)], "slice int, row int, col int, label long")
    b = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 2, 2)], "slice int, row int, col int, label long")
    assert sorted((r["col"], r["left"], r["right"]) for r in validate.differences(a, b).collect()) == [(1, 2, None), (2, None, 2)]
    assert validate.compared(a, a).first()["equal"] and not validate.compared(a, b).first()["equal"]
    assert relabel.rendered(a).first()["line"] == " 1  2"
    assert {r["label"]: r["n"] for r in relabel.histogram(a.where("label = 2"), Dims(2, 1)).collect()} == {0: 1, 1: 0, 2: 1}


def plain_roots(pairs):
    """For each vertex, the least that it is joined to: a flood over neighbours."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = {}
    for start in sorted(near):
        stack = [start]
        while stack:
            v = stack.pop()
            if v not in out:
                out[v] = start
                stack += near[v]
    return out


def connected_of(spark, pairs, finish, rounds=None):
    import pandas as pd

    edges = spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b"]))
    return {r["v"]: r["root"] for r in components.connected(edges, finish, rounds).collect()}


@pytest.mark.parametrize(("length", "most"), [(300, 20), (3000, 25), (100_000, 40)])
def test_chains_in_random_order_settle(spark, length, most):
    names = list(range(1, length + 1))
    random.Random(length).shuffle(names)
    rounds = []
    found = connected_of(spark, list(zip(names, names[1:])), max(4, length // 1000), rounds)
    assert found == dict.fromkeys(names, 1)
    print(length, rounds)
    assert 0 < len(rounds) <= most


@pytest.mark.parametrize("finish", [0, 5, 10_000])
def test_components_of_odd_graphs(spark, finish):
    draw = random.Random(7)
    two_minima = [(1, 50), (50, 51), (51, 52), (52, 53), (53, 2)]
    star = [(500, x) for x in range(501, 700)] + [(x, 499) for x in range(700, 720)]
    ascending = [(x, x + 1) for x in range(1000, 1100)]
    alone = [(2000 + 2 * x, 2001 + 2 * x) for x in range(40)]
    scattered = [(draw.randrange(3000, 3300), draw.randrange(3000, 3300)) for _ in range(160)]
    pairs = two_minima + star + ascending + alone + scattered + two_minima
    pairs = [(a, b) if draw.random() < 0.5 else (b, a) for a, b in pairs]
    found = connected_of(spark, pairs, finish)
    assert found == plain_roots([(a, b) for a, b in pairs if a != b])


def test_components_of_no_edges(spark):
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components.connected(spark.createDataFrame([(3, 3)], "a long, b long"), 0).count() == 0


def test_a_long_grid_of_small_blocks(spark):
    # a U of 200 slices: both arms begin in the first slice and meet in the last; a block holds one slice
    cells = [(z, 0, x) for z in range(200) for x in (0, 4)] + [(199, 0, x) for x in range(5)]
    seg = rle.segments(voxels(spark, sorted(set(cells))))
    rounds = []
    links = unify.contacts(seg)
    found = components.roots(seg.select("seg_id"), links, block=2, finish=8, rounds=rounds).collect()
    assert {r["root"] for r in found} == {1} and len(found) == 399
    assert 0 < len(rounds) <= 20


def test_runs_and_gaps_keep_nothing_in_memory(spark):
    draw = random.Random(21)
    cells = sorted({(draw.randrange(3), draw.randrange(4), draw.randrange(30)) for _ in range(200)})
    grid = voxels(spark, cells + cells[::3])
    rows, expected = rle.runs(grid), []
    for z, y, x in cells:
        if expected and expected[-1][:2] == [z, y] and expected[-1][3] == x:
            expected[-1][3] = x + 1
        else:
            expected.append([z, y, x, x + 1])
    key = lambda df: sorted(list(r) for r in df.select("slice", "row", "x0", "x1").collect())
    assert key(rows) == expected
    filled = {(z, y, x) for z, y in {c[:2] for c in cells} for x in range(32)} - set(cells)
    assert {(z, y, x) for z, y, a, b in key(rle.gaps(rows, 32)) for x in range(a, b)} == filled
    plan = rle.gaps(rows, 32)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Union" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_double_links_join_lines_only(spark):
    seg = rle.segments(voxels(spark, [(z, y, x) for z in range(3) for y in range(3) for x in range(0, 9, 2)]))
    seg = spark.createDataFrame(seg.collect(), seg.schema)
    links = unify.double_links(seg)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_strategies_share_segments(spark):
    cells = [(z, y, x) for z in range(4) for y in range(5) for x in range(11) if (z * 7 + y * 5 + x * 3) % 4 == 0]
    grid = voxels(spark, cells + cells)
    seg = rle.segments(grid)
    seg = spark.createDataFrame(seg.collect(), seg.schema)
    for strategy in ("band", "double", "position"):
        assert labels_of(relabel.label_cells(pipeline.labelled_segments(seg, strategy, Dims(11, 5, 4)))) == grids.flood(cells)


def test_a_dense_grid_is_dealt_by_its_cells(spark):
    one = spark.createDataFrame([(0, 0, 3, 5)], "slice int, row int, x0 int, x1 int")
    found = rle.every_cell(one, Dims(4096, 4096), F.lit(1), F.lit(0))
    assert found.rdd.getNumPartitions() == 16
