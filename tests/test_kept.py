"""Grids that are stored, packed, streamed, grown by slabs or asked by many boxes, against the plain operators and brute force."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from runfield.operators import bitrows, boxes, components, features, relabel, rle, sweep, unify, validate
from runfield.operators.stored import StoredRuns
from runfield.plans import pipeline
from runfield.plans.growing import GrowingVolume
from runfield.sources import raw
from runfield.sources.shared import new_path, removed, written
from runfield.sources.volumes import Dims
from runfield.streaming import rows as arriving
from tests import grids
from tests.test_grids import labels_of, voxels


def drawn(seed, slices, rows, cols, density):
    draw = random.Random(seed)
    return [(z, y, x) for z in range(slices) for y in range(rows) for x in range(cols) if draw.random() < density]


def feature_rows(df):
    return {r["label"]: tuple(r[c] for c in features.FeatureConfig().columns) for r in df.collect()}


# Bit-packed rows


def test_packed_runs_equal_runs(spark):
    draw = random.Random(2)
    cells = set(drawn(1, 2, 6, 300, 0.5))
    # runs that fill words, end at their ends, begin at their starts, and words that are missing in between
    cells |= {(5, 0, x) for x in range(64)} | {(5, 1, x) for x in range(64, 192)} | {(5, 2, x) for x in (63, 64, 127, 128, 255)}
    cells |= {(5, 3, x) for x in range(10, 500)} | {(5, 4, x) for x in (*range(60, 64), *range(128, 130))} | {(6, draw.randrange(3), draw.randrange(10_000)) for _ in range(80)}
    grid = voxels(spark, sorted(cells))
    words = bitrows.packed(grid.unionAll(grid))
    assert words.count() == len({(z, y, x // 64) for z, y, x in cells})
    of = lambda df: sorted(tuple(r) for r in df.select("slice", "row", "x0", "x1").collect())
    assert of(bitrows.runs(words)) == of(rle.runs(grid))
    counts = lambda df: sorted(tuple(r) for r in df.collect())
    assert counts(bitrows.volumes(words)) == counts(rle.foreground_counts(rle.runs(grid)))
    assert sorted(tuple(r) for r in bitrows.unpacked(words).collect()) == sorted(cells)
    assert bitrows.runs(bitrows.packed(voxels(spark, []))).count() == 0


def test_packed_grids_combine(spark):
    a, b = set(drawn(3, 2, 3, 100, 0.3)), set(drawn(4, 2, 3, 100, 0.3)) | {(9, 9, 9)}
    p, q = (bitrows.packed(voxels(spark, sorted(c))) for c in (a, b))
    for how, expected in (("or", a | b), ("and", a & b), ("xor", a ^ b)):
        assert {tuple(r) for r in bitrows.unpacked(bitrows.combined(p, q, how)).collect()} == expected


# Stored runs


def test_stored_contacts_shuffle_nothing(spark):
    seg = written(rle.segments(voxels(spark, drawn(5, 5, 8, 600, 0.3))), "segments")
    stored = StoredRuns.store(seg, buckets=4)
    met = stored.contacts()
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
    of = lambda df: sorted(tuple(r) for r in df.collect())
    assert of(met) == of(unify.contacts(seg))
    some = (unify.ABOVE, unify.BACK_BELOW)
    assert of(stored.contacts(some)) == of(unify.contacts(seg, some))
    stored.drop()
    with pytest.raises(ValueError):
        StoredRuns.store(seg, name="a b")


def test_position_contacts_over_tiles(spark, monkeypatch):
    monkeypatch.setattr(unify, "CELLS", 16)
    cells = sorted({*drawn(6, 3, 4, 64, 0.4), *((1, 1, x) for x in range(5, 60)), *((0, 1, x) for x in (15, 16, 31, 32, 63))})
    found = labels_of(pipeline.label_image(voxels(spark, cells), strategy="position", dims=Dims(64, 4, 3)))
    assert found == grids.flood(cells)


# Growing volumes


def grown(spark, cells, slices, depth):
    volume = GrowingVolume(spark, new_path(spark, "growing"), slices)
    for slab in range(-(-depth // slices)):
        volume.add(slab, voxels(spark, [c for c in cells if c[0] // slices == slab]))
    return volume


@pytest.mark.parametrize(("density", "slices"), [(0.08, 2), (0.25, 1)])
def test_slabs_added_one_by_one(spark, density, slices):
    cells = drawn(int(density * 100), 6, 7, 11, density)
    volume = grown(spark, cells, slices, 6)
    expected = grids.flood(cells)
    assert feature_rows(volume.features()) == grids.features(expected)
    runs = volume.labelled_runs().withColumnRenamed("root", "label")
    parts = {}
    for cell, root in labels_of(relabel.label_cells(runs)).items():
        parts.setdefault(root, set()).add(expected[cell])
    assert all(len(p) == 1 for p in parts.values()) and len(parts) == len(set(expected.values()))


def test_only_slabs_that_change_are_written_anew(spark):
    # two arms that meet in the last slab; a block of its own in slabs 0 and 1, and one that ends before the arms begin
    arms = [(z, y, 0) for z in range(4, 10) for y in (0, 6)] + [(9, y, 0) for y in range(7)]
    cells = sorted({*arms, *((z, 20, 3) for z in range(3))})
    volume = GrowingVolume(spark, new_path(spark, "growing"), 2)
    files = lambda name: {f.rsplit("/", 2)[-2] + "/" + f.rsplit("/", 1)[-1] for f in volume.read(name).inputFiles()}
    for slab in range(4):
        volume.add(slab, voxels(spark, [c for c in cells if c[0] // 2 == slab]))
    names, parts = files("names"), files("parts")
    volume.add(4, voxels(spark, [c for c in cells if c[0] // 2 == 4]))
    gone = {f.split("/")[0] for f in names - files("names")}
    assert gone == {"slab=2", "slab=3"} and parts < files("parts")
    assert feature_rows(volume.features()) == grids.features(grids.flood(cells))
    with pytest.raises(ValueError, match="after slab"):
        volume.add(3, voxels(spark, [(6, 0, 0)]))
    with pytest.raises(ValueError, match="outside"):
        volume.add(5, voxels(spark, [(2, 0, 0)]))
    # the last slab once more, as after a lost writer
    volume.add(4, voxels(spark, [c for c in cells if c[0] // 2 == 4]))
    assert feature_rows(volume.features()) == grids.features(grids.flood(cells))


def test_slabs_without_cells(spark):
    cells = [(0, 0, 0), (5, 0, 0), (6, 1, 1)]
    assert feature_rows(grown(spark, cells, 2, 8).features()) == grids.features(grids.flood(cells))


def test_runs_of_a_slab_mark_the_first_of_each_component(spark):
    cells = drawn(12, 4, 7, 11, 0.2)
    runs = grown(spark, cells, 2, 4).read("runs").collect()
    first = {}
    for r in runs:
        first.setdefault(r["comp"], []).append((r["slice"], r["row"], r["x0"]))
    assert sorted((r["comp"], r["slice"], r["row"], r["x0"]) for r in runs if r["first"]) == sorted((c, *min(p)) for c, p in first.items())


def test_edges_between_blocks_are_broadcast_to_the_roots(spark, monkeypatch):
    plans = {}

    def spied(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return written(df, name)

    monkeypatch.setattr(components, "written", spied)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    try:
        # two chains over two blocks, whose roots take more than what is broadcast
        vertices = spark.range(1, 40_001).select(F.col("id").alias("seg_id"), F.lit(7).alias("kept"))
        chains = spark.range(1, 39_999).select(F.col("id").alias("a"), (F.col("id") + 2).alias("b"))
        found = components.roots(vertices, chains, block=20_000)
        assert found.groupBy("root", "kept").count().orderBy("root").collect() == [(1, 7, 20_000), (2, 7, 20_000)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans["block-edges"]


# Rows that arrive


def plain_stream(cells, slices, batches, rows):
    """What ``_Slab`` gives out for batches of rows, as one list of frames."""
    own = {}
    for z, y, x in cells:
        for slab in {z // slices, (z - 1) // slices if z and z % slices == 0 else z // slices}:
            own.setdefault(slab, []).append((z, y, x))
    out = []
    for slab, held in sorted(own.items()):
        state = arriving._Slab(slab, slices)
        for low, high in batches:
            part = [c for c in held if low <= c[1] < high]
            random.Random(len(part)).shuffle(part)
            state.take(np.array(part, np.int64).reshape(-1, 3))
        state.take(np.array([(0, rows + 1, -1)], np.int64))
        assert not len(state.opened) and not len(state.waiting)
        out += [arriving._completed(f) for f in state.out]
    return out


@pytest.mark.parametrize(("density", "slices", "batches"), [(0.1, 4, [(0, 12)]), (0.3, 2, [(0, 3), (3, 4), (4, 12)]), (0.2, 1, [(k, k + 1) for k in range(12)])])
def test_rows_in_order_give_the_features_of_the_whole(spark, density, slices, batches):
    import pandas as pd

    cells = drawn(int(density * 1000), 7, 12, 9, density)
    given = spark.createDataFrame(pd.concat(plain_stream(cells, slices, batches, 12)).astype(object).where(lambda f: f.notna(), None), arriving.OUTPUT)
    assert given.where("kind = 'late'").isEmpty()
    assert feature_rows(arriving.features_of(given)) == grids.features(grids.flood(cells))


def test_state_does_not_grow_with_rows():
    state = arriving._Slab(0, 8)
    sizes = []
    for y in range(200):
        state.take(np.array([(z, y, x) for z in range(8) for x in range(0, 20, 3 if y % 2 else 2)], np.int64))
        sizes.append(len(state.held) + len(state.opened) + len(state.waiting))
    assert max(sizes[100:]) <= max(sizes[:20])


def test_rows_of_a_batch_are_completed_at_once(monkeypatch):
    calls = []
    least = components._least
    monkeypatch.setattr(components, "_least", lambda a, b: calls.append(len(a)) or least(a, b))
    state = arriving._Slab(1, 8)
    state.take(np.array([(z, y, x) for z in range(8, 17) for y in range(200) if y % 7 for x in range(y % 3, 20, 3)], np.int64))
    assert len(calls) == 1 and len(state.out) <= 5


def test_batches_cut_anywhere_give_the_same(spark):
    import pandas as pd

    cells = drawn(77, 7, 40, 9, 0.12)
    cells += [(z, y + 90, x) for z, y, x in cells[::2]] + cells[::3]
    expected = grids.features(grids.flood(sorted(set(cells))))
    for batches in ([(0, 140)], [(0, 1), (1, 39), (39, 95), (95, 140)], [(k, k + 3) for k in range(0, 140, 3)]):
        given = spark.createDataFrame(pd.concat(plain_stream(cells, 3, batches, 140)).astype(object).where(lambda f: f.notna(), None), arriving.OUTPUT)
        assert given.where("kind = 'late'").isEmpty()
        assert feature_rows(arriving.features_of(given)) == expected


def test_state_partitions_follow_the_cores(spark):
    cells = arriving.dealt(voxels(spark, drawn(5, 6, 9, 8, 0.25)), 3)
    source, sink, state = (new_path(spark, k) for k in ("source", "sink", "state"))
    cells.unionByName(arriving.endings(cells, 10)).write.parquet(source)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "24")
    try:
        arriving.advanced(spark, source, sink, state, 3)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    stores = [n for n in os.listdir(state.removeprefix("file://") + "/state/0") if n.isdigit()]
    assert 0 < len(stores) <= 2 * spark.sparkContext.defaultParallelism


def test_late_cells_are_told():
    state = arriving._Slab(0, 8)
    state.take(np.array([(0, 0, 0), (0, 3, 1)], np.int64))
    state.take(np.array([(1, 1, 5), (0, 3, 2), (0, 4, 2)], np.int64))
    late = [f for f in state.out if (f["kind"] == "late").all()]
    assert [tuple(r) for f in late for r in f[["slice", "row", "x0"]].itertuples(index=False)] == [(1, 1, 5)]
    assert state.held[:, :3].tolist() == [[0, 1, 3]]


def test_a_stream_that_is_taken_up_again(spark):
    cells = drawn(31, 6, 9, 8, 0.25)
    dealt = arriving.dealt(voxels(spark, cells), 3)
    source, sink, state = (new_path(spark, k) for k in ("source", "sink", "state"))
    for low, high in ((0, 4), (4, 5), (5, 9)):
        part = dealt.where(F.col("row").between(low, high - 1))
        part = part if high < 9 else part.unionByName(arriving.endings(dealt, 10))
        part.write.mode("append").parquet(source)
        arriving.advanced(spark, source, sink, state, 3)
    given = spark.read.schema(arriving.OUTPUT).parquet(sink)
    assert feature_rows(arriving.features_of(given)) == grids.features(grids.flood(cells))


# Raw volumes


def test_a_raw_volume_by_stripes(spark):
    dims = Dims(13, 7, 5)
    draw = random.Random(8)
    cells = [(z, y, x, draw.choice([1, 255, 256, 7])) for z, y, x in drawn(9, 5, 7, 13, 0.2) if z != 2]
    path = new_path(spark, "raw").removeprefix("file://")
    raw.write_volume(spark.createDataFrame(cells, "slice int, row int, col int, val int"), path, dims, stripe=3)
    expected = {(z, y, x): 0 for z in range(5) for y in range(7) for x in range(13)} | {c[:3]: c[3] & 255 for c in cells}
    found = lambda back: {(r["slice"], r["row"], r["col"]): r["val"] for r in back.collect()}
    for rows in (0, 1, 2, 3, 50):
        assert found(raw.read_volume(spark, path, rows)) == expected
    assert raw.read_volume(spark, path, 4).rdd.getNumPartitions() > 5
    # groups of two stripes, one file each; a task for each group, stored or not, but none for each stripe
    for file, groups in ((13 * 3 * 2, 6), (1, 12), (1 << 20, 1)):
        path = new_path(spark, "raw").removeprefix("file://")
        raw.write_volume(spark.createDataFrame(cells, "slice int, row int, col int, val int"), path, dims, stripe=3, file=file)
        assert raw.read_volume(spark, path).rdd.getNumPartitions() == groups
        for rows in (0, 2, 4):
            assert found(raw.read_volume(spark, path, rows)) == expected
        assert len([n for n in os.listdir(path) if n.endswith(".raw")]) <= groups
    # one file, as another program would write it
    whole = os.path.join(path, "..", "whole.bin")
    with open(whole, "wb") as f:
        f.write(bytes(expected[k] for k in sorted(expected)))
    back = raw.read_volume(spark, whole, 2, dims)
    assert {(r["slice"], r["row"], r["col"]): r["val"] for r in back.collect()} == expected


def test_raw_volumes_that_cannot_be(spark):
    path = new_path(spark, "raw")
    with pytest.raises(Exception, match="outside"):
        raw.write_volume(spark.createDataFrame([(0, 0, 9, 1)], "slice int, row int, col int, val int"), path, Dims(3, 3))
    with pytest.raises(Exception, match="(?i)not ?found"):
        raw.read_volume(spark, path + "-none", dims=Dims(1, 1)).count()
    raw.write_volume(spark.createDataFrame([], "slice int, row int, col int, val int"), path, Dims(3, 2))
    assert raw.read_volume(spark, path).agg(F.count("*"), F.sum("val")).first() == (6, 0)


# Many boxes


def test_boxes_against_one_by_one(spark):
    cells = drawn(12, 40, 40, 6, 0.06)
    labelled = written(pipeline.labelled_runs(voxels(spark, cells)), "labelled")
    draw = random.Random(13)
    asked = []
    for k in range(40):
        z, y = draw.randrange(-3, 45), draw.randrange(-3, 45)
        asked.append((k, z, z + draw.choice([0, 1, 5, 39]), y, y + draw.choice([-1, 0, 3, 17, 60]), 0, draw.randrange(6), 1))
    table = spark.createDataFrame(asked, "box long, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, expected long")
    got = {(r["box"], r["label"]): tuple(r[c] for c in features.FeatureConfig().columns) for r in boxes.in_boxes(labelled, table).collect()}
    runs, expected, ok = labelled.collect(), {}, {}
    for k, z0, z1, y0, y1, x0, x1, label in asked:
        inside = [r for r in runs if z0 <= r["slice"] <= z1 and y0 <= r["row"] <= y1]
        seen = {(r["slice"], r["row"], x): r["label"] for r in inside for x in range(r["x0"], r["x1"])}
        expected |= {(k, n): f for n, f in grids.features(seen).items()}
        ok[k] = all(n == label for (z, y, x), n in seen.items() if x0 <= x <= x1)
    assert got == expected
    assert {r["box"]: r["ok"] for r in boxes.areas_have(labelled, table).collect()} == ok


def small_boxes(spark):
    draw = random.Random(14)
    cells = drawn(13, 20, 30, 6, 0.15)
    asked = [(k, z, z + draw.randrange(7), y, y + draw.choice([0, 3, 8, 25]), 0, draw.randrange(6), draw.randrange(1, 4)) for k in range(30) for z, y in [(draw.randrange(18), draw.randrange(28))]]
    return written(pipeline.labelled_runs(voxels(spark, cells)), "labelled"), asked, "box long, z0 int, z1 int, y0 int, y1 int, x0 int, x1 int, expected long"


def test_small_boxes_are_added_up_where_they_meet_runs(spark):
    labelled, asked, schema = small_boxes(spark)
    found = boxes.in_boxes(labelled, spark.createDataFrame(asked, schema))
    assert "hashpartitioning(box" not in found._jdf.queryExecution().executedPlan().toString()
    # the same rows where regions are so small that most boxes are large ones
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(found) == key(boxes.in_boxes(labelled, spark.createDataFrame(asked, schema), regions=((1, 1),))) != []
    # boxes of one name, of whatever sizes and places, are one
    names = [(k // 2 if k < 10 else k, *rest) for k, *rest in asked]
    folded = features.folded(found.withColumn("box", F.expr("if(box < 10, box div 2, box)")), ["box", "label"])
    assert key(boxes.in_boxes(labelled, spark.createDataFrame(names, schema))) == key(folded)


def test_areas_answer_each_row_by_regions(spark):
    labelled, asked, schema = small_boxes(spark)
    table = spark.createDataFrame([*asked, (99, 0, 0, 90, 95, 0, 5, 1)], schema)
    found = boxes.areas_have(labelled, table)
    assert "hashpartitioning(box" not in found._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted(map(tuple, df.collect()))
    by_name = key(found)
    assert by_name == key(boxes.areas_have(labelled, table, regions=((1, 1),))) and len({ok for _, ok in by_name}) == 2
    one = key(boxes.areas_have(labelled, table.withColumn("box", F.lit(7))))
    assert one == sorted((7, ok) for _, ok in by_name)


def test_tiles_of_a_box_are_its_rows_once(spark):
    table = spark.createDataFrame([(1, 3, 37, 2, 90), (2, 5, 5, 7, 7), (3, 16, 31, 16, 31), (4, 0, 3, 1, 2)], "box long, z0 int, z1 int, y0 int, y1 int")
    seen = {}
    for r in boxes.tiles(table).collect():
        s = r["size"]
        for z in range(r["tz"] * s, r["tz"] * s + s):
            for y in range(r["ty"] * s, r["ty"] * s + s):
                assert seen.setdefault((r["box"], z, y), 0) == 0
                seen[r["box"], z, y] = 1
    assert set(seen) == {(b, z, y) for b, z0, z1, y0, y1 in table.collect() for z in range(z0, z1 + 1) for y in range(y0, y1 + 1)}
    assert boxes.tiles(table.where("box = 3")).count() == 1


# Thresholds and digests


def test_thresholds(spark):
    draw = random.Random(14)
    rows = [(draw.choice("ab"), draw.choice([None, -3.0, 0.0, 5.0, 12.5, 500.0, float("nan"), draw.uniform(0, 60)])) for _ in range(300)]
    table = spark.createDataFrame(rows, "k string, v double")
    got = {(r["k"], r["threshold"]): r["density"] for r in sweep.of_steps(table, "k", "v", 5, 12).collect()}
    for k in "ab":
        values = [v for c, v in rows if c == k]
        for t in range(0, 60, 5):
            assert got[k, t] == sum(v is not None and (v > t or v != v) for v in values) / len(values)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    found = sweep.of_values(table.where("not isnan(v)"), "k", "v").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for k in "ab":
        values = [v for c, v in rows if c == k and v is not None and v == v]
        assert {r["threshold"]: r["density"] for r in found if r["k"] == k} == {t: sum(v > t for v in values) / len(values) for t in set(values)}


def test_one_changed_cell_joins_one_tile(spark):
    cells = written(relabel.label_cells(pipeline.labelled_runs(voxels(spark, drawn(15, 9, 40, 70, 0.1)))), "cells")
    one = cells.orderBy("slice", "row", "col").first()
    same = (F.col("slice") == one["slice"]) & (F.col("row") == one["row"]) & (F.col("col") == one["col"])
    other = cells.withColumn("label", F.when(same, 999).otherwise(F.col("label")))
    assert validate.differing_tiles(cells, other, 8).count() == 1 and validate.differing_tiles(cells, cells.repartition(3), 8).isEmpty()
    assert [tuple(r) for r in validate.differences_by_tiles(cells, other, 8).collect()] == [(one["slice"], one["row"], one["col"], one["label"], 999)]
    fewer = cells.where("col < 60")
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(validate.differences_by_tiles(cells, fewer, 8)) == key(validate.differences(cells, fewer))


def test_removed_tables_are_gone(spark):
    table = written(spark.range(5), "short-lived")
    files = table.inputFiles()
    removed(table)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


# Measurements


def test_stages_are_measured(spark):
    from runfield.plans.measures import Sampler, measured

    cells = drawn(16, 6, 20, 40, 0.1)
    stages = measured(voxels(spark, cells))
    expected = grids.flood(cells)
    assert list(stages) == ["encode", "contacts", "components", "labels", "relabel", "features"]
    assert stages["encode"].counts["cells"] == stages["relabel"].counts["cells"] == len(cells)
    assert stages["components"].counts["components"] == stages["features"].counts["components"] == len(set(expected.values()))
    assert stages["contacts"].counts["contacts"] == unify.contacts(rle.segments(voxels(spark, cells))).count()
    assert all(s.seconds > 0 and s.rate(next(iter(s.counts))) > 0 for s in stages.values()) and stages["components"].rounds == []
    assert stages["encode"].shuffle_bytes > 0 and stages["relabel"].shuffle_bytes == 0
    sampler = Sampler(spark)
    with sampler.stage("none") as s:
        assert sampler.kept(s, voxels(spark, []), cells=F.count(F.lit(1)), reach=F.max("col")).count() == 0
    assert sampler.stages["none"].counts == {"cells": 0, "reach": 0}
