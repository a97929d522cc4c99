"""From voxels to labels and features, by the strategy asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runfield.operators import bitrows, components, features, relabel, rle, unify
from runfield.sources.shared import written
from runfield.sources.volumes import Dims

STRATEGIES = ("band", "position", "double", "slab", "packed")


def dense(voxels: DataFrame, dims: Dims) -> DataFrame:
    """Every cell with val 0 or 1."""
    return _dense(rle.runs(voxels), dims)


def _dense(seg: DataFrame, dims: Dims) -> DataFrame:
    return rle.every_cell(seg, dims, F.lit(1), F.lit(0)).withColumnRenamed("value", "val")


def labelled_runs(voxels: DataFrame, strategy: str = "band", dims: Dims | None = None, slices: int = 8) -> DataFrame:
    """Runs with root and label. All strategies give the same labels.

    band: contacts by interval joins. position: by look-ups in the dense image (needs ``dims``). double: by double lines.
    slab: band contacts, first inside slabs of ``slices`` slices, then between them. packed: band contacts of runs that come
    from words of 64 cells, which suits grids of which much is set.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; one of {', '.join(STRATEGIES)}")
    found = bitrows.runs(bitrows.packed(voxels)) if strategy == "packed" else rle.runs(voxels)
    return labelled_segments(written(rle.numbered_runs(found), "segments"), strategy, dims, slices)


def labelled_segments(seg: DataFrame, strategy: str = "band", dims: Dims | None = None, slices: int = 8) -> DataFrame:
    """``labelled_runs`` of segments, as ``rle.segments`` gives them; they are read several times."""
    if strategy == "position":
        if dims is None:
            raise ValueError("the position strategy needs the grid's dims")
        links = unify.contacts_by_position(seg, rle.relative_labels(_dense(seg, dims)))
    elif strategy == "double":
        links = unify.double_links(seg)
    elif strategy in ("band", "packed"):
        links = unify.contacts(seg)
    if strategy == "slab":
        rooted = components.reduced(*components.slab_labels(seg, slices))
    else:
        rooted = components.roots(seg.select("seg_id"), links)
    return components.labelled(seg, rooted)


def label_image(voxels: DataFrame, **options) -> DataFrame:
    """slice, row, col, label of every foreground cell."""
    return relabel.label_cells(labelled_runs(voxels, **options))


def component_features(voxels: DataFrame, config: features.FeatureConfig = features.FeatureConfig(), **options) -> DataFrame:
    """One row of features for each component; no label image is made."""
    return features.of_runs(labelled_runs(voxels, **options), config)
