"""Connected patches of grid cells, and how floods expand between two maps.

Cells are labelled inside tiles first; patches of neighbouring tiles that meet
across a border are edges of a small graph, whose components join them up. A
task holds one tile, and only cells on borders are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.operators.graph import components, cut


def tile_labels(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each cell of one tile the place in ``i`` and ``j`` of the first cell, by row then column, of its patch; cells meet at their sides."""
    order = np.lexsort((j, i))
    at = {(int(i[k]), int(j[k])): int(k) for k in order}
    label = np.full(len(i), -1)
    for k in order:
        if label[k] >= 0:
            continue
        label[k], open_ = k, [int(k)]
        while open_:
            m = open_.pop()
            for di, dj in ((1, 0), (-1, 0), (0, 1), (0, -1)):
                n = at.get((int(i[m]) + di, int(j[m]) + dj))
                if n is not None and label[n] < 0:
                    label[n] = k
                    open_.append(n)
    return label


def label_cells(cells: DataFrame, keys: Sequence[str], i: str, j: str, tile: int = 64) -> DataFrame:
    """(keys, i, j, label_i, label_j): each distinct cell with the first cell, by row then column, of its patch.

    Cells of a map touch at their sides; ``keys`` name the map. A cell with a
    null index or key belongs to no map and is left out.
    """
    own = cells.dropna(subset=[*keys, i, j]).select(*keys, F.col(i).cast("long").alias("i"), F.col(j).cast("long").alias("j")).distinct()
    own = own.withColumns({"ti": F.floor(F.col("i") / tile), "tj": F.floor(F.col("j") / tile)})

    def label(rows: pd.DataFrame) -> pd.DataFrame:
        first = tile_labels(rows["i"].to_numpy(), rows["j"].to_numpy())
        return rows.assign(li=rows["i"].to_numpy()[first], lj=rows["j"].to_numpy()[first])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields) + ", li long, lj long"
    labelled = cut(own.groupBy(*keys, "ti", "tj").applyInPandas(label, schema))
    node = F.struct(*keys, "li", "lj")
    met = None
    for step_i, step_j, edge in ((1, 0, F.pmod("i", F.lit(tile))), (0, 1, F.pmod("j", F.lit(tile)))):
        last = labelled.where(edge == tile - 1).select(*keys, (F.col("i") + step_i).alias("i"), (F.col("j") + step_j).alias("j"), node.alias("a"))
        across = last.join(labelled.where(edge == 0).select(*keys, "i", "j", node.alias("b")), [*keys, "i", "j"]).select("a", "b").distinct()
        met = across if met is None else met.union(across)
    joined = components(met).select(*[F.col(f"node.{c}").alias(c) for c in [*keys, "li", "lj"]], F.col("label.li").alias("to_i"), F.col("label.lj").alias("to_j"))
    out = labelled.join(joined, [*keys, "li", "lj"], "left")
    return out.select(*keys, F.col("i").alias(i), F.col("j").alias(j), F.coalesce("to_i", "li").alias("label_i"), F.coalesce("to_j", "lj").alias("label_j"))


def patch_sizes(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per map: the number of patches and the share of its cells in the largest."""
    sizes = labelled.groupBy(*keys, "label_i", "label_j").agg(F.count("*").alias("c"))
    return sizes.groupBy(*keys).agg(F.count("*").alias("n_patches"), (F.max("c") / F.sum("c")).alias("largest_share"))


def expansion(cells: DataFrame, keys: Sequence[str], i: str, j: str, wet0: Column, wet1: Column, least: int = 10, tile: int = 64) -> DataFrame:
    """Per map: patches of newly wet cells (dry, then wet), the largest one's share of them, and the shift of the wet cells' centre.

    Null states are unknown: such a cell is neither newly wet nor part of a
    centre. A centre of fewer than ``least`` wet cells is unknown, and so is
    the shift then. A map without newly wet cells has 0 patches and no share.
    """
    known = cells.select(*keys, i, j, wet0.alias("wet0"), wet1.alias("wet1"))
    both = F.col("wet0").isNotNull() & F.col("wet1").isNotNull()
    centre = lambda c, wet: F.when(F.count_if(both & F.col(wet)) >= least, F.avg(F.when(both & F.col(wet), F.col(c))))
    shift = F.hypot(centre(i, "wet1") - centre(i, "wet0"), centre(j, "wet1") - centre(j, "wet0"))
    maps = known.groupBy(*keys).agg(F.count_if(~F.col("wet0") & F.col("wet1")).alias("n_new"), F.round(shift, 6).alias("centre_shift"))
    sizes = patch_sizes(label_cells(known.where(~F.col("wet0") & F.col("wet1")), keys, i, j, tile), keys)
    out = maps.join(sizes, list(keys), "left")
    return out.select(*keys, "n_new", F.coalesce("n_patches", F.lit(0)).alias("n_patches"), F.round("largest_share", 6).alias("largest_share"), "centre_shift")
