"""Joins of boxes on one page. Each rides on an equality of page and grid cell, never on a cross product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Side of the cells that a box is dealt to; a join meets only boxes that share a cell.
CELL = 128
ASSIGNED = 0.5


def _celled(boxes: DataFrame, prefix: str, cell: int) -> DataFrame:
    """Each box once for every cell that it touches."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(f"{prefix}{lo}") / cell), F.floor(F.greatest(F.col(f"{prefix}{lo}"), F.col(f"{prefix}{hi}")) / cell))
    return boxes.withColumn("__cx", F.explode(span("x0", "x1"))).withColumn("__cy", F.explode(span("y0", "y1")))


def meet(left: DataFrame, right: DataFrame, on: Column, keys: list[str] | None = None, cell: int = CELL) -> DataFrame:
    """Pairs on a page for which ``on`` holds, each pair once.

    Columns of ``left`` are prefixed l_, of ``right`` r_. ``on`` must imply that the boxes touch, for pairs are met in
    the cell that holds the top left corner of their intersection.
    """
    l = _celled(left.select(*[F.col(c).alias(f"l_{c}") for c in left.columns]), "l_", cell)
    r = _celled(right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]), "r_", cell)
    keys = keys or ["page"]
    same = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    l = l.withColumnsRenamed({"__cx": "__lx", "__cy": "__ly"})
    first = (F.col("__lx") == F.floor(F.greatest("l_x0", "r_x0") / cell)) & (F.col("__ly") == F.floor(F.greatest("l_y0", "r_y0") / cell))
    joined = l.join(r, [*same, F.col("__lx") == F.col("__cx"), F.col("__ly") == F.col("__cy"), first, on])
    return joined.drop("__lx", "__ly", "__cx", "__cy")


def left_box() -> G.Box:
    return G.Box.of("l_")


def right_box() -> G.Box:
    return G.Box.of("r_")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return meet(left, right, G.overlaps(left_box(), right_box()), keys)


def assign(regions: DataFrame, glyphs: DataFrame) -> DataFrame:
    """page, id of each glyph with n_assigned, n_boundary, region_id (where one region owns it) and state.

    Assigned: the glyph's middle lies in the region and half of its area does. Boundary: it overlaps one, but is assigned
    to none. Multiple: several own it.
    """
    owns = G.contains_center(left_box(), right_box()) & (G.overlap_ratio(left_box(), right_box()) >= ASSIGNED)
    pairs = overlapping(regions, glyphs).select(F.col("r_page").alias("page"), F.col("r_id").alias("id"), F.col("l_id").alias("region"), owns.alias("owns"))
    counts = pairs.groupBy("page", "id").agg(F.count_if("owns").alias("n_assigned"), F.count_if(~F.col("owns")).alias("n_touched"), F.min(F.when(F.col("owns"), F.col("region"))).alias("region"))
    out = glyphs.select("page", "id").join(counts, ["page", "id"], "left").fillna(0, ["n_assigned", "n_touched"])
    state = F.when(F.col("n_assigned") > 1, "multiple").when(F.col("n_assigned") == 1, "assigned").when(F.col("n_touched") > 0, "boundary").otherwise("unassigned")
    return out.select("page", "id", "n_assigned", F.col("n_touched").alias("n_boundary"), F.when(F.col("n_assigned") == 1, F.col("region")).alias("region_id"), state.alias("state"))


def unique_containers(items: DataFrame, regions: DataFrame) -> DataFrame:
    """id of each region with the one item whose box holds its middle; status none, linked or ambiguous."""
    pairs = meet(items, regions, G.contains_center(left_box(), right_box()) & (G.intersection(left_box(), right_box()) >= 0))
    counts = pairs.groupBy(F.col("r_page").alias("page"), F.col("r_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("l_id").alias("item"))
    out = regions.select("page", "id").join(counts, ["page", "id"], "left").fillna(0, ["n"])
    return out.select("page", "id", "n", F.when(F.col("n") == 1, F.col("item")).alias("item_id"), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "linked").otherwise("ambiguous").alias("status"))


def scored_pairs(oracle: DataFrame, candidates: DataFrame) -> DataFrame:
    """page, oracle_id, candidate_id, iou of pairs that overlap."""
    return overlapping(oracle, candidates).select(F.col("l_page").alias("page"), F.col("l_id").alias("oracle_id"), F.col("r_id").alias("candidate_id"), G.iou(left_box(), right_box()).alias("iou"))


def match(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A largest matching per page of pairs with iou >= threshold: page, oracle_id, candidate_id, iou.

    Oracles and their neighbours are tried by rising id; edges never leave a page, so pages are matched apart.
    """
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, list[int]] = {}
        for o, c in group.sort_values(["oracle_id", "candidate_id"])[["oracle_id", "candidate_id"]].itertuples(index=False):
            near.setdefault(o, []).append(c)
        owner: dict[int, int] = {}
        for root in near:
            # Breadth-free depth-first search for an augmenting path, kept on a stack of its own.
            seen: set[int] = set()
            path: list[tuple[int, int]] = []
            stack = [(root, iter(near[root]))]
            while stack:
                o, rest = stack[-1]
                c = next((x for x in rest if x not in seen), None)
                if c is None:
                    stack.pop()
                    if path:
                        path.pop()
                    continue
                seen.add(c)
                path.append((o, c))
                if c not in owner:
                    for a, b in path:
                        owner[b] = a
                    break
                stack.append((owner[c], iter(near[owner[c]])))
        found = pd.DataFrame({"oracle_id": list(owner.values()), "candidate_id": list(owner)}, dtype="int64")
        return group.merge(found, on=["oracle_id", "candidate_id"])[["page", "oracle_id", "candidate_id", "iou"]]

    return pairs.where(F.col("iou") >= threshold).groupBy("page").applyInPandas(run, "page long, oracle_id long, candidate_id long, iou double")


def near_misses(pairs: DataFrame, matches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs with 0 < iou < threshold whose two ends are both unmatched."""
    return pairs.where((F.col("iou") > 0) & (F.col("iou") < threshold)).join(matches.select("page", "oracle_id"), ["page", "oracle_id"], "left_anti").join(matches.select("page", "candidate_id"), ["page", "candidate_id"], "left_anti")


def detection_metrics(oracle: DataFrame, candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """n_oracle, n_candidate, n_matched, recall, precision per page and, with a null page, over all; 0.0 over nothing."""
    counts = oracle.select("page", F.lit("o").alias("k")).union(candidates.select("page", F.lit("c"))).union(matches.select("page", F.lit("m")))
    per = counts.groupingSets([["page"], []], "page").agg(F.count_if(F.col("k") == "o").alias("n_oracle"), F.count_if(F.col("k") == "c").alias("n_candidate"), F.count_if(F.col("k") == "m").alias("n_matched"))
    ratio = lambda n: F.when(F.col(n) == 0, F.lit(0.0)).otherwise(F.round(F.col("n_matched") / F.col(n), 6))
    return per.withColumns({"recall": ratio("n_oracle"), "precision": ratio("n_candidate")})


def in_exactly_one_group(rows: DataFrame, keys: list[str], group: str) -> DataFrame:
    """``rows`` with ``shared``: whether the key stands in several groups."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("shared", F.size(F.collect_set(group).over(w)) > 1)


def detected(regions: DataFrame, predictions: DataFrame, pages: DataFrame, exact: Column) -> DataFrame:
    """page, id, n, detected, exact of regions once they are turned with their page (page, angle, width, height).

    A prediction counts if it holds the middle of the turned region; ``exact`` is a condition on columns l_ of the prediction and r_ of
    the region. A page without a row or with an unknown angle detects nothing.
    """
    box = G.rotated(G.Box.of(""), F.col("angle"), F.col("width"), F.col("height"))
    turned = regions.join(pages.select("page", "angle", "width", "height"), "page").withColumns({"x0": box.x0, "y0": box.y0, "x1": box.x1, "y1": box.y1}).drop("angle", "width", "height")
    pairs = meet(predictions, turned, G.contains_center(left_box(), right_box()) & (G.intersection(left_box(), right_box()) >= 0))
    found = pairs.groupBy(F.col("r_page").alias("page"), F.col("r_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(exact, F.lit(False))).alias("exact"))
    out = regions.select("page", "id").join(found, ["page", "id"], "left").fillna(0, ["n"]).fillna(False, ["exact"])
    return out.select("page", "id", "n", (F.col("n") > 0).alias("detected"), "exact")
