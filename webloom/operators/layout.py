"""The map of results: titles laid out by three scores without overlap.

Scores, boxes and sizes are columns; placing one box looks at all placed before, so the
at most 500 rows of a result page go through one Python group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.quadtree import QuadTree, Region
from webloom.functions.scores import DIMENSIONS
from webloom.operators.search import SPATIAL_ROWS
from webloom.operators.titles import shown_title

HEIGHT = 1080
LINE = 18


def _renormalised(value: Column) -> Column:
    """Linear onto [0, 1] over all rows; 0 where all are equal."""
    w = Window.partitionBy()
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))


def scored(results: DataFrame, x: str = "words", y: str = "assets", z: str = "relevance") -> DataFrame:
    """results with x, y, z scores; rows without one of them are dropped."""
    return results.withColumns({n: DIMENSIONS[d]() for n, d in (("x", x), ("y", y), ("z", z))}).dropna(subset=["x", "y", "z"])


def boxes(rows: DataFrame, width: int = 1920) -> DataFrame:
    """doc_id, title, x, y, z, pt, left, top, box_w, box_h of scored rows (a result page)."""
    title = shown_title(F.coalesce("title", F.lit("")))
    pt = F.lit(10.0) + _renormalised(F.col("z")) * 6
    high = pt / 10 * LINE
    wide = pt / 10 * 8 * F.length("title") + high
    out = rows.withColumn("title", title).withColumn("pt", pt)
    out = out.withColumn("box_w", F.bround(wide).cast("int")).withColumn("box_h", F.bround(high).cast("int"))
    left = F.bround(F.col("x") * width).cast("int")
    out = out.withColumn("left", F.when(left + F.col("box_w") >= width, F.lit(width) - F.col("box_w")).otherwise(left))
    return out.withColumn("top", F.bround(_renormalised(F.col("y")) * HEIGHT).cast("int")).select("doc_id", "title", "x", "y", "z", "pt", "left", "top", "box_w", "box_h")


def tightened(regions: list[Region]) -> list[Region]:
    """From the top down: a box more than a line and a half off the lowest bottom so far moves there. Input in order of top."""
    out: list[Region] = []
    bottom = regions[0].y if regions else 0
    for r in regions:
        if abs(bottom - r.y) > round(LINE * 1.5):
            r = r._replace(y=bottom)
        bottom = max(bottom, r.y + r.h)
        out.append(r)
    return out


def _pushed(r: Region, obstacle: Region) -> Region:
    """r moved off an obstacle by its overlap, along each side that the overlap reaches."""
    over = r.meet(obstacle)
    if over is None:
        return r
    if r.x == over.x:
        r = r._replace(x=r.x + over.w)
    elif r.x + r.w == over.x + over.w:
        r = r._replace(x=r.x - over.w)
    if r.y == over.y:
        return r._replace(y=r.y + over.h)
    if r.y + r.h == over.y + over.h:
        return r._replace(y=r.y - over.h)
    return r


def _can_move(r: Region, obstacles: list[Region]) -> bool:
    """Not held from both left and right, nor from both top and bottom."""
    overs = [o for q in obstacles if (o := r.meet(q)) is not None]
    left, right = any(o.x == r.x for o in overs), any(o.x + o.w == r.x + r.w for o in overs)
    top, bottom = any(o.y == r.y for o in overs), any(o.y + o.h == r.y + r.h for o in overs)
    return not (left and right) and not (top and bottom)


def place_all(items: list[tuple[int, Region]], width: int = 1920, tries: int = 3) -> dict[int, Region]:
    """Where each item ends up; those that find no room in so many tries are left out. Later items of the list are placed first."""
    tree = QuadTree(Region(-width, -10000, 2 * width, 20000))
    placed: dict[int, Region] = {}
    for name, r in reversed(items):
        for _ in range(tries):
            if not any(v is not None for _, v in tree.tiles(r)):
                tree.fill(name, r)
                placed[name] = r
                break
            obstacles = [tile for tile, v in tree.tiles(r) if v is not None]
            if not _can_move(r, obstacles):
                break
            for o in obstacles:
                r = _pushed(r, o)
    return placed


def placed(boxed: DataFrame, width: int = 1920) -> DataFrame:
    """doc_id, title, pt, left, top, box_w, box_h of the boxes that found room; blank titles are left out."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["top", "doc_id"], kind="stable").reset_index(drop=True)
        regions = tightened([Region(*map(int, t)) for t in rows[["left", "top", "box_w", "box_h"]].itertuples(index=False)])
        tops = sorted(r.y for r in regions)
        middle = tops[len(tops) // 2] if tops else 0
        order = sorted(range(len(regions)), key=lambda i: abs(regions[i].y - middle))
        where = place_all([(i, regions[i]) for i in order], width)
        out = rows.loc[sorted(where), ["doc_id", "title", "pt"]].copy()
        for k, c in enumerate(("left", "top", "box_w", "box_h")):
            out[c] = [where[i][k] for i in sorted(where)]
        return out[out["title"].str.strip() != ""]

    # a map is one page; of more, the largest boxes are placed
    page = boxed.orderBy(F.desc("pt"), "doc_id").limit(SPATIAL_ROWS).withColumn("page", F.lit("one"))
    return page.groupBy("page").applyInPandas(run, "doc_id long, title string, pt double, left int, top int, box_w int, box_h int")


def overlaps(a: DataFrame, b: DataFrame, cell: int = 64) -> DataFrame:
    """a_id, b_id of boxes (id, x, y, w, h) that overlap: boxes meet in the grid cells they cover, so no pair is tried that shares none."""

    def covered(boxes: DataFrame, name: str) -> DataFrame:
        span = lambda start, size: F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(start) + F.col(size) - 1) / cell))
        rows = boxes.where("w > 0 and h > 0").select(F.struct("id", "x", "y", "w", "h").alias(name), F.explode(span("x", "w")).alias("cx"), "y", "h")
        return rows.select(name, "cx", F.explode(span("y", "h")).alias("cy"))

    met = covered(a, "a").join(covered(b, "b"), ["cx", "cy"])
    apart = "a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h"
    return met.where(apart).select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id")).distinct()
