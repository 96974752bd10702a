"""Terrain on grids of cells in rows: neighbours by joins on shifted cells."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def neighbours(grid: DataFrame, value: str = "elev") -> DataFrame:
    """(row, col, drow, dcol, other): the up to eight neighbours of each cell; each cell is dealt to its neighbours."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EIGHT])).alias("m")
    dealt = grid.select("row", "col", F.col(value).alias("other"), moves)
    dealt = dealt.select((F.col("row") + F.col("m.a")).alias("row"), (F.col("col") + F.col("m.b")).alias("col"), (-F.col("m.a")).alias("drow"), (-F.col("m.b")).alias("dcol"), "other")
    return grid.select("row", "col").join(dealt, ["row", "col"])


def flow_direction(grid: DataFrame) -> DataFrame:
    """(row, col, to_row, to_col, drop): the steepest way down (ties: lower row, then column); cells without one are left out."""
    both = neighbours(grid).join(grid, ["row", "col"])
    slope = (F.col("elev") - F.col("other")) / F.when((F.col("drow") != 0) & (F.col("dcol") != 0), F.sqrt(F.lit(2.0))).otherwise(1.0)
    down = both.withColumn("drop", slope).filter("drop > 0")
    best = down.groupBy("row", "col").agg(F.min(F.struct((-F.col("drop")).alias("d"), "drow", "dcol")).alias("b"))
    return best.select("row", "col", (F.col("row") + F.col("b.drow")).alias("to_row"), (F.col("col") + F.col("b.dcol")).alias("to_col"), (-F.col("b.d")).alias("drop"))


def flow_accumulation(grid: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Cells that drain through each cell, itself included. Pointers are doubled: after round k each cell has sent its count 2^k steps
    down, so the rounds are the logarithm of the longest stream."""
    jump = flow_direction(grid).select("row", "col", "to_row", "to_col")
    jump = written(jump, "flow")
    total = written(grid.select("row", "col", F.lit(1).cast("long").alias("n")), "flow-sums")
    while not jump.isEmpty():
        moved = jump.join(total, ["row", "col"]).groupBy("to_row", "to_col").agg(F.sum("n").alias("add"))
        moved = moved.select(F.col("to_row").alias("row"), F.col("to_col").alias("col"), "add")
        total = written(total.join(moved, ["row", "col"], "left").select("row", "col", (F.col("n") + F.coalesce("add", F.lit(0))).alias("n")), "flow-sums")
        after = jump.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("r2"), F.col("to_col").alias("c2"))
        jump = written(jump.join(after, ["to_row", "to_col"]).select("row", "col", F.col("r2").alias("to_row"), F.col("c2").alias("to_col")), "flow")
    return total


def depression_fill(grid: DataFrame, written: Callable[[DataFrame, str], DataFrame], eps: float = 0.0, tile: int = 256, rounds: int = 1_000_000) -> DataFrame:
    """Elevations with no cell below all its ways out: the lowest, over all ways to the border, of the highest point on the way. Border
    cells (fewer than eight neighbours) keep theirs. With eps > 0 each step must rise by it; that goes cell by cell (`_fill_by_steps`).

    Each tile is flooded from its rim by itself, which gives every cell a basin and a level inside the tile, and basins that touch the
    lowest point between them; basins of neighbouring tiles touch at their rims. On this graph of basins, far smaller than the grid, the
    lowest way out of each is found by joining basins over their lowest links (`_ways_out`), in rounds that grow with the logarithm of
    their number. A cell's level is the higher of its own and its basin's.
    """
    if eps > 0:
        return _fill_by_steps(grid, written, eps)
    side = lambda x: F.floor(F.col(x) / tile)
    dealt = neighbours(grid).groupBy("row", "col").agg(F.count("*").alias("k"), F.count_if((side("row") != F.floor((F.col("row") + F.col("drow")) / tile)) | (side("col") != F.floor((F.col("col") + F.col("dcol")) / tile))).alias("outside"))
    cells = grid.select("row", "col", F.col("elev").cast("double").alias("elev")).join(dealt, ["row", "col"], "left")
    cells = cells.select("row", "col", "elev", F.coalesce(F.col("k") < 8, F.lit(True)).alias("border"), F.coalesce(F.col("outside") > 0, F.lit(False)).alias("rim"), side("row").alias("ty"), side("col").alias("tx"))
    flooded = written(cells.groupBy("ty", "tx").applyInArrow(_flood, "row long, col long, elev double, rim boolean, level double, basin string, basin2 string"), "fill-tiles")

    wet = flooded.filter("basin2 IS NULL")
    rim = wet.filter("rim").select("row", "col", F.col("level").alias("__l"), F.col("basin").alias("__b"))
    moves = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in EIGHT])).alias("m")
    met = rim.select("*", moves).select((F.col("row") + F.col("m.y")).alias("row"), (F.col("col") + F.col("m.x")).alias("col"), F.col("__l").alias("l2"), F.col("__b").alias("b2"))
    across = rim.join(met, ["row", "col"]).filter("__b <> b2").select(F.col("__b").alias("a"), F.col("b2").alias("b"), F.greatest("__l", "l2").alias("w"))
    inside = flooded.filter("basin2 IS NOT NULL").select(F.col("basin").alias("a"), F.col("basin2").alias("b"), F.col("level").alias("w"))
    links = inside.unionByName(inside.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).unionByName(across)
    lowest = lambda df: df.groupBy("a", "b").agg(F.min("w").alias("w"))
    known = _ways_out(written(lowest(links), "fill-links"), written, rounds)
    return wet.join(known, "basin", "left").select("row", "col", "elev", F.greatest("level", "out").alias("fill"))


_OCEAN = "border"


def _ways_out(links: DataFrame, written: Callable[[DataFrame, str], DataFrame], rounds: int) -> DataFrame:
    """(basin, out): of each basin the lowest, over all ways to the border, of the highest link on the way; none where there is no way.
    links: (a, b, w) in both directions.

    In a round each group of basins takes its lowest link, by which its lowest way leaves; the links that groups follow one after another
    never rise, so a basin is raised to its group's link only. Groups that follow one another become one, named by where they end (the
    border, or the lower of two that chose each other), so each round at least halves those that are left."""
    own = written(links.select(F.col("a").alias("basin")).distinct().withColumns({"top": F.col("basin"), "out": F.lit(float("-inf"))}), "fill-known")
    for _ in range(rounds):
        low = links.filter(F.col("a") != _OCEAN).groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))).alias("e"))
        low = written(low.select("a", F.when(F.col("e.p") == F.col("a"), F.col("e.q")).otherwise(F.col("e.p")).alias("up"), "e.w"), "fill-lowest")
        if low.isEmpty():
            return own.filter(F.col("top") == _OCEAN).select("basin", "out")
        chosen = low.select(F.col("a").alias("up"), F.col("up").alias("back"))
        ends = (F.col("back") == F.col("a")) & (F.col("a") < F.col("up"))
        jump = low.join(chosen, "up", "left").select("a", F.when(ends, F.col("a")).otherwise(F.col("up")).alias("up"), F.when(F.coalesce(~ends, F.lit(True)), F.col("w")).alias("w"), F.lit(True).alias("moved"))
        jump = written(jump, "fill-jumps")
        while not jump.filter("moved").isEmpty():
            on = jump.select(F.col("a").alias("up"), F.col("up").alias("next"))
            end = F.coalesce("next", "up")
            jump = written(jump.join(on, "up", "left").select("a", end.alias("up"), "w", (end != F.col("up")).alias("moved")), "fill-jumps")
        group = lambda of, name: jump.select(F.col("a").alias(of), F.col("up").alias(name))  # noqa: B023, E731
        raised = jump.select(F.col("a").alias("top"), F.col("up").alias("__top"), F.col("w").alias("__w"))
        own = written(own.join(raised, "top", "left").select("basin", F.coalesce("__top", "top").alias("top"), F.greatest("out", "__w").alias("out")), "fill-known")
        links = links.join(group("a", "__a"), "a", "left").join(group("b", "__b"), "b", "left").select(F.coalesce("__a", "a").alias("a"), F.coalesce("__b", "b").alias("b"), "w")
        links = written(links.filter("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")), "fill-links")
    raise RuntimeError(f"depression_fill: basins are left after {rounds} rounds")


def _flood(cells: pa.Table) -> pa.Table:
    """One tile: each cell's level and basin, flooded from the tile's rim and from border cells (one basin), lowest first; and for two basins
    that touch (basin, basin2) the lowest level at which they do. A basin is named by the cell where it begins."""
    row, col, elev, border, rim = (cells[c].to_pylist() for c in ("row", "col", "elev", "border", "rim"))
    at = {k: i for i, k in enumerate(zip(row, col, strict=True))}
    todo = [(elev[i], 0 if border[i] else 1, i, _OCEAN if border[i] else f"{row[i]}:{col[i]}") for i in range(len(row)) if border[i] or rim[i]]
    heapq.heapify(todo)
    level: list[float | None] = [None] * len(row)
    basin = [""] * len(row)
    touch: dict[tuple[str, str], float] = {}
    while todo:
        here, _, i, name = heapq.heappop(todo)
        if level[i] is not None:
            continue
        level[i], basin[i] = here, name
        for dy, dx in EIGHT:
            j = at.get((row[i] + dy, col[i] + dx))
            if j is None:
                continue
            if level[j] is None:
                heapq.heappush(todo, (max(here, elev[j]), 2, j, name))
            elif basin[j] != name:
                pair = (min(name, basin[j]), max(name, basin[j]))
                touch[pair] = min(touch.get(pair, float("inf")), max(here, level[j]))
    n, m = len(row), len(touch)
    names = {
        "row": row + [None] * m, "col": col + [None] * m, "elev": elev + [None] * m, "rim": rim + [None] * m, "level": level + list(touch.values()),
        "basin": basin + [a for a, _ in touch], "basin2": [None] * n + [b for _, b in touch],
    }
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.float64(), pa.string(), pa.string())
    return pa.table({c: pa.array(v, t) for (c, v), t in zip(names.items(), kinds, strict=True)})


def _fill_by_steps(grid: DataFrame, written: Callable[[DataFrame, str], DataFrame], eps: float) -> DataFrame:
    """max(elevation, lowest filled neighbour + eps), from the border inwards, until nothing changes."""
    degree = neighbours(grid).groupBy("row", "col").agg(F.count("*").alias("k"))
    cells = grid.join(degree, ["row", "col"], "left").withColumn("border", F.coalesce(F.col("k") < 8, F.lit(True)))
    now = written(cells.select("row", "col", "elev", "border", F.when(F.col("border"), F.col("elev")).otherwise(float("inf")).alias("fill")), "fill")
    while True:
        low = neighbours(now, "fill").groupBy("row", "col").agg(F.min("other").alias("low"))
        step = now.join(low, ["row", "col"], "left").withColumn("new", F.when(F.col("border"), F.col("elev")).otherwise(F.greatest("elev", F.least(F.col("fill"), F.col("low") + eps))))
        step = written(step.select("row", "col", "elev", "border", F.col("new").alias("fill"), (F.col("new") < F.col("fill")).alias("changed")), "fill")
        now = step.drop("changed")
        if step.filter("changed").isEmpty():
            return now.select("row", "col", "elev", "fill")


def local_windows(grid: DataFrame, reach: int) -> DataFrame:
    """Mean and lowest elevation in the square around each cell, by a window along rows and then along columns; position index."""
    across = Window.partitionBy("row").orderBy("col").rangeBetween(-reach, reach)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-reach, reach)
    rows = grid.select("row", "col", "elev", F.sum("elev").over(across).alias("s"), F.count("*").over(across).alias("n"), F.min("elev").over(across).alias("m"))
    out = rows.select("row", "col", "elev", (F.sum("s").over(down) / F.sum("n").over(down)).alias("mean"), F.min("m").over(down).alias("low"))
    return out.withColumns({"tpi": F.col("elev") - F.col("mean"), "relief": F.col("elev") - F.col("low")})


def slope(grid: DataFrame, cell_m: float) -> DataFrame:
    """(row, col, slope): degrees by central differences; null where a neighbour is missing."""
    at = lambda dr, dc: F.max(F.when((F.col("drow") == dr) & (F.col("dcol") == dc), F.col("other")))
    near = neighbours(grid).groupBy("row", "col").agg(((at(0, 1) - at(0, -1)) / (2 * cell_m)).alias("x"), ((at(1, 0) - at(-1, 0)) / (2 * cell_m)).alias("y"))
    return grid.select("row", "col").join(near, ["row", "col"], "left").select("row", "col", F.degrees(F.atan(F.hypot("x", "y"))).alias("slope"))


def nearest_masked(grid: DataFrame, mask, reach: int, value: str = "elev") -> DataFrame:
    """(row, col, cells, value): the nearest cell of the mask within `reach` cells (ties: lower row, then column) and its value; null
    where there is none. Masked cells are dealt to the squares of side `reach` around them."""
    side = lambda x: F.floor(F.col(x) / reach)
    shift = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    m = grid.filter(mask).select(F.col("row").alias("r"), F.col("col").alias("k"), F.col(value).alias("value")).withColumn("dy", shift).withColumn("dx", shift)
    m = m.withColumns({"sy": side("r") + F.col("dy"), "sx": side("k") + F.col("dx")}).drop("dy", "dx")
    cells = grid.select("row", "col").withColumns({"sy": side("row"), "sx": side("col")})
    far = F.pow(F.col("row") - F.col("r"), 2) + F.pow(F.col("col") - F.col("k"), 2)
    best = cells.join(m, ["sy", "sx"]).withColumn("d", far).filter(F.col("d") <= reach * reach).groupBy("row", "col").agg(F.min(F.struct("d", "r", "k", "value")).alias("b"))
    return grid.select("row", "col").join(best, ["row", "col"], "left").select("row", "col", F.sqrt("b.d").alias("cells"), "b.value")
