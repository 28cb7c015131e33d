"""Grid routes around blocked cells: A* for each case, one case a group."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame


def a_star(
    start: tuple[int, int], goal: tuple[int, int], blocked: set, box: tuple[int, int, int, int], diagonal: bool = False
) -> list[tuple[int, int]] | None:
    """A shortest way in the box (x0, y0, x1, y1), or None. The start may be blocked, a
    blocked goal can't be reached. With diagonal steps (cost 1.4142) the way need not be
    the shortest, as the Manhattan estimate then overrates."""
    x0, y0, x1, y1 = box
    steps = [(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)]
    if diagonal:
        steps += [(a, b, 1.4142) for a in (1, -1) for b in (1, -1)]
    guess = lambda p: abs(p[0] - goal[0]) + abs(p[1] - goal[1])
    cost, came = {start: 0.0}, {}
    queue = [(guess(start), 0, start)]
    done, pushed = set(), 0
    while queue:
        _, _, here = heapq.heappop(queue)
        if here == goal:
            way = [here]
            while here in came:
                here = came[here]
                way.append(here)
            return way[::-1]
        if here in done:
            continue
        done.add(here)
        for dx, dy, price in steps:
            there = (here[0] + dx, here[1] + dy)
            if not (x0 <= there[0] <= x1 and y0 <= there[1] <= y1) or there in blocked:
                continue
            total = cost[here] + price
            if total < cost.get(there, float("inf")):
                cost[there], came[there] = total, here
                pushed += 1
                heapq.heappush(queue, (total + guess(there), -pushed, there))
    return None


def find_routes(cases: DataFrame, blocked: DataFrame) -> DataFrame:
    """``case``, ``route_found``, ``length`` (nodes, the start included; null without a route)
    and ``lookup_count`` (blocked cells in the box).

    ``cases`` has case, sx, sy, gx, gy, x0, y0, x1, y1; ``blocked`` has case, x, y, once
    each. A case's cells lie in its box, which bounds its group; cases run side by side.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for c in left.itertuples():
            cells = set(zip(right["x"].tolist(), right["y"].tolist(), strict=True))
            way = a_star((c.sx, c.sy), (c.gx, c.gy), cells, (c.x0, c.y0, c.x1, c.y1))
            rows.append((c.case, way is not None, len(way) if way else None, len(cells)))
        return pd.DataFrame(rows, columns=["case", "route_found", "length", "lookup_count"]).astype({"length": "Int64"})

    return (
        cases.groupBy("case")
        .cogroup(blocked.select("case", "x", "y").groupBy("case"))
        .applyInPandas(run, "case string, route_found boolean, length long, lookup_count long")
    )


def route_case(name, start: tuple[int, int], goal: tuple[int, int], margin: int = 2) -> dict:
    """A case whose box is start and goal with ``margin`` tiles around."""
    (sx, sy), (gx, gy) = start, goal
    return {
        "case": name, "sx": sx, "sy": sy, "gx": gx, "gy": gy,
        "x0": min(sx, gx) - margin, "x1": max(sx, gx) + margin, "y0": min(sy, gy) - margin, "y1": max(sy, gy) + margin,
    }
