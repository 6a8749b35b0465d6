"""One-to-one matching of detections and true points: most pairs first, then least total distance.

Only pairs within the radius are ever made, by a join on buckets of the distance.  They part a cell
into groups of points that no pair connects; each group grows its matching by one pair at a time,
along the cheapest alternating path.  After k steps the matching is the cheapest of k pairs, so when
no path is left it has as many pairs as there can be, at the least total distance.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Edge = tuple[int, int, float]


def groups(edges: Iterable[Edge]) -> Iterator[list[Edge]]:
    """The edges (left, right, distance) of each connected group."""
    out: dict[int, list[Edge]] = defaultdict(list)
    by_left: dict[int, list[Edge]] = defaultdict(list)
    by_right: dict[int, list[int]] = defaultdict(list)
    for edge in edges:
        by_left[edge[0]].append(edge)
        by_right[edge[1]].append(edge[0])
    seen: set[int] = set()
    for first in sorted(by_left):
        if first in seen:
            continue
        waiting = [first]
        seen.add(first)
        while waiting:
            left = waiting.pop()
            out[first] += by_left[left]
            for _, right, _ in by_left[left]:
                for other in by_right.pop(right, ()):
                    if other not in seen:
                        seen.add(other)
                        waiting.append(other)
    yield from out.values()


def best(edges: Iterable[Edge]) -> list[Edge]:
    """The matching of one group.

    Each point has a height; a step costs its distance plus the difference of heights, which stays
    non-negative, so the cheapest path is found as the shortest one (Dijkstra), and heights follow it.
    """
    near: dict[int, dict[int, float]] = defaultdict(dict)
    for left, right, d in edges:
        near[left][right] = min(d, near[left].get(right, d))
    partner: dict[int, int] = {}  # of a matched right point
    height_left: dict[int, float] = dict.fromkeys(near, 0.0)
    height_right: dict[int, float] = {r: 0.0 for row in near.values() for r in row}
    free, height_end = set(near), 0.0
    while free:
        far: dict[int, float] = dict.fromkeys(free, 0.0)  # of left points
        reached: dict[int, tuple[float, int]] = {}  # of right points: distance, left point before
        queue = [(0.0, left) for left in sorted(free)]
        closed: set[int] = set()
        while queue:
            at, left = heapq.heappop(queue)
            if left in closed or at > far[left]:
                continue
            closed.add(left)
            for right, d in near[left].items():
                if partner.get(right) == left:
                    continue
                cost = at + max(d + height_left[left] - height_right[right], 0.0)
                if right not in reached or cost < reached[right][0]:
                    reached[right] = cost, left
                    onward = partner.get(right)
                    if onward is not None and cost < far.get(onward, float("inf")):
                        far[onward] = cost
                        heapq.heappush(queue, (cost, onward))
        ends = [(cost + height_right[right], right) for right, (cost, _) in reached.items() if right not in partner]
        if not ends:
            break
        total, end = min(ends)
        step = total - height_end  # what lies farther, or isn't reached, rises as the end does
        height_end = total
        for right in height_right:
            height_right[right] += min(reached[right][0], step) if right in reached else step
        for left in height_left:
            height_left[left] += min(far.get(left, step), step)
        while True:  # turn the path round
            left = reached[end][1]
            before = next((r for r in near[left] if partner.get(r) == left and r != end), None)
            partner[end] = left
            if left in free:
                free.discard(left)
                break
            del partner[before]
            end = before
    return sorted((left, right, near[left][right]) for right, left in partner.items())


def match(edges: Iterable[Edge]) -> list[Edge]:
    return sorted(pair for group in groups(edges) for pair in best(group))


def pairs_near(found: DataFrame, true: DataFrame, radius: float) -> DataFrame:
    """(cell, found_id, true_id, d) of all pairs of one cell at most ``radius`` apart."""
    step = lambda c: F.floor(F.col(c) / radius)
    around = lambda c: F.explode(F.sequence(step(c) - 1, step(c) + 1))
    left = found.select("cell", F.col("id").alias("found_id"), F.col("x").alias("fx"), F.col("y").alias("fy"), step("x").alias("_bx"), step("y").alias("_by"))
    right = true.select("cell", F.col("id").alias("true_id"), "x", "y", around("x").alias("_bx")).withColumn("_by", around("y"))
    d = F.hypot(F.col("fx") - F.col("x"), F.col("fy") - F.col("y"))
    return left.join(right, ["cell", "_bx", "_by"]).withColumn("d", d).filter(F.col("d") <= radius).select("cell", "found_id", "true_id", "d")


def match_by_cell(found: DataFrame, true: DataFrame, radius: float) -> DataFrame:
    """(cell, found_id, true_id, d) of matched rows with id, x and y.  A cell is one tile's points; its near pairs meet in one task."""

    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        kept = match(zip(pairs["found_id"].tolist(), pairs["true_id"].tolist(), pairs["d"].tolist(), strict=True))
        return pd.DataFrame([(pairs["cell"].iloc[0], *k) for k in kept], columns=["cell", "found_id", "true_id", "d"])

    return pairs_near(found, true, radius).groupBy("cell").applyInPandas(run, "cell long, found_id long, true_id long, d double")
