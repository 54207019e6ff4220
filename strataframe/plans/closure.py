"""Maximum closure and nested shells: a driver-side solver for graphs that fit one process.

A precedence graph of one pit is one indivisible problem; many scenarios run side by side with `solve_many`.
Values are integers, so that the result is exact.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame


def max_closure(values: dict[int, int], needs: list[tuple[int, int]]) -> set[int]:
    """The smallest set of greatest total value that holds with a every b of (a, b): a minimum cut by shortest augmenting paths."""
    source, sink = -1, -2
    cap: dict[int, dict[int, int]] = {v: {} for v in [source, sink, *values]}
    infinite = sum(abs(v) for v in values.values()) + 1

    def add(a: int, b: int, c: int) -> None:
        cap[a][b] = cap[a].get(b, 0) + c
        cap[b].setdefault(a, 0)

    for k, v in values.items():
        if v > 0:
            add(source, k, v)
        elif v < 0:
            add(k, sink, -v)
    for a, b in needs:
        add(a, b, infinite)
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 0 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            return {k for k in level if k >= 0}
        todo = {a: list(cap[a]) for a in level}
        while True:  # one blocking flow, path by path
            path, a = [], source
            while a != sink:
                while todo[a]:
                    b = todo[a][-1]
                    if cap[a][b] > 0 and level.get(b, -1) == level[a] + 1:
                        break
                    todo[a].pop()
                else:
                    if not path:
                        break
                    a = path.pop()
                    todo[a].pop()
                    continue
                path.append(a)
                a = b
            if a != sink:
                break
            steps = list(zip(path, [*path[1:], sink], strict=True))
            flow = min(cap[x][y] for x, y in steps)
            for x, y in steps:
                cap[x][y] -= flow
                cap[y][x] += flow


def nested_shells(revenue: dict[int, int], cost: dict[int, int], needs: list[tuple[int, int]], factors: list[float]) -> dict[int, int]:
    """The first shell (0-based, by ascending factor) that holds each block; blocks of no shell are left out.

    The largest factor is solved first; smaller ones only among the blocks of the next larger shell.
    """
    inside, out = set(revenue), {}
    for i in range(len(factors) - 1, -1, -1):
        values = {k: round(revenue[k] * factors[i]) - cost[k] for k in inside}
        inside = max_closure(values, [(a, b) for a, b in needs if a in inside and b in inside])
        for k in inside:
            out[k] = i
    return out


def pattern(dims: tuple[int, int, int], reach: int = 1) -> list[tuple[int, int]]:
    """(block, block above within reach) of a regular grid; a block needs what lies above it."""
    nx, ny, nz = dims
    at = lambda x, y, z: (z * ny + y) * nx + x
    return [(at(x, y, z), at(x + i, y + j, z + 1)) for z in range(nz - 1) for y in range(ny) for x in range(nx) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if abs(i) + abs(j) <= reach and 0 <= x + i < nx and 0 <= y + j < ny]


def solve_many(blocks: DataFrame, dims: tuple[int, int, int], factors: list[float]) -> DataFrame:
    """(scenario, block, shell) of blocks(scenario, block, revenue, cost): one task a scenario."""

    def one(key, pdf):
        import pandas as pd

        shells = nested_shells(dict(zip(pdf.block.tolist(), pdf.revenue.tolist())), dict(zip(pdf.block.tolist(), pdf.cost.tolist())), pattern(dims), factors)
        return pd.DataFrame([(key[0], b, s) for b, s in sorted(shells.items())], columns=["scenario", "block", "shell"])

    return blocks.groupBy("scenario").applyInPandas(one, "scenario long, block long, shell long")
