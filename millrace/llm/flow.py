"""Minimum-cost flow on the small networks of the allocation operators.

The networks hold aggregates only (bundles, strata, membership patterns), never records.
"""

from __future__ import annotations

import heapq


class MinCostFlow:
    """Successive shortest paths with potentials; integral capacities, costs of zero or more."""

    def __init__(self, nodes: int = 0):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[int] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, cap: int, cost: int = 0) -> int:
        """The arc's number; its flow is had from ``flow``."""
        k = len(self.to)
        self.to += [b, a]
        self.cap += [int(cap), 0]
        self.cost += [cost, -cost]
        self.out[a].append(k)
        self.out[b].append(k + 1)
        return k

    def flow(self, arc: int) -> int:
        return self.cap[arc + 1]

    def run(self, s: int, t: int, most: int | None = None) -> tuple[int, int]:
        """Send as much as possible (at most ``most``) at the least cost; amount and cost."""
        n, sent, paid = len(self.out), 0, 0
        high = [0] * n
        while most is None or sent < most:
            dist, via = [None] * n, [-1] * n
            dist[s] = 0
            heap = [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for k in self.out[u]:
                    if self.cap[k]:
                        v, e = self.to[k], d + self.cost[k] + high[u] - high[self.to[k]]
                        if dist[v] is None or e < dist[v]:
                            dist[v], via[v] = e, k
                            heapq.heappush(heap, (e, v))
            if dist[t] is None:
                break
            for v in range(n):
                if dist[v] is not None:
                    high[v] += dist[v]
            push, v = (most - sent) if most is not None else None, t
            while v != s:
                k = via[v]
                push = self.cap[k] if push is None else min(push, self.cap[k])
                v = self.to[k ^ 1]
            v = t
            while v != s:
                k = via[v]
                self.cap[k] -= push
                self.cap[k ^ 1] += push
                paid += push * self.cost[k]
                v = self.to[k ^ 1]
            sent += push
        return sent, paid
