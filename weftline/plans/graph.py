"""The graph of a workflow's tools."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

from weftline.plans.document import Connection, Workflow


class CyclicWorkflow(ValueError):
    """The connections form a loop."""


class Graph:
    """Connections between known tools."""

    def __init__(self, flow: Workflow) -> None:
        self.nodes = sorted(flow.tools)
        self.edges: list[Connection] = [c for c in flow.connections if c.origin in flow.tools and c.destination in flow.tools]
        self.into: dict[int, list[Connection]] = defaultdict(list)
        self.out: dict[int, list[Connection]] = defaultdict(list)
        for c in self.edges:
            self.into[c.destination].append(c)
            self.out[c.origin].append(c)

    def order(self) -> list[int]:
        """Every tool behind its origins, the smaller id first."""
        waiting = {n: len(self.into[n]) for n in self.nodes}
        ready = [n for n in self.nodes if not waiting[n]]
        heapq.heapify(ready)
        done = []
        while ready:
            n = heapq.heappop(ready)
            done.append(n)
            for c in self.out[n]:
                waiting[c.destination] -= 1
                if not waiting[c.destination]:
                    heapq.heappush(ready, c.destination)
        if len(done) < len(self.nodes):
            raise CyclicWorkflow(f"a loop among the tools {sorted(set(self.nodes) - set(done))}")
        return done

    def _closure(self, start: int, step: dict[int, list[Connection]], end: str) -> set[int]:
        seen: set[int] = set()
        stack = [start]
        while stack:
            for c in step[stack.pop()]:
                n = getattr(c, end)
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return seen

    def ancestors(self, tool: int) -> set[int]:
        return self._closure(tool, self.into, "origin")

    def descendants(self, tool: int) -> set[int]:
        return self._closure(tool, self.out, "destination")

    def sources(self) -> list[int]:
        return [n for n in self.nodes if not self.into[n] and self.out[n]]

    def sinks(self) -> list[int]:
        return [n for n in self.nodes if self.into[n] and not self.out[n]]

    def isolated(self) -> list[int]:
        return [n for n in self.nodes if not self.into[n] and not self.out[n]]

    def consumed(self, tool: int) -> list[str]:
        """Anchors of a tool that some connection leaves, once per connection."""
        return [c.origin_anchor for c in self.out[tool]]

    def paths(self) -> Iterator[tuple[int, ...]]:
        """All paths from sources to sinks, made one by one: their number may grow exponentially, the memory only with the
        longest of them. Loops raise. ``path_counts`` tells how many there are without making them."""
        self.order()
        for source in self.sources():
            path, steps = [source], [iter(self._next(source))]
            while steps:
                n = next(steps[-1], None)
                if n is None:
                    if not self.out[path[-1]]:
                        yield tuple(path)
                    path.pop()
                    steps.pop()
                else:
                    path.append(n)
                    steps.append(iter(self._next(n)))

    def _next(self, tool: int) -> list[int]:
        return sorted({c.destination for c in self.out[tool]})

    def path_counts(self) -> dict[int, int]:
        """Paths from each tool to a sink."""
        counts: dict[int, int] = {}
        for n in reversed(self.order()):
            counts[n] = sum(counts[m] for m in self._next(n)) or 1
        return counts
