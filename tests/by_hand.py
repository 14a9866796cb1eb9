"""Findings of one repository, in memory and in order: what the joins of infer.findings must come to."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

from histlens.functions.values import CONFIDENCE
from histlens.operators.infer import MAX_HOPS, PATTERNS, WORK_BUDGET, Pattern


class Exhausted(Exception):
    """The search budget is spent."""


@dataclass
class Search:
    """Distances over undirected file edges, and the work that asking for them costs."""

    edges: dict[str, set[str]]
    budget: int = WORK_BUDGET
    work: int = 0
    _known: dict[str, dict[str, int]] = field(default_factory=dict)

    def spend(self, units: int = 0) -> None:
        self.work += units
        if self.work > self.budget:
            raise Exhausted

    def within(self, start: str) -> dict[str, int]:
        """Files within MAX_HOPS of one; the first question for a file costs as many units as it has answers."""
        if start not in self._known:
            found, waiting = {start: 0}, deque([start])
            while waiting:
                here = waiting.popleft()
                if found[here] < MAX_HOPS:
                    for other in self.edges.get(here, ()):
                        if other not in found:
                            found[other] = found[here] + 1
                            waiting.append(other)
            self._known[start] = found
            self.work += len(found)
        return self._known[start]

    def distance(self, a: str, b: str) -> int:
        return 0 if a == b else self.within(a).get(b, MAX_HOPS + 1)

    def nearest(self, sides: list[list[str]]) -> tuple[int, tuple[str, ...]] | None:
        """Files, one of each side, with the smallest largest distance within MAX_HOPS; the first in order of the sides wins ties."""
        best: tuple[int, tuple[str, ...]] | None = None
        for reach, files in self._candidates(sides):
            if reach <= MAX_HOPS and (best is None or reach < best[0]):
                best = (reach, files)
        return best

    def _candidates(self, sides: list[list[str]]) -> Iterator[tuple[int, tuple[str, ...]]]:
        for a, b in product(sides[0], sides[1]):
            # A pair is a unit of work by itself; for triples the third file is.
            self.spend(1 if len(sides) == 2 else 0)
            first = self.distance(a, b)
            self.spend()
            if len(sides) == 2:
                yield first, (a, b)
            elif first <= MAX_HOPS:
                for c in sides[2]:
                    self.spend(1)
                    yield max(first, self.distance(a, c), self.distance(b, c)), (a, b, c)


def _ordered(anchors: list[dict]) -> list[dict]:
    return sorted(anchors, key=lambda a: (a["path"], a["line"], a["kind"]))


def _together(groups: list[list[dict]], scope) -> list[dict] | None:  # noqa: ANN001
    """The first anchor of each group in the first scope, by the first group's order, that all groups have."""
    firsts: list[dict] = []
    for group in groups:
        seen: dict = {}
        for a in _ordered(group):
            seen.setdefault(scope(a), a)
        firsts.append(seen)
    for a in _ordered(groups[0]):
        if all(scope(a) in f for f in firsts):
            return [a, *(f[scope(a)] for f in firsts[1:])]
    return None


def _weaker(a: str, b: str) -> str:
    return min(a, b, key=CONFIDENCE.index)


def _one_library(groups: list[list[dict]]) -> list[list[dict]]:
    """Anchors of the library that most groups have, and those of none; the first that appears wins ties."""
    names = list(dict.fromkeys(a["library"] for g in groups for a in g if a["library"]))
    if len(names) < 2:
        return groups
    best = max(names, key=lambda n: (sum(any(a["library"] in (n, None) for a in g) for g in groups), -names.index(n)))
    return [[a for a in g if a["library"] in (best, None)] for g in groups]


def classify(anchors: list[dict], edges: dict[str, set[str]], packages: set[str], touched: set[str], budget: int = WORK_BUDGET) -> list[dict]:
    """Findings of one repository, by slug."""
    search, out = Search(edges, budget), []

    def of(kind: str, pattern: Pattern) -> list[dict]:
        return [a for a in anchors if a["kind"] == kind and (pattern.provider is None or kind != "webhook-verification" or a["provider"] == pattern.provider)]

    def report(pattern: Pattern, confidence: str, own: list[dict], connection: str | None = None, distance: int | None = None, bounded: bool | None = None) -> None:
        attributed = any(a["path"] in touched for a in own)
        kept = [{k: a[k] for k in ("kind", "path", "fn", "line", "reason")} for a in _ordered(own)]
        out.append({"slug": pattern.slug, "confidence": confidence, "attributed": attributed, "claimed": attributed and confidence != "ambiguous", "anchors": kept, "connection": connection, "edge_distance": distance, "search_bounded": bounded})

    for pattern in PATTERNS:
        groups = [of(k, pattern) for k in pattern.kinds]
        if pattern.scoped:
            groups = _one_library(groups)
        own = [a for g in groups for a in g]
        lacking = pattern.optional if pattern.optional and not of(pattern.optional, pattern) else None
        # Without an optional member of the three, the other two are searched.
        sides = [g for g, k in zip(groups, pattern.kinds) if k != lacking]
        most = "inferred" if lacking else "direct"
        if all(sides):
            scopes = (("same-function", lambda a: (a["path"], a["fn"])), ("same-file", lambda a: a["path"]))
            hit = next(((name, found) for name, scope in scopes if (found := _together(sides, scope))), None)
            if hit:
                report(pattern, _weaker("direct", most), hit[1], hit[0], 0)
                continue
            try:
                near = search.nearest([list(dict.fromkeys(a["path"] for a in _ordered(s))) for s in sides])
            except Exhausted:
                report(pattern, "ambiguous", own, bounded=True)
                continue
            if near:
                report(pattern, _weaker("inferred", most), [next(a for a in _ordered(s) if a["path"] == f) for s, f in zip(sides, near[1])], "cross-file", near[0])
                continue
        if groups[0] or packages & set(pattern.packages):
            report(pattern, "ambiguous", own)
    return sorted(out, key=lambda f: f["slug"])
