"""Query graphs: samples, a file format, and plans for matching them."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Query:
    """An undirected labelled pattern. ``edges`` are pairs with the smaller vertex first."""

    edges: frozenset[tuple[int, int]]
    labels: dict[int, str] = field(hash=False)

    @staticmethod
    def of(neighbors: dict[int, list[int]], labels: dict[int, str]) -> Query:
        """From adjacency lists, made symmetric."""
        pairs = frozenset((min(v, n), max(v, n)) for v, some in neighbors.items() for n in some if v != n)
        return Query(pairs, {v: labels.get(v, "_") for v in {x for p in pairs for x in p}})

    @property
    def vertices(self) -> list[int]:
        return sorted(self.labels)

    def near(self, v: int) -> set[int]:
        return {b if a == v else a for a, b in self.edges if v in (a, b)}

    def degree(self, v: int) -> int:
        return len(self.near(v))

    def joined(self, a: int, b: int) -> bool:
        return (min(a, b), max(a, b)) in self.edges

    def order(self) -> list[int]:
        """A join order: the vertex of most edges first, then always one that most edges tie to those before."""
        out: list[int] = []
        while len(out) < len(self.labels):
            left = [v for v in self.vertices if v not in out]
            out.append(max(left, key=lambda v: (sum(self.joined(v, u) for u in out), self.degree(v), -v)))
        return out


@dataclass(frozen=True)
class Slice:
    """A star around ``anchor`` with its later neighbours in the pattern's degree order, and edges among them."""

    anchor: int
    higher: tuple[int, ...]
    pairs: tuple[tuple[int, int], ...]
    links: tuple[tuple[int, int], ...] = ()


def slices(query: Query) -> list[Slice]:
    """Stars that cover the pattern, largest first: the vertex of the greatest 2 x neighbours + triangles, of equal
    ones the largest id; then the same over the edges left. ``links``: (position, later slice's anchor)."""
    rank = lambda v: (query.degree(v), v)
    left, out = set(query.edges), []
    while left:
        own = {v: sorted((n for n in query.near(v) if (min(v, n), max(v, n)) in left and rank(n) > rank(v)), key=rank) for v in query.vertices}
        inner = {v: [(a, b) for i, a in enumerate(h) for b in h[i + 1 :] if query.joined(a, b)] for v, h in own.items()}
        v = max((v for v in own if own[v]), key=lambda v: (2 * len(own[v]) + len(inner[v]), v))
        out.append(Slice(v, tuple(own[v]), tuple(inner[v])))
        left -= {(min(v, n), max(v, n)) for n in own[v]} | {(min(a, b), max(a, b)) for a, b in inner[v]}
    linked, reached = [], set()
    for i, s in enumerate(out):
        inside = (s.anchor, *s.higher)
        found = []
        for t in out[i + 1 :]:
            for p in (t.anchor, *t.higher):
                if p in inside and t.anchor not in reached:
                    found.append((inside.index(p), t.anchor))
                    reached.add(t.anchor)
                    break
        linked.append(Slice(s.anchor, s.higher, s.pairs, tuple(found)))
    return linked


def read_query(text: str) -> Query:
    """Sections ``#neighbors`` (lines: vertex and its neighbours) and ``#labels`` (lines: vertex and label)."""
    section, neighbors, labels = "", {}, {}
    for line in text.splitlines():
        parts = line.split()
        if not parts:
            continue
        if parts[0].startswith("#"):
            section = parts[0][1:]
        elif section == "neighbors":
            neighbors.setdefault(int(parts[0]), []).extend(map(int, parts[1:]))
        elif section == "labels":
            labels[int(parts[0])] = parts[1]
    return Query.of(neighbors, labels)


def _sample(edges: str, labels: str) -> Query:
    near: dict[int, list[int]] = {}
    for e in edges.split():
        a, b = map(int, e.split("-"))
        near.setdefault(a, []).append(b)
    return Query.of(near, {i + 1: c for i, c in enumerate(labels)})


#: The sample patterns, as edges and the labels of vertices 1, 2, ...
SAMPLES = {
    "q1": _sample("1-2 1-3 2-3", "ABC"),
    "q2": _sample("1-2 1-3 2-3 1-4", "ABCA"),
    "q2_default": _sample("1-2 1-3 2-3 1-4", "____"),
    "q3": _sample("1-2 1-3 1-4 2-3 2-4 2-5 3-4 3-5", "AAAAA"),
    "q4": _sample("1-2 1-3 1-4 1-5 2-3 2-4 2-5 3-4 3-5 4-5", "ABCDE"),
    "q5": _sample("1-2 1-3 2-3 2-4 3-6 4-5 5-6 4-6", "ABCDAA"),
}
