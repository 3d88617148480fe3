"""Algorithms on one small graph in plain Python; they run inside Arrow-batched UDFs."""

from __future__ import annotations

from collections import Counter, defaultdict
from fractions import Fraction
from functools import cached_property
from itertools import combinations
from math import prod


def adjacency(n: int, edges) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for s, d in edges:
        out[s].append(d)
        out[d].append(s)
    return out


def component_ids(n: int, edges) -> list[int]:
    """The least vertex of each vertex's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for s, d in edges:
        a, b = find(s), find(d)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def bicomponents(n: int, edges) -> list[list[tuple[int, int]]]:
    """Biconnected components as edge lists; one edge alone is a bridge. Iterative depth-first search with low points."""
    near = defaultdict(list)
    for k, (s, d) in enumerate(edges):
        near[s].append((d, k))
        near[d].append((s, k))
    order, low, out, seen = {}, {}, [], set()
    for start in range(n):
        if start in order:
            continue
        order[start] = low[start] = len(order)
        stack, path = [(start, None, iter(near[start]))], []
        while stack:
            v, via, rest = stack[-1]
            for w, k in rest:
                if k == via or k in seen:
                    continue
                seen.add(k)
                path.append(k)
                if w in order:
                    low[v] = min(low[v], order[w])
                else:
                    order[w] = low[w] = len(order)
                    stack.append((w, k, iter(near[w])))
                    break
            else:
                stack.pop()
                if stack:
                    u = stack[-1][0]
                    low[u] = min(low[u], low[v])
                    if low[v] >= order[u]:
                        part = []
                        while True:
                            part.append(edges[path.pop()])
                            if part[-1] == edges[via]:
                                break
                        out.append(part)
    return out


def spanning_trees(n: int, edges) -> int:
    """Spanning trees of a connected graph, by the matrix-tree theorem with exact fractions."""
    if n <= 1:
        return 1
    a = [[Fraction(0)] * n for _ in range(n)]
    for s, d in edges:
        a[s][s] += 1
        a[d][d] += 1
        a[s][d] -= 1
        a[d][s] -= 1
    a = [row[1:] for row in a[1:]]
    det = Fraction(1)
    for c in range(n - 1):
        p = next((r for r in range(c, n - 1) if a[r][c]), None)
        if p is None:
            return 0
        if p != c:
            a[c], a[p] = a[p], a[c]
            det = -det
        det *= a[c][c]
        for r in range(c + 1, n - 1):
            f = a[r][c] / a[c][c]
            if f:
                a[r] = [x - f * y for x, y in zip(a[r], a[c])]
    return int(det)


def renumbered(part):
    at: dict[int, int] = {}
    for e in part:
        for v in e:
            at.setdefault(v, len(at))
    return len(at), [(at[s], at[d]) for s, d in part]


def is_outerplanar(n: int, edges) -> bool:
    """Each block reduces to an edge by removing vertices of degree two and joining their neighbours, no edge being closed over more than twice."""
    for part in bicomponents(n, edges):
        if len(part) == 1:
            continue
        k, e = renumbered(part)
        if len(e) > 2 * k - 3:
            return False
        near = [set() for _ in range(k)]
        sides: dict[frozenset, int] = {}
        for s, d in e:
            near[s].add(d)
            near[d].add(s)
            sides[frozenset((s, d))] = 0
        queue, left = [v for v in range(k) if len(near[v]) == 2], k
        while queue and left > 2:
            v = queue.pop()
            if len(near[v]) != 2:
                continue
            a, b = near[v]
            across = frozenset((a, b))
            # the ear a-v-b lies on one side of the edge a-b; an edge has two sides, a new one has its outer side used by the ear
            if across in sides:
                sides[across] += 1
            else:
                sides[across] = 1
                near[a].add(b)
                near[b].add(a)
            if sides[across] > 2 or any(sides[frozenset((v, x))] > 1 for x in (a, b)):
                return False
            near[a].discard(v)
            near[b].discard(v)
            near[v] = set()
            left -= 1
            queue += [x for x in (a, b) if len(near[x]) == 2]
        if left > 2:
            return False
    return True


def simple_cycles(n: int, edges, length: int | None = None):
    """Simple cycles (of the given length), each once, from its least vertex in its lesser direction."""
    near = adjacency(n, edges)
    for start in range(n):
        stack = [(start, (start,))]
        while stack:
            v, path = stack.pop()
            for w in near[v]:
                if w == start and len(path) > 2 and path[1] < path[-1] and length in (None, len(path)):
                    yield path
                elif w > start and w not in path and (length is None or len(path) < length):
                    stack.append((w, (*path, w)))


class Shape:
    """What the measures of one graph share, worked out when a measure asks for it."""

    def __init__(self, n: int, edges):
        self.n, self.edges = n, edges

    @cached_property
    def component(self):
        return component_ids(self.n, self.edges)

    @cached_property
    def parts(self):
        return bicomponents(self.n, self.edges)

    @cached_property
    def blocks(self):
        return [p for p in self.parts if len(p) > 1]

    @cached_property
    def bridges(self):
        return [p[0] for p in self.parts if len(p) == 1]

    @cached_property
    def degree(self):
        out = [0] * self.n
        for e in self.edges:
            for v in e:
                out[v] += 1
        return out

    @cached_property
    def block_degree(self):
        out = [0] * self.n
        for p in self.blocks:
            for v in {x for e in p for x in e}:
                out[v] += 1
        return out

    @cached_property
    def block_trees(self):
        return [spanning_trees(*renumbered(p)) for p in self.blocks]

    @cached_property
    def easiness(self):
        out = [1] * self.n
        for p, t in zip(self.blocks, self.block_trees):
            for v in {x for e in p for x in e}:
                out[v] *= t
        return out

    @cached_property
    def connected(self):
        return len(set(self.component)) <= 1

    def most_blocks(self):
        per = Counter(self.component[p[0][0]] for p in self.blocks)
        return max(per.values(), default=0)


#: name: its value from a Shape
MEASURES = {
    "connected": lambda g: int(g.connected),
    "tree": lambda g: int(len(g.edges) == g.n - 1 and g.connected),
    "path": lambda g: int(len(g.edges) == g.n - 1 and max(g.degree, default=0) <= 2),
    "cactus": lambda g: int(g.n <= 1 or (g.connected and len(g.edges) - len(g.blocks) == g.n - 1)),
    "outerplanar": lambda g: int(is_outerplanar(g.n, g.edges)),
    "components": lambda g: len(set(g.component)),
    "bicomponents": lambda g: len(g.parts),
    "blocks": lambda g: len(g.blocks),
    "max_blocks": lambda g: g.most_blocks(),
    "bridges": lambda g: len(g.bridges),
    "bridge_trees": lambda g: len(set(component_ids(g.n, g.bridges))),
    "max_degree": lambda g: max(g.degree, default=-1),
    "min_degree": lambda g: min(g.degree, default=-1),
    "max_block_degree": lambda g: max(g.block_degree, default=-1),
    "min_block_degree": lambda g: min(g.block_degree, default=-1),
    "max_easiness": lambda g: max(g.easiness, default=-1),
    "min_easiness": lambda g: min(g.easiness, default=-1),
    "spanning_trees": lambda g: prod(g.block_trees),
    "simple_cycles": lambda g: sum(1 for _ in simple_cycles(g.n, g.edges)),
}


def measures(n: int, edges, names=tuple(MEASURES)) -> dict[str, int]:
    """The named measures; none of the others is worked out."""
    shape = Shape(n, edges)
    return {x: MEASURES[x](shape) for x in names}


def same(a, b) -> bool:
    """Labels match; a null one matches all."""
    return a is None or b is None or a == b


def _tokens(near, labels, root, up):
    """Tokens of a rooted tree, leaves first, so that deep trees need no deep stack."""
    order = [(root, up)]
    for v, u in order:
        order += [(w, v) for w, _ in near[v] if w != u]
    made: dict[int, list[str]] = {}
    for v, u in reversed(order):
        kids = sorted([label, *made.pop(w)] for w, label in near[v] if w != u)
        made[v] = [labels[v], *(t for k in kids for t in ("(", *k, ")"))]
    return made[root]


def _labelled(n, edges):
    near: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for s, d, label in edges:
        near[s].append((d, label))
        near[d].append((s, label))
    return near


def rooted_string(labels, edges, root: int = 0) -> str:
    return "".join(t + " " for t in _tokens(_labelled(len(labels), edges), labels, root, -1))


def centres(n: int, edges) -> list[int]:
    """One or two centres of a tree, by taking off leaves."""
    near = adjacency(n, edges)
    degree, left = [len(x) for x in near], n
    leaves = [v for v in range(n) if degree[v] <= 1]
    while left > 2:
        left -= len(leaves)
        new = []
        for v in leaves:
            for w in near[v]:
                degree[w] -= 1
                if degree[w] == 1:
                    new.append(w)
        leaves = new
    return sorted(leaves)


def free_string(labels, edges) -> str:
    """Of a tree: the least rooted string at its centres."""
    near = _labelled(len(labels), edges)
    best = min(_tokens(near, labels, c, -1) for c in centres(len(labels), [e[:2] for e in edges])) if labels else []
    return "".join(t + " " for t in best)


def parse_string(cstring: str) -> tuple[list[str], list[tuple[int, int, str]]]:
    """A canonical string as labels and edges; raises ValueError on a malformed one."""
    tokens, labels, edges, stack, k = cstring.split(), [], [], [], 0
    while k < len(tokens):
        if tokens[k] == ")":
            if not stack:
                raise ValueError("unbalanced string")
            stack.pop()
        elif tokens[k] == "(":
            labels.append(tokens[k + 2])
            edges.append((stack[-1], len(labels) - 1, tokens[k + 1]))
            stack.append(len(labels) - 1)
            k += 2
        else:
            if labels:
                raise ValueError("two roots")
            labels.append(tokens[k])
            stack.append(0)
        k += 1
    if labels and len(stack) != 1:
        raise ValueError("unbalanced string")
    return labels, edges


def contains(labels, edges, pattern_labels, pattern_edges) -> bool:
    """An injective map of a connected pattern that keeps vertex labels and labelled edges (not induced), null labels matching all; backtracking along a search order."""
    if not pattern_labels:
        return True
    near, pnear = _labelled(len(labels), edges), _labelled(len(pattern_labels), pattern_edges)
    link = {(a, b): x for a, r in enumerate(near) for b, x in r}
    order, seen = [(0, -1, None)], {0}
    for v, _, _ in order:
        for w, x in pnear[v]:
            if w not in seen:
                seen.add(w)
                order.append((w, v, x))
    image: dict[int, int] = {}

    def place(k: int) -> bool:
        if k == len(order):
            return True
        v, up, x = order[k]
        options = range(len(labels)) if up < 0 else [w for w, y in near[image[up]] if same(x, y)]
        for w in options:
            if same(labels[w], pattern_labels[v]) and w not in image.values() and all((w, image[u]) in link and same(link[w, image[u]], y) for u, y in pnear[v] if u in image):
                image[v] = w
                if place(k + 1):
                    return True
                del image[v]
        return False

    return place(0)


def wilson(n: int, edges, rng) -> list[tuple[int, int]]:
    """A uniform spanning tree of each component, by loop-erased random walks."""
    near = adjacency(n, edges)
    out, comp = [], component_ids(n, edges)
    inside = {c for c in set(comp)}
    for v in range(n):
        step, w = {}, v
        while w not in inside:
            step[w] = near[w][rng.randrange(len(near[w]))]
            w = step[w]
        w = v
        while w not in inside:
            inside.add(w)
            out.append((min(w, step[w]), max(w, step[w])))
            w = step[w]
    return sorted(out)


def brute_spanning_trees(n: int, edges) -> int:
    return sum(len(set(component_ids(n, c))) <= 1 for c in combinations(edges, n - 1)) if n else 1
