"""Whether (or how often) a tree pattern lies in one graph: exact, sampled and rooted tests in plain Python.

Null labels match every label. All sampled tests err on one side: a reported match is one.
"""

from __future__ import annotations

from collections import defaultdict, deque
from math import perm

from .kernels import _labelled, adjacency, bicomponents, component_ids, contains, renumbered, same, spanning_trees, wilson
from .structure import listed_trees, split_components


def matching(options: list[list[int]]) -> list[int] | None:
    """A choice of different items, one for each list, or None: augmenting paths."""
    owner: dict[int, int] = {}

    def place(k, tried):
        for x in options[k]:
            if x not in tried:
                tried.add(x)
                if x not in owner or place(owner[x], tried):
                    owner[x] = k
                    return True
        return False

    for k in range(len(options)):
        if not place(k, set()):
            return None
    chosen = {k: x for x, k in owner.items()}
    return [chosen[k] for k in range(len(options))]


def matching_size(options: list[list[int]]) -> int:
    """The largest number of lists that get different items."""
    chosen: list[list[int]] = []
    for o in options:
        if matching([*chosen, o]) is not None:
            chosen.append(o)
    return len(chosen)


def subtree_in_forest(labels, edges, pattern_labels, pattern_edges) -> bool:
    """Exact for forests, polynomial: a pattern branch fits under a directed edge if its branches match different ones there."""
    if not pattern_labels:
        return True
    near, pnear = _labelled(len(labels), edges), _labelled(len(pattern_labels), pattern_edges)
    known: dict[tuple[int, int, int], bool] = {}

    def fits(p, up, v, came):
        key = (p, v, came)
        if key not in known:
            kids = [(w, x) for w, x in pnear[p] if w != up]
            known[key] = same(pattern_labels[p], labels[v]) and (not kids or matching([[w for w, y in near[v] if w != came and same(x, y) and fits(c, p, w, v)] for c, x in kids]) is not None)
        return known[key]

    return any(fits(0, -1, v, -1) for v in range(len(labels)))


def parents(n: int, edges) -> list[int]:
    """Of a forest: each vertex's parent; the root of a component is its least vertex, -1 there. Raises on cycles."""
    if not is_forest(n, edges):
        raise ValueError("rooted trees are asked of forests only")
    near, up = adjacency(n, edges), [-1] * n
    for root in sorted(set(component_ids(n, edges))):
        order = [root]
        for v in order:
            for w in near[v]:
                if w != up[v]:
                    up[w] = v
                    order.append(w)
    return up


def rooted_subtree(labels, edges, pattern_labels, pattern_edges) -> int:
    """The image of the pattern's root (vertex 0), nearest to its component's root; -1 where the pattern doesn't fit downwards."""
    if not pattern_labels:
        return 0 if labels else -1
    up, pup = parents(len(labels), [e[:2] for e in edges]), parents(len(pattern_labels), [e[:2] for e in pattern_edges])
    down, pdown = defaultdict(list), defaultdict(list)
    for out, parent, all_edges in ((down, up, edges), (pdown, pup, pattern_edges)):
        for s, d, x in all_edges:
            a, b = (s, d) if parent[d] == s else (d, s)
            out[a].append((b, x))
    known: dict[tuple[int, int], bool] = {}

    def fits(p, v):
        if (p, v) not in known:
            known[p, v] = same(pattern_labels[p], labels[v]) and matching([[w for w, y in down[v] if same(x, y) and fits(c, w)] for c, x in pdown[p]]) is not None
        return known[p, v]

    depth = lambda v: 0 if up[v] < 0 else 1 + depth(up[v])
    return min((v for v in range(len(labels)) if fits(0, v)), key=lambda v: (depth(v), v), default=-1)


def is_forest(n: int, edges) -> bool:
    return len(edges) == n - len(set(component_ids(n, edges)))


def subtree(labels, edges, pattern_labels, pattern_edges) -> bool:
    """Exact for every graph: the forest test where it is one, else backtracking, since a tree lies in a graph exactly if it does in one of its spanning forests."""
    test = subtree_in_forest if is_forest(len(labels), [e[:2] for e in edges]) else contains
    return test(labels, edges, pattern_labels, pattern_edges)


class Shared:
    """A graph asked for many tree patterns: a rooted branch is compared once with each place, whichever patterns have it.

    So a pattern one leaf larger than others costs only the branches that this leaf changes. Exact: forests by matchings of
    branches, other graphs by backtracking."""

    def __init__(self, labels, edges):
        self.labels, self.edges, self.known = labels, edges, {}
        self.near = _labelled(len(labels), edges) if is_forest(len(labels), [e[:2] for e in edges]) else None

    def holds(self, pattern_labels, pattern_edges) -> bool:
        if not pattern_labels:
            return True
        if self.near is None:
            return contains(self.labels, self.edges, pattern_labels, pattern_edges)
        near = _labelled(len(pattern_labels), pattern_edges)

        def branch(p, up):
            return pattern_labels[p], tuple(sorted(((x, branch(w, p)) for w, x in near[p] if w != up), key=repr))

        whole = branch(0, -1)
        return any(self._fits(whole, v, -1) for v in range(len(self.labels)))

    def _fits(self, branch, v, came) -> bool:
        key = branch, v, came
        if key not in self.known:
            label, kids = branch
            self.known[key] = same(label, self.labels[v]) and (not kids or matching([[w for w, y in self.near[v] if w != came and same(x, y) and self._fits(kid, w, v)] for x, kid in kids]) is not None)
        return self.known[key]


def important(labels, edges, pattern_labels, pattern_edges) -> tuple[int, int]:
    """Connected components that hold the pattern, and all."""
    parts = split_components(labels, edges)
    return sum(subtree(v, e, pattern_labels, pattern_edges) for v, e, _ in parts), len(parts)


class LocalTrees:
    """Spanning trees of the blocks at each vertex through which the walk from the least vertex of a component enters them.

    `samples` trees for each such vertex (all of them where it is 0); those with equal edges count once. A pattern is
    held if it lies in a graph that has, at every such vertex, the edges of one of its trees."""

    def __init__(self, labels, edges, samples: int = 0, rng=None, unique: bool = True, limit: int = 10_000):
        self.labels, n, pairs = labels, len(labels), [e[:2] for e in edges]
        order, seen, near = {}, set(), adjacency(n, pairs)
        for start in range(n):
            queue = [start] if start not in seen else []
            seen.update(queue)
            for v in queue:
                order[v] = len(order)
                new = [w for w in near[v] if w not in seen]
                seen.update(new)
                queue += new
        at = defaultdict(list)
        for part in bicomponents(n, pairs):
            if len(part) > 1:
                at[min({v for e in part for v in e}, key=order.get)].append(part)
        self.trees = {v: self._local(parts, samples, rng, unique, limit) for v, parts in at.items()}
        mask: dict[tuple[int, int], tuple[int, int]] = {}
        for v, trees in self.trees.items():
            for part in at[v]:
                for e in part:
                    mask[e] = (v, sum(1 << k for k, t in enumerate(trees) if e in t))
        self.near = [[] for _ in range(n)]
        for s, d, x in edges:
            group = mask.get((s, d), (-1, 1))
            self.near[s].append((d, x, group))
            self.near[d].append((s, x, group))
        self.full = {v: (1 << len(t)) - 1 for v, t in self.trees.items()} | {-1: 1}

    @staticmethod
    def _local(parts, samples, rng, unique, limit):
        def one(part, tree):
            k, _ = renumbered(part)
            back = dict(enumerate(dict.fromkeys(v for e in part for v in e)))
            known = {frozenset(e): e for e in part}
            return frozenset(known[frozenset((back[s], back[d]))] for s, d in tree), k

        trees = []
        if samples:
            for _ in range(samples):
                trees.append(frozenset().union(*(one(p, wilson(*renumbered(p), rng))[0] for p in parts)))
        else:
            trees = [frozenset()]
            for p in parts:
                here = [one(p, t)[0] for t in listed_trees(*renumbered(p))]
                if len(here) * len(trees) > limit:
                    raise OverflowError("more local trees than the limit; use contains")
                trees = [a | b for a in trees for b in here]
        return list(dict.fromkeys(trees)) if unique else trees

    def combinations(self) -> int:
        out = 1
        for t in self.trees.values():
            out *= len(t)
        return out

    def holds(self, pattern_labels, pattern_edges) -> bool:
        if not pattern_labels:
            return True
        pnear = _labelled(len(pattern_labels), pattern_edges)
        order, seen = [(0, -1, None)], {0}
        for p, _, _ in order:
            for w, x in pnear[p]:
                if w not in seen:
                    seen.add(w)
                    order.append((w, p, x))
        image: dict[int, int] = {}
        left = dict(self.full)

        def place(k):
            if k == len(order):
                return True
            p, up, x = order[k]
            options = [(v, None, (-1, 1)) for v in range(len(self.labels))] if up < 0 else self.near[image[up]]
            for v, y, (group, mask) in options:
                rest = left[group] & mask
                if rest and v not in image.values() and same(x, y) and same(pattern_labels[p], self.labels[v]):
                    before, left[group], image[p] = left[group], rest, v
                    if place(k + 1):
                        return True
                    left[group] = before
                    del image[p]
            return False

        return place(0)


class Whole:
    """A graph asked for trees by backtracking, in place of its local trees."""

    def __init__(self, labels, edges):
        self.graph = labels, edges

    def holds(self, pattern_labels, pattern_edges) -> bool:
        return contains(*self.graph, pattern_labels, pattern_edges)


def max_flow(n: int, arcs, source: int, sink: int) -> int:
    """The greatest flow from source to sink over arcs (from, to, capacity): excess is pushed downhill, vertices are raised where it stands."""
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in arcs:
        room[a][b] = room[a].get(b, 0) + c
        room[b].setdefault(a, 0)
    height, excess = [0] * n, [0] * n
    height[source], excess[source] = n, sum(room[source].values())
    active = deque([source])

    def push(v, w):
        by = min(excess[v], room[v][w])
        room[v][w] -= by
        room[w][v] += by
        excess[v] -= by
        if by and not excess[w] and w not in (source, sink):
            active.append(w)
        excess[w] += by

    active.clear()
    for w in list(room[source]):
        push(source, w)
    while active:
        v = active.popleft()
        while excess[v]:
            for w in room[v]:
                if excess[v] and room[v][w] and height[v] == height[w] + 1:
                    push(v, w)
            if excess[v]:
                height[v] = 1 + min(height[w] for w in room[v] if room[v][w])
    return excess[sink]


def matching_reaches(options: list[list[int]], least: int) -> bool:
    """Whether `least` of the lists get different items, given up as soon as too many have failed."""
    chosen: list[list[int]] = []
    for k, o in enumerate(options):
        if len(chosen) >= least or len(chosen) + len(options) - k < least:
            break
        if matching([*chosen, o]) is not None:
            chosen.append(o)
    return len(chosen) >= least


def hops(labels, edges, pattern_labels, pattern_edges, rng, how: str = "maximum", root: int | None = None, down=None) -> int:
    """One random trial: 0 on failure, else an estimate of the number of embeddings (1 for the plain variants).

    how: 'simple' takes the first neighbours that fit, 'random' does so in random order, 'matching' takes a maximum
    matching, 'maximum' a uniform one for each class of (edge label, vertex label). `down` restricts steps to arcs."""
    n, k = len(labels), len(pattern_labels)
    if not k:
        return 1
    near, pnear = down if down else (_labelled(n, edges), _labelled(k, pattern_edges))
    start = rng.randrange(k) if root is None else root
    images = [v for v in range(n) if same(pattern_labels[start], labels[v])]
    if not images:
        return 0
    first = rng.choice(images)
    used, weight = {first}, [1]

    def grow(p, up, v) -> bool:
        kids = [(c, x) for c, x in pnear[p] if c != up]
        free = [(w, y) for w, y in near[v] if w not in used]
        if how in ("simple", "random"):
            if how == "random":
                rng.shuffle(free)
            for c, x in kids:
                for w, y in free:
                    if w in used or not same(x, y) or not same(pattern_labels[c], labels[w]):
                        continue
                    before = set(used)
                    used.add(w)
                    if grow(c, p, w):
                        break
                    used.clear()
                    used.update(before)
                else:
                    return False
            return True
        if how == "matching":
            chosen = matching([[w for w, y in free if same(x, y) and same(pattern_labels[c], labels[w])] for c, x in kids]) if kids else []
            if chosen is None:
                return False
        else:
            classes, chosen = defaultdict(list), [None] * len(kids)
            for j, (c, x) in enumerate(kids):
                classes[x, pattern_labels[c]].append(j)
            for (x, label), members in classes.items():
                fit = [w for w, y in free if same(x, y) and same(label, labels[w]) and w not in chosen]
                if len(fit) < len(members):
                    return False
                weight[0] *= perm(len(fit), len(members))
                for j, w in zip(members, rng.sample(fit, len(members))):
                    chosen[j] = w
        used.update(chosen)
        return all(grow(c, p, w) for (c, _), w in zip(kids, chosen))

    if not grow(start, -1, first):
        return 0
    return weight[0] * len(images) if how == "maximum" else 1


def directed_near(n: int, edges) -> list[list[tuple[int, str]]]:
    out: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for s, d, x in edges:
        out[s].append((d, x))
    return out


def rooted_hops(labels, edges, pattern_labels, pattern_edges, rng) -> int:
    """A trial from the pattern's root along arcs."""
    down = (directed_near(len(labels), edges), directed_near(len(pattern_labels), pattern_edges))
    return hops(labels, edges, pattern_labels, pattern_edges, rng, root=0, down=down)


def kruskal(n: int, edges, rng) -> list[tuple[int, int]]:
    """A spanning forest by edges in random order."""
    order, kept, pieces = list(edges), [], n
    rng.shuffle(order)
    for e in order:
        if len(set(component_ids(n, [*kept, e]))) < pieces:
            kept.append(e)
            pieces -= 1
    return sorted(kept)


def cactus_tree(n: int, edges, rng) -> list[tuple[int, int]]:
    """Of a cactus: all edges but one random edge of each cycle."""
    gone = {rng.choice(p) for p in bicomponents(n, edges) if len(p) > 1}
    return sorted(e for e in edges if e not in gone)


def listing(n: int, edges, count: int, rng) -> list[tuple]:
    """`count` draws with replacement from all spanning trees of a connected graph."""
    trees = list(listed_trees(n, edges))
    return [rng.choice(trees) for _ in range(count)]


def tree_sampler(how: str, n: int, edges, count: int, threshold: int, rng) -> list[list[tuple[int, int]]]:
    """Spanning trees of a connected graph by the named way; counts that decide are exact (matrix-tree theorem)."""
    few = how in ("mix", "partialListing", "listOrSample") and spanning_trees(n, edges) < threshold
    if how == "bridgeForest":
        return [[p[0] for p in bicomponents(n, edges) if len(p) == 1]]
    if how == "listing" or (few and how == "mix"):
        return [list(t) for t in listing(n, edges, count, rng)]
    if few and how == "listOrSample":
        return [list(t) for t in listed_trees(n, edges)]
    if how == "partialListing":
        count = 1
        if few:
            return [list(t) for t in listing(n, edges, 1, rng)]
    one = {"kruskal": kruskal, "cactus": cactus_tree}.get(how, wilson)
    return [one(n, edges, rng) for _ in range(count)]
