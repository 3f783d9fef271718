"""Density clustering the plain way: one sorted list of edges, the whole merge tree, from the top."""

from __future__ import annotations

import math


def spanning(nodes, edges):
    """Kruskal's forest of (w, a, b), shortest first."""
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    out = []
    for w, a, b in sorted(edges):
        if find(a) != find(b):
            up[find(a)] = find(b)
            out.append((w, a, b))
    return out


def clusters(nodes, edges, least):
    """{node: (topic, probability)}"""
    left = {n: n for n in nodes}  # point -> its merge node
    kids, size, height = {}, {n: 1 for n in nodes}, {}
    for k, (w, a, b) in enumerate(spanning(nodes, edges)):
        x, y, new = left[a], left[b], ("m", k)
        kids[new], size[new], height[new] = (x, y), size[x] + size[y], w
        for n in points(kids, new):
            left[n] = new
    tops = sorted(set(left.values()), key=str)
    density = lambda w: 0.0 if math.isinf(w) else 1 / max(w, 1e-9)
    if len(tops) > 1:
        new, known = ("root",), [t for t in tops if size[t] >= least]
        kids[new], height[new] = tuple(known), math.inf
        tops = [new]
    if not tops or (tops[0] not in kids and tops[0] != ("root",)):
        return {n: (-1, 0.0) for n in nodes}
    found, members, leave, born = [], {}, {}, {}  # clusters from the top: (top node, parent)

    def walk(top, parent, birth):
        own = len(found)
        found.append(parent)
        born[own], members[own] = birth, []
        node, todo = top, None
        while True:
            if node == ("root",):
                split = list(kids[node])
            else:
                big = [c for c in kids[node] if size[c] >= least]
                split = big if len(big) == 2 else None
                if split is None:
                    for c in kids[node]:
                        if c not in big:
                            for p in points(kids, c):
                                members[own].append(p)
                                leave[p] = density(height[node])
                    if big:
                        node = big[0]
                        continue
                    return
            at = density(height[node])
            for c in split:
                todo = points(kids, c)
                gained.setdefault(own, 0.0)
                gained[own] += len(todo) * (at - birth)
                walk(c, own, at)
            return

    gained = {}
    walk(tops[0], None, 0.0)
    value, best = {}, {}
    for c in reversed(range(len(found))):
        own = gained.get(c, 0.0) + sum(leave[p] - born[c] for p in members[c])
        below = sum(value[k] for k in range(len(found)) if found[k] == c)
        value[c], best[c] = (own, True) if own >= below and c != 0 else (below, False)
    chosen = {}
    for c in range(len(found)):
        above = found[c]
        chosen[c] = chosen[above] if above is not None and chosen[above] is not None else (c if best[c] else None)
    groups = {}
    for c, name in chosen.items():
        if name is not None:
            groups.setdefault(name, []).extend(members[c])
    out = {n: (-1, 0.0) for n in nodes}
    for topic, group in enumerate(sorted(groups.values(), key=lambda g: -len(g))):
        most = max(leave[p] for p in group)
        for p in group:
            out[p] = (topic, leave[p] / most)
    return out


def points(kids, node):
    todo, out = [node], []
    while todo:
        n = todo.pop()
        if n in kids:
            todo += kids[n]
        else:
            out.append(n)
    return out
