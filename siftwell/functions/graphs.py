"""Directed graphs that fit into one task: strongly connected components, and shortcuts through what has none."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def components(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, component, cyclic): components count up against the edges between them; cyclic ones have several nodes or a loop.

    Tarjan's method without recursion: one visit for each node and edge.
    """
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, a, b = len(nodes), ends[: len(src)], ends[len(src) :]
    to = b[np.argsort(a, kind="stable")].tolist()
    start = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]).tolist()
    at, seen, low, found = start[:n], [0] * n, [0] * n, [-1] * n
    stack: list[int] = []
    count = done = 0
    for root in range(n):
        if seen[root]:
            continue
        path = [root]
        while path:
            v = path[-1]
            if not seen[v]:
                count += 1
                seen[v] = low[v] = count
                stack.append(v)
            if at[v] < start[v + 1]:
                w = to[at[v]]
                at[v] += 1
                if not seen[w]:
                    path.append(w)
                elif found[w] < 0 and seen[w] < low[v]:
                    low[v] = seen[w]
                continue
            path.pop()
            if path and low[v] < low[path[-1]]:
                low[path[-1]] = low[v]
            if low[v] == seen[v]:
                while found[v] < 0:
                    found[stack.pop()] = done
                done += 1
    component = np.array(found, dtype=np.int64)
    cyclic = np.bincount(component, minlength=done) > 1
    cyclic[component[a[a == b]]] = True
    return nodes, component, cyclic[component]


def shortcuts(edges: set[tuple[int, int]], entries: set[int], exits: set[int]) -> set[tuple[int, int]]:
    """Edges that join the same entries and exits as these, of a graph without cycles whose nodes count down along the edges.

    Pairs of entry and exit where these can't be more than the edges, else the edges themselves.
    """
    if len(entries) * len(exits) > len(edges):
        return edges
    back = len(entries) < len(exits)  # spread the smaller side, as bits
    ends = sorted(entries if back else exits)
    bits, after = defaultdict(int, {c: 1 << i for i, c in enumerate(ends)}), defaultdict(list)
    for c, d in edges:
        after[d if back else c].append(c if back else d)
    for c in sorted(after, reverse=back):
        for d in after[c]:
            bits[c] |= bits[d]
    out = set()
    for c in exits if back else entries:
        k = bits[c]
        while k:
            i = (k & -k).bit_length() - 1
            k &= k - 1
            if ends[i] != c:
                out.add((ends[i], c) if back else (c, ends[i]))
    return out
