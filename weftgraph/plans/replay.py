"""Ordered, limited tree walks over a collected sub-graph.

A request's tree depends on the order in which nodes are visited and counted, which no set operation keeps.
Spark extracts the bounded sub-graph (plans/expand.py); these functions replay the walk over it. The sub-graph
of a request is limited by its depth and by the edges of a node that a walk of ``limit`` entries can come to.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field


@dataclass
class Entry:
    node_id: str
    depth: int
    edge: dict = field(default_factory=dict)
    children: list[Entry] = field(default_factory=list)


def depth_first(root: str, edges: Callable[[str], Iterable[tuple[str, dict]]], depth: int, limit: int) -> list[Entry]:
    """Pre-order: a node is marked and counted, then its own children come before its siblings. Visited nodes
    and the count are shared by the whole tree."""
    seen, count = {root}, 0

    def walk(node: str, level: int) -> list[Entry]:
        nonlocal count
        out: list[Entry] = []
        if level > depth or count >= limit:
            return out
        for other, edge in edges(node):
            if count >= limit:
                break
            if other in seen:
                continue
            seen.add(other)
            count += 1
            entry = Entry(other, level, edge)
            out.append(entry)
            if level < depth:
                entry.children = walk(other, level + 1)
        return out

    return walk(root, 1)


def breadth_first(root: str, edges: Callable[[str], Iterable[tuple[str, dict]]], depth: int, limit: int) -> list[Entry]:
    """First in, first out; a node is marked when it is taken from the queue."""
    top = Entry(root, 0)
    queue, seen, count = deque([top]), set(), 0
    while queue and count < limit:
        entry = queue.popleft()
        if entry.node_id in seen:
            continue
        seen.add(entry.node_id)
        if entry.depth >= depth:
            continue
        for other, edge in edges(entry.node_id):
            if other in seen or count >= limit:
                continue
            child = Entry(other, entry.depth + 1, edge)
            entry.children.append(child)
            queue.append(child)
            count += 1
    return top.children


def by_path(root: str, edges: Callable[[str], Iterable[tuple[str, dict]]], depth: int, limit: int) -> list[Entry]:
    """A node may occur on several paths, never twice on one; the count is shared."""
    count = 0

    def walk(node: str, level: int, path: frozenset[str]) -> list[Entry]:
        nonlocal count
        out: list[Entry] = []
        for other, edge in edges(node):
            if count >= limit:
                break
            if other in path:
                continue
            count += 1
            entry = Entry(other, level, edge)
            out.append(entry)
            if level < depth:
                entry.children = walk(other, level + 1, path | {other})
        return out

    return walk(root, 1, frozenset([root]))


WALKS = {"shared": depth_first, "queue": breadth_first, "path": by_path}
