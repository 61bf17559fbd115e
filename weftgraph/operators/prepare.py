"""All derived tables of a graph, built before anyone asks for them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from ..graph import Graph
from . import context as C
from . import trees as T
from . import values as V

#: Tables by what they need: those of a row need only rows above.
TABLES = [
    ["nodes"],
    ["edges"],
    ["anc", "calls", "args", "refs", "subtypes", "inherits", "overriding", "override_roots", "by_name", "flows", "emits", "handled_by"],
    ["nearest_class", "nearest_method"],
]
FACTS = [[C.incoming, C.injections, C.reference_calls, C.hinted_types, C.instantiated, V.consumers, T.flow_entries, V.origin_entries, V.origin_pairs], [V.hops]]


def prepare(g: Graph, workers: int = 4) -> None:
    """Builds what isn't there yet. Tables that don't need each other are built side by side: each is a few jobs,
    of which one alone seldom fills a cluster."""
    with ThreadPoolExecutor(workers) as pool:
        for row in TABLES:
            list(pool.map(lambda name: getattr(g, name), [n for n in row if hasattr(type(g), n)]))
        for row in FACTS:
            list(pool.map(lambda fact: fact(g), row))
