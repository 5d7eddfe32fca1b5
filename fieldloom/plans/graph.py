"""A graph of nodes with named inlets, and its order of evaluation."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from typing import Any

from ..errors import ConsistencyError


@dataclasses.dataclass(eq=False)
class Node:
    """``run`` makes a value from the values of the nodes at its inlets, in order."""

    name: str
    run: Callable[..., Any]
    label: str | None = None

    def __repr__(self) -> str:
        return f"<{self.label or self.name}>"


@dataclasses.dataclass(frozen=True)
class Connection:
    source: Node
    target: Node
    inlet: int = 0


class Graph:
    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.connections: list[Connection] = []

    def add(self, node: Node, *sources: Node) -> Node:
        if node in self.nodes:
            raise ConsistencyError(f"node {node} is there already")
        self.nodes.append(node)
        for i, s in enumerate(sources):
            self.connect(s, node, i)
        return node

    def connect(self, source: Node, target: Node, inlet: int = 0) -> None:
        for n in (source, target):
            if n not in self.nodes:
                raise ConsistencyError(f"node {n} isn't in the graph")
        if any(c.target is target and c.inlet == inlet for c in self.connections):
            raise ConsistencyError(f"inlet {inlet} of {target} is connected already")
        self.connections.append(Connection(source, target, inlet))

    def remove(self, node: Node) -> None:
        self.nodes.remove(node)
        self.connections = [c for c in self.connections if node not in (c.source, c.target)]

    def remove_connection(self, connection: Connection) -> None:
        self.connections.remove(connection)

    def sources(self, node: Node) -> list[Node]:
        return [c.source for c in sorted((c for c in self.connections if c.target is node), key=lambda c: c.inlet)]

    def targets(self, node: Node) -> list[Node]:
        return [c.target for c in self.connections if c.source is node]

    def sorted_nodes(self) -> list[Node]:
        """Sources before targets, otherwise as added."""
        waiting = {n: len(self.sources(n)) for n in self.nodes}
        out: list[Node] = []
        while ready := [n for n, k in waiting.items() if not k]:
            node = ready[0]
            del waiting[node]
            out.append(node)
            for t in self.targets(node):
                waiting[t] -= 1
        if waiting:
            raise ConsistencyError(f"a cycle holds {list(waiting)}")
        return out
