"""The fluent pipeline.

``Pipeline`` records sources and operations as nodes. Nothing runs before ``run``; then each node is
evaluated once, Spark sees one plan for each sink, and the last value is returned.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from ..errors import ArgumentError, NoSuchObjectError, ProbeAssertionError
from ..registry import ops
from .graph import Graph, Node


class Pipeline:
    """Operations are methods: ``Pipeline(stores).source("in", "orders").filter_by_value("a", 1)``.

    A pipeline names its last node. ``fork`` gives another one over the same graph, and forks are
    operands of operations on two tables or lists of them.
    """

    def __init__(self, stores: dict[str, Any] | None = None, graph: Graph | None = None, node: Node | None = None, name: str | None = None):
        self.stores, self.graph, self.node, self.name = dict(stores or {}), graph or Graph(), node, name
        self.labels: dict[str, Node] = {}
        self._needed: Pipeline | None = None
        self._satisfied: Pipeline | None = None

    def _store(self, name: str):
        if name not in self.stores:
            raise NoSuchObjectError(f"no store {name!r}; there are {sorted(self.stores)}")
        return self.stores[name]

    def _add(self, name: str, run: Callable, *sources: Node) -> Pipeline:
        self.node = self.graph.add(Node(name, run), *sources)
        return self

    def source(self, store: str, name: str, **options) -> Pipeline:
        """An object of a store."""
        return self._add(f"source {store}.{name}", lambda: self._store(store).get_object(name, **options))

    def source_object(self, data: DataFrame | Callable[..., DataFrame], **options) -> Pipeline:
        """A DataFrame, or what a factory makes of the options."""
        return self._add("source", lambda: data if isinstance(data, DataFrame) else data(**options))

    def insert_into(self, store: str, name: str) -> Pipeline:
        """Append to an object of a store, which must exist."""
        return self._add(f"insert into {store}.{name}", lambda df: self._store(store).append(name, df), self._last())

    def insert_into_object(self, target: DataFrame | str) -> Pipeline:
        return self._add("insert into object", lambda df: ops.insert(df, target), self._last())

    def create(self, store: str, name: str, replace: bool = False) -> Pipeline:
        """Write to a new object of a store."""
        return self._add(f"create {store}.{name}", lambda df: self._store(store).create(name, df, replace=replace), self._last())

    def fork(self, empty: bool = False) -> Pipeline:
        """Another pipeline over the same graph, from the same node, or from none."""
        out = Pipeline(self.stores, self.graph, None if empty else self.node, self.name)
        out.labels = self.labels
        return out

    def clone(self) -> Pipeline:
        """A pipeline with a graph of its own."""
        graph = Graph()
        graph.nodes, graph.connections = list(self.graph.nodes), list(self.graph.connections)
        out = Pipeline(self.stores, graph, self.node, self.name)
        out.labels, out._needed, out._satisfied = dict(self.labels), self._needed, self._satisfied
        return out

    def label(self, name: str) -> Pipeline:
        self._last().label = name
        self.labels[name] = self._last()
        return self

    def __getitem__(self, label: str) -> Pipeline:
        """A fork from a labelled node."""
        if label not in self.labels:
            raise NoSuchObjectError(f"no label {label!r}")
        out = self.fork()
        out.node = self.labels[label]
        return out

    def test_if_needed(self) -> Pipeline:
        """A pipeline of assertions; where they fail, this one is skipped."""
        self._needed = Pipeline(self.stores, name=f"needed {self.name or ''}".strip())
        return self._needed

    def test_if_satisfied(self) -> Pipeline:
        """A pipeline of assertions; where they fail, this one fails before anything runs."""
        self._satisfied = Pipeline(self.stores, name=f"satisfied {self.name or ''}".strip())
        return self._satisfied

    def _last(self) -> Node:
        if self.node is None:
            raise ArgumentError("the pipeline has no source")
        return self.node

    def __getattr__(self, name: str) -> Callable[..., Pipeline]:
        if name.startswith("_"):
            raise AttributeError(name)
        operands = ops.operands(name)

        def call(*args, **kwargs) -> Pipeline:
            given = list(args)
            if operands == 0:
                forks = [self, *(given.pop(0) if given and isinstance(given[0], list | tuple) else [])]
                return self._op(name, forks, lambda tables: ([tables],), given, kwargs)
            many = operands == 2 and given and isinstance(given[0], list | tuple)
            forks = [self, *(given.pop(0) if many else [given.pop(0) for _ in range(operands - 1)])]
            return self._op(name, forks, (lambda t: ((t[0], t[1:]),)) if many else (lambda t: (tuple(t),)), given, kwargs)

        return call

    def _op(self, name: str, forks: list, shape: Callable, args: list, kwargs: dict) -> Pipeline:
        nodes = []
        for f in forks:
            if isinstance(f, Pipeline):
                if f.graph is not self.graph:
                    raise ArgumentError("operands are forks of one pipeline")
                nodes.append(f._last())
            else:
                nodes.append(self.graph.add(Node("object", lambda f=f: f)))
        return self._add(name, lambda *tables: ops.call(name, *shape(list(tables))[0], *args, **kwargs), *nodes)

    def execution_plan(self) -> list[str]:
        """The nodes in order of evaluation, with what they read."""
        order = self.graph.sorted_nodes()
        return [f"{i}: {n.label or n.name}" + (f" <- {', '.join(str(order.index(s)) for s in self.graph.sources(n))}" if self.graph.sources(n) else "") for i, n in enumerate(order)]

    def run(self) -> Any:
        """The value of the last node; None if the pipeline isn't needed."""
        if self._needed is not None:
            try:
                self._needed.run()
            except ProbeAssertionError:
                return None
        if self._satisfied is not None:
            self._satisfied.run()
        values: dict[Node, Any] = {}
        for n in self.graph.sorted_nodes():
            values[n] = n.run(*[values[s] for s in self.graph.sources(n)])
        return values.get(self.node)


def create_pipeline(stores: dict[str, Any] | None = None, **how) -> Pipeline:
    return Pipeline(stores, **how)
