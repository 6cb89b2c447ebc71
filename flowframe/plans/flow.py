"""Flows: directed acyclic graphs of DataFrame transforms.

A node's transform gets the union of its predecessors' outputs. A flow has inputs (where another flow
may be connected) and outputs. Connectors return new flows and share nodes:

    a.then(b)       a >> b    every output of a to every input of b
    a.zip(b)                  outputs to inputs one by one, the shorter side reused from its start
    a.union(b)      a | b     both, shared nodes once
    a.replicate(n)  a ^ n     n parallel copies
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame

_numbers = count()


@dataclass(frozen=True, eq=False)
class Node:
    """A named transform. Its output may be a dict of DataFrames: named ports; an edge says which it takes."""

    name: str
    transform: Callable[..., DataFrame]
    is_source: bool = False
    number: int = field(default_factory=lambda: next(_numbers))


def _unique(items) -> tuple:
    return tuple(dict.fromkeys(items))


@dataclass(frozen=True)
class Flow:
    nodes: tuple[Node, ...] = ()
    edges: tuple[tuple[Node, Node], ...] = ()
    inputs: tuple[Node, ...] = ()
    outputs: tuple[Node, ...] = ()

    def _connect(self, other: Flow, pairs) -> Flow:
        if not self.nodes or not other.nodes:
            return self if self.nodes else other
        made = Flow(_unique(self.nodes + other.nodes), _unique([*self.edges, *other.edges, *pairs]), self.inputs, other.outputs)
        made.topological()
        return made

    def then(self, other: Flow) -> Flow:
        return self._connect(other, [(a, b) for a in self.outputs for b in other.inputs])

    def zip(self, other: Flow) -> Flow:
        a, b = self.outputs, other.inputs
        return self._connect(other, [(a[i % len(a)], b[i % len(b)]) for i in range(max(len(a), len(b)))] if a and b else [])

    def union(self, other: Flow) -> Flow:
        def held(kind: str) -> tuple:
            mine, theirs = getattr(self, kind), getattr(other, kind)
            return _unique(n for n in mine + theirs if (n in mine or n not in self.nodes) and (n in theirs or n not in other.nodes))

        made = Flow(_unique(self.nodes + other.nodes), _unique(self.edges + other.edges), held("inputs"), held("outputs"))
        made.topological()
        return made

    def copy(self) -> Flow:
        """The same shape with nodes of its own; shared nodes stay shared."""
        new = {n: Node(n.name, n.transform, n.is_source) for n in self.nodes}
        return Flow(tuple(new.values()), tuple((new[a], new[b]) for a, b in self.edges), tuple(new[n] for n in self.inputs), tuple(new[n] for n in self.outputs))

    def replicate(self, n: int) -> Flow:
        if n < 1:
            raise ValueError("a flow is replicated at least once")
        return reduce(Flow.union, [self.copy() for _ in range(n - 1)], self)

    __rshift__, __or__, __xor__ = then, union, replicate

    def predecessors(self, n: Node) -> list[Node]:
        return [a for a, b in self.edges if b is n]

    def successors(self, n: Node) -> list[Node]:
        return [b for a, b in self.edges if a is n]

    def topological(self) -> list[Node]:
        """Nodes after all their predecessors; a cycle is an error."""
        waiting = {n: len(self.predecessors(n)) for n in self.nodes}
        ready, done = [n for n in self.nodes if not waiting[n]], []
        while ready:
            done.append(n := ready.pop(0))
            for s in self.successors(n):
                waiting[s] -= 1
                if not waiting[s]:
                    ready.append(s)
        if len(done) < len(self.nodes):
            raise ValueError("the flow has a cycle")
        return done

    def _reach(self, n: Node, step: Callable[[Node], list[Node]]) -> list[Node]:
        found, todo = [], [n]
        while todo:
            for m in step(todo.pop()):
                if m not in found:
                    found.append(m)
                    todo.append(m)
        return found

    def descendants(self, n: Node) -> list[Node]:
        return self._reach(n, self.successors)

    def ancestors(self, n: Node) -> list[Node]:
        return self._reach(n, self.predecessors)

    def cumulated_out_degree(self, n: Node) -> int:
        """Edges below a node, each once."""
        below = {n, *self.descendants(n)}
        return sum(a in below for a, _ in self.edges)

    def find(self, wanted: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.topological() if wanted(n)]

    def to_dot(self, node_style: Callable[[Node], dict] = lambda n: {}, edge_style: Callable[[Node, Node], dict] = lambda a, b: {}) -> str:
        def styled(**style) -> str:
            return " [" + ", ".join(f'{k}="{v}"' for k, v in style.items()) + "]" if style else ""

        at = {n: f"n{i}" for i, n in enumerate(self.nodes)}
        lines = [f"  {at[n]}{styled(label=n.name, **node_style(n))};" for n in self.nodes]
        lines += [f"  {at[a]} -> {at[b]}{styled(**edge_style(a, b))};" for a, b in self.edges]
        return "digraph flow {\n" + "\n".join(lines) + "\n}"

    def describe(self) -> str:
        return "\n".join(f"{n.name} <- {', '.join(p.name for p in self.predecessors(n)) or '-'}" for n in self.topological())

    def compile(self, *frames: DataFrame) -> list[DataFrame]:
        """DataFrames of the outputs. frames feed the inputs that are no sources, in order; sources are called without."""
        feeds = dict(zip([n for n in self.inputs if not n.is_source], frames, strict=True))
        made: dict[Node, DataFrame] = {}
        for n in self.topological():
            arriving = [made[p] for p in self.predecessors(n)] + ([feeds[n]] if n in feeds else [])
            made[n] = n.transform() if n.is_source else n.transform(reduce(DataFrame.unionByName, arriving))
        return [made[n] for n in self.outputs]

    def as_transform(self) -> Callable[[DataFrame], DataFrame]:
        """A flow with one input and one output as a plain function: DataFrame.transform runs it inside another plan."""
        return lambda frame: self.compile(frame)[0]


def node(transform: Callable[[DataFrame], DataFrame], name: str | None = None) -> Flow:
    n = Node(name or transform.__name__, transform)
    return Flow((n,), (), (n,), (n,))


def source(make: Callable[[], DataFrame], name: str | None = None) -> Flow:
    n = Node(name or make.__name__, make, True)
    return Flow((n,), (), (n,), (n,))
