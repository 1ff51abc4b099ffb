"""Checks that no plan or source looks ahead."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from barlake.config import Config


@dataclass
class Node:
    """A node of a plan, or of an expression, as Spark tells it."""

    kind: str
    own: dict
    children: list[Node]

    def all(self) -> Iterator[Node]:
        yield self
        for x in self.children:
            yield from x.all()

    @property
    def id(self) -> int | None:
        return self.own.get("exprId", {}).get("id")


def tree(flat: list[dict]) -> Node:
    """Spark lists a tree's nodes from the top, each followed by its children."""
    rest = iter(flat)

    def one() -> Node:
        own = next(rest)
        return Node(own["class"].rpartition(".")[2], own, [one() for _ in range(own["num-children"])])

    return one()


def expressions(node: Node, name: str) -> list[Node]:
    return [tree(x) for x in node.own[name]]


def past_the_row(window: Node) -> list[tuple[Node, str | None, bool]]:
    """(named expression, what is wrong, strictly before the row) of each expression of a Window node."""
    out = []
    for named in expressions(window, "windowExpressions"):
        wrong, strict = None, True
        for x in (n for n in named.all() if n.kind == "WindowSpecDefinition"):
            frame = next((c for c in x.children if c.kind == "SpecifiedWindowFrame"), None)
            upper = frame.children[1] if frame else None
            orders = [c for c in x.children if c.kind == "SortOrder"]
            number = int(upper.own["value"]) if upper is not None and upper.kind == "Literal" else None
            if upper is None or upper.kind == "UnboundedFollowing$" or (number or 0) > 0 or upper.kind not in ("Literal", "CurrentRow$"):
                wrong = "frame past the current row"
            elif not orders or "Descending" in orders[0].own["direction"]["object"]:
                wrong = "order against time"
            strict = strict and number is not None and number < 0
        out.append((named, wrong, strict))
    return out


def looks_ahead(df: DataFrame) -> list[tuple[str, str]]:
    """(column, why) of all in df's analysed plan that a later row can change: windows past the current row or against its
    order, and aggregates that are joined back to rows of their group.

    Aggregates may pass on through a window strictly before each row, as scans over buckets do, or through a union with rows
    that a window then puts in order of time.
    """
    found: list[tuple[str, str]] = []

    def walk(node: Node) -> set[int]:
        """Ids of node's columns that are sums over groups."""
        below = [walk(c) for c in node.children]
        sums = set().union(*below) if below else set()
        uses = lambda x, ids: any(n.id in ids for n in x.all() if n.kind == "AttributeReference")
        if node.kind == "Aggregate":
            named = expressions(node, "aggregateExpressions")
            return {x.id for x in named if uses(x, sums) or any(n.kind == "AggregateExpression" for n in x.all())}
        if node.kind == "Project":
            return {x.id for x in expressions(node, "projectList") if (x.id in sums if x.kind == "AttributeReference" else uses(x, sums))}
        if node.kind == "Window":
            for named, wrong, strict in past_the_row(node):
                if wrong:
                    found.append((named.own.get("name", "?"), wrong))
                elif not strict and uses(named, sums):
                    sums = sums | {named.id}
            return sums
        if node.kind == "Union":
            return set()
        if node.kind == "Join" and bool(below[0]) != bool(below[1]) and node.own["joinType"]["object"].rpartition(".")[2] not in ("LeftSemi$", "LeftAnti$"):
            side = node.children[0 if below[0] else 1]
            names = {x.id: x.own["name"] for n in side.all() for k in ("aggregateExpressions", "projectList") if k in n.own for x in expressions(n, k) if x.id is not None}
            found.extend((names.get(i, "?"), "sum over a group joined back to its rows") for i in sorted(below[0] or below[1]))
            return set()
        return sums

    walk(tree(json.loads(df._jdf.queryExecution().analyzed().toJSON())))
    return list(dict.fromkeys(found))


#: Columns of resample() that the end of a series decides: which coarse bar is still open, and what share is usual.
OPEN_END = frozenset({"_last", "_want"})
#: The statistics of whole series that reference semantics keep.
WHOLE_SERIES = frozenset({"_usual", "_labels"})


def proof(bars: DataFrame, cfg: Config, chunk_rows: int | None = None) -> list[tuple[str, str]]:
    """looks_ahead() of all plans that the feature matrix of bars is made by, but for what is known and said so."""
    from barlake.plans.engine import transform
    from barlake.sources import scratch

    found: list[tuple[str, str]] = []
    watch = lambda df: found.extend(looks_ahead(df))
    scratch.WATCHERS.append(watch)
    try:
        matrix, _ = transform(scratch.cut(bars, bars.columns), cfg, drop_warmup=False, chunk_rows=chunk_rows)
    finally:
        scratch.WATCHERS.remove(watch)
    known = OPEN_END | (WHOLE_SERIES if cfg.features.semantics == "reference" else frozenset())
    return [x for x in dict.fromkeys([*found, *looks_ahead(matrix)]) if x[0] not in known]


def scan_source(folder: str | Path, allowed: frozenset[str] = frozenset()) -> list[tuple[str, int, str]]:
    """(file, line, call) of lead(), negative lags and frames with a positive or open end in Python sources."""
    out = []
    for p in sorted(Path(folder).rglob("*.py")):
        if p.name in allowed:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            if not isinstance(node, ast.Call) or not isinstance(node.func, ast.Attribute):
                continue
            name, args = node.func.attr, node.args
            number = lambda a: ast.literal_eval(a) if isinstance(a, ast.Constant | ast.UnaryOp) and isinstance(getattr(a, "operand", a), ast.Constant) else None
            if name == "lead":
                out.append((p.name, node.lineno, "lead"))
            elif name == "lag" and len(args) > 1 and isinstance(n := number(args[1]), int) and n < 0:
                out.append((p.name, node.lineno, "negative lag"))
            elif name in ("rowsBetween", "rangeBetween") and len(args) == 2:
                n = number(args[1])
                if (isinstance(n, int) and n > 0) or (isinstance(args[1], ast.Attribute) and args[1].attr == "unboundedFollowing"):
                    out.append((p.name, node.lineno, "frame past the current row"))
    return out
