"""The one module that touches the session's internals: statements to unresolved plans, and a walk over them.

A statement is parsed, never run, here. The walk goes over a plan's children, its common table expressions, its
expressions and the plans inside these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


class ParseError(ValueError):
    pass


def statements(sql: str) -> list[str]:
    """A text's statements, cut at semicolons outside quotes and comments; empty ones are left out."""
    out, now, k, quote = [], "", 0, ""
    while k < len(sql):
        c, two = sql[k], sql[k : k + 2]
        if quote:
            now += c
            if c == "\\" and quote != "`" and k + 1 < len(sql):
                now += sql[k + 1]
                k += 1
            elif c == quote:
                quote = ""
        elif two == "--":
            end = sql.find("\n", k)
            k = len(sql) if end < 0 else end
            now += " "
            continue
        elif two == "/*":
            end = sql.find("*/", k + 2)
            k = len(sql) if end < 0 else end + 2
            now += " "
            continue
        elif c == ";":
            out.append(now)
            now = ""
        else:
            quote = c if c in "'\"`" else ""
            now += c
        k += 1
    return [s.strip() for s in [*out, now] if s.strip()]


@dataclass
class Node:
    """A plan node or an expression, with what the checks need of it; children include inner plans."""

    kind: str
    is_plan: bool
    name: str | None = None  # of a relation, a column, an alias or a function
    parts: tuple[str, ...] = ()
    value: object = None  # of a literal
    children: list[Node] = field(default_factory=list)
    ctes: tuple[str, ...] = ()

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            yield from c.walk()

    def all(self, *kinds: str) -> list[Node]:
        return [n for n in self.walk() if n.kind in kinds]


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _node(j, is_plan: bool) -> Node:
    kind = j.getClass().getSimpleName()
    node = Node(kind, is_plan)
    if kind in ("UnresolvedRelation", "UnresolvedAttribute", "UnresolvedFunction", "UnresolvedTableValuedFunction"):
        seq = {"UnresolvedRelation": "multipartIdentifier", "UnresolvedAttribute": "nameParts", "UnresolvedFunction": "nameParts", "UnresolvedTableValuedFunction": "name"}[kind]
        node.parts = tuple(str(x) for x in _items(getattr(j, seq)()))
        node.name = node.parts[-1].lower()
    elif kind in ("Alias", "SubqueryAlias"):
        node.name = str(j.name() if kind == "Alias" else j.alias()).lower()
    elif kind == "Literal":
        value = j.value()
        node.value = value if isinstance(value, int | float | bool) or value is None else str(value)
    if is_plan:
        if kind == "UnresolvedWith":
            node.ctes = tuple(str(t._1()).lower() for t in _items(j.cteRelations()))
            node.children += [_node(t._2(), True) for t in _items(j.cteRelations())]
        node.children += [_node(c, True) for c in _items(j.children())]
        node.children += [_node(e, False) for e in _items(j.expressions())]
    else:
        if hasattr(j, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery"):
            if kind != "InSubquery":
                node.children.append(_node(j.plan(), True))
        node.children += [_node(c, False) for c in _items(j.children()) if not (kind in ("ScalarSubquery", "Exists", "ListQuery") and c.getClass().getSimpleName().endswith("Plan"))]
    return node


def parse(spark: SparkSession, sql: str) -> Node:
    """The unresolved plan of one statement. Raises ParseError with the parser's first line."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import ParseException

    try:
        return _node(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), True)
    except (ParseException, Py4JJavaError) as e:
        raise ParseError(str(e).strip().splitlines()[0]) from e


@dataclass(frozen=True)
class Optimised:
    kind: str
    rows: list[tuple] | None  # of a local relation


def optimised(df) -> Optimised:
    """The root of a DataFrame's optimised plan."""
    root = df._jdf.queryExecution().optimizedPlan()
    kind = root.getClass().getSimpleName()
    if kind != "LocalRelation":
        return Optimised(kind, None)
    return Optimised(kind, [tuple(None if r.isNullAt(i) else 1 for i in range(r.numFields())) for r in _items(root.data())])
