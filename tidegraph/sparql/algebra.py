"""Query algebra and expressions as plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidegraph.terms import Iri, Literal, Term, Var


class Node:
    """A graph pattern."""


class Expr:
    """An expression."""


# paths ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Inverse:
    path: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class Alternative:
    parts: tuple


@dataclass(frozen=True)
class Repeat:
    path: object
    sign: str  # one of * + ?


@dataclass(frozen=True)
class Negated:
    forward: tuple
    backward: tuple


# patterns ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Triple:
    s: Term
    p: object  # Iri, Var or a path
    o: Term


@dataclass
class Bgp(Node):
    triples: list[Triple] = field(default_factory=list)


@dataclass
class Join(Node):
    left: Node
    right: Node


@dataclass
class LeftJoin(Node):
    left: Node
    right: Node
    cond: Expr | None = None


@dataclass
class Minus(Node):
    left: Node
    right: Node


@dataclass
class Union(Node):
    left: Node
    right: Node


@dataclass
class Filter(Node):
    cond: Expr
    of: Node


@dataclass
class Extend(Node):
    of: Node
    var: Var
    expr: Expr


@dataclass
class Values(Node):
    names: list[Var]
    rows: list[list[Term | None]]


@dataclass
class Graph(Node):
    name: Term
    of: Node


@dataclass
class Group(Node):
    of: Node
    keys: list[Var]
    aggregates: list[tuple[Var, "Aggregate"]]


@dataclass
class OrderBy(Node):
    of: Node
    keys: list[tuple[Expr, bool]]  # expression, descending


@dataclass
class Project(Node):
    of: Node
    names: list[Var]


@dataclass
class Distinct(Node):
    of: Node


@dataclass
class Reduced(Node):
    of: Node


@dataclass
class Slice(Node):
    of: Node
    offset: int
    limit: int | None


# expressions ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const(Expr):
    term: Iri | Literal


@dataclass(frozen=True)
class Ref(Expr):
    var: Var


@dataclass(frozen=True)
class Op(Expr):
    """Operators: || && = != < <= > >= + - * / and, of one operand, ! neg pos."""

    name: str
    args: tuple


@dataclass(frozen=True)
class In(Expr):
    of: Expr
    among: tuple
    negated: bool = False


@dataclass(frozen=True)
class Call(Expr):
    name: str  # a keyword in upper case, or an IRI
    args: tuple


@dataclass(eq=False)
class Exists(Expr):
    of: Node
    negated: bool = False


@dataclass(frozen=True)
class Aggregate(Expr):
    name: str  # COUNT SUM AVG MIN MAX SAMPLE GROUP_CONCAT, or an IRI
    arg: Expr | None  # None of COUNT(*)
    distinct: bool = False
    separator: str = " "


def references(e: Expr | None) -> set[str]:
    """Names of the variables that an expression mentions, patterns within EXISTS left out."""
    if isinstance(e, Ref):
        return {e.var.name}
    if isinstance(e, (Op, Call)):
        return set().union(*map(references, e.args)) if e.args else set()
    if isinstance(e, In):
        return references(e.of).union(*map(references, e.among))
    if isinstance(e, Aggregate):
        return references(e.arg)
    return set()


def substituted(e: Expr, by: dict[str, Expr]) -> Expr:
    """The expression with variables replaced by expressions."""
    if isinstance(e, Ref):
        return by.get(e.var.name, e)
    if isinstance(e, (Op, Call)):
        return type(e)(e.name, tuple(substituted(a, by) for a in e.args))
    if isinstance(e, In):
        return In(substituted(e.of, by), tuple(substituted(a, by) for a in e.among), e.negated)
    if isinstance(e, Aggregate) and e.arg is not None:
        return Aggregate(e.name, substituted(e.arg, by), e.distinct, e.separator)
    return e


def conjuncts(e: Expr) -> list[Expr]:
    return [c for a in e.args for c in conjuncts(a)] if isinstance(e, Op) and e.name == "&&" else [e]


def variables(n: Node) -> list[str]:
    """Names that a pattern may bind, in order of appearance."""
    out: dict[str, None] = {}

    def walk(x: Node) -> None:
        if isinstance(x, Bgp):
            for t in x.triples:
                out.update(dict.fromkeys(v.name for v in (t.s, t.p, t.o) if isinstance(v, Var)))
        elif isinstance(x, (Join, LeftJoin, Union)):
            walk(x.left), walk(x.right)
        elif isinstance(x, Minus):
            walk(x.left)
        elif isinstance(x, Extend):
            walk(x.of)
            out.setdefault(x.var.name)
        elif isinstance(x, Values):
            out.update(dict.fromkeys(v.name for v in x.names))
        elif isinstance(x, Group):
            out.update(dict.fromkeys(v.name for v in x.keys))
            out.update(dict.fromkeys(v.name for v, _ in x.aggregates))
        elif isinstance(x, Project):
            out.update(dict.fromkeys(v.name for v in x.names))
        else:
            if isinstance(x, Graph) and isinstance(x.name, Var):
                out.setdefault(x.name.name)
            walk(x.of)

    walk(n)
    return list(out)
