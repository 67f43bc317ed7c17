"""Symbolic front end: queries as trees of (head, args), evaluated bottom-up as far as they can be.

`evaluate` gives a DataFrame for a relation, a Python value for constants, or, where an input isn't known here, the node with
those arguments evaluated that could be: nothing is raised for unknown heads, tables or predicates.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import relational as R
from ..session import moved, with_conf
from ..sources.catalog import table_literal
from .settings import Settings


@dataclass(frozen=True)
class Sym:
    name: str


@dataclass(frozen=True)
class Node:
    head: str
    args: tuple = ()

    def __repr__(self) -> str:
        return f"{self.head}({', '.join(map(repr, self.args))})"


class _Heads:
    """H.Select(a, b) builds Node("Select", (a, b)); strings in name position are wrapped by the caller with Sym."""

    def __getattr__(self, head: str):
        return lambda *args: Node(head, args)

    def __getitem__(self, head: str):
        return lambda *args: Node(head, args)


H = _Heads()
EXTRA: dict[str, Any] = {}


class NotReady(Exception):
    """The expression can't be compiled here and stays as it is."""


def register(head: str, fn) -> None:
    """Add an operator: fn(list of evaluated arguments, environment) gives its value, or raises NotReady."""
    EXTRA[head] = fn


@dataclass
class Env:
    spark: SparkSession
    tables: dict[str, DataFrame]
    settings: Settings
    literal_mode: str = "narrow"


ARITHMETIC = {"Plus", "Times", "Minus", "Divide"}
BOOLEAN = {"Greater", "Equal", "And"}
SCALAR = ARITHMETIC | BOOLEAN | {"Year", "YearApprox", "StringContainsQ", "StringJoin", "Interpolate"}


def atom(x: Any) -> bool:
    return isinstance(x, (bool, int, float, str))


def number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def fold(head: str, xs: list) -> Any:
    """Constants now; whole numbers divide towards zero."""
    if head == "Plus":
        return reduce(lambda a, b: a + b, xs)
    if head == "Times":
        return reduce(lambda a, b: a * b, xs)
    if head == "Minus":
        return reduce(lambda a, b: a - b, xs)
    if head == "Divide":

        def div(a, b):
            if isinstance(a, int) and isinstance(b, int):
                q = abs(a) // abs(b)
                return q if (a < 0) == (b < 0) else -q
            return a / b

        return reduce(div, xs)
    return xs[0] > xs[1] if head == "Greater" else xs[0] == xs[1]


def compile_scalar(x: Any, df: DataFrame, env: Env) -> Any:
    """A Column over `df`, or the atom itself."""
    if isinstance(x, Sym):
        if x.name not in df.columns:
            raise KeyError(f"unknown symbol in an expression: {x.name}")
        return R.column(df, x.name)
    if atom(x) or isinstance(x, Column):
        return x
    if not isinstance(x, Node) or x.head not in SCALAR:
        raise NotReady(x)
    args = [compile_scalar(a, df, env) for a in x.args if not (isinstance(a, Node) and a.head == "PredicateID")]
    match x.head:
        case "Plus":
            return S.plus(*args)
        case "Times":
            return S.times(*args)
        case "Minus":
            return S.minus(*args)
        case "Divide":
            return S.divide(df, *args)
        case "Greater":
            return S.greater(df, *args, env.literal_mode)
        case "Equal":
            return S.equal(df, *args, env.literal_mode)
        case "And":
            return S.and_(*map(S.as_column, args))
        case "Year":
            return S.year_exact(args[0], S.integral(S.type_of(df, args[0])))
        case "YearApprox":
            return S.year_approx(args[0])
        case "StringContainsQ":
            return S.string_contains(*args)
        case "StringJoin":
            return S.string_join(*args)
        case "Interpolate":
            return S.interpolate(args[0], args[1] if len(args) > 1 else args[0])
    raise NotReady(x)


def predicate(where: Any, df: DataFrame, env: Env) -> Column:
    p = where.args[0] if isinstance(where, Node) and where.head == "Where" else where
    if isinstance(p, Node) and p.head == "Function" and len(p.args) == 1 and isinstance(p.args[0], bool):
        return F.lit(p.args[0])
    if isinstance(p, bool):
        return F.lit(p)
    if not isinstance(p, Node):
        raise NotReady(p)
    return S.as_column(compile_scalar(p, df, env))


def pairs(node: Node) -> list[tuple[str, Any]]:
    if node.head != "As" or len(node.args) % 2:
        raise NotReady(node)
    return [(a.name if isinstance(a, Sym) else a, b) for a, b in zip(node.args[::2], node.args[1::2], strict=True)]


def rows_of(x: Any) -> list:
    """The values of a List, its chunks joined."""
    if isinstance(x, Node) and x.head == "DictionaryEncodedList":
        ends, blob = rows_of(x.args[0]), x.args[1]
        return [blob[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    if isinstance(x, Node) and x.head in ("List", "Span"):
        return [v for a in x.args for v in (rows_of(a) if isinstance(a, Node) else [a])]
    raise NotReady(x)


def literal_table(node: Node, env: Env) -> DataFrame:
    cols = {}
    for c in node.args:
        if not isinstance(c, Node):
            raise NotReady(node)
        if c.head == "Index":
            continue
        if c.head == "Column":
            cols[c.args[0].name] = rows_of(c.args[1])
        else:
            cols[c.head] = [v for a in c.args for v in rows_of(a)]
    return table_literal(env.spark, cols)


def chunks_of(table: Any) -> dict[str, list[list]]:
    """Column name -> its chunks, of a literal table."""
    if not isinstance(table, Node) or table.head != "Table":
        raise NotReady(table)
    out = {}
    for c in table.args:
        name, lists = (c.args[0].name, c.args[1:]) if c.head == "Column" else (c.head, c.args)
        parts = [a for x in lists for a in ([s for s in x.args] if x.args and all(isinstance(s, Node) for s in x.args) else [x])]
        out[name] = [rows_of(x) for x in parts]
    return out


def indexed_table(args: tuple, env: Env) -> DataFrame:
    """A join result given as two tables and a list of row places for either: chunk number times 2^32, plus the row in it.

    Where names meet, the left table's column stays.
    """
    cols: dict[str, list] = {}
    for table, places in zip(args[::2], args[1::2], strict=True):
        at = [divmod(p, 1 << 32) for p in rows_of(places)]
        for name, chunks in chunks_of(table).items():
            cols.setdefault(name, [chunks[c][i] for c, i in at])
    return table_literal(env.spark, cols)


def relation(x: Any, env: Env) -> DataFrame:
    if isinstance(x, DataFrame):
        return moved(x, env.spark)
    if isinstance(x, Sym) and x.name in env.tables:
        return moved(env.tables[x.name], env.spark)
    if (p := deferred(x)) is not None:
        df = relation(x.args[0], env)
        return R.select(df, predicate(p, df, env))
    raise NotReady(x)


def deferred(x: Any) -> Any:
    """The predicate of Gather(relation, Selection(predicate)), which a deferred Select comes out as; None for anything else."""
    if isinstance(x, Node) and x.head == "Gather" and len(x.args) == 2 and isinstance(x.args[1], Node) and x.args[1].head == "Selection":
        return x.args[1].args[0]
    return None


def by(node: Node) -> list[tuple[str, bool]]:
    """By(a, b, desc): the symbol desc belongs to the column before it."""
    out: list[tuple[str, bool]] = []
    for a in node.args:
        if a.name == "desc" and out:
            out[-1] = (out[-1][0], True)
        else:
            out.append((a.name, False))
    return out


def aggregate(x: Any) -> tuple[Column, str]:
    """The aggregate and the name it has without As."""
    if x == Sym("Count") or x == Node("Count") or x == Node("Count", (Sym("*"),)) or x == Node("Count", ("*",)):
        return F.count(F.lit(1)), "Count"
    if isinstance(x, Node) and x.head in R.AGGREGATES and len(x.args) == 1 and isinstance(x.args[0], Sym):
        return R.AGGREGATES[x.head](F.col(R.quoted(x.args[0].name))), x.args[0].name
    raise NotReady(x)


def do_group(args: list, env: Env) -> DataFrame:
    df, keys, aggs = relation(args[0], env), [], {}
    for a in args[1:]:
        if isinstance(a, Node) and a.head == "By":
            keys += [k.name for k in a.args]
        elif isinstance(a, Node) and a.head == "Function":
            keys.append(F.lit(a.args[0]).alias("Function"))
        elif isinstance(a, Node) and a.head == "As":
            aggs |= {n: aggregate(x)[0] for n, x in pairs(a)}
        else:
            c, n = aggregate(a)
            aggs[n] = c
    if not aggs:
        raise ValueError("nothing to aggregate")
    for k in keys:
        if isinstance(k, str) and k not in df.columns:
            raise KeyError(f"no such column: {k}")
    if env.settings.options["GroupMode"] == "Sort" and keys:
        df = df.sortWithinPartitions(*[R.column(df, k) for k in keys if isinstance(k, str)] or keys)
    return R.group(df, [R.column(df, k) if isinstance(k, str) else k for k in keys], aggs)


def do_join(head: str, args: list, env: Env) -> DataFrame:
    left, right, where = relation(args[0], env), relation(args[1], env), args[2]
    eq = where.args[0] if isinstance(where, Node) and where.head == "Where" else where
    if not isinstance(eq, Node) or eq.head != "Equal":
        raise NotReady(eq)
    sides = [[k.name for k in s.args] if isinstance(s, Node) and s.head == "List" else [s.name] if isinstance(s, Sym) else None for s in eq.args]
    if None in sides or head == "PartitionedJoin" and (isinstance(eq.args[0], Node) or isinstance(eq.args[1], Node)):
        raise NotReady(eq)
    for df, keys in ((left, sides[0]), (right, sides[1])):
        for k in keys:
            if k not in df.columns:
                raise KeyError(f"no such column: {k}")
    if head == "PartitionedJoin":
        return R.partitioned_join(left, right, sides[0][0], sides[1][0])
    return R.join(left, right, *sides)


def apply(head: str, args: list, env: Env) -> Any:
    """The value of an operator over evaluated arguments."""
    if head in EXTRA:
        return EXTRA[head](args, env)
    if head in SCALAR:
        args = [a for a in args if not (isinstance(a, Node) and a.head == "PredicateID")]
        if head == "Plus" and len(args) == 1 and isinstance(args[0], Node) and args[0].head in ("List", "Span"):
            return fold("Plus", rows_of(args[0]))
        foldable = head in ARITHMETIC | {"Greater", "Equal"} and args and all(map(number, args))
        if foldable:
            return fold(head, args)
        if head == "StringJoin" and all(isinstance(a, str) for a in args):
            return "".join(args)
        raise NotReady
    match head:
        case "Table":
            return literal_table(Node(head, tuple(args)), env)
        case "Symbol":
            return Sym(args[0])
        case "DateObject":
            return S.date_days(args[0])
        case "Select":
            df = relation(args[0], env)
            p = predicate(args[1], df, env)
            if env.settings.options["DeferGatherPhase"]:
                return Node("Gather", (df, Node("Selection", (args[1],))))
            return R.select(df, p)
        case "Project":
            df = relation(args[0], env)
            out, named = {}, pairs(args[1])
            for i, (n, x) in enumerate(named):  # a mean of neighbours needs the order of all rows, so it is a step of its own
                if isinstance(x, Node) and x.head == "Interpolate" and all(isinstance(a, Sym) and a.name in df.columns for a in x.args):
                    name = f"__interpolated_{i}"
                    df = R.interpolate(df, x.args[0].name, x.args[-1].name, name)
                    named[i] = (n, Sym(name))
            for n, x in named:
                if isinstance(x, Sym) and x.name not in df.columns:
                    raise KeyError(f"no such column: {x.name}")
                out[n] = S.as_column(compile_scalar(x, df, env))
            return R.project(df, out)
        case "Group":
            return do_group(args, env)
        case "Join" | "PartitionedJoin":
            return do_join(head, args, env)
        case "Order" | "Sort":
            return R.order(relation(args[0], env), by(args[1]))
        case "Top":
            return R.top(relation(args[0], env), by(args[1]), args[2])
        case "Gather":  # of given row places it is left as it is: rows have none here
            node = Node(head, tuple(args))
            if len(args) == 1 or deferred(node) is not None:
                return relation(args[0] if len(args) == 1 else node, env)
        case "RadixPartition":
            df = relation(args[0], env)
            keys = [k.args[0].name for k in args[1:] if isinstance(k, Node) and k.head == "Partition" and k.args and isinstance(k.args[0], Sym)]
            return R.partition(df, keys[0]) if keys and keys[0] in df.columns else df
        case "Set":
            name = args[0].name if isinstance(args[0], Sym) else args[0]
            if not env.settings.knows(name):
                raise NotReady
            return env.settings.put(name, args[1] if len(args) > 1 else None)
    raise NotReady


def configured(env: Env, settings: Settings) -> Env:
    """The environment under these settings: with a session of their own where they ask for other Spark options."""
    conf = settings.spark_conf()
    return replace(env, settings=settings, spark=with_conf(env.spark, conf) if conf else env.spark)


def walk(x: Any, env: Env) -> Any:
    if not isinstance(x, Node):
        return x
    if x.head == "Let":
        for option in x.args[1:]:
            if isinstance(option, Node) and option.head == "Parallel":
                env = configured(env, env.settings.with_parallel(int(option.args[0])))
            elif not (isinstance(option, Node) and option.head == "Stats"):
                raise ValueError(f"Let has no option {option}")
        return walk(x.args[0], env)
    if x.head == "TableIndexed" and len(x.args) == 4:
        try:
            return indexed_table(x.args, env)
        except NotReady:
            pass
    args = [walk(a, env) for a in x.args]
    try:
        return apply(x.head, args, env)
    except NotReady:
        return Node(x.head, tuple(args))


def evaluate(
    x: Any, spark: SparkSession, tables: dict[str, DataFrame] | None = None, settings: Settings | None = None, *, literal_mode: str = "narrow", on_error: str = "raise"
) -> Any:
    """Evaluate a tree. on_error="expr": an error becomes ErrorWhenEvaluatingExpression(expression, message)."""
    try:
        settings = settings or Settings()
        return walk(x, configured(Env(spark, tables or {}, settings, literal_mode), settings))
    except Exception as e:
        if on_error == "raise":
            raise
        return Node("ErrorWhenEvaluatingExpression", (x, str(e.args[0] if e.args else e)))
