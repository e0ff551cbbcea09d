"""A query object to a DataFrame. Names are resolved here; everything after that is left to Catalyst and AQE."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flatsql.errors import QueryError
from flatsql.functions import scalar
from flatsql.functions.kernel import Value, kind_of, num, ts, txt
from flatsql.operators import aggregates
from flatsql.operators.ordering import sort_keys
from flatsql.operators.predicates import predicate
from flatsql.plans.ast import Call, Case, Expr, Item, Join, Literal, Logic, Name, Not, Query, Source, Star

Resolver = Callable[[str], DataFrame]
#: Column metadata by which sinks know values that always show a decimal point.
DECIMALS = {"decimals": True}


@dataclass(frozen=True)
class Field:
    """A source's column: as it is called, as whose, and under what name it stands in the joined frame."""

    name: str
    owner: str
    value: Value


class Scope:
    """The columns that names can mean."""

    def __init__(self, fields: list[Field]):
        self.fields = fields

    def find(self, name: Name) -> Value:
        return self.field(name).value

    def field(self, name: Name) -> Field:
        named = [f for f in self.fields if f.name.lower() == name.name.lower() and (name.qualifier is None or f.owner.lower() == name.qualifier.lower())]
        if not named:
            raise QueryError(f"column not found: {name}")
        if len(named) > 1:
            raise QueryError(f"ambiguous column: {name}")
        return named[0]

    def has(self, name: Name) -> bool:
        return any(f.name.lower() == name.name.lower() and (name.qualifier is None or f.owner.lower() == name.qualifier.lower()) for f in self.fields)


def plan(query: Query, resolve: Resolver) -> DataFrame:
    return _Planner(query, resolve).build()


def _is_aggregate(expr: Expr) -> bool:
    return isinstance(expr, Call) and expr.name in aggregates.NAMES


def _children(expr: Expr) -> list[Expr]:
    if isinstance(expr, Call):
        return list(expr.args)
    if isinstance(expr, Case):
        return [x for w in expr.whens for x in w] + ([expr.otherwise] if expr.otherwise else [])
    if isinstance(expr, Logic):
        return list(expr.items)
    if isinstance(expr, Not):
        return [expr.inner]
    return [x for x in (getattr(expr, "left", None), getattr(expr, "right", None), getattr(expr, "value", None)) if isinstance(x, Expr)]


def _aggregates(expr: Expr) -> list[Call]:
    if _is_aggregate(expr):
        return [expr]
    return [a for x in _children(expr) for a in _aggregates(x)]


def is_grouped(query: Query) -> bool:
    return bool(query.group_by or query.having or any(_aggregates(i.expr) for i in query.items))


def _renamed(expr: Expr, name: Callable[[Name], Expr]) -> Expr:
    """The expression with name() in place of each name, however deep it stands."""

    def inner(x: object) -> object:
        if isinstance(x, Expr):
            return _renamed(x, name)
        return tuple(map(inner, x)) if isinstance(x, tuple) else x

    return name(expr) if isinstance(expr, Name) else replace(expr, **{f.name: inner(getattr(expr, f.name)) for f in fields(expr)})


class _Planner:
    def __init__(self, query: Query, resolve: Resolver):
        self.query, self.resolve = query, resolve

    # sources

    def build(self) -> DataFrame:
        q = self.query
        df, scope = self._sources()
        base = lambda e: self.value(e, scope)
        if q.where is not None:
            if _aggregates(q.where):
                raise QueryError("aggregates belong in HAVING")
            df = df.where(predicate(q.where, base))
        items = self._expand(scope)
        grouped = is_grouped(q)
        value = base
        if grouped:
            df, value = self._aggregate(df, scope, items)
        named = [(self._name(i, scope), value(i.expr)) for i in items]
        if q.having is not None:
            df = df.where(predicate(q.having, self._outputs_first(named, items, value)))
        return self._finish(df, named, items, value)

    def _load(self, source: Source, prefix: str | None) -> tuple[DataFrame, list[Field]]:
        df = self.resolve(source.path)
        names = [c.lower() for c in df.columns]
        if len(set(names)) < len(names):
            raise QueryError(f"{source.path} has columns of the same name")
        inner = [f"{prefix}{i}" if prefix else c for i, c in enumerate(df.columns)]
        owner = source.alias or source.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        kinds = [kind_of(f.dataType) for f in df.schema.fields]
        fields = [Field(c, owner, Value(F.col(f"`{n}`"), k)) for c, n, k in zip(df.columns, inner, kinds, strict=True)]
        return (df.toDF(*inner) if prefix else df), fields

    def _sources(self) -> tuple[DataFrame, Scope]:
        q = self.query
        if not q.joins:
            df, fields = self._load(q.source, None)
            return df, Scope(fields)
        df, fields = self._load(q.source, "s0_")
        for n, join in enumerate(q.joins, 1):
            right, more = self._load(join.source, f"s{n}_")
            if any(f.owner.lower() == more[0].owner.lower() for f in fields if more):
                raise QueryError(f"two sources are called {more[0].owner}")
            df = df.join(right, self._condition(join, Scope(fields), Scope(more)), "inner")
            fields = [*fields, *more]
        return df, Scope(fields)

    def _condition(self, join: Join, left: Scope, right: Scope) -> Column:
        """The equality, either side first. Columns of one kind compare as they are, dates and times as times, others as text."""
        a, b = join.left, join.right
        if not (left.has(a) and right.has(b)):
            a, b = b, a
        x, y = left.find(a), right.find(b)
        if x.kind == y.kind or (x.numeric and y.numeric):
            return x.column == y.column
        if x.temporal and y.temporal:
            return ts(x) == ts(y)
        return txt(x) == txt(y)

    # expressions

    def value(self, expr: Expr, scope: Scope) -> Value:
        if isinstance(expr, Name):
            return scope.find(expr)
        return self._computed(expr, lambda e: self.value(e, scope))

    def _computed(self, expr: Expr, value: Callable[[Expr], Value]) -> Value:
        if isinstance(expr, Literal):
            n = expr.number()
            quoted = expr.text.startswith("'")
            return Value(F.lit(expr.value), "text") if n is None or quoted else Value(F.lit(n), "int" if isinstance(n, int) else "real")
        if isinstance(expr, Case):
            return self._case(expr, value)
        if isinstance(expr, Call):
            if _is_aggregate(expr):
                raise QueryError(f"an aggregate cannot stand here: {expr.text}")
            if expr.distinct:
                raise QueryError(f"DISTINCT cannot stand here: {expr.text}")
            return scalar.call(expr.name, [a if isinstance(a, Literal) else value(a) for a in expr.args])
        if isinstance(expr, Star):
            raise QueryError("* cannot stand here")
        raise QueryError(f"not a value: {expr.text}")

    def _case(self, expr: Case, value: Callable[[Expr], Value]) -> Value:
        branches = [value(v) for _, v in expr.whens] + ([value(expr.otherwise)] if expr.otherwise else [])
        numeric = all(b.numeric for b in branches)
        # Text columns among numbers are read as numbers; what is none counts 0.
        mixed = not numeric and any(b.numeric for b in branches)
        read = (lambda v: F.coalesce(num(v), F.lit(0.0)) if v.kind == "text" else v.column) if mixed else (lambda v: v.column)
        out = F
        for (condition, _), branch in zip(expr.whens, branches, strict=False):
            out = out.when(predicate(condition, value), read(branch))
        if expr.otherwise:
            out = out.otherwise(read(branches[-1]))
        kind = "real" if mixed or (numeric and any(b.kind == "real" for b in branches)) else branches[0].kind
        return Value(out, kind)

    # select list

    def _expand(self, scope: Scope) -> list[Item]:
        out: list[Item] = []
        for item in self.query.items:
            if not isinstance(item.expr, Star):
                out.append(item)
            elif self.query.group_by:  # the keys only
                out.extend(Item(g, None) for g in self.query.group_by)
            else:
                joined = bool(self.query.joins)
                out.extend(Item(Name(f.name, f.owner if joined else None, text=f.name), f.name.lower() if joined else f.name) for f in scope.fields)
        return out

    def _name(self, item: Item, scope: Scope) -> str:
        if item.alias:
            return item.alias
        if isinstance(item.expr, Name) and scope.has(item.expr):
            return scope.field(item.expr).name
        return item.expr.text

    def _alias_of(self, expr: Expr) -> Expr | None:
        """What a bare name stands for in the select list."""
        if isinstance(expr, Name) and expr.qualifier is None:
            return next((i.expr for i in self.query.items if i.alias and i.alias.lower() == expr.name.lower()), None)
        return None

    # aggregation

    def _aggregate(self, df: DataFrame, scope: Scope, items: list[Item]) -> tuple[DataFrame, Callable[[Expr], Value]]:
        q = self.query
        keys: list[tuple[Expr, Value]] = []
        for expr in q.group_by:
            target = expr if not (isinstance(expr, Name) and not scope.has(expr)) else self._alias_of(expr) or expr
            if isinstance(target, Literal) and isinstance(target.number(), int) and 1 <= target.number() <= len(items):
                target = items[target.number() - 1].expr
            if _aggregates(target):
                raise QueryError(f"cannot group by an aggregate: {expr.text}")
            keys.append((self._canonical(target, scope), self.value(target, scope)))
        wanted: dict[Expr, Call] = {}
        havings = [q.having] if q.having is not None else []
        for expr in [i.expr for i in items] + havings + [o.expr for o in q.order_by]:
            for call in _aggregates(expr):
                wanted.setdefault(self._canonical(call, scope), call)
        made: dict[Expr, Value] = {}
        for n, (canonical, call) in enumerate(wanted.items()):
            if len(call.args) != 1:
                raise QueryError(f"{call.name} takes one argument")
            arg = call.args[0]
            inner = None if isinstance(arg, Star) else self.value(arg, scope)
            if call.name in ("SUM", "AVG") and isinstance(arg, Case) and arg.otherwise and inner.kind == "text":
                inner = Value(F.coalesce(num(inner), F.lit(0.0)), "real")
            made[canonical] = aggregates.aggregate(call.name, inner, call.distinct)
        columns = [v.column.alias(f"__a{n}") for n, v in enumerate(made.values())]
        grouped = [v.column.alias(f"__g{n}") for n, (_, v) in enumerate(keys)]
        if keys and not columns:
            df = df.select(*grouped).distinct()
        else:
            df = df.groupBy(*grouped).agg(*columns) if keys else df.agg(*(columns or [F.count(F.lit(1)).alias("__a0")]))
        known = {c: Value(F.col(f"__a{n}"), v.kind) for n, (c, v) in enumerate(made.items())}
        known |= {c: Value(F.col(f"__g{n}"), v.kind, v.decimals) for n, (c, v) in enumerate(keys)}

        def value(expr: Expr) -> Value:
            found = known.get(self._canonical(expr, scope))
            if found is not None:
                return found
            if isinstance(expr, Name):
                target = None if scope.has(expr) else self._alias_of(expr)
                if target is not None:
                    return value(target)
                scope.find(expr)
                raise QueryError(f"{expr} is neither grouped by nor aggregated")
            return self._computed(expr, value)

        return df, value

    def _canonical(self, expr: Expr, scope: Scope) -> Expr:
        """Names resolved to their source, so that a, t.a and A are one."""

        def resolved(name: Name) -> Name:
            if scope.has(name):
                f = scope.field(name)
                return Name(f.name.lower(), f.owner.lower())
            return Name(name.name.lower(), name.qualifier and name.qualifier.lower())

        return _renamed(expr, resolved)

    def _outputs_first(self, named: list[tuple[str, Value]], items: list[Item], value: Callable[[Expr], Value]) -> Callable[[Expr], Value]:
        def find(expr: Expr) -> Value:
            text = str(expr) if isinstance(expr, Name) else expr.text
            hit = [v for n, v in named if n.lower() == text.lower()]
            return hit[0] if hit else value(expr)

        return find

    # output

    def _finish(self, df: DataFrame, named: list[tuple[str, Value]], items: list[Item], value: Callable[[Expr], Value]) -> DataFrame:
        q = self.query
        out = [v.column.alias(f"__o{n}") for n, (_, v) in enumerate(named)]
        known = {f"__o{n}": v.kind for n, (_, v) in enumerate(named)}
        orders: list[tuple[Value, bool]] = []
        hidden: list[Column] = []
        for order in q.order_by:
            at = self._output_of(order.expr, named, items)
            if at is not None:
                orders.append((Value(F.col(f"__o{at}"), known[f"__o{at}"]), order.descending))
                continue
            if q.distinct:
                raise QueryError(f"with DISTINCT, ORDER BY takes selected columns: {order.expr.text}")
            v = value(order.expr)
            hidden.append(v.column.alias(f"__h{len(hidden)}"))
            orders.append((Value(F.col(f"__h{len(hidden) - 1}"), v.kind), order.descending))
        df = df.select(*out, *hidden)
        if q.distinct:
            df = df.distinct()
        if orders:
            df = df.orderBy(*[k for v, down in orders for k in sort_keys(v, down)])
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*[F.col(f"__o{n}").alias(name, metadata=DECIMALS) if v.decimals else F.col(f"__o{n}").alias(name) for n, (name, v) in enumerate(named)])

    def _output_of(self, expr: Expr, named: list[tuple[str, Value]], items: list[Item]) -> int | None:
        """By position, then by output name or text."""
        if isinstance(expr, Literal):
            n = expr.number()
            if not isinstance(n, int) or not 1 <= n <= len(named):
                raise QueryError(f"no column {expr.value} to order by")
            return n - 1
        text = expr.name if isinstance(expr, Name) and expr.qualifier is None else str(expr) if isinstance(expr, Name) else expr.text
        for n, ((name, _), item) in enumerate(zip(named, items, strict=True)):
            if name.lower() == text.lower() or item.expr.text.lower() == text.lower():
                return n
        return None
