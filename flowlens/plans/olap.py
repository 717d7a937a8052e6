"""OLAP requests as DataFrames (projection, filters, joins, grouping, unions, order, limit).

Joins do not multiply copies of a key. A request with metrics first aggregates every joined input to its
join keys, dimensions and partial sums, and carries the number of rows each partial stands for. Where a
request without metrics is limited, of the rows that agree on all join columns only the first ``limit`` in
the requested order can matter; the rest go before the join. Where the order begins with an input whose every
row has a result, only its first ``limit`` rows and their ties go into the join. All are exact.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from decimal import Decimal, InvalidOperation
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.plans.catalog import Catalog
from flowlens.plans.request import Branch, Filter, Join, Metric, OlapRequest, OrderBy, RequestError

COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}


# --------------------------------------------------------------------------- predicates


def literal(value: Any, dtype: T.DataType) -> Column:
    """A request value as a literal of the column's type.

    A fraction compared with an integer column stays a fraction, so that ``x > 1.5`` keeps its meaning.
    """
    if value is None:
        return F.lit(None).cast(dtype)
    if isinstance(value, bool):
        return F.lit(value) if isinstance(dtype, T.BooleanType) else F.lit(int(value)).cast(dtype)
    if isinstance(dtype, T.IntegralType):
        try:
            number = value if isinstance(value, int) else float(value)
        except ValueError as err:
            raise RequestError(f"{value!r} is no number") from err
        if isinstance(number, float):
            if not number.is_integer():
                return F.lit(number)
            number = int(value) if isinstance(value, str) and value.strip().lstrip("+-").isdigit() else int(number)
        low, high = INTEGRAL_RANGE[dtype.typeName()]
        return F.lit(number).cast(dtype) if low <= number <= high else F.lit(float(number))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        try:
            return F.lit(float(value)).cast(dtype)
        except ValueError as err:
            raise RequestError(f"{value!r} is no number") from err
    if isinstance(dtype, T.DecimalType):
        try:
            number = Decimal(str(value).strip())
        except InvalidOperation as err:
            raise RequestError(f"{value!r} is no number") from err
        if not number.is_finite():
            raise RequestError(f"{value!r} is no number")
        # The literal keeps its own digits: 10.005 lies between the values of a column with two decimals.
        digits, scale = len(number.as_tuple().digits), max(0, -number.as_tuple().exponent)
        whole = max(0, digits + min(0, number.as_tuple().exponent)) + max(0, number.as_tuple().exponent)
        if whole + scale > 38 - max(0, dtype.scale - scale):
            return F.lit(float(number))
        return F.lit(format(number, "f")).cast(T.DecimalType(max(1, whole + scale), scale))
    return F.lit(value).cast(dtype)


def comparable(column: Column, dtype: T.DataType, values: list) -> tuple[Column, T.DataType]:
    """The column and type to compare ``values`` in: a date meets a time of day as the timestamp it begins with."""
    if isinstance(dtype, T.DateType) and any(isinstance(v, str) and not _DAY.fullmatch(v.strip()) for v in values):
        return column.cast("timestamp"), T.TimestampType()
    return column, dtype


_DAY = re.compile(r"\d{4}-\d{1,2}-\d{1,2}")


INTEGRAL_RANGE = {
    name: (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    for name, bits in (("byte", 8), ("short", 16), ("integer", 32), ("long", 64))
}


def predicate(column: Column, dtype: T.DataType, f: Filter) -> Column:
    """One filter as a boolean column."""
    if f.op == "is_null":
        return column.isNull()
    if f.op == "is_not_null":
        return column.isNotNull()
    if f.op in ("in", "not_in"):
        values = f.value if isinstance(f.value, list) else [f.value]
        if not values:
            return F.lit(f.op == "not_in")
        column, dtype = comparable(column, dtype, values)
        inside = column.isin(*[literal(v, dtype) for v in values])
        return inside if f.op == "in" else ~inside
    if f.op in ("like", "ilike"):
        if not isinstance(f.value, str):
            raise RequestError(f"{f.op} needs a text pattern")
        text = column.cast("string")
        return text.like(f.value) if f.op == "like" else text.ilike(f.value)
    column, dtype = comparable(column, dtype, [f.value])
    return COMPARE[f.op](column, literal(f.value, dtype))


def apply_filters(df: DataFrame, filters: list[Filter] | list[dict]) -> DataFrame:
    """AND of filters over the columns of one DataFrame."""
    for f in filters:
        f = f if isinstance(f, Filter) else Filter.parse(f)
        if f.field not in df.columns:
            raise RequestError(f"no column {f.field!r}")
        df = df.filter(predicate(F.col(f.field), df.schema[f.field].dataType, f))
    return df


# --------------------------------------------------------------------------- metrics


def check_metric(m: Metric, dtype: T.DataType) -> None:
    """A4, A5: sums and averages are of numbers."""
    if m.agg in ("sum", "avg") and not isinstance(dtype, T.NumericType):
        raise RequestError(f"{m.agg} needs a number column; {m.field!r} is {dtype.simpleString()}")


def aggregate(m: Metric, column: Column | None) -> Column:
    """A1 to A7 over one input."""
    if m.agg == "count":
        return F.count(F.lit(1) if column is None else column)
    return {
        "count_distinct": F.count_distinct, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    }[m.agg](column)


# --------------------------------------------------------------------------- inputs of a branch


@dataclass(eq=False)
class Side:
    """One input of a branch; its columns are renamed ``alias__column`` so that names never clash."""

    alias: str
    collection: str
    catalog: Catalog
    types: dict[str, T.DataType]
    early: list[Filter] = field(default_factory=list)
    late: list[Filter] = field(default_factory=list)
    link: set[str] = field(default_factory=set)  # join columns
    dims: set[str] = field(default_factory=set)
    measures: set[str] = field(default_factory=set)
    distinct: set[str] = field(default_factory=set)
    order: list[OrderBy] = field(default_factory=list)

    def own(self, column: str) -> str:
        return f"{self.alias}__{column}"

    def filtered(self) -> DataFrame:
        return apply_filters(self.catalog.view(self.collection, self.early), self.early)


def _side(catalog: Catalog, collection: str, alias: str) -> Side:
    schema = catalog.view(collection).schema
    return Side(alias, collection, catalog, {f.name: f.dataType for f in schema.fields})


class Scope:
    """Name lookup over the base and the joins: the base first, then the joins in order."""

    def __init__(self, sides: list[Side]):
        self.sides = sides

    def find(self, name: str) -> tuple[Side, str]:
        if "." in name:
            alias, column = name.split(".")
            for side in self.sides:
                if side.alias == alias:
                    if column in side.types:
                        return side, column
                    raise RequestError(f"no column {column!r} in {alias!r}")
            raise RequestError(f"no input has the alias {alias!r}")
        if name in self.sides[0].types:
            return self.sides[0], name
        found = [side for side in self.sides[1:] if name in side.types]
        if not found:
            raise RequestError(f"no column {name!r}")
        if len(found) > 1:
            raise RequestError(f"column {name!r} is in several joins; qualify it")
        return found[0], name


def _output_names(scope: Scope, dims: tuple[str, ...]) -> list[tuple[Side, str, str]]:
    """(input, column, output name); a name two inputs share is written ``alias_column``."""
    found = [scope.find(d) for d in dims]
    plain = [column for _, column in found]
    return [
        (side, column, column if plain.count(column) == 1 else f"{side.alias}_{column}")
        for side, column in found
    ]


def _star(scope: Scope) -> list[tuple[Side, str, str]]:
    """All columns: the base's by their name, a join's too unless the name is taken."""
    out, taken = [], set()
    for side in scope.sides:
        for column in side.types:
            name = column if column not in taken else f"{side.alias}_{column}"
            taken.add(name)
            out.append((side, column, name))
    return out


# --------------------------------------------------------------------------- one branch


def _top(df: DataFrame, keys: list[tuple[str, bool]], limit: int | None) -> DataFrame:
    """O1, O2: NULLs last in both directions, then the limit, if any."""
    if keys:
        df = df.orderBy(*[F.desc_nulls_last(k) if desc else F.asc_nulls_last(k) for k, desc in keys])
    return df if limit is None else df.limit(limit)


def _single(catalog: Catalog, branch: Branch) -> DataFrame:
    """A branch without joins: filter, then project or aggregate."""
    scope = Scope([_side(catalog, branch.collection, branch.alias)])
    scope.sides[0].early += [replace(f, field=scope.find(f.field)[1]) for f in branch.filters]
    df = scope.sides[0].filtered()
    dims = [(F.col(column), name) for _, column, name in _output_names(scope, branch.dimensions)]
    metrics = []
    for m in branch.metrics:
        side, column = (None, None) if m.field == "*" else scope.find(m.field)
        if side:
            check_metric(m, side.types[column])
        metrics.append(aggregate(m, F.col(column) if side else None).alias(m.alias))
    if metrics and dims:
        return df.groupBy(*[c.alias(n) for c, n in dims]).agg(*metrics)
    if metrics:
        return df.agg(*metrics)
    return df.select(*[c.alias(n) for c, n in dims]) if dims else df


def _sides(catalog: Catalog, branch: Branch) -> list[Side]:
    inputs = [(branch.collection, branch.alias)] + [(j.collection, j.alias) for j in branch.joins]
    return [_side(catalog, collection, alias) for collection, alias in inputs]


def _place_filters(branch: Branch, scope: Scope) -> None:
    """Give every filter to its input, before the join where that is the same as WHERE after it.

    That holds for all inputs when no join is outer, and for the base when it is never null-extended.
    """
    kinds = {j.kind for j in branch.joins}
    placed = [(f, None) for f in branch.filters] + [(f, j.alias) for j in branch.joins for f in j.filters]
    for f, alias in placed:
        name = f.field if alias is None or "." in f.field else f"{alias}.{f.field}"
        side, column = scope.find(name)
        before = kinds <= {"inner", "cross"} or (side is scope.sides[0] and kinds <= {"inner", "cross", "left"})
        (side.early if before else side.late).append(replace(f, field=column))


def _links(branch: Branch, scope: Scope) -> list[list[tuple[Side, str, Side, str]]]:
    """Per join the (left input, column, right input, column) pairs."""
    links = []
    for position, join in enumerate(branch.joins, start=1):
        visible = Scope(scope.sides[:position])
        pairs = []
        for on in join.on:
            left, left_column = visible.find(on.left)
            right = scope.sides[position]
            if on.right not in right.types:
                raise RequestError(f"no column {on.right!r} in {join.alias!r}")
            left.link.add(left_column)
            right.link.add(on.right)
            pairs.append((left, left_column, right, on.right))
        links.append(pairs)
    return links


def _fold(branch: Branch, frames: list[DataFrame], links) -> DataFrame:
    """The joins in the order written; the strategy is Spark's choice."""
    df = frames[0]
    for join, frame, pairs in zip(branch.joins, frames[1:], links, strict=True):
        if join.kind == "cross":
            df = df.crossJoin(frame)
            continue
        on = reduce(lambda a, b: a & b, [F.col(l.own(lc)) == F.col(r.own(rc)) for l, lc, r, rc in pairs])
        df = df.join(frame, on, join.kind)
    return df


def _late(df: DataFrame, scope: Scope) -> DataFrame:
    """WHERE after an outer join, so a filter on the null-extended input drops unmatched rows."""
    for side in scope.sides:
        for f in side.late:
            df = df.filter(predicate(F.col(side.own(f.field)), side.types[f.field], f))
    return df


def _missing(scope: Scope, branch: Branch) -> set[str]:
    """Aliases whose rows may be null-extended."""
    out: set[str] = set()
    seen = [scope.sides[0].alias]
    for join in branch.joins:
        if join.kind in ("right", "full"):
            out.update(seen)
        if join.kind in ("left", "full"):
            out.add(join.alias)
        seen.append(join.alias)
    return out


def _zero(dtype: T.DataType) -> Column:
    """The default an outer-join miss takes with ``fill_defaults``: '' or 0."""
    if isinstance(dtype, T.StringType):
        return F.lit("")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01 00:00:00").cast(dtype)
    if isinstance(dtype, T.NumericType):
        return F.lit(0).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return F.lit(False)
    return F.lit(None).cast(dtype)


def _first_rows(df: DataFrame, keys: list[tuple[str, bool]], limit: int) -> DataFrame:
    """The first ``limit`` rows in the order of ``keys`` (name, descending; NULLs last), and all ties of the last."""
    rank = [F.desc_nulls_last(k) if desc else F.asc_nulls_last(k) for k, desc in keys]
    back = [F.asc_nulls_first(k) if desc else F.desc_nulls_first(k) for k, desc in keys]
    names = [k for k, _ in keys]
    last = df.select(*names).orderBy(*rank).limit(limit).orderBy(*back).limit(1)
    last = last.select(*[F.col(k).alias(f"_last_{i}") for i, k in enumerate(names)])
    within = F.lit(True)
    for i, (k, desc) in reversed(list(enumerate(keys))):
        own, end = F.col(k), F.col(f"_last_{i}")
        ahead = own.isNotNull() & (end.isNull() | ((own > end) if desc else (own < end)))
        within = F.coalesce(ahead, F.lit(False)) | (own.eqNullSafe(end) & within)
    return df.join(F.broadcast(last), within).select(*df.columns)  # one row


def _lead(branch: Branch, scope: Scope, keys: list[tuple[Side, str, bool]]) -> tuple[int, int] | None:
    """The input that the order begins with and for how many keys, if each of its matched rows has a result."""
    kinds = {j.kind for j in branch.joins}
    side = keys[0][0] if keys else scope.sides[0]
    at = scope.sides.index(side)
    if kinds != {"inner"} and (at or not kinds <= {"inner", "left"} or "inner" in kinds or any(s.late for s in scope.sides)):
        return None
    own = 0
    while own < len(keys) and keys[own][0] is side:
        own += 1
    return at, own


def _joined_rows(
    branch: Branch, scope: Scope, links, order: list[OrderBy], limit: int | None, fill: bool
) -> DataFrame:
    """A join without metrics: at most ``limit`` rows per combination of join columns survive per input.

    Spark cuts each combination before the shuffle where its window-group limit allows. The input that the order
    begins with is also cut as a whole, after rows that have no partner are gone. Without a limit the rows are joined
    as they are, and a hot key is split by the adaptive skew join.
    """
    outputs = _output_names(scope, branch.dimensions) if branch.dimensions else _star(scope)
    keys: list[tuple[Side, str, bool]] = []
    by_output = {name: (side, column) for side, column, name in outputs}
    for o in order:
        side, column = by_output.get(o.field) or scope.find(o.field)
        side.order.append(OrderBy(column, o.descending))
        keys.append((side, column, o.descending))
    for side, column, _ in outputs:
        side.dims.add(column)

    missing = _missing(scope, branch)
    frames = []
    for side in scope.sides:
        needed = side.dims | side.link | {o.field for o in side.order} | {f.field for f in side.late}
        df = side.filtered().select(*[F.col(c).alias(side.own(c)) for c in sorted(needed)])
        same = sorted(side.own(c) for c in side.link | {f.field for f in side.late})
        rank = [
            F.desc_nulls_last(side.own(o.field)) if o.descending else F.asc_nulls_last(side.own(o.field))
            for o in side.order
        ]
        if limit is None:
            pass
        elif not same:
            df = (df.orderBy(*rank) if rank else df).limit(limit)
        else:
            window = Window.partitionBy(*same).orderBy(*(rank or [F.lit(1)]))
            df = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= limit).drop("_rank")
        if fill and side.alias in missing:
            df = df.withColumn(side.own("_here"), F.lit(True))
        frames.append(df)

    lead = _lead(branch, scope, keys) if limit is not None else None
    if lead:
        at, own = lead
        side, df = scope.sides[at], frames[at]
        if branch.joins[0].kind == "inner":
            linked = [f.select(*[s.own(c) for c in sorted(s.link)]).distinct() for s, f in zip(scope.sides, frames)]
            partners = _fold(branch, linked, links).select(*linked[at].columns).distinct()
            df = df.join(partners, linked[at].columns, "left_semi")
        order_keys = [(side.own(c), desc) for _, c, desc in keys[:own]]
        frames[at] = _first_rows(df, order_keys, limit) if own < len(keys) else _top(df, order_keys, limit)

    df = _fold(branch, frames, links)
    if fill:
        df = df.withColumns({
            side.own(c): F.when(F.col(side.own("_here")).isNull(), _zero(side.types[c])).otherwise(F.col(side.own(c)))
            for side in scope.sides if side.alias in missing
            for c in side.types if side.own(c) in df.columns
        })
    df = _late(df, scope)
    df = _top(df, [(side.own(column), desc) for side, column, desc in keys], limit)
    return df.select(*[F.col(side.own(column)).alias(name) for side, column, name in outputs])


def _joined_metrics(branch: Branch, scope: Scope, links, fill: bool) -> DataFrame:
    """A join with metrics: partial aggregates per input, joined, weighted by the rows they stand for."""
    outputs = _output_names(scope, branch.dimensions)
    for side, column, _ in outputs:
        side.dims.add(column)
    for m in branch.metrics:
        if m.field != "*":
            side, column = scope.find(m.field)
            check_metric(m, side.types[column])
            (side.distinct if m.agg == "count_distinct" else side.measures).add(column)

    missing = _missing(scope, branch)
    frames = []
    for side in scope.sides:
        group = sorted(side.link | side.dims | side.distinct | {f.field for f in side.late})
        parts = [F.count(F.lit(1)).alias(side.own("_rows"))]
        for c in sorted(side.measures):
            kinds = {m.agg for m in branch.metrics if m.field != "*" and scope.find(m.field) == (side, c)}
            if kinds & {"count", "avg"}:
                parts.append(F.count(c).alias(side.own(f"{c}_n")))
            if "sum" in kinds:
                parts.append(F.sum(c).alias(side.own(f"{c}_sum")))
            if "avg" in kinds:
                parts.append(F.sum(F.col(c).cast("double")).alias(side.own(f"{c}_total")))
            if "min" in kinds:
                parts.append(F.min(c).alias(side.own(f"{c}_min")))
            if "max" in kinds:
                parts.append(F.max(c).alias(side.own(f"{c}_max")))
        df = side.filtered()
        if group:
            df = df.groupBy(*[F.col(c).alias(side.own(c)) for c in group]).agg(*parts)
        else:
            # An input that only multiplies rows; an empty one contributes none.
            df = df.agg(*parts).filter(F.col(side.own("_rows")) > 0)
        frames.append(df)

    df = _fold(branch, frames, links)
    fills: dict[str, Column] = {}
    for side in scope.sides:
        if side.alias not in missing:
            continue
        absent = F.col(side.own("_rows")).isNull()
        if fill:
            for c in side.link | side.dims | side.distinct | {f.field for f in side.late}:
                fills[side.own(c)] = F.when(absent, _zero(side.types[c])).otherwise(F.col(side.own(c)))
            for c in side.measures:
                for suffix, value in (("n", F.lit(1)), ("sum", F.lit(0)), ("total", F.lit(0.0)),
                                      ("min", _zero(side.types[c])), ("max", _zero(side.types[c]))):
                    name = side.own(f"{c}_{suffix}")
                    if name in df.columns:
                        fills[name] = F.when(absent, value.cast(df.schema[name].dataType)).otherwise(F.col(name))
        fills[side.own("_rows")] = F.coalesce(F.col(side.own("_rows")), F.lit(1))
    if fills:
        df = df.withColumns(fills)
    df = _late(df, scope)

    def others(side: Side | None) -> Column:
        rest = [F.col(s.own("_rows")) for s in scope.sides if s is not side]
        return reduce(lambda a, b: a * b, rest, F.lit(1).cast("bigint"))

    metrics = []
    for m in branch.metrics:
        if m.field == "*":
            metrics.append(F.coalesce(F.sum(others(None)), F.lit(0)).alias(m.alias))
            continue
        side, c = scope.find(m.field)
        own = lambda suffix: F.col(side.own(f"{c}_{suffix}"))
        if m.agg == "count":
            value = F.coalesce(F.sum(own("n") * others(side)), F.lit(0))
        elif m.agg == "count_distinct":
            value = F.count_distinct(F.col(side.own(c)))
        elif m.agg == "sum":
            value = F.sum(own("sum") * others(side))
        elif m.agg == "avg":
            weight = others(side)
            value = F.try_divide(F.sum(own("total") * weight), F.sum(own("n") * weight))
        else:
            value = {"min": F.min, "max": F.max}[m.agg](own(m.agg))
        metrics.append(value.alias(m.alias))
    if outputs:
        return df.groupBy(*[F.col(s.own(c)).alias(n) for s, c, n in outputs]).agg(*metrics)
    return df.agg(*metrics)


def _branch(
    catalog: Catalog, branch: Branch, order: list[OrderBy], limit: int | None, fill: bool,
    ordered_here: bool,
) -> DataFrame:
    """One branch; orders and limits it itself where sort columns may be outside the output."""
    if not branch.joins:
        df = _single(catalog, branch)
        if not ordered_here:
            return df
        names = set(df.columns)
        if all(o.field in names for o in order):
            return _top(df, [(o.field, o.descending) for o in order], limit)
        if branch.metrics:
            raise RequestError(f"order_by must name output columns: {sorted(names)}")
        scope = Scope([_side(catalog, branch.collection, branch.alias)])
        whole = _single(catalog, replace(branch, dimensions=()))
        dims = _output_names(scope, branch.dimensions)
        by_output = {name: column for _, column, name in dims}
        whole = _top(whole, [
            (by_output.get(o.field) or scope.find(o.field)[1], o.descending) for o in order
        ], limit)
        return whole.select(*[F.col(column).alias(name) for _, column, name in dims])

    scope = Scope(_sides(catalog, branch))
    _place_filters(branch, scope)
    links = _links(branch, scope)
    if not branch.metrics:
        # Under a union the order names output columns, and the same bound holds per branch.
        if not ordered_here:
            outputs = {n for *_, n in (_output_names(scope, branch.dimensions) if branch.dimensions else _star(scope))}
            if not all(o.field in outputs for o in order):
                raise RequestError("order_by over a union must name output columns of the first branch")
        return _joined_rows(branch, scope, links, order, limit, fill)
    df = _joined_metrics(branch, scope, links, fill)
    if not ordered_here:
        return df
    names = set(df.columns)
    fields = [o.field.split(".")[-1] if o.field not in names else o.field for o in order]
    if not all(f in names for f in fields):
        raise RequestError(f"order_by must name output columns: {sorted(names)}")
    return _top(df, [(f, o.descending) for f, o in zip(fields, order, strict=True)], limit)


# --------------------------------------------------------------------------- requests


def effective_limit(catalog: Catalog, request: OlapRequest) -> int | None:
    """O2: the request's limit, at most the cap; a catalog without a cap leaves it to the request."""
    limits = [n for n in (request.limit, catalog.row_cap) if n is not None]
    return min(limits) if limits else None


def olap_query(catalog: Catalog, request: dict | OlapRequest, fill_defaults: bool = False) -> DataFrame:
    """The result of a request as a DataFrame of at most ``catalog.row_cap`` rows.

    Filters of a join are evaluated after it, so on a left join they drop unmatched rows. An outer-join
    miss is NULL; ``fill_defaults`` gives 0 or the empty string for it, and leaves a matched row's own NULLs.
    """
    req = request if isinstance(request, OlapRequest) else OlapRequest.parse(request)
    catalog.check(req.collections)
    limit = effective_limit(catalog, req)
    order = list(req.order_by)
    if not req.union_all:
        return _branch(catalog, req.main, order, limit, fill_defaults, ordered_here=True)

    branches = [_branch(catalog, req.main, order, limit, fill_defaults, ordered_here=False)]
    branches += [_single(catalog, b) for b in req.union_all]
    widths = {len(b.columns) for b in branches}
    if len(widths) > 1:
        raise RequestError(f"the union's branches have different numbers of columns: {sorted(widths)}")
    whole = reduce(DataFrame.union, branches)
    for o in order:
        if o.field not in whole.columns:
            raise RequestError(f"order_by over a union must name one of {whole.columns}")
    return _top(whole, [(o.field, o.descending) for o in order], limit)


def plan_text(df: DataFrame) -> str:
    """The optimized plan, for debugging a request."""
    return df._jdf.queryExecution().optimizedPlan().toString()


def olap_result(catalog: Catalog, request: dict, fill_defaults: bool = False) -> dict[str, Any]:
    """Run a request and wrap its rows. Collects at most ``catalog.row_cap`` rows, so it needs a cap.

    ``truncated`` (O3) compares with the cap, not with the request's own limit.
    """
    if catalog.row_cap is None:
        raise ValueError("olap_result collects its rows; give the catalog a row_cap")
    req = OlapRequest.parse(request)
    df = olap_query(catalog, req, fill_defaults)
    rows = [list(r) for r in df.collect()]
    return {
        "collection": req.main.collection,
        "columns": df.columns,
        "rows": rows,
        "row_count": len(rows),
        "truncated": len(rows) >= catalog.row_cap,
        "compiled_query": plan_text(df),
    }
