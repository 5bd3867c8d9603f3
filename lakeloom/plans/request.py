"""A typed read-only request and the DataFrame that answers it.

Every capability is a field; Catalyst plans the rest. Values are literals, names are resolved by Spark, and nothing is
taken from text.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "in", "like", "starts_with", "is_null", "is_not_null", "between_dates", "or_null_le", "or_null_ge")
AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None

    def condition(self) -> Column:
        c, v = F.col(self.column), self.value
        match self.operator:
            case "=":
                return c == v
            case "<>":
                return c != v
            case "<":
                return c < v
            case "<=":
                return c <= v
            case ">":
                return c > v
            case ">=":
                return c >= v
            case "in":
                return c.isin(*v)
            case "like":
                return c.like(v)
            case "contains":
                return F.upper(c).contains(str(v).upper())
            case "starts_with":
                return c.startswith(v)
            case "is_null":
                return c.isNull()
            case "is_not_null":
                return c.isNotNull()
            case "between_dates":  # both days included
                return (c >= F.lit(v[0])) & (c < F.lit(v[1] + timedelta(days=1)))
            case "or_null_le":
                return c.isNull() | (c <= v)
            case "or_null_ge":
                return c.isNull() | (c >= v)
        raise ValueError(f"unknown operator {self.operator}")


@dataclass(frozen=True)
class Relation:
    """Rows of other that match on keys (ours, theirs): joined (inner, left) or only asked for (exists, absent)."""

    other: DataFrame
    keys: tuple[tuple[str, str], ...]
    kind: str = "inner"
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Request:
    fields: tuple[str, ...] = ()
    all_of: tuple[Filter, ...] = ()
    any_of: tuple[tuple[Filter, ...], ...] = ()  # groups: all within one, any group
    relations: tuple[Relation, ...] = ()
    valid: tuple[str, str, date] | None = None  # from, to (null: open), day
    valid_inclusive: tuple[bool, bool] = (True, True)  # whether the first and the last day count
    group_by: tuple[str, ...] = ()
    aggregates: tuple[tuple[str, str, str], ...] = ()  # function, column, name
    having: tuple[Filter, ...] = ()
    distinct: bool = False
    order_by: tuple[tuple[str, bool], ...] = field(default=())  # column, descending; nulls last
    offset: int = 0
    limit: int | None = None

    def answer(self, rows: DataFrame) -> DataFrame:
        for r in self.relations:
            if r.kind not in ("inner", "left", "exists", "absent"):
                raise ValueError(f"unknown relation {r.kind}")
            if not r.keys:
                raise ValueError("a relation needs keys; cross joins aren't planned")
            other = r.other
            for f in r.filters:  # on the other side, so that a left join keeps all of ours
                other = other.where(f.condition())
            if r.kind in ("exists", "absent"):
                other = other.select([k for _, k in r.keys])
            condition = [F.col(a).eqNullSafe(F.col(b)) & F.col(a).isNotNull() if a == b else F.col(a) == F.col(b) for a, b in r.keys]
            rows = rows.join(other, condition, {"exists": "left_semi", "absent": "left_anti"}.get(r.kind, r.kind))
        for f in self.all_of:
            rows = rows.where(f.condition())
        if self.any_of:
            anything = F.lit(False)
            for group in self.any_of:
                every = F.lit(bool(group))  # a group without conditions holds for no row
                for f in group:
                    every = every & f.condition()
                anything = anything | every
            rows = rows.where(anything)
        if self.valid:
            start, end, day = self.valid
            begun = F.col(start) <= F.lit(day) if self.valid_inclusive[0] else F.col(start) < F.lit(day)
            lasts = F.col(end) >= F.lit(day) if self.valid_inclusive[1] else F.col(end) > F.lit(day)
            rows = rows.where(begun & (F.col(end).isNull() | lasts))
        if self.group_by and not self.aggregates:
            rows = rows.select(*self.group_by).distinct()
        if self.aggregates:
            rows = rows.groupBy(*self.group_by).agg(*(AGGREGATES[f](F.col(c) if c != "*" else F.lit(1)).alias(n) for f, c, n in self.aggregates))
            for f in self.having:
                rows = rows.where(f.condition())
        if self.fields:
            rows = rows.select(*self.fields)
        if self.distinct:
            rows = rows.distinct()
        if self.order_by:
            rows = rows.orderBy(*(F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in self.order_by))
        if self.offset:
            rows = rows.offset(self.offset)
        return rows if self.limit is None else rows.limit(self.limit)
