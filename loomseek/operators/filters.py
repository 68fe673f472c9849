"""Filters on target rows. They are plain column predicates, so the optimizer pushes them as far as it can.

A property that a row doesn't have is absent: it passes not-equals, not-in and
missing, and fails equals, in and exists; null maps have no properties.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomseek.errors import QueryError
from loomseek.functions import text
from loomseek.sources.discover import lies_in

OPS = ("equals", "not-equals", "in", "not-in", "exists", "missing")


@dataclass(frozen=True)
class PropertyFilter:
    key: str
    op: str
    value: str | None = None
    values: tuple[str, ...] = ()

    def column(self) -> Column:
        properties = F.col("properties")
        value = F.lower(text.prop(properties, self.key))
        there = text.has_prop(properties, self.key)
        match self.op.replace("_", "-"):
            case "equals":
                hit = value == (self.value or "").lower()
            case "not-equals":
                hit = ~F.coalesce(value == (self.value or "").lower(), F.lit(False))
            case "in":
                hit = value.isin([v.lower() for v in self.values]) if self.values else F.lit(False)
            case "not-in":
                hit = ~F.coalesce(value.isin([v.lower() for v in self.values]), F.lit(False)) if self.values else F.lit(True)
            case "exists":
                hit = there
            case "missing":
                hit = ~there
            case _:
                raise QueryError(f"unknown property filter: {self.op}")
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Filters:
    """What a result must satisfy; allowed_roots None means no constraint, empty rejects all."""

    allowed_roots: tuple[str, ...] | None = None
    property_equals: tuple[tuple[str, str], ...] = ()
    property_filters: tuple[PropertyFilter, ...] = ()
    max_heading_level: int | None = None
    exclude_titles: tuple[str, ...] = field(default_factory=tuple)
    property_key: str | None = None
    property_value: str | None = None
    #: whether allowed roots are a matter of real paths, and files must exist
    on_disk: bool = False

    def normalized(self) -> Filters:
        """The deprecated single property as a filter."""
        if not self.property_key:
            return self
        extra = PropertyFilter(self.property_key, "equals", self.property_value)
        return Filters(self.allowed_roots, self.property_equals, (*self.property_filters, extra), self.max_heading_level, self.exclude_titles, on_disk=self.on_disk)

    def column(self) -> Column:
        f = self.normalized()
        parts = [F.coalesce(F.try_element_at("properties", F.lit(k)) == v, F.lit(False)) for k, v in f.property_equals]
        parts += [p.column() for p in f.property_filters]
        if f.max_heading_level is not None:
            parts.append(~((F.col("kind") == "heading") & (F.col("level") > f.max_heading_level)))
        if f.exclude_titles:
            parts.append(~F.coalesce(F.lower("title").isin([t.lower() for t in f.exclude_titles]), F.lit(False)))
        if f.allowed_roots and f.on_disk:
            parts.append(lies_in(F.col("path"), F.array(*[F.lit(r) for r in f.allowed_roots])))
        elif f.allowed_roots is not None:
            parts.append(reduce(lambda a, b: a | b, [text.below(F.col("path"), r) for r in f.allowed_roots], F.lit(False)))
        return reduce(lambda a, b: a & b, parts, F.lit(True))
