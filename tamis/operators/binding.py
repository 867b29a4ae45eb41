"""Queries over any kind of record: a binding tells the cell that a path leads to, the rest follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.cells import Bool, Cell, both, column, compare, either, negated
from tamis.plans.ast import ORIGINAL, And, Choice, Compare, Filter, Not, Or, Path, Query, Template, Truthy


class Binding:
    def cell(self, path: Path) -> Cell:
        raise NotImplementedError

    def prepared(self, df: DataFrame, query: Query) -> tuple[DataFrame, Binding]:
        """The table with what the query's paths need, and the binding to go on with."""
        return df, self

    def leaf(self, f: Compare) -> Bool:
        return compare(self.cell(f.path), f.op, f.value, self.cell(f.value) if isinstance(f.value, Path) else None)

    def leaf_fails(self, f: Compare) -> Bool:
        return negated(self.leaf(f))

    def holds(self, f: Filter) -> Bool:
        """True where the filter holds; false or null elsewhere."""
        if isinstance(f, And):
            return both(self.holds(f.left), self.holds(f.right))
        if isinstance(f, Or):
            return either(self.holds(f.left), self.holds(f.right))
        if isinstance(f, Not):
            return self.fails(f.inner)
        if isinstance(f, Truthy):
            return self.cell(f.path).truthy()
        return self.leaf(f)

    def fails(self, f: Filter) -> Bool:
        """True where the filter does not hold; false or null elsewhere."""
        if isinstance(f, And):
            return either(self.fails(f.left), self.fails(f.right))
        if isinstance(f, Or):
            return both(self.fails(f.left), self.fails(f.right))
        if isinstance(f, Not):
            return self.holds(f.inner)
        if isinstance(f, Truthy):
            return negated(self.holds(f))
        return self.leaf_fails(f)

    def rendered(self, template: Template) -> Column:
        parts = [F.lit("")]
        for item in template.items:
            if isinstance(item, str):
                parts.append(F.lit(item))
            elif isinstance(item, Choice):
                parts.append(F.when(column(self.cell(item.path).truthy()), self.rendered(item.yes)).otherwise(self.rendered(item.no)))
            else:
                parts.append(F.coalesce(self.cell(item).shown(), F.lit("")))
        return F.concat(*parts) if len(parts) > 1 else parts[0]

    def where(self, df: DataFrame, query: Query) -> DataFrame:
        if query.filter is None:
            return df
        found, binding = self.prepared(df, query)
        return found.filter(column(binding.holds(query.filter))).select(*[F.col(f"`{c}`") for c in df.columns])

    def select(self, df: DataFrame, query: Query, name: str = "value", carry: tuple[str, ...] = (), every: bool = False) -> DataFrame:
        """What the query prints for each row that passes, after the carried columns; a missing field prints null with every, else nothing."""
        kept, binding = self.prepared(df, query)
        if query.filter is not None:
            kept = kept.filter(column(binding.holds(query.filter)))
        if query.selector is not None:
            cell = binding.cell(query.selector)
            if cell.present is not True and not every:
                kept = kept.filter(column(cell.present))
            return kept.select(*carry, cell.shown(pretty=True).alias(name))
        template = query.template or Template((Path((ORIGINAL,)),))
        return kept.select(*carry, binding.rendered(template).alias(name))


def paths(query: Query) -> list[Path]:
    """The different paths of a query, in order."""
    found: dict[Path, None] = {}

    def of_filter(f: Filter) -> None:
        if isinstance(f, (And, Or)):
            of_filter(f.left)
            of_filter(f.right)
        elif isinstance(f, Not):
            of_filter(f.inner)
        else:
            found[f.path] = None
            if isinstance(f, Compare) and isinstance(f.value, Path):
                found[f.value] = None

    def of_template(t: Template) -> None:
        for item in t.items:
            if isinstance(item, Path):
                found[item] = None
            elif isinstance(item, Choice):
                found[item.path] = None
                of_template(item.yes)
                of_template(item.no)

    if query.filter is not None:
        of_filter(query.filter)
    if query.template is not None:
        of_template(query.template)
    if query.selector is not None:
        found[query.selector] = None
    return list(found)
