"""Building blocks for row-local logic, as Spark SQL expression text.

Expressions over the node array nest several lambdas deep.  Kept as SQL text they
reach Spark in one ``F.expr`` call; as Column objects each operator would be a
separate trip to the JVM and building a plan would take longer than running it.

Every helper takes and returns SQL text.  Lambda variables are numbered, so an
expression can be put inside any other without a clash of names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import count

Body = Callable[[str], str]

_numbers = count()


def lit(value: str | int | float | bool | None) -> str:
    """A constant."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lits(values: Iterable[str | int]) -> str:
    """A list of constants, for ``IN (...)`` or ``array(...)``."""
    return ", ".join(lit(v) for v in values)


def _lambda(function: str, items: str, body: Body) -> str:
    v = f"x{next(_numbers)}"
    return f"{function}({items}, {v} -> {body(v)})"


def each(items: str, body: Body) -> str:
    return _lambda("transform", items, body)


def each_indexed(items: str, body: Callable[[str, str], str]) -> str:
    v, i = f"x{next(_numbers)}", f"i{next(_numbers)}"
    return f"transform({items}, ({v}, {i}) -> {body(v, i)})"


def keep(items: str, test: Body) -> str:
    return _lambda("filter", items, test)


def some(items: str, test: Body) -> str:
    return _lambda("exists", items, test)


def let(value: str, body: Body) -> str:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return f"get({each(f'array({value})', body)}, 0)"


def first(items: str) -> str:
    """First array entry, NULL when there is none."""
    return f"get({items}, 0)"


def last(items: str) -> str:
    """Last array entry, NULL when there is none."""
    return let(items, lambda a: f"get({a}, size({a}) - 1)")


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def override(base: str, wins: str) -> str:
    """Map union in which the entries of ``wins`` replace those of ``base``."""
    k, v = f"k{next(_numbers)}", f"v{next(_numbers)}"

    def union(both: str) -> str:
        kept = f"map_filter({both}.base, ({k}, {v}) -> not map_contains_key({both}.wins, {k}))"
        return f"map_concat({kept}, {both}.wins)"

    return let(struct(base=base, wins=wins), union)


def without_nulls(mapping: str) -> str:
    k, v = f"k{next(_numbers)}", f"v{next(_numbers)}"
    return f"map_filter({mapping}, ({k}, {v}) -> {v} is not null)"


def sparse_map(entries: dict[str, str]) -> str:
    """Map of the given values without the NULL ones."""
    return without_nulls(f"map_from_arrays(array({lits(entries)}), array({', '.join(entries.values())}))")
