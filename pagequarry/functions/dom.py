"""Selections over the node array of a page (see ``operators.parse``), as SQL text.

Everything here works within one row.  A descendant test compares ids instead
of walking parents: ``c.id < n.id <= c.last``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pagequarry.functions.sql import each, first, keep, let, lit, lits, some
from pagequarry.functions.text import strip
from pagequarry.schema import TEXT_TAG


def is_text(n: str) -> str:
    return f"({n}.tag = '{TEXT_TAG}')"


def elements(nodes: str, *tags: str) -> str:
    return keep(nodes, lambda n: f"{n}.tag in ({lits(tags)})")


def attr(n: str, name: str) -> str:
    return f"{n}.attrs[{lit(name)}]"


def has_class(n: str, name: str) -> str:
    """Whether a node has a class; only an attribute that holds its name somewhere is split."""
    value, wanted = attr(n, "class"), lit(name)
    return rf"coalesce(contains({value}, {wanted}) and array_contains(split({value}, r'\s+'), {wanted}), false)"


def is_below(n: str, c: str) -> str:
    return f"({n}.id > {c}.id and {n}.id <= {c}.last)"


def below(nodes: str, containers: str) -> str:
    """Nodes lying under any of the containers."""
    return let(containers, lambda cs: keep(nodes, lambda n: some(cs, lambda c: is_below(n, c))))


def subtree(nodes: str, n: str) -> str:
    """Descendants of a node: one contiguous slice of the page's nodes."""
    return f"slice({nodes}, {n}.id + 2, {n}.last - {n}.id)"


def texts(nodes: str) -> str:
    # elements have none
    return keep(f"{nodes}.text", lambda t: f"{t} is not null")


def own_text_nodes(nodes: str, parents: str) -> str:
    """Text nodes directly inside any of ``parents``, in document order.

    They lie between the first parent and the last end of one, so no other nodes are looked at.
    """

    def of(ps: str) -> str:
        span = f"if(size({ps}) = 0, slice({nodes}, 1, 0), slice({nodes}, array_min({ps}.id) + 2, array_max({ps}.last) - array_min({ps}.id)))"
        return let(f"{ps}.id", lambda ids: keep(span, lambda n: f"{is_text(n)} and array_contains({ids}, {n}.parent)"))

    return let(parents, of)


def own_texts(nodes: str, parents: str) -> str:
    return each(own_text_nodes(nodes, parents), lambda n: f"{n}.text")


def string_value(nodes: str, n: str) -> str:
    """All text below a node, joined as it stands; NULL for no node."""
    return f"array_join({texts(subtree(nodes, n))}, '')"


def stripped_texts(nodes: str) -> str:
    """Text nodes stripped, blank ones left out."""
    return keep(each(f"{nodes}.text", strip), lambda t: f"{t} <> ''")


def cell_text(nodes: str, c: str) -> str:
    """Stripped texts below a table cell with a blank between them; a cell that holds one node needs no search."""
    alone = f"coalesce({strip(f'get({nodes}, {c}.id + 1).text')}, '')"
    return f"if({c}.last = {c}.id + 1, {alone}, array_join({stripped_texts(subtree(nodes, c))}, ' '))"


def unless_blank(x: str) -> str:
    return let(x, lambda t: f"case when {strip(t)} <> '' then {t} end")


@dataclass(frozen=True)
class Selector:
    """One element pattern and what to take from it.

    ``take`` is ``text`` (first own text node), ``deep`` (first own text node,
    else first text node further down) or the name of an attribute.
    """

    tag: str | None = None
    cls: str | None = None
    class_like: str | None = None
    inside: Selector | None = None
    take: str = "text"

    def _ok(self, n: str) -> str:
        tests = [f"{n}.tag = {lit(self.tag)}" if self.tag else f"not {is_text(n)}"]
        if self.cls:
            tests.append(has_class(n, self.cls))
        if self.class_like:
            tests.append(f"contains(coalesce({attr(n, 'class')}, ''), {lit(self.class_like)})")
        return " and ".join(tests)

    def matches(self, nodes: str) -> str:
        found = keep(nodes, self._ok)
        return let(found, lambda f: f"if(size({f}) = 0, {f}, {below(f, self.inside.matches(nodes))})") if self.inside else found

    def first_result(self, nodes: str, found: str) -> str:
        """NULL for a selector that matched nothing, before any text is looked for."""
        return f"if(size({found}) = 0, NULL, {self._first_result(nodes, found)})"

    def _first_result(self, nodes: str, found: str) -> str:
        if self.take == "text":
            return first(own_texts(nodes, found))
        if self.take == "deep":
            return f"coalesce({unless_blank(first(own_texts(nodes, found)))}, {first(texts(below(nodes, found)))})"
        return first(keep(each(found, lambda n: attr(n, self.take)), lambda v: f"{v} is not null"))


def touched(nodes: str, selectors: list[Selector]) -> str:
    """The few nodes that selectors need to find their matches: the matches among these are those among all."""
    steps = []
    for s in selectors:
        while s is not None:
            steps.append(s)
            s = s.inside
    tags = dict.fromkeys(s.tag for s in steps if s.tag)

    def test(n: str) -> str:
        by_tag = [f"{n}.tag in ({lits(tags)})"] if tags else []
        return " or ".join(by_tag + [f"({s._ok(n)})" for s in steps if not s.tag]) or "false"

    return keep(nodes, test)


def select_value(nodes: str, selectors: list[Selector], among: str | None = None) -> str:
    """Value of a field by selector priority, before cleaning; NULL when blank everywhere.

    First round: the first result of each selector in turn.  Second round: the
    whole text of the first element of each selector in turn.  ``among`` holds the nodes that the
    selectors touch, if the caller has them.
    """
    if not selectors:
        return "cast(NULL as string)"

    return let(
        f"array({', '.join(s.matches(among or nodes) for s in selectors)})",
        lambda m: f"coalesce({', '.join(unless_blank(v) for v in _tried(nodes, selectors, m))})",
    )


def _tried(nodes: str, selectors: list[Selector], m: str) -> list[str]:
    """Values of the two rounds of ``select_value`` in order; ``m`` holds the matches of each selector."""
    found = [f"{m}[{i}]" for i in range(len(selectors))]
    results = [s.first_result(nodes, f) for s, f in zip(selectors, found)]
    return results + [let(first(f), lambda n: f"case when {n} is not null then {string_value(nodes, n)} end") for f in found]


def select_number(nodes: str, selectors: list[Selector]) -> str:
    """Number, from 0, of the selector that gives ``select_value``; NULL when none does."""
    if not selectors:
        return "cast(NULL as bigint)"

    def pick(m: str) -> str:
        tried = _tried(nodes, selectors, m)
        numbers = [f"case when {unless_blank(v)} is not null then {i % len(selectors)}L end" for i, v in enumerate(tried)]
        return f"coalesce({', '.join(numbers)})"

    return let(f"array({', '.join(s.matches(nodes) for s in selectors)})", pick)
