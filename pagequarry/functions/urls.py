"""URL resolution (RFC 3986) and link checks, as SQL text over built-in functions."""

from __future__ import annotations

from pagequarry.functions.sql import let, lit, struct
from pagequarry.functions.text import strip

# RFC 3986, appendix B: groups 2 scheme, 4 authority, 5 path, 7 query
PARTS = r"(?s)^(([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?"

# A web address whose path is more than ``/`` and ``;`` parameters, by its beginning.
PLAIN_PAGE = r"^https?://[^/?#]+/[^/;?#\s\x85\u2028\u2029]"

# The reasons a link is turned down for.
NON_STRING = "Non-string input"
EMPTY = "Empty or None"
BASE_OR_FRAGMENT = "Fragment-only link or base URL"
NON_CRAWLABLE = "Non-crawlable scheme"
MALFORMED = "Unsupported or malformed URL format"


def _part(u: str, group: int) -> str:
    return f"regexp_extract({u}, r'{PARTS}', {group})"


def url_parts(u: str) -> str:
    return struct(scheme=f"lower({_part(u, 2)})", host=_part(u, 4), path=_part(u, 5), query=_part(u, 7))


def host_of(u: str) -> str:
    """Host without user info and port, lower case."""
    return rf"regexp_replace(lower({_part(u, 4)}), r'^.*@|:\d*$', '')"


def drop_fragment(u: str) -> str:
    return f"substring_index({u}, '#', 1)"


def remove_dots(path: str) -> str:
    """Apply ``.`` and ``..`` segments; a path without a dot stays as it is."""

    def walk(segments: str) -> str:
        done = (
            f"aggregate({segments}, cast(array() as array<string>), (done, s) -> case "
            "when s = '..' then slice(done, 1, greatest(size(done) - 1, 0)) "
            "when s = '.' then done else array_append(done, s) end)"
        )
        return f"concat(array_join({done}, '/'), if(element_at({segments}, -1) in ('.', '..'), '/', ''))"

    def applied(p: str) -> str:
        segments = f"split({p}, '/')"
        return f"if(contains({p}, '.'), {let(segments, walk)}, {p})"

    return let(path, applied)


def _merge(base_path: str, path: str) -> str:
    folder = f"regexp_replace({base_path}, '[^/]*$', '')"
    return f"regexp_replace(concat({folder}, {path}), '(?<=.)/{{2,}}(?=.)', '/')"


def _absolute(scheme: str, host: str, path: str, query: str) -> str:
    rooted = let(path, lambda p: f"if({p} = '' or startswith({p}, '/'), {p}, concat('/', {p}))")
    tail = let(query, lambda q: f"if({q} = '', '', concat('?', {q}))")
    return f"concat({scheme}, '://', {host}, {rooted}, {tail})"


def resolve(base: str, raw: str, base_parts: str | None = None) -> str:
    """Absolute form of ``raw`` against ``base``, fragment dropped.

    A reference with another scheme is returned as it is, less its fragment.
    ``base_parts`` may hold ``url_parts(base)`` when many links share one base.
    """
    ref = rf"regexp_replace({strip(raw)}, r'[\t\r\n]', '')"

    def dotless(path: str) -> str:
        return let(remove_dots(path), lambda p: f"if({p} = '', '/', {p})")

    def rooted(text: str, b: str) -> str:
        """A reference that is a path from the root and nothing else needs not be taken apart."""
        is_path = f"startswith({text}, '/') and not startswith({text}, '//') and not contains({text}, '?') and not contains({text}, '#')"
        return f"when {is_path} then {_absolute(f'{b}.scheme', f'{b}.host', dotless(text), chr(39) * 2)}"

    def join(r: str, b: str, text: str) -> str:
        path = f"if(startswith({r}.path, '/'), {r}.path, {_merge(f'{b}.path', f'{r}.path')})"
        dotted = dotless(path)
        # dropping a fragment also folds the case of the scheme
        foreign = (
            f"if(contains({text}, '#'), concat({r}.scheme, substring({drop_fragment(text)}, length({r}.scheme) + 1)), {text})"
        )
        same_page_query = f"if({r}.query = '', {b}.query, {r}.query)"
        return (
            f"case when {text} = '' then {drop_fragment(base)} "
            f"when {r}.scheme <> '' and {r}.scheme <> {b}.scheme then {foreign} "
            f"when {r}.host <> '' then {_absolute(f'{b}.scheme', f'{r}.host', f'{r}.path', f'{r}.query')} "
            f"when {r}.path = '' then {_absolute(f'{b}.scheme', f'{b}.host', f'{b}.path', same_page_query)} "
            f"else {_absolute(f'{b}.scheme', f'{b}.host', dotted, f'{r}.query')} end"
        )

    def against(b: str) -> str:
        def parted(text: str) -> str:
            return let(url_parts(text), lambda r: join(r, b, text))

        return let(ref, lambda text: f"case {rooted(text, b)} else {parted(text)} end")

    return let(url_parts(base), against) if base_parts is None else against(base_parts)


def reject_reason(url: str) -> str:
    """Why a link is not followed; NULL when it is valid.  First hit wins."""

    def check(u: str, p: str) -> str:
        web = f"({p}.scheme in ('http', 'https') and {p}.host <> '')"
        return (
            f"case when startswith({u}, '#') or ({web} and {p}.path rlike '^/?(;[^/]*)?$') then {lit(BASE_OR_FRAGMENT)} "
            f"when lower({u}) rlike '^(javascript|mailto|tel):' then {lit(NON_CRAWLABLE)} "
            f"when {web} then NULL "
            rf"when {p}.scheme = '' and {p}.path rlike r'^(/|\./|\.\./)' then NULL "
            f"else {lit(MALFORMED)} end"
        )

    def first_look(u: str) -> str:
        """An ordinary page is valid at a glance; the others are taken apart."""
        return (
            f"case when lower({u}) in ('', 'none', 'void(0)') or endswith(lower({u}), '/none') then {lit(EMPTY)} "
            f"when {u} rlike r'{PLAIN_PAGE}' then NULL else {let(url_parts(u), lambda p: check(u, p))} end"
        )

    checked = let(strip(url), first_look)
    return f"case when {url} is null then {lit(NON_STRING)} else {checked} end"
