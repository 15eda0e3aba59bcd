"""Embedded blocks with nested values: an indentation reader and writer, and ``VARIANT`` columns.

A block is read line by line with a stack of the collections that are open, so it takes time in proportion to its
length. It knows maps, lists, lists of maps, quoted, plain and block scalars, and values in brackets on one line.
Plain scalars become numbers, booleans or NULL as their spelling says; dates stay texts. Anchors, tags, several
documents and keys that are not scalars on one line make a block malformed, as does a line that does not fit its place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

FENCED = r"(?s)```yaml\n(.*?)\n```"

# How plain scalars are spelt.
NULLS = {"", "~", "null", "Null", "NULL"}
BOOLEANS = {
    **dict.fromkeys(["true", "True", "TRUE", "yes", "Yes", "YES", "on", "On", "ON"], True),
    **dict.fromkeys(["false", "False", "FALSE", "no", "No", "NO", "off", "Off", "OFF"], False),
}
INTEGER = re.compile(r"[-+]?(0|[1-9][0-9_]*)$")
BASED = {8: re.compile(r"[-+]?0[0-7_]+$"), 16: re.compile(r"[-+]?0x[0-9a-fA-F_]+$"), 2: re.compile(r"[-+]?0b[01_]+$")}
REAL = re.compile(r"[-+]?[0-9][0-9_]*\.[0-9_]*([eE][-+][0-9]+)?$|[-+]?\.[0-9][0-9_]*([eE][-+][0-9]+)?$")
ESCAPES = {
    "0": "\0", "a": "\a", "b": "\b", "t": "\t", "\t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ",
    '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029",
}

KEY = re.compile(
    r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|(?:[^\s\-?:,\[\]{}#&*!|>'"%@`]|[-?:](?=[^\s:#]))(?:[^:#]|(?<=[^ \t])#|:(?=[^ \t]))*?)[ \t]*:(?:[ \t]+|$)"""
)
BLOCK_SCALAR = re.compile(r"([|>])([1-9]?)([+-]?)([1-9]?)(\s+#.*|\s*)$")
#: Collections open inside each other at most; deeper blocks are malformed, so that no reader runs out of stack.
DEPTH = 60


class Malformed(ValueError):
    pass


def scalar(text: str):
    """A plain scalar by its spelling."""
    if text in NULLS:
        return None
    if text in BOOLEANS:
        return BOOLEANS[text]
    if INTEGER.match(text):
        return int(text.replace("_", ""))
    for base, spelling in BASED.items():
        if spelling.match(text):
            return int(text.replace("_", ""), base)
    if REAL.match(text) and abs(float(text.replace("_", ""))) < float("inf"):
        return float(text.replace("_", ""))
    return text


def quoted_end(text: str, at: int) -> int:
    """Place after the quoted scalar that starts at ``at``."""
    mark, i = text[at], at + 1
    while i < len(text):
        if mark == '"' and text[i] == "\\":
            i += 2
        elif text[i] == mark:
            if mark == "'" and text[i + 1 : i + 2] == "'":
                i += 2
            else:
                return i + 1
        else:
            i += 1
    raise Malformed("open quote")


def unquoted(text: str) -> str:
    if text[0] == "'":
        return text[1:-1].replace("''", "'")

    def plain(m: re.Match) -> str:
        if m[1][0] in "xuU":
            return chr(int(m[1][1:], 16))
        if m[1] not in ESCAPES:
            raise Malformed("unknown escape")
        return ESCAPES[m[1]]

    text = re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", plain, text[1:-1], flags=re.DOTALL)
    # two escapes may spell one character, as JSON does
    return text.encode("utf-16", "surrogatepass").decode("utf-16")


class Inline:
    """Values of one line: scalars, and lists and maps in brackets."""

    def __init__(self, text: str):
        self.text, self.at, self.depth = text, 0, 0

    def blanks(self) -> str:
        while self.text[self.at : self.at + 1] in (" ", "\t"):
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self, ends: str):
        c = self.blanks()
        if c and c in "[{":
            self.depth += 1
            if self.depth > DEPTH:
                raise Malformed("too deep")
            out = self.items() if c == "[" else self.entries()
            self.depth -= 1
            return out
        if c and c in "\"'":
            stop = quoted_end(self.text, self.at)
            out, self.at = unquoted(self.text[self.at : stop]), stop
            return out
        return scalar(self.plain(ends))

    def plain(self, ends: str) -> str:
        start = self.at
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in ends or (c == "#" and self.at and self.text[self.at - 1] in " \t"):
                break
            if c == ":" and ends and self.text[self.at + 1 : self.at + 2] in ("", " ", *ends):
                break
            self.at += 1
        out = self.text[start : self.at].rstrip(" \t")
        if out and (out[0] in "&*!|>%@`" or re.search(r":([ \t]|$)", out)):
            raise Malformed("not a plain scalar")
        return out

    def items(self) -> list:
        out = []
        self.at += 1
        while self.blanks() != "]":
            if self.blanks() == ",":
                raise Malformed("empty item")
            out.append(self.value(",]"))
            self.separator("]")
        self.at += 1
        return out

    def entries(self) -> dict:
        out = {}
        self.at += 1
        while self.blanks() != "}":
            key = self.value(",}")
            if isinstance(key, (list, dict)):
                raise Malformed("key is a collection")
            if self.blanks() == ":":
                self.at += 1
                out[spelt(key)] = self.value(",}")
            else:
                out[spelt(key)] = None
            self.separator("}")
        self.at += 1
        return out

    def separator(self, end: str) -> None:
        c = self.blanks()
        if c == ",":
            self.at += 1
        elif c != end:
            raise Malformed("bracket left open")

    def rest(self) -> None:
        c = self.blanks()
        if c and not (c == "#" and self.at and self.text[self.at - 1] in " \t"):
            raise Malformed("text after a value")


def spelt(key) -> str:
    """A key as text, as JSON writes it."""
    return key if isinstance(key, str) else json.dumps(key)


def inline_value(text: str):
    reader = Inline(text)
    out = reader.value("")
    reader.rest()
    return out


class Reader:
    """Lines of a block with a stack of open collections, each with its indentation."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.at = 0
        self.root = None
        # (indent, collection, put): ``put`` hands over the value that lines below may still give
        self.stack: list[tuple[int, dict | list]] = []
        self.waiting = None

    def read(self):
        while self.at < len(self.lines):
            line = self.lines[self.at]
            body = line.lstrip(" ")
            if body.rstrip() == "---" and self.root is None and not self.stack or body.rstrip() == "..." == line.rstrip():
                self.at += 1
                if body[0] == ".":
                    break
                continue
            if body.startswith("\t") and body.strip(" \t"):
                raise Malformed("tab")
            if not body.strip(" \t") or body.startswith("#"):
                self.at += 1
                continue
            self.at += 1
            self.line(len(line) - len(body), body.rstrip(" \t"))
        return self.root

    def line(self, indent: int, body: str) -> None:
        while self.stack and self.stack[-1][0] > indent:
            self.stack.pop()
            self.waiting = None
        is_item = body == "-" or body.startswith("- ")
        if self.stack and self.stack[-1][0] == indent:
            here = self.stack[-1][1]
            # a list may stand at the indentation of the key that it belongs to
            if is_item and isinstance(here, dict) and self.waiting:
                self.open(indent, [])
            elif not is_item and isinstance(here, list) and len(self.stack) > 1 and self.stack[-2][0] == indent:
                self.stack.pop()
                self.waiting = None
        elif not self.stack and self.root is None or self.waiting:
            self.open(indent, [] if is_item else {})
        else:
            raise Malformed("indentation")
        here = self.stack[-1][1]
        if is_item != isinstance(here, list):
            raise Malformed("list and map mixed")
        self.waiting = None
        if is_item:
            self.item(indent, here, body)
        else:
            self.entry(indent, here, body)

    def open(self, indent: int, collection: dict | list) -> None:
        if len(self.stack) >= DEPTH:
            raise Malformed("too deep")
        if self.waiting:
            holder, key = self.waiting
            holder[key] = collection
        else:
            self.root = collection
        self.stack.append((indent, collection))

    def item(self, indent: int, here: list, body: str) -> None:
        rest = body[1:].lstrip(" ")
        here.append(None)
        if not rest or rest.startswith("#"):
            self.waiting = (here, len(here) - 1)
        elif rest == "-" or rest.startswith("- ") or self.key_of(rest):
            # a collection that starts on the line of its item
            self.waiting = (here, len(here) - 1)
            self.line(indent + len(body) - len(rest), rest)
        else:
            self.value(indent, here, len(here) - 1, rest)

    def key_of(self, body: str) -> re.Match | None:
        return None if body[0] in "[{" else KEY.match(body)

    def entry(self, indent: int, here: dict, body: str) -> None:
        found = self.key_of(body)
        if not found:
            raise Malformed("no key")
        raw = found[1]
        key = unquoted(raw) if raw[0] in "\"'" else spelt(scalar(raw))
        rest = body[found.end() :]
        here[key] = None
        if not rest or rest.startswith("#"):
            self.waiting = (here, key)
        else:
            self.value(indent, here, key, rest)

    def value(self, indent: int, holder: dict | list, key, text: str) -> None:
        block = BLOCK_SCALAR.match(text)
        if block:
            holder[key] = self.block_scalar(indent, block[1] == ">", block[3], int(block[2] or block[4] or 0))
        elif text[0] in "\"'":
            holder[key] = inline_value(self.whole_quote(text))
        elif text[0] in "[{":
            holder[key] = inline_value(text)
        else:
            holder[key] = inline_value(self.whole_plain(indent, text))

    def whole_quote(self, text: str) -> str:
        """A quoted scalar with the lines that it goes on over, line ends folded."""
        parts, blanks = [text], 0
        while open_quote(text[0], parts[-1], first=len(parts) == 1):
            if self.at == len(self.lines):
                raise Malformed("open quote")
            line = self.lines[self.at].strip(" \t")
            self.at += 1
            if not line:
                blanks += 1
                continue
            before = parts[-1].rstrip(" \t") if not parts[-1].endswith("\\ ") else parts[-1]
            joined = text[0] == '"' and len(before) - len(before.rstrip("\\")) & 1
            parts[-1] = (before[:-1] if joined else before) + ("\n" * blanks if blanks else "" if joined else " ")
            parts.append(line)
            blanks = 0
        return "".join(parts)

    def whole_plain(self, indent: int, text: str) -> str:
        """A plain scalar with the lines further in that it goes on over, line ends folded."""
        blanks = 0
        while self.at + blanks < len(self.lines) and not re.search(r"(^|\s)#", text):
            line = self.lines[self.at + blanks]
            body = line.strip(" \t")
            if not body:
                blanks += 1
                continue
            if len(line) - len(line.lstrip(" ")) <= indent or body[0] == "#":
                break
            text += ("\n" * blanks if blanks else " ") + body
            self.at += blanks + 1
            blanks = 0
        return text

    def block_scalar(self, indent: int, folded: bool, chomp: str, more: int) -> str:
        found, inner = [], indent + more if more else None
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip(" "):
                own = len(line) - len(line.lstrip(" "))
                if own <= indent or (inner is not None and own < inner):
                    break
                inner = own if inner is None else inner
            found.append(line)
            self.at += 1
        kept = [x[inner or 0 :] for x in found]
        # a block that the text ends in has no line end of its own
        ended = self.at < len(self.lines) or not found or not found[-1].strip(" ")
        while kept and not kept[-1]:
            kept.pop()
        if not kept:
            return "\n" * len(found) if chomp == "+" else ""
        body = folded_lines(kept) if folded else "\n".join(kept)
        if chomp == "+":
            return body + "\n" * (len(found) - len(kept) + (self.at < len(self.lines)))
        return body if chomp == "-" or not ended else body + "\n"


def open_quote(mark: str, text: str, first: bool) -> bool:
    """Whether a quoted scalar is still open at the end of a line of it."""
    i = 1 if first else 0
    while i < len(text):
        if mark == '"' and text[i] == "\\":
            i += 2
        elif text[i] == mark:
            if mark == '"' or text[i + 1 : i + 2] != "'":
                return False
            i += 2
        else:
            i += 1
    return True


def folded_lines(lines: list[str]) -> str:
    """Lines joined by blanks; empty lines and those beside lines further in keep their line ends."""
    out, blanks, before = "", 0, ""
    for line in lines:
        if not line:
            blanks += 1
        else:
            if not before:
                out = "\n" * blanks + line
            elif line[0] in " \t" or before[0] in " \t":
                out += "\n" * (blanks + 1) + line
            else:
                out += ("\n" * blanks if blanks else " ") + line
            before, blanks = line, 0
    return out


def read_block(text: str | None) -> str | None:
    """A block as JSON; NULL when it is missing, malformed or not a map."""
    if text is None:
        return None
    try:
        value = Reader(text).read()
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None


PLAIN = re.compile(r"[A-Za-z_/.(][^\n\t:#'\"\[\]{},&*!|>%@`]*$")


def written_scalar(value) -> str:
    if isinstance(value, str):
        safe = PLAIN.match(value) and  isinstance(scalar(value), str) and value.isprintable()
        return value if safe else json.dumps(value, ensure_ascii=False).replace("\\u0000", "\\0").replace("\\/", "/")
    return "null" if value is None else repr(value).lower() if isinstance(value, bool) else format_number(value)


def format_number(value: int | float) -> str:
    text = repr(value)
    if isinstance(value, float) and "e" in text:
        base, power = text.split("e")
        return f"{base if '.' in base else base + '.0'}e{int(power):+d}"
    return text


def written_lines(value, indent: int) -> Iterator[str]:
    """A map or list as lines; empty ones in brackets."""
    pad = " " * indent
    for key, inner in value.items() if isinstance(value, dict) else ((None, x) for x in value):
        head = f"{pad}- " if key is None else f"{pad}{written_scalar(key)}:"
        if isinstance(inner, (dict, list)) and inner:
            yield head.rstrip()
            yield from written_lines(inner, indent + 2)
        elif isinstance(inner, (dict, list)):
            yield f"{head.rstrip()} {'{}' if isinstance(inner, dict) else '[]'}"
        else:
            yield f"{head.rstrip()} {written_scalar(inner)}"


def write_block(value: str | None) -> str | None:
    """A JSON map as the lines of a block; reading it gives the map again."""
    return None if value is None else "\n".join(written_lines(json.loads(value), 0))


def leaves(value: str | None) -> list[tuple[str, str | None, str]] | None:
    """``path, value, kind`` of every scalar and empty collection, in order; ``$.a.b[0]`` as in ``variant_get``."""
    if value is None:
        return None
    out = []
    waiting = [("$", json.loads(value))]
    while waiting:
        path, here = waiting.pop()
        if isinstance(here, dict) and here:
            waiting += [(f"{path}.{k}", v) for k, v in reversed(here.items())]
        elif isinstance(here, list) and here:
            waiting += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(here)))]
        else:
            kind = "null" if here is None else type(here).__name__
            out.append((path, here if isinstance(here, str) else None if here is None else json.dumps(here), kind))
    return out


LEAF = StructType().add("path", "string").add("value", "string").add("kind", "string")


@F.pandas_udf(StringType())
def _read(text):
    return text.map(read_block, na_action="ignore")


@F.pandas_udf(StringType())
def _write(value):
    return value.map(write_block, na_action="ignore")


@F.pandas_udf(ArrayType(LEAF))
def _leaves(value):
    return value.map(lambda v: [{"path": p, "value": x, "kind": k} for p, x, k in leaves(v)], na_action="ignore")


def block_text(body: Column) -> Column:
    """The first fenced block of a text; NULL when there is none."""
    return F.when(body.rlike(FENCED), F.regexp_extract(body, FENCED, 1))


def nested_block(body: Column) -> Column:
    """The first fenced block as ``VARIANT``; NULL when it is missing, malformed or not a map."""
    return F.try_parse_json(_read(block_text(body)))


def nested_body(block: Column, before: Column) -> Column:
    """A text that carries a ``VARIANT`` map as its fenced block; without one, ``before`` alone."""
    lines = _write(F.to_json(block))
    return F.when(lines.isNull(), before).otherwise(F.concat(before, F.lit("\n```yaml\n"), lines, F.lit("\n```\n")))


def block_leaves(records: DataFrame, block: str, *keep: str) -> DataFrame:
    """One row for each scalar of a ``VARIANT`` column: the kept columns, ``path, value, kind``."""
    return records.select(*keep, F.inline(_leaves(F.to_json(F.col(block)))))
