"""Text cleaning, as SQL text over built-in functions."""

from __future__ import annotations

# The separators that end a label, the words that mark junk, and
# the length of a paragraph that may hold a field.
LABEL_SEPARATORS = r"[:\-–]"
BLACKLIST = ["login", "subscribe", "advertisement", "sponsored", "cookie"]
PARAGRAPH_MIN, PARAGRAPH_MAX = 5, 200


def strip(x: str) -> str:
    """Drop Unicode white space at both ends (``trim`` only drops blanks)."""
    return rf"regexp_replace({x}, r'(?U)^\s+|\s+$', '')"


def clean_text(x: str) -> str:
    """The part after the first label separator, or all of it, stripped; NULL gives ''."""
    text = f"replace(coalesce({x}, ''), '\u00a0', ' ')"
    return strip(f"element_at(split({text}, r'{LABEL_SEPARATORS}', 2), -1)")


def is_paragraph_length(x: str) -> str:
    return f"(length({x}) between {PARAGRAPH_MIN} and {PARAGRAPH_MAX})"


def is_blacklisted(x: str) -> str:
    return f"(lower({x}) rlike '{'|'.join(BLACKLIST)}')"


def burmese_digits(x: str) -> str:
    """Burmese digits as ASCII digits, so that a cast can read them."""
    return f"translate({x}, '၀၁၂၃၄၅၆၇၈၉', '0123456789')"
