"""More plain Python answers."""

import collections
import re

BREAKS = " \t\n\x0b\x0c\r"


def quality_by_hand(text):
    """The five counts, whether the base rules fail, and whether no rule rejects."""
    text = text or ""
    words = [w for w in re.split(f"[{BREAKS}]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(BREAKS)]
    chars = sum(map(len, words))
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    twice = len(lines) - len(set(lines))
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    again = len({i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)})
    n = len(words)
    base = n < 20 or 100 * again > 30 * n
    rejected = (
        symbols > 0.25 * n or chars < 2 * n or chars > 20 * n or twice > 0.4 * len(lines)
        or len(re.findall("[A-ZÀ-ÖØ-Þ]", text)) > 0.5 * chars or text.count("!") > 0.3 * n
        or len(re.findall("[0-9]", text)) > 0.4 * chars or (n >= 50 and len(set(words)) < 0.1 * min(n, 1000))
    )
    return n, chars, symbols, twice, again, base, not (base or rejected)
