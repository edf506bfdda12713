"""Character tables derived from the Unicode database that Python carries.

They are computed once on the driver and reach the plan as literals.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache
from typing import NamedTuple

# Python's str.isspace() and re's \s, which are wider than Java's \s. Latin
# characters are listed one by one: Java tests those with one bit set.
OTHER_LATIN_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"  # all but the space
WIDE_SPACES = r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITESPACE = rf"[\x20{OTHER_LATIN_SPACES}{WIDE_SPACES}]"

HANGUL_FIRST, HANGUL_LAST = "가", "힣"


class Folding(NamedTuple):
    """How compatibility decomposition without combining marks changes text."""

    source: str  # characters that become one character or none, the latter last
    target: str  # what they become, in the same order
    wide: str  # JSON of buckets of characters that become several, Hangul apart
    buckets: int
    expanding: str  # pattern of a few ranges that hold all characters that become several


#: A pattern tries a class range by range at every character, so there are few.
RANGES = 20


def _ranges(chars: list[str], most: int = RANGES) -> str:
    """Ranges that hold the characters, ascending, as the inside of a pattern's class.

    Where there would be too many, gaps that are small for where they lie are closed: low
    code points hold the alphabets that texts use most, so gaps count by proportion.
    """
    codes = list(map(ord, chars))
    gaps = sorted((b / a, a) for a, b in zip(codes, codes[1:], strict=False) if b - a > 1)
    split = {a for _, a in gaps[max(0, len(gaps) - most + 1) :]}
    out: list[list[int]] = []
    for code, last in zip(codes, [None, *codes], strict=False):
        if last is None or last in split:
            out.append([code, code])
        out[-1][1] = code
    return "".join(rf"\x{{{low:x}}}-\x{{{high:x}}}" for low, high in out)


@lru_cache(maxsize=1)
def folding(buckets: int = 256) -> Folding:
    single: dict[str, str] = {}
    removed: list[str] = []
    wide: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if HANGUL_FIRST <= char <= HANGUL_LAST:
            continue  # decomposed by arithmetic, see text.py
        if not unicodedata.combining(char) and not unicodedata.decomposition(char):
            continue
        kept = "".join(
            part for part in unicodedata.normalize("NFKD", char) if not unicodedata.combining(part)
        )
        if len(kept) > 1:
            wide[char] = kept
        elif not kept:
            removed.append(char)
        elif kept != char:
            single[char] = kept
    spread: list[dict[str, str]] = [{} for _ in range(buckets)]
    for char, kept in wide.items():
        spread[ord(char) % buckets][char] = kept
    return Folding(
        "".join([*single, *removed]),
        "".join(single.values()),
        json.dumps(spread, ensure_ascii=False),
        buckets,
        f"[{_ranges(sorted([*wide, *map(chr, range(ord(HANGUL_FIRST), ord(HANGUL_LAST) + 1))]))}]",
    )


@lru_cache(maxsize=1)
def delimiter_lookalikes() -> str:
    """Characters whose compatibility form holds a URL delimiter, as ``／`` does."""
    found = []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if unicodedata.decomposition(char) and set("/?#@:") & set(
            unicodedata.normalize("NFKC", char)
        ):
            found.append(char)
    return "".join(found)
