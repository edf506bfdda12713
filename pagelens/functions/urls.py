"""URL normalising, validity and registered domain.

``parse_url`` raises under ANSI mode and ``try_parse_url`` rejects URLs with
spaces in them, so the parts needed here are read with patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.text import strip_whitespace
from pagelens.functions.unicode_rules import WHITESPACE, delimiter_lookalikes


def normalise_url(url: Column) -> Column:
    """Strip whitespace, then every trailing slash. Nothing else changes."""
    return F.regexp_replace(strip_whitespace(url), r"/++\z", "")


def _h16_groups(most: int) -> str:
    return rf"(?:(?:[0-9a-f]{{1,4}}:){{0,{most}}}[0-9a-f]{{1,4}})?"


def _ipv6() -> str:
    """RFC 3986 IPv6address, built from its rule."""
    h16 = r"[0-9a-f]{1,4}"
    octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    ls32 = rf"(?:{h16}:{h16}|{octet}(?:\.{octet}){{3}})"
    forms = [rf"(?:{h16}:){{6}}{ls32}", rf"::(?:{h16}:){{5}}{ls32}"]
    forms += [rf"{_h16_groups(k)}::(?:{h16}:){{{4 - k}}}{ls32}" for k in range(5)]
    forms += [rf"{_h16_groups(5)}::{h16}", rf"{_h16_groups(6)}::"]
    return "(?:" + "|".join(forms) + ")"


def _authority() -> str:
    """A well-formed authority up to its end, as one pattern.

    Brackets may only hold an IP literal, and no character may look like a URL
    delimiter once its compatibility form is taken.
    """
    char = rf"[^/?#\[\]{delimiter_lookalikes()}]"
    literal = rf"\[(?:v[0-9a-f]+\.[^\]/?#]+|{_ipv6()}(?:%[^\]%/?#]+)?)\]"
    return rf"(?:{char}++|(?:{char}*@)?{literal}(?::{char}*)?)(?=[/?#]|\z)"


def _without_breaks(url: Column) -> Column:
    """A URL parser ignores tabs and line breaks wherever they are."""
    return F.regexp_replace(url, r"[\t\r\n]", "")


def is_valid_url(url: Column) -> Column:
    """True for http and https URLs with a non-empty, well-formed authority."""
    pattern = (
        rf"(?i)^{WHITESPACE}*+[\x00-\x20]*+https?://(?!{WHITESPACE}*+\z){_authority()}"
    )
    return F.coalesce(_without_breaks(url).rlike(pattern), F.lit(False))


def registered_domain(url: Column) -> Column:
    """Lower-cased authority without one leading ``www.``; '' when there is none.

    User info and port stay, so ``github.com:443`` is not ``github.com``.
    """
    pattern = rf"(?i)^[\x00-\x20]*+(?:[a-z][a-z0-9+.\-]*+:)?//({_authority()})"
    authority = F.regexp_extract(_without_breaks(F.coalesce(url, F.lit(""))), pattern, 1)
    return F.regexp_replace(F.lower(authority), r"^www\.", "")
