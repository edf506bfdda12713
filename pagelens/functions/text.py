"""Whitespace, case and accent folding, tokens and n-grams."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.binding import bind
from pagelens.functions.unicode_rules import (
    HANGUL_FIRST,
    HANGUL_LAST,
    OTHER_LATIN_SPACES,
    WHITESPACE,
    WIDE_SPACES,
    folding,
)

# Patterns over whole texts use flat, positive character classes: Java tests a
# listed class with one bit set, but a negated or nested one with a call chain.

# What separates words once other separators have become spaces.
ASCII_SEPARATORS = (
    "[" + "".join(rf"\x{code:02x}" for code in range(128) if not re.match(r"\w", chr(code))) + "]+"
)
WIDE_SEPARATOR = r"[^\p{L}\p{N}\x00-\x7f]"

# Whitespace runs other than a lone space, by far the most common run. One class
# leads the pattern, so that other characters cost a single test.
_RUNS = (
    rf"[\x20{OTHER_LATIN_SPACES}](?:[\x20{OTHER_LATIN_SPACES}]++|(?<=[{OTHER_LATIN_SPACES}]))"
)
NOT_SPACE = rf"[^{WHITESPACE[1:]}"

# The English stop list the weights are defined over (318 words).
ENGLISH_STOP_WORDS = tuple(
    """
    a about above across after afterwards again against all almost alone along
    already also although always am among amongst amoungst amount an and another
    any anyhow anyone anything anyway anywhere are around as at back be became
    because become becomes becoming been before beforehand behind being below
    beside besides between beyond bill both bottom but by call can cannot cant co
    con could couldnt cry de describe detail do done down due during each eg eight
    either eleven else elsewhere empty enough etc even ever every everyone
    everything everywhere except few fifteen fifty fill find fire first five for
    former formerly forty found four from front full further get give go had has
    hasnt have he hence her here hereafter hereby herein hereupon hers herself him
    himself his how however hundred i ie if in inc indeed interest into is it its
    itself keep last latter latterly least less ltd made many may me meanwhile
    might mill mine more moreover most mostly move much must my myself name namely
    neither never nevertheless next nine no nobody none noone nor not nothing now
    nowhere of off often on once one only onto or other others otherwise our ours
    ourselves out over own part per perhaps please put rather re same see seem
    seemed seeming seems serious several she should show side since sincere six
    sixty so some somehow someone something sometime sometimes somewhere still such
    system take ten than that the their them themselves then thence there
    thereafter thereby therefore therein thereupon these they thick thin third this
    those though three through throughout thru thus to together too top toward
    towards twelve twenty two un under until up upon us very via was we well were
    what whatever when whence whenever where whereafter whereas whereby wherein
    whereupon wherever whether which while whither who whoever whole whom whose why
    will with within without would yet you your yours yourself yourselves
    """.split()
)


def is_ascii(text: Column) -> Column:
    """Bytes equal characters. Cheap, and opens faster paths to most text."""
    return F.octet_length(text) == F.char_length(text)


def strip_whitespace(text: Column) -> Column:
    # The lookbehind lets the tail match start only where a run starts, which
    # keeps the cost linear on long inner runs.
    edge = rf"^{WHITESPACE}++|(?<!{WHITESPACE}){WHITESPACE}++\z"
    return F.regexp_replace(text, edge, "")


def clean(text: Column) -> Column:
    """Collapse whitespace runs to one space, trim, and turn null into ''."""

    def collapse(value: Column) -> Column:
        # The range test is cheap and rules the wide spaces out of most texts.
        narrow = F.when(
            value.rlike(r"[\u1680-\u3000]"), F.regexp_replace(value, f"[{WIDE_SPACES}]", " ")
        ).otherwise(value)
        return F.trim(F.regexp_replace(narrow, _RUNS, " "))

    return bind(F.coalesce(text, F.lit("")), collapse)


def strip_accents(text: Column) -> Column:
    """Compatibility-decompose and drop combining marks."""
    return bind(text, lambda value: F.when(is_ascii(value), value).otherwise(_folded(value)))


def _folded(value: Column) -> Column:
    """Fold a text that holds other characters than ASCII, in time linear in its length.

    Characters that become several are cut out, folded one by one and joined back. The
    others become one character or none, in one hash-based call for the whole text.
    """
    rules = folding()
    expanding = F.lit(rules.expanding)
    parts = F.transform(F.regexp_extract_all(value, expanding, F.lit(0)), _expanded)
    joined = F.zip_with(
        F.split(value, rules.expanding, -1),
        F.concat(parts, F.array(F.lit(""))),
        lambda plain, expanded: F.concat(plain, expanded),
    )
    whole = F.when(value.rlike(rules.expanding), F.array_join(joined, "")).otherwise(value)
    return F.translate(whole, rules.source, rules.target)


def _expanded(char: Column) -> Column:
    """What a character of the expanding ranges becomes; many of them stay as they are.

    They are spread over buckets by code point, since a map is searched end to end.
    """
    rules = folding()
    buckets = F.from_json(F.lit(rules.wide), "array<map<string,string>>")
    found = F.try_element_at(F.get(buckets, F.ascii(char) % rules.buckets), char)
    found = F.coalesce(found, char)
    return F.when(char.between(HANGUL_FIRST, HANGUL_LAST), _hangul_parts(char)).otherwise(found)


def _hangul_parts(char: Column) -> Column:
    """Syllable to letters by the standard's arithmetic (19 x 21 x 28 grid)."""
    index = F.ascii(char) - F.lit(ord(HANGUL_FIRST))
    leads = F.lit("".join(chr(0x1100 + i) for i in range(19)))
    vowels = F.lit("".join(chr(0x1161 + i) for i in range(21)))
    tails = F.lit("".join(chr(0x11A8 + i) for i in range(27)))
    tail = index % 28
    return F.concat(
        F.substring(leads, F.floor(index / 588).cast("int") + 1, 1),
        F.substring(vowels, F.floor((index % 588) / 28).cast("int") + 1, 1),
        F.when(tail == 0, F.lit("")).otherwise(F.substring(tails, tail, 1)),
    )


def normalise_text(text: Column) -> Column:
    """Lower-case first, then strip accents; the order matters."""
    return strip_accents(F.lower(text))


def tokens(text: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Words in order, repeats kept, stop words dropped (hash-set lookup).

    A word is a run of two or more letters, digits or underscores of the
    normalised text. Separators beyond ASCII become spaces along with accents,
    so the split itself needs only a fast ASCII pattern.
    """

    def words_apart(value: Column) -> Column:
        apart = F.regexp_replace(_folded(value), WIDE_SEPARATOR, " ")
        return F.when(is_ascii(value), value).otherwise(apart)

    def keep(word: Column) -> Column:
        long_enough = F.char_length(word) > 1
        return long_enough & ~word.isin(list(stop_words)) if stop_words else long_enough

    words = F.split(bind(F.lower(text), words_apart), ASCII_SEPARATORS)
    return F.filter(words, keep)


def ngrams(words: Column) -> Column:
    """The words, then each pair of neighbours joined by a space."""

    def build(words: Column) -> Column:
        pairs = F.zip_with(
            words,
            F.slice(words, 2, F.size(words)),
            lambda left, right: F.concat(left, F.lit(" "), right),
        )
        # The last word has no right neighbour; its pair is null.
        return F.concat(words, F.filter(pairs, lambda pair: pair.isNotNull()))

    return bind(words, build)
