"""Page signals read from HTML with column expressions.

Markup is read with linear-time patterns (possessive, no nested repeats), so one
hostile page cannot stall a task. Comments and raw-text elements go first, so
tags quoted in scripts or comments are never taken for markup.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.binding import bind
from pagelens.functions.text import clean

# Rest of a tag after its name. Quotes count only after '=', so that a stray
# apostrophe does not swallow text; a '>' inside a quoted value does not end it.
_TAIL = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+(?:>|\z)"""
_NAME_END = r"(?=[\s/>])"
_TAG = rf"<(?:/?[A-Za-z]{_TAIL}|[!?/][^>]*+(?:>|\z))"
_RAW = (
    r"(?is)<(?:!--.*?(?:-->|\z)"
    rf"|(script|style|template){_NAME_END}{_TAIL}.*?(?:</\1{_NAME_END}[^>]*+>|\z))"
)
# Elements whose text never describes a page.
_NOISE = "noscript|header|footer|nav|aside"
_NOISE_TAG = rf"(?i)</?(?:{_NOISE}){_NAME_END}{_TAIL}"
_ATTRIBUTE = r"""([^\s=>"'/<]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
_REFERENCE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;)"

_META_FIELDS = ("name", "property", "content")

# How often each signal is repeated in the combined text.
SIGNAL_WEIGHTS = {
    "title": 5,
    "description": 4,
    "keywords": 4,
    "h1": 3,
    "h2": 2,
    "h3": 1,
    "body_text": 1,
}


def markup(html: Column) -> Column:
    """The document with comments, scripts, styles and templates cut to ``<!>``.

    The stub keeps the text nodes on its two sides apart.
    """
    return F.regexp_replace(F.coalesce(html, F.lit("")), _RAW, "<!>")


def decode_references(text: Column) -> Column:
    """Decode character references in one pass, so ``&amp;lt;`` gives ``&lt;``."""

    def decode(value: Column) -> Column:
        decoded = F.transform(
            F.split(value, "&"),
            lambda piece, i: F.when(i == 0, piece).otherwise(_decode_piece(piece)),
        )
        return F.when(value.contains("&"), F.array_join(decoded, "")).otherwise(value)

    return bind(text, decode)


def _decode_piece(piece: Column) -> Column:
    """``piece`` is the text after an ampersand."""

    def decode(reference: Column) -> Column:
        decoded = F.concat(_referenced(reference), F.substr(piece, F.length(reference) + 1))
        return F.coalesce(decoded, F.concat(F.lit("&"), piece))

    return bind(F.regexp_extract(piece, _REFERENCE, 0), decode)


def _referenced(reference: Column) -> Column:
    """The character named, '' for a number that names none, null when unknown."""
    # The names of HTML 4, and the one for the apostrophe that came later.
    characters = {**name2codepoint, "apos": ord("'")}
    named = F.str_to_map(
        F.lit("\u0002".join(f"{k}\u0001{chr(v)}" for k, v in characters.items())),
        F.lit("\u0002"),
        F.lit("\u0001"),
    )
    body = F.rtrim(reference, F.lit(";"))
    hexadecimal = F.regexp_extract(body, r"^#[xX]0*+([0-9a-fA-F]{1,6})\z", 1)
    decimal = F.regexp_extract(body, r"^#0*+([0-9]{1,7})\z", 1)
    code = bind(
        hexadecimal,
        lambda digits: F.when(digits != "", F.conv(digits, 16, 10).try_cast("int"))
        .otherwise(decimal.try_cast("int")),
    )
    number = bind(
        code,
        lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), _char(n))
        .otherwise(F.lit("")),
    )
    return F.when(reference.startswith("#"), number).otherwise(F.try_element_at(named, body))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def strip_tags(fragment: Column, separator: str) -> Column:
    """Text nodes of a fragment joined by ``separator``, references undecoded."""
    return F.regexp_replace(fragment, _TAG, separator)


def read_text(raw: Column) -> Column:
    """Final text of stripped markup."""
    return clean(decode_references(raw))


def title_markup(doc: Column) -> Column:
    return F.regexp_extract(
        doc, rf"(?is)<title{_NAME_END}{_TAIL}(.*?)(?:</title|</head|<body|\z)", 1
    )


def heading_markup(doc: Column) -> Column:
    """Headings of levels 1 to 3 in document order, start tag included.

    A heading ends at its end tag, or where a paragraph, list item, form or a
    heading of another level starts.
    """
    pattern = (
        rf"(?is)<h([1-3]){_NAME_END}{_TAIL}.*?"
        rf"(?:</h\1{_NAME_END}|(?=<(?:p|li|form|h(?!\1)[1-6]){_NAME_END})|\z)"
    )
    return F.regexp_extract_all(doc, F.lit(pattern), F.lit(0))


def texts(doc: Column) -> Column:
    """Texts of the title, of heading levels 1 to 3, and of the body, as arrays.

    Tags vanish inside titles and headings but part words in the body. All texts
    share one decoding step, which keeps the expression small.
    """

    def level(found: Column, number: int) -> Column:
        return F.filter(found, lambda part: F.substring(part, 3, 1) == str(number))

    tight = bind(
        heading_markup(doc),
        lambda found: F.array(F.array(title_markup(doc)), *[level(found, n) for n in (1, 2, 3)]),
    )
    stripped = F.concat(
        F.transform(tight, lambda group: F.transform(group, lambda part: strip_tags(part, ""))),
        F.array(F.array(strip_tags(without_noise(doc), " "))),
    )
    return F.transform(stripped, lambda group: F.transform(group, read_text))


def join_texts(group: Column) -> Column:
    return F.array_join(F.filter(group, lambda text: text != ""), " ")


def metas(doc: Column) -> Column:
    """Meta tags that can matter, as structs of their attributes."""
    tags = F.regexp_extract_all(doc, F.lit(rf"(?is)<meta{_NAME_END}{_TAIL}"), F.lit(0))
    useful = F.filter(tags, lambda tag: tag.rlike("(?i)description|keywords"))
    return F.transform(useful, _meta_struct)


def _meta_struct(tag: Column) -> Column:
    parsed = F.struct(
        F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower).alias("names"),
        F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)).alias("values"),
    )

    def value(attributes: Column, name: Column) -> Column:
        position = F.array_position(attributes["names"], name).cast("int")
        raw = F.get(attributes["values"], position - 1)
        return decode_references(F.regexp_replace(raw, r"""^(["'])(.*)\1\z""", "$2"))

    wanted = F.array(*map(F.lit, _META_FIELDS))
    values = bind(parsed, lambda found: F.transform(wanted, lambda name: value(found, name)))
    return bind(
        values,
        lambda got: F.struct(*[F.get(got, i).alias(n) for i, n in enumerate(_META_FIELDS)]),
    )


def meta_content(parsed: Column, word: str) -> Column:
    """Content of the first ``name`` match, else of the first ``og:`` match.

    Only the first match of each kind counts. Blank content in the first lets
    the second be tried only when it is empty, not when it is whitespace.
    """

    def first(attribute: str, pattern: str) -> Column:
        hits = F.filter(parsed, lambda m: m[attribute].rlike(f"(?i){pattern}"))
        content = F.get(hits, 0)["content"]
        return F.when(content != "", content)

    return clean(F.coalesce(first("name", word), first("property", f"og:{word}")))


def without_noise(doc: Column) -> Column:
    """Cut the noise elements, nested ones included.

    The document is split at noise tags, and a fold over the tags tracks which
    element is open and how deep it is nested in its own kind. An element left
    open runs to the end. Self-closed tags hold nothing.
    """

    def cut(pieces: Column) -> Column:
        kept = F.zip_with(
            pieces, _kept_flags(doc), lambda piece, flag: F.when(flag == "1", piece)
        )
        # Joining skips the nulls.
        return F.when(F.size(pieces) == 1, doc).otherwise(F.array_join(kept, " "))

    return bind(F.split(doc, _NOISE_TAG, -1), cut)


def _kept_flags(doc: Column) -> Column:
    """For each piece between noise tags, "1" when it lies outside noise.

    The fold carries one character per piece and not the pieces, so a page made
    of nothing but noise tags stays cheap.
    """
    tags = F.transform(
        F.regexp_extract_all(doc, F.lit(_NOISE_TAG), F.lit(0)),
        lambda tag: F.struct(
            F.lower(F.regexp_extract(tag, r"^</?([A-Za-z]+)", 1)).alias("name"),
            F.when(tag.startswith("</"), -1)
            .when(tag.endswith("/>"), 0)
            .otherwise(1)
            .alias("change"),
        ),
    )
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("depth"), F.lit("1").alias("flags"))

    def step(state: Column, tag: Column) -> Column:
        depth = (
            F.when(state["depth"] == 0, F.greatest(tag["change"], F.lit(0)))
            .when(state["open"] == tag["name"], state["depth"] + tag["change"])
            .otherwise(state["depth"])
        )
        return F.struct(
            F.when(state["depth"] == 0, tag["name"]).otherwise(state["open"]).alias("open"),
            depth.alias("depth"),
            F.concat(
                state["flags"], F.when(depth == 0, F.lit("1")).otherwise(F.lit("0"))
            ).alias("flags"),
        )

    return F.split(F.aggregate(tags, start, step, lambda state: state["flags"]), "")


def combined_text(weights: dict[str, int] | None = None) -> Column:
    """Each non-empty signal repeated by its weight, joined by spaces."""
    parts = [
        F.array_repeat(F.col(name), times)
        for name, times in (weights or SIGNAL_WEIGHTS).items()
    ]
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda text: text != ""), " ")
