"""Page text and detail pages as column expressions.

No document tree is built here: blocks are cut by pattern, and the few places that need matching end tags
count opening and closing tags of one name. Listings need the structure; see `elements`.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .dates import date_from_text
from .text import clean_title_attribute, collapse, extract, first_group, let, strip

# All named character references of HTML, as the standard library lists them: name with semicolon -> characters.
_NAMED = json.dumps({name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}, ensure_ascii=False)

_STARTS_WITH_DATE = r"^\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}"


# References that most pages get by with; the ampersand comes last, so that what it stands for is not read again.
_FREQUENT = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": "\xa0", "middot": "·", "copy": "©", "amp": "&"}
_RARE = rf"&(?!(?:{'|'.join(_FREQUENT)});)(?:#|[A-Za-z])"


def unescape(text: Column) -> Column:
    """Named and numeric character references to characters."""

    def frequent(x: Column) -> Column:
        for name, char in _FREQUENT.items():
            x = F.replace(x, F.lit(f"&{name};"), F.lit(char))
        return x

    return let(text, lambda x: F.when(~F.contains(x, F.lit("&")), x).when(x.rlike(_RARE), _unescape(x)).otherwise(frequent(x)))


def _unescape(text: Column) -> Column:
    """One pass: what a reference stands for is not read again. Codes that are no character become U+FFFD."""

    def referred(part: Column, i: Column) -> Column:
        return let(F.regexp_extract(part, r"^(#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);", 1), lambda ref: put(part, i, ref))

    def put(part: Column, i: Column, ref: Column) -> Column:
        dec, hexa = F.regexp_extract(ref, r"^#0*(\d{1,7})$", 1), F.regexp_extract(ref, r"^#[xX]0*([0-9A-Fa-f]{1,6})$", 1)
        code = F.coalesce(
            F.try_to_number(F.nullif(dec, F.lit("")), F.lit("9999999")).cast("bigint"), F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("bigint")
        )
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
        named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), ref)
        char = F.when(F.startswith(ref, F.lit("#")), numbered).when(ref != "", named)
        rest = F.substring(part, F.length(ref) + 2, F.length(part))
        return F.when(i == 0, part).when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(char, rest))

    return F.array_join(F.transform(F.split(text, "&"), referred), "")


def _without_comments(html: Column) -> Column:
    return let(html, lambda h: F.when(F.contains(h, F.lit("<!--")), F.regexp_replace(h, r"(?s)<!--.*?-->", "")).otherwise(h))


def joined_text(html: Column) -> Column:
    """Text nodes, each stripped, joined without a separator; whitespace collapsed."""
    html = F.replace(_without_comments(html), F.lit("&nbsp;"), F.lit(" "))
    return collapse(unescape(F.regexp_replace(html, r"(?U)\s*<[^>]*>\s*", "")))


def spaced_text(html: Column) -> Column:
    """Text nodes separated by blanks; whitespace collapsed."""
    return collapse(unescape(F.regexp_replace(_without_comments(html), r"<[^>]*>", " ")))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of the opening tag `tag` starts with, unescaped; null when absent."""
    head = rf"(?is)^<\w+\b[^>]*?\s{name}\s*=\s*"

    def value(t: Column) -> Column:
        return unescape(F.coalesce(first_group(t, head + '"([^"]*)"'), first_group(t, head + "'([^']*)'"), first_group(t, head + r"([^\s>\"']+)")))

    # Most tags do not have it; a plain search tells that sooner than three patterns.
    return let(tag, lambda t: F.when(F.contains(F.lower(t), F.lit(name)), value(t)))


def open_tag(kind: str, name: str, tag: str = r"\w+") -> str:
    """Pattern of an opening tag chosen by class, id or tag name."""
    if kind == "tag":
        return rf"<(?i:{name})\b[^>]*>"
    inner = r"(?:[^\"'>]*\s)?" if kind == "class" else ""
    return rf"<(?i:{tag})\b[^>]*?\s(?i:{kind})\s*=\s*[\"']?{inner}{name}(?=[\s\"'>/])[^>]*>"


def _cut(part: Column) -> Column:
    """Split text that begins with an opening tag into its element and what follows it."""
    tag = F.regexp_extract(part, r"^<(\w+)", 1)
    return let(F.split(part, F.concat(F.lit("(?i)(?=</?"), tag, F.lit(r"\b)"))), _cut_pieces)


def _cut_pieces(pieces: Column) -> Column:
    def step(acc: Column, piece: Column) -> Column:
        change = F.when(F.startswith(piece, F.lit("</")), -1).when(piece.rlike(r"^<[^>]*/>"), 0).otherwise(1)
        at, depth = acc["at"] + 1, acc["depth"] + change
        return F.struct(
            at.alias("at"),
            depth.alias("depth"),
            F.when((acc["end"] == 0) & (depth == 0), at).otherwise(acc["end"]).alias("end"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def halves(end: Column) -> Column:
        inside = F.array_join(F.filter(pieces, lambda p, i: (end == 0) | (i < end - 1)), "")
        after = F.array_join(F.filter(pieces, lambda p, i: (end > 0) & (i >= end - 1)), "")
        return F.struct(inside.alias("element"), F.regexp_replace(after, r"^</\w+\s*>", "").alias("rest"))

    return let(F.aggregate(pieces, start, step, lambda acc: acc["end"]), halves)


def elements(html: Column, opening: str | Column) -> Column:
    """Inner html (opening tag included) of the elements whose opening tag matches."""
    opening = F.lit(opening) if isinstance(opening, str) else opening
    pieces = F.split(F.concat(F.lit(" "), html), F.concat(F.lit("(?="), opening, F.lit(")")))
    return F.transform(F.filter(pieces, lambda p, i: i > 0), lambda p: _cut(p)["element"])


def first_element(html: Column, opening: str | Column) -> Column:
    opening = F.lit(opening) if isinstance(opening, str) else opening
    pieces = F.split(F.concat(F.lit(" "), html), F.concat(F.lit("(?="), opening, F.lit(")")), 2)
    return _cut(F.try_element_at(pieces, F.lit(2)))["element"]


def without_elements(html: Column, opening: str) -> Column:
    """`html` minus the matching elements."""

    def cut_out(text: Column) -> Column:
        pieces = F.split(F.concat(F.lit(" "), text), f"(?={opening})")
        kept = F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(_cut(p)["rest"]))
        return F.when(text.rlike(opening), F.array_join(kept, " ")).otherwise(text)

    return let(html, cut_out)


def split_blocks(html: Column, boundary: Column) -> Column:
    """Blocks that begin where the lookahead `boundary` holds; what precedes the first is dropped."""
    return F.filter(F.split(F.concat(F.lit(" "), html), boundary), lambda p, i: i > 0)


def snippet(
    html: Column,
    containers: Sequence[tuple[str, str]] = fv.CONTENT_CONTAINERS,
    max_chars: int = fv.SNIPPET_CHARS,
) -> Column:
    """First `max_chars` characters of the text of the content container, else of the body."""
    return F.left(page_text(html, containers), F.lit(max_chars))


def page_text(html: Column, containers: Sequence[tuple[str, str]] = fv.CONTENT_CONTAINERS) -> Column:
    """Whole text of the first content container found, else of the body."""
    html = _without_comments(html)
    html = F.regexp_replace(html, rf"(?is)<({'|'.join(fv.DROPPED_ELEMENTS)})\b[^>]*>.*?</\1\s*>", "")
    for name in fv.DROPPED_CLASSES:
        html = without_elements(html, open_tag("class", name))
    return let(html, lambda h: spaced_text(F.coalesce(_content(h, containers), _body(h))))


def _content(html: Column, containers: Sequence[tuple[str, str]]) -> Column:
    chosen = None
    for kind, name in containers:
        pattern = open_tag(kind, name)
        chosen = F.when(html.rlike(pattern), pattern) if chosen is None else chosen.when(html.rlike(pattern), pattern)
    return first_element(html, chosen)


def _body(html: Column) -> Column:
    return F.when(html.rlike(r"(?i)<body\b"), F.regexp_extract(html, r"(?is)<body\b[^>]*>(.*?)(?=</body|$)", 1)).otherwise(
        F.regexp_replace(html, r"(?is)<head\b[^>]*>.*?</head\s*>", "")
    )


def mentioned_extensions(text: Column) -> Column:
    """`.ext` of each document name in the text, as written."""
    return F.transform(
        F.regexp_extract_all(text, F.lit("(?iU)" + fv.ATTACHMENT_EXTENSION), 1), lambda e: F.concat(F.lit("."), e)
    )


# ---- board listings ---------------------------------------------------------------------------


def title_text(tag: Column) -> Column:
    """Cleaned title attribute when it has at least three characters, else the text of the element."""
    attr = clean_title_attribute(attribute(tag, "title"))
    return F.coalesce(let(attr, lambda a: F.when(F.length(a) >= 3, a)), joined_text(tag))


def row_date(field: Column, cells: Column) -> Column:
    """Date in the row's date field, else in the first cell that begins with a date."""
    texts = F.transform(cells, joined_text)
    dated = F.try_element_at(F.filter(texts, lambda c: c.rlike(_STARTS_WITH_DATE)), F.lit(1))
    text = unescape(F.regexp_replace(_without_comments(field), r"<[^>]*>", ""))
    return date_from_text(F.coalesce(text, dated))


# ---- detail pages -----------------------------------------------------------------------------


def title_region(html: Column, marker: Column, chars: int = 2000) -> Column:
    """Where a detail page's title may stand: the text behind the marker, or all of it without one."""
    at = F.instr(html, marker)
    behind = F.substr(html, at + F.length(marker), F.lit(chars))
    return F.when(F.coalesce(marker, F.lit("")) == "", html).when(at > 0, behind)


def listed_files(html: Column, pattern: Column, has_names: Column) -> Column:
    """Ids of linked files that are documents or carry no name."""
    ids = F.regexp_extract_all(html, pattern, F.lit(1))
    names = F.when(has_names, F.regexp_extract_all(html, pattern, F.lit(2))).otherwise(F.transform(ids, lambda i: F.lit("")))
    files = F.arrays_zip(ids.alias("id"), names.alias("name"))

    def wanted(f: Column) -> Column:
        name = strip(f["name"])
        suffix = [F.endswith(F.lower(name), F.lit(s)) for s in fv.DETAIL_ATTACHMENT_SUFFIXES]
        return suffix[0] | suffix[1] | suffix[2] | (name == "")

    return F.transform(F.filter(files, wanted), lambda f: f["id"])
