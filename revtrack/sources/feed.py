"""RSS and Atom feeds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import feed_date
from ..functions.html import unescape
from ..functions.rules import board_keyword_match
from ..functions.text import let, strip
from .items import has_text, item, page

_ENTRY = (
    "struct<title:string,link:string,guid:struct<_VALUE:string,_isPermaLink:string>,pubDate:string,"
    "`dc:date`:string,category:array<string>,enclosure:array<struct<_url:string>>>"
)
_ATOM = (
    "struct<title:string,link:array<struct<_href:string,_rel:string>>,published:string,updated:string,"
    "category:array<struct<_term:string>>>"
)
FEED_SCHEMA = f"channel struct<item:array<{_ENTRY}>>, item array<{_ENTRY}>, entry array<{_ATOM}>, _corrupt_record string"
# One entry read by itself.
_ENTRY_ROW, _ATOM_ROW = (f"{fields[:-1]},_corrupt_record:string>" for fields in (_ENTRY, _ATOM))
PARSE_ERROR = "feed could not be parsed"


def _pdfs(urls: Column) -> Column:
    return F.filter(urls, lambda u: F.endswith(F.lower(u), F.lit(".pdf")))


def _rss_item(e: Column) -> Column:
    guid = F.when(F.coalesce(e["guid"]["_isPermaLink"], F.lit("true")) != "false", e["guid"]["_VALUE"])
    return item(
        strip(e["title"]),
        strip(F.coalesce(F.nullif(e["link"], F.lit("")), guid)),
        feed_date(e["pubDate"], e["dc:date"]),
        _pdfs(F.transform(e["enclosure"], lambda x: x["_url"])),
        F.try_element_at(e["category"], F.lit(1)),
    )


def _atom_item(e: Column) -> Column:
    def with_rel(rel: str) -> Column:
        wanted = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == rel)
        return F.transform(wanted, lambda x: x["_href"])

    return item(
        strip(e["title"]),
        strip(F.try_element_at(with_rel("alternate"), F.lit(1))),
        feed_date(e["published"], e["updated"]),
        _pdfs(with_rel("enclosure")),
        F.try_element_at(e["category"], F.lit(1))["_term"],
    )


def repaired(body: Column) -> Column:
    """A feed's text with CDATA sections as plain text, named references as characters, and stray `&` escaped."""

    def plain(text: Column) -> Column:
        # What XML itself knows, and codes of its own signs, stay references; all others become characters first.
        kept = F.regexp_replace(text, r"&(amp|lt|gt|quot|apos|#0*(?:38|60)|#[xX]0*(?:26|3[cC]));", "\x00$1;")
        return F.replace(F.replace(unescape(kept), F.lit("&"), F.lit("&amp;")), F.lit("\x00"), F.lit("&"))

    def quoted(text: Column) -> Column:
        return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def section(part: Column, i: Column) -> Column:
        end = F.instr(part, "]]>")
        both = F.concat(quoted(F.substring(part, F.lit(1), end - 1)), plain(F.substring(part, end + 3, F.length(part))))
        return F.when(i == 0, plain(part)).when(end == 0, quoted(part)).otherwise(both)

    # A feed with XML's own five references only is read as it is.
    wanted = body.rlike("&(?!(?:amp|lt|gt|quot|apos);)") | F.contains(body, F.lit("<![CDATA["))
    return F.when(wanted, F.array_join(F.transform(F.split(body, r"<!\[CDATA\["), section), "")).otherwise(body)


def feed_page(body: Column, keywords: Column) -> Column:
    """Entries with title and link that pass the keywords.

    A feed that does not parse as a whole is read entry by entry; it is an error if that gives no entry either.
    """
    none = F.array()

    def read(text: Column) -> Column:
        return let(F.from_xml(text, FEED_SCHEMA, {"mode": "PERMISSIVE"}), lambda feed: entries(text, feed))

    def entries(text: Column, feed: Column) -> Column:
        rss = F.concat(F.coalesce(feed["channel"]["item"], none), F.coalesce(feed["item"], none))
        whole = F.concat(
            F.transform(rss, lambda e: _rss_item(e)),
            F.transform(F.coalesce(feed["entry"], none), lambda e: _atom_item(e)),
        )
        broken = feed["_corrupt_record"].isNotNull()
        return let(F.when(broken, singly(text)).otherwise(whole), lambda all_: _kept(all_, broken))

    def singly(text: Column) -> Column:
        one = {"mode": "PERMISSIVE"}
        items = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<item\b.*?</item\s*>"), F.lit(0)), lambda x: F.from_xml(x, _ENTRY_ROW, one))
        atoms = F.transform(F.regexp_extract_all(text, F.lit(r"(?s)<entry\b.*?</entry\s*>"), F.lit(0)), lambda x: F.from_xml(x, _ATOM_ROW, one))
        sound = lambda e: e["_corrupt_record"].isNull()
        return F.concat(F.transform(F.filter(items, sound), lambda e: _rss_item(e)), F.transform(F.filter(atoms, sound), lambda e: _atom_item(e)))

    def _kept(all_: Column, broken: Column) -> Column:
        kept = F.filter(
            all_,
            lambda i: has_text(i["title"]) & has_text(i["url"]) & board_keyword_match(i["title"], keywords),
        )
        error = F.when((F.size(all_) == 0) & broken, F.lit(PARSE_ERROR))
        return page(kept, F.size(all_), error)

    return let(repaired(body), read)
