"""Single pages that list many publications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.dates import iso_day
from ..functions.rules import publication_keyword_match
from ..functions.text import breaks_to_blanks, extract, let, strip
from ..functions.urls import publication_url
from .items import has_text, item, page


def publications_page(body: Column, page_url: Column, keywords: Column, profile: Column) -> Column:
    """Publications of a page, first of each sequence id, that pass the keywords."""
    null = F.lit(None).cast("string")

    def entry(block: Column) -> Column:
        seq = strip(extract(block, profile["seq_regex"]))
        return let(seq, lambda s: _entry(block, s))

    def _entry(block: Column, seq: Column) -> Column:
        template = profile["download_url_template"]
        url = publication_url(page_url, template, seq)
        return item(
            breaks_to_blanks(extract(block, profile["title_regex"])),
            url,
            iso_day(extract(block, profile["date_regex"])),
            F.when(F.coalesce(template, F.lit("")) != "", F.array(url)),
            null,
            seq,
        )

    def firsts(entries: Column) -> Column:
        """The first of each sequence id, in order: sorted by id and place, so that a page of any length takes no pairs."""
        marked = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["serial"].alias("serial"), i.alias("at"), e.alias("e"))))
        first = let(marked, lambda m: F.filter(m, lambda s, k: (k == 0) | (F.get(m, k - 1)["serial"] != s["serial"])))
        return F.transform(F.array_sort(F.transform(first, lambda s: F.struct(s["at"], s["e"]))), lambda s: s["e"])

    def kept(entries: Column) -> Column:
        return page(F.filter(entries, lambda e: publication_keyword_match(e["title"], keywords)), F.size(entries))

    entries = F.transform(H.split_blocks(body, profile["block_splitter"]), entry)
    whole = F.filter(entries, lambda e: has_text(e["title"]) & has_text(e["serial"]))
    return let(whole, lambda w: let(firsts(w), kept))
