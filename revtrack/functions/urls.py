"""URL column functions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import first_group, let


def page_url(base: Column, param: Column, page_num: Column) -> Column:
    """Listing url of one page; boards without a paging parameter have a single url."""
    glue = F.when(F.contains(base, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    paged = F.concat(base, glue, param, F.lit("="), page_num.cast("string"))
    return F.when(param.isNull() | (param == ""), base).otherwise(paged)


def _fold_dots(segments: Column) -> Column:
    """Resolve `.` and `..` path segments."""
    return let(segments, lambda s: F.when(F.array_contains(s, ".") | F.array_contains(s, ".."), _folded(s)).otherwise(F.array_join(s, "/")))


def _folded(segments: Column) -> Column:
    last = F.try_element_at(segments, F.lit(-1))

    def step(path: Column, seg: Column) -> Column:
        parent = F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path)
        return F.when(seg == "..", parent).when(seg == ".", path).otherwise(F.array_append(path, seg))

    folded = F.aggregate(segments, F.array().cast("array<string>"), step)
    closing = F.when(last.isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(folded, closing), "/")


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of `href` as found on page `base` (RFC 3986 reference resolution)."""
    return let(base, lambda b: let(href, lambda h: _resolved(b, h)))


def _resolved(base: Column, href: Column) -> Column:
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)

    def from_here() -> Column:
        parts = F.split(base_path, "/")
        kept = F.when(F.element_at(parts, -1) != "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
        joined = F.concat(kept, F.split(path, "/"))
        return let(joined, lambda j: F.filter(j, lambda s, i: (s != "") | (i == 0) | (i == F.size(j) - 1)))

    folded = _fold_dots(F.when(F.startswith(path, F.lit("/")), F.split(path, "/")).otherwise(from_here()))
    rooted = F.regexp_replace(folded, "^(?!/)", "/")

    return (
        F.when(href == "", base)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, base_path, href))
        .when(F.startswith(href, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(origin, rooted, tail))
    )


def script_link(onclick: Column, rules: Sequence[tuple[str, str]] = fv.SCRIPT_LINK_RULES) -> Column:
    """Path behind a scripted link, null when no rule knows the call."""
    options = []
    for pattern, template in rules:
        pieces = [
            F.regexp_extract(onclick, pattern, int(p[1])) if re.fullmatch(r"\{\d\}", p) else F.lit(p)
            for p in re.split(r"(\{\d\})", template)
            if p
        ]
        options.append(F.when(onclick.rlike(pattern), F.concat(*pieces)))
    return F.coalesce(*options)


def post_url(page: Column, href: Column, onclick: Column) -> Column:
    """Url of a post on a board page; empty when the link leads nowhere."""
    scripted = let(F.coalesce(onclick, F.lit("")), script_link)
    target = let(
        F.coalesce(href, F.lit("")),
        lambda h: F.when(h.isin(*fv.SCRIPT_LINK_HREFS), scripted).when(h != "", h),
    )
    return F.coalesce(resolve_url(page, target), F.lit(""))


def fill(template: Column, name: str, value: Column) -> Column:
    return F.replace(template, F.lit("{" + name + "}"), value)


def publication_url(page: Column, template: Column, seq: Column) -> Column:
    """Download url of a publication, or the page with the sequence as fragment."""
    return F.when(F.coalesce(template, F.lit("")) != "", fill(template, "seq", seq)).otherwise(
        F.concat(page, F.lit("#"), seq)
    )


def url_discriminator(template: Column) -> Column:
    """The parameter that tells one board of a site from another; empty when there is none."""
    return F.coalesce(first_group(template, fv.URL_DISCRIMINATOR), F.lit(""))


def law_url(link: Column, title: Column) -> Column:
    link = F.coalesce(link, F.lit(""))
    return (
        F.when(link == "", F.concat(F.lit(fv.LAW_HOST + fv.LAW_TITLE_PATH), title))
        .when(F.startswith(link, F.lit("http")), link)
        .otherwise(F.concat(F.lit(fv.LAW_HOST), link))
    )
