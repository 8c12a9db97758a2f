"""Law-search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.dates import compact_date
from ..functions.rules import relevant_law_title, rule_type
from ..functions.text import let, strip
from ..functions.urls import law_url
from ..operators.pick import first_per_key, top_per_key
from .items import has_text, item, page

_F = fv.LAW_FIELDS
_RULE = "struct<" + ",".join(f"`{name}`:string" for name in _F.values()) + ">"
_MANY = f"struct<AdmRulSearch:struct<admrul:array<{_RULE}>>>"
_ONE = f"struct<AdmRulSearch:struct<admrul:{_RULE}>>"

RULE_STRUCT = (
    "struct<title:string,rule_type:string,agency_name:string,promulgation_date:date,enforcement_date:date,"
    "law_api_id:string,source_url:string>"
)


def search_error(body: Column, http_status: Column) -> Column:
    """Why a search answer fails the whole agency; null when it does not."""
    refused = F.contains(F.coalesce(F.get_json_object(body, "$.result"), F.lit("")), F.lit(fv.LAW_AUTH_FAILURE))
    return F.when((http_status < 200) | (http_status > 299), F.concat(F.lit("HTTP "), http_status.cast("string"))).when(
        refused, F.lit("law search refused the request")
    )


def relevant_rules(body: Column, own_names: Column, term: Column) -> Column:
    """Rules of one search answer whose title stays relevant without the agency's own names."""
    many = F.from_json(body, _MANY)["AdmRulSearch"]["admrul"]
    one = F.from_json(body, _ONE)["AdmRulSearch"]["admrul"]
    rules = F.filter(F.coalesce(many, F.array(one)), lambda r: r.isNotNull())

    def rule(r: Column) -> Column:
        title = strip(r[_F["title"]])
        return let(title, lambda t: _rule(r, t))

    def _rule(r: Column, title: Column) -> Column:
        return F.struct(
            title.alias("title"),
            rule_type(strip(r[_F["rule_type"]])).alias("rule_type"),
            strip(F.coalesce(r[_F["ministry"]], term)).alias("agency_name"),
            compact_date(r[_F["promulgated"]]).alias("promulgation_date"),
            compact_date(r[_F["enforced"]]).alias("enforcement_date"),
            F.coalesce(r[_F["serial"]], F.lit("")).alias("law_api_id"),
            law_url(r[_F["link"]], title).alias("source_url"),
        )

    return F.filter(F.transform(rules, rule), lambda r: has_text(r["title"]) & relevant_law_title(r["title"], own_names))


def law_page(body: Column, http_status: Column, own_names: Column, term: Column) -> Column:
    def posts(rules: Column) -> Column:
        items = F.transform(
            rules,
            lambda r: item(
                r["title"],
                r["source_url"],
                F.coalesce(r["promulgation_date"], r["enforcement_date"]),
                serial=r["law_api_id"],
            ),
        )
        return page(items, F.size(rules), search_error(body, http_status))

    return let(F.coalesce(relevant_rules(body, own_names, term), F.array().cast(f"array<{RULE_STRUCT}>")), posts)


def admin_rules(pages: DataFrame, max_results: int = 30) -> DataFrame:
    """Rules per agency from landed answers: first of each serial, first `max_results` in order.

    Wants `agency_code, page_num, http_status, body`; page n is the answer to the agency's n-th search
    term. An agency with a refused answer yields no rules.
    """
    names = F.create_map(
        *[x for code, terms in fv.LAW_SEARCH_TERMS.items() for x in (F.lit(code), F.array(*[F.lit(t) for t in terms]))]
    )
    own = F.coalesce(F.try_element_at(names, F.col("agency_code")), F.array().cast("array<string>"))
    term = F.when(F.col("page_num") > 0, F.try_element_at(own, F.col("page_num")))
    known = pages.where(F.size(own) > 0)
    refused = known.where(search_error(F.col("body"), F.col("http_status")).isNotNull()).select("agency_code").distinct()
    rules = (
        known.join(refused, "agency_code", "left_anti")
        .select("agency_code", "page_num", F.posexplode(relevant_rules(F.col("body"), own, term)).alias("pos", "rule"))
        .select("agency_code", "page_num", "pos", "rule.*")
    )
    return top_per_key(distinct_rules(rules, ["agency_code"], "law_api_id"), ["agency_code"], ["page_num", "pos"], max_results)


def distinct_rules(rules: DataFrame, scope: list[str], serial: str) -> DataFrame:
    """First rule of each serial; rules without a serial are all kept."""
    apart = F.when(F.coalesce(F.col(serial), F.lit("")) == "", F.struct("page_num", "pos"))
    return first_per_key(rules.withColumn("_apart", apart), [*scope, serial, "_apart"], ["page_num", "pos"]).drop("_apart")
