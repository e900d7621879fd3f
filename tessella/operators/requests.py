"""Order requests: fields, route, funding, flags, forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.similarity import similar_names
from tessella.functions.text import normalized, or_blank
from tessella.operators.sampling import chunked

# Header words that set the route, names under which fields come, and where a fund's detail goes.
ROUTES = (("amazon", "Amazon"), ("form", "Pritzker"))
SYNONYMS = {"part #": "catalog", "part number": "catalog", "catalog #": "catalog", "catalog number": "catalog", "cat #": "catalog", "sku": "catalog", "project/grant": "account", "project": "account", "grant": "account", "account to be charged": "account", "qty": "quantity", "amount": "quantity", "link": "url", "product url": "url", "company": "vendor", "supplier": "vendor", "item description": "item", "description": "item", "requested by": "requester", "name": "requester"}
DETAIL_FIELDS = {"amazon": "po_field", "form": "account_to_be_charged", "direct": "po_or_notes"}
FORM_ITEMS = 5


def route(header: Column) -> Column:
    out = None
    for name, word in ROUTES:
        test = F.contains(or_blank(header), F.lit(word))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("direct")


def detail_field(route_: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in DETAIL_FIELDS.items() for x in p)), route_)


def field_name(c: Column) -> Column:
    """The canonical name of a field, through its synonyms."""
    n = normalized(F.regexp_replace(or_blank(c), r"\s*:\s*$", ""))
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in SYNONYMS.items() for x in p)), n), F.regexp_replace(n, " ", "_"))


def needs_funding(account: Column) -> Column:
    return (normalized(account) == "") | normalized(account).startswith("to be determined")


def funding(requests: DataFrame, sources: DataFrame, account: str, name: str = "name", threshold: float = 0.5) -> DataFrame:
    """The best source of each account text at or above the threshold; others are to be asked for (source null)."""
    pairs = similar_names(requests, sources, threshold, account, name)
    best = pairs.groupBy("left_name").agg(F.max_by("right_name", F.struct("similarity", "right_name")).alias("source"))
    return requests.withColumn("left_name", normalized(F.col(account))).join(best, "left_name", "left").drop("left_name")


def flags(quoted: Column, seen: Column, stock: Column | None = None, login: Column | None = None, matches: Column | None = None) -> Column:
    tests = [(seen.isNotNull() & quoted.isNotNull() & (quoted != seen), "price_differs")]
    if stock is not None:
        tests.append((~F.coalesce(stock, F.lit(False)), "out_of_stock"))
    if matches is not None:
        tests.append((F.coalesce(matches, F.lit(0)) != 1, "ambiguous"))
    if login is not None:
        tests.append((F.coalesce(login, F.lit(False)), "login_needed"))
    return F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda x: x.isNotNull())


def clean_lab_alert(header: Column) -> Column:
    return F.when(or_blank(header).rlike("(?i)clean[ -]?lab"), "*** CLEAN LAB ORDER ***")


def forms(items: DataFrame, request: str, order: list[str]) -> DataFrame:
    """Items of a request in forms of at most five."""
    return chunked(items, [request], order, FORM_ITEMS, "form")
