"""Links and embedded JSON-LD records out of page HTML, with built-in expressions only.

None of these shuffles except ``dedup_urls`` and ``cap_rows``, so the same functions
serve batch and streaming inputs.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexivane.functions.binding import let
from lexivane.operators.ranks import global_rank
from lexivane.schemas import JSONLD_RECIPE, RECIPE

# What a recipe link starts with, and the record type looked for.
RECIPE_PREFIX = "/receita/"
RECIPE_TYPE = "Recipe"

# A parser sees no tags inside comments, scripts and style sheets. One alternation in
# a single pass gives whichever opens first precedence, as a parser does.
_OPAQUE = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<script\b.*?(?:</script\s*>|\z)"
    r"|<style\b.*?(?:</style\s*>|\z)"
)
# Quoted attribute values may hold '>'. The possessive loop never backtracks.
_ANCHOR = r"""(?i)<a[\s/](?:[^"'>]++|"[^"]*+"|'[^']*+')*+>"""
# The first attribute of that name: other name=value pairs are passed over whole, so text
# inside their values is never taken for an attribute.
_HREF = (
    r"""(?i)^<a(?:[\s/]*+(?!href[\s=/>])[^\s/>=][^\s/=>]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+))?+)*+"""
    r"""[\s/]*+href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
)
# JSON-LD bodies up to and with their end tag in group 1. Comments and other scripts are
# matched too, with an empty group, so that nothing inside them is taken for a record.
_JSONLD = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"""|<script\b[^>]*?(?<=[\s"'])type\s*=\s*["']?application/ld\+json["']?(?:\s[^>]*)?>(.*?</script\s*>)"""
    r"|<script\b.*?(?:</script\s*>|\z)"
)
_REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}

MAX_TAG = 2**31 - 1  # characters: as many as a string can have

_JSON_OPTIONS = {"allowSingleQuotes": "false"}


def _character(reference: Column) -> Column:
    """What one character reference stands for; unknown names stay as they are."""
    body = F.substring(reference, 2, F.length(reference) - 2)
    number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, F.length(body)), 16, 10)).otherwise(F.substring(body, 2, F.length(body)))
    point = number.cast("long")
    valid = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
    code = F.when(valid, point).otherwise(0xFFFD)
    named = F.element_at(F.map_from_arrays(F.lit(list(_NAMED)), F.lit(list(_NAMED.values()))), body)
    numeric = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(body.startswith("#"), numeric).otherwise(F.coalesce(named, reference))


def _unescaped(text: Column) -> Column:
    """Decode character references in one pass, so decoded text is never decoded again."""
    characters = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), _character)
    pieces = F.zip_with(F.split(text, _REFERENCE, -1), characters, lambda t, c: F.concat(t, F.coalesce(c, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(pieces, "")).otherwise(text)


def link_array(html: str | Column) -> Column:
    """All ``<a href>`` values of a page, in order, duplicates kept."""
    html = F.col(html) if isinstance(html, str) else html
    visible = F.regexp_replace(html, _OPAQUE, "")
    tags = F.regexp_extract_all(visible, F.lit(_ANCHOR), F.lit(0))
    return F.filter(F.transform(tags, _href), lambda h: h.isNotNull())


def _href(tag: Column) -> Column:
    """The value of a tag's ``href``; NULL without one. Most tags begin with it, in quotes."""
    quoted = F.substring_index(F.substring(tag, 10, MAX_TAG), '"', 1)
    given = F.nullif(F.regexp_extract(tag, _HREF, 1), F.lit(""))
    bare = F.when(given.rlike("^[\"']"), F.substring(given, 2, F.length(given) - 2)).otherwise(given)
    return _unescaped(F.when(F.lower(F.left(tag, F.lit(9))) == '<a href="', quoted).otherwise(bare))


def extract_links(
    pages: DataFrame,
    prefix: str = RECIPE_PREFIX,
    base: str | None = None,
    html: str = "html",
    page_url: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    distinct_in_page: bool = False,
) -> DataFrame:
    """One row per link that starts with ``prefix``, made absolute.

    ``base`` is a fixed scheme and host, or NULL to take those of the page itself.
    ``distinct_in_page`` drops repeats inside a page before rows are multiplied; use it
    whenever URLs are deduplicated later.
    """
    links = F.filter(link_array(html), lambda h: h.startswith(prefix))
    if distinct_in_page:
        links = F.array_distinct(links)
    root = F.lit(base)
    if base is None:
        root = F.concat(
            F.try_parse_url(F.col(page_url), F.lit("PROTOCOL")),
            F.lit("://"),
            F.try_parse_url(F.col(page_url), F.lit("HOST")),
        )
    # A plain explode would make the optimizer filter on the size of the array first and so
    # search each page twice.
    exploded = pages.select(*keep, root.alias("_root"), F.explode_outer(links).alias("_href"))
    return exploded.filter(F.col("_href").isNotNull()).select(*keep, F.concat("_root", "_href").alias("url"))


def dedup_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """The set of URLs. Distinct is a partial aggregation: a hot URL shrinks map-side."""
    return df.select(url).distinct()


def cap_rows(df: DataFrame, n: int, by: str = "url", top_n_limit: int = 100_000) -> DataFrame:
    """The first ``n`` rows in ``by`` order, so that the choice is repeatable.

    A top-n is merged by one task, so larger caps go by global ranks.
    """
    if n <= top_n_limit:
        return df.orderBy(by).limit(n)
    return global_rank(df, by, "_rank").filter(F.col("_rank") < n).drop("_rank")


def jsonld_bodies(html: str | Column) -> Column:
    """The bodies of all JSON-LD scripts of a page."""
    html = F.col(html) if isinstance(html, str) else html
    found = F.filter(F.regexp_extract_all(html, F.lit(_JSONLD), F.lit(1)), lambda m: m != "")

    def without_end_tag(m: Column) -> Column:
        return F.left(m, F.length(m) - F.length(F.substring_index(m, "</", -1)) - 2)

    return F.transform(found, without_end_tag)


def extract_jsonld(
    pages: DataFrame,
    type_: str = RECIPE_TYPE,
    schema: T.StructType = JSONLD_RECIPE,
    html: str = "html",
    if_array: bool = False,
    out: str = "record",
) -> DataFrame:
    """The first JSON-LD record of type ``type_`` per page; pages without one drop out.

    Malformed scripts are skipped; so are those that hold NaN or Infinity, which JSON does
    not have. A script that is valid JSON but no object (a list, a
    scalar) or that is empty ends the search of that page without a result, which is
    what the strict mode is for; with ``if_array`` lists are searched like scripts of
    their own and the others are skipped.
    """

    def parsed(body: Column) -> Column:
        opens = F.substring(F.regexp_replace(body, r"^\s+", ""), 1, 1)
        return let(
            F.struct(F.try_parse_json(body).isNotNull().alias("valid"), opens.alias("opens")),
            lambda seen: found_in(body, seen["valid"], seen["valid"] & (seen["opens"] == "{"), seen["opens"]),
        )

    def found_in(body: Column, valid: Column, is_object: Column, opens: Column) -> Column:
        one = F.when(is_object, F.from_json(body, schema, _JSON_OPTIONS))
        if if_array:
            many = F.from_json(body, T.ArrayType(schema), _JSON_OPTIONS)
            return F.when(valid & (opens == "["), many).otherwise(F.array(one))
        stop = (valid & ~is_object) | (body == "")
        return F.array(F.struct(F.coalesce(stop, F.lit(False)).alias("stop"), one.alias("item")))

    found = F.flatten(F.transform(jsonld_bodies(html), parsed))
    if if_array:
        record = F.filter(found, lambda r: r["@type"] == type_)
    else:
        ends = F.filter(found, lambda r: r["stop"] | (r["item"]["@type"] == type_))
        record = F.transform(ends, lambda r: F.when(~r["stop"], r["item"]))
    others = [c for c in pages.columns if c != html]
    # The first one, taken by an outer explode so that no filter repeats the extraction.
    first = F.explode_outer(F.slice(record, 1, 1))
    return pages.select(*others, first.alias(out)).filter(F.col(out).isNotNull())


def flatten_recipe(df: DataFrame, record: str = "record", url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """Nested record to the flat recipe columns, and those to ``keep``; the page URL replaces
    any own URL."""
    r = F.col(record)
    # array_join skips NULLs, but a step without text still counts as an empty one.
    ingredients = F.transform(r["recipeIngredient"], lambda i: F.coalesce(i, F.lit("")))
    steps = F.transform(r["recipeInstructions"], lambda s: F.coalesce(s["text"], F.lit("")))
    values = {
        "name": r["name"],
        "url": F.col(url),
        "image_url": r["image"]["url"],
        "author": r["author"]["name"],
        "date_published": r["datePublished"],
        "description": r["description"],
        "rating_value": r["aggregateRating"]["ratingValue"].try_cast("double"),
        "rating_count": r["aggregateRating"]["ratingCount"].try_cast("double").try_cast("bigint"),
        "keywords": r["keywords"],
        "prep_time": r["prepTime"],
        "cook_time": r["cookTime"],
        "total_time": r["totalTime"],
        "recipe_yield": r["recipeYield"],
        "recipe_category": r["recipeCategory"],
        "ingredients": F.coalesce(F.array_join(ingredients, ", "), F.lit("")),
        "instructions": F.coalesce(F.array_join(steps, " "), F.lit("")),
    }
    return df.select(*(values[name].alias(name) for name in RECIPE.fieldNames()), *keep)
