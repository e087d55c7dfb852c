"""Tool/API payload parsing and flattening (H13-H19) with declared schemas.

Payloads are JSON text columns. Each flattener looks at the payload's type (a VARIANT parse) first. The expected one is
parsed with ``from_json`` and a fixed schema, its item list exploded (``posexplode_outer`` keeps payloads
without items) and the reference's defaults filled in with ``coalesce``. Any other payload keeps one row without an item and
its text in ``fallback``: a summary of the JSON value, or the start of a text that is no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sifter.functions.cleanup import date_part
from sifter.functions.text import _c, explode_positions, let

REPO_SCHEMA = ("total_count int, items array<struct<full_name string, name string, "
               "description string, stargazers_count int, forks_count int, language string, "
               "updated_at string, html_url string>>")
ISSUE_FIELDS = ("title string, number int, state string, user struct<login string>, "
                "created_at string, html_url string")
ISSUE_SCHEMA = f"array<struct<{ISSUE_FIELDS}>>"
PR_SCHEMA = (f"array<struct<{ISSUE_FIELDS}, head struct<ref string>, base struct<ref string>, "
             "draft boolean, merged boolean>>")
FILE_SCHEMA = "name string, size bigint, content string"
CREATED_SCHEMA = "title string, number int, html_url string"


def is_json(text) -> Column:
    """True when the text parses as JSON (VARIANT parse, NULL on failure)."""
    return F.try_parse_json(_c(text)).isNotNull()


def json_or_text(text, schema: str) -> Column:
    """``STRUCT<parsed, text>``: the parsed value when the text is JSON,
    else the text kept as is."""
    c = _c(text)
    ok = is_json(c)
    return F.struct(F.when(ok, F.from_json(c, schema)).alias("parsed"),
                    F.when(~ok, c).alias("text"))


# How much of a text that is no JSON is shown, and around it.
RAW_CHARS = 500
RAW_PREFIX = "Raw content: "


def json_kind(text) -> Column:
    """``object``, ``array``, ``scalar``, or ``text`` when it is no JSON (also for NULL)."""
    kind = F.schema_of_variant(F.try_parse_json(_c(text)))
    return (F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
            .when(kind.isNotNull(), "scalar").otherwise("text"))


def fallback_text(text) -> Column:
    """What is shown of a payload of another type than expected."""
    c = _c(text)
    return F.when(json_kind(c) == "text", F.concat(F.lit(RAW_PREFIX), F.substring(
        F.coalesce(c, F.lit("")), 1, RAW_CHARS), F.lit("..."))).otherwise(summarise_json(c))


def _others(df: DataFrame, json_col: str, keys: list[str], expected: DataFrame, is_expected: Column) -> DataFrame:
    """``expected`` and one fallback row for each payload that is not of its type."""
    rest = df.where(~is_expected).select(*keys, fallback_text(json_col).alias("fallback"))
    return (expected.withColumn("fallback", F.lit(None).cast("string"))
            .unionByName(rest, allowMissingColumns=True))


def flatten_repositories(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """One row per repository item (search results without items keep one row), and a
    ``fallback`` row for a payload that is no search result."""
    searched = (json_kind(json_col) == "object") & (
        F.json_object_keys(F.col(json_col)).isNotNull()
        & (F.array_contains(F.json_object_keys(F.col(json_col)), "items")
           | F.array_contains(F.json_object_keys(F.col(json_col)), "total_count")))
    p = df.where(searched).select(*keys, F.from_json(F.col(json_col), REPO_SCHEMA).alias("p"))
    ex = p.select(*keys, F.coalesce(F.col("p.total_count"), F.lit(0)).alias("total_count"),
                  F.posexplode_outer("p.items").alias("pos", "r"))
    r = F.col("r")
    return _others(df, json_col, keys, ex.select(
        *keys, "total_count", (F.col("pos") + 1).alias("item_no"),
        F.coalesce(r["full_name"], r["name"], F.lit("Unknown")).alias("name"),
        F.when(r["description"].isNull() | (r["description"] == ""), F.lit("No description"))
        .otherwise(r["description"]).alias("description"),
        r["stargazers_count"].alias("stars"), r["forks_count"].alias("forks"),
        r["language"].alias("language"), date_part(r["updated_at"]).alias("updated"),
        (r["stargazers_count"].isNotNull() & r["forks_count"].isNotNull()).alias("has_details"),
        F.coalesce(r["html_url"], F.lit("N/A")).alias("url")), searched)


def _issue_cols(i: Column) -> list[Column]:
    state = F.coalesce(i["state"], F.lit("unknown"))
    return [
        F.coalesce(i["number"].cast("string"), F.lit("N/A")).alias("number"),
        F.coalesce(i["title"], F.lit("No title")).alias("title"),
        state.alias("state"),
        F.coalesce(i["user"]["login"], F.lit("unknown")).alias("user"),
        date_part(i["created_at"]).alias("created"),
        F.coalesce(i["html_url"], F.lit("N/A")).alias("url"),
    ]


def flatten_issues(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """One row per issue; ``is_open`` = state is exactly ``open``. A payload that is no list has a
    ``fallback`` row."""
    listed = json_kind(json_col) == "array"
    p = df.where(listed).select(*keys, F.from_json(F.col(json_col), ISSUE_SCHEMA).alias("a"))
    ex = explode_positions(p, F.col("a"), "pos", "i", *keys)
    i = F.col("i")
    return _others(df, json_col, keys, ex.select(
        *keys, (F.col("pos") + 1).alias("item_no"), *_issue_cols(i),
        (F.coalesce(i["state"], F.lit("unknown")) == "open").alias("is_open")), listed)


def pr_status(state: Column, draft: Column, merged: Column) -> Column:
    """Open / draft / merged / closed / unknown."""
    return (F.when(state == "open", F.when(draft, "draft").otherwise("open"))
            .when(state == "closed", F.when(merged, "merged").otherwise("closed"))
            .otherwise("unknown"))


def flatten_pull_requests(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """Issue fields + head/base branch, draft flag and status. A payload that is no list has a
    ``fallback`` row."""
    listed = json_kind(json_col) == "array"
    p = df.where(listed).select(*keys, F.from_json(F.col(json_col), PR_SCHEMA).alias("a"))
    ex = explode_positions(p, F.col("a"), "pos", "i", *keys)
    i = F.col("i")
    draft = F.coalesce(i["draft"], F.lit(False))
    merged = F.coalesce(i["merged"], F.lit(False))
    return _others(df, json_col, keys, ex.select(
        *keys, (F.col("pos") + 1).alias("item_no"), *_issue_cols(i),
        F.coalesce(i["head"]["ref"], F.lit("unknown")).alias("head"),
        F.coalesce(i["base"]["ref"], F.lit("unknown")).alias("base"), draft.alias("draft"),
        pr_status(F.coalesce(i["state"], F.lit("unknown")), draft, merged).alias("status")), listed)


def file_contents(text) -> Column:
    """``STRUCT<name, size, content, fallback>`` with defaults ``file`` / 0; a payload
    without ``content`` has the fallback text alone."""
    c = _c(text)
    p = F.from_json(F.when(json_kind(c) == "object", c), FILE_SCHEMA)
    held = F.coalesce(F.array_contains(F.json_object_keys(F.when(json_kind(c) == "object", c)), "content"), F.lit(False))
    return F.struct(F.when(held, F.coalesce(p["name"], F.lit("file"))).alias("name"),
                    F.when(held, F.coalesce(p["size"], F.lit(0))).alias("size"),
                    F.when(held, p["content"]).alias("content"),
                    F.when(~held, fallback_text(c)).alias("fallback"))


def created_item(text) -> Column:
    """``STRUCT<title, number, url, fallback>`` with defaults ``Untitled`` / ``N/A``; a payload that
    is no object has the fallback text alone."""
    c = _c(text)
    held = json_kind(c) == "object"
    p = F.from_json(F.when(held, c), CREATED_SCHEMA)
    return F.struct(F.when(held, F.coalesce(p["title"], F.lit("Untitled"))).alias("title"),
                    F.when(held, F.coalesce(p["number"].cast("string"), F.lit("N/A"))).alias("number"),
                    F.when(held, F.coalesce(p["html_url"], F.lit("N/A"))).alias("url"),
                    F.when(~held, fallback_text(c)).alias("fallback"))


def _shown(raw: Column, value: Column) -> Column:
    """A JSON value as Python would print it: ``raw`` is its text, ``value`` the VARIANT that knows its type (the
    string "true" stays as it is)."""
    kind = F.schema_of_variant(value)
    return (F.when(raw.isNull() | (kind == "VOID"), F.lit("None"))
            .when((kind == "BOOLEAN") & (raw == "true"), F.lit("True"))
            .when((kind == "BOOLEAN") & (raw == "false"), F.lit("False")).otherwise(raw))


def summarise_json_object(text) -> Column:
    """H19 for a JSON object: <= 3 keys inline ``k: v | k: v``; more keys as
    ``• k: v`` lines, nested values longer than 50 chars -> ``[complex data]``."""
    c = _c(text)

    def body(m, kinds):
        entries = F.map_entries(m)
        shown = lambda e: _shown(e["value"], kinds[e["key"]])
        inline = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), shown(e))), " | ")
        nested = lambda e: F.schema_of_variant(kinds[e["key"]]).rlike("^(OBJECT|ARRAY)")
        lines = F.array_join(F.transform(entries, lambda e: F.concat(
            F.lit("• "), e["key"], F.lit(": "),
            F.when(nested(e) & (F.length(e["value"]) > 50), F.lit("[complex data]")).otherwise(shown(e)))), "\n")
        return F.when(F.size(m) <= 3, inline).otherwise(lines)
    return let(F.from_json(c, "map<string,string>"), lambda m: let(
        F.from_json(c, "map<string,variant>"), lambda kinds: body(m, kinds)))


def summarise_json_array(text) -> Column:
    """H19 for a JSON array: <= 5 items joined by ``, ``; else ``[n items: a, b, c, ...]``."""
    c = _c(text)

    def body(a, kinds):
        items = F.transform(a, lambda x, i: _shown(x, F.get(kinds, i)))
        return F.when(F.size(a) <= 5, F.array_join(items, ", ")).otherwise(F.concat(
            F.lit("["), F.size(a).cast("string"), F.lit(" items: "),
            F.array_join(F.slice(items, 1, 3), ", "), F.lit(", ...]")))
    return let(F.from_json(c, "array<string>"), lambda a: let(
        F.from_json(c, "array<variant>"), lambda kinds: body(a, kinds)))


def summarise_json(text) -> Column:
    """H19 for any JSON value (a string is shown without its quotes); NULL when it is no JSON."""
    c, kind = _c(text), json_kind(text)
    v = F.try_parse_json(c)
    scalar = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(
        _shown(F.trim(c), v))
    return (F.when(kind == "object", summarise_json_object(F.when(kind == "object", c)))
            .when(kind == "array", summarise_json_array(F.when(kind == "array", c)))
            .when(kind == "scalar", scalar))
