"""Clean-up of model and tool output text (H3-H13, H20, F7, F8) as native
regex chains; each function is a Column builder applied row by row.

Python's ``\\s`` is spelled out with :data:`sifter.functions.text.WS` so the
JVM regex engine sees the same whitespace set as the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sifter.functions.text import WS, _c, let, strip_ws

S = f"[{WS}]"  # one whitespace character (Python ``\s``)
NOT_NL = "[^\\n]"  # Python ``.`` without DOTALL

# Marker strings and templates of the reference's formatters.
PROMPT_START = "Begin! This is VERY important"
PROMPT_END = "depends on it!"
CHAR_COUNT_MARKER = "Character count:"
NO_CONTENT = "No content"
NO_CONTENT_AVAILABLE = "No content available"
TRUNCATION_NOTE = "\n... (output truncated for readability)"
LINE_CAP = 100
GENERIC_HEADERS = ["name", "description", "type", "default", "required"]


def unescape(text) -> Column:
    """H3: ``\\n \\r \\t \\" \\' \\\\`` in that order, then ``\\x`` -> ``x``."""
    c = _c(text)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'"),
                 ("\\\\", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"\\([^\n])", "$1")


def _empty_to_blank(text, body) -> Column:
    c = _c(text)
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(body)


def clean_flat(text) -> Column:
    """H4: unescape, every whitespace run -> one space, strip (no newline survives)."""
    c = F.regexp_replace(unescape(text), f"{S}+", " ")
    c = F.regexp_replace(c, f"\\n{S}*\\n{S}*\\n+", "\n\n")
    return _empty_to_blank(text, strip_ws(c))


def clean_lines(text) -> Column:
    """H5: unescape, space runs -> one space, 3+ line breaks -> 2, strip."""
    c = F.regexp_replace(unescape(text), " +", " ")
    c = F.regexp_replace(c, f"\\n{S}*\\n{S}*\\n+", "\n\n")
    return _empty_to_blank(text, strip_ws(c))


def strip_markdown_code(text) -> Column:
    """H6: drop fenced blocks (dot-all), drop backticks, blank-line runs -> one, strip."""
    c = F.regexp_replace(_c(text), "(?s)```.*?```", "")
    c = F.replace(c, F.lit("`"), F.lit(""))
    c = F.regexp_replace(c, f"\\n{S}*\\n", "\n\n")
    return strip_ws(c)


def strip_reasoning(text) -> Column:
    """H7: drop <think> blocks, fences, backticks, the agent prompt, ``Thought:`` lines."""
    c = F.regexp_replace(_c(text), "(?s)<think>.*?</think>", "")
    c = F.regexp_replace(c, "(?s)```.*?```", "")
    c = F.replace(c, F.lit("`"), F.lit(""))
    c = F.regexp_replace(c, f"(?s){PROMPT_START}.*?{PROMPT_END}", "")
    c = F.regexp_replace(c, f"Thought:{NOT_NL}*?\\n", "")
    c = F.regexp_replace(c, f"\\n{S}*\\n", "\n\n")
    return strip_ws(c)


def cut_at_marker(text) -> Column:
    """H8: when ``Character count:`` occurs, keep the lines before the first line
    containing it or ``---``; otherwise the text unchanged."""
    def body(lines):
        stop = F.array_position(F.transform(lines, lambda l: F.contains(l, F.lit(CHAR_COUNT_MARKER))
                                            | F.contains(l, F.lit("---"))), F.lit(True))
        kept = F.when(stop == 0, lines).otherwise(F.slice(lines, 1, stop - 1))
        return strip_ws(F.array_join(kept, "\n"))
    c = _c(text)
    return F.when(F.contains(c, F.lit(CHAR_COUNT_MARKER)), let(F.split(c, "\n", -1), body)).otherwise(c)


def paragraphise(text) -> Column:
    """H9: text of more than 3 lines unchanged (stripped); otherwise line breaks
    before headers, bullets, numbered items, fences and after ``. X``."""
    raw = _c(text)

    def body(c):
        r = c
        for a in ("# ", "## ", "### ", "* ", "- ", "1. ", "2. ", "3. "):
            r = F.replace(r, F.lit(a), F.lit("\n" + a))
        r = F.replace(r, F.lit("```"), F.lit("\n```\n"))
        r = F.regexp_replace(r, f"(\\p{{Nd}}+\\.{S})", "\n$1")
        r = F.regexp_replace(r, f"(\\.{S}+)([A-Z])", "$1\n$2")
        r = F.regexp_replace(r, f"\\n{S}*\\n{S}*\\n", "\n\n")
        r = F.regexp_replace(r, "^\\n+", "")
        well_formed = F.contains(c, F.lit("\n")) & (F.size(F.split(c, "\n", -1)) > 3)
        return F.when(well_formed, c).otherwise(r)

    return F.when(raw.isNull() | (raw == ""), F.lit(NO_CONTENT)).otherwise(let(strip_ws(raw), body))


def strip_links(line) -> Column:
    """``<a name=".."></a> [t](u)`` and ``[t](u)`` -> ``t``."""
    c = F.regexp_replace(_c(line), '<a name="[^"]*"></a> \\[([^\\]]+)\\]\\([^)]+\\)', "$1")
    return F.regexp_replace(c, "\\[([^\\]]+)\\]\\([^)]+\\)", "$1")


def _table_cells(line: Column) -> Column:
    """Cells of a table line with empty first/last cells dropped."""
    def body(cells):
        a = F.when(F.element_at(cells, 1) == "", F.slice(cells, 2, F.size(cells))).otherwise(cells)
        return let(a, lambda b: F.when((F.size(b) > 0) & (F.element_at(b, -1) == ""),
                                       F.slice(b, 1, F.size(b) - 1)).otherwise(b))
    return let(F.transform(F.split(strip_links(line), "\\|", -1), strip_ws), body)


def is_table_line(line) -> Column:
    c = _c(line)
    return F.contains(c, F.lit("|")) & ((F.length(c) - F.length(F.replace(c, F.lit("|"), F.lit("")))) >= 2)


def line_kind(line) -> Column:
    """Classify a stripped markdown line."""
    c = _c(line)
    return (F.when(c == "", "blank")
            .when(is_table_line(c), "table")
            .when(c.startswith("## "), "h2").when(c.startswith("### "), "h3")
            .when(c.startswith("# "), "h1")
            .when(c.startswith("- ") | c.startswith("* ") | c.rlike("^\\p{Nd}+\\. "), "list")
            .when(c.startswith("moduleID:") | c.startswith("Name:") | c.startswith("Description:"), "key")
            .when(c.startswith("Downloads:") | c.startswith("Published:") | c.startswith("Verified:"),
                  "fact")
            .when(c.startswith("Source:") | c.startswith("Version:"), "link")
            .when(c.startswith("```"), "fence")
            .otherwise("text"))


def table_row(line) -> Column:
    """``STRUCT<name, description, is_header>`` of a table line; NULL for
    separators and rows with fewer than two cells."""
    def body(cells):
        name = F.element_at(cells, 1)
        desc = strip_ws(F.array_join(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), " "))
        keep = (F.size(cells) >= 2) & ~name.startswith("---") & ~desc.startswith("---")
        return F.when(keep, F.struct(name.alias("name"), desc.alias("description"),
                                     F.lower(name).isin(GENERIC_HEADERS).alias("is_header")))
    return let(_table_cells(_c(line)), body)


def _format_row(row: Column) -> Column:
    return F.when(row.isNull(), F.lit(None).cast("string")).when(
        row["is_header"], F.concat(F.lit("**"), row["name"], F.lit("** | **"), row["description"],
                                   F.lit("**"))).otherwise(
        F.concat(F.lit("• **"), row["name"], F.lit("**: "), row["description"]))


def _format_line(line: Column) -> Column:
    big = 1 << 30
    return let(line_kind(line), lambda kind: (
        F.when(kind == "blank", F.lit(""))
        .when(kind == "table", let(table_row(line), _format_row))
        .when(kind == "h2", F.concat(F.lit("\n🔷 **"), F.substring(line, 4, big), F.lit("**")))
        .when(kind == "h3", F.concat(F.lit("\n📋 **"), F.substring(line, 5, big), F.lit("**")))
        .when(kind == "h1", F.concat(F.lit("\n🏗️ **"), F.substring(line, 3, big), F.lit("**")))
        .when(kind == "list", F.concat(F.lit("  "), line))
        .when(kind == "key", F.concat(F.lit("**"), line, F.lit("**")))
        .when(kind == "fact", F.concat(F.lit("  📊 "), line))
        .when(kind == "link", F.concat(F.lit("  🔗 "), line))
        .when(kind == "fence", line)
        .otherwise(strip_links(line))))


def format_markdown(text, most_lines: int = LINE_CAP) -> Column:
    """Line-by-line markdown tidy-up, capped at ``most_lines`` with a note (the reference's display has 100)."""
    raw = _c(text)

    def body(c):
        lines = F.transform(F.split(c, "\n", -1), strip_ws)
        out = F.filter(F.transform(lines, _format_line), lambda x: x.isNotNull())
        joined = F.regexp_replace(F.array_join(out, "\n"), f"\\n{S}*\\n{S}*\\n+", "\n\n")

        def cap(all_lines):
            n = F.size(all_lines)
            return F.when(n > most_lines, F.array_join(F.concat(
                F.slice(all_lines, 1, most_lines),
                F.array(F.lit(TRUNCATION_NOTE),
                        F.concat(F.lit("📊 Total: "), n.cast("string"),
                                 F.lit(f" lines, showing first {most_lines}")))), "\n")
            ).otherwise(F.array_join(all_lines, "\n"))

        return let(F.split(joined, "\n", -1), cap)

    prepared = F.replace(F.replace(strip_ws(raw), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("  "))
    return F.when(raw.isNull() | (raw == ""), F.lit(NO_CONTENT_AVAILABLE)).otherwise(let(prepared, body))


def extract_json_object(text) -> Column:
    """Substring from the first ``{`` to the last ``}`` (NULL when none)."""
    c = _c(text)
    start = F.instr(c, "{")
    end = F.length(c) - F.instr(F.reverse(c), "}") + 1
    return F.when((start > 0) & (F.instr(c, "}") > 0) & (end >= start),
                  F.substring(c, start, end - start + 1))


def date_part(ts) -> Column:
    """Date part of an ISO timestamp string, ``N/A`` when absent or empty."""
    c = _c(ts)
    return F.when(c.isNull() | (c == ""), F.lit("N/A")).otherwise(F.substring_index(c, "T", 1))


def line_cap(text, n: int = LINE_CAP) -> Column:
    """first n lines; the caller adds the note when ``size > n``."""
    return F.slice(F.split(_c(text), "\n", -1), 1, n)
