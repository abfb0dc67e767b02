"""Column builders for strings and identifiers; no Python runs on the executors.

Java's ``\\b`` knows Unicode letters; the word edges meant here are ASCII, so
patterns use the look-arounds EDGE_L and EDGE_R instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE_L, EDGE_R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
TOKEN = r"[\p{L}\p{N}_@.$:-]+"

# Words that the ranking and the planner leave out.
RANKING_STOP_WORDS = (
    "a an and are as at be by current do does for from how i in is it latest make of on the to use version when with"
).split()
PLANNER_STOP_WORDS = (
    "a about an and are as at be bedrock by can code current do does example find for from get how i in is it latest "
    "make minecraft of on please search show stable tell the to use version what when where which why with"
).split()


def _regex_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def js_trim(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def strip_backticks(col: Column) -> Column:
    return F.regexp_replace(js_trim(col), "^`+|`+$", "")


def normalize_identifier(col: Column) -> Column:
    """Trimmed, outer backticks and all white space removed, lower case."""
    return F.lower(F.regexp_replace(strip_backticks(col), r"\s+", ""))


def non_empty(parts: Column) -> Column:
    return F.filter(parts, lambda x: x != "")


def identifier_leaf(col: Column) -> Column:
    """Last non-empty segment between dots, colons and slashes; the whole if there is none."""
    clean = strip_backticks(col)
    return F.coalesce(F.try_element_at(non_empty(F.split(clean, "[.:/]")), F.lit(-1)), clean)


def spaced_camel(col: Column) -> Column:
    return F.regexp_replace(col, "([a-z0-9])([A-Z])", "$1 $2")


def identifier_search_terms(col: Column) -> Column:
    """Whole, leaf, and every part with its camel case also spaced; first-seen order."""
    clean = strip_backticks(col)
    parts = non_empty(F.split(clean, "[.:/_@-]+"))
    spread = F.flatten(F.transform(parts, lambda p: F.array(p, spaced_camel(p))))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(clean, identifier_leaf(col)), spread)))


# The identifier families that are looked for in prose.
_NAMESPACED = EDGE_L + r"[A-Za-z_][A-Za-z0-9_.-]*:[A-Za-z_][A-Za-z0-9_./-]*(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_PACKAGE = r"@minecraft/[A-Za-z0-9._-]+"
_PASCAL = (
    EDGE_L + r"[A-Z][A-Za-z0-9]*(?:AfterEvent|BeforeEvent|EventSignal|Component|Controller|Options|Error|Event|Signal|Permission|Permissions"
    r"|Manager|Registry|Result|Type|Mode|State)" + EDGE_R
)
_DOTTED = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?=\$))(?:[A-Za-z_$][A-Za-z0-9_$]*\.)+[A-Za-z_$][A-Za-z0-9_$]*(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=\$)(?=[A-Za-z0-9_]))"
_MOLANG = "(?i)" + EDGE_L + r"(?:query|variable|temp|context|math)\.[A-Za-z_][A-Za-z0-9_.]*(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<=\.)(?=[A-Za-z0-9_]))"
_BACKTICK = r"`([A-Z][A-Za-z0-9]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)?)`"
_TYPE_LINK = r"\[([A-Z][A-Za-z0-9]+)\]\([^)]*\.md(?:#[^)]*)?\)"
_COMMAND = r"(?im)(?:^|[\s`\"'(])/([a-z][a-z0-9_:-]*)" + EDGE_R


def extract_identifiers(col: Column) -> Column:
    """Identifiers of all families in first-seen order, one for each normalised form; dotted ones also give prefixes and leaf."""

    def plain(found: Column) -> Column:
        return F.transform(found, lambda x: F.regexp_replace(js_trim(x), "[.,;:]+$", ""))

    def with_parts(found: Column) -> Column:
        def parts(x: Column) -> Column:
            seg = F.split(x, r"\.")
            n = F.size(seg)
            prefixes = F.when(n > 2, F.transform(F.sequence(F.lit(2), F.greatest(n - 1, F.lit(2))), lambda k: F.array_join(F.slice(seg, 1, k), "."))).otherwise(F.array().cast("array<string>"))
            leaf = F.element_at(seg, -1)
            return F.concat(
                F.array(x),
                F.filter(prefixes, lambda p: F.length(p) > 2),
                F.when((n > 1) & (F.length(leaf) >= 3), F.array(leaf)).otherwise(F.array().cast("array<string>")),
            )

        return F.flatten(F.transform(plain(found), parts))

    every = F.concat(
        plain(_regex_all(col, _NAMESPACED)),
        plain(_regex_all(col, _PACKAGE)),
        plain(_regex_all(col, _PASCAL)),
        with_parts(_regex_all(col, _DOTTED)),
        with_parts(_regex_all(col, _MOLANG)),
        with_parts(_regex_all(col, _BACKTICK, 1)),
        plain(_regex_all(col, _TYPE_LINK, 1)),
        F.transform(_regex_all(col, _COMMAND, 1), lambda x: F.concat(F.lit("/"), x)),
    )
    every = F.filter(every, lambda x: F.length(normalize_identifier(x)) > 1)
    keys = F.transform(every, normalize_identifier)
    return F.filter(F.transform(every, lambda x, i: F.when(F.array_position(keys, normalize_identifier(x)) == i + 1, x)), lambda x: x.isNotNull())


def query_tokens(col: Column) -> Column:
    return _regex_all(col, TOKEN)


def compile_match(col: Column) -> Column:
    """Distinct tokens, quoted, joined by AND; null without a token."""
    tokens = F.array_distinct(query_tokens(col))
    return F.when(F.size(tokens) > 0, F.array_join(F.transform(tokens, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " AND "))


def _terms(col: Column, stop: list[str], most: int) -> Column:
    kept = F.filter(query_tokens(F.lower(col)), lambda t: (F.length(t) > 1) & ~t.isin(*stop))
    return F.slice(F.array_distinct(kept), 1, most)


def meaningful_terms(col: Column) -> Column:
    return _terms(col, RANKING_STOP_WORDS, 8)


def keywords(col: Column) -> Column:
    return _terms(col, PLANNER_STOP_WORDS, 10)


def normalize_whitespace(col: Column) -> Column:
    return F.regexp_replace(js_trim(col), r"\s+", " ")


def clip_ellipsis(col: Column, most: int) -> Column:
    """At most ``most`` characters, the last one an ellipsis if something was cut."""
    cut = F.concat(F.regexp_replace(F.substring(col, 1, most - 1), r"\s+$", ""), F.lit("…"))
    return F.when(F.length(col) <= most, col).otherwise(cut)


def excerpt(content: Column, query: Column, most: Column | int = 1600) -> Column:
    """A window of the content that begins 30 % before the first query token, or its head."""
    most = F.lit(most) if isinstance(most, int) else most
    low = F.lower(content)
    found = F.transform(query_tokens(F.lower(query)), lambda t: F.position(t, low))
    first = F.array_min(F.filter(found, lambda p: p > 0))
    size = F.length(content)
    start = F.greatest(F.lit(0), first - 1 - F.floor(most * 0.3).cast("int"))
    end = F.least(size, start + most)
    start = F.when(end == size, F.greatest(F.lit(0), end - most)).otherwise(start)
    window = F.concat(
        F.when(start > 0, "…").otherwise(""), js_trim(F.substr(content, (start + 1).cast("int"), (end - start).cast("int"))), F.when(end < size, "…").otherwise("")
    )
    head = F.concat(F.regexp_replace(F.substr(content, F.lit(1), (most - 1).cast("int")), r"\s+$", ""), F.lit("…"))
    return F.when(size <= most, content).when(first.isNull(), head).otherwise(window)


def strip_md(col: Column) -> Column:
    """Text without heading marks, bold marks and backticks."""
    return js_trim(F.replace(F.replace(F.regexp_replace(col, r"^#+\s*", ""), F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))


def json_pointer_escape(col: Column) -> Column:
    return F.replace(F.replace(col, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def sha256_text(col: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(col, 256))


def stable_public_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 24 hex digits of the hash of the parts, joined by NUL."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\0", *[p.cast("string") for p in parts]), 256), 1, 24))


def canonical_config_hash(col: Column) -> Column:
    """Hash of a JSON text that does not depend on the order of keys."""
    return F.sha2(F.to_json(F.parse_json(col)), 256)


def iso_compact(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def round_n(col: Column, digits: int) -> Column:
    return F.round(col, digits)


def gain(grade: Column, rank: Column) -> Column:
    """(2 ** grade - 1) / log2(rank + 1), ranks from 1."""
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def sanitize_error(col: Column, most: int = 500) -> Column:
    """No SQL statement and no credentials in URLs; bounded length."""
    no_sql = F.regexp_replace(col, r"(?i)\b(?:SELECT|INSERT|UPDATE|DELETE|PRAGMA)\b[\s\S]*", "[redacted SQL]")
    return F.substring(F.regexp_replace(no_sql, r"//[^/@\s]+@", "//"), 1, most)


def json_result(result: Column, code: Column, message: Column) -> Column:
    """One JSON text: the result, or where there is a code the structured error with what may be said of it in public."""
    bad = F.to_json(F.struct(F.lit(False).alias("ok"), F.struct(code.alias("code"), sanitize_error(message).alias("message")).alias("error")))
    return F.when(code.isNull(), F.to_json(F.struct(F.lit(True).alias("ok"), result.alias("result")))).otherwise(bad)


def member_owner(col: Column) -> Column:
    """What stands before the last dot; null without one inside the name."""
    return F.when(col.rlike(r"^.+\..+$"), F.regexp_extract(col, r"^(.+)\.([^.]+)$", 1))


def member_leaf(col: Column) -> Column:
    return F.when(col.rlike(r"^.+\..+$"), F.regexp_extract(col, r"^(.+)\.([^.]+)$", 2))


def signature_type(content: Column, leaf: Column) -> Column:
    """The simple type after ``leaf:`` in a signature; null if there is none.

    The pattern depends on the row, so the text after the first ``leaf:`` is taken.
    """
    leaf = F.regexp_replace(leaf, r"([^A-Za-z0-9_])", r"\\$1")
    pattern = F.concat(F.lit(EDGE_L), leaf, F.lit(EDGE_R + r"\s*:\s*([A-Z_$][A-Za-z0-9_$]*)"))
    return F.nullif(F.call_function("regexp_extract", content, pattern, F.lit(1)), F.lit(""))


def fts_tokens(col: Column) -> Column:
    """Lower-case letters and digits, Latin diacritics removed; everything else separates."""
    return _regex_all(F.translate(F.lower(col), DIACRITICS, PLAIN), r"[\p{L}\p{N}]+")


# Accented Latin letters and their base letters.
DIACRITICS = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
