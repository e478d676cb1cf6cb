"""Scalar functions on lines, tokens, paths, commands and times, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once, however often it stands in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# --- predicates ---


def is_error_line(line: str | Column) -> Column:
    return col(line).rlike(P.ERROR_WORDS) | col(line).rlike(P.ERROR_MARKS)


def is_budget_error(line: str | Column) -> Column:
    """The token ceiling's broader predicate; not the same as is_error_line."""
    words = col(line).rlike("(?i)" + "|".join(P.BUDGET_WORDS))
    return words | col(line).startswith(P.BUDGET_MARKS[0]) | F.ltrim(col(line)).startswith(P.BUDGET_MARKS[1])


def is_diagnostic_line(line: str | Column) -> Column:
    return col(line).rlike(P.GCC) | col(line).rlike(P.RUSTC)


def is_bar_line(line: str | Column) -> Column:
    return col(line).rlike(P.BAR) & col(line).rlike(P.AMOUNT)


def level_of(line: str | Column) -> Column:
    """TRACE, DEBUG, INFO, WARN, ERROR or FATAL; null if the line has none."""
    found = F.regexp_extract(col(line), P.LEVEL, 1)
    named = found
    for name, level in P.LEVEL_NAMES.items():
        named = F.when(found == name, level).otherwise(named)
    return F.when(found != "", named)


def is_noise(level: str | Column) -> Column:
    return col(level).isin(*P.NOISE)


def is_container(json: str | Column) -> Column:
    """Whether a text is one valid JSON object or array, and nothing more.

    The parser stops after a first value, so the text is also parsed as the
    only element of an array and as the value of a field.
    """
    t = F.trim(col(json))
    listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    named = F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}")))
    alone = F.try_variant_get(listed, "$[1]", "variant").isNull()
    return F.when(t.rlike(r"^[\[{]"), listed.isNotNull() & named.isNotNull() & alone).otherwise(False)


def is_json_document(text: str | Column) -> Column:
    """One JSON object or array, or at least two lines that each are one."""
    lines = F.filter(F.split(col(text), "\n"), lambda x: F.trim(x) != "")
    many = (F.size(lines) >= 2) & F.forall(lines, is_container)
    return F.when(F.trim(col(text)).rlike(r"^[\[{]"), is_container(text) | many).otherwise(False)


def looks_like_run_id(c: str | Column) -> Column:
    return col(c).rlike("^[0-9]{8}-[0-9]{6}-[0-9a-f]{4}$")


# --- tokens and the savings guard ---


def approx_tokens(text: str | Column) -> Column:
    return F.floor(F.octet_length(col(text)) / 4).cast("long")


def cheap_tokens(text: str | Column) -> Column:
    return F.ceil(F.octet_length(col(text)) / 4).cast("long")


def counted_tokens(text: str | Column, exact=None, ceiling: bool = False) -> Column:
    """Tokens by ``exact`` (a function of a column) where that is worth its cost.

    Texts under 4 KiB or over 4 MiB are estimated, unless a ceiling is set.
    """
    size = F.octet_length(col(text))
    if exact is None:
        return approx_tokens(text)
    return exact(col(text)) if ceiling else F.when(size.between(4 << 10, 4 << 20), exact(col(text))).otherwise(cheap_tokens(text))


def pays(candidate: Column, original: Column) -> Column:
    """The candidate is used only if it has strictly fewer tokens."""
    return candidate < original


def is_close(candidate: Column, original: Column) -> Column:
    """Within a fifth either way: an estimate is not enough then."""
    return (candidate * 5 >= original * 4) & (candidate * 5 <= original * 6)


# --- paths, commands, times ---


def basename(path: str | Column) -> Column:
    return F.regexp_extract(col(path), r"[^/\\]*$", 0)


def file_of(loc: str | Column) -> Column:
    """A location without its trailing :line:column."""
    return F.regexp_replace(col(loc), r"(?::\d+)+$", "")


def relativize(text: str | Column, folder: str) -> Column:
    """Strip ``folder/`` (and file://folder/) where a path starts."""
    quoted = "\\Q" + folder.rstrip("/") + "/\\E"
    return F.regexp_replace(col(text), rf"(?<![\pL\pN/._-])(?:file://)?{quoted}", "")


def relativize_json(json: str | Column, folder: str) -> Column:
    """Every string of a JSON text relativized; keys too, as they name files at times."""
    escaped = folder.rstrip("/").replace("\\", "\\\\").replace('"', '\\"')
    quoted = "\\Q" + escaped + "/\\E"
    return F.regexp_replace(col(json), rf"(?<![\pL\pN/._-])(?:file://)?{quoted}", "")


def command_key(argv: str | Column) -> Column:
    words = F.transform(col(argv), lambda a: F.regexp_replace(F.trim(F.regexp_replace(a, r"(?U)\s+", " ")), "^ | $", ""))
    return F.array_join(words, "\u001f")


def inner_command(argv: str | Column) -> Column:
    """First word of ``sh -c '...'`` that is not an assignment."""
    a = col(argv)
    words = F.filter(F.split(F.trim(F.try_element_at(a, F.lit(3))), r"\s+"), lambda w: ~w.rlike(r"^[A-Za-z0-9_]+=") & (w != ""))
    shell = basename(F.try_element_at(a, F.lit(1))).isin("sh", "bash", "zsh", "dash", "cmd") & F.try_element_at(a, F.lit(2)).isin("-c", "/C", "/c")
    return F.when(shell, F.try_element_at(words, F.lit(1)))


def strip_variant(package: str | Column) -> Column:
    return F.substring_index(col(package), " [", 1)


def wildcard(text: str | Column, rule: str | Column) -> Column:
    """``*`` in a rule stands for any characters."""
    escaped = F.regexp_replace(col(rule), r"([\\%_])", r"\\$1")
    return F.like(col(text), F.replace(escaped, F.lit("*"), F.lit("%")), F.lit("\\"))


def since_interval(value: str):
    """``7d``, ``12h`` or ``30m`` as an interval column; the number is positive."""
    number, unit = value[:-1], value[-1:]
    if not number.lstrip("+").isdigit() or int(number) <= 0 or unit not in ("d", "h", "m"):
        raise ValueError("expected <number><d|h|m>, for example 7d")
    n = F.lit(int(number))
    zero = F.lit(0)
    return F.make_dt_interval(n if unit == "d" else zero, n if unit == "h" else zero, n if unit == "m" else zero)


def run_time(run_id: str | Column) -> Column:
    return F.try_to_timestamp(F.substring(col(run_id), 1, 15), F.lit("yyyyMMdd-HHmmss"))


def clock_seconds(c: str | Column) -> Column:
    """``hh:mm:ss.f`` in seconds; null if malformed."""
    p = F.split(col(c), ":")
    n = lambda i: F.element_at(p, i).try_cast("double")
    return F.when(F.size(p) == 3, n(1) * 3600 + n(2) * 60 + n(3))


def round_duration(c: str | Column) -> Column:
    d = col(c)
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(F.round(d, 3))
