"""Compact tabular text of nested data (TOON).

``encode`` renders one Python value; ``encode_json`` is the same over a column
of JSON texts, keeping key order and exact numbers; ``toon_table`` renders the
rows of a DataFrame with a fixed schema by expressions alone.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_.]*$"
NUMBER_LIKE = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
WORDS = ("true", "false", "null")
ESCAPED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}
#: Powers of ten within which numbers are written plainly.
PLAIN_POWERS = range(-6, 21)

_KEY, _NUMBER = re.compile(PLAIN_KEY), re.compile(NUMBER_LIKE)


class Number(str):
    """A JSON number as it was written."""


def loads(text: str):
    def refuse(word: str):
        raise ValueError(f"{word} is not JSON")

    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=refuse)


def quote(s: str) -> str:
    return '"' + "".join(ESCAPED.get(c) or (f"\\u{ord(c):04x}" if c < " " else c) for c in s) + '"'


def _ambiguous(s: str) -> bool:
    return not s or s[0] in " \t-#" or s[-1] in " \t" or s in WORDS or bool(_NUMBER.fullmatch(s))


def key(k: str) -> str:
    return k if _KEY.match(k) and not k.endswith("\n") else quote(k)


def number(text: str) -> str:
    try:
        d = Decimal(text)
    except InvalidOperation:  # an exponent out of any range: only tidied
        mantissa, _, e = text.lower().partition("e")
        return f"{mantissa}e{e if e[:1] in '+-' else '+' + e}"
    if not d:
        return "0"
    sign, digits, scale = d.as_tuple()
    shown = "".join(map(str, digits)).lstrip("0")
    bare = shown.rstrip("0")
    scale += len(shown) - len(bare)
    lead = len(bare) - 1 + scale
    minus = "-" if sign else ""
    if lead in PLAIN_POWERS or re.fullmatch(r"-?\d+(\.)?", text):
        if scale >= 0:
            return minus + bare + "0" * scale
        whole = bare[:scale] or "0"
        return f"{minus}{whole}.{bare[scale:].rjust(-scale, '0')}" if len(bare) > -scale else f"{minus}0.{bare.rjust(-scale, '0')}"
    return f"{minus}{bare[0]}{'.' + bare[1:] if bare[1:] else ''}e{lead:+d}"


def _nested(v) -> bool:
    return isinstance(v, (dict, list))


class Encoder:
    def __init__(self, delimiter: str = ",", indent: int = 2, list_scalars: bool = False):
        self.delimiter, self.step, self.list_scalars = delimiter, " " * indent, list_scalars
        self.special = set(':"\\[]{}') | {delimiter} | {chr(i) for i in range(32)}

    def scalar(self, v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, Number):
            return number(v)
        if isinstance(v, (int, float)):
            return number(json.dumps(v))
        return quote(v) if _ambiguous(v) or self.special & set(v) else v

    def item(self, v) -> str:
        """A scalar on a line of its own needs fewer quotes."""
        if not isinstance(v, str) or isinstance(v, Number):
            return Encoder(",").scalar(v)
        return quote(v) if _ambiguous(v) or v[0] == '"' or ":" in v or any(c < " " for c in v) else v

    def indented(self, lines: list[str]) -> list[str]:
        return [self.step + x for x in lines]

    def count(self, n: int, keyed: bool = False) -> str:
        return f"[{n}{':' if keyed else ''}{self.delimiter if self.delimiter != ',' else ''}]"

    def columns(self, rows: list) -> list[tuple] | None:
        """(name, columns of the group or None) shared by all rows, if they are a table."""
        if not rows or not all(isinstance(r, dict) and r for r in rows) or any(r.keys() != rows[0].keys() for r in rows):
            return None
        out = []
        for name in rows[0]:
            values = [r[name] for r in rows]
            group = self.columns(values) if any(map(_nested, values)) else ()
            if group is None:
                return None
            out.append((name, group or None))
        return out

    def header(self, columns: list[tuple]) -> str:
        return "{" + self.delimiter.join(key(n) + (self.header(g) if g else "") for n, g in columns) + "}"

    def cells(self, row: dict, columns: list[tuple]) -> list[str]:
        return [c for n, g in columns for c in (self.cells(row[n], g) if g else [self.scalar(row[n])])]

    def table(self, head: str, rows: list[dict], columns: list[tuple], names=None) -> list[str]:
        body = [self.delimiter.join(self.cells(r, columns)) for r in rows]
        if names is not None:
            body = [f"{key(n)}: {b}" for n, b in zip(names, body)]
        return [f"{head}{self.count(len(rows), names is not None)}{self.header(columns)}:", *self.indented(body)]

    def named(self, name: str, v) -> list[str]:
        if isinstance(v, dict):
            columns = self.columns(list(v.values())) if len(v) > 1 else None
            if columns:
                return self.table(name, list(v.values()), columns, v)
            return [f"{name}:", *self.indented(self.fields(v))]
        if isinstance(v, list):
            return self.array(name, v) if v else [f"{name}: []"]
        return [f"{name}: {self.scalar(v)}"]

    def fields(self, obj: dict) -> list[str]:
        return [line for k, v in obj.items() for line in self.named(key(k), v)]

    def array(self, head: str, values: list, table: bool = True) -> list[str]:
        if not any(map(_nested, values)):
            if self.list_scalars:
                return [f"{head}{self.count(len(values))}:", *self.indented([f"- {self.item(v)}" for v in values])]
            return [f"{head}{self.count(len(values))}: {self.delimiter.join(map(self.scalar, values))}"]
        columns = self.columns(values) if table else None
        if columns:
            return self.table(head, values, columns)
        return [f"{head}{self.count(len(values))}:", *self.indented([line for v in values for line in self.element(v)])]

    def element(self, v) -> list[str]:
        if isinstance(v, dict):
            first, *rest = self.fields(v) or [""]
            return [f"- {first}".rstrip() if not first else f"- {first}", *self.indented(rest)]
        if isinstance(v, list):
            first, *rest = self.array("", v, table=False) if v else [f"{self.count(0)}:"]
            return [f"- {first}", *rest]
        return [f"- {self.scalar(v)}"]

    def encode(self, v) -> str:
        if isinstance(v, dict):
            columns = self.columns(list(v.values())) if len(v) > 1 else None
            return "\n".join(self.table("", list(v.values()), columns, v) if columns else self.fields(v))
        if isinstance(v, list):
            return "\n".join(self.array("", v)) if v else "[]"
        return self.scalar(v)


def encode(value, **options) -> str:
    return Encoder(**options).encode(value)


def encode_json(c: str | Column, **options) -> Column:
    """TOON of a JSON text column; null where the text is not JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return encode(loads(t), **options)
            except (TypeError, ValueError, RecursionError):
                return None

        return texts.map(one)

    return run(F.col(c) if isinstance(c, str) else c)


def cell(c: Column, kind: str) -> Column:
    """One scalar of a table row, by expressions."""
    if kind == "string":
        bad = c.rlike(r'[:"\\\[\]{},\x00-\x1f]') | c.rlike(r"^[ \t\-#]|[ \t]$") | c.rlike(f"^{NUMBER_LIKE}$") | c.isin("", *WORDS)
        out = F.regexp_replace(c, r'([\\"])', r"\\$1")
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            out = F.replace(out, F.lit(raw), F.lit(shown))
        code = lambda x: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(x))), 4, "0"))
        coded = F.array_join(F.transform(F.split(out, ""), lambda x: F.when((x < " ") & (x != ""), code(x)).otherwise(x)), "")
        out = F.when(c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), coded).otherwise(out)
        return F.coalesce(F.when(bad, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(c), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def table_head(name: str, columns: list[tuple[str, str]], n: Column) -> Column:
    return F.concat(F.lit(f"{name}["), n.cast("string"), F.lit("]{" + ",".join(key(c) for c, _ in columns) + "}:"))


def table_row(columns: list[tuple[str, str]], r: Column) -> Column:
    return F.concat(F.lit("  "), F.concat_ws(",", *(cell(r[c], kind) for c, kind in columns)))


def table_text(name: str, columns: list[tuple[str, str]], rows: Column) -> Column:
    """An array of structs as one table; ``columns``: names and types."""
    return F.concat(table_head(name, columns, F.size(rows)), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("\n"), table_row(columns, r))), ""))


def toon_table(rows: DataFrame, name: str, columns: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., toon): the rows as one table per group, in ``order``.

    Columns must be strings, integers or booleans.
    """
    kinds = dict(rows.dtypes)
    sorted_ = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("r"))))
    got = rows.groupBy(*(by or [])).agg(F.transform(sorted_, lambda x: x["r"]).alias("_rows"))
    return got.select(*(by or []), table_text(name, [(c, kinds[c]) for c in columns], F.col("_rows")).alias("toon"))
