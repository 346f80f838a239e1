"""Field extraction by the task layouts' own templates (B4-B7): literal anchors instead of one regex after another.

A template is a row of literals with holes between them, and a hole takes one or
more characters of the field class.  Holes are greedy, so of all ways to read a
text the one wins whose literals stand as far right as they can, the last one
first.  That reading needs no backtracking: from the end of the text, every literal
is taken at its last place before the one already found.  Each literal is searched
once, from where the search before it stopped; of an enumeration the longest
template that fits is taken, and one whose rarest item is not in the text fails on
its first search.  The characters of the text are checked once for all templates.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptspread.operators import format_space as S
from promptspread.operators import layouts as L
from promptspread.operators.instances import FIELD_CLASS, HOLE


def own_text(r: L.Relations, length: int | None = None) -> str:
    """A layout's own text without its output field, with ``length`` items of an enumeration at most."""
    shown = [p for p in r.parts if not p[4] & L.OUTPUT and (length is None or p[3] <= length)]
    return "".join(texts[0] if cell < 0 else texts[r.cells[cell][1] - base] for cell, base, texts, _, _ in shown)


@lru_cache(None)
def bank() -> list[list[tuple[int, str]]]:
    """Per layout its templates as (enumeration length, text), longest first; length 0 for layouts without a range."""
    out = []
    for r in L.RELATIONS.values():
        low, high = r.layout.lengths or (0, 0)
        out.append([(n, own_text(r, n or None)) for n in range(high, low - 1, -1)])
    return out


def matched(text: Column) -> Column:
    """struct(length, fields) of the longest template of the row's layout that fits the text, else null."""
    rows, literals = [], []
    for templates in bank():
        rows.append([])
        for length, template in templates:
            parts = [p[::-1] for p in template.split(HOLE)][::-1]
            if not all(parts[1:-1]):
                raise ValueError(f"two holes without a literal between them: {template!r}")
            rows[-1].append((length, len(literals), len(parts)))
            literals += parts
    t, literal = S.Table("length first n", rows), S.strings(literals)
    field_type = "struct<at: int, ok: boolean, fields: array<string>>"

    def read(back: Column, row: Column) -> Column:
        """The text, backwards, against one template: after its last literal, hole and literal in turn."""
        last, n = F.get(literal, t.first(row)), t.n(row)
        start = F.struct((F.length(last) + 1).alias("at"), F.startswith(back, last).alias("ok"), F.array().cast("array<string>").alias("fields")).cast(field_type)

        def step(s: Column, k: Column) -> Column:
            part = F.get(literal, t.first(row) + k)
            end = F.length(back) - F.length(part) + 1
            anchored = F.when((end > s["at"]) & F.endswith(back, part), end).otherwise(0)   # the template's first literal begins the text
            found = F.when(k == n - 1, anchored).otherwise(F.call_function("locate", part, back, s["at"] + 1))
            return F.when(~s["ok"], s).otherwise(F.transform(F.array(found), lambda at: F.struct(
                (at + F.length(part)).alias("at"), (at > 0).alias("ok"),
                F.concat(F.array(F.reverse(F.substring(back, s["at"], at - s["at"]))), s["fields"]).alias("fields")).cast(field_type))[0])

        done = F.aggregate(F.sequence(F.lit(1), n - 1), start, step)
        return F.transform(F.array(done), lambda s: F.when(s["ok"], F.struct(t.length(row).alias("length"), s["fields"].alias("fields"))))[0]

    def longest(back: Column) -> Column:
        none = F.lit(None).cast("struct<length: int, fields: array<string>>")
        return F.aggregate(t.rows(), none, lambda found, row: F.when(found.isNotNull(), found).otherwise(read(back, row)))

    fits = text.rlike(f"\\A{FIELD_CLASS}+\\z")
    return F.when(fits, F.transform(F.array(F.reverse(text)), longest)[0])


def parsed(rows: DataFrame, text: str = "input") -> DataFrame:
    """Rows with a layout ``number`` -> plus ``parsed``, null where no template fits."""
    return S.held(rows, "parsed", matched(F.col(text)))


def extracted(rows: DataFrame, text: str = "input") -> DataFrame:
    """Rows that a template fits, with ``enum_len`` and ``fields``."""
    x = S.held(rows, "_p", matched(F.col(text)), lambda p: p.isNotNull())
    return x.select("*", F.col("_p.length").alias("enum_len"), F.col("_p.fields").alias("fields")).drop("_p")


def rejected(rows: DataFrame, text: str = "input") -> DataFrame:
    """Rows no template fits, with the characters outside the field class, sorted."""
    x = S.held(rows, "_p", matched(F.col(text)), lambda p: p.isNull()).drop("_p")
    odd = F.array_distinct(F.split(F.regexp_replace(F.col(text), FIELD_CLASS, ""), ""))
    return x.withColumn("bad_chars", F.array_join(F.array_sort(F.filter(odd, lambda c: c != "")), ""))


def bank_sql() -> str:
    """CTE ``bank`` (template, enum_len, text)."""
    return S._values("bank", "template, enum_len, text", [(name, n, text) for name, templates in zip(S.NAMES, bank()) for n, text in templates])
