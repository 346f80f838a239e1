"""Text column functions with Python ``str`` semantics, JVM-side (no UDFs).

Each function has a DuckDB twin in ``SQL`` form where the oracle needs it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): characters stripped by the answer cleaner.
STRIP_CHARS = " .,()\n-><"

# Python ``isalpha() or isdigit()`` as a regex class: letters, decimal digits and
# the superscript / subscript / circled digits that Python also calls digits.
# Letter numbers (Roman numeral signs) are neither alpha nor digit in Python.
ALNUM_CLASS = "[\\p{L}\\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨]"

# Python ``str.split()`` whitespace (ASCII whitespace, separators and the
# information separators 0x1c-0x1f).
WS_CLASS = ("[\\t\\n\\x0b\\x0c\\r\\x1c-\\x1f \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
            "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")

# Fixed values (must equal the reference): multiple-choice normalisation maps.
ROMAN_TO_NUMBER = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6",
                   "vii": "7", "viii": "8", "ix": "9", "x": "10", "xi": "11", "xii": "12"}
# Latin letters a..l and the lower-case Roman numeral signs U+2170.. map to 1..12 (rule).
LATIN_TO_NUMBER = {"a": "1", "b": "2", "c": "3", "d": "4", "e": "5", "f": "6", "g": "7", "h": "8", "i": "9", "j": "10", "k": "11", "l": "12"}
FANCY_ROMAN_TO_NUMBER = {"ⅰ": "1", "ⅱ": "2", "ⅲ": "3", "ⅳ": "4", "ⅴ": "5", "ⅵ": "6", "ⅶ": "7", "ⅷ": "8", "ⅸ": "9", "ⅹ": "10", "ⅺ": "11", "ⅻ": "12"}


def clean_text(c: Column) -> Column:
    """``x.strip(' .,()\\n-><').lower()`` - strip first, then lower."""
    return F.lower(F.btrim(c, F.lit(STRIP_CHARS)))


def prefix_match(gen: Column, ans: Column) -> Column:
    """``gen`` starts with ``ans`` and the next character is not a letter/digit."""
    nxt = F.substring(gen, F.length(ans) + 1, 1)
    return gen.startswith(ans) & ((F.length(gen) == F.length(ans)) | ~nxt.rlike(ALNUM_CLASS))


def _lookup(m: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def first_word(c: Column) -> Column:
    """``g.split()[0]``; NULL when the text holds no word (the reference raises)."""
    w = F.regexp_extract(c, f"[^{WS_CLASS[1:-1]}]+", 0)
    return F.when(w != "", w)


def normalize_generation(g: Column, multiple_choice: bool = True) -> Column:
    """First word, clean, decode a ``\\uXXXX`` escape, then Roman -> Latin -> fancy Roman to numbers."""
    w = clean_text(first_word(g))
    hexpart = F.regexp_extract(w, "^[\\\\u]*(.*)$", 1)
    decoded = F.decode(F.unhex(F.lpad(hexpart, 8, "0")), "UTF-32")
    w = F.when(w.startswith("\\u"), decoded).otherwise(w)
    if not multiple_choice:
        return w
    return F.coalesce(F.element_at(_lookup(ROMAN_TO_NUMBER), w),
                      F.element_at(_lookup(LATIN_TO_NUMBER), w),
                      F.element_at(_lookup(FANCY_ROMAN_TO_NUMBER), w), w)


# --- DuckDB twins (used by the oracle SQL) ---------------------------------

def sql_clean(x: str) -> str:
    return f"lower(trim({x}, ' .,()' || chr(10) || '-><'))"


def sql_prefix_match(g: str, a: str) -> str:
    return (f"(starts_with({g}, {a}) AND (length({g}) = length({a}) OR NOT regexp_matches("
            f"substr({g}, length({a}) + 1, 1), '{ALNUM_CLASS}')))")


def sql_map_case(x: str, m: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {x} = '{k}' THEN '{v}'" for k, v in m.items()) + " END"


def sql_normalize(g: str, multiple_choice: bool = True) -> str:
    w0 = sql_clean(f"nullif(regexp_extract({g}, '[^{WS_CLASS[1:-1]}]+', 0), '')")
    w = (f"(CASE WHEN starts_with({w0}, '\\u') THEN chr(CAST('0x' || ltrim({w0}, '\\u') AS INTEGER)) "
         f"ELSE {w0} END)")
    if not multiple_choice:
        return w
    return (f"coalesce({sql_map_case(w, ROMAN_TO_NUMBER)}, {sql_map_case(w, LATIN_TO_NUMBER)}, "
            f"{sql_map_case(w, FANCY_ROMAN_TO_NUMBER)}, {w})")
