"""Value catalogues (C1, C11) and the Column forms of their value functions.

The reference stores Python lambdas in the catalogues; here every function
value has a name and a Column expression (CASE on the name), so rendering is
JVM-side.  The catalogue itself is tiny and fixed, so it is always broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference), in the reference's order.
SEPARATORS = ["", "::: ", ":: ", ": ", " \n\t", "\n    ", " : ", " - ", " ", "\n ", "\n\t", ":", "::", "- ", "\t"]
SPACES = ["", " ", "\n", " \n", " -- ", "  ", "; \n", " || ", " <sep> ", " -- ", ", ", " \n ", " , ", "\n ", ". ", " ,  "]
TEXT_OPTION_GAPS = ["", " ", "  ", "\t"]
CASE_FNS = ["lambda x: x", "lambda x: x.title()", "lambda x: x.upper()", "lambda x: x.lower()"]
WRAPPERS = ["lambda x: f'({x})'", "lambda x: f'{x}.'", "lambda x: f'{x})'", "lambda x: f'{x} )'",
            "lambda x: f'[{x}]'", "lambda x: f'<{x}>'"]
NUMBER_FORMATS = ["lambda x: x + 1", "lambda x: chr(ord('A') + x)", "lambda x: chr(ord('a') + x)",
                  "lambda x: chr(0x215F + x + 1)", "lambda x: EnumerationPromptFormat.ROMAN_NUMERALS[x]",
                  "lambda x: EnumerationPromptFormat.ROMAN_NUMERALS[x].upper()"]
ROMAN_NUMERALS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv"]
# ---------------------------------------------------------------------------

ACTION_TYPES = {
    "chosen_separator": SEPARATORS,
    "chosen_space": SPACES,
    "chosen_separator_text_and_option": TEXT_OPTION_GAPS,
    "text_descriptor_fn": CASE_FNS,
    "chosen_item_wrapper": WRAPPERS,
    "chosen_number_format": NUMBER_FORMATS,
}


def catalogue_rows(catalogues: dict[str, list[str]] | None = None, mode: str = "all") -> list[tuple]:
    """(mode, action_type, value_idx, value) rows; duplicates keep their own index."""
    catalogues = catalogues or ACTION_TYPES
    return [(mode, t, i, v) for t, vals in catalogues.items() for i, v in enumerate(vals)]


def catalogue(spark: SparkSession, catalogues: dict[str, list[str]] | None = None, mode: str = "all") -> DataFrame:
    """The value catalogue as a (broadcastable) DataFrame."""
    return F.broadcast(spark.createDataFrame(
        catalogue_rows(catalogues, mode), "mode string, action_type string, value_idx int, value string"))


def codepoint_char(cp: Column) -> Column:
    """One character from a Unicode code point (Spark's ``chr`` is byte-only)."""
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def number_label(idx: Column, fmt: Column) -> Column:
    """Label of 0-based item ``idx`` under number format ``fmt`` (an index into NUMBER_FORMATS).

    The Roman-numeral sign format exists for 12 items only (NULL beyond).
    """
    roman = F.array(*[F.lit(r) for r in ROMAN_NUMERALS])
    return (F.when(fmt == 0, (idx + 1).cast("string"))
            .when(fmt == 1, codepoint_char(F.lit(65) + idx))
            .when(fmt == 2, codepoint_char(F.lit(97) + idx))
            .when(fmt == 3, F.when(idx < 12, codepoint_char(F.lit(0x2160) + idx)))
            .when(fmt == 4, F.element_at(roman, idx + 1))
            .otherwise(F.upper(F.element_at(roman, idx + 1))))


# ---------------------------------------------------------------------------
# Fixed values (must equal the reference): split-mode catalogues (C11).
SHORT_TRAIN_SEPARATORS = ["", ": ", " - ", " ", ":", "- ", "::: ", ":: ", "::"]
LONG_TEST_SEPARATORS = [" \n\t", "\n    ", " : ", "\n\t", "\t", "\n "]
SHORT_TRAIN_SPACES = ["", " ", " -- ", " || ", " <sep> ", ", ", " , ", ". "]
LONG_TEST_SPACES = [" \n", "  ", "; \n", " \n ", "\n ", "\n", " ,  "]
COMPOSITIONAL_TRAIN_SEPARATORS = ["", " ", ":", "- ", "\t", "\n "]
COMPOSITIONAL_TEST_SEPARATORS = [" - ", " \n\t", "\n    ", " : ", "\n\t", "::: ", ":: ", ": ", "::"]
COMPOSITIONAL_TRAIN_SPACES = ["", " ", " -- ", " || ", " <sep> ", "\n", ", ", ". ", ";"]
COMPOSITIONAL_TEST_SPACES = [" \n", "  ", "; \n", " \n ", "\n ", " , ", " ,  "]
# ---------------------------------------------------------------------------

SPLIT_MODES = {
    "random": {},
    "space": {"chosen_space": LONG_TEST_SPACES},
    "separator_space": {"chosen_space": LONG_TEST_SPACES, "chosen_separator": LONG_TEST_SEPARATORS},
    "compositional_separator": {"chosen_separator": COMPOSITIONAL_TEST_SEPARATORS},
    "compositional_separator_space": {"chosen_separator": COMPOSITIONAL_TEST_SEPARATORS,
                                      "chosen_space": COMPOSITIONAL_TEST_SPACES},
    "unseen_space": {"chosen_space": [s for s in SPACES if s != "\n"]},
}
TRAIN_MODES = {
    "space": {"chosen_space": SHORT_TRAIN_SPACES},
    "separator_space": {"chosen_space": SHORT_TRAIN_SPACES, "chosen_separator": SHORT_TRAIN_SEPARATORS},
    "compositional_separator": {"chosen_separator": COMPOSITIONAL_TRAIN_SEPARATORS},
    "compositional_separator_space": {"chosen_separator": COMPOSITIONAL_TRAIN_SEPARATORS,
                                      "chosen_space": COMPOSITIONAL_TRAIN_SPACES},
}


def mode_catalogue(mode: str) -> dict[str, list[str]]:
    """C11: the catalogue a split mode samples test formats from."""
    return {**ACTION_TYPES, **SPLIT_MODES[mode]}
