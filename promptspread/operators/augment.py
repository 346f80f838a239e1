"""Training-text augmentation (D7-D14) with the leakage guard.

Each conversation x augmentation draws formats (md5 picks) until one's essential
key is no test key.  The draws are a fold inside the row, so nothing is exploded,
joined or repeated; an augmentation without a clean format after ``ATTEMPTS`` draws
is an error, never a lost row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptspread.operators.catalogue import CASE_FNS, SEPARATORS, SPACES
from promptspread.operators.prompts import INSTRUCTION_TAG, RESPONSE_TAG

# Fixed values (must equal the reference): verbalizers of the two turns.
FIRST_VERBALIZERS = ["question", "query", "Q"]
SECOND_VERBALIZERS = ["answer", "reply", "A"]
ATTEMPTS = 200


def _h(key: Column, tag: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(tag))), 1, 8), 16, 10).cast("bigint")


def _pick(values: list[str], key: Column, tag: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_h(key, tag) % len(values)).cast("int") + 1)


def _case_variants(word: str) -> list[str]:
    return [word, word.title(), word.upper(), word.lower()]


def draw_format(key: Column, spaces: list[str] = SPACES, separators: list[str] = SEPARATORS) -> dict[str, Column]:
    """Case fn, separator, space (newline separator => a space holding a newline), verbalizers."""
    fn_idx = (_h(key, "fn") % len(CASE_FNS)).cast("int")
    sep = _pick(separators, key, "sep")
    nl_spaces = [s for s in spaces if "\n" in s]
    space = F.when(F.instr(sep, "\n") > 0, _pick(nl_spaces, key, "space")).otherwise(_pick(spaces, key, "space"))
    v1_idx = (_h(key, "v1") % len(FIRST_VERBALIZERS)).cast("int")
    v2_idx = (_h(key, "v2") % len(SECOND_VERBALIZERS)).cast("int")
    first = F.element_at(F.array(*[F.lit(x) for w in FIRST_VERBALIZERS for x in _case_variants(w)]),
                         v1_idx * 4 + fn_idx + 1)
    second = F.element_at(F.array(*[F.lit(x) for w in SECOND_VERBALIZERS for x in _case_variants(w)]),
                          v2_idx * 4 + fn_idx + 1)
    fn_name = F.element_at(F.array(*[F.lit(x) for x in CASE_FNS]), fn_idx + 1)
    return {"fn_name": fn_name, "separator": sep, "space": space, "first": first, "second": second}


def format_key(space: Column, sep: Column, fn_name: Column, delimiter: str = "") -> Column:
    """Essential key (space, separator, case fn), joined bare unless a delimiter is given (which only separates more)."""
    return F.concat_ws(delimiter, space, sep, fn_name)


def augmented_text(user: Column, assistant: Column, f: dict[str, Column]) -> Column:
    return F.concat(F.lit(INSTRUCTION_TAG), f["first"], f["separator"], user, f["space"], f["second"],
                    f["separator"], F.lit(RESPONSE_TAG), assistant)


def default_text(user: Column, assistant: Column) -> Column:
    """The default format."""
    return F.concat(F.lit(INSTRUCTION_TAG + "Question: "), user, F.lit("\nAnswer: " + RESPONSE_TAG), assistant)


def augment(pairs: DataFrame, n_aug: int, seed: int, test_keys: DataFrame | None,
            spaces: list[str] = SPACES, separators: list[str] = SEPARATORS, delimiter: str = "") -> DataFrame:
    """``n_aug`` augmented texts per conversation, none with a format among ``test_keys`` (fmt_key)."""
    banned = None if test_keys is None else sorted(r["fmt_key"] for r in test_keys.select("fmt_key").distinct().collect())   # one per test format
    if banned is not None:
        every = {delimiter.join((x, y, z)) for y in separators for x in spaces for z in CASE_FNS if "\n" not in y or "\n" in x}
        if every <= set(banned):
            raise ValueError("every format of the catalogue is a test key")

    def candidate(draw: Column) -> Column:
        f = draw_format(F.concat_ws("|", F.lit(str(seed)), F.col("conv_id").cast("string"), F.col("aug_id").cast("string"), draw.cast("string")), spaces, separators)
        key = format_key(f["space"], f["separator"], f["fn_name"], delimiter)
        return F.struct(draw.alias("draw"), *[f[c].alias(c) for c in ("first", "second", "separator", "space")], key.alias("fmt_key"))

    rows = pairs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_aug - 1))).alias("aug_id"))
    if not banned:
        best = candidate(F.lit(0))
    else:
        keys = F.array(*[F.lit(k) for k in banned])
        clean = lambda c: F.when(~F.array_contains(keys, c["fmt_key"]), c)
        none = F.lit(None).cast("struct<draw: int, first: string, second: string, separator: string, space: string, fmt_key: string>")
        best = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), none, lambda found, r: F.when(found.isNotNull(), found).otherwise(F.transform(F.array(candidate(r)), clean)[0]))
        best = F.coalesce(best, F.raise_error(F.lit(f"no clean format in {ATTEMPTS} draws")))
    x = rows.withColumn("f", best)
    fields = {c: F.col(f"f.{c}") for c in ("first", "second", "separator", "space")}
    text = augmented_text(F.col("user_text"), F.col("assistant_text"), fields)
    return x.select("conv_id", "aug_id", "f.draw", "f.fmt_key", "f.separator", "f.space", text.alias("text"))


def split_prompt_label(text: Column) -> tuple[Column, Column]:
    """prompt = part before the response tag without the instruction tag; label = part after it."""
    parts = F.split(text, RESPONSE_TAG, -1)
    return F.replace(parts[0], F.lit(INSTRUCTION_TAG), F.lit("")), parts[1]
