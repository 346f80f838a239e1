"""Format space (C2-C14, C18): draws, effective values, validity and rendering over the layout relations.

All layouts run in one plan: a format row carries its layout's number, and a few
array expressions read that layout's relations from constants (39 layouts, so they
are fixed and small).  Applying a format is a fold over its slots that writes
cells; validity asks the cells three kinds of questions; rendering picks every
part's text by a cell.

Draws never repeat.  The assignments of a layout are numbered by mixed radix; a
generalised Feistel network permutes the numbers: they are pairs (left, right) of
the first and the last slots' numbers, and each round adds a keyed function of one
half to the other, modulo the half's own size.  So the k-th draw is the k-th number
of a keyed permutation, and the draws end when every assignment has come.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import lru_cache
from math import prod

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.operators import layouts as L
from promptspread.operators.catalogue import SPLIT_MODES
from promptspread.session import shared_path

ROUNDS = 6
PRIME = (1 << 31) - 1      # of the round function; products stay below 2 ** 62
NAMES = list(L.RELATIONS)
KINDS = list(L.VALUES)
MODES = tuple(SPLIT_MODES)


def mode_codes(mode: str) -> dict[str, list[int]]:
    """C11: the values a split mode draws from, per type; a value listed twice keeps both numbers."""
    chosen = SPLIT_MODES[mode]
    out = {}
    for kind in KINDS:
        base = list(range(L.OFFSET[kind], L.OFFSET[kind] + L.size(kind)))
        if kind in chosen:
            if mode == "unseen_space":   # the catalogue without one value
                base = [c for c in base if L.CODES[c][1] in chosen[kind]]
            else:
                base = [L.code(kind, v) for v in chosen[kind]]
        out[kind] = base
    return out


@lru_cache(None)
def sizes(name: str, mode: str = "random") -> tuple[int, int, list[int], list[int]]:
    """(assignments, size of the right half, size and stride of every slot) of a layout under a mode's catalogue."""
    counts = [len(mode_codes(mode)[s[0]]) for s in L.RELATIONS[name].slots]
    strides = [prod(counts[i + 1:]) for i in range(len(counts))]
    # the cut that makes both halves about equally large
    half = min((prod(counts[i:]) for i in range(len(counts) + 1)), key=lambda right: max(right, prod(counts) // right))
    return prod(counts), half, counts, strides


@lru_cache(None)
def _text_lists() -> dict[tuple, int]:
    """Numbers of the text choices that parts refer to."""
    out: dict[tuple, int] = {}
    for r in L.RELATIONS.values():
        for cell, base, texts, _, _ in r.parts:
            out.setdefault((base, tuple(texts)), len(out))
    return out


def numbers(values: list[int], kind: str = "int") -> Column:
    """A constant array; one literal that the optimizer turns into the array once, however long it is."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def strings(values: list[str]) -> Column:
    return F.split(F.lit("\x1f".join(values)), "\x1f", -1)


def of_layout(values: list[int], kind: str = "int") -> Column:
    """The row's layout's entry of a constant array."""
    return F.get(numbers(values, kind), F.col("number"))


class Table:
    """A constant table with some rows for each layout: ``rows()`` are the numbers of the row's layout's rows, and
    ``field(i)`` reads row ``i``."""

    def __init__(self, fields: str, rows: list[list[tuple]]):
        flat = [r for part in rows for r in part]
        self._columns = {name: numbers([int(r[k]) for r in flat], "bigint" if name == "stride" else "int") for k, name in enumerate(fields.split())}
        self._starts, self._sizes, self._n = [sum(map(len, rows[:i])) for i in range(len(rows))], [len(r) for r in rows], len(flat)

    def rows(self) -> Column:
        return F.slice(F.sequence(F.lit(0), F.lit(max(0, self._n - 1))), of_layout(self._starts) + 1, of_layout(self._sizes))

    def size(self) -> Column:
        return of_layout(self._sizes)

    def row(self, nth: Column) -> Column:
        """The number of the layout's nth row."""
        return of_layout(self._starts) + nth

    def __getattr__(self, name: str):
        column = self._columns[name]
        return lambda i: F.get(column, i)


@lru_cache(None)
def _slot_rows(modes: tuple[str, ...]) -> list[list[tuple]]:
    return [[(KINDS.index(s[0]), size, stride, mode, *s[1:]) for s, size, stride in zip(L.RELATIONS[n].slots, *sizes(n, m)[2:])]
            for mode, m in enumerate(modes) for n in NAMES]


def slots(modes: tuple[str, ...] = ("random",)) -> Table:
    return Table("kind size_of stride mode cell rule sep gap space", _slot_rows(modes))


@lru_cache(None)
def _value_rows(modes: tuple[str, ...]) -> tuple[list[int], list[int]]:
    """All catalogues' codes, and where those of a mode's type begin."""
    codes, starts = [], []
    for m in modes:
        for k in KINDS:
            starts.append(len(codes))
            codes += mode_codes(m)[k]
    return codes, starts


def catalogue_value(mode: Column, kind: Column, digit: Column, modes: tuple[str, ...] = ("random",)) -> Column:
    """The code of the digit-th value of a type in a mode's catalogue."""
    codes, starts = _value_rows(modes)
    return F.get(numbers(codes), F.get(numbers(starts), mode * len(KINDS) + kind) + digit)


def layout_number(template: Column, mode: int = 0) -> Column:
    """A layout's number from its name."""
    return (F.array_position(strings(NAMES), template) - 1 + mode * len(NAMES)).cast("int")


def spread(spark) -> int:
    """Partitions to deal few rows to that each take long; adaptive execution would put them into one."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_layouts(rows: DataFrame, modes: tuple[str, ...] = ("random",)) -> DataFrame:
    """Every row once for each layout (and mode): columns ``template``, ``mode`` and ``number``."""
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(modes) * len(NAMES) - 1))).alias("number"))
    mode = F.get(strings(list(modes)), F.floor(F.col("number") / len(NAMES)).cast("int"))
    return each.withColumns({"template": F.get(strings(NAMES), F.col("number") % len(NAMES)), "mode": mode})


# ------------------------------------------------------------------------ draws

def _number(*key: Column) -> Column:
    """The first 24 bits of an md5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key)), 1, 6), 16, 10).cast("bigint")


def round_keys(seed: str, name: Column) -> Column:
    """Keys of all rounds, a multiplier and two addends for each, from a name."""
    return F.array(*[_number(F.lit(seed), name, F.lit(f"{r}{part}")) + 1 for r in range(ROUNDS) for part in "acd"])


def layout_keys(seed: str, modes: tuple[str, ...] = ("random",)) -> Column:
    """The same keys for each layout's own name, as constants."""
    def key(name: str, part: str) -> int:
        return int(hashlib.md5(f"{seed}|{name}|{part}".encode()).hexdigest()[:6], 16) + 1

    rows = [key(n, f"{r}{part}") for _ in modes for n in NAMES for r in range(ROUNDS) for part in "acd"]
    return F.slice(numbers(rows, "bigint"), F.col("number") * (3 * ROUNDS) + 1, 3 * ROUNDS)


def permuted(k: Column, n: Column, half: Column, keys: Column) -> Column:
    """The k-th number of the keyed permutation of 0 .. n-1."""
    whole = lambda x: F.floor(x).cast("bigint")
    start = F.struct(whole(k / half).alias("l"), (k % half).alias("r"))

    def step(s: Column, i: Column) -> Column:
        key = lambda part: F.get(keys, 3 * i + part)

        def mixed(x: Column) -> Column:
            u = (x * key(0) + key(1)) % PRIME
            return (u * (F.shiftright(u, 7) + key(2))) % PRIME

        left = F.struct(((s["l"] + mixed(s["r"])) % whole(n / half)).alias("l"), s["r"].alias("r"))
        right = F.struct(s["l"].alias("l"), ((s["r"] + mixed(s["l"])) % half).alias("r"))
        return F.when(i % 2 == 0, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["l"] * half + s["r"])


def unranked(number: Column, modes: tuple[str, ...] = ("random",)) -> Column:
    """Values (codes) of the assignment with this number; the last slot counts fastest."""
    t = slots(modes)
    digit = lambda i: (F.floor(number / t.stride(i)) % t.size_of(i)).cast("int")
    return F.transform(t.rows(), lambda i: catalogue_value(t.mode(i), t.kind(i), digit(i), modes))


def assignments(modes: tuple[str, ...] = ("random",)) -> Column:
    """Number of assignments of the row's layout."""
    return of_layout([sizes(n, m)[0] for m in modes for n in NAMES], "bigint")


def drawn(rows: DataFrame, seed: str, draw: str = "format_id", name: str | None = None, modes: tuple[str, ...] = ("random",)) -> DataFrame:
    """Add ``codes``, the draw-th assignment of each row's layout, keyed by the layout's or another name; draws beyond the last one go."""
    n, half = assignments(modes), of_layout([sizes(x, m)[1] for m in modes for x in NAMES], "bigint")
    keys = layout_keys(seed, modes) if name is None else round_keys(seed, F.col(name))
    inside = rows.where((F.col(draw) >= 0) & (F.col(draw) < n))
    keyed = inside.select("*", n.alias("_n"), half.alias("_half"), keys.alias("_keys"))
    indexed = held(keyed, "_index", permuted(F.col(draw).cast("bigint"), F.col("_n"), F.col("_half"), F.col("_keys"))).drop("_n", "_half", "_keys")
    return held(indexed, "codes", unranked(F.col("_index"), modes)).drop("_index")


# ------------------------------------------------------------------- evaluation

def _bit(mask: int, code: Column) -> Column:
    return F.call_function("shiftright", F.lit(mask).cast("bigint"), code).bitwiseAND(F.lit(1)) == 1


PLANE = 20   # a layout has fewer cells; a state holds three bits of every cell, 20 apart: newline, empty, blank
UNWRITTEN = 63   # no layout has a slot of this number


@lru_cache(None)
def _write_rows() -> list[list[tuple]]:
    """For every slot its cell and rule, the bits of the cells whose newline needs one in the space cell, and that cell's."""
    bits = lambda *cells: sum(1 << c for c in set(cells) if c >= 0)
    return [[(s[1], s[2], bits(s[3], s[4]), bits(s[5])) for s in r.slots] for r in L.RELATIONS.values()]


def _flags(code: int) -> int:
    return sum((mask >> code & 1) << at * PLANE for at, mask in enumerate((L.NEWLINE, L.EMPTY, L.BLANK)))


def _written(codes: Column, finish) -> Column:
    """All writes in slot order as a fold over numbers: ``finish`` gets struct(cells, took), bits of the cells' values
    (newline, empty, blank) and of the slots whose write was accepted."""
    t = Table("cell rule others space", _write_rows())
    first, flags_of = t.row(F.lit(0)), numbers([_flags(c) for c in range(len(L.CODES))], "bigint")
    init = of_layout([sum(_flags(c[1]) << i for i, c in enumerate(r.cells)) for r in L.RELATIONS.values()], "bigint")
    left = lambda x, by: F.call_function("shiftleft", x, by)
    every = F.lit(sum(1 << at * PLANE for at in range(3))).cast("bigint")
    one = F.lit(1).cast("bigint")
    has = lambda flags, at: flags.bitwiseAND(F.lit(1 << at * PLANE).cast("bigint")) != 0

    def write(s: Column, i: Column) -> Column:
        flags = F.coalesce(F.get(flags_of, F.get(codes, i - first)), F.lit(0).cast("bigint"))
        new = s["cells"].bitwiseAND(F.bitwise_not(left(every, t.cell(i)))).bitwiseOR(left(flags, t.cell(i)))
        rule = t.rule(i)

        def judged(x: Column) -> Column:
            fits = (F.when(rule == L.ALWAYS, True).when(rule == L.BLANK_ONLY, has(x["flags"], 2)).when(rule == L.NOT_EMPTY, ~has(x["flags"], 1))
                    .otherwise((x["new"].bitwiseAND(t.others(i)) == 0) | (x["new"].bitwiseAND(t.space(i)) != 0)))
            return F.when(fits, F.struct(x["new"].alias("cells"), s["took"].bitwiseOR(left(one, i - first)).alias("took"))).otherwise(s)

        return F.transform(F.array(F.struct(flags.alias("flags"), new.alias("new"))), judged)[0]

    return F.aggregate(t.rows(), F.struct(init.alias("cells"), F.lit(0).cast("bigint").alias("took")), write, finish)


def applied(codes: Column) -> Column:
    """struct(cells, rejected) after all writes in slot order; a rejected write leaves its cell as it was."""
    writers = [[[i for i, s in enumerate(r.slots) if s[1] == c] for c in range(len(r.cells))] for r in L.RELATIONS.values()]
    most = max(len(w) for part in writers for w in part)
    named = [f"w{k}" for k in range(most)]   # the slots that write a cell, the last one first
    t = Table(" ".join(["code", *named]), [[(c[1], *(w[::-1] + [UNWRITTEN] * most)[:most]) for c, w in zip(r.cells, part)] for r, part in zip(L.RELATIONS.values(), writers)])

    def value(s: Column, j: Column) -> Column:
        out = F.when(F.lit(False), t.code(j))
        for name in named:
            slot = getattr(t, name)(j)
            out = out.when(F.call_function("shiftright", s["took"], slot).bitwiseAND(F.lit(1)) == 1, F.get(codes, slot))
        return out.otherwise(t.code(j))

    n_slots = of_layout([len(r.slots) for r in L.RELATIONS.values()])
    return _written(codes, lambda s: F.struct(F.transform(t.rows(), lambda j: value(s, j)).alias("cells"), (n_slots - F.bit_count(s["took"])).alias("rejected")))


def gives_valid(codes: Column) -> Column:
    """C6 for an assignment of catalogue values: whether the layout's effective values are valid, without building them."""
    rs = L.RELATIONS.values()
    needed: list[dict[int, int]] = [{} for _ in rs]   # of a cell: the cells whose newline needs one in it
    for r, need in zip(rs, needed):
        for a, b in r.implies:
            need[b] = need.get(b, 0) | 1 << a
    implies = Table("of needs", [[(of, 1 << b) for b, of in need.items()] for need in needed])
    plane = lambda cells, at: sum(1 << c for c in set(cells)) << at * PLANE
    filled, blank = (of_layout([plane(get(r), at) for r in rs], "bigint") for at, get in ((1, lambda r: r.filled), (2, lambda r: r.blank)))
    return _written(codes, lambda s: (s["cells"].bitwiseAND(filled) == 0) & (s["cells"].bitwiseAND(blank) == blank)
                    & F.forall(implies.rows(), lambda i: (s["cells"].bitwiseAND(implies.of(i)) == 0) | (s["cells"].bitwiseAND(implies.needs(i)) != 0)))


def is_valid(cells: Column) -> Column:
    """Newlines only where they are allowed, nothing empty that must not be, blank where only blanks may stand."""
    at = lambda cell: F.get(cells, cell)
    implies = Table("a b", [r.implies for r in L.RELATIONS.values()])
    filled, blank = (Table("cell", [[(c,) for c in get(r)] for r in L.RELATIONS.values()]) for get in (lambda r: r.filled, lambda r: r.blank))
    return (F.forall(implies.rows(), lambda i: ~_bit(L.NEWLINE, at(implies.a(i))) | _bit(L.NEWLINE, at(implies.b(i))))
            & F.forall(filled.rows(), lambda i: ~_bit(L.EMPTY, at(filled.cell(i)))) & F.forall(blank.rows(), lambda i: _bit(L.BLANK, at(blank.cell(i)))))


@lru_cache(None)
def _part_rows() -> tuple[list[str], list[list[tuple]]]:
    """All texts a part can show, and the parts: their cell (-1: none), what to add to the cell's code for the place of
    the text, item and flag."""
    texts, starts = [], {}
    for base, options in _text_lists():
        starts[base, options] = len(texts)
        texts += ["\x00" if t is None else t for t in options]
    return texts, [[(cell, starts[base, tuple(options)] - base, item, flag) for cell, base, options, item, flag in r.parts] for r in L.RELATIONS.values()]


def rendered(cells: Column, length: Column | None = None, output: bool = True, output_hole: bool = True) -> Column:
    """The format's text with ``{}`` for holes; null if an item has no numeral.

    ``length`` prints that many items of an enumeration at most, ``output`` and
    ``output_hole`` say whether the output field and its hole are printed.
    """
    without = (0 if output else L.OUTPUT) | (0 if output_hole else L.OUTPUT_HOLE)
    texts, rows = _part_rows()
    if without:
        rows = [[p for p in part if not p[3] & without] for part in rows]
    t, words = Table("cell place item flag", rows), strings(texts)
    kept = t.rows() if length is None else F.filter(t.rows(), lambda i: t.item(i) <= length)
    shown = F.transform(kept, lambda i: F.get(words, t.place(i) + F.when(t.cell(i) < 0, 0).otherwise(F.get(cells, t.cell(i)))))
    return F.transform(F.array(shown), lambda x: F.when(~F.array_contains(x, "\x00"), F.array_join(x, "")))[0]


def held(rows: DataFrame, name: str, value: Column, keep=None) -> DataFrame:
    """Add a column that is computed once for each row, whatever filters and columns use it later (a filter would be
    pushed below a plain column and evaluate it again for every use); ``keep`` drops rows by its value."""
    out = rows.select("*", F.explode(F.array(value)).alias(name))
    # (a filter inside the array would make the optimizer infer one on its size, which computes the value a second time)
    return out if keep is None else out.where(keep(F.col(name)))


def evaluated(rows: DataFrame, only_valid: bool = False) -> DataFrame:
    """Rows with ``codes`` and a layout number -> plus ``cells``, ``rejected`` and ``valid``."""
    result = F.transform(F.array(applied(F.col("codes"))), lambda a: F.struct(a["cells"].alias("cells"), a["rejected"].alias("rejected"), is_valid(a["cells"]).alias("valid")))[0]
    return held(rows, "_e", result, (lambda e: e["valid"]) if only_valid else None).select("*", "_e.*").drop("_e")


def with_text(rows: DataFrame, name: str = "format_text", **how) -> DataFrame:
    """Rows with ``cells`` -> plus their text; formats without one (an item beyond the numerals) go."""
    return held(rows, name, rendered(F.col("cells"), **how), lambda t: t.isNotNull())


def filled_in(text: Column, cells: Column) -> Column:
    """The text with every ``{object_item}`` replaced by the item's number under the format; null if one has none."""
    labels = [[(f"{{{label}_{i}}}", cell, item) for label, (cell, items) in r.labels.items() for i, item in enumerate(items, 1)] for r in L.RELATIONS.values()]
    places, items = sorted({p[0] for part in labels for p in part}), sorted({p[2] for part in labels for p in part})
    t = Table("name cell item", [[(places.index(name), cell, items.index(item)) for name, cell, item in part] for part in labels])
    words = strings(["\x00" if x is None else x for item in items for x in L.numbered(item)])
    word = lambda i: F.get(words, t.item(i) * len(L.VALUES[L.NUMBER]) + F.get(cells, t.cell(i)) - L.OFFSET[L.NUMBER])
    out = F.aggregate(t.rows(), text, lambda x, i: F.replace(x, F.get(strings(places), t.name(i)), word(i)))
    return F.when(~F.contains(out, F.lit("\x00")), out)


def slot_kinds() -> Column:
    """Types of the row's layout's slots, in order."""
    t = slots()
    return F.transform(t.rows(), lambda i: F.get(strings(KINDS), t.kind(i)))


FIRST_OF_NAME = [L.CODES.index(c) for c in L.CODES]


def first_name(code: Column) -> Column:
    """The first code with the same name."""
    return F.get(numbers(FIRST_OF_NAME), code)


def names(codes: Column) -> Column:
    """Value names of an assignment."""
    listed = strings([v for _, v in L.CODES])
    return F.transform(codes, lambda c: F.get(listed, c))


def from_names(values: Column) -> Column:
    """Value names back to codes; a name listed twice resolves to its first place."""
    known = strings([f"{kind}:{v}" for kind, v in L.CODES])
    return F.transform(F.arrays_zip(slot_kinds().alias("k"), values.alias("v")), lambda p: (F.array_position(known, F.concat(p["k"], F.lit(":"), p["v"])) - 1).cast("int"))


def indices(codes: Column) -> Column:
    """Codes as indices into the catalogues."""
    at = numbers([c - L.OFFSET[kind] for c, (kind, _) in enumerate(L.CODES)])
    return F.transform(codes, lambda c: F.get(at, c))


def essential_key(codes: Column, delimiter: str = "") -> Column:
    """The first non-empty space, separator and case function of an assignment, joined bare unless a delimiter is given."""
    zipped = F.arrays_zip(slot_kinds().alias("k"), names(codes).alias("v"))

    def first(kind: str) -> Column:
        return F.coalesce(F.get(F.filter(zipped, lambda p: (p["k"] == kind) & (p["v"] != "")), F.lit(0))["v"], F.lit(""))

    return F.concat_ws(delimiter, first(L.SPACE), first(L.SEP), first(L.CASE))


def transferred(reference: Column) -> Column:
    """A reference-task assignment carried to the row's layout; the reference has slots of all types."""
    t = Table("slot", [[(j,) for j in L.transfer(L.RELATIONS[L.REFERENCE], r)] for r in L.RELATIONS.values()])
    return F.transform(t.rows(), lambda i: F.get(reference, t.slot(i)))


# -------------------------------------------------------------------- sampling

def sampled(named: DataFrame, quota: int, seed: str, modes: tuple[str, ...] = ("random",), first_block: int = 2, required: bool = True) -> DataFrame:
    """(name, template, draw, codes, ord): for every row (name, template) the first ``quota`` valid assignments.

    If a layout has no more assignments than the quota, all of them are tried in
    their natural order and the valid ones returned.  Otherwise draws without
    repetition go on, in blocks that double, until the quota is met; if the space
    ends before, ``required`` raises.  With several ``modes``, a column ``mode`` says
    whose catalogue a row draws from.  State is a table per block in the shared
    folder; the names still short reach the driver, which checks whether to go on.
    """
    spark, schema = named.sparkSession, "name string, template string, draw bigint, codes array<int>"
    place = F.lit(0) if len(modes) == 1 else F.array_position(F.array(*[F.lit(m) for m in modes]), F.col("mode")) - 1
    number = (layout_number(F.col("template")) + place * len(NAMES)).cast("int")
    layouts = named.select("name", "template", number.alias("number")).withColumn("n", assignments(modes))
    path = shared_path(spark, f"sampled-{uuid.uuid4().hex}")
    open_, low, high, block = layouts, 0, max(first_block * quota, 64), 0
    while True:
        tries = F.when(F.col("n") <= quota, F.col("n")).otherwise(F.least(F.lit(high), F.col("n")))
        rows = open_.where(F.col("n") > low).select("name", "template", "number", "n", F.explode(F.sequence(F.lit(low).cast("bigint"), tries - 1)).alias("draw")).repartition(spread(spark), "name", "draw")
        few = rows.where(F.col("n") <= quota).withColumn("codes", unranked(F.col("draw"), modes))
        many = drawn(rows.where(F.col("n") > quota), seed, "draw", "name", modes)
        good = evaluated(few.unionByName(many).withColumn("number", (F.col("number") % len(NAMES)).cast("int")), True).select("name", "template", "draw", "codes")
        first = good.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("draw"))).where(F.col("_n") <= quota).drop("_n")
        first.write.parquet(f"{path}/block_{block}")
        done = spark.read.schema(schema).parquet(*[f"{path}/block_{b}" for b in range(block + 1)])
        have = done.groupBy("name").agg(F.count("*").alias("have"))
        state = layouts.where(F.col("n") > quota).join(have, "name", "left").where(F.coalesce("have", F.lit(0)) < quota)
        short = state.select("name", "template", "number", "n").collect()   # names without enough formats yet
        ended = sorted(r["name"] for r in short if r["n"] <= high)
        if ended and required:
            raise ValueError(f"fewer than {quota} valid formats exist for {ended[:5]}")
        more = [tuple(r) for r in short if r["n"] > high]
        if not more:
            break
        open_, low, high, block = spark.createDataFrame(more, "name string, template string, number int, n bigint"), high, 2 * high, block + 1
    rank = F.row_number().over(Window.partitionBy("name").orderBy("draw"))
    return done.withColumn("ord", rank).where(F.col("ord") <= quota)


# ------------------------------------------------------------------------- SQL

def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (int, float)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_q, v)) + "]"
    return "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


def _values(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_q, r)) + ")" for r in rows) + ")"


@lru_cache(None)
def relations_sql(modes: tuple[str, ...] = ("random",), only: tuple[str, ...] = ()) -> str:
    """CTEs of the relations: lay, slots, cells, implies, filled, blank, parts, choices, vals."""
    own = [(n, L.RELATIONS[n]) for n in only or NAMES]
    lists = _text_lists()
    return ",\n".join([
        _values("lay", "template, mode, n, half, shortest, longest, n_slots", [(n, m, *sizes(n, m)[:2], *(r.layout.lengths or (0, 0)), len(r.slots)) for m in modes for n, r in own]),
        _values("slots", "template, mode, slot, kind, size, stride, codes, cell, rule, sep, gap, space",
                [(n, m, i, s[0], *z, mode_codes(m)[s[0]], *s[1:]) for m in modes for n, r in own for i, (s, z) in enumerate(zip(r.slots, zip(*sizes(n, m)[2:])))]),
        _values("cells", "template, cell, code", [(n, i, c[1]) for n, r in own for i, c in enumerate(r.cells)]),
        _values("implies", "template, a, b", [(n, *p) for n, r in own for p in r.implies] or [("", 0, 0)]),
        _values("filled", "template, cell", [(n, c) for n, r in own for c in r.filled] or [("", 0)]),
        _values("blank", "template, cell", [(n, c) for n, r in own for c in r.blank] or [("", 0)]),
        _values("parts", "template, pos, cell, list, item, flag", [(n, i, p[0], lists[(p[1], tuple(p[2]))], *p[3:]) for n, r in own for i, p in enumerate(r.parts)]),
        _values("choices", "list, code, text", [(k, base + i, t) for (base, texts), k in lists.items() for i, t in enumerate(texts)]),
        _values("vals", "code, kind, value, idx, first, nl, em, bl", [
            (i, t, v, i - L.OFFSET[t], FIRST_OF_NAME[i], t in L.TEXTS and "\n" in v, t in L.TEXTS and v == "", t in L.TEXTS and v.isspace()) for i, (t, v) in enumerate(L.CODES)]),
    ])


def draws_sql(ids: str, seed: str, key: str = "f.template", extra: str = "") -> str:
    """CTE ``f`` (from ``ids``: template, mode, format_id, extra columns) -> CTEs up to ``fs``: one row per format and slot with its code."""
    def part(r: int, letter: str) -> str:
        return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {key}, '{r}{letter}')), 1, 6) AS BIGINT) + 1)"

    steps = ["f0 AS (SELECT f.*, l.n, l.half, f.format_id // l.half AS l, f.format_id % l.half AS r FROM f JOIN lay l USING (template, mode) WHERE f.format_id >= 0 AND f.format_id < l.n)"]
    for r in range(ROUNDS):
        x = "r" if r % 2 == 0 else "l"
        u = f"(({x} * {part(r, 'a')} + {part(r, 'c')}) % {PRIME})"
        mixed = f"((u * ((u >> 7) + {part(r, 'd')})) % {PRIME})"
        new = f"(l + {mixed}) % (n // half) AS l, r" if r % 2 == 0 else f"l, (r + {mixed}) % half AS r"
        steps.append(f"f{r + 1} AS (SELECT f.* EXCLUDE (l, r, u), {new} FROM (SELECT f.*, {u} AS u FROM f{r} f) f)")
    steps.append(f"fi AS (SELECT f.* EXCLUDE (l, r, n, half), l * half + r AS number FROM f{ROUNDS} f)")
    steps.append("fs AS (SELECT f.* EXCLUDE (number), s.slot, s.kind, s.cell, s.rule, s.space, s.codes[(f.number // s.stride) % s.size + 1] AS code FROM fi f JOIN slots s USING (template, mode))")
    return f"f AS ({ids}),\n" + ",\n".join(steps)


def cells_sql(fs: str = "fs", key: str = "template, format_id", p: str = "") -> str:
    """CTEs fa (writes and whether each is accepted), fc (effective cells) and fv (validity) of the formats in ``fs``.

    Defaults hold no newline, so of an enumeration only a separator can be rejected,
    namely by the space the same format writes.
    """
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in key.split(","))
    xk = ", ".join(f"x.{k.strip()}" for k in key.split(","))
    return f"""{p}fa AS (SELECT x.*, CASE x.rule WHEN 1 THEN v.bl WHEN 2 THEN NOT v.em WHEN 3 THEN x.kind <> 'chosen_separator' OR NOT v.nl OR w.nl ELSE TRUE END AS ok
  FROM {fs} x JOIN vals v ON v.code = x.code LEFT JOIN {fs} y ON {on} AND x.rule = 3 AND y.kind = 'chosen_space' AND y.cell = x.space LEFT JOIN vals w ON w.code = y.code),
{p}fc AS (SELECT {xk}, c.cell, coalesce(arg_max(y.code, y.slot) FILTER (y.ok), any_value(c.code)) AS code
  FROM (SELECT DISTINCT {key} FROM {fs}) x JOIN cells c ON c.template = x.template LEFT JOIN {p}fa y ON {on} AND y.cell = c.cell GROUP BY {xk}, c.cell),
{p}fx AS (SELECT x.*, v.nl, v.em, v.bl FROM {p}fc x JOIN vals v ON v.code = x.code),
{p}bad AS (
  SELECT {xk} FROM {p}fx x JOIN implies i ON i.template = x.template AND i.a = x.cell JOIN {p}fx y ON {on} AND y.cell = i.b WHERE x.nl AND NOT y.nl
  UNION SELECT {xk} FROM {p}fx x JOIN filled i ON i.template = x.template AND i.cell = x.cell WHERE x.em
  UNION SELECT {xk} FROM {p}fx x JOIN blank i ON i.template = x.template AND i.cell = x.cell WHERE NOT x.bl),
{p}fv AS (SELECT {xk}, NOT EXISTS (SELECT 1 FROM {p}bad y WHERE {on}) AS valid FROM (SELECT DISTINCT {key} FROM {fs}) x)"""


def text_sql(key: str = "template, format_id", where: str = "TRUE", p: str = "", out: str = "ft") -> str:
    """CTE with the text of every format with cells in fc."""
    xk = ", ".join(f"x.{k.strip()}" for k in key.split(","))
    on = " AND ".join(f"c.{k.strip()} = x.{k.strip()}" for k in key.split(","))
    return f"""{out} AS (SELECT {xk}, CASE WHEN bool_and(h.text IS NOT NULL) THEN string_agg(h.text, '' ORDER BY p.pos) END AS format_text
  FROM (SELECT DISTINCT {key} FROM {p}fc) x JOIN parts p ON p.template = x.template LEFT JOIN {p}fc c ON {on} AND c.cell = p.cell
  LEFT JOIN choices h ON h.list = p.list AND h.code = coalesce(c.code, 0) WHERE {where} GROUP BY {xk})"""
