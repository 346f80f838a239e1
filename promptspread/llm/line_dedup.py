"""Operator 10, line dedup by a segment-partition edit join (DataFrame functions only).

Lines within ``edits`` insertions, deletions or substitutions of each other are
linked, and connected lines are one class.  A line has ``edits + 1`` windows; two
lines within reach share one of them unchanged, at its place or at one of few
next to it.  Windows follow from ranges of lengths, so that lines of nearby
lengths meet by one hash a window.  What is exchanged for all lines are numbers
only: hashes and, in one number, twelve letter counts modulo 16 (an edit
moves them by at most two together) and the length, two lower bounds that a hit must
pass before it becomes a pair.  Texts are read again for the lines in pairs.
A window that many lines have in common says little about a pair, as among
copies with many edits each.  It is divided: the same rule holds for what is left of it
and for what is right, with the edits left to either, so that the lines meet by a window
there as well, round after round, until few lines share all that was asked for.
Pairs are verified by a banded bit-parallel edit distance: a column of ``2 * edits + 1``
cells is a few bits, updated with integer operations per character.

Lines are identified by a 64-bit hash; n distinct lines share one by accident
with a probability of about n ** 2 / 2 ** 65.

A line is dropped if it equals an earlier one, or if it is within ``edits`` of a
different line that is kept.  Which of near lines are kept follows from an order by
their digests: a line without a link to a kept one before it is kept.  So no line
goes for a chain of others.  Each round settles the lines without an open neighbour
before them; as the order is random, n lines take about log n rounds however they
are linked.  Of equal lines the one in the first place stays, in order of (doc_id
with null last, text hash, line number).

Defined results: null texts have no lines; lines shorter than ``least`` code
points (blank ones too) are never linked nor dropped, whatever repeats; equal
lines are one class.  Rows equal in id and text are one document that occurs
several times.  Texts of any length are read whole.  Extra columns stay, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptspread.llm.common import fresh_path, stored, unused
from promptspread.llm.components import components

EDITS = 2
LEAST = 20
LETTERS = "etaonisrhdlu"  # counted by ``traits``: four bits each
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}]"
LENGTH_AT, LENGTHS = 48, 1 << 12   # the length modulo 4096 stands behind them,
SHIFTED_AT = 60                    # and whether a window is looked for away from its place
SHIFTED = 1 << SHIFTED_AT
HOT = 64    # a window of more lines than this is divided further,
PIECE = 8   # as long as a stretch of so many code points is left beside it


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(low: Column, edits: int) -> list[tuple[int, bool, list[int], Column, Column]]:
    """(number, whether placed from the end, shifts, offset, length) of the ``edits + 1`` windows of lines of ``low`` code points or more.

    Windows share no place in any such line.  If ``edits`` edits separate two lines, then for some i there are exactly i edits before the
    i-th window of one line and at most ``edits - i`` behind it, and the other line has it unchanged, moved by as many places at most (the
    first window never moves from the start, the last never from the end).  With up to two edits a window in the middle has exactly
    the first edit before it, so that of the two lines' windows one is moved forward or not at all; with more, both ways are tried.
    """
    parts, out = edits + 1, []
    for i in range(parts):
        start, stop = (F.floor(low * j / parts).cast("int") for j in (i, i + 1))
        far = min(i, edits - i)
        out.append((i, 2 * i > edits, list(range(0 if edits <= 2 else -far, far + 1)), start, stop - start))
    return out


def traits(line: Column) -> Column:
    """Letter counts modulo 16, four bits each, in one number."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter)))  # a letter is one byte
        out = out.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)).cast("long"), 4 * k))
    return out


def may_match(x: Column, y: Column, edits: int) -> Column:
    """False only if more than ``edits`` edits separate the lines with these traits."""
    moved = F.lit(0)
    for k in range(len(LETTERS)):
        d = (F.shiftright(x, 4 * k) - F.shiftright(y, 4 * k)).bitwiseAND(F.lit(15))
        moved = moved + F.least(d, 16 - d)
    return moved <= 2 * edits


def pair_bits(line: Column) -> Column:
    """A number whose bit b tells whether an odd count of neighbouring characters hash to b; an edit flips four bits at most."""
    def bits(chars: Column) -> Column:
        hashed = F.transform(chars, lambda c, i: F.pmod(F.xxhash64(F.get(chars, i - 1), c), F.lit(64)).cast("int"))
        return F.aggregate(hashed, F.lit(0).cast("long"), lambda n, b: n.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))

    return F.transform(F.array(F.regexp_extract_all(line, F.lit("(?s)."), F.lit(0))), bits)[0]


def _common_prefix(x: Column, y: Column) -> Column:
    """Length of the common prefix, by doubling steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(20))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(
        (n + s <= F.least(F.length(x), F.length(y))) & (F.substring(x, n + 1, s) == F.substring(y, n + 1, s)), n + s).otherwise(n))


def banded_distance(x: Column, y: Column, edits: int) -> Column:
    """Edit distance of two strings if at most ``edits``, else some larger number.

    Bit b of column j stands for row j - edits + b.  Vertical differences up and
    down are two bit sets; a column takes the usual bit-parallel step, and the band
    moves one row down with it.  The distance is followed along the band's lowest
    row until that is the last row of ``x``, then along that row.
    """
    mask = (1 << (2 * edits + 1)) - 1
    xs, ys = F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), F.regexp_extract_all(y, F.lit("(?s)."), F.lit(0))
    table = F.struct(xs.alias("x"), ys.alias("y"), F.size(xs).alias("m"), F.size(ys).alias("n"))

    def whole(t: Column) -> Column:
        m, n = t["m"], t["n"]
        flip = lambda c: c.bitwiseXOR(F.lit(mask))

        def column(acc: Column, j: Column) -> Column:
            c = F.element_at(t["y"], j)
            match = F.lit(0)
            for b in range(2 * edits + 1):
                i = j - edits + b
                match = match + F.when((i >= 1) & (i <= m), F.when(F.get(t["x"], i - 1) == c, 1 << b).otherwise(0)).otherwise(0)
            step = F.struct(match.alias("e"), acc["up"].alias("up"), acc["down"].alias("down"), acc["d"].alias("d"))
            return F.transform(F.array(step), lambda s: _move(s, j, m))[0]

        def _move(s: Column, j: Column, m: Column) -> Column:
            zero = ((s["e"].bitwiseAND(s["up"]) + s["up"]).bitwiseXOR(s["up"])).bitwiseOR(s["e"]).bitwiseOR(s["down"]).bitwiseAND(F.lit(mask))
            return F.transform(F.array(F.struct(zero.alias("z"), s["up"].alias("up"), s["down"].alias("down"), s["d"].alias("d"))), lambda q: _close(q, j, m))[0]

        def _close(q: Column, j: Column, m: Column) -> Column:
            right = q["down"].bitwiseOR(flip(q["z"].bitwiseOR(q["up"])))
            left = q["z"].bitwiseAND(q["up"])
            below = F.shiftright(q["z"], 1)
            row = F.greatest(F.least(m - j + edits, F.lit(2 * edits)), F.lit(0))  # the band's lowest row, or the last of x
            at = lambda v: F.call_function("shiftright", v, row).bitwiseAND(F.lit(1))
            d = q["d"] + F.when(j <= m - edits, 1 - at(q["z"])).otherwise(at(right) - at(left))
            return F.struct(left.bitwiseOR(flip(below.bitwiseOR(right))).bitwiseAND(F.lit(mask)).alias("up"),
                            below.bitwiseAND(right).bitwiseAND(F.lit(mask)).alias("down"), d.cast("int").alias("d"))

        start = F.struct(F.lit(mask ^ ((1 << edits) - 1)).alias("up"), F.lit(0).alias("down"), F.lit(edits).alias("d"))
        end = F.aggregate(F.sequence(F.lit(1), n), start, column)["d"]
        # strings no longer than the band: the distance can't be above the longer one
        return F.when(F.abs(m - n) > edits, F.lit(edits + 1)).when(F.least(m, n) <= edits, F.least(F.greatest(m, n), F.levenshtein(x, y))).otherwise(end)

    return F.transform(F.array(table), whole)[0]


def within(x: Column, y: Column, edits: int) -> Column:
    """Whether at most ``edits`` edits separate two strings; common ends are cut off first."""
    p = _common_prefix(x, y)
    rest = F.struct(F.reverse(F.substring(x, p + 1, F.length(x))).alias("x"), F.reverse(F.substring(y, p + 1, F.length(y))).alias("y"))

    def middle(r: Column) -> Column:
        q = _common_prefix(r["x"], r["y"])
        return banded_distance(F.substring(r["x"], q + 1, F.length(r["x"])), F.substring(r["y"], q + 1, F.length(r["y"])), edits) <= edits

    return F.transform(F.array(rest), middle)[0]


def _bottoms(edits: int, least: int) -> tuple[Column, Column]:
    """The lowest length of a line's range of lengths, and of the range its shorter neighbours may begin in."""
    width, size = 4 * max(edits, 2), F.length("line")
    low = lambda n: F.greatest(n - F.pmod(n - least, F.lit(width)), F.lit(0))
    return low(size), low(size - edits)


def _numbers(line: Column) -> Column:
    """Traits and length modulo ``LENGTHS`` of a line."""
    return traits(line).bitwiseOR(F.shiftleft(F.length(line).bitwiseAND(F.lit(LENGTHS - 1)).cast("long"), LENGTH_AT))


def signatures(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(a, s, t): the hashed windows of every different line of (a, line), and its traits, length and whether the window is shifted in one number.

    Windows follow from the lowest length of a range of lengths; a line whose
    possible shorter neighbours begin in the range below has that range's windows too.
    """
    size, (own, below) = F.length("line"), _bottoms(edits, least)
    facts = {"t": _numbers(F.col("line"))}
    moved = {}
    for name, bottom, there in (("own", own, None), ("below", below, own != below)):
        for i, back, shifts, offset, length in windows(bottom, edits):
            start = (size - bottom if back else F.lit(0)) + offset + 1
            for shift in shifts:
                key = F.xxhash64(bottom, F.lit(i), F.substring(F.col("line"), start + shift, length))
                column = f"{name}_{i}_{shift + edits}"
                facts[column], moved[column] = (key if there is None else F.when(there, key)), shift != 0
    # only numbers are exchanged, equal lines meet in a hash aggregate
    each = lines.select("a", *[c.alias(name) for name, c in facts.items()]).groupBy("a").agg(*[F.min(name).alias(name) for name in facts])
    marks = [F.struct(F.col(c).alias("s"), F.col("t").bitwiseOR(F.lit(SHIFTED if m else 0)).alias("t")) for c, m in moved.items()]
    return each.select("a", F.explode(F.array(*marks)).alias("e")).select("a", "e.s", "e.t").where("s IS NOT NULL")


def _stretches(key: Column, at: Column, size: Column, low: Column, edits: int) -> Column:
    """(s, open) of every window of a line's stretch of ``size`` code points from ``at``: its hash, and the stretches beside it.

    A stretch (low, at, size, edits) has at least ``low`` code points in all lines that have the window, and as many edits at most.
    """
    out = []
    for i, back, shifts, offset, length in windows(low, edits):
        for shift in shifts:
            start = at + offset + shift + (size - low if back else F.lit(0))
            before = (offset + shifts[0], at, start - at, F.lit(i))
            behind = (low - offset - length - shifts[-1], start + length, at + size - start - length, F.lit(edits - i))
            sides = [F.struct(*[F.greatest(v, F.lit(0)).cast("int").alias(n) for n, v in zip(("low", "at", "size", "edits"), side, strict=True)])
                     for side, n in ((before, i), (behind, edits - i)) if n]
            out.append(F.struct(F.xxhash64(key, F.lit(i), F.substring(F.col("line"), start + 1, length)).alias("s"), F.array(*sides).alias("open")))
    return F.array(*out)


def divided(lines: DataFrame, marks: DataFrame, hot: DataFrame, edits: int, least: int) -> DataFrame:
    """(a, s, t, g) in place of the ``marks`` whose window is ``hot``: the window and windows beside it, until few lines share them.

    Every round divides the longest stretch that a window leaves open.  Lines within ``edits`` edits share one of the
    windows there in every round, so that none of their links is lost.
    """
    spark = lines.sparkSession
    named = stored(marks.join(hot, "s", "left_semi").select("a").distinct(), "hot_names")
    texts = lines.join(named, "a", "left_semi").groupBy("a").agg(F.first("line").alias("line"))
    texts = stored(texts.withColumn("g", pair_bits(F.col("line"))), "hot_lines")
    size, (own, below) = F.length("line"), _bottoms(edits, least)
    whole = lambda bottom: _stretches(bottom, F.lit(0), size, bottom, edits)
    windowed = texts.select("a", _numbers(F.col("line")).alias("t"), F.explode(F.when(own == below, whole(own)).otherwise(F.concat(whole(own), whole(below)))).alias("e"))
    state = stored(windowed.select("a", "e.s", "t", "e.open").join(hot, "s", "left_semi"), "hot_0")
    folder, round_, longest = fresh_path(spark, "divided"), 0, F.array_max(F.transform("open", lambda o, i: F.struct(o["low"], -i)))
    while True:
        big = stored(state.where(longest["low"] >= PIECE).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("s"), f"hot_windows_{round_}")
        state.join(big, "s", "left_anti").select("a", "s", "t").write.parquet(f"{folder}/round={round_}")  # one growing folder
        if big.isEmpty():
            return spark.read.schema("a long, s long, t long").parquet(folder).join(texts.select("a", "g"), "a").select("a", "s", "t", "g")
        picked = state.join(big, "s", "left_semi").withColumn("p", -longest["col2"])
        picked = picked.select("a", "s", "t", F.get("open", F.col("p")).alias("o"), F.filter("open", lambda o, i: i != F.col("p")).alias("rest"))
        each = F.lit(None)
        for n in range(1, edits + 1):
            each = F.when(F.col("o.edits") == n, _stretches(F.col("s"), F.col("o.at"), F.col("o.size"), F.col("o.low"), n)).otherwise(each)
        parts = picked.join(texts, "a").select("a", "t", "rest", F.explode(each).alias("e"))
        round_ += 1
        state = stored(parts.select("a", "e.s", "t", F.concat("rest", "e.open").alias("open")).distinct(), f"hot_{round_}")


def line_links(lines: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(a, b, ahead): hashes of different lines within ``edits`` edits, from rows (a, line), a < b, and whether a's digest is the smaller one."""
    marks = stored(signatures(lines, edits, least), "line_marks")
    hot = stored(marks.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("s"), "hot_windows")
    marks, all_ = marks.withColumn("g", F.lit(0).cast("long")), marks
    if not hot.isEmpty():
        marks = marks.join(hot, "s", "left_anti").select("a", "s", "t", "g").unionByName(divided(lines, all_, hot, edits, least))
    one = marks.select("s", F.col("a").alias("x"), F.col("t").alias("tx"), F.col("g").alias("gx"))
    other = marks.select("s", F.col("a").alias("y"), F.col("t").alias("ty"), F.col("g").alias("gy"))
    # windows at their place meet once, a shifted one meets those at their place; conditions on both sides, so that one exchange serves both
    shifted = lambda t: F.shiftright(t, SHIFTED_AT)
    once = (shifted(F.col("tx")) + shifted(F.col("ty")) == F.lit(0)) & (F.col("x") < F.col("y")) | (shifted(F.col("tx")) < shifted(F.col("ty"))) & (F.col("x") != F.col("y"))
    apart = (F.shiftright("tx", LENGTH_AT) - F.shiftright("ty", LENGTH_AT) + edits).bitwiseAND(F.lit(LENGTHS - 1))
    flipped = F.bit_count(F.col("gx").bitwiseXOR(F.col("gy")))
    hits = one.join(other, "s").where(once & (apart <= 2 * edits) & may_match(F.col("tx"), F.col("ty"), edits) & (flipped <= 4 * edits))
    pairs = stored(hits.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "line_pairs")
    # texts of the lines in pairs only; as a table their size is known, so that few are broadcast and no other text is exchanged
    named = stored(pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct(), "line_names")
    texts = lines.join(named, "a", "left_semi").groupBy("a").agg(F.first("line").alias("line"))
    left, right = texts.select("a", F.col("line").alias("p")), texts.select(F.col("a").alias("b"), F.col("line").alias("q"))
    return pairs.join(left, "a").join(right, "b").where(within(F.col("p"), F.col("q"), edits)).select("a", "b", (F.md5("p") < F.md5("q")).alias("ahead"))


def place() -> Column:
    """Where a line stands, in the lines' order."""
    return F.struct(F.col("id").isNull().alias("none"), "id", "h", "no")


def _lines_and_edges(df: DataFrame, id_: str, text: str, edits: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Every line (id, h, no, a) of the documents, ``a`` null if too short to count, one row without ``no`` for a null text; and the links between lines."""
    body = F.col(f"`{text}`")
    docs = df.select(F.col(f"`{id_}`").alias("id"), F.xxhash64(body).alias("h"), body.alias("t"))
    hashed = F.transform(split_lines(F.col("t")), lambda x: F.when(F.length(x) >= least, F.xxhash64(x)))
    occurrences = stored(docs.select("id", "h", F.posexplode_outer(hashed).alias("no", "a")), "line_places")
    lines = docs.select(F.explode(split_lines(F.col("t"))).alias("line")).where(F.length("line") >= least).select(F.xxhash64("line").alias("a"), "line")
    return occurrences, stored(line_links(lines, edits, least), "line_edges")


def classes(df: DataFrame, id_: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lines, edges): every line (id, h, no, a, class, n, kept) of the documents, and the links between lines.

    ``class`` is the first place of a line's class (struct none, id, h, no) and ``n``
    the lines in it, null for lines too short to count; ``kept`` tells whether the
    line stays (in every copy of a row that occurs several times).
    """
    occurrences, edges = _lines_and_edges(df, id_, text, edits, least)
    counted = occurrences.where("a IS NOT NULL")
    # per distinct line, then per class of linked ones; only those that are not alone then go to the places
    own = stored(counted.groupBy("a").agg(F.min(place()).alias("start"), F.count("*").alias("n")), "line_starts")
    linked = own.join(components(edges).select(F.col("node").alias("a"), "component"), "a")
    whole = linked.groupBy("component").agg(F.min("start").alias("class"), F.sum("n").alias("total"))
    member = stored(linked.select("a", "component").join(whole, "component").select("a", "class", "total"), "line_members")
    near = near_kept(edges).select("a", F.lit(True).alias("near"))
    facts = own.join(member, "a", "left").join(near, "a", "left").select("a", "start", F.coalesce("class", "start").alias("class"), F.coalesce("total", "n").alias("n"), "near").where("n > 1")
    placed = occurrences.join(facts, "a", "left")
    counts = F.col("a").isNotNull()
    kept = F.col("near").isNull() & F.coalesce(F.col("start") == place(), F.lit(True))
    return placed.select("id", "h", "no", "a", F.when(counts, F.coalesce("class", place())).alias("class"), F.when(counts, F.coalesce("n", F.lit(1))).alias("n"), kept.alias("kept")), edges


def near_kept(edges: DataFrame) -> DataFrame:
    """(a): lines with a link to a kept line before them; every linked line that is not among them is kept."""
    spark = edges.sparkSession
    open_ = edges.select(F.when(F.col("ahead"), F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("ahead"), F.col("b")).otherwise(F.col("a")).alias("v"))
    folder, round_ = fresh_path(spark, "near_kept"), 0
    open_ = stored(open_, "open_0")
    while round_ == 0 or not open_.isEmpty():
        kept = open_.select("u").distinct().join(open_.select(F.col("v").alias("u")).distinct(), "u", "left_anti")
        path = f"{folder}/round={round_}"   # one growing folder
        open_.join(kept, "u", "left_semi").select(F.col("v").alias("a")).distinct().write.parquet(path)
        dropped = spark.read.schema("a long").parquet(path)
        left = open_.join(dropped.select(F.col("a").alias("u")), "u", "left_anti").join(dropped.select(F.col("a").alias("v")), "v", "left_anti")
        round_ += 1
        open_ = stored(left.select("u", "v"), f"open_{round_}")
    return spark.read.schema("a long").parquet(folder).select("a")


def dedup(df: DataFrame, id_: str = "doc_id", text: str = "text", edits: int = EDITS, least: int = LEAST, keep_short: bool = False) -> DataFrame:
    """``df`` without the lines that equal an earlier one or are near a kept one.

    A document that keeps no line of at least ``least`` code points after losing
    one goes, with ``keep_short`` only one that keeps no line with a visible
    character; documents that lose nothing stay as they are.
    """
    occurrences, edges = _lines_and_edges(df, id_, text, edits, least)
    near = near_kept(edges).select("a", F.lit(True).alias("near"))
    counted = occurrences.where("a IS NOT NULL")
    repeated = counted.groupBy("a").agg(F.min(place()).alias("start"), F.count("*").alias("n")).where("n > 1").drop("n")
    lost = counted.join(near, "a", "left").join(repeated, "a", "left").where(F.col("near") | (F.col("start") != place()))
    i, h, no, new = (unused(df.columns, name) for name in ("g_id", "g_h", "g_no", "g_new"))
    gone = lost.groupBy(F.col("id").alias(i), F.col("h").alias(h)).agg(F.collect_set("no").alias(no))  # at most a document's lines
    joined = df.join(gone, df[id_].eqNullSafe(gone[i]) & (F.xxhash64(df[text]) == gone[h]), "left")
    kept = F.filter(split_lines(F.col(f"`{text}`")), lambda x, at: ~F.array_contains(no, at))
    rest = F.when(F.col(no).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    worth = lambda x: x.rlike(VISIBLE) if keep_short else F.length(x) >= least
    out = joined.withColumn(new, rest).where(F.col(no).isNull() | F.exists(kept, worth))
    return out.select(*[F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
