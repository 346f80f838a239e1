"""Operator 5, secret scans with multipart credential linking (DataFrame functions only).

Base kinds are reported wherever they match.  Weak candidates - an account name,
a short or unlabelled secret, an endpoint - say little alone; they are reported
only where complementary parts lie within ``reach`` code points in the same
document: an identifier needs a secret, a secret an identifier or an endpoint, an
endpoint both an identifier and a secret.  Base spans count as parts too.  With
``paragraphs`` parts of one paragraph (text between blank lines) belong together
at any distance, so that a key block or a long value between them parts nothing.

Positions come from cutting a text at its matches: a match starts after all
pieces and matches before it, a running sum over the (few) matches.  The interval
join deals parts and candidates into cells of ``reach`` code points; per
(document, cell, part) the outermost positions are kept, which is all that the
question "is there one within reach" needs, so no pairs are formed and a document
full of parts spreads over its cells.  Paragraphs are numbered by the
blank lines in the pieces; one row per (document, paragraph) tells its parts.

Defined results: null texts count as empty; every input row gives one row, rows
equal in id and text alike ones; ties of the start are ordered by kind.  Texts
are scanned whole.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.llm.common import stored

IDENTIFIER, SECRET, ENDPOINT = "identifier", "secret", "endpoint"


@dataclass(frozen=True)
class Kind:
    name: str
    part: str
    pattern: str
    keep: Callable[[Column, Column], Column] = lambda m, v: F.lit(True)  # of the match and its value
    group: int = 0  # group that holds the value
    weak: bool = False


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
_SECRET_WORD = r"((?i:password|passwd|secret|token|api_?key))"
PARAGRAPH_BREAK = r"\n[\x20\t\r]*\n"
KINDS = (
    Kind("assign", SECRET, _SECRET_WORD + _ASSIGNED + r"([A-Za-z0-9+/_.=-]+)", lambda m, v: F.length(v) >= 12, 2),
    Kind("access", IDENTIFIER, r"AKIA[A-Z0-9]+", lambda m, v: F.length(m) >= 18),
    Kind("hex", SECRET, r"[0-9a-f]{16,}"),
    Kind("account", IDENTIFIER, r"((?i:client_?id|user_?name|user|login|account))" + _ASSIGNED + r"([A-Za-z0-9@._-]+)", lambda m, v: F.length(v) >= 3, 2, True),
    Kind("pass", SECRET, r"((?i:pwd|passphrase|private_?key|credential))" + _ASSIGNED + r"([A-Za-z0-9+/_.=!$%&*@-]+)", lambda m, v: F.length(v) >= 4, 2, True),
    Kind("key40", SECRET, r"[A-Za-z0-9+/]{40,}",
         lambda m, v: (F.length(m) == 40) & m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]"), weak=True),
    Kind("url", ENDPOINT, r"[a-z]{2,10}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+", weak=True),
    Kind("address", ENDPOINT, r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?", weak=True),
    # what ``assign`` leaves out: values that are short, or that another character cuts short
    Kind("short", SECRET, _SECRET_WORD + _ASSIGNED + r"(?![A-Za-z0-9+/_.=-]{12})([A-Za-z0-9+/_.=!$%&*@-]+)", group=2, weak=True),
)


def _found(text: Column, number: int, kind: Kind, paragraphs: bool) -> Column:
    """Matches of one kind: array of (kind, nth, gap before, paragraph breaks in it, chars, match)."""
    pattern = F.lit(kind.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    # no match has white space at its ends, so a blank line is whole in one piece
    breaks = lambda g: F.regexp_count(g, F.lit(PARAGRAPH_BREAK)) if paragraphs else F.lit(0)
    pieces = F.transform(gaps, lambda g: F.struct(F.length(g).cast("long").alias("gap"), breaks(g).alias("breaks")))
    entry = F.transform(F.arrays_zip(matches.alias("m"), pieces.alias("g")), lambda z, i: F.struct(
        F.lit(number).alias("kind"), i.alias("nth"), z["g"]["gap"].alias("gap"), z["g"]["breaks"].alias("breaks"), F.length(z["m"]).cast("long").alias("chars"), z["m"].alias("m")))
    # the piece after the last match has no match of its own
    entry = F.filter(entry, lambda e: e["m"].isNotNull())
    return F.when(F.regexp_like(text, pattern), entry)


def _keep(kinds: tuple[Kind, ...]) -> Column:
    out = F.lit(False)
    for number, kind in enumerate(kinds):
        out = F.when(F.col("kind") == number, kind.keep(F.col("m"), F.regexp_extract("m", kind.pattern, kind.group))).otherwise(out)
    return out


def spans(df: DataFrame, id_: str = "doc_id", text: str = "text", kinds: tuple[Kind, ...] = KINDS, reach: int = 200,
          paragraphs: bool = False) -> DataFrame:
    """(id, h, copies, spans): one row per distinct (id, text); spans are (kind, start, end), ordered, the linked ones included."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    nothing = F.expr("array()").cast("array<struct<kind:int,nth:int,gap:bigint,breaks:int,chars:bigint,m:string>>")
    every = F.concat(F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("nth"), F.lit(0).cast("long").alias("gap"), F.lit(0).alias("breaks"), F.lit(0).cast("long").alias("chars"), F.lit("").alias("m"))),
                     *[F.coalesce(_found(body, n, k, paragraphs), nothing) for n, k in enumerate(kinds)])
    exploded = df.select(F.col(f"`{id_}`").alias("id"), F.xxhash64(body).alias("h"), F.explode(every).alias("e")).select("id", "h", "e.*")
    # the few matches are kept, so the texts are scanned once
    single = stored(exploded.groupBy("id", "h", "kind", "nth").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("gap", "breaks", "chars", "m")]), "matches")
    order = Window.partitionBy("id", "h", "kind").orderBy("nth")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(F.col("gap") + F.col("chars")).over(running)
    placed = single.withColumn("paragraph", F.sum("breaks").over(running)).withColumn("end", before).withColumn("start", F.col("end") - F.col("chars")).where((F.col("kind") == -1) | _keep(kinds))

    part_of = F.element_at(F.create_map(*[F.lit(x) for n, k in enumerate(kinds) for x in (n, k.part)]), F.col("kind"))
    weak = F.col("kind").isin([n for n, k in enumerate(kinds) if k.weak])
    parts = placed.where("kind >= 0").select("id", "h", "kind", "start", "end", "paragraph", part_of.alias("part"))
    cell = lambda c: F.floor(c / reach)
    covered = parts.select("id", "h", "part", "start", "end", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
    roles = (IDENTIFIER, SECRET, ENDPOINT)
    lo, hi = F.greatest("start", F.col("cell") * reach), F.least("end", (F.col("cell") + 1) * reach)
    outermost = covered.groupBy("id", "h", "cell").agg(*[f(F.when(F.col("part") == r, x)).alias(f"{r}_{n}") for r in roles for f, x, n in ((F.min, lo, "lo"), (F.max, hi, "hi"))])
    candidates = parts.where(weak)
    asking = candidates.select("*", F.explode(F.sequence(cell(F.col("start") - reach), cell(F.col("end") + reach))).alias("cell"))
    o = outermost.select(F.col("id").alias("o_id"), F.col("h").alias("o_h"), F.col("cell").alias("o_cell"), *[f"{r}_{n}" for r in roles for n in ("lo", "hi")])
    met = asking.join(o, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("h") == F.col("o_h")) & (F.col("cell") == F.col("o_cell")))
    near = [F.max((F.col(f"{r}_hi") >= F.col("start") - reach) & (F.col(f"{r}_lo") <= F.col("end") + reach)).alias(r) for r in roles]
    answers = met.groupBy("id", "h", "kind", "start", "end", "paragraph", "part").agg(*near)
    has = {r: F.coalesce(F.col(r), F.lit(False)) for r in roles}
    if paragraphs:
        inside = parts.groupBy(F.col("id").alias("p_id"), F.col("h").alias("p_h"), F.col("paragraph").alias("p_paragraph")).agg(
            *[F.max(F.col("part") == r).alias(f"p_{r}") for r in roles])
        answers = answers.join(inside, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")) & (F.col("paragraph") == F.col("p_paragraph")))
        has = {r: has[r] | F.col(f"p_{r}") for r in roles}
    complete = (F.when(F.col("part") == IDENTIFIER, has[SECRET]).when(F.col("part") == SECRET, has[IDENTIFIER] | has[ENDPOINT])
                .otherwise(has[IDENTIFIER] & has[SECRET]))
    linked = answers.where(complete).select("id", "h", "kind", "start", "end", F.lit(0).cast("long").alias("copies"))
    reported = placed.where(~weak).select("id", "h", "kind", "start", "end", F.when(F.col("kind") == -1, F.col("copies")).otherwise(0).alias("copies")).unionByName(linked)
    gathered = reported.groupBy("id", "h").agg(
        F.sum("copies").alias("copies"),
        F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end")))).alias("s"))
    names = F.create_map(*[F.lit(x) for n, k in enumerate(kinds) for x in (n, k.name)])
    return gathered.select("id", "h", "copies", F.transform("s", lambda s: F.struct(F.element_at(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
