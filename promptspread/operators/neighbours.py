"""Formats that differ in one slot: pairs (C9) and two-step paths.

A neighbour changes one slot to a value of another name.  Paths need no search
across rows: the neighbours of a format are a list that follows from its layout,
tried in an order that its id shuffles, until a valid one is found; all of them are
tried if need be, so every format that has a path gets one.

Pairs are accepted one after the other, because the slot to change is the number of
pairs accepted before, modulo the slots, and no format may occur twice.  A name's
draws are therefore taken in blocks, evaluated in parallel for every slot, and only
the acceptance itself is a fold over the block in order of the draws; the blocks
double until the quota is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptspread.operators import format_space as S
from promptspread.operators import layouts as L

STEP = 7919   # a prime above the number of any format's neighbours: stepping by it visits all of them


def _with(codes: Column, slot: Column, code: Column) -> Column:
    return F.transform(codes, lambda c, i: F.when(i == slot, code).otherwise(c))


def valid_codes(codes: Column) -> Column:
    """Whether an assignment of the row's layout is valid."""
    return F.transform(F.array(codes), S.gives_valid)[0]   # bound, or every write would compute the assignment again


def _step(codes: Column, start: Column, unlike: tuple[Column, Column] | None = None) -> Column:
    """The first valid neighbour in the order that begins at ``start``: struct(slot, code), null if there is none;
    ``unlike`` is a format that ``codes`` differs from in one slot, and that slot: no step leads back to it."""
    t = S.Table("slot code", [[(i, c) for i, s in enumerate(r.slots) for c in S.mode_codes("random")[s[0]]] for r in L.RELATIONS.values()])
    n = t.size()

    def test(found: Column, j: Column) -> Column:
        at = t.row(((start + j * STEP) % n).cast("int"))
        move = F.struct(t.slot(at).alias("slot"), t.code(at).alias("code"))
        return F.when(found.isNotNull(), found).otherwise(F.transform(F.array(move), lambda m: F.when(fits(m), m))[0])

    def fits(m: Column) -> Column:
        new = S.first_name(m["code"]) != S.first_name(F.get(codes, m["slot"]))
        if unlike is not None:
            new = new & ((m["slot"] != unlike[1]) | (S.first_name(m["code"]) != S.first_name(F.get(unlike[0], m["slot"]))))
        return new & valid_codes(_with(codes, m["slot"], m["code"]))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(None).cast("struct<slot: int, code: int>"), test)


def _start(tag: str, *key: str) -> Column:
    return S._number(F.lit(tag), *[F.col(k).cast("string") for k in key])


def paths(valid: DataFrame) -> DataFrame:
    """Rows of valid formats (template, number, format_id, codes) -> those with a path, and its two changes."""
    found = lambda m: m.isNotNull()
    x = S.held(valid, "_s1", _step(F.col("codes"), _start("first", "template", "format_id")), found)
    x = S.held(x, "v1", _with(F.col("codes"), F.col("_s1.slot"), F.col("_s1.code")))
    x = S.held(x, "_s2", _step(F.col("v1"), _start("second", "template", "format_id"), (F.col("codes"), F.col("_s1.slot"))), found)
    out = x.select("*", F.col("_s1.slot").alias("slot1"), F.col("_s1.code").alias("code1"), F.col("_s2.slot").alias("slot2"), F.col("_s2.code").alias("code2"))
    return out.withColumn("v2", _with(F.col("v1"), F.col("slot2"), F.col("code2"))).drop("_s1", "_s2")


def paths_sql(tries: int = 12) -> str:
    """CTE ``paths`` (template, format_id, slot1, c1, slot2, c2) by the first ``tries`` moves, enough at the size the oracle runs on."""
    def start(tag: str) -> str:
        return f"CAST('0x' || substr(md5(concat_ws('|', '{tag}', x.template, CAST(x.format_id AS VARCHAR))), 1, 6) AS BIGINT)"

    def step(name: str, rows: str, tag: str, unlike: str) -> str:
        return f"""{name}m AS (SELECT x.template, x.format_id, m.slot, m.code, r.j FROM (SELECT DISTINCT template, format_id FROM {rows}) x, (SELECT range AS j FROM range({tries})) r
  JOIN mv m ON m.template = x.template AND m.pos = ({start(tag)} + r.j * {STEP}) % m.n
  JOIN {rows} c ON c.template = x.template AND c.format_id = x.format_id AND c.slot = m.slot JOIN vals a ON a.code = c.code JOIN vals b ON b.code = m.code WHERE a.first <> b.first {unlike}),
{name}c AS (SELECT c.template, c.format_id, m.j, m.slot AS mslot, m.code AS mcode, c.slot, c.kind, c.cell, c.rule, c.space, CASE WHEN c.slot = m.slot THEN m.code ELSE c.code END AS code
  FROM {name}m m JOIN {rows} c ON c.template = m.template AND c.format_id = m.format_id),
{S.cells_sql(f'{name}c', 'template, format_id, j', name)},
{name}b AS (SELECT template, format_id, min(j) AS j FROM {name}fv WHERE valid GROUP BY template, format_id),
{name}v AS (SELECT c.* FROM {name}c c JOIN {name}b USING (template, format_id, j))"""

    back = "AND NOT EXISTS (SELECT 1 FROM av z JOIN v0 o ON o.template = z.template AND o.format_id = z.format_id AND o.slot = z.slot JOIN vals oo ON oo.code = o.code " \
           "WHERE z.template = x.template AND z.format_id = x.format_id AND z.slot = m.slot AND z.mslot = m.slot AND oo.first = b.first)"
    return f"""mv AS (SELECT template, slot, code, row_number() OVER (PARTITION BY template ORDER BY slot, pos) - 1 AS pos, count(*) OVER (PARTITION BY template) AS n
  FROM (SELECT template, slot, unnest(codes) AS code, unnest(range(len(codes))) AS pos FROM slots)),
v0 AS (SELECT fs.* FROM fs JOIN fv USING (template, format_id) WHERE valid),
{step('a', 'v0', 'first', '')},
{step('b', 'av', 'second', back)},
paths AS (SELECT DISTINCT a.template, a.format_id, a.mslot AS slot1, a.mcode AS c1, b.mslot AS slot2, b.mcode AS c2 FROM av a JOIN bv b ON b.template = a.template AND b.format_id = a.format_id)"""


# ------------------------------------------------------------------------ pairs

def pairs(named: DataFrame, seed: str, quota: int, first_block: int = 4) -> DataFrame:
    """(name, template, number, pair, draw, slot_idx, v0, v1) for every row (name, template), ``quota`` pairs each, fewer if the space ends."""
    spark = named.sparkSession
    layouts = named.select("name", "template", S.layout_number(F.col("template")).alias("number")).withColumn("n", S.assignments())
    high, largest = first_block * quota, max(S.sizes(n)[0] for n in S.NAMES)
    while True:
        rows = layouts.select("name", "template", "number", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(high), F.col("n")) - 1)).alias("draw")).repartition(S.spread(spark), "name", "draw")
        x = S.drawn(rows, seed, "draw", "name")
        x = S.held(S.evaluated(x, True), "others", _others())
        x = S.held(x, "fine", F.transform("others", lambda c, i: valid_codes(_with(F.col("codes"), i, c))))
        draws = x.groupBy("name", "template", "number").agg(F.array_sort(F.collect_list(F.struct("draw", "codes", "others", "fine"))).alias("draws"))
        found = draws.select("name", "template", "number", _accepted(quota).alias("pairs")).select("name", "template", "number", F.posexplode("pairs").alias("pair", "p"))
        out = found.select("name", "template", "number", "pair", F.col("p.draw").alias("draw"), F.col("p.slot").alias("slot_idx"), F.col("p.v0").alias("v0"), F.col("p.v1").alias("v1"))
        path = S.shared_path(spark, f"pairs-{S.uuid.uuid4().hex}")
        out.write.parquet(path)
        out = spark.read.schema(out.schema).parquet(path)
        have = out.groupBy("name").agg(F.count("*").alias("have"))
        short = layouts.join(have, "name", "left").where((F.coalesce("have", F.lit(0)) < quota) & (F.col("n") > high))
        if high >= largest or short.isEmpty():
            return out
        high *= 2


def _others() -> Column:
    """For each slot another value, by a hash of (name, draw, slot) among those of another name."""
    codes, starts = S._value_rows(("random",))
    all_codes, t = S.numbers(codes), S.slots()
    first = t.row(F.lit(0))

    def other(i: Column) -> Column:
        now = F.get(F.col("codes"), i - first)
        options = F.slice(all_codes, F.get(S.numbers(starts), t.kind(i)) + 1, t.size_of(i))
        h = S._number(F.lit("other"), F.col("name"), F.col("draw").cast("string"), (i - first).cast("string"))
        rest = F.filter(options, lambda c: S.first_name(c) != S.first_name(now))
        return F.transform(F.array(rest), lambda r: F.get(r, (h % F.size(r)).cast("int")))[0]

    return F.transform(t.rows(), other)


def _accepted(quota: int) -> Column:
    """The fold over one name's draws: a pair is accepted if both formats are valid and new, until the quota is met."""
    empty = F.array().cast("array<struct<draw: bigint, slot: int, v0: array<int>, v1: array<int>>>")
    plain = lambda codes: F.transform(codes, S.first_name)

    def take(done: Column, x: Column) -> Column:
        slot = (F.size(done) % F.size(x["codes"])).cast("int")
        pair = F.struct(x["draw"].alias("draw"), slot.alias("slot"), x["codes"].alias("v0"), _with(x["codes"], slot, F.get(x["others"], slot)).alias("v1"))
        return F.when((F.size(done) >= quota) | ~F.get(x["fine"], slot), done).otherwise(F.transform(F.array(pair), lambda q: _add(done, q))[0])

    def _add(done: Column, q: Column) -> Column:
        used = F.exists(done, lambda o: (plain(o["v0"]) == plain(q["v0"])) | (plain(o["v1"]) == plain(q["v0"])) | (plain(o["v0"]) == plain(q["v1"])) | (plain(o["v1"]) == plain(q["v1"])))
        return F.when(used, done).otherwise(F.concat(done, F.array(q)))

    return F.aggregate("draws", empty, take)


def pairs_sql(seed: str, quota: int, draws: int, tasks: str) -> str:
    """The same by a recursive query over the first ``draws`` draws; ``tasks`` are CTEs up to tl (task, template)."""
    return f"""WITH RECURSIVE {S.relations_sql()}, {tasks},
tn AS (SELECT tl.*, l.mode, l.n FROM tl JOIN lay l ON l.template = tl.template),
{S.draws_sql(f"SELECT task, template, mode, range AS format_id FROM tn, range({draws})", seed, "f.task")},
{S.cells_sql('fs', 'task, template, format_id')},
oc AS (SELECT f.task, f.template, f.format_id, f.slot, list(c.code ORDER BY c.pos) AS rest FROM fs f JOIN vals a ON a.code = f.code
  JOIN (SELECT template, slot, unnest(codes) AS code, unnest(range(len(codes))) AS pos FROM slots) c ON c.template = f.template AND c.slot = f.slot JOIN vals b ON b.code = c.code WHERE b.first <> a.first GROUP BY f.task, f.template, f.format_id, f.slot),
ot AS (SELECT *, rest[CAST('0x' || substr(md5(concat_ws('|', 'other', task, CAST(format_id AS VARCHAR), CAST(slot AS VARCHAR))), 1, 6) AS BIGINT) % len(rest) + 1] AS other FROM oc),
nb AS (SELECT o.task, o.template, o.format_id, o.slot AS mslot, f.slot, f.kind, f.cell, f.rule, f.space, CASE WHEN f.slot = o.slot THEN o.other ELSE f.code END AS code
  FROM ot o JOIN fs f USING (task, template, format_id)),
{S.cells_sql('nb', 'task, template, format_id, mslot', 'n')},
v0 AS (SELECT task, format_id, list(v.first ORDER BY slot) AS names0, string_agg(v.idx, ',' ORDER BY slot) AS vals0 FROM fs JOIN vals v USING (code) GROUP BY task, format_id),
v1 AS (SELECT task, format_id, mslot, list(v.first ORDER BY slot) AS names1, string_agg(v.idx, ',' ORDER BY slot) AS vals1 FROM nb JOIN vals v USING (code) GROUP BY task, format_id, mslot),
cand AS (SELECT f.task, f.template, f.format_id, n.mslot, CAST(len(names0) AS BIGINT) AS n_slots, f.valid AND n.valid AS ok, names0, names1, vals0, vals1
  FROM fv f JOIN nfv n USING (task, template, format_id) JOIN v0 USING (task, format_id) JOIN v1 ON v1.task = f.task AND v1.format_id = f.format_id AND v1.mslot = n.mslot),
w AS (
  SELECT task, template, CAST(-1 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n_done, CAST([] AS INTEGER[][]) AS used, FALSE AS took FROM tl
  UNION ALL
  SELECT w.task, w.template, w.k + 1, w.n_done + CAST(c.ok AND NOT list_contains(used, names0) AND NOT list_contains(used, names1) AS BIGINT),
    CASE WHEN c.ok AND NOT list_contains(used, names0) AND NOT list_contains(used, names1) THEN list_concat(used, [names0, names1]) ELSE used END,
    c.ok AND NOT list_contains(used, names0) AND NOT list_contains(used, names1)
  FROM w JOIN cand c ON c.task = w.task AND c.format_id = w.k + 1 AND c.mslot = w.n_done % c.n_slots WHERE w.n_done < {quota}
)
SELECT w.task, w.template, CAST(w.n_done - 1 AS INT) AS pair, w.k AS draw, CAST(c.mslot AS INT) AS slot_idx, vals0 AS v0, vals1 AS v1
FROM w JOIN cand c ON c.task = w.task AND c.format_id = w.k AND c.mslot = (w.n_done - 1) % c.n_slots WHERE took"""
