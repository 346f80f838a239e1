"""Queries C1-C23, B7 and F36: the format space of all task layouts in one plan each.

Formats are drawn for the ids of the ``documents`` table: the id is the number of
the draw, so a layout's formats never repeat and end when its space does.  Tasks
are named like the task files of the data (one per source and language).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptspread.functions.ranking import bucketed_rank
from promptspread.operators import format_space as S
from promptspread.operators import instances as I
from promptspread.operators import layouts as L
from promptspread.operators import neighbours as N
from promptspread.operators import splits as SP
from promptspread.plans.registry import register
from promptspread.sources import views as V
from promptspread.sources.tables import table

SEED = "1"
REF = L.REFERENCE
QUOTA = 50            # formats of a task (C4)
EXHAUSTIVE_QUOTA = 1000   # a space up to this size is enumerated (C3)
N_TEST = 10           # test formats per split (C15)
ENSEMBLE_SIZE = 5
N_ENSEMBLES = 4
KEEP_LAST = 4
N_PAIRS = 40          # neighbour pairs of a task (C9)


def ids(spark, d) -> DataFrame:
    """Numbers of draws: the documents' ids, dealt to all tasks, since a draw costs far more than reading its number."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("format_id")).repartition(S.spread(spark), "format_id")


def formats(spark, d, modes=("random",)) -> DataFrame:
    """Assignments of every layout (and mode), one per id."""
    return S.drawn(S.with_layouts(ids(spark, d), modes), SEED, modes=modes)


def reference_formats(spark, d) -> DataFrame:
    rows = ids(spark, d).select("format_id", F.lit(REF).alias("template"), F.lit("random").alias("mode"), F.lit(S.NAMES.index(REF)).alias("number"))
    return S.drawn(rows, SEED)


def joined(values) -> F.Column:
    return F.array_join(values.cast("array<string>"), ",")


IDS_SQL = "SELECT l.template, l.mode, doc_id AS format_id FROM documents, lay l"
DRAWS = f"WITH {S.relations_sql()}, {S.draws_sql(IDS_SQL, SEED)}"
CELLS = f"{DRAWS}, {S.cells_sql()}"
TEXTS = f"{CELLS}, {S.text_sql()}"
VALS = "vs AS (SELECT fs.template, fs.format_id, string_agg(v.idx, ',' ORDER BY fs.slot) AS vals FROM fs JOIN vals v USING (code) GROUP BY fs.template, fs.format_id)"


# ------------------------------------------------------------------ catalogue

@register("c1_catalogue_usage", sql=f"""{DRAWS}
SELECT v.kind AS action_type, CAST(v.idx AS INT) AS value_idx, v.value, CAST(count(fs.code) AS BIGINT) AS n_draws
FROM vals v LEFT JOIN fs ON fs.code = v.code GROUP BY v.kind, v.idx, v.value""")
def c1_catalogue_usage(spark, d):
    """The value catalogue and how often each value is drawn, over all layouts at once."""
    rows = [(c, kind, c - L.OFFSET[kind], v) for c, (kind, v) in enumerate(L.CODES)]
    values = F.broadcast(spark.createDataFrame(rows, "code int, action_type string, value_idx int, value string"))
    used = formats(spark, d).select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("n_draws"))
    return values.join(used, "code", "left").select("action_type", "value_idx", "value", F.coalesce("n_draws", F.lit(0)).alias("n_draws"))


@register("c2_slot_values_long", sql=f"""{DRAWS}
SELECT template, format_id, CAST(slot AS INT) AS slot_idx, fs.kind AS action_type, CAST(v.idx AS INT) AS value_idx FROM fs JOIN vals v USING (code)""")
def c2_slot_values_long(spark, d):
    """Every layout's slot list with the drawn assignments, long form (format, slot, type, value)."""
    x = formats(spark, d).select("template", "format_id", F.posexplode(F.arrays_zip(S.slot_kinds().alias("k"), S.indices(F.col("codes")).alias("v"))))
    return x.select("template", "format_id", F.col("pos").alias("slot_idx"), F.col("col.k").alias("action_type"), F.col("col.v").alias("value_idx"))


# ------------------------------------------------------------------ tasks

TASK_IDS = [t for layout in L.LAYOUTS for t in layout.tasks]
BRANCHES = [(i, t, layout.name) for i, layout in enumerate(L.LAYOUTS) for t in layout.tasks]


def task_files(spark, d) -> DataFrame:
    """Stand-in task files of the data: one per source and language, with a task id in front."""
    pairs = table(spark, d, "documents").select("source", "lang").distinct()
    pick = F.conv(F.substring(F.md5(F.concat_ws("|", "source", "lang")), 1, 6), 16, 10).cast("bigint") % len(TASK_IDS)
    return pairs.select(F.concat_ws("_", F.get(S.strings(TASK_IDS), pick.cast("int")), "source", "lang").alias("task"))


def task_layouts(spark, files: DataFrame) -> DataFrame:
    """The layout of each task file: the first branch one of whose task ids, closed by an underscore, is in the name."""
    branches = F.broadcast(spark.createDataFrame(BRANCHES, "branch int, task_id string, template string"))
    hits = files.join(branches, F.contains("task", F.concat("task_id", F.lit("_"))))
    return hits.groupBy("task").agg(F.min(F.struct("branch", "template")).alias("b")).select("task", "b.template")


TASKS_SQL = f"""tf AS (SELECT DISTINCT concat_ws('_', ({S._q(TASK_IDS)})[CAST('0x' || substr(md5(concat_ws('|', source, lang)), 1, 6) AS BIGINT) % {len(TASK_IDS)} + 1], source, lang) AS task FROM documents),
tl AS (SELECT task, arg_min(template, branch) AS template FROM tf JOIN (VALUES {', '.join(S._q(list(b)).replace('[', '(').replace(']', ')') for b in BRANCHES)}) b(branch, task_id, template)
       ON contains(task, task_id || '_') GROUP BY task)"""


@register("c22_task_layouts", sql=f"""WITH {S.relations_sql()}, {TASKS_SQL}
SELECT task, tl.template, CAST(n_slots AS INT) AS n_slots, CAST(n AS BIGINT) AS n_assignments, CAST(p.n_parts AS INT) AS n_parts
FROM tl JOIN lay ON lay.template = tl.template JOIN (SELECT template, count(*) AS n_parts FROM parts GROUP BY template) p ON p.template = tl.template""")
def c22_task_layouts(spark, d):
    """Which of the 39 layouts each task file uses, with the layout's size."""
    x = task_layouts(spark, task_files(spark, d)).withColumn("number", S.layout_number(F.col("template")))
    n_parts = S.of_layout([len(r.parts) for r in L.RELATIONS.values()])
    return x.select("task", "template", F.size(S.slot_kinds()).alias("n_slots"), S.assignments().alias("n_assignments"), n_parts.alias("n_parts"))


# --------------------------------------------------------------- sampling

def per_task(spark, d, quota: int, seed: str) -> DataFrame:
    named = task_layouts(spark, task_files(spark, d)).withColumnRenamed("task", "name")
    return S.sampled(named, quota, seed).withColumn("number", S.layout_number(F.col("template")))


def per_task_sql(quota: int, seed: str, draws: int) -> str:
    """The same with ``draws`` tries for each task, more than any of them needs at the size the oracle runs on."""
    return f"""WITH {S.relations_sql()}, {TASKS_SQL},
tn AS (SELECT tl.*, l.mode, l.n FROM tl JOIN lay l ON l.template = tl.template),
{S.draws_sql(f"SELECT task, template, mode, range AS format_id FROM tn, range({draws}) WHERE n > {quota}", seed, "f.task")},
fe AS (SELECT task, t.template, s.mode, range AS format_id, slot, kind, cell, rule, space, codes[(range // stride) % size + 1] AS code
       FROM tn t JOIN slots s ON s.template = t.template, range({quota}) WHERE t.n <= {quota} AND range < t.n),
fu AS (SELECT task, template, format_id, slot, kind, cell, rule, space, code FROM fs UNION ALL SELECT task, template, format_id, slot, kind, cell, rule, space, code FROM fe),
{S.cells_sql('fu', 'task, template, format_id')},
ok AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY format_id) AS ord FROM fv WHERE valid),
vs AS (SELECT task, format_id, string_agg(v.idx, ',' ORDER BY slot) AS vals FROM fu JOIN vals v USING (code) GROUP BY task, format_id)
SELECT task, template, CAST(format_id AS BIGINT) AS draw, CAST(ord AS INT) AS ord, vals FROM ok JOIN vs USING (task, format_id) WHERE ord <= {quota}"""


def _sample(spark, d, quota, seed):
    return per_task(spark, d, quota, seed).select(F.col("name").alias("task"), "template", "draw", "ord", joined(S.indices(F.col("codes"))).alias("vals"))


@register("c3_exhaustive_formats", sql=per_task_sql(EXHAUSTIVE_QUOTA, "all", 4 * EXHAUSTIVE_QUOTA))
def c3_exhaustive_formats(spark, d):
    """All valid assignments of a task whose space fits the quota; of a larger space, as many valid draws as the quota."""
    return _sample(spark, d, EXHAUSTIVE_QUOTA, "all")


@register("c4_sampled_valid_formats", sql=per_task_sql(QUOTA, "some", 10 * QUOTA))
def c4_sampled_valid_formats(spark, d):
    """C4: every task's first valid draws without repetition, until its quota is met."""
    return _sample(spark, d, QUOTA, "some")


# ------------------------------------------------------ evaluation

@register("c5_effective_values", sql=f"""{CELLS}
SELECT c.template, c.format_id, CAST(any_value(a.n) AS INT) AS n_rejected, md5(string_agg(v.value, chr(31) ORDER BY c.cell)) AS effective_md5
FROM fc c JOIN vals v USING (code) JOIN (SELECT template, format_id, count(*) FILTER (NOT ok) AS n FROM fa GROUP BY template, format_id) a
  ON a.template = c.template AND a.format_id = c.format_id GROUP BY c.template, c.format_id""")
def c5_effective_values(spark, d):
    """Effective values after applying the slots in order (a rejected write keeps the old value)."""
    x = S.evaluated(formats(spark, d))
    return x.select("template", "format_id", F.col("rejected").alias("n_rejected"), F.md5(F.array_join(S.names(F.col("cells")), "\x1f")).alias("effective_md5"))


@register("c6_format_validity", sql=f"{CELLS} SELECT template, format_id, valid FROM fv")
def c6_format_validity(spark, d):
    """The validity rules on every drawn assignment of every layout."""
    return S.evaluated(formats(spark, d)).select("template", "format_id", "valid")


def valid_texts(spark, d) -> DataFrame:
    return S.with_text(S.evaluated(formats(spark, d), True))


@register("c7_render_format", sql=f"{TEXTS} SELECT template, format_id, format_text FROM ft JOIN fv USING (template, format_id) WHERE valid AND format_text IS NOT NULL")
def c7_render_format(spark, d):
    """Every valid assignment as its format string with ``{{}}`` holes."""
    return valid_texts(spark, d).select("template", "format_id", "format_text")


@register("c8_value_name_index", sql=f"""{DRAWS}
SELECT template, format_id, string_agg(w.idx, ',' ORDER BY slot) AS name_indices, CAST(count(*) FILTER (v.first <> v.code) AS INT) AS n_remapped
FROM fs JOIN vals v ON v.code = fs.code JOIN vals w ON w.code = v.first GROUP BY template, format_id""")
def c8_value_name_index(spark, d):
    """Value names and back to indices; a name listed twice resolves to its first place."""
    x = formats(spark, d).withColumn("back", S.from_names(S.names(F.col("codes"))))
    n = F.size(F.filter(F.arrays_zip("back", "codes"), lambda p: p["back"] != p["codes"]))
    return x.select("template", "format_id", joined(S.indices(F.col("back"))).alias("name_indices"), n.alias("n_remapped"))


@register("c21_format_profile", sql=f"""{CELLS}
SELECT l.template, CAST(l.n_slots AS INT) AS n_slots, CAST(count(DISTINCT s.kind) AS INT) AS n_types, string_agg(DISTINCT s.kind, ',' ORDER BY s.kind) AS types,
       l.n_slots = (SELECT max(n_slots) FROM lay) AS is_longest, count(DISTINCT s.kind) = 6 AS uses_all_types, any_value(n_formats) AS n_formats, any_value(n_valid) AS n_valid
FROM lay l JOIN slots s ON s.template = l.template JOIN (SELECT template, CAST(count(*) AS BIGINT) AS n_formats, CAST(count_if(valid) AS BIGINT) AS n_valid FROM fv GROUP BY template) f
  ON f.template = l.template GROUP BY l.template, l.n_slots""")
def c21_format_profile(spark, d):
    """Per layout: slots, slot types, longest sequence, all-six-types flag, drawn and valid counts."""
    longest = max(len(r.slots) for r in L.RELATIONS.values())
    x = S.evaluated(formats(spark, d)).groupBy("template", "number").agg(F.count("*").alias("n_formats"), F.count_if("valid").alias("n_valid"))
    kinds = F.array_sort(F.array_distinct(S.slot_kinds()))
    return x.select("template", F.size(S.slot_kinds()).alias("n_slots"), F.size(kinds).alias("n_types"), F.array_join(kinds, ",").alias("types"),
                    (F.size(S.slot_kinds()) == longest).alias("is_longest"), (F.size(kinds) == 6).alias("uses_all_types"), "n_formats", "n_valid")


def default_texts(spark) -> DataFrame:
    """The layouts' own texts, before any format is applied: order 0 of every register."""
    one = spark.range(1).select(F.lit(-1).cast("bigint").alias("format_id"))
    init = S.Table("code", [[(c[1],) for c in r.cells] for r in L.RELATIONS.values()])
    return S.with_text(S.with_layouts(one).withColumn("cells", F.transform(init.rows(), init.code))).select("template", "format_id", "format_text")


@register("c23_register_formats", sql=f"""{TEXTS},
r AS (SELECT template, format_id, format_text FROM ft JOIN fv USING (template, format_id) WHERE valid
      UNION ALL SELECT p.template, -1, string_agg(h.text, '' ORDER BY p.pos) FROM parts p LEFT JOIN cells c ON c.template = p.template AND c.cell = p.cell
                JOIN choices h ON h.list = p.list AND h.code = coalesce(c.code, 0) GROUP BY p.template),
g AS (SELECT template, format_text, min(format_id) AS first_id, CAST(count(*) AS BIGINT) AS n_same FROM r WHERE format_text IS NOT NULL GROUP BY template, format_text),
o AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY first_id) - 1 AS generation_order FROM g)
SELECT r.template, CAST(r.format_id AS BIGINT) AS format_id, md5(r.format_text) AS text_md5, CAST(generation_order AS BIGINT) AS generation_order, n_same, r.format_id = first_id AS is_first
FROM r JOIN o USING (template, format_text)""")
def c23_register_formats(spark, d):
    """The register of format texts: the default first, then texts as first seen, and every assignment that gives one."""
    texts = valid_texts(spark, d).select("template", "format_id", "format_text").unionByName(default_texts(spark))
    path = S.shared_path(spark, f"register-{S.uuid.uuid4().hex}")   # two readers: drawn and rendered once, kept as digests
    texts.select("template", "format_id", F.md5("format_text").alias("h")).write.parquet(path)
    rows = spark.read.schema("template string, format_id bigint, h string").parquet(path)
    seen = rows.groupBy("template", "h").agg(F.min("format_id").alias("first_id"), F.count("*").alias("n_same"))
    ranked = bucketed_rank(seen, ["template"], ["first_id"], F.floor(F.col("first_id") / 4096), "rn")
    x = rows.select("template", "format_id", "h").join(ranked, ["template", "h"])
    return x.select("template", "format_id", F.col("h").alias("text_md5"), (F.col("rn") - 1).alias("generation_order"), "n_same", (F.col("format_id") == F.col("first_id")).alias("is_first"))


# ------------------------------------------------------- neighbours

@register("c9_neighbor_pairs", sql=N.pairs_sql("pairs", N_PAIRS, 8 * N_PAIRS, TASKS_SQL))
def c9_neighbor_pairs(spark, d):
    """Every task's pairs that differ in one slot, the slot by the number of pairs accepted before; both valid, no format used twice."""
    x = N.pairs(task_layouts(spark, task_files(spark, d)).withColumnRenamed("task", "name"), "pairs", N_PAIRS)
    return x.select(F.col("name").alias("task"), "template", "pair", "draw", "slot_idx", joined(S.indices(F.col("v0"))).alias("v0"), joined(S.indices(F.col("v1"))).alias("v1"))


@register("c10_two_step_paths", sql=f"""{CELLS},
{N.paths_sql()}
SELECT template, format_id, CAST(slot1 AS INT) AS slot1, CAST(c1 AS INT) AS code1, CAST(slot2 AS INT) AS slot2, CAST(c2 AS INT) AS code2 FROM paths""")
def c10_two_step_paths(spark, d):
    """For every valid format that has one, a path to a second and a third valid format, each step in one slot."""
    x = S.evaluated(formats(spark, d), True)
    return N.paths(x).select("template", "format_id", "slot1", "code1", "slot2", "code2")


# ------------------------------------------------ modes and splits (C11-C17)

@register("c11_mode_catalogues", sql=f"""WITH {S.relations_sql(S.MODES, (REF,))}, {S.draws_sql(IDS_SQL, SEED)},
{S.cells_sql('fs', 'template, mode, format_id')}
SELECT v.mode, CAST(count(*) AS BIGINT) AS n_drawn, CAST(count_if(valid) AS BIGINT) AS n_valid,
       CAST(count(DISTINCT w.value) AS BIGINT) AS n_root_spaces
FROM fv v JOIN fs s ON s.mode = v.mode AND s.format_id = v.format_id AND s.slot = 0 JOIN vals w ON w.code = s.code GROUP BY v.mode""")
def c11_mode_catalogues(spark, d):
    """C11: the reference layout drawn from every split mode's catalogue, in one plan; validity and root spaces."""
    rows = S.with_layouts(ids(spark, d), S.MODES).where(F.col("template") == REF)
    x = S.drawn(rows, SEED, modes=S.MODES).withColumn("number", (F.col("number") % len(S.NAMES)).cast("int"))
    x = S.evaluated(x).withColumn("space", S.names(F.col("codes"))[0])
    return x.groupBy("mode").agg(F.count("*").alias("n_drawn"), F.count_if("valid").alias("n_valid"), F.count_distinct("space").alias("n_root_spaces"))


KEYS_SQL = """k AS (SELECT template, format_id, concat(
  coalesce(arg_min(v.value, slot) FILTER (fs.kind = 'chosen_space' AND v.value <> ''), ''),
  coalesce(arg_min(v.value, slot) FILTER (fs.kind = 'chosen_separator' AND v.value <> ''), ''),
  coalesce(arg_min(v.value, slot) FILTER (fs.kind = 'text_descriptor_fn'), '')) AS key FROM fs JOIN vals v USING (code) GROUP BY template, format_id)"""


@register("c12_essential_key_dedup", sql=f"""{DRAWS}, {KEYS_SQL}
SELECT template, md5(key) AS key_md5, min(format_id) AS format_id, CAST(count(*) AS BIGINT) AS n_formats FROM k GROUP BY template, key""")
def c12_essential_key_dedup(spark, d):
    """Essential key (first non-empty space, separator, case function) and the first format that has it."""
    x = formats(spark, d).withColumn("k", S.essential_key(F.col("codes")))
    return x.groupBy("template", "k").agg(F.min("format_id").alias("format_id"), F.count("*").alias("n_formats")).select("template", F.md5("k").alias("key_md5"), "format_id", "n_formats")


@register("c13_transfer_format", sql=f"""WITH {S.relations_sql()}, {S.draws_sql(IDS_SQL + f" WHERE l.template = '{REF}'", SEED)},
{SP.transfer_sql('fs', 'format_id')}, {S.cells_sql('tr')},
vs AS (SELECT template, format_id, string_agg(v.idx, ',' ORDER BY slot) AS vals FROM tr JOIN vals v USING (code) GROUP BY template, format_id)
SELECT template AS target, format_id, vals, valid FROM fv JOIN vs USING (template, format_id)""")
def c13_transfer_format(spark, d):
    """Every reference-task format carried to every layout (k-th slot of a type takes the k-th value), with its validity there."""
    x = SP.everywhere(reference_formats(spark, d))
    return x.select(F.col("template").alias("target"), "format_id", joined(S.indices(F.col("codes"))).alias("vals"), "valid")


@register("c14_valid_on_all_tasks", sql=f"""WITH {S.relations_sql()}, {S.draws_sql(IDS_SQL + f" WHERE l.template = '{REF}'", SEED)},
{SP.transfer_sql('fs', 'format_id')}, {S.cells_sql('tr')}
SELECT format_id, bool_and(valid) AS valid_all, CAST(count_if(valid) AS INT) AS n_valid_tasks FROM fv GROUP BY format_id""")
def c14_valid_on_all_tasks(spark, d):
    """C14: on how many layouts each reference-task format is valid, and whether on all."""
    x = SP.everywhere(reference_formats(spark, d)).groupBy("format_id")
    return x.agg(F.bool_and("valid").alias("valid_all"), F.count_if("valid").cast("int").alias("n_valid_tasks"))


def split(spark, d, modes=S.MODES, seed: str = "split") -> DataFrame:
    """The test formats of the splits over the data's tasks."""
    return SP.build(task_layouts(spark, task_files(spark, d)), modes, N_TEST, seed)


SPLIT_SQL = SP.build_sql(S.MODES, N_TEST, "split", f"{S.relations_sql(S.MODES)}, {TASKS_SQL}")


@register("c15_build_split", sql=f"""{SPLIT_SQL}
SELECT mode, task, template, CAST(ord AS INT) AS ord, vals, kinds AS action_types FROM split""")
def c15_build_split(spark, d):
    """The test split of all six modes: valid on all tasks, one per essential key, carried to every task with its slot types."""
    x = split(spark, d)
    return x.select("mode", "task", "template", "ord", F.array_join(S.names(F.col("codes")), "\x1f").alias("vals"), F.array_join(S.slot_kinds(), ",").alias("action_types"))


@register("c16_split_new_permutation", views=("instances",), sql=f"""{SP.build_sql(("random",), N_TEST, "split", f"{S.relations_sql()}, {TASKS_SQL}")},
p AS (SELECT task, instance_id, row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', '29', CAST(instance_id AS VARCHAR)))) - 1 AS ord FROM instances)
SELECT p.task, p.instance_id, CAST(p.ord AS BIGINT) AS ord, CAST(s.ord AS INT) AS format_ord, md5(s.vals) AS format_md5
FROM p JOIN split s ON s.template = '{REF}' AND s.task = '{REF}_'""".replace("tl AS (", f"tl AS (SELECT '{REF}_' AS task, '{REF}' AS template UNION ALL "))
def c16_split_new_permutation(spark, d):
    """The formats of a split over a fresh permutation of other instances: every (instance, format) to evaluate."""
    one = spark.createDataFrame([(f"{REF}_", REF)], "task string, template string")
    both = task_layouts(spark, task_files(spark, d)).unionByName(one)
    s = SP.build(both, ("random",), N_TEST, "split").where(F.col("task") == f"{REF}_")
    chosen = F.array_sort(F.collect_list(F.struct(F.col("ord").alias("format_ord"), F.md5(F.array_join(S.names(F.col("codes")), "\x1f")).alias("format_md5"))))
    listed = s.agg(chosen.alias("fs")).scalar()   # N_TEST formats
    inst = I.seeded_shuffle(V.instances_base(spark, d).select("task", "instance_id"), ["task"], "instance_id", 29)
    return inst.select("task", "instance_id", "ord", F.explode(listed).alias("f")).select("task", "instance_id", "ord", "f.format_ord", "f.format_md5")


@register("c17_split_coherence", sql=f"""{SPLIT_SQL}
SELECT mode, task, CAST(count(DISTINCT vals) AS BIGINT) AS n_distinct, count(DISTINCT vals) = {N_TEST} AS coherent FROM split GROUP BY mode, task""")
def c17_split_coherence(spark, d):
    """C17: whether each task of each split holds exactly n distinct formats (carrying may merge some)."""
    x = split(spark, d).groupBy("mode", "task").agg(F.count_distinct("codes").alias("n_distinct"))
    return x.withColumn("coherent", F.col("n_distinct") == N_TEST)


# ------------------------------------------------------------ placeholders

def _asks(r: L.Relations) -> str:
    return "Choose one of " + ", ".join(f"'{{{label}_{i}}}'" for label, (_, items) in r.labels.items() for i in range(1, len(items) + 1)) + "."


@register("c18_fill_placeholders", sql=f"""{CELLS},
items(template, name, pos, cell, list) AS (VALUES {', '.join(S._q([n, label, i, cell, S._text_lists()[(L.OFFSET[L.NUMBER], tuple(L.numbered(item)))]]).replace('[', '(').replace(']', ')')
    for n, r in L.RELATIONS.items() for label, (cell, its) in r.labels.items() for i, item in enumerate(its, 1))})
SELECT v.template, v.format_id, 'Choose one of ' || string_agg('''' || h.text || '''', ', ' ORDER BY i.name, i.pos) || '.' AS instruction
FROM fv v JOIN items i ON i.template = v.template JOIN fc c ON c.template = v.template AND c.format_id = v.format_id AND c.cell = i.cell
JOIN choices h ON h.list = i.list AND h.code = c.code WHERE valid GROUP BY v.template, v.format_id HAVING count(h.text) = count(*)""")
def c18_fill_placeholders(spark, d):
    """An instruction's ``{{object_item}}`` placeholders, for every object and item of every layout, as the format numbers them."""
    asks = F.get(S.strings([_asks(r) if r.labels else "" for r in L.RELATIONS.values()]), F.col("number"))
    x = S.evaluated(formats(spark, d), True).withColumn("ask", asks).where("ask <> ''")
    return S.held(x, "instruction", S.filled_in(F.col("ask"), F.col("cells")), lambda t: t.isNotNull()).select("template", "format_id", "instruction")


# ------------------------------------------------------------ ensembles

def _ens_sql(tail: str) -> str:
    body = per_task_sql(N_ENSEMBLES * ENSEMBLE_SIZE, "ensembles", 400)
    at = body.rindex("\nSELECT task, template")
    return f"""{body[:at]},
fm AS ({body[at:]}),
e AS (SELECT task, CAST(((ord - 1) // {ENSEMBLE_SIZE} + 1) % {N_ENSEMBLES} AS INT) AS ensemble_id, CAST((ord - 1) % {ENSEMBLE_SIZE} AS INT) AS member_pos, draw FROM fm
      UNION ALL SELECT DISTINCT task, 0, -1, CAST(-1 AS BIGINT) FROM fm)
{tail}"""


def _ensembles(spark, d) -> DataFrame:
    x = per_task(spark, d, N_ENSEMBLES * ENSEMBLE_SIZE, "ensembles")
    at = F.col("ord") - 1
    x = x.select(F.col("name").alias("task"), ((F.floor(at / ENSEMBLE_SIZE) + 1) % N_ENSEMBLES).cast("int").alias("ensemble_id"), (at % ENSEMBLE_SIZE).cast("int").alias("member_pos"), "draw")
    default = x.select("task").distinct().select("task", F.lit(0).alias("ensemble_id"), F.lit(-1).alias("member_pos"), F.lit(-1).cast("bigint").alias("draw"))
    return x.unionByName(default)


@register("c19_ensembles", sql=_ens_sql("SELECT task, ensemble_id, member_pos, draw FROM e"))
def c19_ensembles(spark, d):
    """A task's formats in blocks; the last block moves to the front and gets the default format (draw -1) prepended."""
    return _ensembles(spark, d)


@register("c20_keep_last_k", sql=_ens_sql(f"""SELECT task, ensemble_id, member_pos, draw, least(n, {KEEP_LAST}) = {KEEP_LAST} AS "full" FROM (
  SELECT *, row_number() OVER (PARTITION BY task, ensemble_id ORDER BY member_pos DESC) AS rk, count(*) OVER (PARTITION BY task, ensemble_id) AS n FROM e) WHERE rk <= {KEEP_LAST}"""))
def c20_keep_last_k(spark, d):
    """C20: the last k formats of each ensemble (the first may be the shared default); short ones are flagged."""
    w = Window.partitionBy("task", "ensemble_id")
    r = _ensembles(spark, d).withColumn("rk", F.row_number().over(w.orderBy(F.col("member_pos").desc()))).withColumn("n", F.count("*").over(w))
    return r.where(F.col("rk") <= KEEP_LAST).select("task", "ensemble_id", "member_pos", "draw", (F.least("n", F.lit(KEEP_LAST)) == KEEP_LAST).alias("full"))


# -------------------------------------------------------------------- F36

F36_LAYOUT = "task1661"
TOP_K = 5


@register("f36_sensitive_tasks", views=("predictions",), sql=f"""
WITH {S.relations_sql(only=(F36_LAYOUT,))},
{S.draws_sql("SELECT DISTINCT l.template, l.mode, p.format_id FROM predictions p, lay l", "f36")}, {S.cells_sql()}, {S.text_sql()},
acc AS (SELECT task, format_id, CAST(sum(CASE WHEN generation = answer THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS acc FROM predictions GROUP BY task, format_id),
ra AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY acc DESC, format_id) AS rb, row_number() OVER (PARTITION BY task ORDER BY acc ASC, format_id) AS rw FROM acc),
ta AS (SELECT task, max(acc) - min(acc) AS spread, max(CASE WHEN rb = 1 THEN format_id END) AS best_format, max(CASE WHEN rw = 1 THEN format_id END) AS worst_format FROM ra GROUP BY task),
ka AS (SELECT * FROM ta ORDER BY spread DESC, task LIMIT {TOP_K})
SELECT ka.task, round(ka.spread, 6) AS spread, concat('Is the document of good ', ka.task, '?') AS definition, b.format_text AS best_format_text, w.format_text AS worst_format_text
FROM ka JOIN ft b ON b.format_id = ka.best_format JOIN ft w ON w.format_id = ka.worst_format""")
def f36_sensitive_tasks(spark, d):
    """the most format-sensitive tasks (top-k spread) with their best and worst format text and definition."""
    from promptspread.operators import metrics as M
    fm = M.plain_accuracy(V.predictions(spark, d), ["task", "format_id"])
    bw = M.best_worst(fm, ["task"]).withColumn("spread", F.col("best_accuracy") - F.col("worst_accuracy"))
    top = bw.orderBy(F.col("spread").desc(), "task").limit(TOP_K)
    text = S.drawn(V.predictions(spark, d).select("format_id").distinct().withColumn("number", F.lit(S.NAMES.index(F36_LAYOUT))), "f36")
    text = S.evaluated(text).select("format_id", S.rendered(F.col("cells")).alias("format_text"))
    b = text.select(F.col("format_id").alias("best_format"), F.col("format_text").alias("best_format_text"))
    w = text.select(F.col("format_id").alias("worst_format"), F.col("format_text").alias("worst_format_text"))
    return top.join(b, "best_format").join(w, "worst_format").select(
        "task", "spread", F.concat(F.lit("Is the document of good "), F.col("task"), F.lit("?")).alias("definition"), "best_format_text", "worst_format_text")
