"""Queries B1-B17 and A3/A4 over the instances view (V5) and the driver tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from promptspread.functions.ranking import seeded_key
from promptspread.operators import extraction as EX
from promptspread.operators import format_space as S
from promptspread.operators import instances as I
from promptspread.operators import layouts as L
from promptspread.operators import prompts as P
from promptspread.operators import scoring as SC
from promptspread.plans import format_queries as FQ
from promptspread.plans.registry import register
from promptspread.sources import views as V
from promptspread.sources.tables import table

SHUFFLE_SEED = 11
N_SHOT = 2
NUM_SAMPLES = 1000    # evaluation rows of a task at most, the reference's default
TRAIN_START = 0
TRAIN_SIZE = 1000
OPTION_SEED = 3
SAMPLE_N = 40


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


# ------------------------------------------------- stand-in instances of task layouts

FIELD_WORDS = 3


def layout_instances(spark, d):
    """Stand-in instances (task, template, number, instance_id, input, answer): each document written in its task's own
    layout, one field holding the whole text, the others a few of its words; some written without a space after colons."""
    docs = table(spark, d, "documents")
    tasks = FQ.task_layouts(spark, FQ.task_files(spark, d)).withColumnRenamed("task", "file")
    named = docs.withColumn("key", F.concat_ws("_", "source", "lang")).join(
        F.broadcast(tasks.select("file", "template", F.regexp_replace("file", "^task[0-9]+_", "").alias("key"))), "key")   # one row per source and language
    x = named.select(F.col("file").alias("task"), "template", S.layout_number(F.col("template")).alias("number"), F.col("doc_id").alias("instance_id"), F.col("text"), F.col("lang").alias("answer"))
    bank = EX.bank()
    t = S.Table("length place", [[(n, sum(map(len, bank[:i])) + j) for j, (n, _) in enumerate(part)] for i, part in enumerate(bank)])
    template = F.get(S.strings([text for part in bank for _, text in part]), t.place(t.row((F.col("instance_id") % t.size()).cast("int"))))
    x = x.withColumn("words", F.split("text", " ")).withColumn("tmpl", template).withColumn("holes", F.size(F.split("tmpl", "\\{\\}", -1)) - 1)
    piece = lambda j: F.array_join(F.slice("words", (j * FIELD_WORDS % F.size("words") + 1).cast("int"), FIELD_WORDS), " ")
    fields = F.transform(F.sequence(F.lit(0), F.col("holes") - 1), lambda j: F.when(j == F.col("instance_id") % F.col("holes"), F.col("text")).otherwise(piece(j)))
    x = x.withColumn("input", P.fill_template(F.col("tmpl"), fields))
    broken = F.when(F.col("instance_id") % 7 == 3, F.replace("input", F.lit(": "), F.lit(":"))).otherwise(F.col("input"))
    return x.select("task", "template", "number", "instance_id", broken.alias("input"), "answer")


def ordered_instances(spark, d):
    """The same with their place in each task's seeded permutation."""
    x = layout_instances(spark, d)
    ranked = I.seeded_shuffle(x.select("task", "instance_id"), ["task"], "instance_id", SHUFFLE_SEED)
    return x.join(ranked, ["task", "instance_id"])


def fill_sql(tmpl: str, fields: str) -> str:
    pieces = f"string_split({tmpl}, '{{}}')"
    return f"({pieces}[1] || array_to_string(list_transform(range(1, len({pieces})), lambda i: coalesce(({fields})[i], '') || {pieces}[i + 1]), ''))"


LAYOUT_SQL = f"""WITH {S.relations_sql()}, {FQ.TASKS_SQL}, {EX.bank_sql()},
bk AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY enum_len DESC) - 1 AS nth, count(*) OVER (PARTITION BY template) AS n_templates FROM bank),
li0 AS (SELECT tl.task, tl.template, d.doc_id AS instance_id, d.text, d.lang AS answer, b.text AS tmpl, string_split(d.text, ' ') AS words, len(string_split(b.text, '{{}}')) - 1 AS holes
  FROM documents d JOIN tl ON regexp_replace(tl.task, '^task[0-9]+_', '') = concat_ws('_', d.source, d.lang) JOIN bk b ON b.template = tl.template AND b.nth = d.doc_id % b.n_templates),
li1 AS (SELECT *, {fill_sql('tmpl', f"list_transform(range(0, holes), lambda j: CASE WHEN j = instance_id % holes THEN text ELSE array_to_string(list_slice(words, j * {FIELD_WORDS} % len(words) + 1, j * {FIELD_WORDS} % len(words) + {FIELD_WORDS}), ' ') END)")} AS filled FROM li0),
li AS (SELECT task, template, instance_id, answer, CASE WHEN instance_id % 7 = 3 THEN replace(filled, ': ', ':') ELSE filled END AS input,
  row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', '{SHUFFLE_SEED}', CAST(instance_id AS VARCHAR)))) - 1 AS ord FROM li1),
rx AS (SELECT template, enum_len, len(string_split(text, '{{}}')) - 1 AS holes, '^' || array_to_string(list_transform(string_split(text, '{{}}'), lambda p: CASE WHEN p = '' THEN p ELSE '\\Q' || p || '\\E' END), {q('(' + I.FIELD_CLASS + '+)')}) || '$' AS regex FROM bank),
hit AS (SELECT li.*, rx.enum_len, rx.regex, rx.holes, row_number() OVER (PARTITION BY task, instance_id ORDER BY enum_len DESC) AS best FROM li JOIN rx USING (template) WHERE regexp_matches(input, regex)),
px AS (SELECT * FROM hit WHERE best = 1)"""


@register("b1_seeded_shuffle", views=("instances",), sql=f"""
SELECT task, instance_id,
       CAST(row_number() OVER (PARTITION BY task ORDER BY md5(concat_ws('|', '{SHUFFLE_SEED}', CAST(instance_id AS VARCHAR)))) - 1 AS BIGINT) AS ord
FROM instances""")
def b1_seeded_shuffle(spark, d):
    """B1: seeded permutation of each task's instances (skew-safe bucketed rank)."""
    inst = V.instances_base(spark, d).select("task", "instance_id")
    return I.seeded_shuffle(inst, ["task"], "instance_id", SHUFFLE_SEED)


@register("b1_apply_permutation", views=("instances",), sql="""
SELECT i.task, i.instance_id, i.ord AS ord, i.answer FROM instances i""")
def b1_apply_permutation(spark, d):
    """B1: apply a stored permutation (long table task, ord, instance_id) by an equi-join."""
    inst = V.instances(spark, d)
    perm = inst.select("task", "ord", "instance_id")   # the stored permutation of V5
    return I.apply_permutation(inst.select("task", "instance_id", "answer"), perm, ["task"], "instance_id")


@register("b2_demo_eval_split", views=("instances",), sql="""
SELECT task, instance_id, ord, CASE WHEN ord < 10 THEN 'demo' ELSE 'eval' END AS split FROM instances""")
def b2_demo_eval_split(spark, d):
    """B2: first 10 permuted rows are demonstrations, the rest evaluation rows."""
    inst = V.instances(spark, d)
    return inst.select("task", "instance_id", "ord", I.demo_eval_split(F.col("ord")).alias("split"))


@register("b3_nshot_demos", sql=f"""{LAYOUT_SQL},
k AS (SELECT task, instance_id, ord, enum_len, row_number() OVER (PARTITION BY task ORDER BY ord) AS rn FROM px WHERE ord < {I.N_DEMOS})
SELECT task, instance_id, CAST(ord AS BIGINT) AS ord, CAST(enum_len AS INT) AS enum_len, count(*) OVER (PARTITION BY task) = {N_SHOT} AS enough FROM k WHERE rn <= {N_SHOT}""")
def b3_nshot_demos(spark, d):
    """First n_shot parseable demonstrations per task; ``enough`` flags tasks that fall short."""
    demos = EX.extracted(ordered_instances(spark, d).where(F.col("ord") < I.N_DEMOS))
    k = I.first_n_per_group(demos, ["task"], ["ord"], N_SHOT)
    return k.select("task", "instance_id", "ord", "enum_len", (F.count("*").over(Window.partitionBy("task")) == N_SHOT).alias("enough"))


@register("b4_template_regex", sql=f"""{LAYOUT_SQL}
SELECT tl.task, tl.template, CAST(rx.enum_len AS INT) AS enum_len, rx.regex FROM tl JOIN rx USING (template)""")
def b4_template_regex(spark, d):
    """Every task's extraction regexes: escaped literals, holes as the field class, anchored; one per enumeration length."""
    rows = [(name, n, text) for name, part in zip(S.NAMES, EX.bank()) for n, text in part]
    bank = F.broadcast(spark.createDataFrame(rows, "template string, enum_len int, text string"))   # the layouts' own templates
    return FQ.task_layouts(spark, FQ.task_files(spark, d)).join(bank, "template").select("task", "template", "enum_len", I.template_regex(F.col("text")).alias("regex"))


@register("b5_extract_fields", sql=f"""{LAYOUT_SQL},
f AS (SELECT *, list_transform(range(1, holes + 1), lambda i: regexp_extract_all(input, regex, CAST(i AS INTEGER))[1]) AS fields FROM px)
SELECT task, instance_id, CAST(enum_len AS INT) AS enum_len, CAST(holes AS INT) AS n_fields, md5(array_to_string(fields, chr(31))) AS fields_md5,
       CAST(length(fields[1]) AS INT) AS first_len, CAST(length(fields[len(fields)]) AS INT) AS last_len FROM f""")
def b5_extract_fields(spark, d):
    """Every instance's fields by its task's longest template that fits; rows that none fits are dropped."""
    x = EX.extracted(layout_instances(spark, d))
    return x.select("task", "instance_id", "enum_len", F.size("fields").alias("n_fields"), F.md5(F.array_join("fields", "\x1f")).alias("fields_md5"),
                    F.length(F.col("fields")[0]).alias("first_len"), F.length(F.element_at("fields", -1)).alias("last_len"))


@register("b6_reject_audit", sql=f"""{LAYOUT_SQL}
SELECT task, instance_id, array_to_string(list_sort(list_filter(list_distinct(string_split(regexp_replace(input, {q(I.FIELD_CLASS)}, '', 'g'), '')), lambda c: c <> '')), '') AS bad_chars
FROM li WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.instance_id = li.instance_id AND px.task = li.task)""")
def b6_reject_audit(spark, d):
    """Instances that no template of their task fits, with their out-of-class characters."""
    return EX.rejected(layout_instances(spark, d)).select("task", "instance_id", "bad_chars")


RANGED = [n for n, r in L.RELATIONS.items() if r.layout.lengths]


@register("b7_pattern_bank", sql=f"""{FQ.CELLS},
en AS (SELECT template, unnest(range(shortest, longest + 1)) AS enum_len FROM lay WHERE longest > 0),
tx AS (SELECT v.template, v.format_id, e.enum_len, string_agg(h.text, '' ORDER BY p.pos) AS text FROM fv v JOIN en e ON e.template = v.template
  JOIN parts p ON p.template = v.template AND p.flag % 2 = 0 AND p.item <= e.enum_len LEFT JOIN fc c ON c.template = v.template AND c.format_id = v.format_id AND c.cell = p.cell
  LEFT JOIN choices h ON h.list = p.list AND h.code = coalesce(c.code, 0) WHERE v.valid GROUP BY v.template, v.format_id, e.enum_len HAVING count(*) = count(h.text))
SELECT template, format_id, CAST(enum_len AS INT) AS enum_len, md5('^' || array_to_string(list_transform(string_split(text, '{{}}'), lambda p: CASE WHEN p = '' THEN p
  ELSE '\\Q' || p || '\\E' END), {q('(' + I.FIELD_CLASS + '+)')}) || '$') AS regex_md5 FROM tx""")
def b7_pattern_bank(spark, d):
    """Per valid format of the layouts with an enumeration range, one extraction regex per length in it."""
    x = S.evaluated(FQ.formats(spark, d).where(F.col("template").isin(RANGED)), True)
    low, high = (S.of_layout([(r.layout.lengths or (1, 1))[i] for r in L.RELATIONS.values()]) for i in (0, 1))
    x = x.select("template", "format_id", "number", "cells", F.explode(F.sequence(low, high)).alias("enum_len"))
    x = S.with_text(x, "text", length=F.col("enum_len"), output=False)
    return x.select("template", "format_id", "enum_len", F.md5(I.template_regex(F.col("text"))).alias("regex_md5"))


@register("b8_single_field", views=("instances",), sql="""
SELECT task, instance_id, ord, input AS field_1, answer, CAST(1 AS INT) AS n_fields,
       CASE WHEN ord < 10 THEN 'demo' ELSE 'eval' END AS split
FROM instances""")
def b8_single_field(spark, d):
    """Single-field load - the whole input is the only field, no regex."""
    inst = V.instances(spark, d)
    return inst.select("task", "instance_id", "ord", F.col("input").alias("field_1"), "answer",
                       F.lit(1).alias("n_fields"), I.demo_eval_split(F.col("ord")).alias("split"))


@register("b9_eval_cap", sql=f"""{LAYOUT_SQL},
k AS (SELECT task, instance_id, ord, row_number() OVER (PARTITION BY task ORDER BY ord) AS rn FROM px WHERE ord >= {I.N_DEMOS})
SELECT task, instance_id, CAST(ord AS BIGINT) AS ord FROM k WHERE rn <= {NUM_SAMPLES}""")
def b9_eval_cap(spark, d):
    """Cap on evaluation rows counted over *parsed* rows (num_samples)."""
    ev = EX.extracted(ordered_instances(spark, d).where(F.col("ord") >= I.N_DEMOS))
    return I.first_n_per_group(ev, ["task"], ["ord"], NUM_SAMPLES).select("task", "instance_id", "ord")


@register("b10_training_slice", views=("instances",), sql=f"""
SELECT task, instance_id, ord, input, answer FROM instances
WHERE ord >= {TRAIN_START + 10} AND ord < {TRAIN_START + 10 + TRAIN_SIZE}""")
def b10_training_slice(spark, d):
    """Training slice [start+10, start+10+1000) of each task's permutation (filter only)."""
    lo = TRAIN_START + I.N_DEMOS
    return V.instances(spark, d).where((F.col("ord") >= lo) & (F.col("ord") < lo + TRAIN_SIZE)) \
        .select("task", "instance_id", "ord", "input", "answer")


@register("b11_instance_conversation", views=("instances",), sql="""
SELECT task, instance_id, CAST(0 AS INT) AS turn, 'human' AS speaker, input AS value FROM instances
UNION ALL
SELECT task, instance_id, CAST(1 AS INT) AS turn, 'gpt' AS speaker, answer AS value FROM instances""")
def b11_instance_conversation(spark, d):
    """Instance -> two-turn conversation (human input, gpt answer), long form."""
    inst = V.instances_base(spark, d)
    turns = F.array(F.struct(F.lit(0).alias("turn"), F.lit("human").alias("speaker"), F.col("input").alias("value")),
                    F.struct(F.lit(1).alias("turn"), F.lit("gpt").alias("speaker"), F.col("answer").alias("value")))
    return inst.select("task", "instance_id", F.inline(turns))


MC_SQL = f"""langs AS (SELECT list_sort(list(DISTINCT answer)) AS opts FROM instances),
mc AS (SELECT i.task, i.instance_id, i.input AS question, i.answer AS correct,
              list_filter(l.opts, lambda o: o <> i.answer) AS incorrect, l.opts AS opts
       FROM instances i, langs l),
sh AS (SELECT *, list_transform(list_sort(list_transform(opts, lambda o: {{'k': md5(concat_ws('|', '{OPTION_SEED}', task, CAST(instance_id AS VARCHAR), o)), 'o': o}})), lambda s: s.o) AS shuffled FROM mc)"""


def _mc(spark, d):
    inst = V.instances_base(spark, d)
    opts = inst.agg(F.sort_array(F.collect_set("answer"))).scalar()   # the options: one global scalar subquery
    mc = inst.withColumn("opts", opts).select(
        "task", "instance_id", F.col("input").alias("question"), F.col("answer").alias("correct"),
        F.filter("opts", lambda o: o != F.col("answer")).alias("incorrect"), "opts")
    return I.shuffle_options(mc, ["task", "instance_id"], "opts", "correct", OPTION_SEED)


@register("a4_multiple_choice_records", views=("instances",), sql=f"""
WITH {MC_SQL}
SELECT task, instance_id, correct, array_to_string(incorrect, '|') AS incorrect, CAST(len(incorrect) AS INT) AS n_incorrect FROM mc""")
def a4_multiple_choice_records(spark, d):
    """A4: multiple-choice records (question, correct, incorrect[]); the other languages are the distractors."""
    x = _mc(spark, d)
    return x.select("task", "instance_id", "correct", F.array_join("incorrect", "|").alias("incorrect"),
                    F.size("incorrect").alias("n_incorrect"))


@register("b12_shuffle_options", views=("instances",), sql=f"""
WITH {MC_SQL}
SELECT task, instance_id, array_to_string(shuffled, '|') AS shuffled, CAST(list_position(shuffled, correct) - 1 AS INT) AS correct_idx
FROM sh""")
def b12_shuffle_options(spark, d):
    """Seeded option shuffle per question and the index of the correct option."""
    x = _mc(spark, d)
    return x.select("task", "instance_id", F.array_join("shuffled", "|").alias("shuffled"), "correct_idx")


@register("b13_render_multiple_choice", views=("instances",), sql=f"""
WITH {MC_SQL}
SELECT task, instance_id,
       md5(concat('QUESTION', '::: ', question, chr(10), 'OPTIONS', '::: ',
           array_to_string(list_transform(range(len(shuffled)), lambda i: concat('(', chr(65 + CAST(i AS INT)), ')', shuffled[i + 1])), ' '),
           chr(10), 'ANSWER', '::: ')) AS prompt_md5,
       chr(65 + CAST(list_position(shuffled, correct) - 1 AS INT)) AS correct_item
FROM sh""")
def b13_render_multiple_choice(spark, d):
    """Render question + lettered options + answer cue under one format (upper case, ':::', newline)."""
    x = _mc(spark, d)
    items = F.transform("shuffled", lambda o, i: F.concat(F.lit("("), F.char(F.lit(65) + i), F.lit(")"), o))
    prompt = F.concat(F.upper(F.lit("Question")), F.lit("::: "), F.col("question"), F.lit("\n"),
                      F.upper(F.lit("Options")), F.lit("::: "), F.array_join(items, " "), F.lit("\n"),
                      F.upper(F.lit("Answer")), F.lit("::: "))
    return x.select("task", "instance_id", F.md5(prompt).alias("prompt_md5"),
                    F.char(F.lit(65) + F.col("correct_idx")).alias("correct_item"))


@register("b14_output_classes", views=("instances",), sql="""
SELECT task, array_to_string(list_sort(list(DISTINCT answer)), ',') AS classes, CAST(count(DISTINCT answer) AS INT) AS n_classes,
       count(DISTINCT answer) < 10 AS under_10, count(DISTINCT answer) < 100 AS under_100, count(DISTINCT answer) > 1 AS over_1
FROM instances GROUP BY task""")
def b14_output_classes(spark, d):
    """Output classes = sorted distinct answers per task, with the <10 / <100 / >1 guards."""
    c = SC.output_classes(V.instances_base(spark, d), ["task"])
    n = F.col("n_classes")
    return c.select("task", F.array_join("classes", ",").alias("classes"), n.alias("n_classes"),
                    (n < 10).alias("under_10"), (n < 100).alias("under_100"), (n > 1).alias("over_1"))


@register("b15_one_gold_output", sql="""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN len(outputs) <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad
FROM (SELECT doc_id, list(lang) AS outputs FROM documents GROUP BY doc_id) t""")
def b15_one_gold_output(spark, d):
    """Exactly one gold output per instance (outputs counted per id; any other number is flagged)."""
    outs = table(spark, d, "documents").groupBy("doc_id").agg(F.count("lang").alias("outputs"))
    return outs.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.sum(F.when(F.col("outputs") != 1, 1).otherwise(0)).cast("bigint").alias("n_bad"))


NUMBER_FORMATS_SQL = """nf AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5)) t(number_format))"""


def number_label_sql(idx: str, fmt: str) -> str:
    roman = "['i','ii','iii','iv','v','vi','vii','viii','ix','x','xi','xii','xiii','xiv','xv']"
    return (f"CASE {fmt} WHEN 0 THEN CAST({idx} + 1 AS VARCHAR) WHEN 1 THEN chr(65 + {idx}) WHEN 2 THEN chr(97 + {idx}) "
            f"WHEN 3 THEN chr(8544 + {idx}) WHEN 4 THEN {roman}[{idx} + 1] ELSE upper({roman}[{idx} + 1]) END")


@register("b16_remap_labels", views=("instances",), sql=f"""
WITH cls AS (SELECT task, answer, CAST(row_number() OVER (PARTITION BY task ORDER BY answer) - 1 AS INT) AS idx
             FROM (SELECT DISTINCT task, answer FROM instances) t),
{NUMBER_FORMATS_SQL}
SELECT CAST(nf.number_format AS INT) AS number_format, i.task, i.instance_id, {number_label_sql('cls.idx', 'nf.number_format')} AS label
FROM instances i JOIN cls USING (task, answer) CROSS JOIN nf""")
def b16_remap_labels(spark, d):
    """Original class label -> its label under each enumeration number format."""
    from promptspread.operators.catalogue import number_label
    inst = V.instances_base(spark, d)
    cls = inst.select("task", "answer").distinct()
    from pyspark.sql import Window
    cls = cls.withColumn("idx", (F.row_number().over(Window.partitionBy("task").orderBy("answer")) - 1).cast("int"))
    x = inst.join(cls, ["task", "answer"])
    x = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("number_format"))
    return x.select("number_format", "task", "instance_id", number_label(F.col("idx"), F.col("number_format")).alias("label"))


@register("b17_training_sample", views=("conversation_pairs",), sql=f"""
SELECT conv_id FROM conversation_pairs
ORDER BY md5(concat_ws('|', '{SHUFFLE_SEED}', CAST(conv_id AS VARCHAR))) LIMIT {SAMPLE_N}""")
def b17_training_sample(spark, d):
    """Seeded shuffle of the training conversations, take min(n, size) (global top-n)."""
    c = V.conversation_pairs(spark, d)
    return c.orderBy(seeded_key(SHUFFLE_SEED, F.col("conv_id"))).limit(SAMPLE_N).select("conv_id")


@register("a3_choose_instruction", sql="""
WITH c AS (SELECT source AS task, doc_id, length(text) AS len FROM documents
           WHERE regexp_matches(text, '^[\\p{Lu}\\x{2160}-\\x{216F}\\x{24B6}-\\x{24CF}]')),
r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY len DESC, doc_id) AS rn FROM c)
SELECT task, doc_id AS instruction_id, CAST(len AS INT) AS instruction_length FROM r WHERE rn = 1""")
def a3_choose_instruction(spark, d):
    """A3: per task, the longest candidate text starting upper-case; first (lowest id) wins ties."""
    docs = table(spark, d, "documents").select(F.col("source").alias("task"), "doc_id", "text")
    return I.choose_instruction(docs, ["task"], "text", "doc_id")
