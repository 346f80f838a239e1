"""Queries D1-D14: prompts over the instances view, training text over conversation pairs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from promptspread.operators import augment as A
from promptspread.operators import catalogue as CAT
from promptspread.operators import format_space as S
from promptspread.operators import prompts as P
from promptspread.operators import splits as SP
from promptspread.operators.scoring import output_classes
from promptspread.plans import format_queries as FQ
from promptspread.plans.registry import register
from promptspread.session import shared_path
from promptspread.sources import views as V
from promptspread.sources.tables import table

LAYOUT = "task155"   # one text field
N_FMT = 3          # formats per task
N_SHOT = 2
VOCABULARY = 4096    # tokens that replacements are drawn from
N_EVAL_FROM = 10      # rows before are demonstrations
N_AUG = 2
AUG_SEED = 23
PCT = 0.1


def q(s: str) -> str:
    return S._q(s)


# ---------------------------------------------------------------- task formats

def task_formats(spark, d, quota=N_FMT):
    """Per task: its first valid formats of the single-field layout, drawn without repetition, with the input template
    (answer hole dropped) and the demonstration template."""
    named = V.instances_base(spark, d).select(F.col("task").alias("name")).distinct().withColumn("template", F.lit(LAYOUT))
    x = S.sampled(named, quota, "tf").withColumn("number", F.lit(S.NAMES.index(LAYOUT)))
    x = S.evaluated(x)
    return x.select(F.col("name").alias("task"), F.col("draw").alias("format_id"), S.rendered(F.col("cells"), output_hole=False).alias("tmpl_in"), S.rendered(F.col("cells")).alias("tmpl_demo"))


TF_SQL = f"""tf AS (WITH {S.relations_sql(only=(LAYOUT,))},
{S.draws_sql("SELECT task, template, mode, range AS format_id FROM (SELECT DISTINCT task FROM instances), lay, range(60)", "tf", "f.task")},
{S.cells_sql('fs', 'task, template, format_id')},
{S.text_sql('task, template, format_id', '(p.flag & 2) = 0', out='tin')}, {S.text_sql('task, template, format_id', out='tdemo')},
ok AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY format_id) AS f_ord FROM fv WHERE valid)
SELECT ok.task, CAST(ok.format_id AS BIGINT) AS format_id, tin.format_text AS tmpl_in, tdemo.format_text AS tmpl_demo
FROM ok JOIN tin USING (task, format_id) JOIN tdemo USING (task, format_id) WHERE f_ord <= {N_FMT})"""


def fill_sql(tmpl: str, fields: str) -> str:
    """DuckDB twin of ``fill_template``: interleave the pieces with the fields."""
    pieces = f"string_split({tmpl}, '{{}}')"
    return (f"({pieces}[1] || array_to_string(list_transform(range(1, len({pieces})), lambda i: "
            f"coalesce(({fields})[i], '') || {pieces}[i + 1]), ''))")


def definition(task):
    return F.concat(F.lit("Identify the language of each "), task, F.lit(" text."))


DEF_SQL = "concat('Identify the language of each ', task, ' text.')"


def demo_blocks(spark, d):
    return _blocks(V.instance_heads(spark, d, N_SHOT)[0], task_formats(spark, d)).select("task", "format_id", "block")


def _blocks(heads, formats):
    """(task, format_id, tmpl_in, block): each format's demonstrations, from rows that hold the tasks' first places."""
    demos = heads.where(F.col("ord") < N_SHOT).select("task", "ord", "input", "answer")
    j = demos.join(formats, "task")
    j = j.withColumn("demo", P.fill_template(F.col("tmpl_demo"), F.array("input", "answer")))
    g = j.groupBy("task", "format_id").agg(F.first("tmpl_in").alias("tmpl_in"), F.sort_array(F.collect_list(F.struct("ord", "demo"))).alias("ds"))
    return g.select("task", "format_id", "tmpl_in", P.demo_block(definition(F.col("task")), F.transform("ds", lambda s: s["demo"])).alias("block"))


def _stored(spark, rows, name):
    """A small table kept in the shared folder, so that it is computed once and the planner knows its size."""
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex}")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


DEMO_SQL = f"""{TF_SQL},
dm AS (SELECT i.task, i.ord, tf.format_id, {fill_sql('tf.tmpl_demo', '[i.input, i.answer]')} AS demo
       FROM instances i JOIN tf USING (task) WHERE i.ord < {N_SHOT}),
blocks AS (SELECT task, format_id, concat({DEF_SQL}, chr(10) || chr(10), string_agg(demo, chr(10) || chr(10) ORDER BY ord)) AS block
           FROM dm GROUP BY task, format_id)"""


def prompts(spark, d, shots=(N_SHOT,)):
    """Full prompts of all evaluation rows, for each number of shots (0: the formatted input alone).

    Only where a task's order is cut matters (demonstrations before, evaluation rows behind), so texts meet their
    task's formats and demonstrations where they are read.
    """
    heads, rest = V.instance_heads(spark, d, max(N_SHOT, N_EVAL_FROM))
    heads = _stored(spark, heads, "heads")   # a few rows a task
    ev = heads.where(F.col("ord") >= N_EVAL_FROM).drop("ord").unionByName(rest)
    # one join by task, against a few rows for each; the planner broadcasts them unless there are very many
    j = ev.join(_stored(spark, _blocks(heads, task_formats(spark, d)), "blocks"), "task")
    filled = P.fill_template(F.col("tmpl_in"), F.array("input"))
    each = F.array(*[F.struct(F.lit(n).alias("n_shot"), P.full_prompt(F.col("block"), filled, n).alias("prompt")) for n in shots])
    return j.select("task", "format_id", "instance_id", "answer", F.explode(each).alias("p")).select("task", "format_id", "instance_id", "answer", "p.prompt", "p.n_shot")


PROMPTS_SQL = f"""{DEMO_SQL},
prompts AS (SELECT i.task, tf.format_id, i.instance_id, i.answer, concat(b.block, chr(10) || chr(10), {fill_sql('tf.tmpl_in', '[i.input]')}) AS prompt
            FROM instances i JOIN tf USING (task) JOIN blocks b ON b.task = i.task AND b.format_id = tf.format_id WHERE i.ord >= {N_EVAL_FROM})"""


@register("d1_fill_template", views=("instances",), sql=f"""
WITH {TF_SQL}
SELECT i.task, tf.format_id, i.instance_id, md5({fill_sql('tf.tmpl_demo', '[i.input, i.answer]')}) AS filled_md5,
       (len(string_split(tf.tmpl_demo, '{{}}')) - 1) <> 2 AS hole_mismatch
FROM instances i JOIN tf USING (task)""")
def d1_fill_template(spark, d):
    """Fill each task format's holes with the instance fields (input, answer); mismatch audit."""
    j = V.instances_base(spark, d).join(task_formats(spark, d), "task")
    fields = F.array("input", "answer")
    return j.select("task", "format_id", "instance_id", F.md5(P.fill_template(F.col("tmpl_demo"), fields)).alias("filled_md5"),
                    P.hole_mismatch(F.col("tmpl_demo"), fields).alias("hole_mismatch"))


@register("d2_demo_block", views=("instances",), sql=f"""
WITH {DEMO_SQL}
SELECT task, format_id, md5(block) AS block_md5, CAST(length(block) AS INT) AS block_len FROM blocks""")
def d2_demo_block(spark, d):
    """Definition + the first n_shot demonstrations rendered in each format (bounded per group)."""
    b = demo_blocks(spark, d)
    return b.select("task", "format_id", F.md5("block").alias("block_md5"), F.length("block").alias("block_len"))


@register("d3_full_prompts", views=("instances",), sql=f"""
WITH {PROMPTS_SQL},
shots AS (SELECT task, format_id, instance_id, {N_SHOT} AS n_shot, prompt FROM prompts
         UNION ALL SELECT i.task, tf.format_id, i.instance_id, 0, {fill_sql('tf.tmpl_in', '[i.input]')} FROM instances i JOIN tf USING (task) WHERE i.ord >= {N_EVAL_FROM})
SELECT task, format_id, instance_id, CAST(n_shot AS INT) AS n_shot, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INT) AS prompt_len FROM shots""")
def d3_full_prompts(spark, d):
    """D3: full prompts of all evaluation rows: demo block + formatted input, and zero-shot, where the input stands alone."""
    p = prompts(spark, d, shots=(N_SHOT, 0))
    return p.select("task", "format_id", "instance_id", "n_shot", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("prompt_len"))


@register("d4_prompt_answers", views=("instances",), sql=f"""
WITH {PROMPTS_SQL},
cls AS (SELECT DISTINCT task, answer AS class FROM instances)
SELECT p.task, p.format_id, p.instance_id, c.class, md5(concat(p.prompt, c.class)) AS text_md5
FROM prompts p JOIN cls c USING (task)""")
def d4_prompt_answers(spark, d):
    """Each prompt followed by every candidate class of its task (classes per task are bounded)."""
    p = prompts(spark, d)
    cls = output_classes(V.instances_base(spark, d), ["task"]).select("task", F.explode("classes").alias("class"))
    return p.join(cls, "task").select("task", "format_id", "instance_id", "class",
                                       F.md5(F.concat("prompt", "class")).alias("text_md5"))


@register("d5_prompt_messages", views=("instances",), sql=f"""
WITH {PROMPTS_SQL},
parts AS (SELECT *, string_split(prompt, chr(10) || chr(10)) AS ps FROM prompts)
SELECT task, format_id, instance_id, md5(ps[1] || {q(P.SYSTEM_SUFFIX)}) AS system_md5,
       md5(array_to_string(ps[2:len(ps) - 1], chr(10) || chr(10)) || chr(10) || chr(10) || ps[len(ps)]) AS user_md5,
       CAST(len(ps) AS INT) AS n_parts
FROM parts""")
def d5_prompt_messages(spark, d):
    """Prompt -> [system: definition + fixed suffix, user: demonstrations + test input]."""
    p = prompts(spark, d)
    m = P.to_messages(F.col("prompt"))
    return p.select("task", "format_id", "instance_id", F.md5(m[0]["content"]).alias("system_md5"),
                    F.md5(m[1]["content"]).alias("user_md5"), F.size(F.split("prompt", "\n\n", -1)).alias("n_parts"))


def _mix_sql(numbers: str) -> str:
    for _ in range(2):
        numbers = f"list_transform({numbers}, lambda x: (xor(x, x >> 16) * 73244475) % 4294967296)"
    return f"list_transform({numbers}, lambda x: xor(x, x >> 16))"


def _numbers_sql(key: str) -> str:
    start = f"CAST('0x' || substr(md5({key}), 1, 8) AS BIGINT)"
    return _mix_sql(f"list_transform(range(0, len(toks)), lambda i: ({start} + i * 2654435761) % 4294967296)")


@register("d6_perturbed_copies", views=("instances",), sql=f"""
WITH {PROMPTS_SQL},
voc AS (SELECT list(token ORDER BY md5(token), token) AS words FROM (
  SELECT token FROM (SELECT DISTINCT unnest(string_split(input, ' ')) AS token FROM instances) ORDER BY md5(token), token LIMIT {VOCABULARY})),
c AS (SELECT p.*, k.copy_id, string_split(prompt, ' ') AS toks,
             concat_ws('|', '{AUG_SEED}', CAST(p.format_id AS VARCHAR), CAST(p.instance_id AS VARCHAR), CAST(k.copy_id AS VARCHAR)) AS key
      FROM prompts p, (SELECT 1 AS copy_id UNION ALL SELECT 2) k),
s AS (SELECT * EXCLUDE (prompt), CAST(floor(len(toks) * {PCT}) AS INT) AS k, {_numbers_sql('key')} AS hs, {_numbers_sql("key || '|v'")} AS vs FROM c),
r AS (SELECT *, CASE WHEN k > 0 THEN list_sort(hs)[k] ELSE -1 END AS thr FROM s)
SELECT task, format_id, instance_id, CAST(copy_id AS INT) AS copy_id, CAST(len(toks) AS INT) AS n_tokens, k AS n_replaced,
       md5(array_to_string(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN hs[i] <= thr THEN words[vs[i] % len(words) + 1] ELSE toks[i] END), ' ')) AS text_md5
FROM r, voc""")
def d6_perturbed_copies(spark, d):
    """Two perturbed copies of every evaluation prompt, exactly floor(n * 10%) tokens replaced by vocabulary tokens."""
    words = P.vocabulary(V.instances_base(spark, d), "input", VOCABULARY)
    p = prompts(spark, d).withColumn("seed", F.lit(str(AUG_SEED)))
    x = P.with_perturbed(p, "prompt", ["seed", "format_id", "instance_id"], 2, PCT, words, keep=["task", "format_id", "instance_id"])
    return x.select("task", "format_id", "instance_id", "copy_id", "n_tokens", "n_replaced", F.md5("perturbed").alias("text_md5"))


# ------------------------------------------------------------ training text

@register("d7_conversation_filter", views=("conversation_pairs",), sql="""
SELECT c.conv_id, c.conv_id IN (SELECT conv_id FROM conversation_pairs) AS keep
FROM (SELECT DISTINCT conv_id FROM conversations) c""")
def d7_conversation_filter(spark, d):
    """Keep conversations whose first two user/assistant turns go user -> assistant."""
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    keep = V.conversation_pairs(spark, d).select("conv_id", F.lit(True).alias("keep"))
    return ids.join(keep, "conv_id", "left").select("conv_id", F.coalesce("keep", F.lit(False)).alias("keep"))


def h_sql(key: str, tag: str) -> str:
    return f"CAST(('0x' || substr(md5(concat_ws('|', {key}, '{tag}')), 1, 8)) AS BIGINT)"


def pick_sql(values, key, tag):
    return f"([{', '.join(q(v) for v in values)}])[CAST({h_sql(key, tag)} % {len(values)} AS INTEGER) + 1]"


def draw_sql(key: str, spaces=CAT.SPACES, seps=CAT.SEPARATORS) -> dict[str, str]:
    fn_idx = f"CAST({h_sql(key, 'fn')} % 4 AS INTEGER)"
    sep = pick_sql(seps, key, "sep")
    space = f"CASE WHEN strpos({sep}, chr(10)) > 0 THEN {pick_sql([s for s in spaces if chr(10) in s], key, 'space')} ELSE {pick_sql(spaces, key, 'space')} END"
    firsts = [x for w in A.FIRST_VERBALIZERS for x in A._case_variants(w)]
    seconds = [x for w in A.SECOND_VERBALIZERS for x in A._case_variants(w)]
    first = f"([{', '.join(q(v) for v in firsts)}])[CAST({h_sql(key, 'v1')} % 3 AS INTEGER) * 4 + {fn_idx} + 1]"
    second = f"([{', '.join(q(v) for v in seconds)}])[CAST({h_sql(key, 'v2')} % 3 AS INTEGER) * 4 + {fn_idx} + 1]"
    fn_name = f"([{', '.join(q(v) for v in CAT.CASE_FNS)}])[{fn_idx} + 1]"
    return {"fn_name": fn_name, "separator": sep, "space": space, "first": first, "second": second}


def aug_sql(test_keys_sql: str | None, spaces=CAT.SPACES, seps=CAT.SEPARATORS) -> str:
    key = f"concat_ws('|', '{AUG_SEED}', CAST(conv_id AS VARCHAR), CAST(aug_id AS VARCHAR), CAST(draw AS VARCHAR))"
    dr = draw_sql(key, spaces, seps)
    anti = f"WHERE fmt_key NOT IN (SELECT fmt_key FROM ({test_keys_sql}) tk)" if test_keys_sql else ""
    return f"""ids AS (SELECT conv_id, a.aug_id, r.draw FROM conversation_pairs, range(0, {N_AUG}) a(aug_id), range(0, 16) r(draw)),
cand AS (SELECT conv_id, aug_id, draw, {dr['first']} AS first, {dr['second']} AS second, {dr['separator']} AS separator,
                {dr['space']} AS space, {dr['fn_name']} AS fn_name FROM ids),
ck AS (SELECT *, concat(space, separator, fn_name) AS fmt_key FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, aug_id ORDER BY draw) AS rn FROM ck {anti}) z WHERE rn = 1),
aug AS (SELECT b.conv_id, b.aug_id, b.draw, b.fmt_key, b.space, b.separator,
               concat('{P.INSTRUCTION_TAG}', b.first, b.separator, c.user_text, b.space, b.second, b.separator, '{P.RESPONSE_TAG}', c.assistant_text) AS text
        FROM best b JOIN conversation_pairs c USING (conv_id))"""


# the two modes that training texts are drawn in: whole catalogues, and the ones without the test split's values
TRAINING = {"random": (CAT.SPACES, CAT.SEPARATORS),
            "compositional_separator_space": tuple(CAT.TRAIN_MODES["compositional_separator_space"][k] for k in ("chosen_space", "chosen_separator"))}
D8_SQL = "\nUNION ALL\n".join(f"""(WITH {aug_sql(None, *lists)}
SELECT '{mode}' AS catalogue, conv_id, CAST(aug_id AS INT) AS aug_id, md5(text) AS text_md5, md5(fmt_key) AS key_md5 FROM aug)""" for mode, lists in TRAINING.items())


@register("d8_augmented_text", views=("conversation_pairs",), sql=f"SELECT * FROM ({D8_SQL})")
def d8_augmented_text(spark, d):
    """N_AUG randomly formatted training texts per conversation (random case, separator, space, verbalizers) from the
    whole catalogues and from the compositional split's training catalogues."""
    pairs = V.conversation_pairs(spark, d)
    parts = [A.augment(pairs, N_AUG, AUG_SEED, None, *lists).withColumn("catalogue", F.lit(mode)) for mode, lists in TRAINING.items()]
    a = reduce(lambda x, y: x.unionByName(y), parts)
    return a.select("catalogue", "conv_id", F.col("aug_id").cast("int"), F.md5("text").alias("text_md5"), F.md5("fmt_key").alias("key_md5"))


@register("d9_newline_coupling", views=("conversation_pairs",), sql=f"""
WITH {aug_sql(None)}
SELECT strpos(separator, chr(10)) > 0 AS sep_has_newline, strpos(space, chr(10)) > 0 AS space_has_newline,
       CAST(count(*) AS BIGINT) AS n FROM aug GROUP BY ALL""")
def d9_newline_coupling(spark, d):
    """A newline separator always comes with a newline space (counts per combination)."""
    a = A.augment(V.conversation_pairs(spark, d), N_AUG, AUG_SEED, None)
    return a.groupBy((F.instr("separator", "\n") > 0).alias("sep_has_newline"), (F.instr("space", "\n") > 0).alias("space_has_newline")) \
        .agg(F.count(F.lit(1)).alias("n"))


def test_keys(spark, d):
    """Essential keys (space, separator, case fn) of the random split's test formats on the single-field layout."""
    one = spark.createDataFrame([(f"{LAYOUT}_", LAYOUT)], "task string, template string")
    tasks = FQ.task_layouts(spark, FQ.task_files(spark, d)).unionByName(one)
    s = SP.build(tasks, ("random",), FQ.N_TEST, "split").where(F.col("task") == f"{LAYOUT}_")
    return s.select(S.essential_key(F.col("codes")).alias("fmt_key"))


def test_keys_sql() -> str:
    body = SP.build_sql(("random",), FQ.N_TEST, "split", f"{S.relations_sql()}, {FQ.TASKS_SQL}").replace("tl AS (", f"tl AS (SELECT '{LAYOUT}_' AS task, '{LAYOUT}' AS template UNION ALL ", 1)
    # slots of the layout in order: space, case function, separator
    return f"""{body} SELECT concat(string_split(vals, chr(31))[1], string_split(vals, chr(31))[3], string_split(vals, chr(31))[2]) AS fmt_key FROM split WHERE task = '{LAYOUT}_'"""


@register("d10_leakage_guard", views=("conversation_pairs",), sql=f"""
WITH {aug_sql(test_keys_sql())}
SELECT conv_id, CAST(aug_id AS INT) AS aug_id, CAST(draw AS INT) AS draw, md5(fmt_key) AS key_md5,
       fmt_key IN (SELECT fmt_key FROM ({test_keys_sql()}) t) AS leaked
FROM aug""")
def d10_leakage_guard(spark, d):
    """Augmented texts whose (space, separator, case) key is never a test-format key."""
    tk = test_keys(spark, d)
    a = A.augment(V.conversation_pairs(spark, d), N_AUG, AUG_SEED, tk)
    leaked = tk.select("fmt_key", F.lit(True).alias("leaked")).distinct()
    return a.join(F.broadcast(leaked), "fmt_key", "left").select(
        "conv_id", F.col("aug_id").cast("int"), F.col("draw").cast("int"), F.md5("fmt_key").alias("key_md5"),
        F.coalesce("leaked", F.lit(False)).alias("leaked"))


@register("d11_default_text", views=("conversation_pairs",), sql=f"""
SELECT conv_id, md5(concat('{P.INSTRUCTION_TAG}Question: ', user_text, chr(10) || 'Answer: {P.RESPONSE_TAG}', assistant_text)) AS text_md5
FROM conversation_pairs""")
def d11_default_text(spark, d):
    """The default-format training text."""
    c = V.conversation_pairs(spark, d)
    return c.select("conv_id", F.md5(A.default_text(F.col("user_text"), F.col("assistant_text"))).alias("text_md5"))


def _consistency(spark, d):
    c = V.conversation_pairs(spark, d)
    aug = A.augment(c, N_AUG, AUG_SEED, None).select("conv_id", "aug_id", F.lit("perturbed").alias("kind"), "text")
    ids = c.select("conv_id", "user_text", "assistant_text", F.explode(F.sequence(F.lit(0), F.lit(N_AUG - 1))).alias("aug_id"))
    dflt = ids.select("conv_id", "aug_id", F.lit("clean").alias("kind"),
                      A.default_text(F.col("user_text"), F.col("assistant_text")).alias("text"))
    return dflt.unionByName(aug)


CONS_SQL = f"""{aug_sql(None)},
cons AS (SELECT conv_id, aug_id, 'perturbed' AS kind, text FROM aug
         UNION ALL
         SELECT conv_id, a.aug_id, 'clean' AS kind,
                concat('{P.INSTRUCTION_TAG}Question: ', user_text, chr(10) || 'Answer: {P.RESPONSE_TAG}', assistant_text) AS text
         FROM conversation_pairs, range(0, {N_AUG}) a(aug_id))"""


@register("d12_consistency_pairs", views=("conversation_pairs",), sql=f"""
WITH {CONS_SQL}
SELECT conv_id, CAST(aug_id AS INT) AS aug_id, kind, md5(text) AS text_md5 FROM cons""")
def d12_consistency_pairs(spark, d):
    """N augmentations per conversation; consistency mode adds the default text per augmentation."""
    x = _consistency(spark, d)
    return x.select("conv_id", F.col("aug_id").cast("int"), "kind", F.md5("text").alias("text_md5"))


@register("d13_clean_perturbed_pairing", views=("conversation_pairs",), sql=f"""
WITH {CONS_SQL}
SELECT conv_id, CAST(aug_id AS INT) AS aug_id, md5(max(CASE WHEN kind = 'clean' THEN text END)) AS clean_md5,
       md5(max(CASE WHEN kind = 'perturbed' THEN text END)) AS perturbed_md5
FROM cons GROUP BY conv_id, aug_id""")
def d13_clean_perturbed_pairing(spark, d):
    """Pair clean and perturbed texts by a stable pair id (not by row parity)."""
    x = _consistency(spark, d)
    g = x.groupBy("conv_id", "aug_id").agg(F.max(F.when(F.col("kind") == "clean", F.col("text"))).alias("clean"),
                                          F.max(F.when(F.col("kind") == "perturbed", F.col("text"))).alias("perturbed"))
    return g.select("conv_id", F.col("aug_id").cast("int"), F.md5("clean").alias("clean_md5"), F.md5("perturbed").alias("perturbed_md5"))


@register("d14_prompt_label_split", views=("conversation_pairs",), sql=f"""
WITH {aug_sql(None)}
SELECT conv_id, CAST(aug_id AS INT) AS aug_id,
       md5(replace(string_split(text, '{P.RESPONSE_TAG}')[1], '{P.INSTRUCTION_TAG}', '')) AS prompt_md5,
       md5(string_split(text, '{P.RESPONSE_TAG}')[2]) AS label_md5
FROM aug""")
def d14_prompt_label_split(spark, d):
    """Split the training text at the response tag into prompt (instruction tag dropped) and label."""
    a = A.augment(V.conversation_pairs(spark, d), N_AUG, AUG_SEED, None)
    prompt, label = A.split_prompt_label(F.col("text"))
    return a.select("conv_id", F.col("aug_id").cast("int"), F.md5(prompt).alias("prompt_md5"), F.md5(label).alias("label_md5"))
