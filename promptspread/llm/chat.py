"""Operator 6, chat formatting as a prefix tree.

Conversations that share their first turns share those turns' tokens: a node of
the tree is a distinct sequence of turns, every node's formatted text is emitted
once, and nodes lie depth first, one tree after another, on one axis of tokens
(here: code points).  Each node carries

* ``start``/``end`` on that axis and the loss interval of an assistant's text;
* ``position``: the position id of its first token, counted along its own path;
* ``attends``: the ancestors' intervals a token of the node attends to besides
  its own node's earlier tokens, with neighbouring intervals merged.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line break becomes
``\\n``), so no control string can arise from a text and every text can be read
back.

How: a turn's node id is the running exclusive-or of the hashes of (turn number,
role, text) along its conversation, 128 bits.  Depth-first order needs no
recursion: a node sorts by the list of branchings above it - (depth, branch) for
each ancestor or self that has a sibling - and then by depth.  Sorted nodes are
dealt by range, summed per range and shifted by the sums before.

Defined results: rows are ordered by turn, then role and text (null first); null
roles and texts count as empty; rows without conv_id form one conversation;
repeated rows are turns of their own.  Empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.llm.common import parallelism, stored

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LOSS_ROLE = "assistant"


def escape(text: Column, line_breaks: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if line_breaks else out


def unescape(text: Column, line_breaks: bool = False) -> Column:
    """Backwards: every doubled backslash first becomes a backslash and a NUL, a pair that escaped text doesn't hold."""
    kept = F.replace(text, F.lit("\\\\"), F.lit("\\\0"))
    kept = F.replace(kept, F.lit("<\\|"), F.lit("<|"))
    kept = F.replace(kept, F.lit("\\n"), F.lit("\n")) if line_breaks else kept
    return F.replace(kept, F.lit("\\\0"), F.lit("\\"))


def turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, role, text, path): every turn with its place and the two halves of its node id."""
    rows = df.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("depth", F.row_number().over(order))
    along = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    halves = [F.expr(f"bit_xor(xxhash64({seed}, depth, role, text))").over(along) for seed in (1, 2)]
    return placed.select("conv_id", "depth", "role", "text", F.struct(halves[0].alias("a"), halves[1].alias("b")).alias("path"))


def tree(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of :func:`turns`: nodes as described above; links (conv_id, depth, path) lead to them."""
    spark = t.sparkSession
    formatted = F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE))
    conv = Window.partitionBy("conv_id").orderBy("depth")
    along = conv.rowsBetween(Window.unboundedPreceding, -1)
    chain = (t.withColumn("formatted", formatted).withColumn("size", F.length("formatted"))
             .withColumn("parent", F.lag("path").over(conv)).withColumn("root", F.first("path").over(conv))
             .withColumn("position", F.coalesce(F.sum("size").over(along), F.lit(0)))
             .select("conv_id", "depth", "role", "formatted", "size", "path", "parent", "root", "position"))
    links = stored(chain, "chat_turns")
    # nodes whose parent has other children: there the depth-first order branches
    nodes = links.where("parent IS NOT NULL").select("path", "parent").distinct()
    forking = nodes.groupBy("parent").agg(F.count("*").alias("children")).where("children > 1").select("parent")
    branch = stored(nodes.join(forking, "parent", "left_semi").select("path"), "chat_branches")
    marked = links.join(branch.withColumn("forks", F.lit(True)), "path", "left")
    upto = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fork = F.when(F.col("forks"), F.struct("depth", "path"))
    keyed = marked.withColumn("forks_above", F.collect_list(fork).over(upto))
    one = keyed.groupBy("path").agg(*[F.first(c).alias(c) for c in ("depth", "role", "formatted", "size", "parent", "root", "position", "forks_above")])
    # depth-first axis: ranges of the order, summed and shifted
    sorted_ = one.repartitionByRange(parallelism(spark), "root", "forks_above", "depth").withColumn("range", F.spark_partition_id())
    within = Window.partitionBy("range").orderBy("root", "forks_above", "depth").rowsBetween(Window.unboundedPreceding, -1)
    local = stored(sorted_.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0))), "chat_order")
    sums = local.groupBy("range").agg(F.sum("size").alias("s"))
    shift = sums.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    start = F.col("shift") + F.col("local")
    placed = local.join(F.broadcast(shift), "range").select(  # one row per range
        "path", "depth", "role", "formatted", "size", "parent", "root", "position", start.alias("start"), (start + F.col("size")).alias("end"))
    placed = stored(placed, "chat_placed")
    # ancestors' intervals, gathered along one conversation through each node
    route = links.select("conv_id", "depth", "path").join(placed.select("path", "start", "end"), "path")
    run = route.withColumn("last_end", F.lag("end").over(conv)).withColumn("jump", F.col("last_end").isNull() | (F.col("start") != F.col("last_end")))
    run = run.withColumn("run_start", F.last(F.when(F.col("jump"), F.col("start")), True).over(upto))
    run = run.withColumn("last_run", F.lag("run_start").over(conv))
    closed = F.collect_list(F.when(F.col("jump") & F.col("last_end").isNotNull(), F.struct(F.col("last_run").alias("start"), F.col("last_end").alias("end")))).over(upto)
    open_ = F.when(~F.col("jump"), F.array(F.struct(F.col("run_start").alias("start"), F.col("last_end").alias("end")))).otherwise(
        F.expr("array()").cast("array<struct<start:bigint,end:bigint>>"))
    attends = run.select("path", F.concat(closed, open_).alias("attends")).groupBy("path").agg(F.first("attends").alias("attends"))
    text_from = F.col("start") + F.locate(MIDDLE, F.col("formatted"))
    loss = F.when(F.col("role") == LOSS_ROLE, F.struct(text_from.alias("start"), (F.col("end") - len(CLOSE)).alias("end")))
    return placed.join(attends, "path").withColumn("loss", loss), links.select("conv_id", "depth", "path")


def read_back(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text, loss_text, size) of every turn, parsed from the emitted tokens and the loss intervals alone."""
    parts = nodes.select("path", "size", "formatted", (F.col("loss.start") - F.col("start")).alias("from"), (F.col("loss.end") - F.col("loss.start")).alias("chars"))
    f = F.col("formatted")
    body = F.substring(f, len(OPEN) + 1, F.length(f) - len(OPEN) - len(CLOSE))
    cut = F.locate(MIDDLE, body)
    parsed = parts.select("path", "size", unescape(F.substring(body, F.lit(1), cut - 1), True).alias("role"),
                          unescape(F.substring(body, cut + 1, F.length(body))).alias("text"),
                          F.when(F.col("from").isNotNull(), unescape(F.substring(f, F.col("from") + 1, F.col("chars")))).alias("loss_text"))
    return links.join(parsed, "path").select("conv_id", "depth", "role", "text", "loss_text", "size")
