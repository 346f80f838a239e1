"""Operator 4, exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are dealt into blocks and kept inverted: for every dimension (term)
the rows of the block with a weight there.  A query walks its non-zero terms and
scatters ``query weight * posting weight`` into a dense array with a score for
every row of the block; partition selection keeps the block's best k, and a
window over those few rows merges the blocks.  Every candidate is scored.

Both sides are dealt: a pair (candidate block, query block) is one group, with at
most about ``block_rows`` candidates and ``query_rows`` queries, so a group's
size does not grow with the data; the number of groups does.

Defined results: vectors that are null, or hold a null or a non-finite component,
take no part, nor do rows without id.  Vectors of unequal length multiply on
their common dimensions.  A query's own id is no candidate for it.  Repeated
candidate rows each take a rank; repeated query ids search once.  Ties go to the
smaller id.  An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptspread.llm.common import parallelism

SCHEMA = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 1024) -> Column:
    """``floor(scale * x)`` of every component as double; null where the vector can't take part."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _dense(column: pa.Array) -> np.ndarray:
    """Rows of unequal length as one integer matrix, zero-filled."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def accumulate(query: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], scores: np.ndarray) -> np.ndarray:
    """Term at a time: add each non-zero query term's weighted postings into the dense scores."""
    scores[:] = 0
    for term in np.flatnonzero(query[:len(postings)]):
        rows, weights = postings[term]
        scores[rows] += query[term] * weights
    return scores


def best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores among the allowed rows, ties to the smaller id."""
    at = np.flatnonzero(allowed)
    if len(at) > k:
        s = scores[at]
        floor = s[np.argpartition(-s, k - 1)[k - 1]]
        at = at[s >= floor]  # all that tie with the k-th stay until the ids decide
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, vectors = left.column("id").to_numpy(), _dense(left.column("v").combine_chunks())
        q_ids, queries = right.column("id").to_numpy(), _dense(right.column("v").combine_chunks())
        postings = [(rows, vectors[rows, term]) for term in range(vectors.shape[1]) for rows in [np.flatnonzero(vectors[:, term])]]
        scores = np.zeros(len(ids), np.int64)
        out: tuple[list, list, list] = ([], [], [])
        for q_id, query in zip(q_ids, queries):
            top = best(accumulate(query, postings, scores), ids, ids != q_id, k)
            for column, values in zip(out, (np.full(len(top), q_id), ids[top], scores[top])):
                column.append(values)
        flat = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
        return pa.Table.from_arrays(flat, names=["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, is_query: Column, vector: Column, id_: str = "vec_id", k: int = 10,
           block_rows: int = 65536, query_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of integer vectors for every query row."""
    spark = rows.sparkSession
    usable = rows.select(F.col(f"`{id_}`").cast("long").alias("id"), vector.alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    n, n_queries = usable.agg(F.count("*"), F.count(F.when(F.col("q"), 1))).first()
    blocks = max(parallelism(spark), math.ceil(n / block_rows))
    q_blocks = max(1, math.ceil(n_queries / query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # equal ids may be many: the vector takes part in the deal
    candidates = usable.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("c"), every(q_blocks).alias("qb"))
    queries = (usable.where("q").dropDuplicates(["id"])
               .select("id", "v", every(blocks).alias("c"), F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb")))
    found = candidates.groupBy("c", "qb").cogroup(queries.groupBy("c", "qb")).applyInArrow(_search(k), SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
