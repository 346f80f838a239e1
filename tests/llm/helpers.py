"""Small inputs and plain-Python references shared by the tests of the training-data operators."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, Ids string"


def docs(spark, texts, lang="en", source="s"):
    """Documents with two extra columns whose names clash with operators' outputs."""
    rows = [(i, t, lang, source, None if t is None else len(t), "kept?", "clash") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    """Nulls, empty and blank texts, repeated rows, ties, null ids, non-ASCII and one very long text."""
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma's", "delta.", "é", "😀", "1234", "中文", "x\ty"]
    long = " ".join(rng.choice(vocabulary) for _ in range(60_000))
    return [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (4, "one"), (4, "one"), (5, "Alpha beta gamma delta eps zeta"),
            (6, "alpha beta GAMMA delta eps zeta"), (None, "no id here at all, none"), (None, None), (7, long), (8, "é😀中文 'll <|endoftext|> x")]


def shingle_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def connected(nodes, edges):
    """Smallest node of every node's component."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def against_oracle(spark, name):
    """The registered query equals its DuckDB oracle on the smallest tables."""
    import duckdb

    from promptspread.llm.queries import ORACLES, QUERIES
    from promptspread.sources.tables import TABLES
    from tests.conftest import SF_SMALL
    from tools.oracle_check import rows_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    ours = QUERIES[name](spark, SF_SMALL)
    theirs = con.execute(ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    assert rows_of(ours.columns, [tuple(r) for r in ours.collect()]) == rows_of(columns, theirs.fetchall())
