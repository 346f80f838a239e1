import random
from collections import defaultdict

from promptspread.llm import chat
from promptspread.llm.queries.op6 import conversation_digests
from tests.llm.helpers import against_oracle

SCHEMA = "conv_id long, turn long, role string, text string, path string"


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            odd = c > 40
            rows.append((None if c == 7 else c, t, rng.choice(["user", "assistant", "a\\\nb", None]) if odd else ["user", "assistant"][t % 2],
                         "first" if t == 0 else rng.choice(["x", "y<|im_end|>", "\\<\\|n\\n\n", None, ""]), "clash"))
    return rows + [(50, None, "user", "null turn", "clash"), (51, 0, "user", "same", "clash"), (51, 0, "user", "same", "clash"), (52, 0, "assistant", "long " * 50_000, "clash")]


def test_oracle(spark):
    against_oracle(spark, "op6_chat_tree")


def test_tree_against_brute_force(spark):
    rows = conversations()
    nodes_df, links = chat.tree(chat.turns(spark.createDataFrame(rows, SCHEMA)))
    nodes = sorted((r.asDict(True) for r in nodes_df.collect()), key=lambda r: r["start"])
    by = {tuple(r["path"].values()): r for r in nodes}
    conv = defaultdict(list)
    for c, t, role, text, _ in rows:
        conv[c].append((t is not None, t or 0, role or "", text or ""))
    paths = {tuple(x[2:] for x in sorted(v)[:i + 1]) for v in conv.values() for i in range(len(v))}
    assert len(nodes) == len(paths)  # shared turns once
    at, stack = 0, []
    for r in nodes:
        assert r["start"] == at
        at = r["end"]
        above, p = [], r["parent"]
        while p:
            q = by[tuple(p.values())]
            above.append((q["start"], q["end"]))
            p = q["parent"]
        merged = []
        for a, b in sorted(above):
            if merged and merged[-1][1] == a:
                merged[-1] = (merged[-1][0], b)
            else:
                merged.append((a, b))
        assert [(x["start"], x["end"]) for x in r["attends"]] == merged and r["position"] == sum(b - a for a, b in above)
        if r["parent"] is None:
            stack = []
        else:  # depth first: the parent is still open
            while stack and stack[-1] != tuple(r["parent"].values()):
                stack.pop()
            assert stack
        stack.append(tuple(r["path"].values()))
    back = defaultdict(list)
    for r in chat.read_back(nodes_df, links).collect():
        back[r.conv_id].append((r.depth, r.role, r.text, r.loss_text))
    for c, turns in conv.items():
        assert [(b[1], b[2]) for b in sorted(back[c])] == [t[2:] for t in sorted(turns)]
        assert all(b[3] == (b[2] if b[1] == "assistant" else None) for b in back[c])


def test_empty(spark):
    assert conversation_digests(spark.createDataFrame([], SCHEMA)).count() == 0
