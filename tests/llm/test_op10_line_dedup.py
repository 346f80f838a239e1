import hashlib
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from promptspread.llm import line_dedup
from promptspread.llm.queries.op10 import report
from tests.llm.helpers import against_oracle, connected, docs, odd_texts


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def edit(rng, text, n):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        if (kind := rng.randrange(3)) == 0 or not out:
            out.insert(at, rng.choice("abcé😀 "))
        elif kind == 1:
            out.pop(min(at, len(out) - 1))
        else:
            out[min(at, len(out) - 1)] = rng.choice("abcé😀 ")
    return "".join(out)


def test_oracle(spark):
    against_oracle(spark, "op10_line_dedup")


def test_banded_distance(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abcé😀 ") for _ in range(rng.randrange(40)))
        rows.append((a, edit(rng, a, rng.randrange(5))))
    df = spark.createDataFrame(rows, "x string, y string")
    tried = df.select("x", "y", *[line_dedup.within(F.col("x"), F.col("y"), k).alias(f"w{k}") for k in (1, 2, 3)],
                      *[(line_dedup.banded_distance(F.col("x"), F.col("y"), k) <= k).alias(f"d{k}") for k in (1, 2, 3)]).collect()
    for r in tried:
        d = distance(r.x, r.y)
        assert all(r[f"{kind}{k}"] == (d <= k) for k in (1, 2, 3) for kind in "wd"), (r, d)


def numbered(rows):
    """Lines of the distinct documents, in order of (null id last, id)."""
    return [(i, t, no, line) for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)) if t is not None for no, line in enumerate(t.split("\n"))]


def kept_of(texts, edges):
    """Near lines in order of their digests: a line near a kept one before it goes."""
    kept = set()
    for t in sorted(texts, key=lambda x: hashlib.md5(x.encode()).hexdigest()):
        if not any(t in e and (e[0] if e[1] == t else e[1]) in kept for e in edges):
            kept.add(t)
    return kept


def links_of(lines):
    texts = sorted({x for x in lines if len(x) >= line_dedup.LEAST})
    return texts, [(a, b) for a, b in itertools.combinations(texts, 2) if abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]


def brute(rows):
    lines = numbered(rows)
    texts, edges = links_of([x[3] for x in lines])
    kept, top = kept_of(texts, edges), connected(texts, edges)
    links = {t: sum(t in e for e in edges) for t in texts}
    many = Counter()
    for i, t in rows:
        for line in (t or "").split("\n") if t is not None else []:
            if line in top:
                many[top[line]] += 1
    seen, first, per = set(), {}, {(i, t): [0, 0, [], []] for i, t in rows}
    for i, t, no, line in lines:
        own = per[i, t]
        own[0] += 1
        if line in top:
            own[1] += links[line]
            first.setdefault(top[line], f"{'' if i is None else i}:{no}")
            own[2] += [no] if line in seen or line not in kept else []
            own[3] += [f"{no}={first[top[line]]}"] if many[top[line]] > 1 else []
            seen.add(line)
    return sorted((str(i), *(lambda p: (p[0], len(p[2]), p[1], ",".join(map(str, p[2])), ",".join(p[3])))(per[i, t])) for i, t in rows)


def test_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcde fgh") for _ in range(rng.randrange(15, 60))) for _ in range(30)]
    rows = [(i, "\n".join(edit(rng, rng.choice(base), rng.randrange(4)) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, "\n\n"), rows[5]] + [r for r in odd_texts() if r[0] not in (0, 7)] + [(200, None)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.n_links, r.dropped, r.classes) for r in report(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_dedup_rewrites_only_what_repeats(spark):
    a, b, c = "this line is long enough to count", "another line that is long enough", "a third line, also quite long here"
    near = b.replace("another", "anothr")
    rows = [(1, f"{a}\n\n{b}"), (2, f"short\n{near}\n{c}\nshort"), (3, f"{a}\nshort"), (4, "short\n\nshort"), (5, None), (6, ""), (None, c)]
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
    one = b in kept_of([b, near], [(b, near)])
    assert out == {1: f"{a}\n\n{b}" if one else f"{a}\n", 2: f"short\n{c}\nshort" if one else f"short\n{near}\n{c}\nshort", 4: "short\n\nshort", 5: None, 6: ""}


def test_long_text_and_empty_table(spark):
    long = "\n".join(hashlib.md5(str(i % 9000).encode()).hexdigest() for i in range(20_000))
    (row,) = report(docs(spark, [(1, long)])).collect()
    assert row.n_lines == 20_000 and row.n_dropped == 11_000
    assert report(docs(spark, [])).count() == 0


def test_dedup_drops_only_direct_neighbours_of_kept_lines(spark):
    line = "this line has the number {} in its middle".format
    chain = [line("000000"), line("000011"), line("001111"), line("111111"), line("111111"), line("999999"), "no"]
    rows = [(1, "\n".join(chain)), (2, line("000001")), (3, line("001119")), (4, line("555555")), (None, line("555556"))]
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows).withColumnRenamed("score", "g_no").withColumnRenamed("Ids", "g_new")).collect()}
    kept = kept_of(*links_of([x for _, t in rows for x in t.split("\n")]))
    want = {i: [x for no, x in enumerate(t.split("\n")) if x == "no" or (x in kept and x not in t.split("\n")[:no])] for i, t in rows}
    assert out == {i: "\n".join(x) for i, x in want.items() if any(len(y) >= line_dedup.LEAST for y in x)}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    digests = {i: hashlib.md5(str(i).encode()).hexdigest() for i in range(1000)}
    edges = spark.createDataFrame([(i, i + 1, digests[i] < digests[i + 1]) for i in range(999)], "a long, b long, ahead boolean")
    rounds = []
    real = line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda df, name, *p: (rounds.append(name), real(df, name, *p))[1])
    gone = {r.a for r in line_dedup.near_kept(edges).collect()}
    kept = set()
    for i in sorted(digests, key=digests.get):
        if i - 1 not in kept and i + 1 not in kept:
            kept.add(i)
    assert gone == set(range(1000)) - kept and len(rounds) <= 12


def test_links_of_windows_for_several_edits(spark):
    rng = random.Random(9)
    base = ["".join(rng.choice("abé😀 ") for _ in range(n)) for n in (6, 7, 9, 14, 21, 22, 27, 28, 29, 36, 44, 61)]
    texts = sorted({edit(rng, x, rng.randrange(5)) for x in base for _ in range(12)})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "a long, line string")
    pairs = {(i, j): d for i, j in itertools.combinations(range(len(texts)), 2) if (d := distance(texts[i], texts[j])) <= 4}
    for edits, least in ((1, 1), (2, 1), (2, 20), (3, 5), (4, 1)):
        got = [(r.a, r.b) for r in line_dedup.line_links(rows, edits, least).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p, d in pairs.items() if d <= edits}, (edits, least)


def test_few_numbers_a_line_are_exchanged(spark):
    rows = spark.createDataFrame([(n, "x" * n) for n in range(20, 84)] * 3, "a long, line string")
    marks = line_dedup.signatures(rows, 2, 20)
    assert {t for _, t in marks.dtypes} == {"bigint"} and marks.count() == 64 * 4 * 10 // 8
    above, exchange, _ = marks._jdf.queryExecution().executedPlan().toString().partition("Exchange")
    assert exchange and "line#" not in above


def test_divided_windows_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 4)
    rng = random.Random(10)
    base = ["".join(rng.choice("abé😀 ") for _ in range(n)) for n in (24, 37, 60)]
    texts = sorted({edit(rng, x, rng.randrange(5)) for x in base for _ in range(20)})
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "a long, line string")
    pairs = {(i, j): d for i, j in itertools.combinations(range(len(texts)), 2) if (d := distance(texts[i], texts[j])) <= 4}
    got = [(r.a, r.b) for r in line_dedup.line_links(rows).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p, d in pairs.items() if d <= 2}


def test_copies_with_many_edits_are_not_all_paired(spark, monkeypatch):
    rng = random.Random(11)
    words = ["".join(rng.sample("abcdefghijklmnop", 8)) for _ in range(40)]
    texts = []
    for _ in range(300):  # two words reversed in each: equal letters, far more than two edits apart
        turned = set(rng.sample(range(40), 2))
        texts.append(" ".join(w[::-1] if i in turned else w for i, w in enumerate(words)))
    texts = list(dict.fromkeys(texts))
    n = len(texts)
    texts += [texts[0] + "x", texts[1][:150] + texts[1][151:]]
    made, real = {}, line_dedup.stored

    def counted(df, name, *partition_by):
        out = real(df, name, *partition_by)
        made[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    rows = spark.createDataFrame(list(enumerate(texts)), "a long, line string")
    assert sorted((r.a, r.b) for r in line_dedup.line_links(rows).collect()) == [(0, n), (1, n + 1)]
    assert made["line_pairs"] < 16 * n  # 16994 for 257 lines if no window is divided
