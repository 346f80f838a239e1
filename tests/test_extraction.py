"""Field extraction by the layouts' own templates, against Python's own regular expressions."""

import random
import re

from pyspark.sql import functions as F

from promptspread.operators import extraction as EX
from promptspread.operators import format_space as S
from promptspread.operators.instances import FIELD_CLASS

PY_CLASS = "[" + re.sub(r"(?<!\\)\[", r"\\[", FIELD_CLASS[1:-1]) + "]"


def plain(name, text):
    """The longest template whose regular expression matches, and its groups."""
    for length, template in EX.bank()[S.NAMES.index(name)]:
        pattern = f"({PY_CLASS}+)".join(re.escape(p) for p in template.split("{}"))
        if text is not None and (m := re.fullmatch(pattern, text)):
            return length, list(m.groups())
    return None


def check(spark, cases):
    df = spark.createDataFrame([(i, S.NAMES.index(n), t) for i, (n, t) in enumerate(cases)], "id int, number int, input string")
    got = {r.id: r.parsed for r in EX.parsed(df).collect()}
    assert len(got) == len(cases)
    for i, (name, text) in enumerate(cases):
        assert (None if got[i] is None else (got[i].length, list(got[i].fields))) == plain(name, text), (name, text)
    return [g is not None for _, g in sorted(got.items())]


def test_own_texts_with_literal_expectations(spark):
    cases = [("task1661", "Passage: a b\nQuestion: c?"), ("task1661", "Passage: a\nQuestion: b\nQuestion: c"), ("task1661", "Passage: a Question: c"), ("task1661", None), ("task1661", ""),
             ("task1661", "Passage: \nQuestion: x"), ("task1661", "Passage: a\nQuestion: 日"), ("task118", "how many\n(A)1 (B)2 (C)3 (D)4 (E)5"), ("task1661", "Passage: a\nQuestion: b ")]
    fits = check(spark, cases)
    assert fits == [True, True, False, False, False, False, False, True, False]
    df = spark.createDataFrame([(S.NAMES.index("task1661"), cases[1][1])], "number int, input string")
    # the first hole is greedy: the last question is the second field
    assert list(EX.extracted(df).first().fields) == ["a\nQuestion: b", "c"]


def test_longest_enumeration_first(spark):
    texts = ["Passage: Fact 1- {} Fact 2- {} Question: {} Answer: {}", "Passage: Fact 1- {} Fact 2- {} Fact 3- {} Question: {} Answer: {}"]
    cases = [("task084", t.replace("{}", f)) for t in texts for f in ("x y", "no Fact 3- here", "Fact 9- ", "Question: Answer: z")]
    check(spark, cases)
    df = spark.createDataFrame([(S.NAMES.index("task084"), cases[4][1]), (S.NAMES.index("task084"), cases[1][1])], "number int, input string")
    assert [r.enum_len for r in EX.extracted(df).collect()] == [3, 3]   # a field that holds an item is read as one


def test_random_texts_of_all_layouts(spark):
    rng = random.Random(3)
    cases = []
    for name, templates in zip(S.NAMES, EX.bank()):
        pieces = sorted({p for _, t in templates for p in t.split("{}") if p}) + ["word", "é", "\n", " ", ": ", "{}", "日"]
        for _ in range(12):
            _, template = rng.choice(templates)
            fields = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 4))) or rng.choice(["a", ""]) for _ in range(template.count("{}"))]
            parts = template.split("{}")
            text = parts[0] + "".join(f + p for f, p in zip(fields, parts[1:]))
            cases += [(name, text), (name, text.replace(": ", ":", 1)), (name, text + rng.choice(pieces))]
    fits = check(spark, cases)
    assert 200 < sum(fits) < len(fits) - 200


def test_rejects_and_a_long_text(spark):
    long = "Sentence: " + "some words, again. " * 20_000
    df = spark.createDataFrame([(1, S.NAMES.index("task155"), long), (2, S.NAMES.index("task155"), "Sentence: b 日本 a 日"), (3, S.NAMES.index("task155"), "Sentence b"), (4, S.NAMES.index("task155"), None)],
                               "id int, number int, input string")
    assert [(r.id, len(r.fields[0])) for r in EX.extracted(df).collect()] == [(1, 19 * 20_000)]
    assert [(r.id, r.bad_chars) for r in EX.rejected(df).orderBy("id").collect()] == [(2, "日本"), (3, ""), (4, None)]
    assert EX.extracted(df.limit(0)).count() == 0 and EX.rejected(df.where(F.lit(False))).count() == 0
