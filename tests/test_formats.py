"""Format space: layouts, slots, validity, rendering, draws, neighbours and splits against hand-written Python."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from promptspread.operators import format_space as S
from promptspread.operators import layouts as L
from promptspread.operators import neighbours as N
from promptspread.operators import splits as SP
from promptspread.operators.catalogue import CASE_FNS, SEPARATORS, SPACES, TEXT_OPTION_GAPS, WRAPPERS


def kinds(name):
    return [s[0] for s in L.RELATIONS[name].slots]


def codes(name, *idx):
    """Catalogue indices of a layout's slots as codes."""
    return [L.OFFSET[k] + i for k, i in zip(kinds(name), idx, strict=True)]


def rows(spark, name, assignments):
    df = spark.createDataFrame([(i, S.NAMES.index(name), a) for i, a in enumerate(assignments)], "id int, number int, codes array<int>")
    out = S.evaluated(df).withColumn("text", S.rendered(F.col("cells"))).orderBy("id").collect()
    return out


def test_all_layouts_and_their_tasks():
    assert len(L.LAYOUTS) == 39 and sum(len(x.tasks) for x in L.LAYOUTS) == 82
    assert len({t for x in L.LAYOUTS for t in x.tasks}) == 82
    nodes = L.RELATIONS["task1297"].nodes
    inner = next(n for n in nodes if n[0] == 2)
    assert [n[4] for n in nodes if inner[1] < n[1] and n[2] <= inner[2]] == ["Question", ""]   # inside the inner spacing node


def test_slot_sequence_of_reference_task():
    assert kinds("task1297") == ["chosen_space", "chosen_item_wrapper", "chosen_number_format", "chosen_space",
                                 "chosen_separator", "chosen_separator_text_and_option", "chosen_space", "chosen_space",
                                 "chosen_item_wrapper", "chosen_number_format", "chosen_space", "chosen_separator",
                                 "text_descriptor_fn", "chosen_separator"]
    assert S.sizes("task1297")[0] == 73383542784000


# each layout kind's own text, as the tasks print it
DEFAULTS = {
    "task1661": "Passage: {}\nQuestion: {}\nAnswer: {}",
    "task1587": "Abstract: {}. Title: {}. Answer: {}",
    "task1387": "Premise: {} <sep> Hypothesis: {} <sep> Answer: {}",
    "task1186": "System Reference: {}\nOriginal Reference: {}\nAnswer: {}",
    "task190": "Sentence 1: {} Sentence 2: {} \n Answer: {}",
    "task1612": "sentence_A: {} sentence_B: {} \n Answer: {}",
    "task155": "Sentence: {}\nAnswer: {}",
    "task318": "Target: {} \n{} \nAnswer: {}",
    "task501": "CLAIM : {}. POST : {}. ANSWER : {}",
    "task133": "Sentence: {}\n Reason: {}\n Question: {}\n Answer: {}",
    "task220": "Sentence 1: {} Sentence 2: {} Sentence 3: {} Sentence 4: {} Sentence 5: {} Choices: a. {} b. {} Answer: {}",
    "task1431": "Question: {}\n Options:  <1> {} <2> {} <3> {} <4> {} <5> {}\n Answer: {}",
    "task309": "Article: {}\n Question: {}\n Options: (A) {} (B) {} (C) {} (D) {}\n Answer: {}",
    "task1380": "Sentence: {} Question: {} (A) {} (B) {} Answer: {}",
    "task697": "{}\n(A){} (B){} (C){} (D){}\nAnswer: {}",
    "task1297": "Fact1: {}, Fact2: {}, Question: {} (A) {} (B) {} (C) {} (D) {} (E) {} (F) {} (G) {} (H) {}, Answer: {}",
    "task065": "Sentence 1: {} \n Sentence 3: {} \n Sentence 4: {} \n Sentence 5: {} \n Option 1: {} \n Option 2: {} \n Answer: {}",
    "task069": "Beginning: {} Middle 1: {} Middle 2: {} Ending: {} Answer: {}",
    "task137": "Prompt: {} \nCompletion A: {} \nCompletion B: {} \nAnswer: {}",
    "task118": "{}\n(A){} (B){} (C){} (D){} (E){}\nAnswer: {}",
    "task1135": "Question: {} \n Options: A {} B {} C {} D {} E {} \n Answer: {}",
    "task1424": "Problem: {} \nOptions: a ) {} , b ) {} , c ) {} , d ) {} , e ) {} \nAnswer: {}",
    "task1678": "Problem: {}\nOptions: a. {}, b. {}, c. {}, d. {}, e. {}\nAnswer: {}",
    "task385": "Context: {} \n Question: {} \n Options: (A) {} (B) {} (C) {} \n Answer: {}",
    "task214": "Title: {} Sentence 1: {} Sentence 2: {} Sentence 3: {} Sentence 4: {} Choices: a. {} b. {} Answer: {}",
}


def test_default_texts_of_every_layout_kind(spark):
    init = S.Table("code", [[(c[1],) for c in r.cells] for r in L.RELATIONS.values()])
    df = S.with_layouts(spark.range(1)).withColumn("cells", F.transform(init.rows(), init.code))
    cells = F.col("cells")
    got = {r.template: r for r in df.select("template", S.rendered(cells).alias("t"), S.rendered(cells, F.lit(2)).alias("two"), S.rendered(cells, F.lit(3), output=False).alias("none"),
                                            S.rendered(cells, output_hole=False).alias("ask")).collect()}
    assert {n: got[n].t for n in DEFAULTS} == DEFAULTS
    assert got["task084"].two == "Passage: Fact 1- {} Fact 2- {} Question: {} Answer: {} Final Output: {}"
    assert got["task296"].two == "Sentence1: {} Sentence2: {} \n (A) {} (B) {} \n Answer: {}"
    assert got["task296"].none == "Sentence1: {} Sentence2: {} Sentence3: {} \n (A) {} (B) {}"
    assert got["task155"].ask == "Sentence: {}\nAnswer: " and got["task155"].none == "Sentence: {}"


def py_one_field(space, fn, sep):
    """Independent model of the one-field layout: validity and format text."""
    case = [lambda x: x, str.title, str.upper, str.lower][fn]
    valid = SEPARATORS[sep] != ""                                              # R2 (shared separator)
    if SPACES[space] == "":
        valid = False                                                          # R4: first child carries text
    if "\n" not in SPACES[space] and "\n" in SEPARATORS[sep]:
        valid = False                                                          # R5
    text = f"{case('Sentence')}{SEPARATORS[sep]}{{}}{SPACES[space]}{case('Answer')}{SEPARATORS[sep]}{{}}"
    return valid, text


def test_one_field_all_assignments(spark):
    combos = list(itertools.product(range(len(SPACES)), range(len(CASE_FNS)), range(len(SEPARATORS))))
    for (space, fn, sep), r in zip(combos, rows(spark, "task155", [codes("task155", *c) for c in combos])):
        assert (r.valid, r.text) == py_one_field(space, fn, sep)


def test_enumeration_update_rejection(spark):
    """A newline separator is rejected when the enumeration's (already set) space has no newline."""
    assert kinds("task190")[3:5] == ["chosen_space", "chosen_separator"]
    nl_sep = SEPARATORS.index(" \n\t")
    reject = codes("task190", 2, 0, 0, SPACES.index(" "), nl_sep, 0, 0, 3)
    accept = codes("task190", 2, 0, 0, SPACES.index("\n"), nl_sep, 0, 0, 3)
    r = rows(spark, "task190", [reject, accept])
    # rejected: the enumeration keeps its default separator ': '
    assert r[0].text.startswith("Sentence(1): {} Sentence(2): {}") and r[0].rejected == 1
    assert r[1].text.startswith("Sentence(1) \n\t{}\nSentence(2) \n\t{}") and r[1].rejected == 0


def test_whitespace_only_spacing_rule(spark):
    base = [1] * len(kinds("task084"))
    base[kinds("task084").index("chosen_separator_text_and_option")] = 0
    ok, bad, last = list(base), list(base), list(base)
    ok[1] = ok[2] = SPACES.index(" ")          # the inner (whitespace-only) spacing node, listed twice
    bad[1] = bad[2] = SPACES.index(" -- ")     # rejected: keeps '', which is not blank
    last[1], last[2] = SPACES.index("\n "), SPACES.index(" -- ")   # the first write stays
    r = rows(spark, "task084", [codes("task084", *x) for x in (ok, bad, last)])
    assert not r[1].valid and r[1].rejected == 2 and r[2].rejected == 1
    assert r[2].text.startswith("PASSAGE") or "\n " in r[2].text
    assert all(x.text is not None for x in r)


def test_unregistered_and_unshared_attributes(spark):
    # task220 shares its separator and case function but never assigns them; task697 shares nothing
    assert "text_descriptor_fn" not in kinds("task220") and kinds("task697").count("chosen_separator") == 3
    idx = dict(zip(("space", "sep", "wrap", "number", "espace", "esep", "asep", "case"), (2, 0, 4, 4, 1, 7, 3, 2)))
    r = rows(spark, "task697", [codes("task697", *idx.values())])[0]
    # the first field's own separator stays '' (an empty one is rejected), which no valid format has
    assert r.text == "{}\n[i] - {} [ii] - {} [iii] - {} [iv] - {}\nANSWER: {}" and not r.valid


def test_transfer():
    assert L.transfer(L.RELATIONS["task1297"], L.RELATIONS["task155"]) == [0, 12, 4]
    assert L.transfer(L.RELATIONS["task155"], L.RELATIONS["task190"]) is None


@pytest.mark.parametrize("name", ["task155", "task190"])
def test_draws_visit_every_assignment_once(spark, name):
    n = S.sizes(name)[0]
    some = min(n, 3000)
    df = spark.range(-2, some + (5 if n == some else 0)).select(F.col("id").alias("format_id"), F.lit(S.NAMES.index(name)).alias("number"))
    got = [tuple(r.codes) for r in S.drawn(df, "7").collect()]
    assert len(got) == some == len(set(got))
    natural = [tuple(r.codes) for r in df.where("format_id between 0 and 9").select(S.unranked(F.col("format_id")).alias("codes")).collect()]
    assert natural == [tuple(codes(name, *x)) for x in itertools.islice(itertools.product(*[range(L.size(k)) for k in kinds(name)]), 10)]
    if n == some:
        assert set(got) == {tuple(codes(name, *x)) for x in itertools.product(*[range(L.size(k)) for k in kinds(name)])}
    else:   # every slot's values about equally often
        for i, k in enumerate(kinds(name)):
            for v in range(L.size(k)):
                expected = some / L.size(k)
                assert abs(sum(x[i] == L.OFFSET[k] + v for x in got) - expected) < 6 * math.sqrt(expected)


def test_sampling_meets_quotas_or_raises(spark):
    named = spark.createDataFrame([("a", "task155"), ("b", "task214"), ("c", "task214")], "name string, template string")
    got = S.sampled(named, 300, "q", first_block=1).collect()
    by = {n: sorted((r.ord, r.draw, tuple(r.codes)) for r in got if r.name == n) for n in "abc"}
    assert all(len(v) == 300 == len({x[2] for x in v}) and [x[0] for x in v] == list(range(1, 301)) for v in by.values())
    assert {x[2] for x in by["b"]} != {x[2] for x in by["c"]}   # each name has its own draws
    assert all(r.valid for r in rows(spark, "task214", [list(x[2]) for x in by["b"][:50]]))
    small = S.sampled(named.where("name = 'a'"), 960, "q").collect()
    combos = list(itertools.product(range(len(SPACES)), range(len(CASE_FNS)), range(len(SEPARATORS))))
    assert [tuple(r.codes) for r in sorted(small, key=lambda r: r.draw)] == [tuple(codes("task155", *c)) for c in combos if py_one_field(*c)[0]]
    with pytest.raises(ValueError):   # 680 of 960 are valid
        S.sampled(named.where("name = 'a'"), 900, "q")


def brute_neighbours(assignment):
    space, fn, sep = assignment
    options = [(0, range(len(SPACES)), SPACES), (1, range(len(CASE_FNS)), CASE_FNS), (2, range(len(SEPARATORS)), SEPARATORS)]
    for slot, values, text in options:
        for v in values:
            new = list(assignment)
            new[slot] = v
            if text[v] != text[assignment[slot]] and py_one_field(*new)[0]:
                yield tuple(new)


def test_paths_against_exhaustive_search(spark):
    combos = [c for c in itertools.product(range(len(SPACES)), range(len(CASE_FNS)), range(len(SEPARATORS))) if py_one_field(*c)[0]]
    df = spark.createDataFrame([(i, "task155", S.NAMES.index("task155"), codes("task155", *c)) for i, c in enumerate(combos)],
                               "format_id long, template string, number int, codes array<int>")
    got = {r.format_id: r for r in N.paths(df).collect()}
    plain = lambda cs: tuple(c - L.OFFSET[k] for c, k in zip(cs, kinds("task155")))
    name = lambda x: (SPACES[x[0]], x[1], SEPARATORS[x[2]])
    for i, c in enumerate(combos):
        seconds = list(brute_neighbours(c))
        has = any(name(v2) != name(c) for v1 in seconds for v2 in brute_neighbours(v1))
        assert has == (i in got)
        v1, v2 = plain(got[i].v1), plain(got[i].v2)
        assert v1 in seconds and v2 in set(brute_neighbours(v1)) and name(v2) != name(c)


def test_pairs_against_the_plain_loop(spark):
    named = spark.createDataFrame([("x", "task155"), ("y", "task1380")], "name string, template string")
    got = N.pairs(named, "p", 60, first_block=1).collect()
    pairs = sorted((r.draw, r.pair, r.slot_idx, tuple(r.v0), tuple(r.v1)) for r in got if r.name == "x")
    assert len(pairs) == 60 and sum(r.name == "y" for r in got) == 60
    draws = spark.range(0, 960).select(F.col("id").alias("draw"), F.lit(S.NAMES.index("task155")).alias("number"), F.lit("x").alias("name"))
    drawn = sorted((r.draw, tuple(r.codes), tuple(r.others)) for r in S.drawn(draws, "p", "draw", "name").withColumn("others", N._others()).collect())
    plain = lambda cs: tuple(c - L.OFFSET[k] for c, k in zip(cs, kinds("task155")))
    name = lambda cs: (SPACES[plain(cs)[0]], plain(cs)[1], SEPARATORS[plain(cs)[2]])
    used, expected = set(), []
    for draw, v0, others in drawn:
        if len(expected) == 60:
            break
        slot = len(expected) % 3
        v1 = tuple(others[slot] if i == slot else c for i, c in enumerate(v0))
        assert name(v1) != name(v0)
        if name(v0) in used or name(v1) in used or not (py_one_field(*plain(v0))[0] and py_one_field(*plain(v1))[0]):
            continue
        used |= {name(v0), name(v1)}
        expected.append((draw, len(expected), slot, v0, v1))
    assert pairs == expected


def test_split_is_valid_everywhere_and_short_splits_raise(spark):
    tasks = spark.createDataFrame([("a", "task155"), ("b", "task309"), ("c", "task309")], "task string, template string")
    got = SP.build(tasks, ("random", "separator_space"), 8, "s").collect()
    assert len(got) == 2 * 3 * 8 and {r.ord for r in got} == set(range(1, 9))
    for name in ("task155", "task309"):
        mine = [r for r in got if r.template == name]
        assert all(r.valid for r in rows(spark, name, [list(r.codes) for r in mine]))
    assert {(r.mode, r.ord, tuple(r.codes)) for r in got if r.task == "b"} == {(r.mode, r.ord, tuple(r.codes)) for r in got if r.task == "c"}
    firsts = [[L.CODES[c][1] for c in r.codes] for r in got if r.task == "a" and r.mode == "separator_space"]
    assert all(s in (" \n", "  ", "; \n", " \n ", "\n ", "\n", " ,  ") for s, _, _ in firsts)
    with pytest.raises(RuntimeError):   # there are fewer keys than formats asked for
        SP.build(tasks, ("separator_space",), 200, "s")


def test_duplicate_names_and_placeholders(spark):
    assert len(SPACES) - len(set(SPACES)) == 1 and len(WRAPPERS) == 6 and len(TEXT_OPTION_GAPS) == 4
    df = spark.createDataFrame([(S.NAMES.index("task155"), codes("task155", 9, 0, 3))], "number int, codes array<int>")
    r = df.select(S.from_names(S.names(F.col("codes"))).alias("back")).first()
    assert list(r.back) == codes("task155", 4, 0, 3)
    one = [0] * len(kinds("task220"))
    one[kinds("task220").index("chosen_number_format")] = 1
    df = S.evaluated(spark.createDataFrame([(S.NAMES.index("task220"), codes("task220", *one))], "number int, codes array<int>"))
    assert df.select(S.filled_in(F.lit("{enum0_1}-{enum0_5} {enum1_2} {other}"), F.col("cells")).alias("t")).first().t == "A-E 2 {other}"


def test_validity_without_cells_and_cells_by_last_accepted_write(spark):
    rows = S.with_layouts(spark.range(40).withColumnRenamed("id", "format_id"))
    x = S.drawn(rows, "v").select("*", S.gives_valid(F.col("codes")).alias("short"))
    n, n_valid = 0, 0
    for r in S.evaluated(x).collect():
        rel = L.RELATIONS[r.template]
        cells, rejected = [c[1] for c in rel.cells], 0
        newline, empty, blank = (lambda c, m=m: bool(m >> c & 1) for m in (L.NEWLINE, L.EMPTY, L.BLANK))
        for (_, cell, rule, sep, gap, space), value in zip(rel.slots, r.codes):
            now = [value if c == cell else old for c, old in enumerate(cells)]
            nl = lambda c: c >= 0 and newline(now[c])  # noqa: B023, E731
            fits = {L.ALWAYS: True, L.BLANK_ONLY: blank(value), L.NOT_EMPTY: not empty(value), L.WITH_NEWLINE: not (nl(sep) or nl(gap)) or nl(space)}[rule]
            cells, rejected = (now, rejected) if fits else (cells, rejected + 1)
        valid = (all(not newline(cells[a]) or newline(cells[b]) for a, b in rel.implies) and not any(empty(cells[c]) for c in rel.filled)
                 and all(blank(cells[c]) for c in rel.blank))
        assert (list(r.cells), r.rejected, r.valid, r.short) == (cells, rejected, valid, valid)
        n, n_valid = n + 1, n_valid + valid
    assert n == 40 * len(S.NAMES) and n // 4 < n_valid < n
