"""Task layouts as relations (C2, C22): nodes as nested intervals, slots, cells, rules and text parts.

A layout is a small tree: spacing nodes join their children, fields and
enumerations print a descriptor, a separator and a hole.  ``nodes`` numbers the
tree by nested intervals (a node's descendants are those inside its interval), and
everything the evaluator of ``format_space`` needs follows from that table:

* cells: the attributes a layout has (a space, a separator, a case function, ...),
  each with its default value; a field that shares an attribute reads the shared
  cell;
* slots: the values a format assigns, in order, each with the cell it writes and
  the rule under which the write is accepted;
* rules: cells that must not be empty, cells that must be blank, and pairs of cells
  of which a newline in the first needs one in the second;
* parts: the rendered text in order, every part a constant or a choice by a cell.

Values are numbered across all catalogues (``CODES``), so that one bit of a 64-bit
number says whether a value holds a newline, is empty, or is blank.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from promptspread.operators.catalogue import (CASE_FNS, COMPOSITIONAL_TRAIN_SPACES, NUMBER_FORMATS, ROMAN_NUMERALS, SEPARATORS, SPACES,
                                              TEXT_OPTION_GAPS, WRAPPERS)

SEP, SPACE, GAP = "chosen_separator", "chosen_space", "chosen_separator_text_and_option"
CASE, WRAP, NUMBER = "text_descriptor_fn", "chosen_item_wrapper", "chosen_number_format"
BARE = "lambda x: x as wrapper"   # the default wrapper of some layouts, which no catalogue offers

# All values by type: first the catalogue's (a value listed twice keeps both numbers), then those that only occur as
# defaults or in a training catalogue.
VALUES = {
    SEP: [*SEPARATORS, ". "],
    SPACE: [*SPACES, *[s for s in COMPOSITIONAL_TRAIN_SPACES if s not in SPACES]],
    GAP: [*TEXT_OPTION_GAPS, "_"],
    CASE: list(CASE_FNS),
    WRAP: [*WRAPPERS, BARE],
    NUMBER: list(NUMBER_FORMATS),
}
OFFSET = {t: sum(len(VALUES[u]) for u in list(VALUES)[:i]) for i, t in enumerate(VALUES)}
CODES = [(t, v) for t in VALUES for v in VALUES[t]]
TEXTS = (SEP, SPACE, GAP)         # types whose value is the text itself
WRAPPED = [("(", ")"), ("", "."), ("", ")"), ("", " )"), ("[", "]"), ("<", ">"), ("", "")]


def code(kind: str, value: str) -> int:
    """Number of a value; of a value listed twice the first."""
    return OFFSET[kind] + VALUES[kind].index(value)


def mask(test) -> int:
    """64 bits: for which text values the test holds."""
    return sum(1 << i for i, (t, v) in enumerate(CODES) if t in TEXTS and test(v))


NEWLINE, EMPTY, BLANK = mask(lambda v: "\n" in v), mask(lambda v: v == ""), mask(str.isspace)


# ------------------------------------------------------------------ notation

@dataclass(frozen=True)
class Node:
    kind: str                    # spacing, field, enum, hole
    name: str = ""               # descriptor
    space: str = ""              # spacing, enum
    blank: bool = False          # spacing that accepts blank spaces only
    children: tuple = ()
    shares: str = "sc"           # what the node shares with others: s the separator, c the case function
    sep: str = ": "              # default of its own separator
    hole: bool = True            # whether a text follows
    output: bool = False
    items: tuple[int, ...] = ()  # enum: numbers of its items, from 0
    gap: str = ""
    wrap: int = 0                # number of the default wrapper
    number: int = 0              # number of the default numbering
    label: str = ""              # name by which placeholders refer to an enum


def _f(name: str, **more) -> Node:
    return Node("field", name, **more)


def _e(name: str, n: int | list[int], space: str, sep: str = ": ", gap: str | None = None, **more) -> Node:
    items = tuple(range(n)) if isinstance(n, int) else tuple(n)
    more = {"shares": "c" if name else "", **more}
    return Node("enum", name, space, sep=sep, gap=(" " if name else "") if gap is None else gap, items=items, **more)


def _s(space: str, *children, blank: bool = False) -> Node:
    return Node("spacing", space=space, children=children, blank=blank)


_ANSWER = _f("Answer", output=True)
_TEXT = Node("hole")
_ONLY, _LETTER, _SMALL = len(WRAPPERS), 1, 2   # default wrapper without marks, default numberings


@dataclass(frozen=True)
class Layout:
    tasks: tuple[str, ...]
    root: Node
    shared: str = "cs"                 # shared cells that a format assigns, in order: c case function, s separator
    defaults: tuple[str, str] = (": ", CASE_FNS[0])
    lengths: tuple[int, int] | None = None   # enumeration lengths, first to last

    @property
    def name(self) -> str:
        return self.tasks[0]


def _fields(tasks: str, space: str, *names: str) -> Layout:
    return Layout(tuple(tasks.split()), _s(space, *map(_f, names), _ANSWER))


def _choices(name: str, *, space: str = "", blank: bool = True, options: Node) -> Node:
    return _s(space, _f(name, hole=False), options, blank=blank)


# Fixed values (must equal the reference): the task layouts in its order.  Two of its branches raise before they
# build anything and have no row.
LAYOUTS = (
    _fields("task1661 task027", "\n", "Passage", "Question"),
    _fields("task136 task021 task018 task020 task740", "\n", "Sentence", "Question"),
    _fields("task1366", "\n", "Paragraph", "Claim"),
    _fields("task1162", "\n ", "Paragraph", "Title"),
    _fields("task1587", ". ", "Abstract", "Title"),
    _fields("task491 task492", " ", "Sentence", "Question"),
    _fields("task050", " \n", "Sentence", "Question"),
    _fields("task1387", " <sep> ", "Premise", "Hypothesis"),
    _fields("task1186 task1283 task1284", "\n", "System Reference", "Original Reference"),
    Layout(("task190", "task1347"), _s(" \n ", _e("Sentence", 2, " ", wrap=_ONLY, label="enum1"), _ANSWER)),
    Layout(("task1612",), _s(" \n ", _e("sentence", 2, " ", gap="_", wrap=_ONLY, number=_LETTER), _ANSWER)),
    _fields("task905", "\n", "Tweet", "Label"),
    _fields("task155 task158 task161 task163 task162", "\n", "Sentence"),
    _fields("task322 task323 task324 task325 task326 task327 task328", "\n", "Comment"),
    _fields("task333 task335 task337", "\n", "Post"),
    _fields("task277 task278", "\n", "Context"),
    _fields("task279 task280 task316 task317", "\n", "Passage"),
    _fields("task113 task114", "\n", "Sentence"),
    Layout(("task318", "task319", "task320", "task321"), _s(" \n", _f("Target"), _TEXT, _ANSWER)),
    Layout(("task501",), _s(". ", _f("Claim"), _f("Post"), _ANSWER), defaults=(" : ", CASE_FNS[2])),
    _fields("task133", "\n ", "Sentence", "Reason", "Question"),
    Layout(("task220",), _s(" ", _e("Sentence", 5, " ", wrap=_ONLY, shares="sc", label="enum0"),
                            _choices("Choices", options=_e("", 2, " ", " ", wrap=1, number=_SMALL, label="enum1")), _ANSWER), shared=""),
    Layout(("task1431",), _s("\n ", _f("Question"), _choices("Options", space=" ", blank=False, options=_e("", 5, " ", " ", wrap=5, label="enum1")), _ANSWER), shared="sc"),
    Layout(("task309",), _s("\n ", _f("Article"), _f("Question"), _choices("Options", options=_e("", 4, " ", " ", number=_LETTER, label="enum1")), _ANSWER)),
    Layout(("task1380", "task1381"), _s(" ", _f("Sentence"), _f("Question"), _e("", 2, " ", " ", number=_LETTER, label="enum1"), _ANSWER)),
    Layout(("task697", "task729"), _s("\n", _f("", sep="", shares=""), _e("", 4, " ", "", number=_LETTER, label="enum1"), _f("Answer", shares="", output=True)), shared=""),
    _fields("task903", "\n", "Review", "Polarity"),
    Layout(("task084",), _s(" ", _choices("Passage", options=_e("Fact", 15, " ", "- ", wrap=_ONLY, label="enum1")), _f("Question"), _f("Answer"),
                            _f("Final Output", output=True)), lengths=(2, 15)),
    Layout(("task1297",), _s(", ", _e("Fact", 2, ", ", gap="", wrap=_ONLY), _s(" ", _f("Question"), _e("", 8, " ", " ", number=_LETTER, label="enum1")), _ANSWER)),
    Layout(("task065",), _s(" \n ", _e("Sentence", [0, 2, 3, 4], " \n ", wrap=_ONLY), _e("Option", 2, " \n ", wrap=_ONLY, label="enum1"), _ANSWER)),
    Layout(("task069", "task070"), _s(" ", _f("Beginning"), _e("Middle", 2, " ", wrap=_ONLY, label="enum1"), _f("Ending"), _ANSWER)),
    Layout(("task137", "task138", "task139", "task140"), _s(" \n", _f("Prompt"), _e("Completion", 2, " \n", wrap=_ONLY, number=_LETTER, label="enum1"), _ANSWER)),
    Layout(("task296", "task297"), _s(" \n ", _e("Sentence", 10, " ", gap="", wrap=_ONLY), _s(" ", _e("", 2, " ", " ", number=_LETTER, label="enum1")), _ANSWER), lengths=(1, 10)),
    Layout(("task118",), _s("\n", _TEXT, _e("", 5, " ", "", number=_LETTER, label="enum1"), _ANSWER)),
    Layout(("task1135",), _s(" \n ", _f("Question"), _choices("Options", options=_e("", 5, " ", " ", wrap=_ONLY, number=_LETTER, label="enum1")), _ANSWER)),
    Layout(("task1424", "task1423", "task1422", "task1421", "task1420", "task1419"),
           _s(" \n", _f("Problem"), _choices("Options", options=_e("", 5, " , ", " ", wrap=3, number=_SMALL, label="enum1")), _ANSWER)),
    Layout(("task1678",), _s("\n", _f("Problem"), _choices("Options", options=_e("", 5, ", ", " ", wrap=1, number=_SMALL, label="enum1")), _ANSWER)),
    Layout(("task385", "task580"), _s(" \n ", _f("Context"), _f("Question"), _choices("Options", options=_e("", 3, " ", " ", number=_LETTER, label="enum1")), _ANSWER)),
    Layout(("task214", "task213"), _s(" ", _f("Title"), _e("Sentence", 4, " ", wrap=_ONLY, shares="sc", label="enum0"),
                                      _choices("Choices", options=_e("", 2, " ", ". ", wrap=_ONLY, number=_SMALL, label="enum1")), _ANSWER)),
)
REFERENCE = "task1297"    # the task whose formats a split is built from: it has slots of all six types


# ----------------------------------------------------------------- relations

ALWAYS, BLANK_ONLY, NOT_EMPTY, WITH_NEWLINE = range(4)


@dataclass
class Relations:
    """One layout's rows: what ``nodes`` and the notation give, in terms of cells."""

    layout: Layout
    nodes: list[tuple] = field(default_factory=list)        # (node, low, high, kind, descriptor)
    cells: list[tuple] = field(default_factory=list)        # (type, default code)
    slots: list[tuple] = field(default_factory=list)        # (type, cell, rule, separator cell, gap cell, space cell)
    implies: list[tuple] = field(default_factory=list)      # a newline in the first cell needs one in the second
    filled: list[int] = field(default_factory=list)
    blank: list[int] = field(default_factory=list)
    parts: list[tuple] = field(default_factory=list)        # (cell or -1, first code, texts, item or 0, flag)
    labels: dict = field(default_factory=dict)              # label of an enum -> (number cell, items)


OUTPUT, OUTPUT_HOLE = 1, 2      # flags of parts: of the output field, and its hole


def cased(word: str) -> list[str]:
    """A descriptor under the four case functions."""
    return [word, word.title(), word.upper(), word.lower()]


def numbered(i: int) -> list[str | None]:
    """Item ``i`` under the six numberings; the numeral signs end at twelve."""
    roman = ROMAN_NUMERALS[i] if i < len(ROMAN_NUMERALS) else None
    return [str(i + 1), chr(ord("A") + i), chr(ord("a") + i), chr(0x2160 + i) if i < 12 else None, roman, roman and roman.upper()]


def relations(layout: Layout) -> Relations:
    r = Relations(layout)
    walk: list[tuple[Node, list[int], dict]] = []   # nodes in depth-first order, their ancestors' space cells, their own cells

    def cell(kind: str, default: int) -> int:
        r.cells.append((kind, default))
        return len(r.cells) - 1

    shared = {"s": cell(SEP, code(SEP, layout.defaults[0])), "c": cell(CASE, code(CASE, layout.defaults[1]))}

    def visit(node: Node, above: list[int], at: int) -> int:
        own: dict[str, int] = {}
        if node.kind in ("spacing", "enum"):
            own[SPACE] = cell(SPACE, code(SPACE, node.space))
        if node.kind in ("field", "enum"):
            own[SEP] = shared["s"] if "s" in node.shares else cell(SEP, code(SEP, node.sep))
            own[CASE] = shared["c"] if "c" in node.shares else cell(CASE, OFFSET[CASE])
        if node.kind == "enum":
            own[GAP], own[WRAP], own[NUMBER] = cell(GAP, code(GAP, node.gap)), cell(WRAP, OFFSET[WRAP] + node.wrap), cell(NUMBER, OFFSET[NUMBER] + node.number)
            if node.label:
                r.labels[node.label] = (own[NUMBER], node.items)
        number = len(walk)
        walk.append((node, above, own))
        r.nodes.append(None)
        end = at + 1
        for child in node.children:
            end = visit(child, [*above, own[SPACE]], end)
        r.nodes[number] = (number, at, end, node.kind, node.name)
        return end + 1

    visit(layout.root, [], 0)

    def slot(kind: str, own: dict, rule: int = ALWAYS) -> None:
        r.slots.append((kind, own[kind], rule, own.get(SEP, -1), own.get(GAP, -1), own.get(SPACE, -1)))

    for number, (node, above, own) in enumerate(walk):
        if node.kind == "spacing":
            # a spacing node inside another one is listed twice, as a child and as a parent
            for _ in range(2 if number else 1):
                slot(SPACE, own, BLANK_ONLY if node.blank else ALWAYS)
            if node.blank:
                r.blank.append(own[SPACE])
            if not all(c.kind == "field" and not c.hole for c in node.children[:-1]):
                r.filled.append(own[SPACE])
        elif node.kind == "field":
            if "s" not in node.shares:
                slot(SEP, own, NOT_EMPTY)
            if "c" not in node.shares and node.name:
                slot(CASE, own)
            r.filled.append(own[SEP])
        elif node.kind == "enum":
            if node.name and "c" not in node.shares:
                slot(CASE, own)
            slot(WRAP, own)
            slot(NUMBER, own)
            slot(SPACE, own, WITH_NEWLINE)
            if "s" not in node.shares:
                slot(SEP, own, WITH_NEWLINE)
            if node.name:
                slot(GAP, own, WITH_NEWLINE)
            r.implies += [(own[SEP], own[SPACE]), (own[GAP], own[SPACE])]
        if node.kind in ("field", "enum") and node.hole:
            r.implies += [(own[SEP], space) for space in above]
    for letter in layout.shared:
        kind = SEP if letter == "s" else CASE
        r.slots.append((kind, shared[letter], ALWAYS, -1, -1, -1))

    cells_of = {id(node): own for node, _, own in walk}

    def choice(at: int, kind: str, texts: list, item: int = 0, flag: int = 0) -> None:
        r.parts.append((at, OFFSET[kind], texts, item, flag))

    def constant(text: str, item: int = 0, flag: int = 0) -> None:
        r.parts.append((-1, 0, [text], item, flag))

    def show(node: Node, flag: int) -> None:
        own = cells_of[id(node)]
        if node.kind == "hole":
            constant("{}")
        elif node.kind == "field":
            choice(own[CASE], CASE, cased(node.name), 0, flag)
            choice(own[SEP], SEP, VALUES[SEP], 0, flag)
            if node.hole:
                constant("{}", 0, OUTPUT | OUTPUT_HOLE if flag else 0)
        elif node.kind == "enum":
            for nth, i in enumerate(node.items, 1):
                if nth > 1:
                    choice(own[SPACE], SPACE, VALUES[SPACE], nth)
                choice(own[CASE], CASE, cased(node.name), nth)
                choice(own[GAP], GAP, VALUES[GAP], nth)
                choice(own[WRAP], WRAP, [a for a, _ in WRAPPED], nth)
                choice(own[NUMBER], NUMBER, numbered(i), nth)
                choice(own[WRAP], WRAP, [b for _, b in WRAPPED], nth)
                choice(own[SEP], SEP, VALUES[SEP], nth)
                constant("{}", nth)
        else:
            for nth, child in enumerate(node.children):
                part = OUTPUT if child.output else flag
                if nth:
                    choice(own[SPACE], SPACE, VALUES[SPACE], 0, part)
                show(child, part)

    show(layout.root, 0)
    return r


def size(kind: str) -> int:
    """Number of catalogue values of a type."""
    return len(VALUES[kind]) - {SEP: 1, SPACE: 1, GAP: 1, WRAP: 1}.get(kind, 0)


def transfer(source: Relations, target: Relations) -> list[int] | None:
    """For each slot of ``target`` the slot of ``source`` it takes its value from: the k-th of a type from the
    k-th, the last one repeats.  None if the source lacks a type."""
    places: dict[str, list[int]] = {}
    for i, s in enumerate(source.slots):
        places.setdefault(s[0], []).append(i)
    used: dict[str, int] = {}
    out = []
    for s in target.slots:
        if s[0] not in places:
            return None
        k = used.get(s[0], 0)
        used[s[0]] = k + 1
        out.append(places[s[0]][min(k, len(places[s[0]]) - 1)])
    return out


RELATIONS = {layout.name: relations(layout) for layout in LAYOUTS}
