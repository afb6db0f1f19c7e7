"""Phrase dictionaries: trees of nodes with phrase conditions, and their boolean expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate, groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

AND, OR, NOT = {"И", "AND"}, {"ИЛИ", "OR"}, {"НЕ", "NOT"}


@dataclass
class Limit:
    """A time window: the first or last n seconds, words or phrases of a channel, or around parent matches."""

    event: str = "StartEnd"  # or Parent
    only: bool = True  # keep what is inside, else what is outside
    value: int = 0
    unit: str = "Seconds"  # Seconds, Words, Phrases
    channel: str = "ANY"
    end: str = "First"  # First, Last
    selector: str = "Each"  # of parent matches: First, Last, Each
    direction: str = "Before"  # of parent matches: Before, After
    enabled: bool = True


@dataclass
class Condition:
    text: str
    distance: int = 2
    channel: str = "ANY"
    exact: bool = False
    negated: bool = False
    operator: str = ""  # that joins it to the condition before
    limits: list[Limit] = field(default_factory=list)


@dataclass
class Node:
    name: str
    conditions: list[Condition] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    remainder: bool = False
    gated_by_tree: bool = True  # False: any hit opens the gate
    saved_state: str = ""
    attributes: dict[str, str] = field(default_factory=dict)


@dataclass
class Placed:
    """A node with its place in the tree."""

    node: Node
    node_id: str
    path: tuple[int, ...]
    root: str
    level: int
    gates: tuple[str, ...]  # nodes with conditions above it, the nearest last


def flatten(roots: list[Node]) -> list[Placed]:
    """All nodes in order. Nodes without conditions take no level and no gate of their own."""
    out: list[Placed] = []

    def visit(node: Node, path: tuple[int, ...], root: str, level: int, gates: tuple[str, ...]) -> None:
        node_id = ".".join(map(str, path))
        out.append(Placed(node, node_id, path, root, level, gates))
        below = (level + 1, (*gates, node_id)) if node.conditions else (level, gates)
        for i, child in enumerate(node.children):
            visit(child, (*path, i), root, *below)

    for i, r in enumerate(roots):
        visit(r, (i,), r.name, 1, ())
    return out


def names_of(node: Node) -> Iterator[str]:
    yield node.name
    for c in node.children:
        yield from names_of(c)


def select_roots(roots: list[Node], names: list[str] | None) -> list[Node]:
    """Roots that are named, or have a named descendant; all without names."""
    return [r for r in roots if not names or set(names) & set(names_of(r))]


def open_gate(conditions: list[Condition], matched: Column) -> Column:
    """The node's expression over the array of matched texts: NOT before AND before OR, no brackets.

    An operator that is missing counts as AND; a node without conditions is open.
    """
    if not conditions:
        return F.lit(True)
    alternatives: list[Column] = []
    for i, c in enumerate(conditions):
        leaf = F.array_contains(matched, c.text)
        leaf = ~leaf if c.negated else leaf
        if i and c.operator.upper() in OR:
            alternatives.append(leaf)
        elif alternatives:
            alternatives[-1] = alternatives[-1] & leaf
        else:
            alternatives.append(leaf)
    out = alternatives[0]
    for a in alternatives[1:]:
        out = out | a
    return out


def holds(conditions: list[Condition], matched: set[str]) -> bool:
    """The same expression over a plain set, for single checks."""
    terms: list[bool] = []
    for i, c in enumerate(conditions):
        leaf = (c.text in matched) != c.negated
        if i and c.operator.upper() in OR or not terms:
            terms.append(leaf)
        else:
            terms[-1] = terms[-1] and leaf
    return any(terms) if terms else True


def channel_of(channel: Column) -> Column:
    """CLIENT or OPERATOR, in whatever case it is written; everything else is ANY."""
    known = F.upper(F.trim(F.coalesce(channel, F.lit(""))))
    return F.when(known.isin("CLIENT", "OPERATOR"), known).otherwise("ANY")


def phrases_between(tokens: Column) -> Column:
    """The phrases of array<struct<text, kind>>: words up to the next operator joined by blanks.

    Words are of the kind WORD and not empty; other kinds, and lexemes that are no operators, are passed
    over. Null tokens give null, none an empty array.
    """
    words = lambda a: F.when(F.size(a["words"]) > 0, F.concat(a["out"], F.array(F.array_join(a["words"], " ")))).otherwise(a["out"])
    none = F.expr("cast(array() as array<string>)")

    def step(a: Column, t: Column) -> Column:
        ends = (t["kind"] == "LEXEME") & F.upper(t["text"]).isin(*sorted(AND | OR | NOT))
        word = (t["kind"] == "WORD") & (t["text"] != "")
        more = F.when(word, F.concat(a["words"], F.array(t["text"]))).otherwise(a["words"])
        return F.when(ends, F.struct(words(a).alias("out"), none.alias("words"))).otherwise(F.struct(a["out"].alias("out"), more.alias("words")))

    return F.aggregate(tokens, F.struct(none.alias("out"), none.alias("words")), step, words)


@dataclass
class Token:
    text: str
    kind: str = "WORD"  # WORD, LEXEME, TERMINAL, WHITESPACE
    channel: str = ""
    distance: str = ""


#: Marks of a phrase's end.
_QUOTE, _BRACKET = '"', "()"


def _mark(t: Token) -> str:
    """What a token does: WORD, a quote, BRACKET, AND, OR, NOT, or nothing. Quotes and brackets are terminals."""
    word = t.text.upper()
    if t.kind == "WORD":
        return "WORD"
    if t.kind == "TERMINAL" and t.text in (_QUOTE, *_BRACKET):
        return _QUOTE if t.text == _QUOTE else "BRACKET"
    if t.kind == "LEXEME":
        return next((name for name, known in (("AND", AND), ("OR", OR), ("NOT", NOT)) if word in known), "")
    return ""


def _condition(words: list[Token], quoted: bool, before: list[str], first: bool) -> Condition:
    """A phrase's condition; its channel is the first that is not ANY, its distance the first number (2 without one)."""
    channels = (t.channel.strip().upper() for t in words)
    distance = next((int(t.distance) for t in words if t.distance.strip().lstrip("-").isdigit()), 2)
    operator = next((m for m in reversed(before) if m in ("AND", "OR")), "")
    channel = next((c for c in channels if c not in ("", "ANY")), "ANY")
    return Condition(" ".join(t.text for t in words), distance, channel if channel in ("CLIENT", "OPERATOR") else "ANY", quoted, "NOT" in before, "" if first else operator)


def conditions_of(tokens: list[Token]) -> list[Condition]:
    """Conditions of a token stream.

    Marks cut it into runs of words. Quotes make a run exact, brackets only end one, operators before a
    run join it to the one before, and a negation holds for the next run alone.
    """
    marks = [(t, m) for t in tokens if (m := _mark(t))]
    inside = accumulate((m for _, m in marks), lambda on, m: not on if m == _QUOTE else on and m != "BRACKET", initial=False)
    out: list[Condition] = []
    before: list[str] = []
    for (is_word, quoted), run in groupby(zip(marks, list(inside)[1:], strict=True), key=lambda x: (x[0][1] == "WORD", x[1])):
        found = [x[0] for x in run]
        if is_word:
            out.append(_condition([t for t, _ in found], quoted, before, not out))
            before = []
        else:
            before += [m for _, m in found]
    return out
