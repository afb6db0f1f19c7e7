"""Secret scan: all rules in minimal automata, run over the bytes of many texts at once.

One automaton reads texts backwards, always open to a new match, and so tells in one pass over the
bytes where a match of which rule starts. From each start that is not inside a match another one,
of all rules too, follows the bytes to the last state that accepts. Spans come from these transition
arrays alone; lengths that would multiply the states are counted beside them.
"""

from __future__ import annotations

import hashlib
from collections import deque
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from colloquy.llm.common import pieces, text_bytes

_VALUE = "A-Za-z0-9+/_.=-"


@dataclass(frozen=True)
class Rule:
    """The leftmost longest matches of `pattern`, which do not overlap; a match with fewer than `least`
    characters after the longest match of `head` at its start (without one: in all) is dropped.

    Patterns know ASCII literals, \\xNN, classes, groups, |, ?, *, +, {m}, {m,} and {m,n}.
    """

    kind: str
    pattern: str
    head: str = ""
    least: int = 0
    ignore_case: bool = False


_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: Base kinds first, then those that this scan adds.
RULES = (
    Rule("assign", rf"{_ASSIGN}[{_VALUE}]+", _ASSIGN, 6, True),
    Rule("access", r"AKIA[A-Z0-9]{4,}", "", 20),
    Rule("hex", r"[0-9a-f]{12,}", "", 24),
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]+", "", 24),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", "", 17),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+", "", 23),
)


# ---------------------------------------------------------------- regex -> tree -> NFA -> minimal DFA


def parse(pattern: str, fold: bool = False) -> tuple:
    """("set", bytes), ("seq", parts), ("alt", parts) or ("rep", part, low, high or None)."""
    at = 0

    def byte() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            if c.isalnum():
                raise ValueError(f"unknown escape in {pattern}")
        if ord(c) > 127:
            raise ValueError(f"not ASCII: {pattern}")
        return ord(c)

    def one() -> tuple:
        nonlocal at
        if pattern[at] == "(":
            at += 1
            if pattern.startswith("?:", at):
                at += 2
            out = alternatives()
            at += 1
            return out
        if pattern[at] in "?*+{.^$":
            raise ValueError(f"not in the subset: {pattern}")
        if pattern[at] != "[":
            found = {byte()}
        else:
            at += 1
            found = set()
            if pattern[at] == "^":
                raise ValueError(f"not in the subset: {pattern}")
            while pattern[at] != "]":
                a = b = byte()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    b = byte()
                found |= set(range(a, b + 1))
            at += 1
        if fold:
            found |= {c ^ 32 for c in found if chr(c).isalpha()}
        return ("set", frozenset(found))

    def sequence() -> tuple:
        nonlocal at
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            part = one()
            if at < len(pattern) and pattern[at] in "?*+":
                part = ("rep", part, *{"?": (0, 1), "*": (0, None), "+": (1, None)}[pattern[at]])
                at += 1
            elif at < len(pattern) and pattern[at] == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
                at = end + 1
            parts.append(part)
        return ("seq", parts)

    def alternatives() -> tuple:
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    tree = alternatives()
    if at != len(pattern):
        raise ValueError(f"unbalanced: {pattern}")
    return tree


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, tree: tuple, backwards: bool) -> tuple[int, int]:
        """First and last state of a tree's fragment."""
        kind, first, last = tree[0], self.state(), self.state()
        if kind == "set":
            self.step[first] = (tree[1], last)
        elif kind == "alt":
            for part in tree[1]:
                a, b = self.add(part, backwards)
                self.eps[first].append(a)
                self.eps[b].append(last)
        elif kind == "seq":
            at = first
            for part in reversed(tree[1]) if backwards else tree[1]:
                a, b = self.add(part, backwards)
                self.eps[at].append(a)
                at = b
            self.eps[at].append(last)
        else:
            _, part, low, high = tree
            at = first
            for _ in range(low):
                a, b = self.add(part, backwards)
                self.eps[at].append(a)
                at = b
            if high is None:
                a, b = self.add(part, backwards)
                self.eps[at] += [a, last]
                self.eps[b] += [a, last]
            else:
                for _ in range(high - low):
                    a, b = self.add(part, backwards)
                    self.eps[at] += [a, last]
                    at = b
                self.eps[at].append(last)
        return first, last


@dataclass
class Automaton:
    table: np.ndarray  # state * classes + class -> state * classes
    classes: np.ndarray  # byte -> class
    n_classes: int
    accepts: np.ndarray  # state -> bit mask of patterns
    resets: np.ndarray  # byte -> every state goes back to the start
    least: int  # bytes of the shortest match
    dead: int  # state (times classes) that nothing leaves and that does not accept, or -1

    @cached_property
    def steps(self) -> list[int]:
        return self.table.tolist()

    @cached_property
    def at_step(self) -> list[int]:
        """What a state (times classes) accepts."""
        return np.repeat(self.accepts, self.n_classes).tolist()


def compile_patterns(trees: list[tuple], always_open: bool, backwards: bool) -> Automaton:
    """All patterns in one automaton: subset construction, then minimisation."""
    nfa, starts, finals = _Nfa(), [], {}
    for k, tree in enumerate(trees):
        a, b = nfa.add(tree, backwards)
        starts.append(a)
        finals[b] = k
    # Bytes that no pattern tells apart form one class.
    sets = list({s[0] for s in nfa.step if s})
    signature: dict[tuple, int] = {}
    classes = np.array([signature.setdefault(tuple(c in s for s in sets), len(signature)) for c in range(256)])
    member = [int(np.flatnonzero(classes == k)[0]) for k in range(len(signature))]
    closures: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closures:
            out, todo = {s}, [s]
            while todo:
                for x in nfa.eps[todo.pop()]:
                    if x not in out:
                        out.add(x)
                        todo.append(x)
            closures[s] = frozenset(x for x in out if nfa.step[x] or x in finals)
        return closures[s]

    root = frozenset().union(*(closure(s) for s in starts))
    ids, order, rows = {root: 0}, deque([root]), []
    while order:
        now = order.popleft()
        row = []
        for c in member:
            to = set(root) if always_open else set()
            for s in now:
                if nfa.step[s] and c in nfa.step[s][0]:
                    to |= closure(nfa.step[s][1])
            to = frozenset(to)
            if to not in ids:
                ids[to] = len(ids)
                order.append(to)
            row.append(ids[to])
        rows.append(row)
    table = np.array(rows, np.int64).reshape(len(ids), len(member))
    accepts = np.zeros(len(ids), np.int64)
    for states, i in ids.items():
        accepts[i] = sum({1 << finals[s] for s in states if s in finals})
    # Minimisation: split blocks of states by where their bytes lead until no block splits.
    block = np.unique(accepts, return_inverse=True)[1]
    while True:
        new = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == block.max():
            break
        block = new
    first = np.unique(block, return_index=True)[1]
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    block, first = rank[block], np.sort(first)
    small, accepts = block[table[first]], accepts[first]
    resets = np.array([bool((small[:, classes[c]] == 0).all()) for c in range(256)])
    dead = [i for i in range(len(small)) if not accepts[i] and (small[i] == i).all()]
    least, reach, seen = 0, {0}, {0}
    while reach and not any(accepts[s] for s in reach):
        reach = {int(x) for s in reach for x in small[s]} - seen
        seen |= reach
        least += 1
    n = len(member)
    return Automaton((small * n).astype(np.int32).ravel(), classes.astype(np.uint8), n, accepts, resets, least, dead[0] * n if dead else -1)


@dataclass
class Scanner:
    rules: tuple[Rule, ...]
    back: Automaton  # bits: rules of which a match starts here
    ahead: Automaton  # bits: rules, then their heads


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Scanner:
    if len(rules) > MOST_RULES:
        raise ValueError(f"a scanner holds {MOST_RULES} rules")
    trees = [parse(r.pattern, r.ignore_case) for r in rules]
    heads = [parse(r.head, r.ignore_case) if r.head else ("alt", []) for r in rules]
    return Scanner(rules, compile_patterns(trees, True, True), compile_patterns(trees + heads, False, False))


# ---------------------------------------------------------------- scanning

#: Runs that are too few to be read together; bytes that are read one by one at a time; rules of a scanner.
FEW, PART, MOST_RULES = 64, 1 << 16, 31


def match_starts(auto: Automaton, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, rules) where matches start, in order.

    The runs between bytes that reset the automaton, and between texts, are read from their ends,
    one byte of each at a time, the longest first; when few are left, these are read one by one.
    """
    stop = np.flatnonzero(auto.resets[data])
    edges = np.unique(np.concatenate([stop, stop + 1, off]))
    start, end = edges[:-1], edges[1:]
    long = end - start >= auto.least
    start, end = start[long], end[long]
    order = np.argsort(start - end, kind="stable")
    start, end = start[order], end[order]
    length = end - start
    cls = auto.classes[data]
    together = int(length[FEW - 1]) if len(length) >= FEW else 0
    # active[j]: how many runs have a byte j.
    active = np.searchsorted(-length, -np.arange(together), "left")
    state = np.zeros(len(start), np.int32)
    good = np.zeros(len(auto.table), bool)
    good[:: auto.n_classes] = auto.accepts != 0
    some = good[auto.table]  # the step leads to a state that accepts
    at, masks = [], []
    for j, n in enumerate(active):
        here = end[:n] - 1 - j
        move = state[:n] + cls[here]
        state[:n] = auto.table[move]
        hit = np.flatnonzero(some[move])
        if len(hit):
            at.append(here[hit])
            masks.append(auto.accepts[state[hit] // auto.n_classes])
    table = auto.steps
    for i in range(min(FEW, len(start))):
        now, high = int(state[i]), int(end[i]) - together
        while high > start[i]:
            low = max(int(start[i]), high - PART)
            went = []
            for c in cls[low:high][::-1].tolist():
                now = table[now + c]
                went.append(now)
            got = auto.accepts[np.array(went, np.int32) // auto.n_classes]
            hit = np.flatnonzero(got)
            at.append(high - 1 - hit)
            masks.append(got[hit])
            high = low
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, masks = np.concatenate(at), np.concatenate(masks)
    order = np.argsort(at, kind="stable")
    return at[order], masks[order]


def follow(auto: Automaton, data: np.ndarray, start: np.ndarray, limit: np.ndarray, rule: np.ndarray, n_rules: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, end of the head) of the longest match of a rule from each start; the start where there is none.

    All are read together while they are many and their bytes in all are in proportion to the data;
    an end of -1 stands for those that were not read to the end.
    """
    end, head = start.copy(), start.copy()
    live, at = np.arange(len(start)), start.copy()
    state = np.zeros(len(start), np.int32)
    left = 64 * len(data) + (1 << 22)
    while len(live) >= FEW and left > 0:
        left -= len(live)
        state = auto.table[state + auto.classes[data[at]]]
        at = at + 1
        bits = auto.accepts[state // auto.n_classes] >> rule[live]
        full, part = (bits & 1).astype(bool), (bits >> n_rules & 1).astype(bool)
        end[live[full]] = at[full]
        head[live[part]] = at[part]
        keep = (state != auto.dead) & (at < limit[live])
        live, at, state = live[keep], at[keep], state[keep]
    end[live] = -1
    return end, head


def follow_one(auto: Automaton, data: np.ndarray, start: int, limit: int, rule: int, n_rules: int) -> tuple[int, int]:
    """The same for one start, byte by byte."""
    end = head = start
    table, accepts, dead = auto.steps, auto.at_step, auto.dead
    full, part, now, at, size = 1 << rule, 1 << rule + n_rules, 0, start, 64
    while at < limit:
        for c in auto.classes[data[at : min(limit, at + size)]].tolist():
            now = table[now + c]
            if now == dead:
                return end, head
            at += 1
            bits = accepts[now]
            if bits & full:
                end = at
            if bits & part:
                head = at
        size = min(2 * size, PART)
    return end, head


def spans_in(scanner: Scanner, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, rule, end) in bytes of the kept matches in texts, by start, then rule.

    A rule's starts are kept as intervals of neighbours. The first of each interval is read with all
    others; then a text's matches follow from one another, each from the first start behind the one
    before, which is read by itself only where it is inside an interval or was too long.
    """
    at, masks = match_starts(scanner.back, data, off)
    n, first, last, rule = len(scanner.rules), [], [], []
    for k in range(n):
        mine = at[masks >> k & 1 == 1]
        if len(mine):
            cut = np.flatnonzero((np.diff(mine) != 1) | np.isin(mine[1:], off))
            first.append(mine[np.append(0, cut + 1)])
            last.append(mine[np.append(cut, len(mine) - 1)])
            rule.append(np.full(len(first[-1]), k))
    if not first:
        none = np.zeros(0, np.int64)
        return none, none, none
    first, last, rule = np.concatenate(first), np.concatenate(last), np.concatenate(rule)
    text = np.searchsorted(off, first, "right") - 1
    limit = off[text + 1]
    ends, heads = follow(scanner.ahead, data, first, limit, rule, n)
    edges = np.append(np.flatnonzero((np.diff(rule) != 0) | (np.diff(text) != 0)) + 1, len(first))
    out, a = [], 0
    for b in edges.tolist():
        i, s, k, stop = a, int(first[a]), int(rule[a]), int(limit[a])
        least, mine = scanner.rules[k].least, last[a:b]
        while True:
            end, head = (int(ends[i]), int(heads[i])) if s == first[i] and ends[i] >= 0 else follow_one(scanner.ahead, data, s, stop, k, n)
            if end > s and end - head >= least:
                out.append((s, k, end))
            behind = max(end, s + 1)
            if last[i] < behind:
                i = i + 1 if i + 1 < b and last[i + 1] >= behind else a + int(np.searchsorted(mine, behind, "left"))
            if i >= b:
                break
            s = max(int(first[i]), behind)
        a = b
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    s, k, e = np.array(out, np.int64).T
    order = np.lexsort((k, s))
    return s[order], k[order], e[order]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: key, spans array<struct<kind, start, end, secret>> in code points, by start, then rule.

    The kinds are those of the rules given. A null text counts as empty, and such rows have no spans;
    more rules than a scanner holds are run in several; repeated rows give repeated results; of matches that start alike the earlier rule's comes first;
    an empty table gives an empty result. Texts of any length are scanned whole. Columns other than
    key and text are not used, whatever their names.
    """
    scanners = [compile_rules(tuple(rules[i : i + MOST_RULES])) for i in range(0, len(rules), MOST_RULES)]
    shared = docs.sparkSession.sparkContext.broadcast(scanners)  # tens of thousands of numbers each
    kinds = [r.kind for r in rules]

    def scan(batches):
        import pyarrow as pa

        scanners = shared.value
        kind_type = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())])
        for batch in batches:
            data, off = text_bytes(batch.column(1))
            out: list[list[dict]] = [[] for _ in range(len(off) - 1)]
            for i, j in pieces(off):
                part, po = data[off[i] : off[j]], off[i : j + 1] - off[i]
                found = [(s, k + m * MOST_RULES, e) for m, scanner in enumerate(scanners) for s, k, e in [spans_in(scanner, part, po)]]
                s, k, e = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                if not len(s):
                    continue
                order = np.lexsort((k, s))
                s, k, e = s[order], k[order], e[order]
                points = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # code points before each byte
                d = np.searchsorted(po, s, "right") - 1
                base = points[po[d]]
                for doc, rule, a, b, x, y in zip(d.tolist(), k.tolist(), (points[s] - base).tolist(), (points[e] - base).tolist(), s.tolist(), e.tolist(), strict=True):
                    out[i + doc].append({"kind": kinds[rule], "start": a, "end": b, "secret": part[x:y].tobytes().decode("ascii")})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind_type))], [key, "spans"])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(scan, f"`{key}` {key_type}, spans array<struct<kind:string,start:bigint,end:bigint,secret:string>>")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
