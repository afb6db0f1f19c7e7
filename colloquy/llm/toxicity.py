"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums over all ordered triples of characters that both have, within a span
of SPAN and discounted by DECAY for every character skipped, over the strings' own norms. So an
insult with characters put in or left out stays near to the plain one. A sentence is one string of
letters, in which whatever stands between words is a mark, a character like others: its windows are
its words, parts of long words, and runs of up to RUN successive words of at most WIDTH characters. So
an insult split by spaces or signs is a gapped one too. In scripts without spaces each character is
a word. A sentence is as toxic as its most toxic windows, and a text as its most toxic sentences.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN, DECAY = 6, 0.5
#: Margins below this tell nothing more; that of a text without words.
FLOOR = -0.5
#: Distinct windows of a text whose margins make its score.
TOP = 5
#: Characters of a window, marks included; longer words come in overlapping parts.
WIDTH = 20
#: Successive words that a window may span.
RUN = 7
#: By how much a run of words must exceed each word in it, to be a find of its own.
GAIN = 0.1
#: Weight of each gapped form of an insult in training.
GAPPED = 0.08
_FORMS = (1, 1, 1, 4, 1, 3)  # forms with more gaps, which clean texts have seldom, weigh more
#: A missed toxic text costs as much as so many false alarms when margins are turned into scores.
MISSED = 1.2
#: Characters that are scanned at once.
PIECE = 1 << 18
_MARK = 127  # a letter's symbol takes 7 bits: a-z are 1 to 26, others share 27 to 125
_NOTHING = _MARK << 14 | _MARK << 7 | _MARK  # marks alone tell nothing
_STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
_LEET = str.maketrans("013457", "oieast")
_SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_][.\-*_]?\s+){3,}[^\W\d_](?![^\s.,!?;:])")
_MARKS = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"[.!?\n]+")
_UNSPACED = 0x2E80  # from this code point on, scripts are taken to be written without spaces


def plain(word: str) -> str:
    """A lower-case word's letters; digits that stand for letters count if there are letters too."""
    w = _MARKS.sub("", word)
    if w.isalpha():
        return w
    return _DIGITS.sub("", w.translate(_LEET)) if any(c.isalpha() for c in w) else ""


def words_of(text: str) -> set[str]:
    """Distinct lower-case words of a text, and its spelled-out ones."""
    low = text.lower()
    words = set(low.split())
    if sum(len(w) == 1 or (len(w) == 2 and not w[1].isalnum()) for w in words) >= 3:
        words.update(_MARKS.sub("", m) for m in _SPELLED.findall(low))
    return words


@cache
def _symbols() -> np.ndarray:
    """Symbol of each code point: of letters 1 to 125, else 0."""
    points = np.arange(0x110000, dtype=np.uint64)
    other = (27 + (points * 2654435761 >> 12) % 99).astype(np.uint8)
    out = np.where(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000), other, np.uint8(0))
    out[97:123] = np.arange(1, 27)
    return out


@cache
def _digits() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for a, b in _LEET.items():
        out[a] = b - 96
    return out


@dataclass
class Strings:
    """Texts as one row of symbols; token t stands between marks[t] and marks[t + 1]."""

    x: np.ndarray
    marks: np.ndarray
    ends: np.ndarray  # marks that end a sentence or a text
    source: np.ndarray  # places of the symbols in the joined texts
    starts: np.ndarray  # places where texts begin there
    joined: str

    def text_of(self, token: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.source[self.marks[token] + 1], "right") - 1

    def slice(self, first: int, last: int) -> str:
        """What stands between two symbols, without them."""
        return self.joined[self.source[first + 1] : self.source[last - 1] + 1]


def strings(texts: list[str]) -> Strings:
    """Lower-case texts as symbols: digits beside letters count as those they stand for, what else is no letter
    is a mark, runs of marks are one. Line breaks end sentences, as do . ! ? after two letters or more."""
    joined = "\n".join(["", *texts, ""])
    starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = _symbols()[points]
    digit = np.flatnonzero((points >= 48) & (points <= 57))
    near = digit[(x[digit - 1] > 0) | (x[digit + 1] > 0)]  # the first and last are line breaks
    x[near] = _digits()[points[near]]
    source = np.arange(len(x))
    wide = np.flatnonzero((points >= _UNSPACED) & (x > 0))
    if len(wide):
        x, points, source = (np.insert(a, wide + 1, v) for a, v in ((x, 0), (points, 32), (source, source[wide])))
    gap = x == 0
    first = gap.copy()
    first[1:] &= ~gap[:-1]
    runs = np.flatnonzero(first)
    line = np.add.reduceat((points == 10).astype(np.int32), runs) > 0
    stop = np.add.reduceat(((points == 46) | (points == 33) | (points == 63)).astype(np.int32), runs) > 0
    stop[0] = False
    stop[1:] &= (x[runs[1:] - 1] > 0) & (x[np.maximum(runs[1:] - 2, 0)] > 0)
    keep = np.flatnonzero(~gap | first)
    x = x[keep].astype(np.int32)
    x[x == 0] = _MARK
    return Strings(x, np.flatnonzero(x == _MARK), line | stop, source[keep], starts, joined)


def norms(length: np.ndarray) -> np.ndarray:
    """Least norms of strings of these lengths, marks at both ends included: those of which all triples differ."""
    total = np.zeros(np.shape(length))
    for k in range(2, SPAN):
        total += (k - 1) * DECAY ** (2 * (k - 2)) * np.maximum(0, np.asarray(length) - k)
    return np.sqrt(np.maximum(total, 1.0))


def parts(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of at most WIDTH symbols over each stretch: (owner, first, last)."""
    half = WIDTH // 2
    times = np.maximum(1, -(-(last - first + 1 - WIDTH) // half) + 1)
    owner = np.repeat(np.arange(len(first)), times)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
    a = first[owner] + nth * half
    return owner, a, np.minimum(a + WIDTH - 1, last[owner])


def windows(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, triple, weight) of the windows from a to b, each triple once a window, ascending, weights of
    norm 1; and the norms. Triples of marks alone do not count."""
    n = b - a + 1
    window = np.repeat(np.arange(len(a)), n)
    at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + a[window]
    keys, weights = [], []
    for j, k in _STEPS:
        ok = at + k <= b[window]
        i, w = at[ok], window[ok]
        triple = (x[i] << 14) | (x[i + j] << 7) | x[i + k]
        told = triple != _NOTHING
        keys.append((w[told] << 21) | triple[told])
        weights.append(np.full(int(told.sum()), DECAY ** (k - 2)))
    key, weight = np.concatenate(keys), np.concatenate(weights)
    if len(key):
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, weight = key[first], np.add.reduceat(weight, first)
    window = key >> 21
    norm = np.sqrt(np.maximum(np.bincount(window, weight**2, len(a)), 1.0))
    return window, key & ((1 << 21) - 1), weight / norm[window], norm


def triples(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, triple, weight) of the units' windows, and the windows' owners. A unit is letters, with spaces for marks."""
    s = strings(units)
    text = s.text_of(np.arange(len(s.marks) - 1)) if len(s.marks) > 1 else np.zeros(0, int)
    begin, end = np.searchsorted(text, np.arange(len(units))), np.searchsorted(text, np.arange(len(units)), "right")
    some = np.flatnonzero(end > begin)
    owner, a, b = parts(s.marks[begin[some]], s.marks[end[some]])
    return *windows(s.x, a, b)[:3], some[owner]


def _table(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The triples of the units, ascending, and triples x units: each unit's weights (of its first window)."""
    window, triple, weight, owner = triples(units)
    unit, first = np.unique(owner, return_index=True)
    column = np.full(len(owner), -1)
    column[first] = unit
    keep = column[window] >= 0
    names, row = np.unique(triple[keep], return_inverse=True)
    out = np.zeros((len(names), len(units)))
    out[row, column[window[keep]]] = weight[keep]
    return names, out


def kernel(units: list[str], table: tuple[np.ndarray, np.ndarray], step: int = 1024) -> np.ndarray:
    """Kernel of each unit with the columns of table, the largest of a unit's windows."""
    names, matrix = table
    out = np.full((len(units), matrix.shape[1]), -np.inf)
    for u in range(0, len(units), step):
        window, triple, weight, owner = triples(units[u : u + step])
        part = np.zeros((len(owner), matrix.shape[1]))
        row = np.minimum(np.searchsorted(names, triple), len(names) - 1)
        hit = np.flatnonzero(names[row] == triple)
        for h in range(0, len(hit), 1 << 14):
            some = hit[h : h + (1 << 14)]
            w = window[some]
            edges = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
            part[w[edges]] += np.add.reduceat(matrix[row[some]] * weight[some, None], edges, axis=0)
        np.maximum.at(out, owner + u, part)
    return np.where(np.isinf(out), 0.0, out)


def pieces(text: str):
    """Stretches of a long text, cut at spaces where there are some, each with the RUN words before it."""
    a = 0
    while len(text) - a > PIECE:
        cut = a + PIECE
        space = text.rfind(" ", cut - 4096, cut)
        yield text[a : space if space > 0 else cut]
        back = space
        for _ in range(RUN):
            back = text.rfind(" ", cut - 4096, back) if back > 0 else -1
        a = back + 1 if back > 0 else space + 1 if space > 0 else cut - 2 * WIDTH
    yield text[a:]


def profile(highest: list[float]) -> list[float]:
    """The highest margins of a text's distinct windows, and how far the first is beyond doubt."""
    top = [max(m, FLOOR) for m in highest[:TOP]]
    top += [FLOOR] * (TOP - len(top))
    return [*top, 5 * max(0.0, top[0] - 0.6)]


@dataclass
class Model:
    triples: tuple[np.ndarray, np.ndarray] | None = None  # the machine's weights on triples, through its landmarks
    bias: float = 0.0
    slopes: tuple[float, ...] = (0.0,) * (TOP + 1)  # of a text's profile
    offset: float = -4.0
    landmarks: tuple[str, ...] = ()
    _dense: np.ndarray | None = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def margins(self, words: list[str]) -> np.ndarray:
        if self.triples is None:
            return np.full(len(words), -1.0)
        return kernel(words, (self.triples[0], self.triples[1][:, None]))[:, 0] + self.bias

    def score(self, highest: list[float]) -> float:
        """highest: the margins of a text's most toxic distinct windows."""
        x = sum(a * b for a, b in zip(self.slopes, profile(highest), strict=True)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))

    def finds(self, texts: list[str | None]) -> list[list[tuple[float, str]]]:
        """Each text's TOP highest margins above FLOOR of distinct windows that do not overlap, highest first, and the windows."""
        best: list[dict[str, float]] = [{} for _ in texts]
        some: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            for piece in pieces(text.lower()) if text and self.triples is not None else ():
                if size + len(piece) > PIECE and some:
                    self._scan(some, best)
                    some, size = [], 0
                some.append((i, piece))
                size += len(piece)
        if some:
            self._scan(some, best)
        return [sorted(((m, w) for w, m in b.items()), key=lambda r: (-r[0], r[1]))[:TOP] for b in best]

    def _scan(self, some: list[tuple[int, str]], best: list[dict[str, float]]) -> None:
        if self._dense is None:
            self._dense = np.zeros(1 << 21, np.float32)
            self._dense[self.triples[0]] = self.triples[1]
        s = strings([t for _, t in some])
        tokens = len(s.marks) - 1
        if tokens < 1:
            return
        sums = {}
        for k in range(2, SPAN):
            n = max(0, len(s.x) - k)
            ends = (s.x[:n] << 14) | s.x[k : k + n]
            here = np.zeros(n, np.float32)
            for j in range(1, k):
                here += self._dense[ends | (s.x[j : j + n] << 7)]
            sums[k] = np.concatenate([[0.0], np.cumsum(here, dtype=np.float64)]) * DECAY ** (k - 2)

        def margin(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            total = sum(c[np.clip(b - k + 1, a, len(c) - 1)] - c[np.minimum(a, len(c) - 1)] for k, c in sums.items())
            return total / norms(b - a + 1) + self.bias

        owner, a, b = parts(s.marks[:-1], s.marks[1:])
        here = margin(a, b)
        rows = [(owner, a, b, here, np.full(len(here), -np.inf))]
        inner = np.full(tokens, -np.inf)
        np.maximum.at(inner, owner, here)
        broken = np.cumsum(s.ends)
        for m in range(2, min(RUN, tokens) + 1):
            t = np.arange(tokens - m + 1)
            inner = np.maximum(inner[:-1], inner[1:])
            a, b = s.marks[t], s.marks[t + m]
            t = t[(b - a < WIDTH) & (broken[t + m - 1] == broken[t])]
            a, b = s.marks[t], s.marks[t + m]
            here = margin(a, b)
            new = here > inner[t] + GAIN
            rows.append((t[new], a[new], b[new], here[new], inner[t[new]]))
        token, a, b, value, within = (np.concatenate(z) for z in zip(*rows, strict=True))
        high = np.flatnonzero(value > FLOOR)
        token, a, b, value, within = token[high], a[high], b[high], value[high], within[high]
        for h in range(0, len(a), 4096):  # the norms of windows in which triples repeat are larger than was assumed
            part = slice(h, h + 4096)
            norm = windows(s.x, a[part], b[part])[3]
            value[part] = (value[part] - self.bias) * norms(b[part] - a[part] + 1) / norm + self.bias
        high = np.flatnonzero((value > FLOOR) & (value > within + GAIN))
        token, a, b, value = token[high], a[high], b[high], value[high].round(6)
        text = s.text_of(token)
        order = np.lexsort((b - a, -value, text))
        text, a, b, value = text[order], a[order], b[order], value[order]
        # Copies of a window have one margin and one length, and so stand together.
        fresh = np.ones(len(text), bool)
        fresh[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1]) | (b[1:] - a[1:] != b[:-1] - a[:-1])
        text, a, b, value = text[fresh], a[fresh], b[fresh], value[fresh]
        edges = np.flatnonzero(np.diff(text, prepend=-1, append=-1))
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            own, taken = best[some[text[first]][0]], []
            for n in range(first, last):
                if all(b[n] <= c or a[n] >= d for c, d in taken):
                    taken.append((a[n], b[n]))
                    word = s.slice(a[n], b[n])
                    own[word] = max(float(value[n]), own.get(word, FLOOR))
                    if len(taken) == TOP:
                        break


def _machine(x: np.ndarray, y: np.ndarray, times: np.ndarray, c: float = 300.0, steps: int = 40) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, the classes of equal weight, by Newton steps in the primal."""
    x1 = np.c_[x, np.ones(len(x))]
    weight = times / np.where(y > 0, times[y > 0].sum(), times[y < 0].sum())
    ridge = np.eye(x1.shape[1]) / c
    ridge[-1, -1] = 1e-9
    w, active = np.zeros(x1.shape[1]), np.ones(len(x), bool)
    for _ in range(steps):
        xa, wa = x1[active], weight[active, None]
        new = np.linalg.solve(ridge + (xa * wa).T @ xa, xa.T @ (wa[:, 0] * y[active]))
        now = y * (x1 @ new) < 1
        w = new
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def gapped(word: str) -> list[str]:
    """A word with a letter put in, split, spelled out, and with letters put in throughout."""
    if len(word) < 4 or " " in word:
        return []
    half, third = len(word) // 2, len(word) // 3
    return [word[:half] + "x" + word[half:], word[:third] + "n" + word[third:], word[:half] + " " + word[half:], " ".join(word), "x".join(word), word[:2] + "q" + "q".join(word[2:-1]) + word[-1]]


def bag_of(text: str) -> list[str]:
    """Distinct words of a text of three letters or more; of scripts without spaces pairs of characters."""
    words: set[str] = set()
    for sentence in _SENTENCE.split(text):
        words |= words_of(sentence)
    out = set()
    for w in map(plain, words):
        if any(ord(c) >= _UNSPACED for c in w):
            out.update(f"{a} {b}" for a, b in zip(w, w[1:]))
        elif len(w) >= 3:
            out.add(sys.intern(w))
    return sorted(out)


def fit(texts: list[str], toxic: list[int], landmarks: int = 450, rounds: int = 3) -> Model:
    """Learn from labelled texts.

    A toxic text's sentences are a bag of which at least one window is an insult: the witness is first
    the word most tied to the label, then the one the machine itself puts first; it also counts with gaps
    (gapped). Windows of the other texts are negative; those that the machine takes for insults are added
    each round, runs of words among them. A fifth of the texts only serve to turn margins into scores.
    """
    if not any(toxic) or all(toxic):
        return Model(offset=4.0 if toxic and all(toxic) else -4.0, slopes=(0.0,) * (TOP + 1))
    bags = [bag_of(t) for t in texts]
    order = np.random.default_rng(1).permutation(len(texts))
    held = set(order[: len(order) // 5].tolist())
    held = held if len({toxic[i] for i in held}) == 2 else set()
    use = [i for i in range(len(texts)) if i not in held]
    count: dict[str, list[int]] = {}
    for i in use:
        for w in bags[i]:
            count.setdefault(w, [0, 0])[toxic[i]] += 1
    n1 = sum(toxic[i] for i in use)
    n0 = len(use) - n1
    tied = {w: np.log((b + 0.1) / (n1 + 1)) - np.log((a + 0.1) / (n0 + 1)) + 0.3 * np.log(b + 0.1) for w, (a, b) in count.items() if b}
    bad = sorted((w for w in tied if count[w][0] == 0 or tied[w] > 2), key=lambda w: (-tied[w], w))
    clean = sorted((w for w, (a, _) in count.items() if a), key=lambda w: (-count[w][0], w))
    spread = clean[:: max(1, len(clean) // (landmarks // 3))][: landmarks // 3] if clean else []
    forms = [g for w in bad[: landmarks // 12] for g in gapped(w)[2:5]]
    marks = tuple(dict.fromkeys(bad[: landmarks - len(spread) - len(forms)] + forms + spread))
    if not marks:
        return Model()
    table = _table(list(marks))
    values, vectors = np.linalg.eigh(kernel(list(marks), table))
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    witness = {i: max(bags[i], key=lambda w: (tied.get(w, -9), w)) for i in use if toxic[i] and bags[i]}
    negative = list(dict.fromkeys(clean[:1500] + clean[1500 :: max(1, len(clean) // 2000)]))
    calm = [i for i in use if not toxic[i]]
    known = sorted(count)
    model = Model()
    for turn in range(rounds):
        seen = {w: b for w, (a, b) in count.items() if b >= 3 and a == 0}
        for w in witness.values():
            if w not in seen and count[w][1] > count[w][0]:
                seen[w] = 1
        # Each witness also with gaps.
        plus = {g: n * GAPPED * more for w, n in seen.items() for g, more in zip(gapped(w), _FORMS, strict=False)} | seen
        words = list(plus) + [w for w in negative if w not in plus]
        y = np.r_[np.ones(len(plus)), -np.ones(len(words) - len(plus))]
        times = np.r_[list(plus.values()), [1 + 0.2 * np.log1p(count.get(w, [0])[0]) for w in words[len(plus) :]]]
        w, b = _machine(kernel(words, table) @ root, y, times)
        model = Model((table[0], table[1] @ (root @ w)), b, landmarks=marks)
        if turn == rounds - 1:
            break
        margin = dict(zip(known, model.margins(known).tolist(), strict=True))
        hard = sorted((w for w in clean if count[w][0] >= count[w][1]), key=lambda w: (-margin[w], w))[:1500]
        runs: dict[str, float] = {}
        for found in model.finds([texts[i] for i in calm]):
            runs.update((" ".join(_MARKS.sub(" ", w).split()), m) for m, w in found if not w.isalpha())
        hard += sorted(runs, key=lambda w: (-runs[w], w))[:1000]
        negative = list(dict.fromkeys(negative + hard))
        witness = {i: max(bags[i], key=lambda w: (margin[w], w)) for i in witness}
    scale = sorted(held) or use
    top = np.array([profile([m for m, _ in found]) for found in model.finds([texts[i] for i in scale])])
    y = np.array([toxic[i] for i in scale], float)
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    cost = np.where(y > 0, MISSED, 1.0)
    x = np.c_[top, np.ones(len(top))]
    a = np.array([0.5] * TOP + [0.0, 0.0])
    ridge = np.diag([0.5] * TOP + [0.1, 0.01])
    for _ in range(50):  # Newton steps of a logistic fit, slightly damped
        p = 1 / (1 + np.exp(-np.clip(x @ a, -50, 50)))
        h = (x * (cost * p * (1 - p) + 1e-6)[:, None]).T @ x + ridge
        a = a - np.linalg.solve(h, x.T @ (cost * (p - goal)) + ridge @ a)
    model.slopes, model.offset = tuple(np.maximum(a[:-1], 0).tolist()), float(a[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, seed: int = 9, most_bytes: int = 64 << 20, longest: int = 1 << 20) -> Model:
    """Fit on about `sample` of the labelled rows, docs(doc_id, text), labels(doc_id, toxic): a seeded draw among the
    texts of at most `longest` characters, of fewer rows if those would have more than `most_bytes` together."""
    labels = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = labels.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    drawn = labels.where(place < min(1.0, sample / max(1, n)) * (1 << 20))
    texts = docs.where("text is not null").where(F.length("text") <= longest).select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > most_bytes:
        texts = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1 << 20)) < most_bytes / total * (1 << 20))
    rows = texts.select("text", "toxic").collect()
    rows.sort(key=lambda r: (r["text"], r["toxic"]))
    return fit([r["text"] for r in rows], [r["toxic"] for r in rows])


def score_texts(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """Add score (0 to 1), predicted (score >= cut) and worst_word to docs(text); only the text is looked at.

    Texts that are null, empty or without letters get the score of the least toxic, and no worst_word, as do
    texts of which every window is below FLOOR. Whole texts are read, of any length, PIECE characters at
    once. Of the highest windows that score alike the least is named. Repeated rows each get their row,
    with the same result; an empty table gives an empty result. Added columns replace those of the same
    name, other columns stay.
    """
    added = ["score", "predicted", "worst_word"]
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number a triple of the landmarks
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            texts = batch.column(at)
            scores, worst = [], []
            for a in range(0, batch.num_rows, 64):
                for found in m.finds(texts.slice(a, 64).to_pylist()):
                    scores.append(m.score([v for v, _ in found]))
                    worst.append(found[0][1] if found else None)
            s = np.array(scores, np.float64)
            columns = [pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(worst, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(added, ("double", "integer", "string"), strict=True):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
