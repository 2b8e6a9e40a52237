"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks, trained on labelled sentences.

Strings are compared by the triples of letters that they hold in order, with gaps: a triple that spans s letters counts DECAY ** s, up to a span of SPAN, and
the sums are divided by what a string of its length has. So a word with letters put in between, a new ending or a space inside stays near the insults it was made of.
Characters other than letters are dropped first ("i.d-i o t" is one word: runs of single letters are joined).

A sentence is a bag of windows: each of its words, and each two words in a row that are short enough. Its label is that of its document, and a toxic document need only have
one toxic window, so the machine learns from multiple instances: the windows of toxic documents' sentences that score highest are its witnesses, against sentences of other documents.
Documents are dealt to two folds, and the witnesses of each are chosen by the machine of the other, which leaves out what is peculiar to one document.

Landmarks are witnesses and windows of other sentences. Kernel values to them, whitened (Nyström), are the inputs of a linear machine; the whole is a
weight for each triple, so scoring costs the same however many landmarks there are. A text has the value of its most toxic
window, and a logistic curve fitted on the training texts makes it a score.
"""

from __future__ import annotations

import functools
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import free_name, in_slices, table, text_or_empty

DECAY, SPAN, LETTERS = 0.8, 6, 64
LANDMARKS, WHITEN = 1024, 1e-4
#: Labelled rows of each class to learn from, and their code points in all, at most.
TRAIN_ROWS, TRAIN_CHARS = 3000, 12_000_000
#: Letters of a window; longer words are cut into windows, half of which overlap. Two words are a window if they have so many letters in all.
WINDOW, PAIR = 24, 14
#: The value of a text without windows.
FLOOR = -2.0
THRESHOLD = 0.3
SKETCH = 3
#: Witnesses of a toxic text, and forms of each different one that are learned too.
WITNESSES, FORMS, VARIED = 3, 3, 400
#: Windows of other texts to begin with and to add in each round, and rounds of adding them.
OTHERS, HARD, ROUNDS = 1500, 1500, 6
#: What a witness, a changed form of one and another window may weigh in the machine.
WEIGHTS = 50.0, 3.0, 60.0
PASSES = 40
#: Chance of taking any window for an insult that toxic and clean texts have alike, and how frequent an insult may be in clean texts against toxic ones.
CHANCE, RARE = 0.01, 0.01
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Code points of texts whose windows are held as one part.
PART_CHARS = 300_000
#: In the folds, one in so many texts that aren't toxic is used; and one in so many is kept from the machine for the curve.
PART, APART = 4, 5
#: Letters that are looked up at a time.
CHUNK = 1 << 16

#: Positions of the 2nd and 3rd letter after the first.
STEPS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
_LETTER, _WHITE = (np.array([f(chr(p)) for p in range(0x10000)]) for f in (str.isalpha, str.isspace))
#: 0 is the border of a word; ASCII letters have a number each, all others share the rest. Letters beyond the basic plane are dropped.
_CODE = np.array([p - 96 if 97 <= p <= 122 else 27 + p % (LETTERS - 27) for p in range(0x10000)], np.uint8)
#: For each length of a string with its borders, the root of the sum of its triples' squared weights.
NORM = np.sqrt(np.maximum(1e-9, [sum(max(0, n - k) * DECAY ** (2 * k + 2) for _, k in STEPS) for n in range(2 * WINDOW + 4)]))


class Windows:
    """Windows of texts: codes of letters with a border (0) around each word, where windows begin and end in them, and the text each is of."""

    def __init__(self, texts: list[str]) -> None:
        low = [t.lower() + "\n" for t in texts]
        points = np.minimum(np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF).astype(np.uint16)
        of = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in low])
        white = _WHITE[points]
        stop = (points == 33) | (points == 46) | (points == 63)
        stop[:-1] &= white[1:]
        sentence = np.cumsum(stop | (points == 10), dtype=np.int32)
        kept = white | _LETTER[points]
        points, of, sentence, white = points[kept], of[kept], sentence[kept], white[kept]
        first = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        last = np.flatnonzero(~white & np.concatenate([white[1:], [True]])) if len(white) else first
        size = last - first + 1
        # runs of three or more single letters within a sentence are one word
        one = size == 1
        follows = np.concatenate([[False], one[1:] & one[:-1] & (sentence[first[1:]] == sentence[first[:-1]])])[: len(first)]
        run = np.cumsum(~follows) - 1
        joined = follows & (np.bincount(run, minlength=1)[run] > 2) if len(first) else follows
        begins = ~joined
        word = np.cumsum(begins) - 1
        letters = np.flatnonzero(~white)
        size = np.bincount(word, size).astype(np.int64) if len(first) else size
        start = np.cumsum(size + 1) - size  # a border is before each word
        self.codes = np.zeros(int(size.sum()) + len(size) + 1, np.uint8)
        self.codes[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(len(letters))] = _CODE[points[letters]]
        text, sentence = of[first[begins]], sentence[first[begins]]
        cut = np.maximum(1, -(-(size - WINDOW // 2) // (WINDOW // 2)))  # windows of a word
        nth = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
        begin = np.repeat(start - 1, cut) + nth * (WINDOW // 2)
        end = np.minimum(np.repeat(start + size + 1, cut), begin + WINDOW + 2)
        two = np.flatnonzero((sentence[1:] == sentence[:-1]) & (size[1:] + size[:-1] <= PAIR))
        self.begin = np.concatenate([begin, start[two] - 1]).astype(np.int32)
        self.end = np.concatenate([end, start[two + 1] + size[two + 1] + 1]).astype(np.int32)
        self.text = np.concatenate([np.repeat(text, cut), text[two]]).astype(np.int32)
        self.texts = len(texts)

    def values(self, weight: np.ndarray, bias: float = 0.0, steps: list[tuple[int, int]] = STEPS) -> np.ndarray:
        """The machine's value of each window: the weights of its triples over the norm of its length."""
        found = np.zeros(len(self.begin))
        for k in sorted({k for _, k in steps}):
            n = len(self.codes) - k
            if n <= 0:
                continue
            sums = np.zeros(n, np.float32)
            for at in range(0, n, CHUNK):
                c = self.codes[at : at + CHUNK + k].astype(np.int32)
                m = len(c) - k
                for j in [j for j, b in steps if b == k]:
                    sums[at : at + m] += weight[((c[:m] << 6 | c[j : m + j]) << 6) | c[k:]]
            before = np.concatenate([[0.0], np.cumsum(sums * np.float32(DECAY ** (k + 1)), dtype=np.float64)])
            found += np.where(self.end - k > self.begin, before[np.maximum(self.end - k, 0)] - before[np.minimum(self.begin, n)], 0)
        return found / NORM[self.end - self.begin] + bias

    def tops(self, values: np.ndarray) -> np.ndarray:
        """The highest value of each text; FLOOR without one."""
        found = np.full(self.texts, FLOOR)
        np.maximum.at(found, self.text, values)
        return found

    def strings(self, which: np.ndarray) -> list[bytes]:
        return [self.codes[a:b].tobytes() for a, b in zip(self.begin[which].tolist(), self.end[which].tolist(), strict=True)]

    def hashes(self) -> np.ndarray:
        """64 bits of each window's letters."""
        power = np.full(len(self.codes) + 1, BASE, np.uint64)
        back = np.full(len(self.codes) + 1, pow(int(BASE), -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(power[:-1] * (self.codes.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
        found = (sums[self.end] - sums[self.begin]) * back[self.begin]
        return found ^ (found >> np.uint64(32))

    def witnesses(self, values: np.ndarray, texts: np.ndarray, above: float) -> list[bytes]:
        """The windows of texts (flags) that have the highest values, WITNESSES of each at most, all over above."""
        able = np.flatnonzero(texts[self.text] & (values > above))
        order = able[np.lexsort((-values[able], self.text[able]))]
        first = np.concatenate([[True], self.text[order][1:] != self.text[order][:-1]])[: len(order)]
        nth = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
        return self.strings(order[nth < WITNESSES])


@dataclass
class ToxicityModel:
    weight: np.ndarray  # of each triple
    bias: float
    slope: float
    offset: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text. Some texts, or a piece of a long one, are looked at at a time."""
        tops, some, of, size = np.full(len(texts), FLOOR), [], [], 0
        cut = [(k, piece) for k, text in enumerate(texts) for piece in pieces(text)]
        for n, (k, piece) in enumerate(cut):
            some.append(piece)
            of.append(k)
            size += len(piece)
            if size >= PART_CHARS or n + 1 == len(cut):
                windows = Windows(some)
                np.maximum.at(tops, of, windows.tops(windows.values(self.weight, self.bias)))
                some, of, size = [], [], 0
        return 1 / (1 + np.exp(-(self.slope * tops + self.offset)))


def pieces(text: str, most: int = PART_CHARS) -> Iterator[str]:
    """A long text cut after a line or a sentence; where none ends in the second half of a piece, at a space, and the next piece then begins some words before it, so that no window is lost."""
    at = 0
    while len(text) - at > most:
        half, end = at + most // 2, at + most
        if (cut := 1 + max(text.rfind("\n", half, end), text.rfind(". ", half, end))) > 0:
            yield text[at:cut]
            at = cut
            continue
        cut = 1 + text.rfind(" ", half, end)
        yield text[at : cut or end]
        at = 1 + text.rfind(" ", half, max(half, cut - 100)) or cut or end - 2 * WINDOW
    yield text[at:]


@functools.lru_cache(8_000)
def vector(string: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Codes and weights of a string's triples, borders included, over the norm of its length."""
    c = np.frombuffer(string, np.uint8).astype(np.int64)
    codes = np.concatenate([((c[: len(c) - k] << 6 | c[j : len(c) - k + j]) << 6) | c[k:] for j, k in STEPS if len(c) > k] or [np.zeros(0, np.int64)])
    weights = np.concatenate([np.full(len(c) - k, DECAY ** (k + 1)) for _, k in STEPS if len(c) > k] or [np.zeros(0)])
    codes, which = np.unique(codes, return_inverse=True)
    return codes, np.bincount(which, weights, len(codes)) / NORM[len(c)]


def _machine(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = PASSES) -> tuple[np.ndarray, float]:
    """A linear support vector machine by dual coordinate descent. c: the most that each row may weigh. The last input is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, alpha, size = np.zeros(x.shape[1]), np.zeros(len(x)), np.einsum("ij,ij->i", x, x)
    draw = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in draw.permutation(len(x)):
            gap = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - gap / size[i], 0.0), c[i])
            if new != alpha[i]:
                moved = max(moved, abs(new - alpha[i]))
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
        if moved < 0.01:
            break
    return w[:-1], float(w[-1])


def _nystrom(landmarks: list[bytes], strings: list[bytes], y: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
    """A weight for each triple, and the bias, of a machine whose inputs are whitened kernel values to landmarks."""
    base = [vector(w) for w in landmarks]
    known = np.unique(np.concatenate([codes for codes, _ in base]))
    wide = np.zeros((len(base), len(known)), np.float32)
    for row, (codes, weights) in enumerate(base):
        wide[row, np.searchsorted(known, codes)] = weights
    cross = np.zeros((len(strings), len(base)))
    for row, string in enumerate(strings):
        codes, weights = vector(string)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        there = known[at] == codes
        cross[row] = wide[:, at[there]] @ weights[there]
    values, axes = np.linalg.eigh((wide @ wide.T).astype(np.float64))
    white = axes / np.sqrt(np.maximum(values, WHITEN)) @ axes.T
    w, bias = _machine(cross @ white, y, c)
    weight = np.zeros(LETTERS**3, np.float32)
    weight[known] = (white @ w) @ wide
    return weight, bias


def sketch(text: str) -> list[tuple[int, int]]:
    """The smallest hash of a text's word pairs, under each of SKETCH hashes: near copies most likely share one, other texts hardly ever."""
    row = text.lower().split()
    pairs = {zlib.crc32(f"{a} {b}".encode("utf-8", "replace")) for a, b in zip(row, row[1:], strict=False)} or {0}
    own = np.fromiter(pairs, np.uint64, len(pairs))
    return [(k, int(((own * np.uint64(2 * k + 0x9E3779B1)) % np.uint64(0xFFFFFFFB)).min())) for k in range(SKETCH)]


def changed(strings: list[bytes]) -> list[bytes]:
    """Forms of each string with a letter put in or, from five letters on, left out."""
    draw, found = np.random.default_rng(11), []
    for w in strings:
        for _ in range(FORMS):
            at = int(draw.integers(2, max(3, len(w) - 1)))
            found.append(w[:at] + bytes([1 + int(draw.integers(26))]) + w[at:])
        if len(w) > 6:
            at = int(draw.integers(2, len(w) - 2))
            found.append(w[:at] + w[at + 1 :])
    return found


class Bags:
    """The windows of many texts, in parts of a bounded number of code points, so that only one part's values are held at a time."""

    def __init__(self, texts: list[str]) -> None:
        self.parts: list[tuple[slice, Windows]] = []
        first, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text)
            if size >= PART_CHARS or k + 1 == len(texts):
                self.parts.append((slice(first, k + 1), Windows(texts[first : k + 1])))
                first, size = k + 1, 0

    def witnesses(self, weight: np.ndarray, bias: float, texts: np.ndarray, steps: list[tuple[int, int]] = STEPS) -> list[bytes]:
        return [w for at, part in self.parts if texts[at].any() for w in part.witnesses(part.values(weight, bias, steps), texts[at], 0.0)]

    def evident(self, toxic: np.ndarray, clean: np.ndarray) -> list[bytes]:
        """Windows that toxic texts share and clean ones (flags) don't, each as often as toxic texts have it.

        By the bound for as many toxic texts among those with a window, if toxic and clean ones had it alike: it must be below CHANCE for all windows together. In clean texts a window may be
        RARE times as frequent at most.
        """

        def seen(flags: np.ndarray, among: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            for at, part in self.parts:
                own = flags[at][part.text]
                h, text = part.hashes()[own], part.text[own]
                if among is not None:
                    inside = np.isin(h, among)
                    h, text = h[inside], text[inside]
                order = np.lexsort((text, h))
                h, text = h[order], text[order]
                once = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])[: len(h)]
                both, where = np.unique(np.concatenate([held[0], h[once]]), return_inverse=True)
                held = both, np.bincount(where, np.concatenate([held[1], np.ones(int(once.sum()), np.int64)]), len(both)).astype(np.int64)
            return held

        which, n = seen(toxic, None)
        tested, which, n = len(which), which[n > 2], n[n > 2]
        found, m = seen(clean, which)
        less = np.zeros(len(which), np.int64)
        less[np.searchsorted(which, found)] = m
        share, part = toxic.sum() / (toxic.sum() + clean.sum()), n / (n + less)
        gain = n * np.log(part / share) + less * np.log(np.maximum(1 - part, 1e-300) / (1 - share))
        kept = (part > share) & (gain > np.log(tested / CHANCE)) & (less / clean.sum() <= RARE * n / toxic.sum())
        times = dict(zip(which[kept].tolist(), n[kept].tolist(), strict=True))
        strings: dict[bytes, int] = {}
        for at, part in self.parts:
            h = part.hashes()
            new = np.flatnonzero(np.isin(h, which[kept]) & toxic[at][part.text])
            strings.update(zip(part.strings(new), (times[x] for x in h[new].tolist()), strict=True))
        # two words say nothing new where one of them is evident
        own = [w for w in strings if len(w[1:-1].split(b"\0")) == 1 or not any(b"\0" + part + b"\0" in strings for part in w[1:-1].split(b"\0"))]
        return [w for w in sorted(own) for _ in range(strings[w])]

    def tops(self, weight: np.ndarray, bias: float) -> np.ndarray:
        return np.concatenate([part.tops(part.values(weight, bias)) for _, part in self.parts])

    def some(self, texts: np.ndarray, most: int) -> set[bytes]:
        """About so many windows of texts (flags), drawn at random."""
        draw = np.random.default_rng(5)
        able = [np.flatnonzero(texts[at][part.text]) for at, part in self.parts]
        share = min(1.0, most / max(1, sum(map(len, able))))
        return {w for (_, part), a in zip(self.parts, able, strict=True) for w in part.strings(a[draw.random(len(a)) < share])}

    def hard(self, weight: np.ndarray, bias: float, texts: np.ndarray, known: set[bytes]) -> list[bytes]:
        """The windows of texts (flags) with the highest values, HARD at most, all over -0.8 and not known."""
        best: dict[bytes, float] = {}
        for at, part in self.parts:
            values = part.values(weight, bias)
            near = np.flatnonzero(texts[at][part.text] & (values > -0.8))
            near = near[np.argsort(-values[near], kind="stable")[: 4 * HARD]]
            best.update((w, v) for w, v in zip(part.strings(near), values[near].tolist(), strict=True) if w not in known)
            best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:HARD])
        return list(best)


def first_guess(bags: Bags, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """For each triple in a row, the log-odds that a toxic text has it (flags), where that is above 0 and three of them do."""
    n = np.zeros((2, LETTERS**3))
    for at, part in bags.parts:
        c = part.codes.astype(np.int64)
        codes = (c[:-2] << 6 | c[1:-1]) << 6 | c[2:]
        text = np.zeros(len(c), np.int64)
        text[part.begin] = part.text
        seen = np.unique(np.maximum.accumulate(text)[: len(codes)] * LETTERS**3 + codes)
        of, code = seen // LETTERS**3, seen % LETTERS**3
        for k, flag in enumerate((toxic, clean)):
            n[k] += np.bincount(code[flag[at][of]], minlength=LETTERS**3)
    odds = np.log((n[0] + 0.5) / (toxic.sum() + 1)) - np.log((n[1] + 0.5) / (clean.sum() + 1))
    return np.where((n[0] > 2) & (odds > 0), odds, 0).astype(np.float32)


def _train(bags: Bags, pos: list[bytes], clean: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """The machine of witnesses against windows of clean texts, to which those that score highest are added round by round."""
    seen = Counter(pos)
    often = sorted(seen, key=lambda w: (-seen[w], w))
    bad = sorted(bags.some(clean, OTHERS) - set(often))
    forms = changed(often[:VARIED])
    landmarks = often[: LANDMARKS * 3 // 4] + bad[: LANDMARKS // 4]
    good = often + forms
    for _ in range(rounds):
        y = np.array([1.0] * len(good) + [-1.0] * len(bad))
        c = np.array([WEIGHTS[0] * min(8, seen[w]) / 8 for w in often] + [WEIGHTS[1]] * len(forms) + [WEIGHTS[2]] * len(bad))
        weight, bias = _nystrom(landmarks, good + bad, y, c)
        hard = bags.hard(weight, bias, clean, set(bad))
        if not hard:
            break
        bad = bad + hard
    return weight, bias


def fit(texts: list[str], toxic: list[int]) -> ToxicityModel:
    """From whole texts and their labels. With one class only, or no witnesses, all texts score alike: the part of toxic ones."""
    part = (sum(toxic) + 0.5) / (len(toxic) + 1)
    blank = ToxicityModel(np.zeros(LETTERS**3, np.float32), FLOOR, 0.0, float(np.log(part / (1 - part))))
    if not 0 < sum(toxic) < len(toxic):
        return blank
    y, new, met = np.array(toxic, bool), [], set()
    for text in texts:
        own = sketch(text)
        new.append(met.isdisjoint(own))
        met.update(own)
    some = np.sort(np.concatenate([np.flatnonzero(y & np.array(new)), np.flatnonzero(~y)[::PART]]))
    clean, rows = ~y[some], np.flatnonzero(y[some])
    bags = Bags([texts[i] for i in some])
    folds = [np.isin(np.arange(len(some)), rows[k::2]) for k in (0, 1)]
    found = [bags.evident(f, clean) or bags.witnesses(first_guess(bags, f, clean), 0.0, f, [(1, 2)]) for f in folds]
    for _ in range(2):
        machines = [_train(bags, pos, clean, 2) if pos else None for pos in found]
        found = [bags.witnesses(*m, f) if m else [] for m, f in zip(machines[::-1], folds, strict=True)]
    bags = Bags(texts)
    pos = found[0] + found[1] + bags.evident(y & np.array(new), ~y)
    if not pos:
        return blank
    # one in APART of the texts that aren't toxic teaches the machine nothing and the curve how such texts score
    apart = np.zeros(len(y), bool)
    apart[np.flatnonzero(~y)[::APART]] = True
    weight, bias = _train(bags, pos, ~y & ~apart, ROUNDS)
    # the curve: each text by its most toxic window, with the targets of Platt
    use = y | apart
    many = np.where(y, 1.0, (~y).sum() / apart.sum())[use]
    top, y = bags.tops(weight, bias)[use], y.astype(int)
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))[use]
    a, b = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        g, h = many * (p - target), many * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * top).sum() + 1e-3 * a, g.sum()])
        hess = np.array([[(h * top * top).sum() + 1e-3, (h * top).sum()], [(h * top).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -2, 2)), b - float(np.clip(step[1], -2, 2))
    return ToxicityModel(weight, bias, a, b)


def held_out(row_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> ToxicityModel:
    """Fits on a bounded sample of the labelled rows that aren't held out: rows of each class at most, and chars code points in all. The sample is by a hash of the id; rows that don't fit any more are left out of it."""
    known = labels.where("toxic is not null").groupBy(F.col(row_id).alias("_id")).agg(F.max("toxic").alias("_toxic"))
    slim = docs.select(F.col(row_id).alias("_id"), F.length(text_or_empty(text)).alias("_size")).where(~held_out("_id"))
    sized = slim.join(known, "_id")
    chosen = []
    for label in (0, 1):
        left = chars // 2
        for r in sized.where((F.col("_toxic") == label) & (F.col("_size") <= left)).orderBy(F.xxhash64("_id"), "_id").limit(rows).collect():
            if r["_size"] <= left:
                left -= r["_size"]
                chosen.append((r["_id"], label))
    ids = docs.sparkSession.createDataFrame(pa.table({"_id": pa.array([i for i, _ in chosen], pa.int64()), "_toxic": pa.array([x for _, x in chosen], pa.int32())}))  # a list would start workers of another kind
    found = docs.select(F.col(row_id).alias("_id"), text_or_empty(text).alias("_text")).join(F.broadcast(ids), "_id").dropDuplicates(["_id"]).orderBy("_id").collect()
    return fit([r["_text"] for r in found], [r["_toxic"] for r in found])


def with_score(df: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """df with the toxicity of each whole text, 0 to 1; null and empty texts have the lowest score there is. A column of that name is replaced."""
    kept = df.drop(out)
    columns, schema = kept.columns, T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in in_slices(batches, 128):
            found = model.scores(batch.column(len(columns)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], names=[*columns, out])

    return kept.withColumn(free_name(kept, "_whole"), text_or_empty(text)).mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, learn(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
