"""Conditional random fields over the white-space tokens of a text: features, training, and exact pruning.

Labels are 0 (outside) and kinds above. A token's features come from its own shape, from the classes of its
neighbours and from its file; every potential is a sum of weights; those of neighbours, files and label pairs are
bounded, so that a token's own shape can settle its label. Weights are fitted by full-batch gradient ascent on a
conditional likelihood in two pieces: chains are the windows of a bounded sample and altered copies of them; linked
tokens give the weights of agreeing labels, by the likelihood of the second one's label given the first one's.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\S+")
BUCKETS = 1 << 14  # of own features
CLASSES = 10
EDGE, WORD, KEY, SIGN, FEW, LONG, AT, PUNCT, PLUS, BRACKET = range(CLASSES)
FILES = 4
#: Weight rows: own buckets, class before, class after, file bucket, and one of zeros for padding.
BEFORE, AFTER, FILE, NONE = BUCKETS, BUCKETS + CLASSES, BUCKETS + 2 * CLASSES, BUCKETS + 2 * CLASSES + FILES
ROWS = NONE + 1
PRIOR = 30.0
MOST = 16  # own features of a token
RADIUS = 4  # of a window
LONGEST = 1000  # characters of a token in a window

#: Words that announce a secret.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "credential", "bearer", "private")

#: Spellings of the signs of a mail address.
SPELT = ("[at]", "(at)", "{at}", "[dot]", "(dot)", "{dot}")

#: What sets a token apart from plain words and marks; see token_class.
SPECIAL_CHARS = "0123456789@=:"


def special(text: str) -> bool:
    """Whether a text may hold a token that is no plain word or mark."""
    if any(c in text for c in SPECIAL_CHARS):
        return True
    low = text.lower()
    return any(k in low for k in KEYWORDS) or any(k in low for k in SPELT)


_RUNS = re.compile(r"(.)\1+")
_UPPER, _LOWER, _DIGIT = re.compile(r"[^\W\d_a-zà-öø-ÿ]"), re.compile(r"[a-zà-öø-ÿ]"), re.compile(r"[0-9]")


def shape(token: str) -> str:
    """Letters to a or A, digits to 9, runs to one; the first 24 runs."""
    return _RUNS.sub(r"\1", _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", token[:256]))))[:24]


def token_class(token: str, digits: int) -> int:
    if "@" in token or any(k in token.lower() for k in SPELT):
        return AT
    if digits:
        return PLUS if token[0] == "+" else BRACKET if token[0] == "(" else LONG if len(token) >= 12 else FEW
    low = token.lower()
    if any(k in low for k in KEYWORDS):
        return KEY
    if low in ("=", ":", ":=", "=>"):
        return SIGN
    return WORD if any(c.isalpha() for c in token) else PUNCT


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


TRIM = "\"'`,;:=()[]{}<>!?.*#%&$|"
_PARTS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]")
_LETTERS = re.compile(r"[a-z]+")
_OTHER = re.compile(r"[a-zA-Z0-9]+")


def describe(token: str) -> tuple[list[int], int]:
    """Buckets of a token's own features, and its class."""
    digits = sum(c in "0123456789" for c in token)
    kind = token_class(token, digits)
    n = len(token)
    names = [f"k{kind}"]
    if kind not in (WORD, PUNCT):
        core = token.strip(TRIM) or token
        m = len(core)
        low = core.lower()
        names += [f"d{min(digits, 24) // 2}", f"m{min(9, digits * 10 // n)}", f"n{min(m, 48) // 4}"]
        names.append("s" + shape(token))
        names.append(f"h{all(c in '0123456789abcdef' for c in core)}{m >= 16}")
        names.append("p" + re.sub("[0-9]", "9", token[:4]))
        names.append(f"v{'=' in token}{any(k in low for k in KEYWORDS)}")
        names.append(f"o{token.count('.')}{token.count('-')}{min(token.count(':'), 9)}")
        kinds = f"{any(c.isupper() for c in core):d}{any(c.islower() for c in core):d}{any(c in '0123456789' for c in core):d}"
        names.append(f"c{kinds}{min(m, 48) // 8}")
        names.append(f"t{kinds}{min(9, len(_PARTS.findall(core)) * 10 // m)}{m >= 12}")
        names.append(f"e{len(set(core)) * 8 // m}{min(m, 48) // 8}")
        names.append(f"z{min(8, max(map(len, _LETTERS.findall(low)), default=0))}{min(m, 32) // 8}")
        names.append("w" + "".join(sorted(set(_OTHER.sub("", core))))[:6] + str(m >= 16))
        names.append(f"l{'://' in low or low.startswith('www.')}{'/' in core}")
        number = 13 <= digits <= 19 and not any(c.isalpha() for c in core)
        names.append(f"u{number}{number and luhn(''.join(c for c in core if c in '0123456789'))}")
    return [zlib.crc32(x.encode()) % BUCKETS for x in names], kind


@dataclass
class Weights:
    rows: np.ndarray  # ROWS x labels
    trans: np.ndarray  # labels x labels; outside stands at both ends of a text
    skip: np.ndarray  # by label, for alike and for equal tokens that both have it


@dataclass
class Window:
    """Tokens around a place, with one more at either end for its class; None stands beyond the text."""

    words: list[str | None]
    tags: list[int]
    file: int

    def with_words(self, changes: dict[int, str], tags: dict[int, int]) -> Window:
        """A copy with other tokens and labels at some places."""
        return Window([changes.get(i, w) for i, w in enumerate(self.words)], [tags.get(i, t) for i, t in enumerate(self.tags)], self.file)


SPAN = RADIUS + 1  # the place in the middle of a window


def windows_of(words: list[str], tags: list[int], seed: int, plain: int = 6, most: int = 64) -> list[Window]:
    """Windows around at most ``most`` places of a text: labelled tokens, special ones, and ``plain`` random ones. Windows with a token over LONGEST characters are left out."""
    rng = random.Random(seed)
    kinds = [describe(w)[1] if special(w) else WORD for w in words]
    hot = [i for i, k in enumerate(kinds) if tags[i] or k not in (WORD, PUNCT)]
    some = [rng.randrange(len(words)) for _ in range(min(len(words), plain))] if words else []
    picks = sorted({*(rng.sample(hot, most - plain) if len(hot) > most - plain else hot), *some})
    file = file_bucket(kinds)
    pad = [None] * SPAN
    around, labels = [*pad, *words, *pad], [*[0] * SPAN, *tags, *[0] * SPAN]
    out = [Window(around[i : i + 2 * SPAN + 1], labels[i : i + 2 * SPAN + 1], file) for i in picks]
    return [w for w in out if all(x is None or len(x) <= LONGEST for x in w.words)]


def sampled(docs: DataFrame, hint: Column, labelled: Callable[[str], tuple[list[str], list[int]]], texts: int, windows: int) -> list[Window]:
    """At most ``windows`` windows of at most ``texts`` different whole texts, half of the texts with the hint.

    Those with the smallest hashes are taken, so copies of a text count once. Texts stay on the executors; only windows reach the driver.
    """
    rows = docs.select("text").where("text is not null").select("text", F.xxhash64("text").alias("h"), hint.alias("hint"))

    def last(df: DataFrame) -> int | None:
        return df.select("h").distinct().orderBy("h").limit(max(1, texts // 2)).agg(F.max("h")).first()[0]  # only hashes are shuffled

    a, b = last(rows.where("hint")), last(rows)
    if b is None:
        return []
    few = rows.where((F.col("h") <= b) | (F.col("hint") & (F.col("h") <= (b if a is None else a))))
    once = few.groupBy("h").agg(F.first("text").alias("text"))  # at most ``texts`` rows

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h, text in zip(batch["h"], batch["text"], strict=True):
                found = windows_of(*labelled(text), h)
                order = random.Random(h)
                if found:
                    yield pd.DataFrame({"k": [order.getrandbits(62) for _ in found], "words": [w.words for w in found], "tags": [w.tags for w in found], "file": [w.file for w in found]})

    got = once.mapInPandas(cut, "k long, words array<string>, tags array<int>, file int").orderBy("k").limit(windows).collect()
    return [Window(list(r["words"]), list(r["tags"]), r["file"]) for r in got]


@dataclass
class Pairs:
    """Linked places of windows: the middles of ``first`` and ``second``; ``equal`` tells equal tokens from alike ones."""

    first: list[Window] = field(default_factory=list)
    second: list[Window] = field(default_factory=list)
    equal: list[bool] = field(default_factory=list)

    def add(self, a: Window, b: Window, equal: bool) -> None:
        self.first.append(a), self.second.append(b), self.equal.append(equal)


def encoded(windows: list[Window]) -> tuple[np.ndarray, np.ndarray]:
    """Weight rows of every place of every window, and its label; places beyond a text have the padding row."""
    known: dict[str, tuple[list[int], int]] = {}
    width = 2 * RADIUS + 1
    x, y = np.full((len(windows), width, MOST + 3), NONE), np.zeros((len(windows), width), np.int64)
    for k, w in enumerate(windows):
        for word in w.words:
            if word is not None and word not in known:
                known[word] = describe(word)
        kinds = [EDGE if word is None else known[word][1] for word in w.words]
        for j in range(width):
            word = w.words[j + 1]
            if word is not None:
                own = known[word][0]
                x[k, j, : len(own)] = own
                x[k, j, MOST:] = BEFORE + kinds[j], AFTER + kinds[j + 2], FILE + w.file
                y[k, j] = w.tags[j + 1]
    return x, y


def fit(windows: list[Window], kinds: int, pairs: Pairs | None = None, steps: int = 60, bound: float = 1.0, strongest: float = 8.0) -> Weights:
    """Weights from labelled windows and linked pairs; agreeing labels of a pair weigh at most ``strongest``."""
    trans, rows, skip = np.zeros((kinds, kinds)), np.zeros((ROWS, kinds)), np.zeros((2, kinds))
    fixed = [zlib.crc32(f"k{kind}".encode()) % BUCKETS for kind in (WORD, PUNCT)]
    rows[fixed, 0] = PRIOR  # plain words and marks stand outside
    if not windows:
        return Weights(rows - rows[:, :1], trans, skip)
    x, y = encoded(windows)
    n, width = y.shape
    pairs = pairs if pairs and pairs.first else Pairs([windows[0]], [windows[0]], [True])
    (_, ya), (xb, yb) = encoded(pairs.first), encoded(pairs.second)
    la, lb, kind = np.eye(kinds)[ya[:, RADIUS]], np.eye(kinds)[yb[:, RADIUS]], np.array(pairs.equal, np.int64)
    # places that are described alike share their sums
    places, of = np.unique(np.concatenate([x.reshape(n * width, -1), xb[:, RADIUS]]), axis=0, return_inverse=True)
    of = of.ravel()
    in_chain, in_b = of[: n * width], of[n * width :]
    seen = np.eye(kinds)[y]
    params = [rows, trans]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def summed(at: np.ndarray, d: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, d[:, k], size) for k in range(kinds)], 1)

    for step in range(1, steps + 1):
        emit = rows[places].sum(1)
        node, pair = marginals(emit[in_chain].reshape(n, width, kinds), trans)
        gt = (np.einsum("nti,ntj->ij", seen[:, :-1], seen[:, 1:]) - pair) / n
        each = summed(in_chain, (seen - node).reshape(n * width, kinds), len(places)) / n
        g = summed(places.ravel(), np.repeat(each, places.shape[1], axis=0), ROWS)
        g[[*fixed, NONE]] = 0
        for p, gr, a, b in zip(params, (g, gt), m, v, strict=True):
            a += 0.1 * (gr - a)
            b += 0.01 * (gr * gr - b)
            p += 0.2 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        rows *= 1 - 1e-4
        np.clip(trans, -bound, bound, out=trans)
        np.clip(rows[BEFORE:NONE], -bound, bound, out=rows[BEFORE:NONE])
    # the second of a pair given the label of the first: one weight a label and kind of link, by Newton's method
    emit = rows[places].sum(1)[in_b]
    for _ in range(40):
        given = np.exp((e := emit + la * skip[kind]) - e.max(1, keepdims=True))
        given /= given.sum(1, keepdims=True)
        slope, bend = summed(kind, la * (lb - given), 2), summed(kind, la * given * (1 - given), 2)
        skip = np.clip(skip + np.clip(slope / (bend + 1e-3), -1, 1), 0, strongest)
    rows -= rows[:, :1]  # only differences count
    return Weights(rows, trans, skip)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Node marginals (n, length, labels) and the expected number of label pairs, by forward-backward."""
    n, length, k = emit.shape
    f, b = np.zeros_like(emit), np.zeros_like(emit)
    f[:, 0] = emit[:, 0]
    for t in range(1, length):
        f[:, t] = emit[:, t] + logsum(f[:, t - 1][:, :, None] + trans, 1)
    for t in range(length - 2, -1, -1):
        b[:, t] = logsum(trans + (emit[:, t + 1] + b[:, t + 1])[:, None, :], 2)
    z = logsum(f[:, -1], 1)
    pair = np.zeros((k, k))
    for t in range(length - 1):
        pair += np.exp(f[:, t][:, :, None] + trans + (emit[:, t + 1] + b[:, t + 1])[:, None, :] - z[:, None, None]).sum(0)
    return np.exp(f + b - z[:, None, None]), pair


def numberlike(token: str) -> bool:
    """Whether a token holds a digit or an @."""
    return "@" in token or _DIGIT.search(token) is not None


def file_bucket(classes: Iterable[int]) -> int:
    """Features of a whole text: whether it announces secrets, whether it holds numbers."""
    c = set(classes)
    return (KEY in c) + 2 * bool(c & {LONG, AT, PLUS})


class Table(dict):
    """Ids of tokens; by id: the own potentials, the class, and whether the token may be anything but outside.

    A token is ``sure`` when no neighbours, file or labels beside it can outweigh its own potential for outside:
    changing it to outside then raises the score of any labelling, so every best labelling has it outside and
    decoding the other tokens alone is exact.
    """

    LIMIT = 1 << 18

    def __init__(self, w: Weights, always: Callable[[int], bool] = lambda kind: False):
        super().__init__()
        self.w, self.always = w, always
        gain = lambda a: (a[:, 1:].max(1) - a[:, 0]).max()
        swing = w.trans.max() - w.trans.min()
        self.margin = 2 * swing + sum(max(0.0, gain(w.rows[a:b])) for a, b in ((BEFORE, AFTER), (AFTER, FILE), (FILE, NONE)))
        self.plain = {}
        for kind, token in ((WORD, "a"), (PUNCT, "-")):
            own, found = describe(token)
            e = self.w.rows[own].sum(0)
            self.plain[kind] = (e, self.always(found) or e[1:].max() - e[0] >= -self.margin)
        #: Texts without special tokens have nothing to decode.
        self.skips = not any(is_open for _, is_open in self.plain.values())
        self._fresh()

    def _fresh(self) -> None:
        self.clear()
        self.emit, self.kind, self.open = np.zeros((1 << 12, self.w.rows.shape[1])), np.zeros(1 << 12, np.int8), np.zeros(1 << 12, bool)

    def room(self) -> None:
        """Forget all tokens when there are too many; only between texts."""
        if len(self) > self.LIMIT:
            self._fresh()

    def __missing__(self, token: str) -> int:
        i = len(self)
        if i == len(self.kind):
            self.emit, self.kind, self.open = np.r_[self.emit, np.zeros_like(self.emit)], np.r_[self.kind, np.zeros_like(self.kind)], np.r_[self.open, np.zeros_like(self.open)]
        if special(token):
            own, kind = describe(token)
            e = self.w.rows[own].sum(0)
            is_open = self.always(kind) or e[1:].max() - e[0] >= -self.margin
        else:  # all plain tokens of a class are described alike
            kind = WORD if token[0].isalpha() or any(c.isalpha() for c in token) else PUNCT
            e, is_open = self.plain[kind]
        self.emit[i], self.kind[i], self.open[i] = e, kind, is_open
        self[token] = i
        return i

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def potentials(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Emission potentials of the tokens at places ``at`` of a text."""
        kinds = np.r_[EDGE, self.kind[ids].astype(np.int64), EDGE]
        e = self.emit[ids[at]] + self.w.rows[BEFORE + kinds[at]] + self.w.rows[AFTER + kinds[at + 2]]
        return e + self.w.rows[FILE + file_bucket(np.unique(kinds[1:-1]).tolist())]


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best labels of a run of tokens with outside on either side."""
    n, k = emit.shape
    back = np.zeros((n, k), np.int64)
    s = emit[0] + trans[0]
    for t in range(1, n):
        step = s[:, None] + trans
        back[t] = step.argmax(0)
        s = step.max(0) + emit[t]
    out = np.zeros(n, np.int64)
    out[-1] = int((s + trans[:, 0]).argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out
