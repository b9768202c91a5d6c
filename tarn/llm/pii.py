"""Personal data: base patterns, and a skip-chain conditional random field that adds spans to them.

Tokens carry a label (outside, email, ip, card, phone). Neighbours share chain potentials; tokens of a document that are
equal, or alike in shape and beginning, share skip potentials that favour one label however far apart they
stand; their weights are fitted with the rest, as pieces of the likelihood. Loopy belief propagation runs over all documents
of a batch at once, each until its own messages settle. Each token is linked to the next of its group only, so a group of n
tokens has n - 1 links. Tokens that a base pattern covers are observed: the field spreads their labels, it can't change them.

The field learns from windows of a bounded sample labelled by the base patterns, and from altered copies with other
forms of such data or harmless tokens (``forms``), so that it goes beyond the patterns.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import crf, forms
from tarn.llm.crf import luhn
from tarn.llm.secret_scan import span_text

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match starts where a run of digits starts: the look-behind changes no match and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
LINKED = frozenset((crf.FEW, crf.LONG, crf.AT, crf.PLUS, crf.BRACKET))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of local@domain, found from each @ outwards."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, in code points, by kind and start."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def labelled(text: str) -> tuple[list[str], list[int]]:
    spans, tokens, tags, k = sorted(base_spans(text)), [], [], 0
    for m in crf.TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        tokens.append(m[0])
        tags.append(spans[k][2] + 1 if k < len(spans) and spans[k][0] < m.end() else 0)
    return tokens, tags


EDGES = "\"'`,;:()[]{}<>!#*%&$|."
#: Phone numbers may begin with a bracket.
LEFT = {3: "\"'`,;:)[]{}<>!#*%&$|."}


def address(piece: str) -> bool:
    try:
        ipaddress.ip_address(piece)
    except ValueError:
        return False
    return True


def plausible(piece: str, kind: int) -> bool:
    """What a found span of a kind must be whatever the field says: an address, a card's checksum, a phone's digits."""
    digits = "".join(DIGIT.findall(piece))
    if kind == 0:
        return crf.describe(piece)[1] == crf.AT and not piece.startswith("@")
    if kind == 1:
        return address(piece)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in piece)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in piece)


def alike(token: str) -> str:
    """Key of tokens that are similar: the shape and the first three characters."""
    return crf.shape(token) + "\0" + token[:3]


def altered(window: crf.Window, r: random.Random) -> crf.Window:
    """A copy with personal data of another form in its middle, or a harmless token."""
    mid = crf.SPAN
    if r.random() < 0.5:
        words = {mid: forms.card_number(r, valid=False) if r.random() < 0.1 else forms.harmless(r)}
        if r.random() < 0.4:
            words[mid + 1] = forms.harmless(r)
        return window.with_words(words, {})
    kind = r.randrange(len(KINDS))
    parts = forms.spoken(r, forms.personal_value(r, kind))
    at = mid - r.randrange(len(parts))
    return window.with_words({at + i: w for i, w in enumerate(parts)}, {at + i: kind + 1 for i in range(len(parts))})


def pairs_of(found: list[crf.Window], plain: list[crf.Window], r: random.Random, most: int) -> crf.Pairs:
    """Linked places: a token of a window again amid other words, where nothing but the link tells its label; and alike tokens with labels of their own."""
    mid, out = crf.SPAN, crf.Pairs()
    known = [w for w in found if w.words[mid] and crf.numberlike(w.words[mid])]
    personal = [w for w in known if w.tags[mid]]
    if not plain:
        return out
    for _ in range(most):
        which = r.random()
        if which < 0.7 and known:
            a = r.choice(personal if which < 0.5 and personal else known)
        else:
            a = altered(r.choice(plain), r)
        token, tag = a.words[mid], a.tags[mid]
        if not token or not crf.numberlike(token):
            continue
        if r.random() < 0.6:
            out.add(a, r.choice(plain).with_words({mid: token}, {mid: tag}), True)
        else:  # a token alike: the last digits are others, so a checksum may fail
            other = token[:3] + "".join(r.choice("0123456789") if c in "0123456789" else c for c in token[3:])
            digits = "".join(DIGIT.findall(other))
            of_kind = tag and r.random() < 0.8 and (tag != 3 or (13 <= len(digits) <= 19 and luhn(digits)))
            out.add(a, r.choice(plain).with_words({mid: other}, {mid: tag if of_kind else 0}), False)
    return out


def train(docs: DataFrame, texts: int = 1200, windows: int = 3000, copies: int = 5000, links: int = 4000, seed: int = 5) -> crf.Weights:
    """Weights from at most ``windows`` windows of at most ``texts`` different whole texts, ``copies`` altered ones and ``links`` linked pairs; a bounded sample for training only."""
    hint = F.col("text").contains("@") | F.col("text").rlike("[0-9+][0-9.][0-9a-f. ()-]{6}")
    return fitted(crf.sampled(docs, hint, labelled, texts, windows), copies, links, seed)


def fitted(found: list[crf.Window], copies: int = 5000, links: int = 4000, seed: int = 5) -> crf.Weights:
    """Weights from windows, ``copies`` altered copies of those without personal data, and ``links`` pairs."""
    r = random.Random(seed)
    plain = [w for w in found if not any(w.tags) and all(w.words)]
    made = [altered(r.choice(plain), r) for _ in range(copies if plain else 0)]
    return crf.fit(found + made, len(KINDS) + 1, pairs_of(found, plain, r, links))


def propagate(unary: np.ndarray, edges: np.ndarray, kind: np.ndarray, pots: np.ndarray, doc: np.ndarray | None = None, rounds: int = 1000, damp: float = 0.3) -> np.ndarray:
    """Beliefs (nodes, labels) by loopy sum-product; edge i joins edges[i] with the potential pots[kind[i]].

    ``doc`` is the document of each node: its messages pass until they settle, whatever other documents need. ``rounds`` ends
    loops that never settle.
    """
    if not len(edges):
        return unary
    a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    pot = np.concatenate([pots[kind], pots[kind].transpose(0, 2, 1)])  # from label, to label
    back = np.r_[np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))]
    doc = np.zeros(len(unary), np.int64) if doc is None else doc
    of = doc[a]
    msg = np.zeros((len(a), unary.shape[1]))
    belief = unary.copy()
    live = np.arange(len(a))
    for _ in range(rounds):
        new = crf.logsum((belief[a[live]] - msg[back[live]])[:, :, None] + pot[live], 1)
        new -= new.max(1, keepdims=True)
        step = (1 - damp) * (new - msg[live])
        msg[live] += step
        np.add.at(belief, b[live], step)
        moved = np.zeros(int(doc.max()) + 1, bool)
        np.logical_or.at(moved, of[live], np.abs(step).max(1) > 1e-3)
        live = live[moved[of[live]]]
        if not len(live):
            break
    return belief


#: Log odds of the label of a token that a base pattern covers.
OBSERVED = 30.0


def added_spans(texts: list[str], table: crf.Table, base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text, the spans that the field finds and that touch no base span."""
    trans, skip = table.w.trans, table.w.skip
    unary, edges, kinds, docs, where, count = [], [], [], [], [], 0
    for d, text in enumerate(texts):
        if table.skips and not crf.special(text):
            continue
        words = text.split()
        ids = table.ids(words)
        at = table.open[ids].nonzero()[0]
        if not len(at):
            continue
        u = table.potentials(ids, at)
        near = np.diff(at) == 1
        u[np.r_[True, ~near]] += trans[0]  # outside before
        u[np.r_[~near, True]] += trans[:, 0]
        if base[d]:
            place = {int(i): j for j, i in enumerate(at)}
            spans, k = sorted(base[d]), 0
            for i, m in enumerate(crf.TOKEN.finditer(text)):
                while k < len(spans) and spans[k][1] <= m.start():
                    k += 1
                if k == len(spans):
                    break
                if spans[k][0] < m.end() and i in place:
                    u[place[i], spans[k][2] + 1] += OBSERVED
        unary.append(u)
        last: dict[str, int] = {}
        for j, i in enumerate(at.tolist()):
            if j and near[j - 1]:
                edges.append((count + j - 1, count + j)), kinds.append(0)
            if table.kind[ids[i]] in LINKED:
                word = words[i].strip(crf.TRIM) or words[i]
                before = last.get(word)
                for key, kind in ((word, 2), (alike(word), 1)):
                    if key in last and last[key] != count + j and not (kind == 1 and last[key] == before):
                        edges.append((last[key], count + j)), kinds.append(kind)
                    last[key] = count + j
        where.append((d, at, count))
        docs.append(np.full(len(at), len(docs)))
        count += len(at)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not count:
        return out
    pots = np.stack([trans, np.diag(skip[0]), np.diag(skip[1])])
    labels = propagate(np.concatenate(unary), np.array(edges, np.int64).reshape(-1, 2), np.array(kinds, np.int64), pots, np.concatenate(docs)).argmax(1)
    for d, at, first in where:
        got = labels[first : first + len(at)]
        if got.any():
            tags = dict(zip(at[got > 0].tolist(), got[got > 0].tolist(), strict=True))
            spans: list[tuple[int, int, int]] = []
            last_at, text = -2, texts[d]
            for i, m in enumerate(crf.TOKEN.finditer(text)):
                if i in tags:
                    kind, inside = tags[i] - 1, any(a < m.end() and m.start() < b for a, b, _ in base[d])
                    if inside:
                        continue
                    if last_at == i - 1 and spans[-1][2] == kind:
                        spans[-1] = (spans[-1][0], m.end(), kind)
                    else:
                        spans.append((m.start(), m.end(), kind))
                    last_at = i
            for s, e, k in spans:
                piece = text[s:e]
                s, e = s + len(piece) - len(piece.lstrip(LEFT.get(k, EDGES))), e - len(piece) + len(piece.rstrip(EDGES))
                if s < e and plausible(text[s:e], k):
                    out[d].append((s, e, k))
    return out


def with_personal(df: DataFrame, weights: crf.Weights, text_col: str = "text", name: str = "personal") -> DataFrame:
    """``df`` with array<struct<start, end, kind, base>> of code-point spans of each whole text, by kind and start.

    ``base`` tells whether a pattern or the field found the span. A null text is the empty one and has no span. An
    input column of that name is replaced. Repeated rows are scanned each, an empty table gives none; texts are whole however long,
    and the memory of the messages is in proportion to the tokens with digits or signs of a batch of texts.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)  # a fixed number of weights

    @F.pandas_udf("array<struct<start:int,end:int,kind:string,base:boolean>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = crf.Table(shared.value, always=LINKED.__contains__)
        for column in batches:
            out = []
            for lo in range(0, len(column), 256):
                table.room()
                texts = [t or "" for t in column.iloc[lo : lo + 256]]
                base = [base_spans(t) for t in texts]
                for b, more in zip(base, added_spans(texts, table, base), strict=True):
                    spans = sorted([(k, s, e, True) for s, e, k in b] + [(k, s, e, False) for s, e, k in more])
                    out.append([{"start": s, "end": e, "kind": KINDS[k], "base": is_base} for k, s, e, is_base in spans])
            yield pd.Series(out)

    return df.withColumn(name, scan(F.col(f"`{text_col}`")))


def masked(text: F.Column, spans: F.Column) -> F.Column:
    """A text with every span replaced by [KIND]; of overlapping spans the one that starts first (then the longest) names the kind, and all they cover is cut."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: F.Column, s: F.Column) -> F.Column:
        taken = F.struct(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"), (-s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], taken).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], -s["end"]).alias("at")))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def op6_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_personal(docs, train(docs)).select("doc_id", "personal").withColumn("base", F.expr("filter(personal, s -> s.base)"))
    count = lambda kind: F.size(F.expr(f"filter(base, s -> s.kind = '{kind}')")).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("personal").alias("spans"), F.size("personal").cast("long").alias("n_spans"))
