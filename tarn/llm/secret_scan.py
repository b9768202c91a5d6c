"""Secrets: base patterns, and a linear-chain conditional random field that adds spans to them.

The field tags white-space tokens outside, begin or inside of a secret from the token's shape, the classes of the
tokens beside it and features of the file. It learns from windows of a bounded sample labelled by the base
patterns and from altered copies of them in which keywords, signs and values have other forms, or harmless tokens stand
instead (``forms``), so that it goes beyond the patterns. It is decoded by Viterbi; tokens that are outside in every best
labelling are left out beforehand.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import crf, forms

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that is too short is no match, and what is left of it is shorter still, so the least length can stand in the pattern.
ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
HEX = re.compile("[0-9a-f]{16,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Hexadecimal bytes to 0, others to a space: where 16 zeros stand together there is a match.
HEX_BYTES = bytes(48 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
HEX_RUN = b"0" * 16
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
EDGES = "\"'`,;:()[]{}<>!#*%&$|."
LEAST = 8  # characters of a secret's value


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, in code points, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    if HEX_RUN in text.encode("utf-8", "surrogatepass").translate(HEX_BYTES):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def labelled(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a text and their labels by the base patterns."""
    tokens, tags, spans, k = [], [], sorted(base_spans(text)), 0
    inside = -1
    for m in crf.TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        hit = k < len(spans) and spans[k][0] < m.end()
        tokens.append(m[0])
        tags.append(OUTSIDE if not hit else INSIDE if inside == k else BEGIN)
        inside = k if hit else -1
    return tokens, tags


def altered(window: crf.Window, r: random.Random) -> crf.Window:
    """A copy with another secret around its middle, or with harmless tokens there."""
    mid = crf.SPAN
    if r.random() < 0.45:
        words, tags = {mid: forms.harmless(r)}, {mid: OUTSIDE}
        if r.random() < 0.35:  # a keyword that announces nothing
            words[mid - 1], tags[mid - 1] = r.choice(forms.KEY_WORDS) + r.choice(("", "", ":")), OUTSIDE
        if r.random() < 0.5:
            words[mid + 1], tags[mid + 1] = forms.harmless(r), OUTSIDE
        return window.with_words(words, tags)
    value = forms.spoken(r, [forms.secret_value(r)])[0]
    if r.random() < 0.4:
        return window.with_words({mid: value}, {mid: BEGIN})
    key, sign = r.choice(forms.KEY_WORDS), r.choice(forms.SIGNS)
    if not sign:
        return window.with_words({mid - 1: key + r.choice(("", ":", "=")), mid: value}, {mid - 1: BEGIN, mid: INSIDE})
    return window.with_words({mid - 2: key, mid - 1: sign, mid: value}, {mid - 2: BEGIN, mid - 1: INSIDE, mid: INSIDE})


def train(docs: DataFrame, texts: int = 1200, windows: int = 3000, copies: int = 5000, seed: int = 3) -> crf.Weights:
    """Weights from at most ``windows`` windows of at most ``texts`` different whole texts, and ``copies`` altered ones; a bounded sample for training only."""
    text = F.col("text")
    hint = text.contains("AKIA") | text.contains("password") | text.contains("secret") | text.contains("token") | text.rlike("[0-9][0-9a-f]{15}")
    return fitted(crf.sampled(docs, hint, labelled, texts, windows), copies, seed)


def fitted(found: list[crf.Window], copies: int = 5000, seed: int = 3) -> crf.Weights:
    """Weights from windows and ``copies`` altered copies of those without a secret."""
    r = random.Random(seed)
    plain = [w for w in found if not any(w.tags) and all(w.words)]
    return crf.fit(found + [altered(r.choice(plain), r) for _ in range(copies if plain else 0)], 3)


def added_spans(text: str, table: crf.Table, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans that the field finds and that touch no base span."""
    if table.skips and not crf.special(text):
        return []
    ids = table.ids(text.split())
    at = table.open[ids].nonzero()[0]
    if not len(at):
        return []
    emit = table.potentials(ids, at)
    tags: dict[int, int] = {}
    run = 0
    for k in range(1, len(at) + 1):
        if k == len(at) or at[k] != at[k - 1] + 1:
            for i, tag in zip(at[run:k].tolist(), crf.viterbi(emit[run:k], table.w.trans).tolist(), strict=True):
                if tag:
                    tags[i] = tag
            run = k
    if not tags:
        return []
    out: list[tuple[int, int, int]] = []
    last = -2
    for i, m in enumerate(crf.TOKEN.finditer(text)):
        if i in tags:
            if tags[i] == INSIDE and last == i - 1 and out:
                out[-1] = (out[-1][0], m.end(), 3)
            else:
                out.append((m.start(), m.end(), 3))
            last = i
    found = []
    for start, end, kind in out:
        piece = text[start:end]
        start, end = start + len(piece) - len(piece.lstrip(EDGES)), end - len(piece) + len(piece.rstrip(EDGES))
        if plausible(text[start:end]) and not any(s < end and start < e for s, e, _ in base):
            found.append((start, end, kind))
    return found


def plausible(piece: str) -> bool:
    """Whether some token of a found piece can be a secret's value: long enough, and not only digits, marks or letters of one case."""
    return any(len(w) >= LEAST and sum((any(c.isdigit() for c in w), any(c.islower() for c in w), any(c.isupper() for c in w))) > 1 for w in piece.split())


def with_secrets(df: DataFrame, weights: crf.Weights, text_col: str = "text", name: str = "secrets") -> DataFrame:
    """``df`` with array<struct<start, end, kind>> of code-point spans of each whole text, by start and kind.

    Kinds are assign, access, hex (base) and crf (added). A null text is the empty one and has no span. An input column of that
    name is replaced. Repeated rows are scanned each, an empty table gives none; texts are whole however long, and the work is in
    proportion to their length.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)  # a fixed number of weights

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = crf.Table(shared.value)
        for texts in batches:
            out = []
            for t in texts:
                table.room()
                base = base_spans(t or "")
                spans = sorted(base + added_spans(t or "", table, base), key=lambda s: (s[0], s[2]))
                out.append([{"start": s, "end": e, "kind": KINDS[k]} for s, e, k in spans])
            yield pd.Series(out)

    return df.withColumn(name, scan(F.col(f"`{text_col}`")))


def span_text(spans: str) -> F.Column:
    """kind:start:end, comma-joined, of a span column."""
    return F.array_join(F.transform(F.expr(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_secrets(docs, train(docs)).select("doc_id", "secrets").withColumn("base", F.expr("filter(secrets, s -> s.kind <> 'crf')"))
    count = lambda kind: F.size(F.expr(f"filter(secrets, s -> s.kind = '{kind}')")).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("secrets").alias("spans"), F.size("secrets").cast("long").alias("n_spans"))
