import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import crf, forms, pii, secret_scan

ALPHABET = "ab0 19.+-()@=:'\"K/\nfetokn_"


def plain_secrets(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], s[2]))


def plain_personal(text):
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), m.end(), 2))
    return out + [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*ALPHABET, "token=", "api_key: ", "AKIA", "ABCDEFGHIJ0123", "deadbeef", "4111111111111111", "a.b@c.de", "10.0.0.1", "+1 (555) 123-4567", "256.1.1.1", "ſecret=", "TOKEN '", "é"]), max_size=40).map("".join))
def test_base_patterns(text):
    assert secret_scan.base_spans(text) == plain_secrets(text)
    assert pii.base_spans(text) == plain_personal(text)


def test_long_runs_stay_linear():
    for t in ("1" * 200000, "a" * 200000, "a@" * 50000, "1." * 50000, "+1 " * 50000, "0f" * 100000, "token=" * 20000):
        secret_scan.base_spans(t), pii.base_spans(t)


def windows(labelled, texts):
    return [w for i, t in enumerate(texts) for w in crf.windows_of(*labelled(t), i)]


SECRETS = [f"the of password={random.Random(i).getrandbits(80):020x} and or" for i in range(60)] + ["plain words only here", "numbers 12 and 1999 stand"] * 20
PERSONAL = [f"call +1 (555) 555-{1000 + i} or mail a{i}@b.example.com from 10.0.{i}.1 with 4111111111111111 now" for i in range(60)] + ["plain words only here", "about 12 of 1999"] * 20


def test_pruned_decoding_is_viterbi():
    w = secret_scan.fitted(windows(secret_scan.labelled, SECRETS), 500)
    table = crf.Table(w)
    for text in SECRETS[:5] + ["token = zzz 99 deadbeefdeadbeef of the", "a"]:
        words = text.split()
        ids = table.ids(words)
        whole = crf.viterbi(table.potentials(ids, np.arange(len(ids))), w.trans)
        at = table.open[ids].nonzero()[0]
        assert set(np.flatnonzero(whole)) <= set(at.tolist())


def test_marginals_sum_to_one():
    rng = np.random.default_rng(0)
    node, pair = crf.marginals(rng.normal(size=(3, 5, 4)), rng.normal(size=(4, 4)))
    assert np.allclose(node.sum(2), 1) and np.isclose(pair.sum(), 3 * 4)


def test_loopy_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(1)
    unary, pots = rng.normal(size=(3, 2)), rng.normal(size=(2, 2, 2))
    got = pii.propagate(unary, np.array([[0, 1], [1, 2]]), np.array([0, 1]), pots, rounds=60)
    want = np.zeros((3, 2))
    for a in range(2):
        for b in range(2):
            for c in range(2):
                p = np.exp(unary[0, a] + unary[1, b] + unary[2, c] + pots[0, a, b] + pots[1, b, c])
                want[0, a] += p
                want[1, b] += p
                want[2, c] += p
    p = np.exp(got - got.max(1, keepdims=True))
    assert np.allclose(p / p.sum(1, keepdims=True), want / want.sum(1, keepdims=True), atol=1e-3)


def test_beliefs_of_a_document_do_not_depend_on_others():
    rng = np.random.default_rng(2)
    unary, pots = rng.normal(size=(40, 3)), rng.normal(size=(1, 3, 3))
    chain = np.array([(i, i + 1) for i in range(29)])
    alone = pii.propagate(unary[:30], chain, np.zeros(29, int), pots, np.zeros(30, int))
    more = np.array([(30 + i, 30 + (i + 3) % 10) for i in range(10)])
    both = pii.propagate(unary, np.r_[chain, more], np.zeros(39, int), pots, np.r_[np.zeros(30, int), np.ones(10, int)])
    assert np.array_equal(alone, both[:30])


def test_a_label_reaches_the_end_of_a_long_chain():
    unary = np.zeros((60, 2))
    unary[0, 1] = 30
    got = pii.propagate(unary, np.array([(i, i + 1) for i in range(59)]), np.zeros(59, int), np.diag([8.0, 8.0])[None])
    assert (got.argmax(1) == 1).all()


# --- what the fields add, on forms that neither the patterns nor the training know


@pytest.fixture(scope="module")
def fields(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    secrets, personal = crf.Table(secret_scan.train(docs)), crf.Table(pii.train(docs), always=pii.LINKED.__contains__)
    clean = [r["text"] for r in docs.where("text is not null").orderBy(F.xxhash64("text")).limit(400).collect() if len(r["text"]) < 20000]
    return secrets, personal, [t for t in clean if not secret_scan.base_spans(t) and not pii.base_spans(t)]


def unknown_secret(r):
    form = r.randrange(5)
    if form == 0:
        return "eyJ" + forms.pick(r, forms.ALNUM, 15, 20) + "." + forms.pick(r, forms.ALNUM + "-_", 30, 60) + "." + forms.pick(r, forms.ALNUM + "-_", 30, 43)
    if form == 1:
        return forms.pick(r, "abcdefghijklmnopqrstuvwxyz234567", 26, 52)
    if form == 2:
        return forms.pick(r, forms.ALNUM + "!&^%", 14, 24)
    if form == 3:
        return "sk-live-" + forms.pick(r, forms.ALNUM, 24, 32)
    return "-".join(forms.pick(r, "0123456789ABCDEF", n, n) for n in (8, 4, 4, 4, 12))


def unknown_personal(r):
    word = lambda: forms.pick(r, "abcdefghijklmnop", 3, 9)
    part = lambda n: ":".join(forms.pick(r, "0123456789abcdef", 1, 4) for _ in range(n))
    kind = r.choice((0, 1, 3))
    return kind, (f"{word()}-{word()}{{at}}{word()}.{r.choice(['de', 'io', 'edu'])}", f"{part(2)}::{part(4)}", None, f"{r.randint(200, 999)}/{r.randint(100, 999)}-{r.randint(0, 9999):04d}")[kind]


def planted(text, piece, r):
    words = text.split(" ")
    at = r.randrange(len(words) + 1)
    return " ".join([*words[:at], piece, *words[at:]])


def measured(texts, made, scan, kind_of):
    hit = miss = false = 0
    for text, (kind, piece, value) in zip(texts, made, strict=False):
        whole = planted(text, piece, random.Random(len(text)))
        start = whole.index(piece) + piece.index(value)
        got = scan(whole)
        found = [g for g in got if g[0] < start + len(value) and start < g[1] and kind_of(g[2], kind)]
        hit, miss, false = hit + bool(found), miss + (not found), false + sum(not (g[0] < start + len(value) and start < g[1]) for g in got)
    return hit / (hit + miss), hit / max(1, hit + false)


def test_secrets_beyond_the_patterns(fields):
    table, _, clean = fields
    r = random.Random(9)
    said = ["the pwd {} was", "passphrase: {} in", "use {} here", "auth key {} of", "signing-key={} end", "login with {} today"]
    made = []
    while len(made) < len(clean):
        value, frame = unknown_secret(r), r.choice(said)
        if not secret_scan.base_spans(frame.format(value)):
            made.append((0, frame.format(value), value))
    recall, precision = measured(clean, made, lambda t: secret_scan.added_spans(t, table, secret_scan.base_spans(t)), lambda a, b: True)
    assert recall > 0.7 and precision > 0.97


def test_personal_data_beyond_the_patterns(fields):
    _, table, clean = fields
    r = random.Random(9)
    made = []
    while len(made) < len(clean):
        kind, value = unknown_personal(r)
        frame = r.choice(["call {} now", "{}", "reach {} or"])
        if not pii.base_spans(frame.format(value)):
            made.append((kind, frame.format(value), value))
    recall, precision = measured(clean, made, lambda t: pii.added_spans([t], table, [pii.base_spans(t)])[0], lambda a, b: a == b)
    assert recall > 0.7 and precision > 0.97


def test_links_tell_what_a_token_is(fields):
    """The last part of a phone number is personal data where the whole number stands elsewhere in the document, and a plain number where it doesn't."""
    _, table, clean = fields
    r = random.Random(4)
    linked = alone = 0
    for text in clean:
        last = f"{r.randint(100, 999)}-{r.randint(0, 9999):04d}"
        whole = planted(text, f"+1 ({r.randint(100, 999)}) {last} and", r)
        both, one = f"{whole} then {last} again", f"{text} then {last} again"
        found, other = pii.added_spans([both, one], table, [pii.base_spans(both), pii.base_spans(one)])
        linked += any(k == 3 and s > len(whole) for s, _, k in found)
        alone += bool(other)
    assert linked > 0.4 * len(clean) and alone < 0.03 * len(clean)


HARMLESS = ["ISBN 0-306-40615-2", "5th-6th", "123-4567", "3:2:1", "10.2.3", "12:30:45.123", "20240517.3", "8080/tcp", "sha1sum", "Fig.3a", "4111111111111112", "1234567890123", "2019-2020", "section-4.2.1", "12-34-56", "user_id=4455", "node123.example", "1.2.3.4.5", "chr1:12345-67890", "0x7fff5fbff8c0", "f(x)=2x+1", "H2SO4", "win32api", "R2D2-C3PO", "3.14159265358979", "1e-10", "https://example.org/a/b2/c-33?x=1"]


def test_harmless_tokens_and_clean_texts_stay(fields):
    secrets, personal, clean = fields
    texts = [*clean, *(f"the text of {h} stands here" for h in HARMLESS)]
    assert not [t for t in texts if secret_scan.added_spans(t, secrets, secret_scan.base_spans(t))]
    assert not [t for t, found in zip(texts, pii.added_spans(texts, personal, [pii.base_spans(t) for t in texts]), strict=True) if found]


def test_cards_that_fail_the_checksum_stay_out(fields):
    _, table, _ = fields
    r = random.Random(6)
    texts = [f"the number {forms.card_number(r, valid=False)} of" for _ in range(200)]
    assert not any(pii.added_spans(texts, table, [pii.base_spans(t) for t in texts]))


def test_a_phone_that_runs_into_another_number(fields):
    _, table, _ = fields
    text = "+1 (269) 555-3296 190.137.223.204 and"
    assert [k for *_, k in pii.base_spans(text)] == [1]  # the phone pattern runs on into the address
    assert 3 in [k for *_, k in pii.added_spans([text], table, [pii.base_spans(text)])[0]]


ODD = [(1, None), (2, ""), (None, "token=abcdefghijklmnop"), (3, "x " * 100000 + "a@b.cd"), (3, "10.0.0.1"), (3, "10.0.0.1")]


def test_columns(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ODD], "doc_id long, text string, secrets string")
    rows = secret_scan.with_secrets(df, secret_scan.fitted(windows(secret_scan.labelled, SECRETS), 500)).collect()
    assert [len(r["secrets"]) for r in rows][:3] == [0, 0, 1] and len(rows) == len(ODD)
    rows = pii.with_personal(df, pii.fitted(windows(pii.labelled, PERSONAL), 500, 200)).collect()
    assert [len(r["personal"]) for r in rows] == [0, 0, 0, 1, 1, 1]
    assert rows[3]["personal"][0]["start"] == 200000
    empty = df.limit(0)
    assert secret_scan.with_secrets(empty, secret_scan.train(empty)).collect() == []
    assert pii.with_personal(empty, pii.train(empty)).collect() == []


def test_masking(spark):
    df = spark.createDataFrame([("mail a@b.cd and 10.0.0.1.", [(5, 11, "email"), (16, 24, "ip"), (17, 20, "card")]), ("é +1", []), (None, [])], "text string, s array<struct<start:int,end:int,kind:string>>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(pii.masked(F.col("text"), F.col("s"))).collect()] == ["mail [EMAIL] and [IP].", "é +1", None]


def test_queries(spark, sf):
    import hashlib

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secret_scan.op5_secrets(spark, sf).collect():
        base = plain_secrets(texts[r["doc_id"]])
        want = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for *_, k in base) for i in range(3))
    for r in pii.op6_personal(spark, sf).collect():
        base = plain_personal(texts[r["doc_id"]])
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == i for *_, k in base) for i in range(4))


def test_masking_cuts_the_union_of_overlapping_spans(spark):
    text = "id 123456789012 10.0.0.1 end"
    df = spark.createDataFrame([(text, [(16, 24, "ip"), (3, 18, "card")]), (text, [(3, 15, "card"), (4, 9, "phone"), (16, 24, "ip")])], "text string, s array<struct<start:int,end:int,kind:string>>")
    assert [r[0] for r in df.select(pii.masked(F.col("text"), F.col("s"))).collect()] == ["id [CARD] end", "id [CARD] [IP] end"]


def test_training_samples_hold_different_whole_texts(spark):
    rows = [("the same text of 12",)] * 500 + [(f"text {i + 20}",) for i in range(30)] + [("long " * 30000 + "99",), (None,), ("",), ("x" * 5000,)]
    df = spark.createDataFrame(rows, "text string")
    got = crf.sampled(df.repartition(5), F.lit(False), secret_scan.labelled, 2000, 10**6)
    middles = [w.words[crf.SPAN] for w in got]
    assert middles.count("12") == 1 and middles.count("99") >= 1 and "x" * 5000 not in middles
    few = crf.sampled(df, F.lit(False), secret_scan.labelled, 20, 15)
    assert len(few) == 15 and all(len(w.words) == 2 * crf.SPAN + 1 for w in few)
