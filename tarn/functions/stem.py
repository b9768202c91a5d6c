"""Stems of words: Porter's algorithm (1980) for English, light suffix rules after Savoy (2006) for German, French and Spanish."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

#: Fixed values of Porter's algorithm: suffixes and what stands for them.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou")
#: Endings of the light rules, with the least length of a word that loses them; the first of a list that fits goes.
LIGHT = {
    "de": ((("ern", 6), ("em", 5), ("en", 5), ("er", 5), ("es", 5), ("e", 4), ("s", 5)), (("est", 6), ("er", 5), ("en", 5), ("st", 6))),
    "fr": ((("issements", 12), ("issement", 11), ("ements", 9), ("ement", 8), ("atrices", 10), ("ateurs", 9), ("ations", 9), ("ation", 8), ("euses", 8), ("euse", 7), ("ives", 7), ("ifs", 6), ("eux", 6), ("aux", 6), ("er", 6), ("ent", 7), ("es", 5), ("s", 5), ("x", 5)), (("e", 5),)),
    "es": ((("aciones", 10), ("amientos", 11), ("amiento", 10), ("imiento", 10), ("ación", 8), ("mente", 9), ("idades", 9), ("idad", 8), ("ando", 7), ("iendo", 8), ("eses", 7), ("os", 5), ("as", 5), ("es", 5), ("o", 5), ("a", 5), ("e", 5)),),
}


#: Kinds of letters by their byte: v for vowels, y for itself, c for all others.
KINDS = bytes(ord("v" if chr(i) in "aeiou" else "y" if chr(i) == "y" else "c") for i in range(256))
#: The suffixes of a step, longest first.
ENDS_2, ENDS_3 = (tuple(sorted(t, key=len, reverse=True)) for t in (STEP_2, STEP_3))
#: The light rules, each list with its endings alone.
LIGHT_ENDS = {k: tuple((x, tuple(e for e, _ in x)) for x in v) for k, v in LIGHT.items()}


def _pattern(word: str) -> bytes:
    """c for a consonant, v for a vowel; y is a vowel after a consonant."""
    out = word.encode("latin-1", "replace").translate(KINDS)
    while (i := out.find(b"y")) >= 0:
        out = out[:i] + (b"v" if out[:i].endswith(b"c") else b"c") + out[i + 1 :]
    return out


def _measure(stem: str) -> int:
    return _pattern(stem).count(b"vc")


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant at the end, the last not w, x or y."""
    return _pattern(stem).endswith(b"cvc") and stem[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], ends: tuple[str, ...], least: int) -> str:
    if word.endswith(ends):
        suffix = next(x for x in ends if word.endswith(x))
        head = word[: -len(suffix)]
        return head + table[suffix] if _measure(head) >= least else word
    return word


def porter(word: str) -> str:
    """The stem of a lowered English word."""
    if len(word) <= 2:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith(("ed", "ing")) and b"v" in _pattern(head := w[: -2 if w.endswith("ed") else -3]):
        w = head
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _pattern(w).endswith(b"c") and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and b"v" in _pattern(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(w, STEP_2, ENDS_2, 1), STEP_3, ENDS_3, 1)
    if w.endswith(STEP_4):
        suffix = next(x for x in STEP_4 if w.endswith(x))
        head = w[: -len(suffix)]
        if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
            w = head
    if w.endswith("e") and ((m := _measure(w[:-1])) > 1 or (m == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


@lru_cache(1 << 16)
def stem(word: str, lang: str) -> str:
    """The stem of a lowered word; words of other languages stay as they are."""
    if lang == "en":
        return porter(word) if word.isascii() and word.isalpha() else word
    out = word
    for endings, any_of in LIGHT_ENDS.get(lang, ()):
        if out.endswith(any_of):
            for suffix, least in endings:
                if out.endswith(suffix) and len(out) >= least:
                    out = out[: -len(suffix)]
                    break
    if lang in LIGHT and not out.isascii():
        out = "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c))
    return out
