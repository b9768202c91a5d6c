"""Text functions as columns: hashes, metrics, cleaning, small parsers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTERS = r"\p{L}\p{N}"


def words(c: Column) -> Column:
    """A text split at single white-space characters; an empty text is one empty word."""
    return F.split(c, r"\s")


def content_hash_1(c: Column) -> Column:
    """md5 of the lowered text."""
    return F.md5(F.lower(c))


def content_hash_2(c: Column) -> Column:
    """md5 of the sorted distinct lowered words of three letters and more."""
    return F.md5(F.array_join(F.filter(F.array_sort(F.array_distinct(words(F.lower(c)))), lambda x: F.length(x) >= 3), ""))


def content_hash_4(c: Column) -> Column:
    """md5 of the soundex codes of the words."""
    return F.md5(F.array_join(F.transform(words(F.lower(c)), lambda x: F.soundex(x)), ""))


@F.pandas_udf(T.StringType())
def content_hash_3(text: pd.Series, lang: pd.Series) -> pd.Series:
    """md5 of the stemmed lowered words, by language (null: English)."""
    import hashlib

    from tarn.functions.stem import stem

    return pd.Series([None if t is None else hashlib.md5("".join(stem(w, g or "en") for w in t.lower().split()).encode()).hexdigest() for t, g in zip(text, lang, strict=True)], dtype=object)


def is_word(x: Column) -> Column:
    """Letters and digits only; a word of plain upper and lower case letters and numbers needs three characters."""
    return x.rlike(f"^[{LETTERS}]+$") & ~(x.rlike(r"^[\p{Lu}\p{Ll}\p{N}]+$") & (F.length(x) < 3))


def word_count(c: Column) -> Column:
    return F.size(words(c))


def valid_word_percent(c: Column) -> Column:
    return F.expr("0") + F.floor(F.size(F.filter(words(c), is_word)) * 100 / F.size(words(c)))


def valid_char_percent(c: Column) -> Column:
    """Share of letters and digits, of 100; null for an empty text."""
    return F.when(F.length(c) > 0, F.floor(F.length(F.regexp_replace(c, f"[^{LETTERS}]", "")) * 100 / F.length(c)))


def tag_count(tags: Column) -> Column:
    """Filled tags of a map of strings."""
    return F.size(F.filter(F.map_values(tags), lambda v: F.trim(F.coalesce(v, F.lit(""))) != ""))


def tag_percent(tags: Column) -> Column:
    return F.floor(tag_count(tags) * 100 / F.greatest(F.size(F.map_keys(tags)), F.lit(1)))


#: Metrics by name: a registry that users extend with their own column builders.
METRICS = {"TAGS_NUMBER": tag_count, "TAGS_NUMBER_PERCENT": tag_percent, "WORDS_NUMBER": word_count, "WORDS_NUMBER_PERCENT": valid_word_percent, "CONTENT_SIZE": F.length, "CONTENT_SIZE_PERCENT": valid_char_percent}


def metric(name: str, c: Column) -> Column:
    return METRICS[name](c)


def strip_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?(-->|$)", "")


def strip_tags(c: Column, glue: str = " ") -> Column:
    return F.regexp_replace(c, r"(?s)(<!--.*?-->|<[^>]*>)", glue)


def erase_element(c: Column, name: str) -> Column:
    """A text without elements of a name and what they hold."""
    return F.regexp_replace(c, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")


def encode_entities(c: Column) -> Column:
    """& < > " as entities, entities that stand already left alone."""
    out = F.regexp_replace(c, r"&(?!(?:[a-zA-Z]+|#[0-9]+);)", "&amp;")
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def pairs(c: Column, sep: str = ",", eq: str = "=") -> Column:
    """``a=b,c=d`` as a map; parts without ``=`` are dropped, text after a second one too."""
    parts = F.transform(F.split(c, sep), lambda p: F.split(p, eq))
    good = F.filter(parts, lambda p: F.size(p) > 1)
    return F.map_from_entries(F.transform(good, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))


def is_tail(c: Column, tail: str) -> Column:
    """Whether the first occurrence of a string is the end of the text, and not its start."""
    at = F.instr(c, tail)
    return (at > 1) & (at + len(tail) - 1 == F.length(c))


def collapse(c: Column, what: str) -> Column:
    """Runs of a string as one."""
    import re

    return F.regexp_replace(c, f"(?:{re.escape(what)})+", what.replace("\\", "\\\\").replace("$", "\\$"))


def meta_refresh(c: Column) -> Column:
    """Target of a meta refresh, empty if none."""
    return F.trim(F.regexp_extract(c, r"""(?is)<meta[^>]+http-equiv\s*=\s*["']?refresh["']?[^>]*content\s*=\s*["']?[^"'>]*?url\s*=\s*['"]?([^"'>]+)""", 1))


def mail_address(c: Column, name_only: bool = False) -> Column:
    """Addresses of a mailto link, comma-joined; with ``name_only`` what stands before the @."""
    each = F.split(F.split(F.regexp_replace(c, "^mailto:", ""), r"\?")[0], ",")
    return F.array_join(F.transform(each, lambda x: F.split(x, "@")[0] if name_only else x), ",")


def css_blocks(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?s)\{.+?\}"))


def hash_int(c: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of the md5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")


#: Powers of a thousand by SI suffix.
SI = {"K": 1, "M": 2, "G": 3, "T": 4, "P": 5, "E": 6, "Z": 7, "Y": 8}


def si_number(c: Column, default: float = 0.0) -> Column:
    """A number with an optional SI suffix; the default if there is none."""
    t = F.upper(F.trim(c))
    factor = F.lit(1.0)
    for s, p in SI.items():
        factor = F.when(t.endswith(s), F.lit(1000.0**p)).otherwise(factor)
    return F.coalesce(F.regexp_replace(t, "[KMGTPEZY]$", "").try_cast("double") * factor, F.lit(default))


def matches(c: Column, pattern: str) -> Column:
    """A regular expression if the pattern starts with a slash, else equality in upper case."""
    return c.rlike(pattern[1:]) if pattern.startswith("/") else F.upper(c) == pattern.upper()


def json_checks(c: Column, path: str, allowed: Sequence[str]) -> Column:
    return F.get_json_object(c, path).isin(*allowed)


def json_path(c: Column, path: str, base64: bool = False) -> Column:
    """``a:b:0:__LEN__`` read from JSON text, optionally base64-coded."""
    text = F.decode(F.unbase64(c), "UTF-8") if base64 else c
    steps = path.split(":")
    length = steps[-1] == "__LEN__"
    expr = "$" + "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in (steps[:-1] if length else steps))
    got = F.get_json_object(text, expr)
    return F.coalesce(F.json_array_length(got), F.length(got)).cast("string") if length else got


def mask_names(mask: Column, names: Mapping[int, str]) -> Column:
    """Names of the bits that are set."""
    return F.array_compact(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << b)) != 0, F.lit(n)) for b, n in names.items()]))


#: Leading bytes (hexadecimal) of common content types.
MAGIC = {"FFD8FF": "image/jpeg", "89504E47": "image/png", "47494638": "image/gif", "25504446": "application/pdf", "1F8B": "application/gzip", "504B0304": "application/zip"}


def mime(c: Column) -> Column:
    """Content type by leading bytes of a text or binary."""
    head = F.hex(F.substring(c.cast("binary"), 1, 8))
    text = F.lower(F.ltrim(F.substring(c.cast("string"), 1, 200)))
    out = F.when(text.startswith("<!doctype html") | text.startswith("<html"), "text/html").when(text.startswith("<?xml"), "text/xml").when(text.rlike(r"^[\[{]"), "application/json").otherwise("text/plain")
    for magic, kind in MAGIC.items():
        out = F.when(head.startswith(magic), kind).otherwise(out)
    return out


def declared_charset(c: Column) -> Column:
    """Charset named by a meta element or an XML declaration, in lower case."""
    return F.lower(F.regexp_extract(c, r"""(?i)(?:<meta[^>]+charset\s*=\s*["']?|<\?xml[^>]+encoding\s*=\s*["'])([\w-]+)""", 1))


def header(c: Column, name: str) -> Column:
    """Value of a header line."""
    import re

    return F.trim(F.regexp_extract(c, rf"(?mi)^{re.escape(name)}:\s*(.*)$", 1))


def highlighted(c: Column, terms: Sequence[str], before: str = '<font color="red">', after: str = "</font>") -> Column:
    """A text with the words of a query between markers."""
    import re

    quote = lambda s: s.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(c, r"(?iu)\b(" + "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True)) + r")\b", quote(before) + "$1" + quote(after))
