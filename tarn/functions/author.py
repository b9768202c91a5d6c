"""Author names from bylines."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAD = re.compile(r"^\s*(?:by|from|von|par|por|автор:?|written by|posted by)\s+", re.IGNORECASE)
MAIL = re.compile(r"([\w.+-]+)@[\w.-]+\.\w+")
PAIR = re.compile(r"\b[^\W\d_a-zà-öø-ÿ][^\W\d_]+(?:[ \t]+[^\W\d_a-zà-öø-ÿ][^\W\d_]*\.?)+")


def author(text: str | None, most: int = 64) -> str | None:
    """A name from a byline: the words in title case that stand together; else the local part of an address, CamelCase or parts joined by _ taken apart; None if nothing is left."""
    if not text:
        return None
    t = LEAD.sub("", text).strip()
    if m := PAIR.search(MAIL.sub(" ", t)):
        return re.sub(r"\s+", " ", m[0])[:most].strip()
    if m := MAIL.search(t):
        t = m[1].replace(".", " ")
    t = re.sub(r"(?<=[a-zà-öø-ÿ])(?=[A-Z])", " ", t.replace("_", " "))
    t = " ".join(w if w[:1].isupper() else w.capitalize() for w in re.findall(r"[^\W\d_]+", t))
    return t[:most].strip() or None


@F.pandas_udf(T.StringType())
def normalize_author(text: pd.Series) -> pd.Series:
    return pd.Series([author(t) for t in text], dtype=object)
