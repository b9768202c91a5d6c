"""URL functions. What needs IDNA, Unicode normal forms or path resolution is a Pandas UDF; the rest are columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from urllib.parse import quote, unquote_to_bytes, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PORTS = {"http": 80, "https": 443, "ftp": 21}
UNRESERVED = "-._~"
#: Characters that stay as they are, by URL part (fixed values of the URI syntax).
SAFE = {"user": UNRESERVED + "!$&'()*+,;=:", "path": UNRESERVED + "!$&'()*+,;=:@/", "query": UNRESERVED + "!$&'()*+,;=:@/?[]"}
SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:")


def _part(text: str, safe: str) -> str:
    """Percent-decoded once, in Unicode normal form C, and coded again; bytes that are no UTF-8 are read as Latin-1."""
    raw = unquote_to_bytes(text.encode("utf-8"))
    try:
        plain = raw.decode("utf-8")
    except UnicodeDecodeError:
        plain = raw.decode("latin-1")
    return quote(unicodedata.normalize("NFC", plain), safe=safe)


def _query(text: str) -> str:
    """A query whose separators keep their meaning: coded & and = stay coded."""
    coded = SAFE["query"].replace("&", "").replace("=", "").replace("+", "")
    return "&".join("=".join(_part(x, coded) if "%" in x else quote(unicodedata.normalize("NFC", x), safe=SAFE["query"]) for x in p.split("=")) for p in text.split("&"))


def without_dots(path: str) -> str:
    """A path without . and .. segments and without empty ones but the last."""
    out: list[str] = []
    parts = re.sub("//+", "/", path).split("/")
    for p in parts[1:]:
        if p == "..":
            out = out[:-1]
        elif p != ".":
            out.append(p)
    if parts[-1] in (".", "..") and (not out or out[-1]):
        out.append("")
    return "/" + "/".join(out) if path.startswith("/") else "/".join(out)


def normalized(url: str | None, scheme: str = "http") -> str | None:
    """Canonical form of a URL: scheme and host in lower case, IDNA host without its last dot, parts percent-coded alike, dots resolved, no default port, no fragment; #! becomes _escaped_fragment_."""
    if not url or not (url := url.strip()):
        return url
    if url.startswith("/") and not url.startswith("//"):
        return without_dots(url)
    if not re.search(r"[.:/]", url):
        return url
    if url.startswith("//"):
        url = f"{scheme}:{url}"
    elif not SCHEME.match(url) or re.match(r"[\w.-]+:\d+(?:/|$)", url):
        url = f"{scheme}://{url}"
    url = url.replace("#!", ("&" if "?" in url.split("#!")[0] else "?") + "_escaped_fragment_=")
    try:
        p = urlsplit(url)
        port = p.port
    except ValueError:
        return url
    if p.scheme not in PORTS:
        return url
    user, at, _ = p.netloc.rpartition("@")
    if not user.strip(":"):
        user = at = ""
    host = (p.hostname or "").rstrip(".")
    try:
        host = host.encode("idna").decode() if len(host) <= 63 or "." in host else host
    except UnicodeError:
        pass
    where = host + (f":{port}" if port and port != PORTS[p.scheme] else "")
    path = without_dots(_part(p.path or "/", SAFE["path"] + "%")) or "/"
    return f"{p.scheme.lower()}://{_part(user, SAFE['user']) + at if at else ''}{where.lower()}{path}" + (f"?{_query(p.query)}" if p.query else "")


@F.pandas_udf(T.StringType())
def url_normalize(url: pd.Series) -> pd.Series:
    return url.map(normalized, na_action="ignore")


CONTROL = re.compile(r"[\x00-\x1f]")
ALLOWED = ("http", "https", "ftp")


def resolved(base: str, url: str, allowed: Sequence[str] = ALLOWED) -> str:
    """References of a text, split at white space, joined to a base and by commas; backslashes are slashes; other protocols are dropped."""
    out = []
    for u in CONTROL.sub(lambda m: "" if m[0] in "\t\r\n" else f"/{ord(m[0]):o}", url.replace("\\", "/")).split():
        full = urljoin(base, u)
        if urlsplit(full).scheme.lower() in allowed:
            out.append(full)
    return ",".join(out)


@F.pandas_udf(T.StringType())
def url_resolve(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([None if u is None else resolved(b or "", u) for b, u in zip(base, url, strict=True)], dtype=object)


NONE, SKIP_WWW, USE_VALIDATOR, MAIN = 0, 1, 2, 4


def normalize_masked(url: Column, mask: int = MAIN) -> Column:
    """By mask: the canonical form, without www., or an error URL for unsupported protocols."""
    out = url_normalize(url) if mask & MAIN else url
    if mask & SKIP_WWW:
        out = F.regexp_replace(out, r"^(\w+://)www\.", "$1")
    if mask & USE_VALIDATOR:
        out = F.when(out.rlike(r"^(?i:https?|ftp)://"), out).otherwise(F.concat(F.lit("normalization-error://?"), out))
    return out


def replace_rules(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Case-insensitive replacements one after another."""
    for what, by in rules:
        url = F.regexp_replace(url, f"(?i){what}", re.sub(r"\\(\d)", r"$\1", by))
    return url


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def domain_url(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)


def base_host(url: Column) -> Column:
    """The last two labels of the host."""
    parts = F.split(host(url), r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")


def domain_cut(url: Column) -> Column:
    """The host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def valid(url: Column) -> Column:
    """A URL of known form whose percent signs all start a code."""
    return url.rlike(r"^(?i:https?|ftp)://[^\s/?#]+\.[^\s/?#]+[^\s]*$") & ~url.rlike(r"%(?![0-9A-Fa-f]{2})")


def is_internal(url: Column, page: Column) -> Column:
    """Whether two URLs have the same last two host labels."""
    return base_host(url) == base_host(page)


def site_id(url: Column) -> Column:
    return F.md5(F.concat(domain_url(url), F.lit("/")))


def proxy_parts(c: Column) -> Column:
    """protocol, user, password, host and port of a proxy string."""
    pattern = r"^(?:(\w+)://)?(?:([^:@/]*):([^@/]*)@)?([^:/@]+)(?::(\d+))?/?$"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.struct(part(1).alias("protocol"), part(2).alias("user"), part(3).alias("password"), part(4).alias("host"), part(5).try_cast("int").alias("port"))


def wrapped(url: Column, template: str, macro: str = "%URL%", encode: bool = False) -> Column:
    """A URL in a template, percent-coded if wanted."""
    return F.replace(F.lit(template), F.lit(macro), F.replace(F.url_encode(url), F.lit("+"), F.lit("%20")) if encode else url)
