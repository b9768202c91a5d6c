"""The criterion language: WHERE, ORDER BY, LIMIT, scalar subqueries and extra tables, compiled to DataFrame plans."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STRING = r"'(?:[^'\\]|\\.|'')*'"
_INTERVAL = re.compile(r"\bDATE_(ADD|SUB)\s*\(\s*((?:[^(),]|\([^()]*\))+?)\s*,\s*INTERVAL\s+(-?[\w.]+)\s+(\w+?)\s*\)", re.IGNORECASE)
_PARTS = {"second": "0,0,0,0,0,0,{}", "minute": "0,0,0,0,0,{}", "hour": "0,0,0,0,{}", "day": "0,0,0,{}", "week": "0,0,{}", "month": "0,{}", "year": "{}"}
_FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%i": "mm", "%s": "ss", "%S": "ss", "%y": "yy", "%M": "MMMM", "%b": "MMM", "%p": "a", "%h": "hh", "%j": "DDD"}


def _outside_strings(sql: str, change) -> str:
    """Apply ``change`` to the parts of an expression that are no string literals."""
    return "".join(p if i % 2 else change(p) for i, p in enumerate(re.split(f"({_STRING})", sql)))


def to_spark(expr: str, now: str | None = None) -> str:
    """A MySQL expression as Spark SQL. ``now`` (a timestamp literal's text) stands for NOW() and CURDATE(); the clock is never read."""
    moment = f"TIMESTAMP_NTZ'{now}'" if now else "NULL"

    def formats(m: re.Match) -> str:
        pattern = re.sub("%.", lambda x: _FORMATS.get(x[0], x[0][1]), m[2])
        return f"date_format({m[1]},'{pattern}')"

    out = re.sub(r"\bDATE_FORMAT\s*\(\s*((?:[^(),]|\([^()]*\))+?)\s*,\s*'([^']*)'\s*\)", formats, expr, flags=re.IGNORECASE)

    def plain(p: str) -> str:
        p = re.sub(r"\bNOW\s*\(\s*\)|\bCURRENT_TIMESTAMP\b(?:\s*\(\s*\))?", moment, p, flags=re.IGNORECASE)
        p = re.sub(r"\bCURDATE\s*\(\s*\)", f"cast({moment} as date)", p, flags=re.IGNORECASE)
        for _ in range(8):  # nested calls, innermost first
            new = _INTERVAL.sub(lambda m: f"({m[2]} {'+' if m[1].upper() == 'ADD' else '-'} make_interval({_PARTS[m[4].lower().rstrip('s')].format(m[3])}))", p)
            if new == p:
                break
            p = new
        p = re.sub(r"\bTIMEDIFF\s*\(", "tarn_timediff(", p, flags=re.IGNORECASE)
        p = re.sub(r"tarn_timediff\(\s*((?:[^(),]|\([^()]*\))+?)\s*,\s*((?:[^(),]|\([^()]*\))+?)\s*\)", r"(unix_timestamp(\1) - unix_timestamp(\2))", p)
        p = re.sub(r"\bLENGTH\s*\(", "octet_length(", p, flags=re.IGNORECASE)
        return re.sub(r"(?<![<>=!])==(?!=)", "=", p)

    return _outside_strings(out, plain)


@dataclass(frozen=True)
class Criterion:
    """WHERE, ORDER BY, LIMIT (a number, or offset and count), named scalar subqueries SQL and extra TABLES."""

    where: str | None = None
    order_by: str | None = None
    limit: int | Sequence[int] | None = None
    sql: Mapping[str, DataFrame] = field(default_factory=dict)
    tables: Mapping[str, DataFrame] = field(default_factory=dict)
    now: str | None = None

    @classmethod
    def of(cls, request: Mapping, **more) -> Criterion:
        """From a request's dictionary, whose LIMIT may be "offset, count" text."""
        limit = request.get("LIMIT")
        if isinstance(limit, str):
            limit = [int(x) for x in limit.split(",")] if "," in limit else int(limit)
        return cls(where=request.get("WHERE"), order_by=request.get("ORDER BY"), limit=limit, **more)

    def bound(self, text: str, site_id: str | None) -> str:
        """Macros replaced: %SITE_ID% by a quoted literal, %name% by the first cell of its subquery (NULL if none)."""
        if site_id is not None:
            text = text.replace("%SITE_ID%", site_id.replace("'", "''"))
        return re.sub("%(\\w+)%", lambda m: f"`{m[1]}`" if m[1] in self.sql else "NULL", text)

    def apply(self, df: DataFrame, extra: str | None = None, site_id: str | None = None) -> DataFrame:
        """The rows of ``df`` under the criterion; an added condition is joined by AND, both in parentheses."""
        out = df
        for name, rows in self.tables.items():
            out = out.crossJoin(rows.alias(name))
        for name, rows in self.sql.items():
            cell = rows.select(F.col(rows.columns[0]).alias(name)).limit(1)
            out = out.join(F.broadcast(cell), F.lit(True), "left")  # one row
        conditions = [f"({to_spark(self.bound(c, site_id), self.now)})" for c in (self.where, extra) if c and c.strip()]
        if conditions:
            out = out.where(" AND ".join(conditions))
        if self.order_by:
            out = out.orderBy(*order_columns(self.order_by, self.now))
        if self.limit is not None:
            offset, count = (0, self.limit) if isinstance(self.limit, int) else (self.limit[0], self.limit[1]) if len(self.limit) > 1 else (0, self.limit[0])
            out = (out.offset(offset) if offset else out).limit(count)
        return out.select(*[f"`{c}`" for c in df.columns]) if self.sql or self.tables else out


def order_columns(text: str, now: str | None = None) -> list[Column]:
    """ORDER BY text as columns; like MySQL and Spark, nulls come first ascending and last descending."""
    out = []
    for part in re.split(r",(?![^()]*\))", text):
        m = re.fullmatch(r"\s*(.*?)\s*(ASC|DESC)?\s*", part, flags=re.IGNORECASE | re.DOTALL)
        c = F.expr(to_spark(m[1], now))
        out.append(c.desc() if (m[2] or "").upper() == "DESC" else c.asc())
    return out


def per_site_criterion(default: str, overrides: Mapping[str, str], site_col: str = "site_id", now: str | None = None) -> Column:
    """One condition whose text differs for some sites (texts from site properties, read by the driver)."""
    c = F.expr(to_spark(default, now))
    for site, text in sorted(overrides.items()):
        c = F.when(F.col(site_col) == site, F.expr(to_spark(text, now))).otherwise(c)
    return c


READ_ONLY = re.compile(r"\s*(?:--[^\n]*\n\s*|/\*.*?\*/\s*)*(select|with|show|describe|desc|explain|values)\b", re.IGNORECASE | re.DOTALL)


def reads_only(c: Column) -> Column:
    """Whether a statement only reads, by its first word after comments."""
    return c.rlike("(?is)^" + READ_ONLY.pattern)


def sql_custom(spark, queries: str | Sequence[str], by_name: bool = True, write: bool = False) -> list[DataFrame | str]:
    """Custom SQL: a result for each statement, or its error as text. Statements other than queries need ``write``."""
    out: list[DataFrame | str] = []
    for q in [queries] if isinstance(queries, str) else queries:
        if not write and not READ_ONLY.match(q):
            out.append("read-only mode: statement rejected")
            continue
        try:
            df = spark.sql(q)
            out.append(df if by_name else df.toDF(*[str(i) for i in range(len(df.columns))]))
        except Exception as e:  # the error is the answer to this request
            out.append(str(e).split("\n")[0])
    return out


def project(df: DataFrame, names: Mapping[str, object], keep_defaults: bool = False) -> DataFrame:
    """Fields by list with defaults; a field that ``df`` lacks is null, or its default with ``keep_defaults``."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.col(n), F.lit(d)) if keep_defaults and d is not None else F.col(n) if n in have else F.lit(None)).alias(n) if n in have else F.lit(d if keep_defaults else None).alias(n) for n, d in names.items()])
