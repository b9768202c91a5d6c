"""Rule filters: predicates per site, stage and action, as joins of a small rule table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.schemas import FILTER_OP


def loaded(rules: DataFrame) -> DataFrame:
    """Enabled rules, one for each line of the pattern."""
    return rules.where("coalesce(state, 0) = 0").withColumn("pattern", F.explode(F.split("pattern", "\r\n"))).where("pattern <> ''")


def matched(subject: Column, op: Column, pattern: Column, expressions: dict[str, Column] | None = None) -> Column:
    """Whether a rule holds for a value; numbers are compared as whole numbers, what is no number is false."""
    a, b = subject.cast("string").try_cast("long"), pattern.try_cast("long")
    sqle = F.lit(False)
    for text, c in (expressions or {}).items():
        sqle = F.when(pattern == text, c).otherwise(sqle)
    out = (
        F.when(op == FILTER_OP["re"], F.regexp_like(subject.cast("string"), pattern))
        .when(op == FILTER_OP["eq"], a == b)
        .when(op == FILTER_OP["noteq"], a != b)
        .when(op == FILTER_OP["eqless"], a <= b)
        .when(op == FILTER_OP["eqmore"], a >= b)
        .when(op == FILTER_OP["less"], a < b)
        .when(op == FILTER_OP["more"], a > b)
        .when(op == FILTER_OP["sqle"], sqle)
    )
    return F.coalesce(out, F.lit(False))


def with_rules(rows: DataFrame, rules: DataFrame, stage: int, fields: Sequence[str], on: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``_rules``, the list of the stage's rules that are about a row, by rule id if there is one; null if there are none.

    Rules are gathered, not rows: all of them as one row that goes to every task, or one row for each value of ``on`` in an equi-join
    whose strategy the sizes decide. No row of ``rows`` is shuffled for rules without ``on``.
    """
    mine = rules.where(F.col("stage") == stage)
    order = [c for c in ("rule_id",) if c in rules.columns]
    listed = F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order]))).alias("_rules")
    if on:
        return rows.join(mine.groupBy(*on).agg(listed), list(on), "left")
    return rows.join(F.broadcast(mine.agg(F.when(F.count("*") > 0, listed).alias("_rules"))), F.lit(True), "left")  # one row


def evaluated(rows: DataFrame, key: str, rules: DataFrame, subject: Column, stage: int, on: Sequence[str] = (), any_of: bool = True) -> DataFrame:
    """(key, results): a list of 0/1 for each rule of the stage by rule id, or one value for all of them; rows without rules have no row."""
    both = with_rules(rows, rules, stage, ("rule_id", "op_code", "pattern"), on).where("_rules is not null")
    hit = lambda r: matched(subject, r["op_code"], r["pattern"])
    results = F.transform("_rules", lambda r: hit(r).cast("int")) if any_of else F.array(F.forall("_rules", hit).cast("int"))
    return both.select(key, results.alias("results"))


def decided(rows: DataFrame, key: str, rules: DataFrame, subject: Column, stage: int, default: bool, on: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``passes``: the default or any include rule holds, and no exclude rule does.

    One scan; a row keeps its place when no rule is about it.
    """
    both = with_rules(rows, rules, stage, ("op_code", "pattern", "action"), on)
    some = lambda action: F.coalesce(F.exists("_rules", lambda r: matched(subject, r["op_code"], r["pattern"]) & (r["action"] == action)), F.lit(False))
    return both.withColumn("passes", (F.lit(default) | some(1)) & ~some(-1)).drop("_rules")


def rule_matches(rows: DataFrame, rules: DataFrame, on: Sequence[str], subject: str, pattern: str = "pattern") -> DataFrame:
    """Pairs of rows and rules of their site whose pattern is found in the subject: an equi-join by site with the regex as its rest."""
    return rows.join(rules, list(on)).where(F.regexp_like(F.col(subject), F.col(pattern)))


def date_macros(c: Column, now: Column) -> Column:
    """%@YEAR(+n)%, MONTH, DAY, HOUR, MINUTE, SECOND of ``now`` plus n (signed) hours."""
    parts = {"YEAR": "yyyy", "MONTH": "MM", "DAY": "dd", "HOUR": "HH", "MINUTE": "mm", "SECOND": "ss"}
    pieces = F.split(c, r"(?=%@[A-Z]+(?:\([+-]?\d+\))?%)|(?<=%@[A-Z]{3,6}%)|(?<=\)%)")

    def one(p: Column) -> Column:
        hours = F.coalesce(F.regexp_extract(p, r"\(([+-]?\d+)\)", 1).try_cast("int"), F.lit(0))
        moment = now + F.make_interval(hours=hours)
        out = p
        for name, fmt in parts.items():
            out = F.when(p.rlike(rf"^%@{name}(?:\([+-]?\d+\))?%$"), F.date_format(moment, fmt)).otherwise(out)
        return out

    return F.array_join(F.transform(pieces, one), "")


def replaced(c: Column, rules: Sequence[tuple[Column | None, str, str]]) -> Column:
    """Replace rules (condition or None, pattern, replacement with \\1) one after another."""
    import re

    for condition, what, by in rules:
        new = F.regexp_replace(c, what, re.sub(r"\\(\d)", r"$\1", by.replace("$", "\\$")))
        c = new if condition is None else F.when(condition, new).otherwise(c)
    return c


def last_match(subject: Column, rules: Sequence[tuple[str, Column]], default: Column) -> Column:
    """The value of the last rule whose pattern is found."""
    out = default
    for pattern, value in rules:
        out = F.when(subject.rlike(pattern), value).otherwise(out)
    return out


def condition(text: str, fields: dict[str, Column]) -> Column:
    """``name op value`` with =, ==, <>, !=, match (from the start), search, is empty."""
    import re

    m = re.fullmatch(r"\s*([\w.]+)\s+(?:(is empty)|(==|=|<>|!=|match|search)\s+(.*?))\s*", text, flags=re.DOTALL)
    if not m:
        raise ValueError(f"no condition: {text}")
    c, value = fields[m[1]], (m[4] or "").strip("'\"")
    if m[2]:
        return F.coalesce(c.cast("string"), F.lit("")) == ""
    if m[3] in ("=", "=="):
        return c.cast("string") == value
    if m[3] in ("<>", "!="):
        return c.cast("string") != value
    return c.cast("string").rlike(("^(?:" + value + ")") if m[3] == "match" else value)


def first_true(rules: Sequence[tuple[str, Column]], fields: dict[str, Column], default: Column) -> Column:
    """The value of the first rule whose condition holds."""
    out = default
    for text, value in reversed(rules):
        out = F.when(condition(text, fields), value).otherwise(out)
    return out


def kept_by_regex(values: Column, include: str | None, exclude: str | None) -> Column:
    """Array elements that the include pattern finds and the exclude pattern does not."""
    out = values if include is None else F.filter(values, lambda x: x.rlike(include))
    return out if exclude is None else F.filter(out, lambda x: ~x.rlike(exclude))


def existing(rows: DataFrame, known: DataFrame, keys: Sequence[str], max_age_days: Column, now: Column, updated: str) -> DataFrame:
    """Rows with ``seen``: 0 new, 1 known, 2 known but older than its age allows (to be set to new)."""
    old = known.select(*keys, F.col(updated).alias("_at"))
    out = rows.join(old, list(keys), "left")
    stale = F.col("_at") < now - F.make_interval(days=max_age_days)
    return out.withColumn("seen", F.when(F.col("_at").isNull(), 0).when(stale, 2).otherwise(1)).drop("_at")
