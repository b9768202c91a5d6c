"""robots.txt: parsing to rules, and the verdict for a URL."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.operators.rows import per_row

RULE = T.ArrayType(T.StructType([T.StructField("agent", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("allow", T.BooleanType()), T.StructField("path", T.StringType()), T.StructField("delay", T.DoubleType())]))


def rules_of(text: str) -> list[dict]:
    """(agent, ordinal, allow, path, delay) of every group; groups for all agents come last, a blank line ends a group."""
    groups: list[tuple[list[str], list[tuple[bool, str]], list[float]]] = []
    agents: list[str] = []
    rules: list[tuple[bool, str]] = []
    delay: list[float] = []

    def close():
        nonlocal agents, rules, delay
        if agents:
            groups.append((agents, rules, delay))
        agents, rules, delay = [], [], []

    for line in text.splitlines():
        if not line.strip():
            close()
            continue
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "user-agent":
            if rules or delay:
                close()
            agents.append(value.lower())
        elif agents and name in ("allow", "disallow"):
            rules.append((name == "allow", value))
        elif agents and name == "crawl-delay":
            try:
                delay.append(float(value))
            except ValueError:
                pass
    close()
    ordered = [g for g in groups if "*" not in g[0]] + [g for g in groups if "*" in g[0]]
    out, n = [], 0
    for names, group_rules, d in ordered:
        for agent in names:
            for allow, path in group_rules or [(True, "/")]:
                # an empty path turns a rule's meaning round
                out.append({"agent": agent, "ordinal": n, "allow": allow if path else not allow, "path": path or "/", "delay": d[0] if d else None})
                n += 1
    return out


@F.pandas_udf(RULE)
def parse_robots(text: pd.Series) -> pd.Series:
    return pd.Series([rules_of(t or "") for t in text])


def path_pattern(path: Column) -> Column:
    """Regular expression of a rule's path: * is any run, a last $ the end."""
    quoted = F.regexp_replace(path, r"([\\.\[\]{}()+?^|$])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\\\$$", "\\$"))


def allowed(urls: DataFrame, host: str, path: str, rules: DataFrame, agent: str) -> DataFrame:
    """``urls`` with ``allowed``: the first matching rule of the first group for the agent (or of that for all); no rule allows.

    ``rules`` has host and the fields of ``parse_robots``.
    """
    low = agent.lower()
    mine = rules.where((F.lit(low).contains(F.col("agent")) & (F.col("agent") != "")) | (F.col("agent") == "*"))
    mine = mine.select(F.col("host").alias("_h"), (F.col("agent") == "*").alias("_all"), F.col("ordinal").alias("_o"), F.col("allow").alias("_allow"), path_pattern(F.col("path")).alias("_pattern"))
    fits = F.regexp_like(F.col(path), F.col("_pattern"))
    first = lambda group: F.min_by("_allow", F.when(fits & group, F.col("_o")))
    verdict = F.when(F.bool_or(~F.col("_all")), first(~F.col("_all"))).otherwise(first(F.col("_all")))
    return per_row(urls, lambda rows: rows.join(mine, F.col(host) == F.col("_h"), "left"), allowed=F.coalesce(verdict, F.lit(True)))


def allowed_for_all(urls: DataFrame, host: str, path: str, rules: DataFrame, agents: list[str]) -> DataFrame:
    """``allowed`` only if every one of the agents is."""
    out = urls
    for i, a in enumerate(agents):
        out = allowed(out, host, path, rules, a).withColumnRenamed("allowed", f"_a{i}")
    verdict = F.lit(True)
    for i in range(len(agents)):
        verdict = verdict & F.col(f"_a{i}")
    return out.withColumn("allowed", verdict).drop(*[f"_a{i}" for i in range(len(agents))])


def matches_rule(path: str, url_path: str) -> bool:
    """The same test for one path, for callers without a table."""
    pattern = "".join(".*" if c == "*" else "$" if c == "$" and i == len(path) - 1 else re.escape(c) for i, c in enumerate(path))
    return re.match(pattern, url_path) is not None
