"""robots.txt files as tables of rules, and the filter they make.

A rule belongs to its file's host and to the last agent named before it; rules of one agent add up,
wherever they stand. The rules of our own agent, named without its version, win over those for all
agents. An empty Disallow allows everything; comments and lines without a colon do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def agent_token(agent: str) -> str:
    """The name that robots files use for an agent: without its version, in lower case."""
    return agent.split("/", 1)[0].lower()


def parse_robots(files: DataFrame, text: str, agent: str) -> DataFrame:
    """Rows (host columns of ``files``..., field, value) that apply to ``agent``; fields are
    ``disallow`` and ``crawl-delay``."""
    token = agent_token(agent)
    keys = [c for c in files.columns if c != text]
    lines = files.select(*keys, F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("_n", "_line"))
    clean = F.btrim(F.regexp_replace("_line", "#.*$", ""), F.lit(" \t\n\r\x00\x0b"))
    fields = lines.filter(F.contains(clean, F.lit(":"))).select(*keys, "_n", F.lower(F.btrim(F.substring_index(clean, ":", 1))).alias("field"), F.btrim(F.regexp_replace(clean, "^[^:]*:", "")).alias("value"))
    before = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    owned = fields.withColumn("_agent", F.last(F.when(F.col("field") == "user-agent", F.lower("value")), ignorenulls=True).over(before))
    own = F.max((F.col("_agent") == token).cast("int")).over(Window.partitionBy(*keys))
    chosen = owned.withColumn("_own", own).filter(F.col("_agent") == F.when(F.col("_own") == 1, token).otherwise("*"))
    numeric = F.col("value").try_cast("double").isNotNull()
    return chosen.filter(((F.col("field") == "disallow") & (F.col("value") != "")) | ((F.col("field") == "crawl-delay") & numeric)).select(*keys, "field", "value")


def prefixes(path: Column) -> Column:
    """All prefixes of a path, the path itself last."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(path), F.lit(1))), lambda n: F.substr(path, F.lit(1), n))


def allowed(rows: DataFrame, rules: DataFrame, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose path starts with no prefix that their own host (``keys``) disallows.

    Each different (host, path) meets the rules by an equi-join on host and prefix, so the
    work grows with paths and not with paths times rules. Null paths or hosts are allowed.
    """
    banned = rules.filter("field = 'disallow'").select(*keys, F.col("value").alias("_rule")).distinct()
    asked = rows.select(*keys, F.col(path).alias("_path")).distinct()
    if keys:  # paths of hosts without rules have no prefixes to look up
        asked = asked.join(banned.select(*keys).distinct(), list(keys), "left_semi")
    hits = asked.select(*keys, "_path", F.explode(prefixes(F.col("_path"))).alias("_rule")).join(banned, [*keys, "_rule"], "left_semi").select(*[F.col(k).alias(f"_{k}") for k in keys], "_path").distinct()
    same = rows[path] == hits["_path"]
    for k in keys:
        same = same & (rows[k] == hits[f"_{k}"])
    return rows.join(hits, same, "left_anti")
