"""robots.txt as tables of rules, and the predicate over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, pattern, allow, ord) of the first group that names the agent, else of the first
    that speaks to all.

    Consecutive user-agent lines share a group; comments and carriage returns go; an empty
    pattern says nothing.
    """
    rules = _chosen(robots, agent).where("k IN ('allow', 'disallow') AND v <> ''")
    return rules.select("origin", F.col("v").alias("pattern"), (F.col("k") == "allow").alias("allow"), "ord")


def delays(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, delay) in seconds of the agent's group, where it asks for one; the first counts."""
    seconds = _chosen(robots, agent).where("k = 'crawl-delay'").withColumn("s", F.expr("try_cast(v AS double)")).where("s >= 0")
    return seconds.groupBy("origin").agg(F.min_by("s", "ord").alias("delay"))


def _chosen(robots: DataFrame, agent: str) -> DataFrame:
    """The lines (origin, ord, k, v) of each robots file's group for an agent."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("ord", "line"))
    line = F.trim(F.regexp_replace("line", "#.*$", ""))
    kv = lines.select(
        "origin", "ord", F.lower(F.trim(F.regexp_extract(line, r"^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)).alias("v")
    ).where("k IN ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    by = Window.partitionBy("origin").orderBy("ord")
    opens = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(by), F.lit("")) != "user-agent")
    grouped = kv.withColumn("g", F.sum(opens.cast("int")).over(by)).where("g > 0")
    name = agent.split("/")[0].strip().lower()
    own = F.when(F.col("v") == "*", 1).when(F.lower(F.trim(F.element_at(F.split("v", "/"), 1))) == name, 2).otherwise(0)
    speaks = grouped.where("k = 'user-agent'").groupBy("origin", "g").agg(F.max(own).alias("rank")).where("rank > 0")
    chosen = speaks.groupBy("origin").agg(F.max_by("g", F.struct("rank", -F.col("g"))).alias("g"))
    return grouped.join(chosen, ["origin", "g"])


def sitemaps(robots: DataFrame) -> DataFrame:
    """(origin, loc) of the sitemap lines, whatever their group."""
    lines = robots.select("origin", F.posexplode(F.split("body", r"\r\n|\r|\n")).alias("ord", "line"))
    loc = F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*([^#]+)", 1))
    return lines.select("origin", loc.alias("loc"), "ord").where("loc <> ''")


def pattern_regex(pattern: Column) -> Column:
    """A rule's pattern as a regular expression anchored at its start."""
    ends = pattern.endswith("$")
    body = F.when(ends, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.^$|?+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(ends, F.lit("$")).otherwise(F.lit("")))


def allow(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (origin, target, ...) with allowed: the longest matching rule decides, a tie
    allows, no match allows.  target is the path with its query.  Rules of an origin are
    few; the join is by origin."""
    size = F.length(F.regexp_replace("pattern", r"\$$", ""))
    regex = rules.select("origin", pattern_regex(F.col("pattern")).alias("_re"), size.alias("_n"), F.col("allow").alias("_a"))
    hits = urls.select("origin", "target").distinct().join(regex, "origin").where(F.expr("target RLIKE _re"))
    best = hits.groupBy("origin", "target").agg(F.max_by("_a", F.struct("_n", "_a")).alias("allowed"))
    return urls.join(best, ["origin", "target"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
