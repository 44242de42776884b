"""URL rules by a sorted sweep over intervals, in DataFrame operations only.

A rule (host, path) fits its host, all subdomains and every path that starts with its path. Hosts are
turned around, label by label, so that a host's canonical key starts with those of its parents, and a
page enters the sweep once under each parent that has rules. There a rule's path is an interval of
sorted paths, and intervals are nested or disjoint. The sweep goes through rules and pages in
order; the rule begun last brings the stack of rules around it, from which those that have ended
before the page are popped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aforo.sources.scratch import stored

#: Pages of one host that meet in one window.
PAGES_PER_SWEEP = 50_000
DEFAULT_VERDICT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def reversed_key(host: Column) -> Column:
    """``a.example.net`` as ``net.example.a``."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def parents(host: Column) -> Column:
    """The host and all hosts above it."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (host, path, verdict)."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per distinct rule: ``_key``, ``_path`` and ``_stack``, the rule and those around it, innermost first.

    Of rules that differ only in the verdict, block wins.
    """
    single = (
        rules.filter(F.col("host").isNotNull() & (F.col("host") != ""))
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("_key", reversed_key(F.col("host")))
    )
    prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    around = single.select("_key", "path", F.explode(prefixes).alias("_outer"))
    outer = single.select("_key", F.col("path").alias("_outer"), "host", "verdict")
    entry = F.struct(F.length("_outer").alias("n"), F.col("_outer").alias("path"), F.col("host"), F.col("verdict"))
    return (
        around.join(outer, ["_key", "_outer"])
        .groupBy("_key", F.col("path").alias("_path"))
        .agg(F.reverse(F.array_sort(F.collect_list(entry))).alias("_stack"))
    )


def judge(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = DEFAULT_VERDICT,
    pages_per_sweep: int = PAGES_PER_SWEEP,
    scratch: str | None = None,
) -> DataFrame:
    """The pages with ``host``, ``path``, ``rule`` (host and path of the longest that fits, else NULL) and ``verdict``.

    Length is that of host and path together; of equally long rules the one with the longer host
    wins. A NULL url, or one without ``://``, has an empty host, which no rule fits, and gets the default.
    Repeated rows and urls are judged alike, empty tables of pages or rules are valid. Columns of the
    result's names are replaced, others carried along.

    Each distinct (host, path) is judged once. Only pages under a host that has rules enter a sweep; a
    host with many is swept in several parts, to each of which its rules go.
    """
    carried = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(
        *(F.col(f"`{c}`") for c in carried), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path")
    )
    stacks = stored(rule_stacks(rules), "url-rules", scratch)
    ruled = stacks.groupBy("_key").agg(F.max(F.length("_path")).alias("_longest"))
    distinct = parsed.select("host", "path").distinct()
    levels = distinct.select("host", "path", F.explode(parents(F.col("host"))).alias("_parent"))
    entries = stored(
        levels.withColumn("_key", reversed_key(F.col("_parent"))).drop("_parent").join(ruled, "_key", "left_semi"), "url-entries", scratch
    )

    # Hosts are cut into as many parts as their pages need, by a hash of the page.
    parts = entries.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / pages_per_sweep).cast("long").alias("_parts"))
    split = entries.join(parts, "_key").select(
        "_key",
        F.pmod(F.xxhash64("host", "path"), F.col("_parts")).alias("_part"),
        F.col("path").alias("_path"),
        F.lit(1).alias("_kind"),
        "host",
        F.lit(None).cast(stacks.schema["_stack"].dataType).alias("_stack"),
    )
    begun = stacks.join(parts, "_key").select(
        "_key",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"),
        "_path",
        F.lit(0).alias("_kind"),
        F.lit(None).cast("string").alias("host"),
        "_stack",
    )
    sweep = Window.partitionBy("_key", "_part").orderBy("_path", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = split.unionByName(begun).withColumn("_around", F.last("_stack", ignorenulls=True).over(sweep)).filter("_kind = 1")
    active = F.filter("_around", lambda r: F.startswith(F.col("_path"), r["path"]))
    # get() is NULL where all rules of the stack have ended.
    best = swept.select("host", F.col("_path").alias("path"), F.get(active, F.lit(0)).alias("_rule")).filter("_rule IS NOT NULL")
    written = F.concat("_rule.host", "_rule.path")
    rank = F.struct(F.length(written), F.length("_rule.host"), written.alias("rule"), F.col("_rule.verdict").alias("verdict"))
    judged = best.groupBy("host", "path").agg(F.max(rank).alias("_best")).select("host", "path", "_best.rule", "_best.verdict")
    return parsed.join(judged, ["host", "path"], "left").select(
        *(F.col(f"`{c}`") for c in carried), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
