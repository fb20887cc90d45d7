"""URL verdicts by nested (host, path) rules, as a sort-merge range join.

A rule fits its host and all subdomains when the URL's path starts with the rule's
path. Hosts are written as reversed labels (``net.example.``), so that all hosts below
a rule's host form one interval of the sorted keys, and so do all paths that start
with a rule's path. Rules and URLs are sorted together by key; each rule carries the
stack of the rules that are active from its key on, a URL takes the stack of the last
rule at or before it, and drops those that have ended by then.

The sweep runs twice: over hosts, then, for the hosts that have rules, over paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueglass.llm.store import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Stands between host and path in a key; sorts before every other character.
_BREAK = "\u0000"


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "[.]"))


def _host_key(labels: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): for each rule key the rules whose keys it starts with, outermost first.

    ``rules`` has ``key``, ``starts`` (the beginnings of the key that may be rules, the
    key itself among them) and ``rule``. A stack is as long as rules are nested.
    """
    above = rules.select(F.col("key").alias("start"), F.struct(F.length("key").alias("n"), "key", "rule").alias("above"))
    return (
        rules.select("key", F.explode("starts").alias("start"))
        .join(above, "start")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("above")).alias("stack"))
    )


def _sweep(points: DataFrame, stacks: DataFrame) -> DataFrame:
    """``points`` with the ``stack`` of active rules at their ``key``, outermost first.

    Both are dealt out by ranges of the key, a frequent key over many ranges by the
    points' ``row``. The last stack of each range is carried to the ranges after it:
    one row for each range.
    """
    marks = stacks.withColumn("mark", F.lit(True))
    events = written(
        points.withColumn("mark", F.lit(False))
        .unionByName(marks, allowMissingColumns=True)
        .withColumn("is_point", ~F.col("mark"))
        .repartitionByRange("key", "is_point", "row")
        .withColumn("range", F.spark_partition_id())
    )
    own = F.max_by(F.when(F.col("mark"), F.col("stack")), F.when(F.col("mark"), F.col("key")))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        events.groupBy("range")
        .agg(own.alias("last"))
        .select("range", F.last("last", ignorenulls=True).over(before).alias("carried"))
    )
    inside = Window.partitionBy("range").orderBy("key", "is_point")
    swept = F.last("stack", ignorenulls=True).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    active = F.filter(F.coalesce("swept", "carried"), lambda r: F.startswith(F.col("key"), r["key"]))
    return (
        events.withColumn("swept", swept)
        .where(~F.col("mark"))
        .join(F.broadcast(carried), "range")  # one row for each range
        .withColumn("stack", active)
        .drop("mark", "is_point", "range", "swept", "carried")
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` has host, path and verdict; hosts are compared with A-Z lower-cased. The
    longest fitting rule (host and path together) wins, of two equally long ones that
    with the longer host. Rules with a null or empty host or a null verdict fit nothing;
    a null path is an empty one; of two rules for one host and path the verdict that
    sorts last wins (block before allow). URLs that are null or without ``://`` have an
    empty host and path and no rule. Repeated rows stay repeated; without rules, or
    without pages, the result has all pages with the default, or none.
    """
    path = F.coalesce("path", F.lit(""))
    host = F.translate("host", _UPPER, _LOWER)
    known = (
        rules.select(host.alias("host"), path.alias("path"), "verdict")
        .where("host <> '' and verdict is not null")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", _labels(F.col("host")))
        .withColumn("host_key", _host_key(F.col("labels")))
    )
    ends = F.sequence(F.lit(1), F.size("labels"))
    hosts = known.select(
        F.col("host_key").alias("key"),
        F.transform(ends, lambda n: _host_key(F.slice(F.col("labels"), 1, n))).alias("starts"),
        F.lit(None).cast("struct<name:string,host:string,verdict:string>").alias("rule"),
    ).distinct()
    lengths = known.groupBy("host_key").agg(F.collect_set(F.length("path")).alias("lengths"))
    beginnings = F.transform(
        F.filter("lengths", lambda n: n <= F.length("path")),
        lambda n: F.concat("host_key", F.lit(_BREAK), F.substring("path", F.lit(1), n)),
    )
    paths = known.join(lengths, "host_key").select(
        F.concat("host_key", F.lit(_BREAK), "path").alias("key"),
        beginnings.alias("starts"),
        F.struct(F.concat("host", "path").alias("name"), "host", "verdict").alias("rule"),
    )
    urls = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        F.monotonically_increasing_id().alias("row"),
    )
    at_hosts = _sweep(
        urls.withColumn("key", _host_key(_labels(F.col("host")))), _stacks(hosts)
    ).drop("key")
    row = ["row", "page_id", "host", "path"]
    within = F.when(F.col("host") != "", F.filter("stack", lambda r: r["key"] != "."))
    at_hosts = written(at_hosts.select(*row, within.alias("stack")))
    no_rule = F.coalesce(F.size("stack"), F.lit(0)) < 1
    at_paths = _sweep(
        at_hosts.where(~no_rule)
        .select(*row, F.explode("stack.key").alias("host_key"))
        .select(*row, F.concat("host_key", F.lit(_BREAK), "path").alias("key")),
        _stacks(paths),
    )
    rule = F.element_at("stack", -1)["rule"]
    best = F.max_by("rule", F.struct(F.length("rule.name"), F.length("rule.host")))
    judged = (
        at_paths.select(*row, F.when(F.size("stack") > 0, rule).alias("rule"))
        .groupBy(*row)
        .agg(best.alias("rule"))
    )
    rest = at_hosts.where(no_rule).select(*row, F.lit(None).cast(judged.schema["rule"].dataType).alias("rule"))
    return judged.union(rest).select(
        "page_id",
        "host",
        "path",
        F.col("rule.name").alias("rule"),
        F.coalesce("rule.verdict", F.lit(default)).alias("verdict"),
    )
