"""URL filter by sort-merge range join (operator 2), on DataFrame functions only.

A rule (host, path) fits its host and all subdomains, and urls whose path starts with the rule's.
The canonical key of a host is its labels reversed ("com.example.www"), a blank, then the path.
Each url is looked up under the key of every host suffix that has rules at all, so a rule's urls
are exactly the keys that start with the rule's key: one interval. A rule opens its interval with a
start event and closes it with an end event (its key and the byte FF, which UTF-8 never contains);
the end event carries the rule that encloses it, which is what a sweep would find on its stack of
active nested rules after popping. So the last event before a url's key names its innermost rule.

The sweep runs over a range-sorted table: partitions are cut by key and then by row, so a third of
all urls under one host, or of one url, is spread over partitions; what is active at a partition's
start comes from the last events of the partitions before it (one row each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small

#: Hosts of rules that may be broadcast; with more, the join is shuffled.
MAX_BROADCAST_HOSTS = 200_000
_END, _START, _URL = 0, 1, 2


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    whole = F.coalesce(at > 0, F.lit(False))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(whole, host).otherwise(""), F.when(whole, path).otherwise("")


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def _key(host: Column, path: Column) -> Column:
    return F.encode(F.concat(host, F.lit(" "), path), "UTF-8")


def _rule_events(rules: DataFrame) -> DataFrame:
    """Start and end events (key, ord, active); active is null where no rule encloses the end."""
    rules = rules.select(_reversed(F.col("host")).alias("rhost"), "path", F.struct("rule", "action", F.length("rule").alias("size"), F.length("host").alias("host_size")).alias("own"))
    shorter = rules.select("rhost", "path", F.explode(F.expr("sequence(0, greatest(length(path) - 1, 0))")).alias("n")).where("n < length(path)")
    shorter = shorter.select("rhost", "path", F.expr("substring(path, 1, n)").alias("outer_path"))
    outer = rules.select("rhost", F.col("path").alias("outer_path"), F.col("own").alias("outer_own"))
    parents = shorter.join(outer, ["rhost", "outer_path"]).groupBy("rhost", "path").agg(F.max_by("outer_own", F.length("outer_path")).alias("parent"))
    nested = rules.join(parents, ["rhost", "path"], "left").select(_key(F.col("rhost"), F.col("path")).alias("key"), "own", "parent")
    starts = nested.select("key", F.lit(_START).alias("ord"), F.struct(F.col("own").alias("rule")).alias("active"))
    ends = nested.select(F.concat("key", F.lit(b"\xff")).alias("key"), F.lit(_END).alias("ord"), F.struct(F.col("parent").alias("rule")).alias("active"))
    return starts.union(ends)


def parse_rules(rules: DataFrame) -> DataFrame:
    """Rules (action, rule as host/path) -> (host, path, rule, action); of one rule given twice, block wins. Rules without a host or with a null are left out."""
    at = F.instr("rule", "/")
    host = F.when(at > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule"))
    path = F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise("")
    parsed = rules.where("rule is not null and action in ('allow', 'block')").select(ascii_lower(host).alias("host"), path.alias("path"), "rule", "action")
    return parsed.where("host <> ''").groupBy("host", "path").agg(F.min("rule").alias("rule"), F.max("action").alias("action"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url; other columns are not read).

    rules: columns action ('allow' or 'block') and rule ('host/path'). The longest fitting rule
    decides, the one with the longer host among equally long ones; without one, rule is null and
    verdict is default. Null urls and urls without ``://`` have an empty host and path and get
    default. Repeated rows are judged each on its own; null page_ids are kept.
    """
    rules = parse_rules(rules)
    host, path = host_path(F.col("url").cast("string"))
    urls = materialize(pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.expr("uuid()")), "urls")
    labels = F.reverse(F.split("host", r"\.", -1))
    suffixes = urls.select("row", "path", labels.alias("labels")).select("row", "path", F.explode(F.expr("transform(sequence(1, size(labels)), n -> array_join(slice(labels, 1, n), '.'))")).alias("rhost"))
    ruled = small(rules.select(_reversed(F.col("host")).alias("rhost")).distinct(), MAX_BROADCAST_HOSTS)
    active = "struct<rule:struct<rule:string,action:string,size:int,host_size:int>>"
    looked_up = suffixes.join(ruled, "rhost", "left_semi").select(_key(F.col("rhost"), F.col("path")).alias("key"), F.lit(_URL).alias("ord"), F.lit(None).cast(active).alias("active"), "row")
    events = _rule_events(rules).withColumn("row", F.lit(None).cast("string")).unionByName(looked_up)
    sorted_events = materialize(events.repartitionByRange("key", "ord", "row").withColumn("part", F.spark_partition_id()), "events")

    last = sorted_events.where("active is not null").groupBy("part").agg(F.max_by("active", F.struct("key", "ord")).alias("last"))
    parts = sorted_events.select("part").distinct().join(last, "part", "left")
    # one row for each partition
    carried = parts.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "ord", "row").rowsBetween(Window.unboundedPreceding, 0)
    swept = sorted_events.withColumn("now", F.last("active", ignorenulls=True).over(sweep)).where(F.col("ord") == _URL)
    found = swept.join(carried, "part").select("row", F.coalesce("now", "carried")["rule"].alias("found")).where("found is not null")
    best = found.groupBy("row").agg(F.max_by("found", F.struct("found.size", "found.host_size")).alias("best"))
    return urls.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
