"""URL rules by a sort-merge range join with a sorted sweep. DataFrame functions only.

A host's key is its labels in reverse, each with an end mark, so that a host and all its subdomains are one interval
of keys. The intervals of rules nest or are disjoint: a sweep over their sorted ends keeps the stack of active rules
and writes it down at each end. URLs and ends are then sorted together into ranges; within a range each URL takes the
stack of the last end before it, and at a range's start the last stack of the ranges before. Among the stack's rules
whose path begins the URL's path the longest wins. Equal hosts may lie in several ranges, so a hot host splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut, only

END, AFTER = "\x01", "\x02"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 20_000
STACK = "array<struct<path:string,length:int,nth:int,rule:string,verdict:string>>"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(F.translate(host, END + AFTER, "??"), r"\.")), END), F.lit(END))


def swept(rules: list[Rule]) -> list[tuple[str, list[tuple[int, Rule]]]]:
    """(key, active rules from that key on), in the order of the keys; the rules are a list of bounded length."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    keys = [END.join(reversed(r.host.lower().split("."))) + END for r in rules]
    ends = sorted([(k[:-1] + AFTER, 0, i) for i, k in enumerate(keys)] + [(k, 1, i) for i, k in enumerate(keys)])
    out: list[tuple[str, list[tuple[int, Rule]]]] = []
    stack: list[tuple[int, Rule]] = []
    for key, opens, i in ends:
        stack = [*stack, (i, rules[i])] if opens else [x for x in stack if x[0] != i]
        if out and out[-1][0] == key:
            out[-1] = (key, stack)
        else:
            out.append((key, stack))
    return out


def _ends(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    def entry(i: int, r: Rule) -> Column:
        return F.struct(F.lit(r.path).alias("path"), F.lit(len(r.host + r.path)).alias("length"), F.lit(-i).alias("nth"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))

    rows = [F.struct(F.lit(key).alias("key"), F.array(*[entry(*x) for x in stack]).cast(STACK).alias("stack")) for key, stack in [("", []), *swept(rules)]]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("e")).select("e.key", "e.stack")


def judge_urls(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule (null: none fits), verdict.

    A null url or one without "://" has an empty host and path and gets the default. Of rules of equal length the first
    in the list wins. Null page_ids and repeated rows stay as they are; other columns are ignored; an empty table gives
    an empty table.
    """
    host, path = host_and_path(F.col(url))
    urls = only(pages, page_id, url).select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.select(reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast(STACK).alias("stack"))
    ends = _ends(pages.sparkSession, rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    ranged = urls.unionByName(ends).repartitionByRange("key", "kind", "page_id", "path").withColumn("range", F.spark_partition_id())
    ranged = cut(ranged)
    last = ranged.where("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("stack"))
    every = ranged.select("range").distinct().join(last, "range", "left")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = every.select("range", F.last("stack", ignorenulls=True).over(before).alias("carried"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = ranged.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").join(carried, "range")
    active = F.coalesce(F.col("stack"), F.col("carried"))
    fitting = F.filter(active, lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["length"], r["nth"], r["rule"], r["verdict"])))
    return found.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
