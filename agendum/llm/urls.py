"""URL filters: a trie over reversed host labels and path segments, with the longest match between allow and block entries."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agendum.llm import common


@dataclass(frozen=True)
class UrlRule:
    """verdict: allow or block, for host and its subdomains and paths that start with path (case counts there)."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: behind the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end; both empty without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return common.ascii_lower(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Nodes are dictionaries: host labels from the last to the first, then whole path segments, then the beginnings of a last segment."""

    def __init__(self, rules: list[UrlRule]):
        self.root: dict = {"labels": {}, "paths": None}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node["labels"].setdefault(label, {"labels": {}, "paths": None})
            *whole, begin = rule.path.split("/")
            at = node["paths"] = node["paths"] or {"segments": {}, "begins": {}, "lengths": ()}
            for segment in whole:
                at = at["segments"].setdefault(segment, {"segments": {}, "begins": {}, "lengths": ()})
            old = at["begins"].get(begin)
            if old is None or (old.verdict, rule.verdict) == ("allow", "block"):
                at["begins"][begin] = rule
            at["lengths"] = tuple(sorted({len(b) for b in at["begins"]}))

    @staticmethod
    def bytes_of(rules: list[UrlRule]) -> int:
        """No less than a worker's memory for the trie: at most one node of three dictionaries for each label and segment."""
        return sum(800 * (r.host.count(".") + r.path.count("/") + 2) + 4 * len(str(r)) for r in rules)

    def find(self, host: str, path: str) -> UrlRule | None:
        """The longest rule (host and path together) that fits; the longer host among equals; block before allow for one rule."""
        best, size, node, segments = None, -1, self.root, None
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            at = node["paths"]
            if at is None:
                continue
            segments = path.split("/") if segments is None else segments
            for segment in segments:
                for n in at["lengths"]:
                    rule = at["begins"].get(segment[:n]) if n <= len(segment) else None
                    if rule is not None and len(rule.host) + len(rule.path) >= size:
                        best, size = rule, len(rule.host) + len(rule.path)
                at = at["segments"].get(segment)
                if at is None:
                    break
        return best


def judge_urls(pages: DataFrame, rules: list[UrlRule], url: str = "url", default: str = "allow", max_bytes: int = 64_000_000) -> DataFrame:
    """Adds host, path, rule (host and path of the longest rule that fits, else null) and verdict (its, else default) to each row.

    A null url or one without :// has an empty host and path and gets the default, unless a rule has an empty host. Rules
    whose trie takes max_bytes at most (as RuleTrie.bytes_of reckons) travel to every task; more are joined by host
    suffix instead, with the same result. Repeated rows are judged alike; columns of the added names are replaced; an empty table stays empty.
    """
    spark = pages.sparkSession
    common.ship(spark)
    kept = common.without(pages, ["host", "path", "rule", "verdict"])
    host, path = host_and_path(F.col(f"`{url}`"))
    out = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    if RuleTrie.bytes_of(rules) <= max_bytes:
        trie = spark.sparkContext.broadcast(RuleTrie(rules))

        @F.pandas_udf("rule string, verdict string")
        def judged(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
            found = [trie.value.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            return pd.DataFrame({"rule": [None if r is None else str(r) for r in found], "verdict": [default if r is None else r.verdict for r in found]})

        found = common.fresh(out, "found")
        out = out.withColumn(found, judged("host", "path"))
        return out.withColumns({"rule": F.col(found)["rule"], "verdict": F.col(found)["verdict"]}).drop(found)
    return _joined(out, spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "rule_host string, rule_path string, rule_verdict string"), default)


def _joined(out: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join: each distinct host and path meets the rules of its host's suffixes, and the longest that fits is kept."""
    distinct = out.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels)))))
    fits = distinct.withColumn("rule_host", suffix).join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    size = F.length("rule_host") + F.length("rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(size, F.length("rule_host"), (F.col("rule_verdict") == "block"), "rule_host", "rule_path", "rule_verdict")).alias("r"))
    best = best.select("host", "path", F.concat("r.rule_host", "r.rule_path").alias("rule"), F.col("r.rule_verdict").alias("verdict"))
    return out.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
