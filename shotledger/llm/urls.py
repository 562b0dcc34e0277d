"""URL filters: a trie over reversed host labels and path segments with longest-match precedence."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A list up to this many rules is broadcast as a trie (some 200 bytes a rule, so 40 MB at the most); beyond, it is joined.
MAX_TRIE_RULES = 200_000
#: The verdict where no rule fits.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first :// and the next of / ? # or the end, A-Z lower-cased; empty without ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """rules: (host, path, verdict). A node: labels to host nodes under "h"; under "p" the path trie, whose nodes have
    segments under "s" and, under "e", the beginnings of a next segment at which rules end, longest first. Of rules
    with one host and path the first in order of verdict stays, so that the result doesn't hang on their order."""
    root: dict = {}
    for host, path, verdict in sorted(set(rules), reverse=True):
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault("h", {}).setdefault(label, {})
        *whole, last = path.split("/")
        node = node.setdefault("p", {})
        for segment in whole:
            node = node.setdefault("s", {}).setdefault(segment, {})
        node.setdefault("e", {})[last] = (f"{host}{path}", verdict)
    todo = [root]
    while todo:
        node = todo.pop()
        todo += [*node.get("h", {}).values(), *node.get("s", {}).values(), *([node["p"]] if "p" in node else [])]
        if "e" in node:
            node["e"] = sorted(node["e"].items(), key=lambda x: -len(x[0]))
    return root


def longest(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule and verdict of the longest host, then path, that fits."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get("h", {}).get(label)
        if node is None:
            break
        at = node.get("p")
        for segment in segments:
            if at is None:
                break
            found = next((rule for start, rule in at.get("e", ()) if segment.startswith(start)), None)
            best = found or best
            at = at.get("s", {}).get(segment)
    return best


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT, max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """pages with host, path, rule and verdict; columns of those names are replaced.

    rules: columns host, path, verdict (allow or block). A rule fits its host and all subdomains where the url's path
    starts with the rule's; the longest host wins, then the longest path. A null url or one without :// has an empty
    host and path. Where no rule fits, rule is null and verdict the default. No rules: the default everywhere. An
    empty table gives no rows, repeated urls give equal results, very long ones are parsed whole, and the names of
    other columns don't matter. No shuffle while the list is small enough to broadcast; its number of rows is checked
    first, and a longer list is joined instead, with equal results.
    """
    others = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(F.struct(*(F.col(c) for c in others)).alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    kept = rules.select("host", "path", "verdict").dropna().distinct()
    few = kept.limit(max_trie_rules + 1).count() <= max_trie_rules
    judged = (_walk if few else _join)(parsed, kept, default)
    return judged.select(*(F.col("_row").getField(c).alias(c) for c in others), "host", "path", "rule", "verdict")


def _walk(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    trie = parsed.sparkSession.sparkContext.broadcast(build_trie(tuple(r) for r in rules.collect()))

    @F.pandas_udf("rule string, verdict string")
    def found(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        best = [longest(trie.value, h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame(best, columns=["rule", "verdict"], dtype=object)

    return parsed.withColumn("_found", found("host", "path")).withColumn("rule", F.col("_found.rule")).withColumn("verdict", F.col("_found.verdict")).drop("_found")


def _join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by an equi-join of the distinct pairs of host and path, on each host suffix and each beginning of the path that is as long as some rule's."""
    lengths = rules.agg(F.array_sort(F.collect_set(F.length("path"))).alias("n"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = parsed.select("host", "path").distinct()
    pairs = pairs.withColumn("_lengths", lengths.scalar())
    keys = pairs.withColumn("_host", F.explode(suffixes)).withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("path"))))
    keys = keys.withColumn("_path", F.expr("substring(path, 1, _n)"))
    named = rules.groupBy(F.col("host").alias("_host"), F.col("path").alias("_path")).agg(F.min("verdict").alias("_verdict"))
    hits = keys.join(named, ["_host", "_path"]).groupBy("host", "path")
    best = hits.agg(F.max(F.struct(F.length("_host").alias("a"), F.length("_path").alias("b"), F.concat("_host", "_path").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    out = parsed.join(best, ["host", "path"], "left")
    return out.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.coalesce("_best.verdict", F.lit(default))).drop("_best")


#: The rules of the registered query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def oracle_sql() -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    return rf"""
WITH r(rhost, rpath, v) AS (VALUES {values}),
u AS (SELECT row_number() OVER () AS rid, page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT rid, rhost || rpath AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
    FROM u JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM u LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (rid)"""
