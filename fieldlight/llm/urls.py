"""URL filters: a trie over reversed host labels and path prefixes, broadcast.

A rule names a host (it and all subdomains) and a path prefix, and allows or blocks. The most
specific rule that fits wins: the longest text of host and path; block wins a tie, then the
greater text. Hosts are cut
out of the url as it stands (port and user stay part of it), A-Z lower-cased.

Nulls and repeats: a null url, or one without ://, has empty host and path, fits no rule and gets
the default verdict; repeated urls give equal rows; repeated rules count once. Columns of pages
named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, extended

#: Characters of rules that may be broadcast as a trie; longer lists are joined by host instead.
BROADCAST_CHARS = 64 << 20


class Trie:
    """Host labels from the right, then path characters' prefixes as whole segments and a tail."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, tail = path.split("/")  # every segment but the last must match whole
            node = node.setdefault("/", {})
            for segment in whole:
                node = node.setdefault(segment, {})
            lengths, ends = node.setdefault(None, (set(), {}))
            lengths.add(len(tail))
            if ends.get(tail, ("",))[0] != "block":
                ends[tail] = (action, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(action, rule) of the longest rule that fits."""
        best = None
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None or label == "":
                break
            if "/" in node:
                found = self._below(node["/"], path)
                if found and (best is None or (len(found[1]), *found) > (len(best[1]), *best)):
                    best = found
        return best

    @staticmethod
    def _below(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            lengths, ends = node.get(None, ((), {}))  # tails are looked up, one for each of their lengths
            for n in sorted((n for n in lengths if n <= len(segment)), reverse=True):
                if found := ends.get(segment[:n]):
                    best = found  # longer than what a segment before has found, as its path goes on
                    break
            node = node.get(segment)
            if node is None:
                break
        return best


def with_host_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    rest = F.coalesce(F.when(F.instr(url_col, "://") > 0, F.expr(f"substring({url_col}, instr({url_col}, '://') + 3)")), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", ascii_lower(host)).withColumn("path", path)


def url_verdicts(
    pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow", broadcast_chars: int = BROADCAST_CHARS
) -> DataFrame:
    """Adds host, path, rule and verdict. rules: action (allow or block), host, path."""
    pages = with_host_path(pages.drop("host", "path", "rule", "verdict"), url_col)
    rules = rules.select("action", ascii_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.where("host <> '' AND action IN ('allow', 'block')").distinct()
    size = rules.agg(F.sum(F.length("host") + F.length("path"))).head()[0] or 0
    if size > broadcast_chars:
        return _joined(pages, rules, default)
    listed = pages.sparkSession.sparkContext.broadcast([tuple(r) for r in rules.collect()])  # bounded by broadcast_chars
    columns = pages.columns

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(listed.value)
        for frame in frames:
            found = [trie.find(h, p) for h, p in zip(frame["host"], frame["path"], strict=True)]
            yield frame[columns].assign(rule=[f and f[1] for f in found], verdict=[f[0] if f else default for f in found])

    return pages.mapInPandas(judge, extended(pages.schema, "rule string, verdict string"))


def _joined(pages: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts by an equi-join of distinct (host, path) suffixes to rule hosts, for lists too long to broadcast."""
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path", F.explode(tails).alias("tail"))
    r = rules.select(F.col("host").alias("tail"), F.col("path").alias("start"), "action")
    fits = each.join(r, "tail").where(F.expr("startswith(path, start)"))
    rank = F.struct(F.length("tail") + F.length("start"), "action", F.concat("tail", "start").alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", "best.rule", F.col("best.action").alias("verdict"))
    out = pages.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    return out.select(*pages.columns, "rule", "verdict")
