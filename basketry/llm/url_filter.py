"""URL allow and block lists as a broadcast trie.

A rule is ``host/path``: it fits its host and all subdomains when the url's
path starts with the rule's path. The trie branches on the host's labels from
the right (net, example, www) and then on the path's segments; a rule's last
segment, which may be cut anywhere, is matched as a prefix. One walk over a
url finds every rule that fits; the longest host wins, then the longest path,
whether it allows or blocks. If a rule is given twice with both verdicts,
``block`` wins.

The trie is built on the driver and broadcast only for up to
``MAX_BROADCAST_RULES`` rules (flat arrays, under 100 MB in each Python
worker). Longer lists stay distributed:
every url joins the rules' (host, path length) pairs for each of its host
suffixes, then the rules themselves by equality; the verdicts are the same.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
lower-cased. Path: from there up to ``?``, ``#`` or the end. A null url or one
without ``://`` has empty host and path, fits no rule and gets the default.
Repeated rows are judged one by one; an empty table gives no rows; without rules
every url gets the default. Columns other than the id and the url are not read
(``allowed_pages`` keeps them, whatever their names).
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.text import LOWER_AZ, UPPER_AZ
from basketry.llm.workdir import fresh

MAX_BROADCAST_RULES = 500_000
DEFAULT = "allow"


class UrlTrie:
    """Reversed host labels, then path segments, in flat arrays: an edge is the
    hash of its parent node and its label, kept sorted beside the child's
    number; a rule's last segment is an edge to the rule. Hashes only steer the
    walk: a rule that it ends at is compared with the url itself."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        edges: dict[int, int] = {}
        ends: dict[int, int] = {}
        texts, blocks, longest = [], bytearray(), array("i", [0])

        def step(node: int, label: str) -> int:
            key = self._edge(node, label)
            if key not in edges:
                edges[key] = len(longest)
                longest.append(0)
            return edges[key]

        for host, path, verdict in rules:
            node = 0
            for label in reversed(host.split(".")):
                node = step(node, "." + label)
            *whole, last = path.split("/")
            node = step(node, "/")
            for segment in whole:
                node = step(node, "/" + segment)
            key = self._edge(node, "=" + last)
            if key in ends:
                blocks[ends[key]] |= verdict == "block"
                continue
            ends[key] = len(blocks)
            blocks.append(verdict == "block")
            texts.append((len(host), (host + path).encode()))
            longest[node] = max(longest[node], len(last) + 1)
        self._edges, self._children = self._sorted(edges)
        self._ends, self._rules = self._sorted(ends)
        self._longest, self._blocks = longest, bytes(blocks)         # longest: of a node's rule segments, plus one
        self._hosts = array("i", [n for n, _ in texts])
        self._text = b"".join(t for _, t in texts)
        self._starts = array("q", accumulate((len(t) for _, t in texts), initial=0))

    @staticmethod
    def _edge(node: int, label: str) -> int:
        return xxhash.xxh3_64_intdigest(label.encode(), node)

    @staticmethod
    def _sorted(found: dict[int, int]) -> tuple[array, array]:
        keys = sorted(found)
        return array("Q", keys), array("i", [found[k] for k in keys])

    def _step(self, node: int, label: str) -> int:
        key = self._edge(node, label)
        at = bisect_left(self._edges, key)
        return self._children[at] if at < len(self._edges) and self._edges[at] == key else -1

    def _fits(self, node: int, last: str, host: str, path: str) -> int:
        """The node's rule with the longest segment that ``last`` starts
        with; -1 if there is none."""
        for n in range(min(len(last), self._longest[node] - 1), -1, -1):
            key = self._edge(node, "=" + last[:n])
            at = bisect_left(self._ends, key)
            if at < len(self._ends) and self._ends[at] == key:
                k = self._rules[at]
                rule = self._text[self._starts[k]:self._starts[k + 1]].decode()
                h, p = rule[:self._hosts[k]], rule[self._hosts[k]:]
                if (host == h or host.endswith("." + h)) and path.startswith(p):
                    return k
        return -1

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        best, node, segments = -1, 0, path.split("/")
        if not host:
            return None
        for label in reversed(host.split(".")):
            node = self._step(node, "." + label)
            if node < 0:
                break
            at, found = self._step(node, "/"), -1
            for segment in segments:
                if at < 0:
                    break
                k = self._fits(at, segment, host, path)
                found = k if k >= 0 else found
                at = self._step(at, "/" + segment)
            best = found if found >= 0 else best
        if best < 0:
            return None
        return self._text[self._starts[best]:self._starts[best + 1]].decode(), "block" if self._blocks[best] else "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))

    def upto(text: Column, *ends: str) -> Column:
        for e in ends:
            text = F.substring_index(text, e, 1)
        return text

    host = upto(rest, "/", "?", "#")
    path = upto(rest.substr(F.length(host) + 1, F.length(rest)), "?", "#")
    return F.translate(host, UPPER_AZ, LOWER_AZ), path


def _with_trie(urls: DataFrame, trie: UrlTrie, default: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(trie)

    def judge(batches):
        walk = shared.value
        for b in batches:
            found = [walk.longest(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                ["id", "host", "path", "rule", "verdict"])

    kind = urls.schema["id"].dataType.simpleString()
    return urls.mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string")


def _with_joins(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rule lists of any length, by equi-joins on
    (host suffix) and then (host, path prefix) of the distinct urls."""
    once = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))   # block after allow
    sizes = rules.select("rule_host", F.length("rule_path").alias("size")).distinct()
    tried = (once.where("host <> ''").select("host", "path", F.explode(suffixes).alias("rule_host"))
             .join(sizes, "rule_host").where(F.col("size") <= F.length("path"))
             .withColumn("rule_path", F.expr("substring(path, 1, size)")))
    best = (tried.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule_host").alias("h"), F.col("size").alias("p"),
                                F.concat("rule_host", "rule_path").alias("rule"), "verdict")).alias("best")))
    return urls.join(best, ["host", "path"], "left").select(
        "id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 default: str = DEFAULT, max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """id_col, host, path, rule, verdict of every row of ``pages``.

    ``rules``: host, path, verdict (``allow`` or ``block``); rules with a null
    or an empty host are ignored, a null path is an empty one."""
    listed = rules.where("host <> ''").select(
        F.translate("host", UPPER_AZ, LOWER_AZ).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").distinct()
    host, path = host_and_path(F.col(url_col).cast("string"))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    head = listed.limit(max_broadcast + 1).collect()
    judged = (_with_trie(urls, UrlTrie([tuple(r) for r in head]), default) if len(head) <= max_broadcast
              else _with_joins(urls, listed, default))
    return judged.withColumnRenamed("id", id_col)


def allowed_pages(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """``pages`` (all columns) without the blocked ones."""
    url, = fresh(pages, "_url")
    keyed = pages.withColumn(url, F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    blocked = (url_verdicts(keyed.select(url).distinct(), rules, url, url, default)
               .where("verdict = 'block'").select(url))
    return keyed.join(blocked, url, "left_anti").drop(url)
