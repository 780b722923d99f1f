"""URL filters: a trie over reversed host labels and path segments.

Every rule is stored under the labels of its host, last label first, and below
them under the whole segments of its path; what follows its last slash is kept
at the node as a beginning. A url walks down the trie once and meets all rules
that fit. A trie is built on the driver and broadcast: it holds up to
``max_rules`` rules, whatever the pages. A longer list is taken in parts, one
trie after the other, and the longest rule of all parts wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotsieve.session import settle

#: (action, host, path) of the rules of the registered query
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HOST_END = re.compile("[/?#]")
_PATH_END = re.compile("[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for null and for a url without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = _HOST_END.search(rest)
    if end is None:
        return rest.translate(_LOWER), ""
    return rest[: end.start()].translate(_LOWER), _PATH_END.split(rest[end.start() :], maxsplit=1)[0]


class UrlTrie:
    """Rules of one list; equal rules of both actions block."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            if action not in ("allow", "block"):
                raise ValueError(f"unknown action {action!r}")
            node = self.root
            labels = host.translate(_LOWER).split(".")
            for label in reversed(labels):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, rest = path.split("/")
            node = node.setdefault("paths", {})
            for segment in whole:
                node = node.setdefault("next", {}).setdefault(segment, {})
            # by length: a segment is looked up once for each length there is
            found = node.setdefault("begins", {}).setdefault(len(rest), {})
            if found.get(rest, ("", ""))[1] != "block":
                found[rest] = (host.translate(_LOWER) + path, action, len(labels))

    def match(self, host: str, path: str) -> tuple[str, str, int] | None:
        """The longest rule that fits, its action and number of labels; at equal length that of more labels."""
        best = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get("hosts", {}).get(label)
            if node is None:
                break
            below = node.get("paths")
            for segment in segments:
                if below is None:
                    break
                for size, beginnings in below.get("begins", {}).items():
                    rule = beginnings.get(segment[:size])
                    if rule is not None and (best is None or len(rule[0]) >= len(best[0])):
                        best = rule
                below = below.get("next", {}).get(segment)
        return best


def filter_urls(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] = RULES,
    key: str = "page_id",
    url: str = "url",
    default: str = DEFAULT,
    max_rules: int = 200_000,
) -> DataFrame:
    """(key, host, path, rule, verdict), one row for each row of ``pages``.

    A rule fits its host and all subdomains if the path of the url starts with
    that of the rule; the longest wins, whatever its action. ``rule`` is null
    and ``verdict`` is ``default`` where none fits. A null url, and one without
    ``://``, has an empty host and path. Repeated rows are judged each; other
    columns are not read. ``rules`` may be of any number and is read once: each
    ``max_rules`` of them are one broadcast trie and one pass over the urls,
    written before the next, so that a worker holds one trie at a time. Without
    rules all urls have the default.
    """
    spark = pages.sparkSession
    best = "struct<size: int, labels: int, action: string, rule: string>"
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.lit(None).cast(best).alias("_best"))
    rules = iter(rules)
    part = list(islice(rules, max_rules))
    while True:
        trie = spark.sparkContext.broadcast(UrlTrie(part))
        rows = rows.withColumn("_found", _judge(trie)(F.col("_url")))
        # longest first, then of most labels, then block before allow; null where no rule fits
        rows = rows.withColumn("_best", F.greatest("_best", F.col("_found.best")))
        part = list(islice(rules, max_rules))
        if not part:
            break
        rows = settle(rows.select("_key", "_url", "_best"), "judged-urls")
        trie.destroy()
    return rows.select(
        F.col("_key").alias(key), "_found.host", "_found.path", F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )


def _judge(trie: Broadcast):
    """Host and path of urls, and the best rule of one trie."""
    best = pa.struct([("size", pa.int32()), ("labels", pa.int32()), ("action", pa.string()), ("rule", pa.string())])

    @F.arrow_udf("host string, path string, best struct<size: int, labels: int, action: string, rule: string>")
    def judge(urls: pa.Array) -> pa.Array:
        hosts, paths, found = [], [], []
        for value in urls.to_pylist():
            host, path = split_url(value)
            hosts.append(host)
            paths.append(path)
            rule = trie.value.match(host, path)
            found.append(rule and {"size": len(rule[0]), "labels": rule[2], "action": rule[1], "rule": rule[0]})
        columns = [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(found, best)]
        return pa.StructArray.from_arrays(columns, ["host", "path", "best"])

    return judge
