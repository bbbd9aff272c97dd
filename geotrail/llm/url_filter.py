"""Allow and block rules on URLs, matched in a broadcast trie.

The trie runs over the host's labels from the right (com, example, blog), and
below each host over the segments of the rule's path. A rule fits its host and
all subdomains, if the URL's path starts with the rule's path. Of the rules
that fit, the one with the longest host wins, then the one with the longest
path; of an allow and a block rule that are equally long, the block rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_RULES = 1_000_000       # about 300 MB of trie on an executor's Python worker
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_END = re.compile(r"[/?#]")
_PATH_END = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host runs from the first :// to /, ?, # or the end
    (A-Z lower-cased), the path from there to ?, # or the end; both are empty
    without a ://."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    m = _END.search(rest)
    at = m.start() if m else len(rest)
    return rest[:at].translate(_UPPER), _PATH_END.split(rest[at:], maxsplit=1)[0]


class UrlTrie:
    """rules: (verdict, host, path), verdict 'allow' or 'block'."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"at most {MAX_RULES} rules can be broadcast")
        # a node: children by label, then (path root or None); a path node:
        # children by whole segment, and (last partial segment, verdict, rule) ends
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in reversed(host.translate(_UPPER).split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(None, {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(None, {})
            if verdict == "block" or last not in ends:
                ends[last] = (verdict, host + path)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the winning rule, or None."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                found = self._longest(node[None], path) or found
        return found

    @staticmethod
    def _longest(node: dict, path: str) -> tuple[str, str] | None:
        best = None
        for segment in path.split("/"):
            ends = node.get(None, {})
            if len(ends) <= len(segment):
                fits = [e for e in ends if segment.startswith(e)]
            else:
                fits = [segment[:n] for n in range(len(segment) + 1) if segment[:n] in ends]
            if fits:
                best = ends[max(fits, key=len)]
            node = node.get(segment)
            if node is None:
                return best
        return best


def _judge(trie, url_col: str, default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = trie.value
        for batch in batches:
            split = [split_url(u) for u in batch.column(url_col).to_pylist()]
            found = [rules.match(h, p) or (default, None) for h, p in split]
            out = batch
            for name, values in (("host", [h for h, _ in split]), ("path", [p for _, p in split]),
                                 ("rule", [r for _, r in found]), ("verdict", [v for v, _ in found])):
                out = out.append_column(name, pa.array(values, pa.string()))
            yield out
    return run


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url",
               default: str = "allow") -> DataFrame:
    """Verdict of every URL.

    Returns all columns of ``pages`` (replacing columns of these names) plus
    host, path, rule (host and path of the winning rule, else null) and
    verdict ('allow' or 'block'; ``default`` if no rule fits). A null URL, one
    without :// or with an empty host fits no rule. Every row is judged on its
    own: repeated rows get equal verdicts, an empty table gives an empty one, a URL of
    any length is split in one pass.
    The rules are broadcast; there may be MAX_RULES of them.
    """
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    src = pages.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType(list(src.schema.fields))
    for name in ("host", "path", "rule", "verdict"):
        schema = schema.add(name, "string")
    return src.mapInArrow(_judge(trie, url_col, default), schema)
