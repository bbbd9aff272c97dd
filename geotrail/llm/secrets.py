"""Secrets in texts: assigned values, access keys, hex keys and random strings.

Method: a token-efficiency test. A byte-pair vocabulary spells natural strings in
few tokens and random ones in many, so a long unbroken string with few characters
per token is random. Known digests (by length or algorithm name) and identifiers
(UUIDs, numbers, words joined by separators or capitals) are excluded before the
test. Three plain patterns give the base spans, which always stay; a random string
is added where no base span lies.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "random")       # the order of spans that start together

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "apikey", "api_key")     # one is in every text that ASSIGN finds
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")      # maximal runs: the same as runs of any length, short ones dropped

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})|"
                    r"(?:sha(?:1|224|256|384|512)|md5)[-_].*", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
NUMBER = re.compile(r"[0-9+/_=-]+")
# parts between separators: words, then at most four digits, or a number
# (possessive, so that a long string is matched in linear time)
PART = r"(?:(?:[A-Z]?[a-z]{3,}+|[A-Z]{3,}+)++[0-9]{0,4}+|[0-9]++)"
WORDS = re.compile(rf"[+/_=-]*+{PART}(?:[+/_=-]++{PART})*+[+/_=-]*+")
MAX_RATIO = 1.75
MIN_KINDS = 8       # different characters; 20 random ones have more
SLICE = 4096        # longer strings are cut for counting, as merging grows faster than the string

Span = tuple[int, int, int]     # start, kind's place in KINDS, end

SPANS_TYPE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                       T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str) -> list[Span]:
    """Matches of the plain patterns, by start and kind."""
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def known(string: str) -> bool:
    """A digest or an identifier by its shape, or a pattern of few characters."""
    s = string.rstrip("=")
    return len(set(s)) < MIN_KINDS or any(p.fullmatch(s) for p in (DIGEST, UUID, NUMBER, WORDS))


def random_spans(text: str, tokens: Callable[[str], int], max_ratio: float, base: list[Span]) -> list[Span]:
    """Strings of few characters per token that touch no base span and no further letter."""
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()) or known(m[0]):
            continue        # an end that goes on in another alphabet is part of a word
        if any(s < end and start < e for s, _, e in base):
            continue
        if end - start < max_ratio * tokens(m[0]):
            out.append((start, 3, end))
    return out


def token_counter(path: str) -> Callable[[str], int]:
    """Tokens of a string under the vocabulary of ``path`` (lines of base64 token and rank)."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: sum(len(encoding.encode_ordinary(s[i:i + SLICE])) for i in range(0, len(s), SLICE))


def _scan(path: str, max_ratio: float, text_at: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None

        def tokens(s: str) -> int:
            nonlocal counter
            counter = counter or token_counter(path)        # once per task, where a candidate comes
            return counter(s)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                base, found = [], []
                for text in part.column(text_at).to_pylist():
                    mine = base_spans(text or "")
                    base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in mine])
                    found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(
                        mine + random_spans(text or "", tokens, max_ratio, mine))])
                yield (part.drop_columns([part.schema.names[text_at]])
                       .append_column("base_spans", pa.array(base, ARROW_SPANS))
                       .append_column("spans", pa.array(found, ARROW_SPANS)))
    return scan


def find_secrets(docs: DataFrame, tokenizer: str, text_col: str = "text", columns: list[str] | None = None,
                 max_ratio: float = MAX_RATIO) -> DataFrame:
    """``columns`` of docs (default: all) with ``base_spans`` and ``spans`` of the whole text.

    Both are arrays of (kind, start, end) in code points, end exclusive, ordered by start,
    then by kind as listed in KINDS. A span is the whole match, with the keyword of an
    assignment. ``base_spans`` holds the matches of

    * assign: keyword, optional quote, : or =, optional quote, value of 12 characters and more,
    * access: AKIA and capitals or digits, 18 characters and more,
    * hex: 16 and more of 0-9a-f,

    leftmost and non-overlapping per kind; a match that is too short still consumes its
    characters. ``spans`` adds kind random: 20 and more of A-Za-z0-9+/_- (then up to two =)
    with under ``max_ratio`` characters per token of the vocabulary file ``tokenizer``, not
    overlapping a base span, not going on in letters of another alphabet, of at least
    eight different characters and not shaped like a digest or an identifier.

    Null and empty texts have no spans; repeated rows are rows of their own; columns of docs
    named base_spans or spans are replaced; an empty table gives an empty result. Each text is
    searched whole in one task, without a shuffle; ``tokenizer`` must be readable there."""
    keep = [c for c in (columns or docs.columns) if c not in ("base_spans", "spans")]
    x = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("_secret_text"))
    schema = x.drop("_secret_text").schema.add("base_spans", SPANS_TYPE).add("spans", SPANS_TYPE)
    return x.mapInArrow(_scan(tokenizer, max_ratio, len(keep)), schema)


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
