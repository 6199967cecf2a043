"""Byte-level BPE encoding and decoding by monoid tree reduction.

Encoded spans are a monoid: the two halves of a span are encoded on their own,
and neighbours are joined by encoding anew a window around their boundary. The
window grows until the tokens outside are proven to stay: a sequence of tokens
is the encoding of its bytes if and only if each pair of adjacent tokens is the
encoding of that pair's bytes, so once the pairs at both rims of the window hold,
nothing further out can change. Decoding concatenates up the same tree.

Every match of the splitting pattern is a span of its own; between matches the
join is plain concatenation.

Edge cases: a null or empty text has no ids; lone surrogates can't occur in
Spark strings; texts of any length are handled whole (long matches by the tree);
repeated rows are encoded each; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import read

#: Spans of up to so many bytes are encoded at once, longer ones by halves.
LEAF = 4
#: Entries that each of a worker's lookup tables may hold; they begin anew beyond.
KEPT = 600_000


#: Letters, numbers and white space up to U+024F, for texts that go no further.
NEAR = {r"\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ɏ", r"\p{N}": "0-9²³¹¼-¾", r"\s": r"\t-\r \x85\xa0"}


def splitter(pattern: str):
    """What splits a text into the matches of ``pattern``.

    The classes are spelled out for texts up to U+024F, where a plainer engine
    finds the same matches in half the time.
    """
    near = pattern.replace(r"\S", r"[^\s]")
    near = re.sub(r"\[[^]]*\]|\\(?:p\{[LN]\}|s)", lambda m: m[0] if m[0][0] == "[" else f"[{m[0]}]", near)
    for name, members in NEAR.items():
        near = near.replace(name, members)
    far, plain, quick = regex.compile(pattern).findall, re.compile(near).findall, re.compile("[^\0-ɏ]").search
    return lambda text: far(text) if quick(text) else plain(text)


class TreeEncoder:
    """Encodes with ``ranks`` (token bytes to id, merged in the order of ids)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.split = splitter(pattern)
        self.spans: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, span: bytes) -> tuple[int, ...]:
        """Plain BPE: again and again the leftmost pair of the lowest rank."""
        ranks = self.ranks
        if (whole := ranks.get(span)) is not None:
            return (whole,)
        if len(span) > 64:
            return self._merge_long(span)
        none = len(ranks)
        cuts = list(range(len(span) + 1))
        pairs = [ranks.get(span[i : i + 2], none) for i in range(len(span) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del cuts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(span[cuts[i] : cuts[i + 2]], none)
            if i:
                pairs[i - 1] = ranks.get(span[cuts[i - 1] : cuts[i + 1]], none)
        return tuple([ranks[span[x:y]] for x, y in zip(cuts, cuts[1:])])

    def _merge_long(self, span: bytes) -> tuple[int, ...]:
        """The same with a heap, for windows that grew long."""
        n, ranks = len(span), self.ranks
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(span[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            mid = ends[i]
            if mid < 0 or mid >= n or ends[mid] != end:
                continue
            ends[i], ends[mid] = end, -1
            if end < n:
                before[end] = i
                if (r := ranks.get(span[i : ends[end]])) is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if (p := before[i]) >= 0 and (r := ranks.get(span[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[span[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def holds(self, a: int, b: int) -> bool:
        """Whether tokens ``a`` and ``b`` stay apart when their bytes are encoded together."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) > KEPT:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == (a, b)
        return got

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the bytes of both, encoding anew no more than a window at the boundary."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(self.tokens[t] for t in left[-i:] + right[:j]))
            before = i == len(left) or self.holds(left[-i - 1], window[0])
            after = j == len(right) or self.holds(window[-1], right[j])
            if before and after:
                return left[:-i] + window + right[j:]
            i, j = (i if before else 2 * i), (j if after else 2 * j)

    def encode(self, span: bytes) -> tuple[int, ...]:
        """The ids of one match of the pattern."""
        got = self.spans.get(span)
        if got is not None:
            return got
        whole = self.ranks.get(span)
        if whole is not None:
            got = (whole,)
        elif len(span) <= LEAF:
            got = self.merge(span)
        else:
            half = len(span) // 2
            got = self.join(self.encode(span[:half]), self.encode(span[half:]))
        if len(span) <= 16:
            if len(self.spans) > KEPT:
                self.spans.clear()
            self.spans[span] = got
        return got

    def encode_text(self, text: str) -> list[int]:
        """The ids of a text: those of its matches, one after the other."""
        out: list[int] = []
        words, add = self.words, out.extend
        for word in self.split(text):
            got = words.get(word)
            if got is None:
                got = self.encode(word.encode("utf-8", "surrogatepass"))
                if len(word) <= 64:
                    if len(words) > KEPT:
                        words.clear()
                    words[word] = got
            add(got)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ``ids``: those of its two halves, joined; many leaves are joined at once."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids of a vocabulary file: base64 and rank, one token a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@cache
def encoder(path: str, pattern: str) -> TreeEncoder:
    """One encoder for each Python worker."""
    return TreeEncoder(load_ranks(path), pattern)


def encode_column(path: str, pattern: str):
    """A Pandas UDF from text to array<int> of ids."""

    @F.pandas_udf("array<int>")
    def ids(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for texts in parts:
            yield pd.Series([enc.encode_text(t or "") for t in texts], dtype=object)

    return ids


def decode_column(path: str, pattern: str):
    """A Pandas UDF from array<int> of ids to the bytes that they stand for."""

    @F.pandas_udf("binary")
    def raw(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for rows in parts:
            yield pd.Series([enc.decode([] if r is None else list(r)) for r in rows], dtype=object)

    return raw


def digest_column(path: str, pattern: str):
    """A Pandas UDF from text to the count and digest of its ids and the digest of the decoded bytes.

    It encodes and decodes in one pass, so the ids never leave the worker.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        names = {i: str(i) for i in enc.tokens}
        for texts in parts:
            rows = []
            for text in texts:
                ids = enc.encode_text(text or "")
                told = " ".join(map(names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(told).hexdigest(), hashlib.sha256(enc.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The digests of the ids of every text and of what they decode to."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    digest = digest_column(path, public_tokenizers.PATTERN)
    return read(spark, sf_dir, "documents").select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")
