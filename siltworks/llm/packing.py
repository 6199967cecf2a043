"""Best-fit packing of tokenised documents by bin completion.

Documents are tokenised, ended by id 1, cut into pieces only where they are
longer than a sequence, and packed. Pieces are dealt evenly to groups of a
bounded size; a group starts from best-fit-decreasing as the incumbent and, where
that isn't provably the least, searches by bin completion: around the largest
piece left it enumerates undominated fillings of any number of pieces, takes
those of the least waste first, and gives a branch up once the waste so far makes
a better packing impossible. All that the search does counts against a stated
amount of work, so it ends; the incumbent is always a whole packing, and the
result tells each group's sequences and the least number that they might be.

Edge cases: a null or empty text is the one id 1; a text of any length is
tokenised whole; copies and repeated rows are packed each; rows with a null
doc_id are packed like others; an empty table gives no row; further columns are
ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm.common import blocks, read

SIZE = 4096
#: The id that ends a document.
END = 1
#: Documents for each packing group, on average.
GROUP = 16384
#: Work that a group's search may do (see :class:`Work`), a few seconds. Where it ends by that, its packing may exceed the least by what :func:`least_bins` leaves open.
WORK = 3_000_000
#: Depths whose enumeration is kept to go on with; one holds a sum of 512 bytes for each kind.
ALIVE = 64
#: Entries of a generation of a worker's tables; what two generations haven't met is forgotten.
KEPT = 300_000
#: Bytes of text that are encoded at once, beside the last document that they reach into.
BLOCK = 8 << 20
#: The tokenizer's own split of lower-case text, its classes spelled out for letters up to U+00FF; and line ends, which part words.
NEAR = "a-zªµºß-öø-ÿ"
NEAR_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{NEAR}]+|[0-9²³¹¼-¾]|\n|[^\s{NEAR}0-9²³¹¼-¾]+").findall
#: Words that it holds for: no letter beyond, no white space, no special token.
NEAR_WORD = "^[!-~¡-ÿ]+$"


class Recent:
    """A table that forgets what it wasn't asked for since long: two generations of :data:`KEPT` entries or so."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def missing(self, keys: list[str]) -> list[str]:
        """Those of ``keys`` that aren't known; the others are kept for another generation."""
        if len(self.now) > KEPT:
            self.before, self.now = self.now, {}
        new = [k for k in keys if k not in self.now]
        if self.before:
            self.now.update((k, self.before[k]) for k in new if k in self.before)
            new = [k for k in new if k not in self.now]
        return new


class Words:
    """Token ids of texts, one lookup for each distinct word of a block of texts.

    The tokenizer drops white space and no token crosses it, so a text's ids are
    those of its words at \x20 and \x09-\x0D, one after the other. A new word is
    split as the tokenizer splits it, so that its parts are looked up too.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        #: whether an id ends a part of a word
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ids, self.parts = Recent(), Recent()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers, without an end."""
        ids, n = self.encode_block(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n))[: len(texts)]]

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``texts``, one after the other, without ends; and how many each text has."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        self.learn(self.ids.missing(words))
        raw = list(map(self.ids.now.__getitem__, words))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        flat, starts = np.frombuffer(b"".join(raw), "<u4"), np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        each = sizes[at]
        upto = np.r_[0, np.cumsum(each)]
        ids = flat[np.repeat(starts[at] - upto[:-1], each) + np.arange(upto[-1])]
        of_text = np.r_[0, np.cumsum(pc.list_value_length(split).to_numpy())]
        return ids, np.diff(upto[of_text])

    def learn(self, new: list[str]) -> None:
        """Put the ids of the words ``new`` into the table."""
        column = pa.array(new, pa.large_string())
        near = pc.and_(pc.match_substring_regex(column, NEAR_WORD), pc.invert(pc.match_substring(column, "<|")))
        near, whole = column.filter(near).to_pylist(), column.filter(pc.invert(near)).to_pylist()
        if whole:
            got = self.tokenizer.encode_batch(whole, add_special_tokens=False)
            self.ids.now.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(whole, got))
        if not near:
            return
        parts = NEAR_SPLIT("\n".join(near).lower() + "\n")
        missing = self.parts.missing(list(set(parts) - {"\n"}))
        for at in range(0, len(missing), 256):
            some = missing[at : at + 256]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("the tokenizer splits words in another way")
            raw = ids.tobytes()
            self.parts.now.update((p, raw[4 * i : 4 * j]) for p, i, j in zip(some, [0, *stops.tolist()], stops.tolist()))
        self.parts.now["\n"] = b""
        raw = list(map(self.parts.now.__getitem__, parts))
        upto = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        stops = upto[[k for k, part in enumerate(parts) if part == "\n"]].tolist()
        joined = b"".join(raw)
        self.ids.now.update((w, joined[i:j]) for w, i, j in zip(near, [0, *stops], stops))


@cache
def words(path: str) -> Words:
    return Words(path)


def token_pieces(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document, and ids (binary) on request."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = words(path)
        for batch in batches:
            for i, j in blocks(batch.column("text"), BLOCK):
                part = batch.slice(i, j - i)
                ids, n = table.encode_block(part.column("text"))
                ids, n = np.insert(ids, np.cumsum(n), END), n + 1
                count = -(-n // size)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start, first = piece * size, np.cumsum(n) - n
                length = np.minimum(size, n[row] - start)
                begin = 4 * (first[row] + start)
                raw = memoryview(ids.astype("<u4", copy=False).tobytes())
                own = [raw[x:y] for x, y in zip(begin.tolist(), (begin + 4 * length).tolist())]
                out = {
                    "doc_id": part.column("doc_id").take(pa.array(row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array(map(zlib.crc32, own), pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array(map(bytes, own), pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(pieces, schema)


def least_bins(lengths: list[int], size: int) -> int:
    """A lower bound of the sequences that ``lengths`` need: pieces over half a sequence can't meet."""
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(size + 1))
    best = -(-int(total[size]) // size)
    half = size // 2
    for low in range(half + 1):
        large = n[size] - n[size - low]
        mid, mid_sum = n[size - low] - n[half], total[size - low] - total[half]
        small = total[half] - (total[low - 1] if low else 0)
        best = max(best, int(large + mid + max(0, -(-(small - (mid * size - mid_sum)) // size))))
    return best


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Best-fit-decreasing: ``lengths``, longest first, each to the fullest sequence that takes it; lists of lengths."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (room left, bin), in order
    for x in lengths:
        at = bisect.bisect_left(room, (x, -1))
        left, k = room.pop(at) if at < len(room) else (size, len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append(x)
        if left > x:
            bisect.insort(room, (left - x, k))
    return bins


def dominates(f: tuple[int, ...], g: tuple[int, ...]) -> bool:
    """Whether the pieces that only ``g`` has go into those that only ``f`` has, as far as first-fit-decreasing can tell."""
    room = sorted((Counter(f) - Counter(g)).elements())
    for x in sorted((Counter(g) - Counter(f)).elements(), reverse=True):
        at = next((k for k, r in enumerate(room) if r >= x), None)
        if at is None:
            return False
        room[at] -= x
    return True


class Spent(Exception):
    """A search's work is used up."""


class Work:
    """What a search may still do, about a third of a microsecond each: a sum that is made, or a part of a step or of a test of dominance."""

    def __init__(self, left: int):
        self.left = left

    def spend(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise Spent


def fillings(kinds: list[int], count: dict[int, int], room: int, waste: int, work: Work) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of ``room`` by pieces that are left, of any number, least waste first and never above ``waste``.

    ``kinds`` has the lengths in order. Sums that can be reached are bits of
    integers, so the search for a sum never enters a branch without one. A filling
    beside which another piece would fit is left out, and so is one whose pieces go
    into those of an earlier one. After a filling by one piece there is none: all
    others would go into that piece.
    """
    held = [k for k in kinds if k <= room and count[k]]
    reach, inside = [1], (1 << (room + 1)) - 1
    work.spend(len(kinds) // 4)
    for k in held:
        now = reach[-1]
        for _ in range(min(count[k], room // k)):
            work.spend()
            more = now | (now << k & inside)
            if more == now:
                break
            now = more
        reach.append(now)

    def exact(i: int, left: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if not left:
            yield chosen
            return
        while i and reach[i] >> left & 1:
            work.spend(3)
            i -= 1
            k = held[i]
            for n in range(min(count[k], left // k), 0, -1):
                if reach[i] >> (left - n * k) & 1:
                    yield from exact(i, left - n * k, chosen + (k,) * n)

    seen: list[tuple[int, ...]] = []
    for w in range(min(waste, room) + 1):
        for f in exact(len(held), room - w, ()):
            work.spend(4 + 20 * len(seen))
            if any(k <= w and count[k] > f.count(k) for k in held[: bisect.bisect_right(held, w)]) or any(dominates(s, f) for s in seen):
                continue
            seen.append(f)
            yield f
            if len(f) == 1:
                return


def complete(lengths: list[int], size: int, work: int = WORK) -> list[list[int]]:
    """A packing of ``lengths`` by bin completion, never worse than best-fit-decreasing; the least, unless ``work`` was used up."""
    lengths = sorted(lengths, reverse=True)
    best = best_fit(lengths, size)
    least = least_bins(lengths, size)
    if len(best) == least:
        return best
    count = Counter(lengths)
    kinds, total, left = sorted(count), sum(lengths), Work(work)
    bins: list[list[int]] = []
    #: by depth: how many fillings were tried, and the enumeration that stands there; only the last ALIVE of these are kept, others begin again
    tried, standing, packed, top = [0], [None], 0, len(kinds) - 1
    try:
        while tried:
            option = None
            if packed == total:
                best = [list(b) for b in bins]
                if len(best) == least:
                    return best
            else:
                # what may still be wasted if the packing is to be better than the incumbent
                waste = (len(best) - 1 - len(bins)) * size - (total - packed)
                while not count[kinds[top]]:
                    top -= 1
                first = kinds[top]
                if waste >= 0:
                    count[first] -= 1
                    if standing[-1] is None:
                        standing[-1] = islice(fillings(kinds, count, size - first, waste, left), tried[-1], None)
                    option = next(standing[-1], None)
                    count[first] += 1
                    # it was begun when more could be wasted
                    if option is not None and size - first - sum(option) > waste:
                        option = None
            if option is not None:
                tried[-1] += 1
                tried.append(0)
                standing.append(None)
                if len(standing) > ALIVE:
                    standing[-ALIVE - 1] = None
                bins.append([first, *option])
                count.subtract(bins[-1])
                packed += sum(bins[-1])
                continue
            tried.pop()
            standing.pop()
            if bins:
                gone = bins.pop()
                count.update(gone)
                packed, top = packed - sum(gone), len(kinds) - 1
    except Spent:
        pass
    return best


def pack(pieces: DataFrame, groups: int, size: int = SIZE) -> DataFrame:
    """``pieces`` with sequence_id and offset, and their group's group_sequences and group_least.

    They are dealt evenly to ``groups``, each packed in one task.
    """

    def group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts or not sum(map(len, parts)):
            return
        rows = pd.concat(parts, ignore_index=True)
        order = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True]).index.to_numpy()
        lengths = rows["length"].to_numpy()[order].tolist()
        waiting: dict[int, list[int]] = {}
        for at, x in zip(order, lengths):
            waiting.setdefault(x, []).append(at)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        base = TaskContext.get().partitionId() << 32
        found = complete(lengths, size)
        for k, held in enumerate(found):
            place = 0
            for x in held:
                at = waiting[x].pop()
                sequence[at], offset[at] = base + k, place
                place += x
        rows["sequence_id"], rows["offset"] = sequence, offset
        rows["group_sequences"], rows["group_least"] = len(found), least_bins(lengths, size)
        yield rows

    kinds = ", ".join(f"`{name}` {kind}" for name, kind in pieces.dtypes)
    return pieces.repartition(groups).mapInPandas(group, f"{kinds}, sequence_id long, offset long, group_sequences long, group_least long")


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """A row per piece: where it stands in which sequence."""
    groups = max(1, -(-docs.count() // GROUP))
    return pack(token_pieces(docs, path, size, with_ids), groups, size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents, packed into sequences of 4096 ids."""
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"), path or public_tokenizers.path("word_bpe_49k.json"))
