import random
import time
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltworks.llm import packing
from tests.llm.helpers import documents, words

PATH = public_tokenizers.path("word_bpe_49k.json")
THEIRS = Tokenizer.from_file(PATH)
OWN = packing.Words(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text("aAéÉß²½'’s t<|>endoftext\x85\xa0\x1cİΣςσ日1９-_% ", max_size=80))
def test_word_by_word_is_the_whole_text(text):
    text = text.encode("utf-8", "replace").decode()
    assert OWN.encode([text])[0] == np.array(THEIRS.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_tokens_in_a_text():
    for text in ("x<|endoftext|>y <|startoftext|>", "<|endof text|>"):
        assert OWN.encode([text])[0] == np.array(THEIRS.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def fewest(lengths, size):
    """The least number of sequences, by trying all ways."""
    best = len(lengths)

    def put(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(lengths):
            best = len(room)
            return
        for k in range(len(room)):
            if room[k] >= lengths[i] and room[k] not in room[:k]:
                put(i + 1, [*room[:k], room[k] - lengths[i], *room[k + 1 :]])
        put(i + 1, [*room, size - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best


def test_few_pieces_are_packed_as_well_as_can_be():
    rng, misses = random.Random(4), 0
    for _ in range(150):
        lengths = [rng.randint(5, 60) for _ in range(rng.randint(0, 10))]
        bins = packing.complete(lengths, 100)
        assert sorted(x for b in bins for x in b) == sorted(lengths)
        assert all(sum(b) <= 100 for b in bins)
        best = fewest(lengths, 100)
        assert packing.least_bins(lengths, 100) <= best if lengths else True
        misses += len(bins) > best
    assert not misses


def planted(bins, pieces, seed):
    """Pieces that fill ``bins`` sequences of 100 without waste."""
    rng, lengths = random.Random(seed), []
    for _ in range(bins):
        at = [0, *sorted(rng.sample(range(1, 100), pieces - 1)), 100]
        lengths += [b - a for a, b in zip(at, at[1:])]
    return lengths


def test_full_sequences_of_many_pieces_are_found():
    for bins, pieces in ((2, 6), (3, 5), (3, 6), (4, 5), (12, 4), (12, 5), (12, 6), (12, 8)):
        for seed in range(40):
            lengths = planted(bins, pieces, seed)
            found = packing.complete(lengths, 100)
            assert len(found) == bins and sorted(x for b in found for x in b) == sorted(lengths)


def test_the_search_ends_where_it_is_told_to():
    rng = random.Random(1)
    lengths = [rng.randint(1200, 2100) for _ in range(300)]
    first = packing.best_fit(sorted(lengths, reverse=True), 4096)
    for work in (0, 1, 500, 50_000):
        found = packing.complete(lengths, 4096, work)
        assert len(found) <= len(first) and sorted(x for b in found for x in b) == sorted(lengths)


def test_fillings_are_maximal_and_undominated():
    found = list(packing.fillings([2, 3, 5, 6], {2: 2, 3: 1, 5: 1, 6: 1}, 8, 8, packing.Work(1000)))
    assert found[0] == (6, 2) and (5, 3) in found and (5, 2) not in found and (2, 2, 3) not in found


def test_a_filling_by_one_piece_is_the_last():
    kinds = [*range(1, 101), 200]
    assert list(packing.fillings(kinds, dict.fromkeys(kinds, 1), 200, 200, packing.Work(200))) == [(200,)]


def hard():
    """Groups whose best-fit packing doesn't meet the bound, of mixed and of log-normal lengths."""
    rng = random.Random(7)
    yield [rng.randint(1366, 1500) for _ in range(30)] + [rng.randint(1, 120) for _ in range(80)]
    yield [min(4096, max(1, int(rng.lognormvariate(6.5, 1.0)))) for _ in range(8000)]
    yield [rng.randint(700, 1500) for _ in range(3000)]
    yield [3 * rng.randint(1, 1300) for _ in range(9000)]
    yield [rng.randint(1200, 2100) for _ in range(8000)]


def test_the_search_ends_in_seconds():
    for lengths in hard():
        first, began = packing.best_fit(sorted(lengths, reverse=True), 4096), time.process_time()
        found = packing.complete(lengths, 4096)
        assert time.process_time() - began < 30
        assert len(found) <= len(first) and sorted(x for b in found for x in b) == sorted(lengths) and max(map(sum, found)) <= 4096


def test_bin_completion_beats_best_fit():
    better = 0
    for seed in range(30):
        rng = random.Random(seed)
        lengths = [rng.randint(20, 70) for _ in range(60)]
        first, found = packing.best_fit(sorted(lengths, reverse=True), 100), packing.complete(lengths, 100)
        assert len(found) <= len(first)
        better += len(found) < len(first)
    assert better


def test_pieces_and_places(spark):
    texts = [None, "", "Hello, World!", words(2, 9000), "Hello, World!", *(words(i, 40 * i) for i in range(30))]
    docs = documents(spark, texts, ids=[0, 1, 2, 3, None, *range(10, 40)])
    rows = packing.pack_documents(docs, PATH, with_ids=True).collect()
    assert len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    by = {}
    for r in sorted(rows, key=lambda r: r.piece):
        by.setdefault(r.doc_id, []).append(r)
    for doc, text in zip([0, 1, 2, 3, None, *range(10, 40)], texts):
        ids = [*THEIRS.encode(text or "", add_special_tokens=False).ids, 1]
        assert b"".join(bytes(r.ids) for r in by[doc]) == np.array(ids, "<u4").tobytes()
        assert [r.length for r in by[doc][:-1]] == [4096] * (len(by[doc]) - 1)
        assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.start == 4096 * r.piece for r in by[doc])
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 4096
    assert len(sequences) == packing.least_bins([r.length for r in rows], 4096)


def test_empty_table(spark):
    assert packing.pack_documents(documents(spark, ["x"]).where("false"), PATH).count() == 0
