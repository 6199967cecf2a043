import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm import bpe
from tests.llm.helpers import documents, words

RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
OWN = bpe.TreeEncoder(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text("ab the\n'sé日0 ", max_size=200))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    ids = OWN.encode_text(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000, "aab" * 2001, "thetion" * 3000, " " * 4000 + "x", "é" * 3000, words(3, 20000)])
def test_long_texts(text):
    assert OWN.encode_text(text) == THEIRS.encode_ordinary(text)


def test_join_is_associative():
    a, b, c = (OWN.encode(x) for x in (b"interna", b"tional", b"isation"))
    assert OWN.join(OWN.join(a, b), c) == OWN.join(a, OWN.join(b, c)) == OWN.encode(b"internationalisation")


def test_columns(spark):
    texts = [None, "", "hello world", words(1, 50), "hello world"]
    docs = documents(spark, texts)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select("doc_id", bpe.encode_column(path, public_tokenizers.PATTERN)("text").alias("ids"))
    rows = rows.withColumn("raw", bpe.decode_column(path, public_tokenizers.PATTERN)("ids"))
    got = {r.doc_id: (r.ids, bytes(r.raw)) for r in rows.collect()}
    assert got == {i: (THEIRS.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
    digest = docs.select("doc_id", bpe.digest_column(path, public_tokenizers.PATTERN)("text").alias("d")).select("doc_id", "d.*").collect()
    assert all(r.ids_sha256 == hashlib.sha256(" ".join(map(str, got[r.doc_id][0])).encode()).hexdigest() for r in digest)
