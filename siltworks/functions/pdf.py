"""What a PDF's objects tell without a PDF library: signatures and encryption.

Objects are read where they stand, and those in compressed object streams after
inflating them; what lies in other streams, or in strings, tells nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

#: Inflated bytes of one object stream at most; beyond, the file counts as one that can't be read.
MOST = 256 << 20
_STREAM = re.compile(rb"\bstream\r?\n")
_STRING = re.compile(rb"\((?:[^()\\]|\\.)*+\)", re.DOTALL)
_SIGNATURE = re.compile(rb"/Type\s*/Sig(?![A-Za-z0-9#])")
_FLAGS = re.compile(rb"/SigFlags\s+(\d+)(?:\s+(\d+)\s+R\b)?")


class UnreadablePdf(ValueError):
    pass


def _inflate(raw: bytes) -> bytes:
    packer = zlib.decompressobj()
    out = packer.decompress(raw, MOST)
    if packer.unconsumed_tail:
        raise UnreadablePdf("an object stream is too large")
    return out


def object_texts(raw: bytes) -> Iterator[bytes]:
    """The parts of a PDF that hold objects: what stands outside of streams, and object streams inflated."""
    at = 0
    while found := _STREAM.search(raw, at):
        head = raw[at : found.start()]
        yield head
        end = raw.find(b"endstream", found.end())
        if end < 0:
            return
        # the dictionary is what follows the last object's beginning
        own = head[head.rfind(b" obj") :]
        if re.search(rb"/Type\s*/ObjStm\b", own):
            body = raw[found.end() : end]
            if re.search(rb"/Filter\s*(?:\[\s*)?/FlateDecode\b", own):
                try:
                    body = _inflate(body)
                except zlib.error as error:
                    raise UnreadablePdf(f"an object stream can't be inflated: {error}") from None
            elif b"/Filter" in own:
                raise UnreadablePdf("an object stream with another filter")
            yield body
        at = end + len(b"endstream")
    yield raw[at:]


def is_encrypted(raw: bytes) -> bool:
    """Whether a trailer, or a stream of references, names an encryption dictionary."""
    return bool(re.search(rb"/Encrypt\s+\d+\s+\d+\s+R\b|/Encrypt\s*<<", raw))


def is_signed(raw: bytes) -> bool:
    """Whether the form's first signature flag is set, or any object is a signature.

    A file that can't be read, or whose objects are encrypted in object streams, raises :class:`UnreadablePdf`.
    """
    if b"%PDF-" not in raw[:1024]:
        raise UnreadablePdf("no PDF")
    texts = [_STRING.sub(b"()", t) for t in object_texts(raw)]
    for text in texts:
        if _SIGNATURE.search(text):
            return True
        for flags, generation in _FLAGS.findall(text):
            if generation:  # told by another object
                told = re.compile(rb"\b" + flags + rb"\s+" + generation + rb"\s+obj\s+(\d+)")
                values = [m[1] for t in texts if (m := told.search(t))]
                if not values or int(values[-1]) & 1:
                    return True
            elif int(flags) & 1:
                return True
    return False


def may_be_rewritten(raw: bytes | None) -> bool | None:
    """Whether a PDF may be written anew: not if it is signed, or can't be read to the end."""
    if raw is None:
        return None
    try:
        return not is_signed(raw)
    except UnreadablePdf:
        return False
