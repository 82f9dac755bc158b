"""Token ids of whole texts by a byte-level tokenizer, from a bounded cache of runs between spaces."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np

from spanforge.llm.shared import STEP_BYTES
from spanforge.llm.tokens import BYTES

#: Entries of a worker's cache of runs; beyond it the older half goes. It bounds memory and changes no result.
CACHE_RUNS = 1_200_000

#: Runs that are encoded each on their own: what is no white space with one space before it, and white space up to
#: the last of its characters.
RUN = re.compile(rb" ?\S+|\s+(?!\S)|\s")

#: White space that RUN doesn't know. Texts that hold any go to the library as a whole.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE = re.compile(rb"(?<=\S) (?=\S)")
ODD = re.compile(rb"[\x1c-\x1f]")

#: Texts of ASCII and letters of Latin-1, and their pre-tokens by the usual pattern of byte-level vocabularies.
PLAIN_TEXT = re.compile(rb"(?:[\t-\r -~]+|(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)*")
PIECE = re.compile(rb"'(?:[stmd]|re|ve|ll)| ?(?:[A-Za-z]+|\xc3[\x80-\xbf])+| ?[0-9]+| ?[^A-Za-z0-9\s\x80-\xff]+|\s+(?!\S)|\s")


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def special(path: str) -> tuple[bytes, ...] | None:
    """The special strings, if the tokenizer is one whose ids are those of its runs one after another, else None.

    So it is if nothing is normalised and the pre-tokenizer is the usual one of byte-level vocabularies without a
    space put first: there a run of white space always starts a pre-token, its last character starts another if
    something follows, and a space joins only what comes after it. So pre-tokens never reach across runs. Special
    strings break texts elsewhere; texts that hold one go to the library.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or spec.get("post_processor") or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True):
        return None
    return tuple(x["content"].encode() for x in spec["added_tokens"])


def parts(text: bytes, size: int = STEP_BYTES) -> Iterator[bytes]:
    """A long text in parts of about this size, each from a single space on, where a pre-token always starts."""
    at = 0
    while len(text) - at > size and (found := SPACE.search(text, at + size)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Kept(dict):
    """The ids of each run, as bytes, worked out as it is asked for. Two generations bound it: what is used stays."""

    def __init__(self, work: Callable[[bytes], bytes]) -> None:
        self.work, self.old = work, {}

    def __missing__(self, run: bytes) -> bytes:
        got = self.old.get(run)
        if got is None:
            got = self.work(run)
        if len(run) > 64:  # long runs hardly come again
            return got
        if len(self) >= CACHE_RUNS // 2:
            self.old = dict(self)
            self.clear()
        self[run] = got
        return got


@functools.cache
def encoder(path: str) -> tuple[Callable[[bytes], bytes], str]:
    """A function from a text in UTF-8 to its ids, little-endian, and their width; one for the life of a worker."""
    t = tokenizer(path)
    width = "<u2" if t.get_vocab_size() <= 1 << 16 else "<u4"
    strings, merge = special(path), t.model.tokenize
    number = [i.to_bytes(np.dtype(width).itemsize, "little") for i in range(t.get_vocab_size())]

    def whole(text: bytes) -> bytes:
        return np.array(t.encode(text.decode(), add_special_tokens=False).ids, width).tobytes()

    def merged(piece: bytes) -> bytes:  # a pre-token, in the characters that stand for its bytes
        return b"".join([number[x.id] for x in merge(piece.decode("latin-1").translate(BYTES))])

    piece, run = Kept(merged).__getitem__, Kept(whole).__getitem__

    def encode(text: bytes) -> bytes:
        if strings is None or any(s in text for s in strings) or (ODD.search(text) if text.isascii() else OTHER_SPACE.search(text.decode())):
            return whole(text)
        get, pattern = (piece, PIECE) if PLAIN_TEXT.fullmatch(text) else (run, RUN)
        return b"".join([b"".join(map(get, pattern.findall(part))) for part in parts(text)])

    return encode, width


def forget() -> None:
    """Free what this worker keeps."""
    encoder.cache_clear()
    tokenizer.cache_clear()
