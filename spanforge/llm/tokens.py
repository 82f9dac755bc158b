"""Token counts and token ids of whole texts, by a whole-token shortcut and word caches."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanforge.llm.shared import steps

#: Entries of a worker's cache of words; beyond it the cache starts afresh. It bounds memory and changes no result.
CACHE_WORDS = 400_000

#: The pre-tokenizer under which no pre-token holds white space, so that texts may be cut there.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOCAL_NORMALIZERS = ("NFC", "Replace", "Lowercase")


@functools.cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def cut_at_spaces(path: str) -> bool:
    """Whether a text's ids are those of its words `[^\\x20\\x09-\\x0D]+` one after another.

    So it is if normalisation works within words (NFC never composes across white space, lower-casing is by
    character, runs of white space become one space) and pre-tokens never hold white space. Special strings
    hold none either and don't strip what stands beside them.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        all(x["type"] in LOCAL_NORMALIZERS and (x["type"] != "Replace" or (x["pattern"], x["content"]) == ({"Regex": r"\s+"}, " ")) for x in normal)
        and len(pre) == 2
        and pre[0].get("pattern") == {"Regex": WORD_PATTERN}
        and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
        and (pre[1]["type"], pre[1]["add_prefix_space"], pre[1]["use_regex"]) == ("ByteLevel", False, False)
        and spec.get("post_processor") is None
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or any(map(str.isspace, x["content"])) for x in spec["added_tokens"])
    )


@functools.cache
def whole_tokens(path: str) -> frozenset[str]:
    """The vocabulary strings, in the byte alphabet and without the word end, proved to encode alone as one token.

    Each is proved by running the library's model on it, which must give just its id. The model encodes a
    pre-token without regard to what surrounds it, so the proof holds wherever the string is a whole pre-token;
    only pre-tokens are looked up here.
    """
    t = tokenizer(path)
    with open(path, encoding="utf-8") as file:
        suffix = json.load(file)["model"].get("end_of_word_suffix") or ""
    proved = []
    for piece, number in t.get_vocab(with_added_tokens=False).items():
        if piece.endswith(suffix) and len(piece) > len(suffix):
            bare = piece[: len(piece) - len(suffix)]
            made = t.model.tokenize(bare)
            if len(made) == 1 and made[0].id == number:
                proved.append(bare)
    return frozenset(proved)


#: The pre-tokens of a word of ASCII, without the apostrophe, and letters of Latin-1: runs of letters, single digits,
#: runs of marks. Each is encoded on its own.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+|[0-9]|[!-&(-/:-@\[-`{-~]+")
ALL_PLAIN = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = {chr(b): c for b, c in byte_alphabet().items()}


def lowered(text: bytes) -> bytes:
    """ASCII letters in lower case, so that fewer words differ, where the tokenizer's own lower-casing makes the same.

    Not so beside combining marks (some compose with small letters only; those with ASCII letters begin with these
    bytes in UTF-8), nor in special strings.
    """
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


class WordCache(dict):
    """What each word gives, worked out as it is asked for. Two generations bound it: what is used stays."""

    def __init__(self, path: str) -> None:
        self.tokenizer, self.whole = tokenizer(path), whole_tokens(path)
        self.merge, self.old = self.tokenizer.model.tokenize, {}

    def __missing__(self, word: bytes):
        got = self.old.get(word)
        if got is None:
            if word.isalpha():  # bytes.isalpha: ASCII letters only, which stand for themselves
                got = self.piece(word.lower().decode())
            elif ALL_PLAIN.fullmatch(word) and b"<|" not in word:  # those may hold a special string
                parts = PLAIN.findall(word)
                if len(parts) == 1:
                    got = self.piece(word.decode().lower().encode().decode("latin-1").translate(BYTES))
                else:
                    got = self[parts[0]]
                    for part in parts[1:]:
                        got += self[part]
            else:
                got = self.odd(word)
        if len(self) >= CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def piece(self, text: str):
        """Of one pre-token in the byte alphabet."""
        raise NotImplementedError

    def odd(self, word: bytes):
        """Of any word, by the library's own normaliser and pre-tokenizer."""
        raise NotImplementedError


BYTES = str.maketrans(ALPHABET)


class Counts(WordCache):
    def piece(self, text: str) -> int:
        return 1 if text in self.whole else len(self.merge(text))

    def odd(self, word: bytes) -> int:
        if b"<|" in word:  # may hold a special string
            return len(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        return sum(self.piece(x) for x, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(word.decode())))


class Ids(WordCache):
    """Token ids, little-endian, of the given width."""

    def __init__(self, path: str, width: str) -> None:
        super().__init__(path)
        size = np.dtype(width).itemsize
        self.bytes = [i.to_bytes(size, "little") for i in range(self.tokenizer.get_vocab_size())]

    def piece(self, text: str) -> bytes:
        return b"".join([self.bytes[t.id] for t in self.merge(text)])

    def odd(self, word: bytes) -> bytes:
        return b"".join([self.bytes[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])


def counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """Token counts of texts in UTF-8: by words where that is proved to be the same, else by the library alone."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)]
    if not cut_at_spaces(path):
        t = tokenizer(path)
        return lambda texts: [len(x.ids) for x in t.encode_batch_fast([t_.decode() for t_ in texts], add_special_tokens=False)]
    get = Counts(path).__getitem__
    return lambda texts: [sum(map(get, lowered(t).split())) for t in texts]  # bytes.split: at ASCII white space


@functools.cache
def kept_counter(path: str) -> Callable[[list[bytes]], list[int]]:
    """One for the life of a Python worker, so that later tasks find its cache filled."""
    return counter(path)


@functools.cache
def kept_ids(path: str, width: str) -> Ids:
    return Ids(path, width)


def forget() -> None:
    """Free what this worker keeps for tokenizing; later tasks that need it make it again."""
    for kept in (kept_counter, kept_ids, whole_tokens, tokenizer):
        kept.cache_clear()


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every whole text.

    Null texts count as empty: 0 bytes, 0 tokens. Special strings in texts count as the library's default has
    it. Null ids and repeated rows stay, a row for each; other columns are not read; an empty table gives no rows.
    Very long texts are counted whole. No shuffle; memory is a batch and a bounded cache of words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = kept_counter(tokenizer_path)
        for batch in steps(batches, 1):
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n = of(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
