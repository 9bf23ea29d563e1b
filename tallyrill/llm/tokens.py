"""Tokenising with cached pieces of text that are certain to be independent.

``ForcedBoundaries`` (byte-level BPE): byte pairs that occur inside no vocabulary token mark certain cuts, because no merge
can span them. The fragments between cuts are encoded one by one, each distinct one once, and concatenated. A cut must
also leave the regular pre-tokenisation as it is, so there is none after white space (whose runs look ahead), inside a
character, or before an apostrophe (contractions).

``SpacedWords`` (word-end BPE that drops white space): ASCII white space is a certain cut.

Ids are held as bytes of little-endian unsigned 32-bit integers. Caches are bounded; a full one starts anew.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from ._shared import utf8

CACHE_ENTRIES = 600_000
#: Bytes of text whose results are held at a time, about.
BLOCK_BYTES = 4_000_000

#: Letters whose case, composition and class are the same in every Unicode library: no part of a safe text is in doubt.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017e"
_SAFE = re.compile(f"[\n -~{_LATIN}]*", re.ASCII)


def byte_alphabet() -> dict[str, int]:
    """The byte that each character stands for in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Cache(dict):
    """Fills itself: an unknown fragment is encoded when it is asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: bytes) -> bytes:
        ids = self[fragment] = self.encode(fragment)
        return ids


class CachedEncoder:
    """Encodes texts as the tokenizer of ``path`` does, with special tokens recognised in texts but none added."""

    #: Pre-tokens of a safe text.
    PRETOKENS: re.Pattern

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        self.merges = self.tokenizer.model.tokenize
        self.packed = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)]
        self.cache = _Cache(self._fragment)

    def fragments(self, raw: bytes) -> list[bytes]:
        raise NotImplementedError

    def normal(self, text: str) -> str:
        """What the normalizer makes of a safe text."""
        return text

    def _fragment(self, raw: bytes) -> bytes:
        """A safe fragment goes straight to the vocabulary's merges, any other through the whole tokenizer."""
        text = raw.decode("utf-8", "replace")
        if not _SAFE.fullmatch(text) or any(s in raw for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        merges, ids = self.merges, self.packed
        out = b""
        for word in self.PRETOKENS.findall(self.normal(text)):
            if not (word.isascii() and word.isalnum()):
                word = word.encode().decode("latin-1").translate(self.alphabet)
            for token in merges(word):
                out += ids[token.id]
        return out

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        get, out = self.cache.__getitem__, []
        for raw in raws:
            out.append(b"".join(map(get, self.fragments(raw))))
            if len(self.cache) > CACHE_ENTRIES:
                self.cache.clear()
        return out


class SpacedWords(CachedEncoder):
    PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9]|[^\\s{_LATIN}0-9]+", re.ASCII)

    def fragments(self, raw: bytes) -> list[bytes]:
        return raw.split()

    def normal(self, text: str) -> str:
        return text.lower()


class ForcedBoundaries(CachedEncoder):
    PRETOKENS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\\s{_LATIN}0-9]+|\\s+(?!\\S)|\\s+", re.ASCII)
    #: Last bytes of characters that are, or may count as, white space.
    SPACE_ENDS = (*range(0x09, 0x0E), *range(0x1C, 0x21), *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)

    def __init__(self, path: str):
        super().__init__(path)
        alphabet = byte_alphabet()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocabulary.values()) + 1)
        inside = np.zeros((256, 256), bool)
        for token, k in vocabulary.items():
            own = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
            self.bytes_of[k] = own
            pairs = np.frombuffer(own, np.uint8)
            inside[pairs[:-1], pairs[1:]] = True
        cut = ~inside
        cut[list(self.SPACE_ENDS), :] = False
        cut[:, 0x80:0xC0] = False
        cut[:, ord("'")] = False
        self.cut = cut.reshape(-1)

    def fragments(self, raw: bytes) -> list[bytes]:
        if len(raw) < 2 or any(s in raw for s in self.special):
            return [raw] if raw else []
        b = np.frombuffer(raw, np.uint8)
        at = np.flatnonzero(self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]) + 1
        ends = at.tolist()
        ends.append(len(raw))
        return [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[tuple[type, str], CachedEncoder] = {}


def encoder(kind: type, path: str) -> CachedEncoder:
    """One encoder for each Python worker; it and its cache live on between tasks."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def slices(raws: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts that hold about ``most`` bytes, or one text."""
    at = 0
    while at < len(raws):
        size, end = len(raws[at]), at + 1
        while end < len(raws) and size + len(raws[end]) <= most:
            size += len(raws[end])
            end += 1
        yield at, end
        at = end


def _round_trip(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(ForcedBoundaries, path)
    for b in batches:
        raws = b.column("raw").to_pylist()
        for i, j in slices(raws):
            ids = coder.encode(raws[i:j])
            decoded = [hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(ForcedBoundaries, path)
    for b in batches:
        raws = b.column("raw").to_pylist()
        for i, j in slices(raws):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in coder.encode(raws[i:j])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    coder = encoder(ForcedBoundaries, path)
    for b in batches:
        texts = [None if x is None else coder.decode(np.array(x, "<u4").tobytes()) for x in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def _key(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array<int>) for each row of ``docs`` (doc_id, text); a null text has no ids. Rows stay where they are: no shuffle."""
    return docs.select("doc_id", utf8("text").alias("raw")).mapInArrow(partial(_encode, path=path), f"doc_id {_key(docs)}, ids array<int>")


def decode(ids: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of ``ids`` (doc_id, ids); null ids give a null text."""
    return ids.select("doc_id", "ids").mapInArrow(partial(_decode, path=path), f"doc_id {_key(ids)}, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """What ``encode`` and then ``decode`` give, as digests, in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return docs.select("doc_id", utf8("text").alias("raw")).mapInArrow(partial(_round_trip, path=path), f"doc_id {_key(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
