"""Token ids as the tokenizers library gives them, with work shared between equal words or chunks.

The encoders are kept for the life of a Python worker; their caches are emptied when they reach a fixed
number of entries. Vocabulary files are named by path and read where they lie.
"""

import json
import os
import re
import struct
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

END_ID = 2
CACHE_ENTRIES = 250_000
_PACKERS = [struct.Struct(f"<{n}I") for n in range(32)]


def default_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def library_tokenizer(path: str):
    """The tokenizers library's own tokenizer, truncation and padding off."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return _PACKERS[len(ids)].pack(*ids) if len(ids) < len(_PACKERS) else np.array(ids, "<u4").tobytes()


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabets write a byte as a printable character: itself, or the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(path: str, pattern: str, suffix: str = ""):
    """A byte-pair merger over the vocabulary of a tokenizers file. The word-end suffix is written as the byte
    0xFF, which no UTF-8 text holds; in these files ids follow the order of merges."""
    import tiktoken

    model, byte = json.load(open(path, encoding="utf-8")), _byte_of_char()
    special = {t["content"] for t in model["added_tokens"]}
    ranks = {}
    for token, i in model["model"]["vocab"].items():
        if token not in special:
            stem, end = (token[: -len(suffix)], b"\xff") if suffix and token.endswith(suffix) else (token, b"")
            ranks[bytes(byte[c] for c in stem) + end] = i
    return tiktoken.Encoding("driftspan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class WordEncoder(dict):
    """Packed ids of a white-space word by its bytes, for a lower-casing tokenizer that drops white space.

    Words of ASCII and Latin letters are split and merged here; any other word, and one that may hold a
    special token, goes to the library. No token of such a tokenizer crosses ASCII white space. A full
    table becomes the older of two generations, from which words that are still in use come back.
    """

    _ascii, _plain = re.compile(rb"[!-~]+"), re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    _ascii_pieces = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
    _pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        super().__init__()
        self.path = path
        self.older: dict[bytes, bytes] = {}
        self.merge = _merger(path, r"[^\n]+|\n+", "</w>")._core_bpe.encode_single_piece

    def _ids(self, word: bytes) -> bytes:
        if word.isalpha():  # of bytes: ASCII letters only
            return packed(self.merge(word.lower() + b"\xff"))
        if b"<|" not in word:
            if self._ascii.fullmatch(word):
                pieces = self._ascii_pieces.findall(word.lower())
                return b"".join(map(self.__getitem__, pieces)) if len(pieces) > 1 else packed(self.merge(pieces[0] + b"\xff"))
            text = word.decode("utf-8", "replace")
            if self._plain.fullmatch(text):
                return b"".join(packed(self.merge(piece.encode() + b"\xff")) for piece in self._pieces.findall(text.lower()))
        return packed(library_tokenizer(self.path).encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        out = self.older.get(word)
        if out is None:
            out = self._ids(word)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[word] = out
        return out

    def encode(self, text: bytes) -> bytes:
        """Packed ids of a text in UTF-8."""
        if b"<|" not in text:  # special tokens have a case
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split()))


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class _Chunk:
    """Texts that are encoded as one, with their first and last firm places."""

    def __init__(self, ids: bytes | None):
        self.ids, self.parts, self.size, self.firm = ids, [], 0, ()

    def add(self, text: str, first: int | None, last: int | None) -> "_Chunk":
        if first is not None:
            self.firm = (self.firm[0] if self.firm else self.size + first, self.size + last)
        self.parts.append(text)
        self.size += len(text)
        return self


class ChunkEncoder:
    """Packed ids for a byte-level tokenizer that keeps all bytes, of texts and of texts given in chunks.

    No token crosses the place between a visible character and the white space after it, whatever stands further off:
    such places are firm. A text's ids are those of its parts between firm places, one after another.
    """

    _plain = re.compile(r"[\n\t -~À-ÖØ-öø-ÿ]*")
    _first, _last = re.compile(r"\S(?=[ \t-\r])"), re.compile(r"(?s).*\S(?=[ \t-\r])")

    def __init__(self, path: str):
        import public_tokenizers

        self.path = path
        self.merger = _merger(path, public_tokenizers.PATTERN)
        self.special = {t["id"]: t["content"].encode() for t in json.load(open(path, encoding="utf-8"))["added_tokens"]}
        self.repairs = 0

    def ids(self, text: str) -> bytes:
        """Packed ids of a piece of text on its own."""
        if self._plain.fullmatch(text) and "<|" not in text:
            return packed(self.merger.encode_ordinary(text))
        return packed(library_tokenizer(self.path).encode(text, add_special_tokens=False).ids)

    def encode(self, chunks: list[bytes], known: dict[bytes, bytes] | None = None) -> bytes:
        """Packed ids of the text that these chunks make up, with the ids of chunks that are known.

        A chunk without a firm place is encoded with its neighbour as one. At every join the text between the last firm
        place of the one chunk and the first of the next is encoded as a whole; where that differs from the ids of its
        two sides apart, it takes their place. So every join agrees with the text.
        """
        known, groups = known or {}, []
        for chunk in chunks:
            text = chunk.decode("utf-8", "replace")
            first, last = self._first.search(text), self._last.match(text)
            if groups and not (first and groups[-1].firm):
                groups[-1].add(text, first and first.end(), last and last.end())
            else:
                groups.append(_Chunk(known.get(chunk)).add(text, first and first.end(), last and last.end()))
        texts = ["".join(g.parts) for g in groups]
        done = [(len(g.parts) == 1 and g.ids) or self.ids(text) for g, text in zip(groups, texts, strict=True)]
        for i in range(len(texts) - 1):
            tail, head = texts[i][groups[i].firm[1] :], texts[i + 1][: groups[i + 1].firm[0]]
            before, after, whole = self.ids(tail), self.ids(head), self.ids(tail + head)
            if whole != before + after:
                self.repairs += 1
                done[i], done[i + 1] = done[i][: -len(before)] + whole, done[i + 1][len(after) :]
        return b"".join(done)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that these packed ids stand for."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.special.keys() & set(numbers):
            raw = b"".join(self.special[i] if i in self.special else self.merger.decode_single_token_bytes(i) for i in numbers)
        else:
            raw = self.merger.decode_bytes(numbers)
        return raw.decode("utf-8", "replace").encode()


@cache
def chunk_encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)
