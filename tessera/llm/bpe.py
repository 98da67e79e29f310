"""Byte-level BPE by backtracking over Aho-Corasick matches, and decoding by an offset table.

A text is cut at special tokens, then at its spaces, then by the vocabulary's pattern. Within a pretoken the encoder
takes the longest token that starts where it stands; a token stays if the pair with the token before it is
one that the merges would leave apart, else the next shorter token is tried, and without any the token before is
taken back. A position from which nothing fits is marked, so each is tried once and the work is linear.
Pairs are judged once and kept in a table.

Nulls and empty texts have no ids. Repeated rows each give their own row; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_map, texts_of

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES = 250_000
CACHE_LONGEST = 48


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    at = {b: chr(b) for b in kept}
    at |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in at)}
    return [at[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one vocabulary file; made once in each Python worker."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        n = 1 + max([*vocab.values(), *self.special.values()])
        tokens: list[bytes] = [b""] * n
        for s, i in vocab.items():
            tokens[i] = bytes(back[c] for c in s)
        self.parts: list[tuple[int, int] | None] = [None] * n
        self.rank = [-1] * n
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(spec["merges"] if "merges" in spec else spec["model"]["merges"]):
            i = vocab[a + b]
            if self.rank[i] < 0:
                self.rank[i], self.parts[i] = r, (vocab[a], vocab[b])
            self.joined[vocab[a], vocab[b]] = i
        self.tokens = tokens
        by_bytes = {t: i for i, t in enumerate(tokens) if t}
        self.auto = ahocorasick.Automaton()
        for t, i in by_bytes.items():
            self.auto.add_word(t.decode("latin-1"), (i, len(t)))
        self.auto.make_automaton()
        self.shorter = [self._prefix(by_bytes, t) for t in tokens]
        self.size = [len(t) for t in tokens]
        self.fits: dict[int, bool] = {}
        for s, i in self.special.items():
            tokens[i] = s.encode()
        self.split_special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.find = regex.compile(PATTERN).findall
        self.whole: dict[str, bytes] = {}
        self.chunks: dict[str, bytes | None] = {}
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.ends = np.cumsum(lengths)
        self.starts, self.lengths = self.ends - lengths, lengths
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    @staticmethod
    def _prefix(by_bytes: dict[bytes, int], token: bytes) -> int:
        """The longest token that is a proper prefix; -1 without one."""
        return next((by_bytes[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in by_bytes), -1)

    def compatible(self, left: int, right: int) -> bool:
        """True if the merges of left's and right's bytes together end in just these two tokens.

        The boundary is crossed by a merge of some piece at left's end with some piece at right's start. Both tokens are taken apart from the
        boundary outwards, the later merge first; a crossing merge that comes before the merge which would have used up its pieces breaks the pair.
        """
        pair = left << 20 | right
        known = self.fits.get(pair)
        if known is not None:
            return known
        a, b, until, ok = left, right, len(self.rank) + 1, True
        rank, parts, joined = self.rank, self.parts, self.joined
        while True:
            i = joined.get((a, b))
            if i is not None and rank[i] < until:
                ok = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            # the piece made last comes apart; between equals the left one was merged first, so the right one comes apart first
            if ra > rb:
                until, a = ra, parts[a][1]
            else:
                until, b = rb + 1, parts[b][0]
        if len(self.fits) >= 2 * CACHE_ENTRIES:
            self.fits.clear()
        self.fits[pair] = ok
        return ok

    def pretoken(self, raw: bytes) -> list[int]:
        n = len(raw)
        longest = [-1] * n
        for end, (i, size) in self.auto.iter(raw.decode("latin-1")):
            longest[end - size + 1] = i  # a later end is a longer match
        size, shorter, compatible = self.size, self.shorter, self.compatible
        if size[longest[0]] == n:
            i = longest[0]
            parts = self.parts[i]
            if parts is None or compatible(*parts):
                return [i]
        open_ = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while token >= 0:
            end = at + size[token]
            if open_[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = shorter[token]
            if token < 0:
                open_[at] = 0
                token = out.pop()
                at -= size[token]
                token = shorter[token] if not open_[at + size[token]] else token
                while token < 0:
                    open_[at] = 0
                    token = out.pop()
                    at -= size[token]
        return out

    def _plain(self, text: str) -> bytes:
        whole, out = self.whole, []
        for word in self.find(text):
            ids = whole.get(word)
            if ids is None:
                ids = np.array(self.pretoken(word.encode()), dtype="<u4").tobytes()
                if len(word) <= CACHE_LONGEST:
                    if len(whole) >= CACHE_ENTRIES:
                        whole.clear()
                    whole[word] = ids
            out.append(ids)
        return b"".join(out)

    def _slow(self, text: str) -> bytes:
        if self.split_special is None:
            return self._plain(text)
        return b"".join(np.array([self.special[x]], dtype="<u4").tobytes() if x in self.special else self._plain(x) for x in self.split_special.split(text) if x)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        Single spaces between other characters always begin a pretoken, so the text is cut there and equal chunks are encoded once. Where a space
        touches other white space the whole text goes through the pattern at once.
        """
        first, *rest = text.split(" ")
        chunks, out = self.chunks, []
        for i, word in enumerate([first, *rest]):
            got = chunks.get(word, 0) if i else 0
            if got == 0:
                if i and (not word or word[0].isspace() or word[-1].isspace()) or not i and word[-1:].isspace():
                    got = None
                elif not i:
                    got = self._slow(word) if word or not rest else None
                else:
                    got = self._slow(" " + word)
                if i and len(word) <= CACHE_LONGEST:
                    if len(chunks) >= CACHE_ENTRIES:
                        chunks.clear()
                    chunks[word] = got
            if got is None:
                return self._slow(text)
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of all ids, gathered by offset; what is not UTF-8 becomes U+FFFD."""
        if not len(ids):
            return ""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        index = np.ones(int(ends[-1]), dtype=np.int64)
        begin = ends - n
        starts = self.starts[ids]
        index[0] = starts[0]
        index[begin[1:]] = starts[1:] - (starts[:-1] + n[:-1]) + 1
        return self.pool[np.cumsum(index)].tobytes().decode("utf-8", errors="replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids binary): ids of each whole text as little-endian unsigned 32-bit integers."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.encode(x or "") for x in b.column("text").to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return arrow_map(texts_of(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches):
        c = codec(vocabulary)
        for b in batches:
            texts = [c.decode(np.frombuffer(x or b"", dtype="<u4")) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of each text's ids and of their decoding, both made in one pass so that neither is moved."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        c, rows = codec(vocabulary), []
        for text in b.column("text").to_pylist():
            raw = c.encode(text or "")
            said = c.decode(np.frombuffer(raw, dtype="<u4"))
            rows.append((len(raw) // 4, hashlib.sha256(raw).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
        n, a, d = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(texts_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
