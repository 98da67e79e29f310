"""Ids of whole texts by the tokenizers library, equal words encoded once.

With this vocabulary no pretoken crosses white space, so a text's ids are those of its chunks between white space, one after another. Texts of Latin-1
characters are lower-cased and cut into chunks many at a time; their distinct chunks are cut into pretokens here, and new pretokens go through the library's model. In
other texts each new chunk goes through the whole of the library. A text with separators that Python and the vocabulary see differently, or with what may be a
special token, goes through the library at once. Pretokens and chunks are kept in bounded tables.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.bpe import byte_letters

CACHE_ENTRIES = 300_000
CACHE_LONGEST = 48
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: White space among the characters of Latin-1, but for the blank.
SPACES = "\t\n\x0b\x0c\r\x85\xa0"
#: Characters of text that are cut into chunks at once; a longer text goes in parts that end before a blank.
AT_ONCE = 1 << 20
#: Characters that Python splits at and the vocabulary's pattern doesn't.
NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


def _raw(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Pretokens(dict):
    """Ids of lower-cased Latin-1 chunks; only single pretokens are kept."""

    def __init__(self, model) -> None:
        import regex

        self.tokenize, self.find = model.tokenize, regex.compile(PRETOKEN).findall
        self.letters = {i: c for i, c in enumerate(byte_letters())}

    def __missing__(self, chunk: str) -> bytes:
        if not chunk.isalpha() and len(chunk) > 1:
            if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
                return self[chunk[:-1]] + self[chunk[-1]]
            parts = self.find(chunk)
            if len(parts) > 1:
                return b"".join(map(self.__getitem__, parts))
        shown = chunk.encode().decode("latin-1").translate(self.letters)  # the model knows a control byte by its letter alone, like any other
        ids = _raw([t.id for t in self.tokenize(shown)])
        if len(chunk) <= CACHE_LONGEST:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


class _Chunks(dict):
    """Ids of chunks without white space."""

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        ids = _raw(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(chunk) <= CACHE_LONGEST:
            if len(self) >= CACHE_ENTRIES // 4:
                self.clear()
            self[chunk] = ids
        return ids


class Chunks:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.pretoken = _Pretokens(self.tokenizer.model).__getitem__
        self.chunk = _Chunks(self.tokenizer).__getitem__

    def _one(self, text: str) -> bytes:
        """Ids of a text that isn't simple."""
        if "<|" in text or any(c in text for c in NOT_SPACE):
            return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunk, text.split()))

    def _many(self, texts: list[str]) -> list[bytes]:
        """Ids of lower-cased simple texts with blanks as their only white space."""
        words = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        of, distinct = np.asarray(coded.indices), coded.dictionary
        one = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), " ")[0].as_py()  # a string that is split again takes less time than a list of strings
        each = list(map(self.pretoken, one.split(" ")))
        size = np.array([len(x) // 4 for x in each], dtype=np.int64)
        pool, begin = np.frombuffer(b"".join(each), dtype="<u4"), np.cumsum(size) - size
        n = size[of]
        end = np.concatenate(([0], np.cumsum(n)))
        raw = pool[np.repeat(begin[of] - end[:-1], n) + np.arange(end[-1])].tobytes()
        cut = (4 * end[np.asarray(words.offsets)]).tolist()
        return [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; a null has none."""
        out: list[bytes] = []
        held: list[tuple[int, str]] = []
        size = 0

        def take() -> None:
            nonlocal held, size
            for (i, _), raw in zip(held, self._many([x for _, x in held]), strict=True):
                out[i] += raw
            held, size = [], 0

        for i, x in enumerate(texts):
            out.append(b"")
            if not x:
                continue
            if not _simple(x):
                out[i] = self._one(x)
                continue
            for part in _parts(_blanked(x.lower())):
                held.append((i, part))
                size += len(part)
                if size >= AT_ONCE:
                    take()
        if held:
            take()
        return out


def _simple(text: str) -> bool:
    """Whether a text has Latin-1 characters only, no separators that are seen differently, and nothing that may be a special token."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text and not any(c in text for c in NOT_SPACE)


def _blanked(text: str) -> str:
    for c in SPACES:
        if c in text:
            text = text.replace(c, " ")
    return text


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > AT_ONCE and (cut := text.find(" ", at + AT_ONCE)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


_made: dict[str, Chunks] = {}


def chunks(path: str) -> Chunks:
    if path not in _made:
        _made[path] = Chunks(path)
    return _made[path]
