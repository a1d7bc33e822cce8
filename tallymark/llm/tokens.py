"""Token ids of whole texts with a public tokenizer file, one cache of word pieces per process.

Both tokenizers used here split a text before merging, and never merge across a change from a
non-space to a space character. So a text can be cut there, each cut piece encoded once, and the ids of
the pieces joined; the result equals that of encoding the whole text. Texts that hold a space character
other than the ASCII ones, or the string of a special token, are encoded whole, as the cuts are not proven there.
The pieces of many texts are found, told apart and put back as arrays; Python meets each distinct one once.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that some library counts as space, besides the ASCII ones at which texts are cut.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]")
#: Bytes of texts that may hold one of them.
_SUSPECT = b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3\xef"
#: Word pieces in each of the two generations that a process keeps: pieces of the older one that are met again move to the newer.
CACHE = 300_000
#: Kinds of bytes: ASCII space, letters, and the punctuation that starts no suffix as the apostrophe does.
_SPACE, _LETTER, _POINT = 1, 2, 4
_KIND = np.zeros(256, np.uint8)
for _kind, _bytes in ((_SPACE, rb" \t\n\r\x0b\x0c"), (_LETTER, rb"A-Za-z"), (_POINT, rb"!-&(-/:-@\[-`{-~")):
    _KIND[[m[0][0] for m in re.finditer(b"[" + _bytes + b"]", bytes(range(256)))]] = _kind
#: Characters of texts that are cut in one go, unless one text is longer, and pieces in one call of the tokenizer.
GROUP, JOINED = 4_000_000, 64
_loaded: dict[str, Encoder] = {}


def tokenizer_path(name: str) -> str:
    """The file of a tokenizer that comes with the machine's public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts to ids, as little-endian unsigned numbers of ``width`` bytes: 2 where all ids of the vocabulary fit, else 4."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.drops_space = drops_space
        self.special = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("H" if self.width == 2 else "I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def uncut(self, text: str, raw: bytes) -> bool:
        """Whether a text has to be encoded whole."""
        return len(raw.translate(None, _SUSPECT)) < len(raw) and _ODD.search(text) is not None or any(x in raw for x in self.special)

    def pieces(self, raws: list[bytes]) -> tuple[pa.LargeBinaryArray, list[int]]:
        """The pieces of all texts, and which one each text begins with; last, their number.

        Cuts are before space that follows something else, after a line end that stands alone, and between a letter and
        punctuation: there both tokenizers split, whatever else is around.
        """
        raw = b"".join(raws)
        starts = np.cumsum([0, *map(len, raws)])
        data = np.frombuffer(raw, np.uint8)
        kind = _KIND[data]
        space = kind == _SPACE
        cut = np.zeros(len(data) + 1, bool)
        np.greater(space[1:], space[:-1], out=cut[1:-1])
        cut[1:-1] |= (kind[1:] == _POINT) & (kind[:-1] == _LETTER)
        cut[2:-1] |= (data[1:-1] == 10) & ~space[2:] & ~space[:-2]
        cut[starts] = True
        at = np.flatnonzero(cut)
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw)])
        return found, np.searchsorted(at, starts).tolist()

    def apart(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece. A special token stands between pieces, so that one call encodes many and each by itself."""
        if not self.special:
            return self.whole([p.decode() for p in pieces])
        mark, number = next(iter(self.special.items()))
        joined = [mark.join(pieces[i : i + JOINED]).decode() for i in range(0, len(pieces), JOINED)]
        out, size = [], self.width
        for raw in self.whole(joined):
            at = 0
            for cut in np.flatnonzero(np.frombuffer(raw, f"<u{size}") == number).tolist():
                out.append(raw[at : cut * size])
                at = (cut + 1) * size
            out.append(raw[at:])
        return out

    def known(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each of distinct pieces, by way of the cache."""
        if len(self.cache) > CACHE:
            self.cache, self.older = {}, self.cache
        cache = self.cache
        out = list(map(cache.get, pieces))
        new = [p for p, x in zip(pieces, out, strict=True) if x is None]
        if not new:
            return out
        kept = list(map(self.older.get, new))
        todo = [p for p, x in zip(new, kept, strict=True) if x is None]
        cache.update(zip(new, kept, strict=True))
        cache.update(zip(todo, self.apart(todo), strict=True))
        return list(map(cache.__getitem__, pieces))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        done = 0
        while done < len(texts):
            raws: list[bytes] = []
            whole: dict[int, str] = {}
            size = 0
            while done < len(texts) and size < GROUP:
                text = texts[done] or ""
                raw = text.encode().lower() if self.drops_space else text.encode()
                if self.uncut(text, raw):
                    whole[len(raws)], raw = text, b""
                raws.append(raw)
                size += len(text)
                done += 1
            pieces, first = self.pieces(raws)
            coded = pieces.dictionary_encode()
            ids = pa.array(self.known(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
            at = np.frombuffer(ids.buffers()[1], np.int64)[first].tolist() if len(ids) else [0] * len(first)
            data = memoryview(ids.buffers()[2] or b"")
            for i, (begin, end) in enumerate(zip(at, at[1:])):
                yield self.whole([whole[i]])[0] if i in whole else bytes(data[begin:end])

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def wide(ids: bytes, width: int) -> bytes:
    """Ids of ``width`` bytes as unsigned 32-bit ones."""
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def encoder(path: str, drops_space: bool) -> Encoder:
    """This process's encoder for a tokenizer file. drops_space: the tokenizer makes no ids of spaces."""
    if path not in _loaded:
        _loaded[path] = Encoder(path, drops_space)
    return _loaded[path]
