"""Token ids of a public word-end BPE file, as ``tokenizers`` gives them.

The library spends most of its time in text normalisation.  Its pipeline here
(NFC, white space, lower case, a split that never crosses white space, byte
symbols, BPE) acts on each word by itself, so a window of texts is cut into
words with Arrow kernels, each distinct word is looked up once, and only words
not seen lately reach the library.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by a Python worker; beyond it the memory starts anew.
REMEMBERED = 600_000

#: Characters whose lower case, class and normal form the kernels and the library agree on.
_OTHER = "[^\t-\r -~À-ÖØ-öø-ÿ]|<\\|"
#: The file's split pattern for those characters in lower case, less its runs of letters.
_NO_LETTERS = "('(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\sa-zß-öø-ÿ0-9]+)"
#: White space in the library's regex engine.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")


def _byte_symbols() -> dict[int, int]:
    """Byte to printable symbol: printable Latin-1 stays, the rest is numbered from 256."""
    stays = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in stays]
    return {b: 256 + i for i, b in enumerate(rest)}


class _Words(dict):
    def __init__(self, look_up: Callable[[str], bytes]):
        self.look_up = look_up

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = self.look_up(word)
        return ids


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        model, symbols = whole.model, _byte_symbols()
        pack = lambda ids: np.fromiter(ids, "<u4").tobytes()
        self.plain = _Words(lambda w: pack(t.id for t in model.tokenize(w.encode().decode("latin-1").translate(symbols))))
        self.any = _Words(lambda w: pack(whole.encode(w, add_special_tokens=False).ids))

    def encode(self, texts: pa.Array) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        other = pc.match_substring_regex(texts, _OTHER).to_numpy(zero_copy_only=False).astype(bool)
        for i in np.flatnonzero(other):
            out[i] = b"".join(map(self.any.__getitem__, filter(None, _SPACE.split(texts[int(i)].as_py()))))
        rest = np.flatnonzero(~other)
        if len(rest):
            plain = texts if len(rest) == len(texts) else texts.take(pa.array(rest))
            words = pc.utf8_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(plain), _NO_LETTERS, " \\1 "))
            ends = np.asarray(words.offsets)
            coded = words.values.dictionary_encode()
            found = [self.plain[w] if w else b"" for w in coded.dictionary.to_pylist()]
            table = np.frombuffer(b"".join(found), "<u4")
            sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
            starts = np.cumsum(sizes) - sizes
            index = np.asarray(coded.indices)
            each = sizes[index]
            upto = np.concatenate([[0], np.cumsum(each)])
            ids = table[np.repeat(starts[index] - upto[:-1], each) + np.arange(upto[-1])]
            cuts = upto[ends]
            for k, i in enumerate(rest):
                out[i] = ids[cuts[k] : cuts[k + 1]].tobytes()
        return out


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
