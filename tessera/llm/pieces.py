"""Streaming SentencePiece encoding and decoding.

The segmenter walks a text once.  At each place it looks at the pieces that
end there, at most the longest piece's length back, keeps a backpointer to
where its piece began, and gives ids out as soon as the paths of all places
that a later piece may still start from meet at one boundary.

The public model is a merge (BPE) model.  A plain best-score path over its
pieces gives other ids than the model's own, so a step here is allowed only
between neighbours that the merges leave apart: a segmentation is the merges'
result exactly if each piece and each pair of neighbours is, and every place
has one such piece.  This makes the path exact, with the same window, pointers
and commits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, text_windows

#: Words, their parts and pairs of pieces remembered by a Python worker; beyond it a memory starts anew.
WORDS, PARTS, PAIRS = 100_000, 600_000, 400_000
_GAP = "▁"


class Segmenter:
    """Pieces of a model file; ``segment`` streams ids of a string of symbols."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        plain = [i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        names = {i: model.id_to_piece(i) for i in plain}
        self.rank = {names[i]: (-model.get_score(i), i) for i in plain}
        self.longest = max(map(len, self.rank))
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: Neighbouring symbols inside some piece; between any others every path has a boundary.
        self.inner = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self.ids = {p: i for p, (_, i) in self.rank.items() if self._merged(p) == [p]}
        self.names, self.trie = names, {}  # the trie holds pieces from their ends; "" marks a whole one
        for p, i in self.ids.items():
            node = self.trie
            for symbol in reversed(p):
                node = node.setdefault(symbol, {})
            node[""] = i
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.table = [b""] * self.size
        for i in plain:
            self.table[i] = names[i].replace(_GAP, " ").encode()
        for b, i in enumerate(self.bytes):
            self.table[i] = bytes([b])

    def _merged(self, s: str) -> list[str]:
        """The merges' result for a short string: the best-ranked neighbours join first, the left ones on ties."""
        parts = list(s)
        while len(parts) > 1:
            best = min(((self.rank.get(a + b, (np.inf, 0)), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
            if best[0][0] == np.inf:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _apart(self, a: int, b: int) -> bool:
        """Whether the merges leave pieces ``a`` and ``b`` as neighbours."""
        key = a * self.size + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            x, y = self.names[a], self.names[b]
            known = self.pairs[key] = x[-1] + y[0] not in self.inner or self._merged(x + y) == [x, y]
        return known

    def segment(self, symbols: str) -> Iterator[int]:
        """Ids of a string of symbols, from a window of a few times the longest piece."""
        longest, total, done = self.longest, len(symbols), 0
        start, none = -1, -2
        last, begin = [start], [0]  # of place done + k: the piece that ends there and where it begins
        for at in range(1, total + 1):
            node, k, found = self.trie, at, []
            while k > done:
                node = node.get(symbols[k - 1])
                if node is None:
                    break
                k -= 1
                if "" in node:
                    found.append((k, node[""]))
            piece, origin = none, at - 1
            for k, candidate in reversed(found):  # one at most is right
                before = last[k - done]
                if before == start or before >= 0 and self._apart(before, candidate):
                    piece, origin = candidate, k
                    break
            else:
                if symbols[at - 1] not in self.rank:
                    piece = start  # no piece: its bytes, and a fresh start after it
            last.append(piece)
            begin.append(origin)
            if at < total and at - done < 4 * longest:
                continue
            alive = {at} if at == total else {k for k in range(max(done, at - longest + 1), at + 1) if last[k - done] != none}
            while len(alive) > 1:  # walk the furthest path back until all meet
                top = max(alive)
                alive = (alive - {top}) | {begin[top - done]}
            meet = k = alive.pop()
            path = []
            while k > done:
                path.append(k)
                k = begin[k - done]
            for k in reversed(path):
                if last[k - done] >= 0:
                    yield last[k - done]
                else:
                    yield from (self.bytes[b] for b in symbols[k - 1].encode())
            # the boundary's own piece stays as context for the next one
            last, begin, done = last[meet - done :], begin[meet - done :], meet

    def _part(self, symbols: str) -> bytes:
        if symbols not in self.parts:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            self.parts[symbols] = np.fromiter(self.segment(symbols), "<u4").tobytes()
        return self.parts[symbols]

    def word(self, symbols: str) -> bytes:
        """Ids of symbols between forced boundaries, from memory where possible; long strings are streamed."""
        if len(symbols) > 256:
            return np.fromiter(self.segment(symbols), "<u4").tobytes()
        known = self.words.get(symbols)
        if known is None:
            if len(self.words) >= WORDS:
                self.words.clear()
            cuts = [0, *(k for k in range(1, len(symbols)) if symbols[k - 1 : k + 1] not in self.inner), len(symbols)]
            known = self.words[symbols] = b"".join(self._part(symbols[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b)
        return known

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes; no piece crosses a gap from the left."""
        out: list[bytes] = [b""] * len(texts)
        odd = pc.match_substring_regex(texts, f"^$|^ |  | $|{_GAP}").to_numpy(zero_copy_only=False).astype(bool)
        for i in np.flatnonzero(odd):
            text = texts[int(i)].as_py()
            if text:
                symbols = _GAP + text.replace(" ", _GAP)
                cuts = [0, *(k for k in range(1, len(symbols)) if symbols[k] == _GAP != symbols[k - 1]), len(symbols)]
                out[i] = b"".join(self.word(symbols[a:b]) for a, b in zip(cuts, cuts[1:]))
        even = np.flatnonzero(~odd)
        if len(even):
            words = pc.split_pattern(texts.take(pa.array(even)), " ")
            ends, coded = np.asarray(words.offsets), words.values.dictionary_encode()
            found = [self.word(_GAP + w) for w in coded.dictionary.to_pylist()]
            table = np.frombuffer(b"".join(found), "<u4")
            sizes = np.fromiter((len(x) // 4 for x in found), np.int64, len(found))
            starts, index = np.cumsum(sizes) - sizes, np.asarray(coded.indices)
            each = sizes[index]
            upto = np.concatenate([[0], np.cumsum(each)])
            ids = table[np.repeat(starts[index] - upto[:-1], each) + np.arange(upto[-1])]
            for k, i in enumerate(even):
                out[i] = ids[upto[ends[k]] : upto[ends[k + 1]]].tobytes()
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids; the first gap is dropped, bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return text.removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[str, Segmenter] = {}


def segmenter(path: str) -> Segmenter:
    """The segmenter of a file, loaded once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = Segmenter(path)
    return _loaded[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per input row, ids as little-endian unsigned 32-bit binary.

    Null and empty texts have no ids.  Repeated rows get equal results; other
    columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_windows(batches, 4 << 20):
            done = segmenter(model_path).encode(texts)
            for k in range(0, len(done), 256):
                yield pa.record_batch([ids.slice(k, 256), pa.array(done[k : k + 256], pa.binary())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, ids binary")


def with_decoded(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) per input row, the text decoded from the ids; null ids give an empty text.

    A text comes back as it was, save that a literal U+2581 reads as a space.
    """
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = segmenter(model_path).decode
            texts = [read(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(run, "doc_id long, ids binary, text string")
