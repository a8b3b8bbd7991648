"""Bounded-space online packing of token ids into training sequences.

Every partition keeps a fixed number of open windows.  What fills a whole
sequence leaves at once; a remainder goes to the open window that it fits
best.  When none fits, the fullest window is topped up from the remainder and
emitted, so sequences leave a partition full.  The windows still open at the
end are the leftovers: a second pass over groups of partitions concatenates
them, and cuts the last, partial run of a group at powers of two, lengths that
take no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, text_windows, written
from tessera.llm.word_bpe import encoder

WINDOW_TOKENS = 4096
OPEN_WINDOWS = 32
#: Partitions whose leftovers one task merges: 8 x 32 windows of 16 KB at most.
MERGED_PARTITIONS = 8

_ROW = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, leftover long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("leftover", pa.int64())])
_BATCH_BYTES = 4 << 20


class _Out:
    """Gathers rows into record batches of a few megabytes."""

    def __init__(self):
        self.rows, self.bytes = [], 0

    def add(self, sequence: int, pieces: list[tuple], leftover: int | None = None) -> None:
        offset = 0
        for doc, start, total, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc, start, n, total, sequence, offset, ids, leftover))
            self.bytes += len(ids) + 64
            offset += n

    def take(self, all_of_it: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (all_of_it or self.bytes >= _BATCH_BYTES):
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.rows), _SCHEMA)], schema=_SCHEMA)
            self.rows, self.bytes = [], 0


def _pack_partition(path: str, end_id: int, size: int, windows: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode, TaskContext.get().partitionId()
        number, out, opened = part << 32, _Out(), []  # opened: [tokens, pieces]
        for docs, texts in text_windows(batches):
            for doc, ids in zip(docs.to_pylist(), encode(texts)):
                ids += end
                total, at = len(ids) // 4, 0
                while at < total:
                    rest = total - at
                    if rest >= size:
                        out.add(number, [(doc, at, total, ids[4 * at : 4 * (at + size)])])
                        number, at = number + 1, at + size
                        continue
                    fits = [w for w in opened if size - w[0] >= rest]
                    if fits or len(opened) < windows:
                        if fits:
                            best = max(fits, key=lambda w: w[0])
                        else:
                            opened.append(best := [0, []])
                        take = rest
                    else:
                        best = max(opened, key=lambda w: w[0])
                        take = size - best[0]
                    best[1].append((doc, at, total, ids[4 * at : 4 * (at + take)]))
                    best[0] += take
                    at += take
                    if best[0] == size:
                        out.add(number, best[1])
                        number += 1
                        opened.remove(best)
                yield from out.take()
        for _, pieces in opened:
            out.add(number, pieces, part)
            number += 1
        yield from out.take(True)

    return run


def _merge_leftovers(size: int):
    def close(out: _Out, number: int, pieces: list[tuple], tokens: int) -> int:
        """Emit a run of pieces as sequences, each a power of two long unless it is full."""
        while pieces:
            want = size if tokens >= size else 1 << (tokens.bit_length() - 1)
            now, held = [], 0
            while held < want:
                doc, start, total, ids = pieces.pop(0)
                n = min(len(ids) // 4, want - held)
                now.append((doc, start, total, ids[: 4 * n]))
                held += n
                if 4 * n < len(ids):
                    pieces.insert(0, (doc, start + n, total, ids[4 * n :]))
            out.add(number, now)
            number, tokens = number + 1, tokens - want
        return number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, groups = _Out(), {}  # a task may get several groups, in any order
        for batch in batches:
            for doc, start, total, sequence, offset, ids, group in zip(*(c.to_pylist() for c in batch.columns)):
                groups.setdefault(group, []).append((sequence, offset, (doc, start, total, ids)))
        for group, rows in groups.items():
            rows.sort(key=lambda r: r[:2])
            pieces = [r[2] for r in rows]
            close(out, (1 << 62) | (group << 32), pieces, sum(len(p[3]) // 4 for p in pieces))
            yield from out.take()
        yield from out.take(True)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = WINDOW_TOKENS, windows: int = OPEN_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    A document is its ids followed by ``end_id``; a null or empty text is the
    end id alone.  ``ids`` holds little-endian unsigned 32-bit values.  Each
    input row is packed for itself, also when identifiers repeat or are null.
    An empty table gives an empty result, and other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = written(rows.mapInArrow(_pack_partition(tokenizer_path, end_id, size, windows), _ROW), "packed")
    group = F.floor(F.col("leftover") / F.lit(MERGED_PARTITIONS)).cast("long").alias("grp")
    merged = (
        packed.where("leftover IS NOT NULL")
        .select("doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids", group)
        .repartition("grp")
        .mapInArrow(_merge_leftovers(size), _ROW)
    )
    return packed.where("leftover IS NULL").unionByName(merged).drop("leftover")
