"""Exact deduplication with Patricia-trie owners.

1. Each input partition inserts its texts, window by window, into a local
   compressed radix trie.  Of each distinct text of a window one row (the
   *representative*) keeps the bytes; the others only point to it.  A hot text
   leaves one row per window, however many copies there are.
2. Representatives are shuffled by text length and content hash to their
   owners.  An owner inserts the full byte strings into one trie whose
   terminal nodes hold the extreme identifier, the count and the
   representatives that ended there.  Over its memory bound an owner writes
   whole subtrees to its task's temporary folder and finishes them one by one.
3. The owners' verdicts go back to the rows by representative, a key that
   never has more rows than one window.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import small_batches, written

#: Bytes of text that a partition gathers before it passes a window on.
WINDOW_BYTES = 32 << 20
#: Bytes of labels that an owner's trie may hold before subtrees go to disk.
TRIE_BYTES = 96 << 20


def _shared_prefix(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:  # bisect on slice equality: compares run at C speed
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("label", "next", "value", "spill")

    def __init__(self, label: bytes):
        self.label, self.next, self.value, self.spill = label, {}, None, None


class PatriciaTrie:
    """Byte strings to values merged by ``merge(old, new)``.

    ``limit`` bounds the label bytes in memory; beyond it the heaviest
    subtrees move to files in ``folder`` and later keys below them are
    appended there.  ``items`` yields resident entries first and then takes
    each spilled subtree as a trie of its own.
    """

    def __init__(self, merge, limit: int | None = None, folder: str | None = None):
        self.root, self.merge, self.limit, self.folder, self.held = _Node(b""), merge, limit, folder, 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key[at:], value), node.spill, protocol=5)
                return
            if at == len(key):
                node.value = value if node.value is None else self.merge(node.value, value)
                return
            child = node.next.get(key[at])
            if child is None:
                leaf = node.next[key[at]] = _Node(key[at:])
                leaf.value = value
                self.held += len(leaf.label) + 200
                if self.limit and self.held > self.limit:
                    self._shed()
                return
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            cut = _shared_prefix(child.label, key, at)
            fork = node.next[key[at]] = _Node(child.label[:cut])
            child.label = child.label[cut:]
            fork.next[child.label[0]] = child
            self.held += 200
            at += cut
            node = fork

    @staticmethod
    def _walk(node: _Node, prefix: bytes = b"") -> Iterator[tuple[bytes, _Node]]:
        stack = [(prefix, node)]
        while stack:
            path, x = stack.pop()
            path += x.label
            yield path, x
            stack += [(path, y) for y in x.next.values()]

    @staticmethod
    def _weight(node: _Node) -> int:
        total, stack = 0, [node]
        while stack:
            x = stack.pop()
            total += len(x.label) + 200
            stack += x.next.values()
        return total

    @staticmethod
    def _spilled(file) -> Iterator[tuple[bytes, object]]:
        """The entries of a spilled subtree: what follows its label, and the value."""
        file.seek(0)
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                break
        file.close()

    def _shed(self) -> None:
        fork = self.root
        while len(fork.next) == 1 and fork.value is None and fork.spill is None:
            fork = next(iter(fork.next.values()))
        for weight, child in sorted(((self._weight(x), x) for x in fork.next.values() if x.spill is None), key=lambda p: -p[0]):
            file = tempfile.TemporaryFile(dir=self.folder)
            for path, x in self._walk(child):
                if x.value is not None:
                    pickle.dump((path[1:], x.value), file, protocol=5)
                if x.spill is not None:  # a part that went to disk before moves along
                    for rest, value in self._spilled(x.spill):
                        pickle.dump((path[1:] + rest, value), file, protocol=5)
            child.label, child.next, child.value, child.spill = child.label[:1], {}, None, file
            self.held -= weight
            if self.held <= self.limit // 2:
                break
        self.held = self._weight(self.root)

    def values(self) -> Iterator[object]:
        """The merged value of every distinct key."""
        spilled, stack = [], [self.root]
        while stack:
            x = stack.pop()
            if x.value is not None:
                yield x.value
            if x.spill is not None:
                spilled.append(x.spill)
            stack += x.next.values()
        self.root, self.held = _Node(b""), 0
        for file in spilled:
            below = PatriciaTrie(self.merge, self.limit, self.folder)
            for rest, value in self._spilled(file):
                below.insert(rest, value)
            yield from below.values()


def _beats(a: tuple, b: tuple, largest: bool) -> bool:
    """Whether row a = (id, uid) stays rather than b: null ids lose, ties go to the smaller uid."""
    if a[0] == b[0]:
        return a[1] < b[1]
    if a[0] is None or b[0] is None:
        return b[0] is None
    return (a[0] > b[0]) == largest


_LOCAL = "doc_id long, uid long, slot long, text_sha256 string, length long, content_hash long, body binary, copies long"
_OWNED = "slot long, keep_id long, keep_uid long, group_size long"


def _local_windows(largest: bool):
    def merge(a, b):
        a[0].append(b[0][0])
        a[1] = b[1] if _beats(b[1], a[1], largest) else a[1]
        return a

    schema = pa.schema([("doc_id", pa.int64()), ("uid", pa.int64()), ("slot", pa.int64()), ("text_sha256", pa.string()), ("length", pa.int64()), ("content_hash", pa.int64()), ("body", pa.binary()), ("copies", pa.int64())])

    def flush(ids, texts, first):
        trie = PatriciaTrie(merge)
        for i, (doc, text) in enumerate(zip(ids, texts)):
            trie.insert(text, [[i], (doc, first + i)])
        rows = [None] * len(ids)
        for members, (_, best) in trie.values():
            text = texts[members[0]]
            digest = hashlib.sha256(text).digest()
            for i in members:
                own = first + i == best
                rows[i] = (ids[i], first + i, best, digest.hex(), len(text), int.from_bytes(digest[:8], "big", signed=True), text if own else None, len(members) if own else None)
        for k in range(0, len(rows), 512):
            columns = list(zip(*rows[k : k + 512]))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, ids, texts, held = TaskContext.get().partitionId() << 33, [], [], 0
        for batch in batches:
            ids += batch.column(0).to_pylist()
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                texts.append((text or b"").lower())  # bytes.lower() folds A-Z only
                held += len(texts[-1])
            if held >= WINDOW_BYTES:
                yield from flush(ids, texts, first)
                first, ids, texts, held = first + len(ids), [], [], 0
        if ids:
            yield from flush(ids, texts, first)

    return run


def _owners(largest: bool, trie_bytes: int):
    def merge(a, b):
        a[0] += b[0]
        a[1] = b[1] if _beats(b[1], a[1], largest) else a[1]
        a[2].extend(b[2])
        return a

    schema = pa.schema([(n, pa.int64()) for n in ("slot", "keep_id", "keep_uid", "group_size")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            trie = PatriciaTrie(merge, trie_bytes, folder)
            for batch in batches:
                for doc, slot, copies, body in zip(*(c.to_pylist() for c in batch.columns)):
                    trie.insert(body, [copies, (doc, slot), [slot]])
            rows = []
            for copies, (doc, uid), slots in trie.values():
                for slot in slots:
                    rows.append((slot, doc, uid, copies))
                if len(rows) >= 8192:
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

    return run


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the
    empty text.  ``keep`` names which identifier stays ("smallest" or
    "largest").  A null identifier loses against any other; of rows equal in
    identifier and text exactly one stays.  An empty table gives an empty
    result; other columns of the input are ignored, whatever their names.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    small_batches(docs.sparkSession)
    largest = keep == "largest"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    local = written(rows.mapInArrow(_local_windows(largest), _LOCAL), "exact_local")
    owned = (
        local.where("body IS NOT NULL")
        .select("doc_id", "slot", "copies", "body", "length", "content_hash")
        .repartition("length", "content_hash")
        .select("doc_id", "slot", "copies", "body")
        .mapInArrow(_owners(largest, trie_bytes), _OWNED)
    )
    return local.select("doc_id", "uid", "slot", "text_sha256").join(owned, "slot").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), "text_sha256")
