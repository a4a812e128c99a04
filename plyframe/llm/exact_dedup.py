"""Exact duplicates by compressed radix tries.

Each input partition first folds its own copies in a trie, so that a text that
fills a third of the table leaves at most one row per partition.  Those rows
travel to the owner of their (length, content hash), which inserts the full
byte string into its trie.  A terminal node keeps the best row: most code
points in the original, then smallest id.  An owner over its memory budget
writes its heaviest subtree to disk and handles it afterwards on its own.
Members find their group through the key of their partition-local
representative, never through the text, so no join key is hot.

Null text counts as empty.  Null ids lose against any id; of rows that are
equal in all of this exactly one stays.  A very long text is one byte string in
one trie; Arrow batches are taken in parts of about 1 MB of text, whole rows.  An
empty table gives an empty result.  Other columns are carried in a struct, so
their names can't clash.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import WHITE, slices, text_or_empty, written

#: Guessed bytes of a trie node besides its label, and of a member of its list.
NODE_BYTES, MEMBER_BYTES = 250, 40
#: Files that an owner has open at most; more spilled subtrees share them.
MOST_FILES = 32


class _Node:
    __slots__ = ("label", "kids", "item")

    def __init__(self, label: bytes):
        self.label, self.kids, self.item = label, None, None


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class RadixTrie:
    """A Patricia trie over byte strings; insert() returns the terminal node."""

    def __init__(self, item_bytes: Callable[[object], int] = lambda item: 0):
        self.root, self.size, self.item_bytes = _Node(b""), 0, item_bytes

    def insert(self, key: bytes) -> _Node:
        node, at = self.root, 0
        while at < len(key):
            kids = node.kids
            child = kids.get(key[at]) if kids else None
            if child is None:
                new = _Node(key[at:])
                if kids is None:
                    node.kids = {}
                node.kids[key[at]] = new
                self.size += NODE_BYTES + len(new.label)
                return new
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            k = _common(child.label, key, at)
            middle = _Node(child.label[:k])
            child.label = child.label[k:]
            middle.kids = {child.label[0]: child}
            node.kids[key[at]] = middle
            self.size += NODE_BYTES
            node, at = middle, at + k
        return node

    def walk(self, node: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, object]]:
        """(key, item) of every terminal at or below node; prefix ends with its label."""
        stack = [(node or self.root, prefix)]
        while stack:
            node, path = stack.pop()
            if node.item is not None:
                yield path, node.item
            for child in (node.kids or {}).values():
                stack.append((child, path + child.label))

    def cut_heaviest(self) -> tuple[bytes, list[tuple[bytes, object]]]:
        """Take out the heaviest subtree below the first fork: its prefix, its entries."""
        node, path = self.root, b""
        while node.kids and len(node.kids) == 1 and node.item is None:
            node = next(iter(node.kids.values()))
            path += node.label
        if not node.kids:
            return b"", []

        def weight(top: _Node) -> int:
            total, stack = 0, [top]
            while stack:
                x = stack.pop()
                total += NODE_BYTES + len(x.label) + (self.item_bytes(x.item) if x.item is not None else 0)
                stack += (x.kids or {}).values()
            return total

        first, child = max(node.kids.items(), key=lambda kv: weight(kv[1]))
        self.size -= weight(child)
        del node.kids[first]
        return path + bytes([first]), list(self.walk(child, path + child.label))


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id, row key), the one that stays."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2]))


class _Owner:
    """Folds (key, best, count, members) with equal keys, in bounded memory."""

    def __init__(self, most: int):
        self.most, self.trie = most, self._trie()
        self.files, self.spilled, self.lengths = [], {}, set()

    @staticmethod
    def _trie() -> RadixTrie:
        return RadixTrie(lambda item: MEMBER_BYTES * len(item[2]))

    def _file_of(self, key: bytes):
        """The file of the spilled subtree that a key belongs to, or None."""
        for n in self.lengths:
            if (file := self.spilled.get(key[:n])) is not None:
                return file
        return None

    def add(self, key: bytes, best: tuple, count: int, members: list[int]) -> None:
        if (file := self._file_of(key)) is not None:
            pickle.dump((key, best, count, members), file)
            return
        node = self.trie.insert(key)
        if node.item is None:
            node.item = [best, count, members]
        else:
            node.item[0] = _better(node.item[0], best)
            node.item[1] += count
            node.item[2] += members
        self.trie.size += MEMBER_BYTES * len(members)
        if self.trie.size > self.most:
            prefix, entries = self.trie.cut_heaviest()
            if entries:
                if len(self.files) < MOST_FILES:
                    self.files.append(tempfile.TemporaryFile())
                self.spilled[prefix] = file = self.files[len(self.spilled) % MOST_FILES]
                self.lengths.add(len(prefix))
                for k, (b, n, m) in entries:
                    pickle.dump((k, b, n, m), file)

    def groups(self) -> Iterator[tuple[bytes, list]]:
        yield from self.trie.walk()
        self.trie = self._trie()
        for file in self.files:
            end = file.tell()
            file.seek(0)
            inner = _Owner(self.most)
            while file.tell() < end:
                inner.add(*pickle.load(file))
            file.close()
            yield from inner.groups()


def _fold_partition(most: int):
    """Rows in: n_cp, norm, and columns to pass on.  Rows out: members, then the
    representatives of the texts seen, each with its full byte string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        trie, row = RadixTrie(), 0
        carried = None

        def reps():
            nonlocal trie
            part, size = [], 0
            for key, (best, count, rep) in trie.walk():
                part.append((rep, best[1], best[0], best[2], count, key))
                size += len(key)
                if size > 8 << 20:
                    yield part
                    part, size = [], 0
            if part:
                yield part
            trie = RadixTrie()

        def as_batch(part, schema_of):
            none = lambda t: pa.nulls(len(part), t)
            cols = list(zip(*part))
            return pa.RecordBatch.from_arrays(
                [pa.array([True] * len(part)), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), none(pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.binary()), none(schema_of)],
                names=["is_rep", "rep", "id", "n_cp", "row_key", "sha", "size", "payload", "carry"],
            )

        for batch in (part for whole in batches for part in slices(whole, "norm")):
            carried = batch.column("carry").type
            ids, lengths = batch.column("id").to_pylist(), batch.column("n_cp").to_pylist()
            mine = []
            for i, (key, doc, n) in enumerate(zip(batch.column("norm").to_pylist(), ids, lengths, strict=True)):
                me = base + row + i
                node = trie.insert(key)
                if node.item is None:
                    node.item = [(n, doc, me), 1, me]
                else:
                    node.item[0] = _better(node.item[0], (n, doc, me))
                    node.item[1] += 1
                mine.append(node.item[2])
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * k), pa.array(mine, pa.int64()), batch.column("id"), batch.column("n_cp"), pa.array(range(base + row, base + row + k), pa.int64()), batch.column("sha"), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), batch.column("carry")],
                names=["is_rep", "rep", "id", "n_cp", "row_key", "sha", "size", "payload", "carry"],
            )
            row += k
            if trie.size > most:
                for part in reps():
                    yield as_batch(part, carried)
        for part in reps():
            yield as_batch(part, carried)

    return run


def _own_partition(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = _Owner(most)
        for batch in (part for whole in batches for part in slices(whole, "payload")):
            c = {n: batch.column(n).to_pylist() for n in ("rep", "id", "n_cp", "row_key", "size", "payload")}
            for rep, doc, n, key, size, text in zip(*c.values(), strict=True):
                owner.add(text, (n, doc, key), size, [rep])
        out = ([], [], [], [])
        names = ["rep", "keep_id", "keep_row", "group_size"]
        for _, (best, count, members) in owner.groups():
            for x, v in zip(out, (members, [best[1]] * len(members), [best[2]] * len(members), [count] * len(members)), strict=True):
                x.extend(v)
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)
                out = ([], [], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=names)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, trie_mb: int = 96) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha256 of the text
    without white space, and the struct `carry` of the columns asked for."""
    wanted = [F.col(f"`{c}`").alias(c) for c in carry or []]
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.char_length(text_or_empty(text_col)).cast("long").alias("n_cp"),
        F.translate(text_or_empty(text_col), WHITE, "").alias("norm"),
        (F.struct(*wanted) if wanted else F.lit(None).cast("boolean")).alias("carry"),
    ).select("id", "n_cp", F.sha2("norm", 256).alias("sha"), F.col("norm").cast("binary").alias("norm"), "carry")
    schema = StructType.fromDDL("is_rep boolean, rep long, id long, n_cp long, row_key long, sha string, size long, payload binary").add("carry", rows.schema["carry"].dataType)
    folded = written(rows.mapInArrow(_fold_partition(trie_mb << 20), schema), "exact-dedup")
    owners = (
        folded.filter("is_rep")
        .select("rep", "id", "n_cp", "row_key", "size", "payload")
        .repartition(F.length("payload"), F.xxhash64("payload"))
        .mapInArrow(_own_partition(trie_mb << 20), "rep long, keep_id long, keep_row long, group_size long")
    )
    members = folded.filter("not is_rep").select("rep", "id", "row_key", "sha", *(["carry"] if wanted else []))
    return members.join(owners, "rep").select(
        "id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"), *(["carry"] if wanted else [])
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    found = exact_groups(docs, id_col, text_col, carry=docs.columns)
    return found.filter("kept").select("carry.*")
