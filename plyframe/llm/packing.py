"""Best-fit packing by linear grouping.

A document becomes pieces of at most `capacity` tokens (only longer ones are
cut; the first piece takes the remainder).  The packing problem depends on the
pieces only through how many there are of each length, a table of at most
`capacity` numbers at any scale, so the plan is made from that histogram:

1. Large lengths (over capacity * small_share) are split by rank into `groups`
   groups of equal cardinality and rounded up to the longest of their group; the
   number of groups doubles while rounding adds over MOST_ROUNDING of the tokens.
2. Column generation finds the few-size configurations (which rounded lengths
   share a sequence) of the least fractional count; whole multiples are taken.
3. Actual lengths take the places of the rounded ones, longest first.
4. What is left, large and small, goes best-fit into the gaps, then into new
   sequences.  No sequence of step 3 is taken apart again.

Pieces then find their sequence by their length and their rank among pieces of
that length.  Ranks come from counts by (length, salt); a length has as many
salts as its pieces need at SALT_ROWS each, so that one that a third of all
pieces share is numbered by as many tasks as its number asks for.

Null text counts as empty (one token: the end mark).  Null or repeated ids and
equal rows are packed row by row; ties in length are ranked by id, piece and
checksum.  A very long text is encoded whole, in the task that has it, and leaves
as pieces.  Columns other than id and text are not looked at, so their names can't
clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import text_or_empty, written

#: Share of the large pieces' tokens that rounding may add.
MOST_ROUNDING = 0.005
#: Pieces of one length that one task numbers.
SALT_ROWS = 1_000_000
#: Written in a text, the vocabulary's special token is that token's id.
SPECIAL = "<|endoftext|>"


# ---------------------------------------------------------------- tokens


@functools.cache
def encoder(json_path: str, ranks_path: str, pattern: str):
    """text -> ids as `tokenizers` gives them without added special tokens.

    The same vocabulary as ranks is several times faster; without runs of white
    space the look-ahead of the pattern has no effect and is left out.  Texts
    with the special token's own string go to `tokenizers`.
    """
    import tiktoken
    from tokenizers import Tokenizer

    def ranked(name: str, split: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding(name, pat_str=split, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    # Each takes some 100 MB of a worker, and most workers need the first only.
    quick = ranked("quick", pattern.replace(r"\s+(?!\S)|", ""))
    plain = functools.cache(lambda: ranked("whole", pattern))
    exact = functools.cache(lambda: Tokenizer.from_file(json_path))
    runs = re.compile(r"\s\s").search

    def encode(text: str) -> list[int]:
        if SPECIAL in text:
            return exact().encode(text, add_special_tokens=False).ids
        return plain()(text) if runs(text) else quick(text)

    return encode


def tokenizer_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids)."""
    paths = tokenizer or tokenizer_paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = array("I", encode(text))
                ids.append(end_id)
                start, n = 0, len(ids)
                for piece in range(-(-n // capacity)):
                    length = (n - 1) % capacity + 1 if piece == 0 else capacity
                    part = ids[start : start + length]
                    for column, value in zip(out, (doc, piece, start, length, zlib.crc32(part.tobytes()), part.tolist() if with_ids else None), strict=True):
                        column.append(value)
                    start += length
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: 6 if with_ids else 5], names=names[: 6 if with_ids else 5])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


# ---------------------------------------------------------------- the plan

Runs = list[tuple[tuple[int, ...], int]]  # (lengths in a sequence, how many such sequences)


def linear_groups(histogram: np.ndarray, least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths of at least `least`, longest first, in groups of equal cardinality;
    each group a list of (length, count)."""
    total = int(histogram[least:].sum())
    share = -(-total // groups) if total else 0
    found, room = [], 0
    for length in range(len(histogram) - 1, least - 1, -1):
        count = int(histogram[length])
        while count:
            if not room:
                found.append([])
                room = share
            n = min(count, room)
            found[-1].append((length, n))
            count, room = count - n, room - n
    return found


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of covering `demand` with configurations of `sizes`
    (column generation; the pricing problem is a knapsack over the capacity)."""
    k = len(sizes)
    size, need = np.array(sizes), np.array(demand, float)
    patterns = np.diag(capacity // size).astype(float)
    inverse, level = np.diag(1 / np.diag(patterns)), need / np.diag(patterns)
    # Where a configuration of c tokens comes from when size g is its last one.
    before = np.arange(capacity + 1)[:, None] - size[None, :]
    fits, before = before >= 0, np.maximum(before, 0)
    for _ in range(60 * k):
        price = inverse.sum(axis=0)
        best, choices = np.zeros(capacity + 1), []
        for _ in range(capacity // int(size.min())):
            value = np.where(fits, best[before] + price, -1.0)
            g = value.argmax(axis=1)
            longer = value[np.arange(capacity + 1), g]
            choices.append(np.where(longer > best + 1e-12, g, -1))
            best = np.maximum(best, longer)
        if best[capacity] <= 1 + 1e-9:
            break
        new, c = np.zeros(k), capacity
        for choice in reversed(choices):
            if choice[c] >= 0:
                new[choice[c]] += 1
                c -= sizes[choice[c]]
        step = inverse @ new
        ratio = np.where(step > 1e-9, level / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        amount = ratio[out]
        level = level - amount * step
        level[out] = amount
        patterns[:, out] = new
        pivot = inverse[out] / step[out]
        inverse = inverse - np.outer(step, pivot)
        inverse[out] = pivot
    return [(patterns[:, j].astype(int), float(level[j])) for j in range(k)]


def substitute(groups: list[list[tuple[int, int]]], chosen: list[tuple[np.ndarray, int]]) -> tuple[Runs, dict[int, int]]:
    """Fill configurations with actual lengths; also the lengths left over."""
    queue = [list(reversed(g)) for g in groups]
    runs: Runs = []
    for pattern, times in chosen:
        slots = []
        for g, n in enumerate(pattern):
            for _ in range(int(n)):
                taken, left = [], times
                while left and queue[g]:
                    length, count = queue[g].pop()
                    use = min(left, count)
                    taken.append((length, use))
                    left -= use
                    if count > use:
                        queue[g].append((length, count - use))
                slots.append(taken)
        done = 0
        marks = sorted({0, times} | {int(x) for s in slots for x in np.cumsum([n for _, n in s])})
        for a, b in zip(marks, marks[1:]):
            items = []
            for s in slots:
                at = 0
                for length, n in s:
                    if at <= a < at + n:
                        items.append(length)
                    at += n
            if items:
                runs.append((tuple(items), b - a))
            done = b
        assert done == times
    rest: dict[int, int] = {}
    for g in queue:
        for length, count in g:
            rest[length] = rest.get(length, 0) + count
    return runs, rest


def best_fit(runs: Runs, lengths: dict[int, int], capacity: int) -> Runs:
    """Put `lengths`, longest first, each into the fullest sequence that takes it."""
    gaps: list[Runs] = [[] for _ in range(capacity + 1)]
    for items, n in runs:
        gaps[capacity - sum(items)].append((items, n))
    for length in sorted(lengths, reverse=True):
        count, gap = lengths[length], length
        while count:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            items, n = gaps[gap].pop() if gap <= capacity else ((), -(-count // (capacity // length)))
            fit = (gap if gap <= capacity else capacity) // length
            full = min(n, count // fit)
            if full:
                filled = items + (length,) * fit
                gaps[capacity - sum(filled)].append((filled, full))
                count -= full * fit
            if full < n and items:
                gaps[gap].append((items, n - full))
            if 0 < count < fit:
                if full < n and items:
                    items, n = gaps[gap].pop()
                    if n > 1:
                        gaps[gap].append((items, n - 1))
                elif items:
                    continue
                filled = items + (length,) * count
                gaps[capacity - sum(filled)].append((filled, 1))
                count = 0
    return [x for g in gaps for x in g]


def plan(histogram: np.ndarray, capacity: int, small_share: float = 0.25, groups: int = 192) -> Runs:
    """Sequences for histogram[length] pieces of each length below capacity."""
    least = int(capacity * small_share) + 1
    grouped = linear_groups(histogram[:capacity], least, groups)
    tokens = sum(x * n for g in grouped for x, n in g)
    while groups < capacity - least and sum((g[0][0] - x) * n for g in grouped for x, n in g) > MOST_ROUNDING * tokens:
        groups *= 2
        grouped = linear_groups(histogram[:capacity], least, groups)
    lengths = {i: int(n) for i, n in enumerate(histogram[:least]) if n}
    runs: Runs = []
    if grouped:
        found = configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity)
        runs, rest = substitute(grouped, [(p, int(x + 1e-7)) for p, x in found if x >= 1 - 1e-7])
        for length, n in rest.items():
            lengths[length] = lengths.get(length, 0) + n
    return best_fit(runs, lengths, capacity)


def slot_table(runs: Runs, first: int) -> dict[str, np.ndarray]:
    """Per length, in order: how many ranks end before each slot's end, the first
    sequence and the place in it.  `ends` is offset by length to search at once."""
    rows = []
    for items, n in runs:
        at = 0
        for length in items:
            rows.append((length, n, first, at))
            at += length
        first += n
    rows.sort(key=lambda r: (r[0], r[2], r[3]))
    length, n, seq, at = (np.array(x, np.int64) for x in (zip(*rows) if rows else ((), (), (), ())))
    total = np.cumsum(n)
    start = total - n
    lead = np.searchsorted(length, length, side="left")
    base = start[lead] if len(start) else start
    return {"length": length, "begin": start - base, "seq": seq, "at": at}


# ---------------------------------------------------------------- on Spark


def pack(pieces: DataFrame, capacity: int = 1024, small_share: float = 0.25, groups: int = 192) -> DataFrame:
    """Add sequence_id and offset to the rows of token_pieces()."""
    rows = written(pieces, "packing")
    # At most `capacity` numbers, then one more per SALT_ROWS pieces.
    sizes = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():
        sizes[r["length"]] = r["count"]
    many = np.maximum(1, -(-sizes // SALT_ROWS))
    salts = F.element_at(F.lit([int(x) for x in many]), (F.col("length") + 1).cast("int"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), salts).cast("int"))
    counts = rows.groupBy("length", "salt").agg(F.count("*").alias("n")).toArrow()
    lead = np.cumsum(many) - many  # where a length's salts begin
    by = np.zeros(int(many.sum()), np.int64)
    by[lead[counts.column("length").to_numpy()] + counts.column("salt").to_numpy()] = counts.column("n").to_numpy()
    table = slot_table(plan(sizes, capacity, small_share, groups), int(sizes[capacity]))
    total = np.cumsum(by) - by
    before = total - np.repeat(total[lead], many)
    shared = rows.sparkSession.sparkContext.broadcast((table, lead, before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, lead, before = shared.value
        key = (table["length"] << 44) + table["begin"]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = before[lead[length] + batch.column("salt").to_numpy()] + batch.column("nth").to_numpy() - 1
            seq, offset = rank.copy(), np.zeros_like(rank)
            cut = length < capacity
            slot = np.searchsorted(key, (length[cut] << 44) + rank[cut], side="right") - 1
            seq[cut] = table["seq"][slot] + rank[cut] - table["begin"][slot]
            offset[cut] = table["at"][slot]
            names = [n for n in batch.schema.names if n not in ("salt", "nth")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(seq), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return rows.withColumn("nth", nth).mapInArrow(run, f"{kinds}, sequence_id long, offset long")
