"""Document fingerprints as invertible Bloom lookup tables of piece digests.

A text is the set of digests of its pieces.  A line break or the end of any
sentence closes one; what is still long is cut after words whose hash meets a
condition (on the text itself, so that an edit moves no border but its own).

A table has three rows of 2 ** bits cells, at least LOAD cells in a row for each
digest of the text; a digest goes to one cell in each row, by other bits of its
own.  A cell holds a count, the xor of the digests and the xor of their checks.
A fingerprint lists the cells of a table that are not empty, so that it can be
peeled to its digests from the string alone.  Tables of two versions meet in the
larger one's width; cells subtract, and what both have cancels out.
Peeling sweeps the rows in turn: a cell with one digest left (count 1 or -1 and
a matching check) gives that digest, which leaves its cells in the other rows.
Empty cells at the end mean that every differing digest was recovered; else
the pair is taken again in tables that are WIDER bits larger, and the few that
still fail are compared exactly.

Likeness is 1 - d / (a + b) for d differing of a and b digests; two texts without
pieces are alike (1).  Only built-in functions are used.  Cells are rows of a
DataFrame: all sums are hash aggregates in the partitioning of the join before
them, so that a text of any length is peeled in linear time, no cell is shuffled,
and aggregates may spill.  What is known of a document rides along as one row.

Null text counts as empty.  The next document is the one with the next smaller
id, after the smallest the largest; null ids come last.  Of rows that repeat
the id, the one with the smallest beginning is the next document; equal rows
have equal results.  Columns other than id and text are not looked at, so their
names can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import text_or_empty

#: Cells in a row for each digest at least, and bits of the narrowest row.
LOAD, LEAST_BITS = 4, 6
#: Sweeps (of one row each), and bits that the second attempt's tables are wider.
SWEEPS, WIDER = 6, 4
#: What ends a sentence before a space, and anywhere; characters from which on a piece
#: is cut by content.
SENTENCE_END, WIDE_END = ".!?…؟।", "。！？"
LONG = 120
#: Words after which a long piece is cut: one in eight or so, by their last two letters.
CUT_WORD = r"(?i) (?<=[aehilo][dgmry] )"
#: Where that leaves a piece long: words cut by their hash, one in EVERY; a word over
#: LONG_WORD characters (as where no spaces are written) after characters, by theirs.
LONG_WORD, EVERY = 40, 8
NO_ID = -(1 << 63)
#: Characters of text that a partition of documents has on average.
PART_CHARS = 4 << 20
#: Ids a task puts in order at once: 2 ** ID_BITS.
ID_BITS = 12



def piece_digests(text: str) -> Column:
    """Distinct 64-bit digests of the pieces of a text (SQL), in a fixed order: every
    sentence end closes one, and pieces of more than LONG characters are cut by
    content, at CUT_WORD and, what is long then, by hashes of words or characters."""
    inside = f"array_join(transform(split(w, ''), c -> if((xxhash64(c) & {2 * EVERY - 1}L) = 0, concat(c, chr(10)), c)), '')"
    word = f"if(char_length(w) > {LONG_WORD}, {inside}, if(w <> '' and (xxhash64(w) & {EVERY - 1}L) = 0, concat(w, chr(10)), w))"
    hashed = f"split(array_join(transform(split(v, ' '), w -> {word}), ' '), concat(chr(10), ' ?'))"
    cut = f"flatten(transform(split(x, r'{CUT_WORD}'), v -> if(char_length(v) <= {LONG}, array(v), {hashed})))"
    for end in SENTENCE_END:
        text = f"replace({text}, '{end} ', '{end}\n')"
    for end in WIDE_END:
        text = f"replace({text}, '{end}', '{end}\n')"
    fine = f"flatten(transform(split({text}, '\n'), x -> if(char_length(x) <= {LONG}, array(x), {cut})))"
    return F.expr(f"array_distinct(transform(filter({fine}, y -> y <> ''), y -> xxhash64(y)))")


# ---------------------------------------------------------------- cells as rows

# A cell's number is kind | bits | row | place.  The kind tells the tables of a
# document apart; row 3 counts the digests that peeling has recovered.
KIND, BITS, ROW, TALLY = 48, 40, 36, 3
CELL = "cell"
#: Tables: of the text, of the edited text; differences to the edited and the next one.
TEXT, EDITED, NEAR_EDITED, NEAR_NEXT = 1, 2, 3, 4


def bits(n: str) -> str:
    """Of a row's cells for n digests: the least power of two of LOAD * n or more."""
    return f"greatest({LEAST_BITS}L, bigint(char_length(bin({LOAD} * {n} - 1))) * int({n} > 0))"


def table(kind: int, width: str) -> str:
    """The part of a cell's number that all cells of a table share."""
    return f"(shiftleft({kind}L, {KIND}) | shiftleft({width}, {BITS}))"


def place(cell: str, row: int, digest: str) -> str:
    """Number of the digest's cell in a row of the table that `cell` belongs to."""
    width = f"int(shiftright({cell}, {BITS}) & 255L)"
    return f"((shiftright({cell}, {BITS}) << {BITS}) | {row << ROW}L | (shiftrightunsigned({digest}, {21 * row}) & (shiftleft(1L, {width}) - 1L)))"


def _summed(rows: DataFrame) -> DataFrame:
    """Equal cells summed; empty ones go."""
    cells = rows.groupBy("x", "nth", "doc", CELL).agg(F.sum("c").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h"))
    return cells.filter("doc is not null or c <> 0 or k <> 0 or h <> 0")


def inserted(docs: DataFrame, doc: Column, tables: list[tuple[str, str, int]]) -> DataFrame:
    """Rows x, nth, doc, cell, c, k, h: the tables (number without row and place;
    digests; sign) of each row, and its row with doc and the cell 0."""
    none = F.lit(None)
    own = F.struct(doc.alias("doc"), F.lit(0).cast("long").alias(CELL), F.array(F.lit(0).cast("long")).alias("k"), F.lit(0).cast("long").alias("c"))
    given = docs.select("x", "nth", own.alias("own"), *[F.struct(F.expr(t).alias(CELL), F.expr(k).alias("k"), F.lit(c).cast("long").alias("c")).alias(f"t{i}") for i, (t, k, c) in enumerate(tables)])
    parts = F.array("own", *[F.struct(none.cast(docs_type(given)).alias("doc"), F.col(f"t{i}.{CELL}"), F.col(f"t{i}.k"), F.col(f"t{i}.c")) for i in range(len(tables))])
    flat = given.select("x", "nth", F.explode(parts).alias("p")).select("x", "nth", "p.doc", f"p.{CELL}", "p.c", F.explode("p.k").alias("k"))
    cells = F.when(F.col("doc").isNotNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*[F.expr(place(CELL, r, "k")) for r in range(3)]))
    return flat.select("x", "nth", "doc", F.explode(cells).alias(CELL), "c", "k", F.hash("k").alias("h"))


def docs_type(given: DataFrame):
    return given.schema["own"].dataType["doc"].dataType


def swept(cells: DataFrame, row: int) -> DataFrame:
    """Take the digests that are alone in a cell of `row` out of their other cells."""
    pure = f"doc is null and (shiftright({CELL}, {ROW}) & 15L) = {row} and abs(c) = 1 and hash(k) = h"
    moved = [F.struct(F.expr(place(CELL, (row + i) % 3, "k")).alias(CELL), (-F.col("c")).alias("c"), F.col("k"), F.col("h")) for i in (1, 2)]
    tally = F.struct(F.expr(f"(shiftright({CELL}, {BITS}) << {BITS}) | {TALLY << ROW}L").alias(CELL), F.lit(1).cast("long").alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("h"))
    same = F.struct(CELL, "c", "k", "h")
    return _summed(cells.select("x", "nth", "doc", F.explode(F.when(F.expr(pure), F.array(*moved, tally)).otherwise(F.array(same))).alias("m")).select("x", "nth", "doc", "m.*"))


def differing(docs: DataFrame, pairs: dict[str, tuple[int, str, str]], more_bits: int, where: dict[str, str]) -> DataFrame:
    """Add to docs (x, nth and doc, a struct with arrays of digests) how many digests
    the two of each pair (kind, a, b) do not share: long columns, null where peeling
    failed or `where` is false."""
    tables = []
    for name, (kind, a, b) in pairs.items():
        wide = table(kind, f"{bits(f'greatest(size({a}), size({b}))')} + {more_bits}L")
        tables += [(wide, f"if({where[name]}, {a}, cast(array() as array<bigint>))", 1), (wide, f"if({where[name]}, {b}, cast(array() as array<bigint>))", -1)]
    cells = _summed(inserted(docs, F.col("doc"), tables))
    for sweep in range(SWEEPS):
        cells = swept(cells, sweep % 3)
    of = lambda kind: f"doc is null and shiftright({CELL}, {KIND}) = {kind}"
    tally = f"(shiftright({CELL}, {ROW}) & 15L) = {TALLY}"
    found = cells.groupBy("x", "nth").agg(
        F.first("doc", ignorenulls=True).alias("doc"),
        *[F.expr(f"if(count_if({of(kind)} and not {tally}) > 0, null, coalesce(sum(c) filter (where {of(kind)} and {tally}), 0L))").alias(name) for name, (kind, _, _) in pairs.items()],
    )
    return found.select("x", "nth", "doc", *[F.when(F.expr(where[name]), F.col(name)).alias(name) for name in pairs])


def next_smaller(ids: DataFrame, low: int, high: int) -> DataFrame:
    """(x, next): for distinct longs x in [low, high] the next smaller one, null for
    the smallest.  Ids are ordered within slices of 2 ** ID_BITS values, the
    slices in the same way, until one slice is left."""
    down = Window.orderBy(F.desc("x"))
    if high - low < 1 << ID_BITS:
        return ids.select("x", F.lead("x").over(down).alias("next"))
    sliced = ids.select("x", F.shiftright("x", ID_BITS).alias("slice"))
    tops = sliced.groupBy("slice").agg(F.max("x").alias("top"))
    slices = next_smaller(tops.select(F.col("slice").alias("x")), low >> ID_BITS, high >> ID_BITS)
    after = slices.join(tops, slices.next == tops.slice).select(slices.x.alias("slice"), "top")
    inside = sliced.withColumn("next", F.lead("x").over(Window.partitionBy("slice").orderBy(F.desc("x"))))
    return inside.join(after, "slice", "left").select("x", F.coalesce("next", "top").alias("next"))


def edited_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: Callable[[str], Column] = piece_digests) -> DataFrame:
    """id, text, digests, edited (the last third replaced by as much of the beginning
    of the next document), and next_digests, the digests of that document; x and
    nth tell the rows apart, and the result is partitioned by x."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("x"), F.monotonically_increasing_id().alias("nth"), text_or_empty(text_col).alias("text"))
    # Both joins below read the same columns of rows, so that Spark shuffles them once.
    rows = rows.withColumn("digests", digests("text"))
    third = F.floor(F.char_length("text") / 3).cast("int")
    ids = rows.groupBy("x").agg(F.max(third).alias("k"), F.sum(F.char_length("text")).alias("chars"))
    low, high, chars = ids.agg(F.min("x"), F.max("x"), F.sum("chars")).first()
    if low is None:
        low, high, chars = 0, 0, 0
    # Cells take several times the text's memory, so partitions go by the text; all that
    # is joined has as many, or Spark would deal the texts once more.
    parts = 1 + chars // PART_CHARS
    rows = rows.repartition(parts, "x")
    follows = next_smaller(ids.select("x"), low, high).select("x", F.coalesce("next", F.lit(high)).alias("next"))
    wanted = follows.join(ids, "x").select(F.col("x").alias("of"), "next", "k").repartition(parts, "next")
    tails = (
        rows.join(wanted, rows.x == wanted.next)
        .select("of", F.struct(F.substring("text", F.lit(1), F.col("k")).alias("tail"), "digests", "nth").alias("t"))
        .repartition(parts, "of")
        .groupBy("of")
        .agg(F.min("t").alias("t"))
    )
    kept = F.substring("text", F.lit(1), F.char_length("text") - third)
    return rows.join(tails, rows.x == tails.of).select(
        "x",
        "nth",
        F.when(F.col("x") != NO_ID, F.col("x")).alias("id"),
        "text",
        "digests",
        F.concat(kept, F.substring(F.col("t.tail"), F.lit(1), third)).alias("edited"),
        F.col("t.digests").alias("next_digests"),
    )


def fingerprint(cells: str, n: str) -> str:
    """Bits of a row, `|`, and the cells: place in the table:count:digests:checks in
    hex, in order of place."""
    return f"concat({bits(n)}, '|', array_join({cells}.shown, ','))"


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: Callable[[str], Column] = piece_digests) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and both likenesses."""
    texts = edited_texts(docs, id_col, text_col, digests)
    sets = texts.select(
        "x",
        "nth",
        F.struct(
            "id",
            F.char_length("text").cast("long").alias("n_chars"),
            F.sha2("edited", 256).alias("edited_sha256"),
            F.col("digests").alias("a"),
            digests("edited").alias("e"),
            F.col("next_digests").alias("z"),
        ).alias("doc"),
    )
    cells = _summed(inserted(sets, F.col("doc"), [(table(TEXT, bits("size(doc.a)")), "doc.a", 1), (table(EDITED, bits("size(doc.e)")), "doc.e", 1)]))
    at = f"(shiftleft(shiftright({CELL}, {ROW}) & 15L, int(shiftright({CELL}, {BITS}) & 255L)) | ({CELL} & {(1 << ROW) - 1}L))"
    shown = F.struct(F.col(CELL), F.expr(f"concat_ws(':', hex({at}), c, hex(k), hex(h & 4294967295L))").alias("shown"))
    listed = cells.select("x", "nth", "doc", F.expr(f"shiftright({CELL}, {KIND})").alias("kind"), F.when(F.col("doc").isNull(), shown).alias("s"))
    by_doc = listed.groupBy("x", "nth").agg(
        F.first("doc", ignorenulls=True).alias("d"),
        *[F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("s")))).alias(name) for kind, name in ((TEXT, "text_cells"), (EDITED, "edited_cells"))],
    )
    doc = by_doc.select("x", "nth", F.struct("d.*", F.expr(fingerprint("text_cells", "size(d.a)")).alias("fingerprint"), F.expr(fingerprint("edited_cells", "size(d.e)")).alias("edited_fingerprint")).alias("doc"))
    pairs = {"d_edited": (NEAR_EDITED, "doc.a", "doc.e"), "d_next": (NEAR_NEXT, "doc.a", "doc.z")}
    once = differing(doc, pairs, 0, dict.fromkeys(pairs, "true"))
    kept = once.select("x", "nth", F.struct("doc.*", *pairs).alias("doc"))
    again = differing(kept, pairs, WIDER, {name: f"doc.{name} is null" for name in pairs})

    def likeness(name: str) -> Column:
        _, a, b = pairs[name]
        exact = f"size(array_except({a}, {b})) + size(array_except({b}, {a}))"
        return F.expr(f"if(size({a}) + size({b}) = 0, 1.0D, 1.0D - coalesce(doc.{name}, {name}, {exact}) / (size({a}) + size({b})))")

    shown = [F.col(f"doc.{c}").alias(c) for c in ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint")]
    return again.select(*shown, likeness("d_edited").alias("near_edited"), likeness("d_next").alias("near_next"))
