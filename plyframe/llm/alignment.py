"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers encode a blank and the text.  Neither has a token that reaches
over a blank between two words, so a text's tokens are those of its *chunks* (a
blank and what follows up to the next lone blank) in a row, and every chunk's
end is an end of both tokenizers.  A distinct chunk is therefore encoded and
aligned once for the whole corpus, and a document is a list of chunk codes of
its block of documents.  (With a vocabulary that breaks this rule the whole text
is one chunk.)  The alignment is relational, on rows of tokens:

1. tokens are posexploded, and a running sum of their byte lengths gives ends;
2. A's and B's tokens meet in equi-joins on chunk and end (from either side, so
   that ends of one side stay);
3. ends of both sides cut; the running count of the cuts before a token is its
   group's number;
4. a group's rows give its text form, its cut row is its link: the pair of
   tokens whose byte ranges end together.

Counts of id pairs come from links weighted by their chunk's number of
occurrences, so hot chunks are one row each before any shuffle.  Block
dictionaries meet the aligned chunks by a join on the chunk; a chunk is there
once per block at most, so that no key is hot.  A block holds about
`block_bytes` of text (or one longer text), which bounds what one row gathers.

Null and empty texts, and texts whose tokens do not give their bytes back, have
no tokens: zeros and an empty `groups_sha256`.  Their chunks count for no pair.
Null and repeated ids and equal rows are kept row by row.  A very long text is a
block of its own, gathered in one row.  Ties (several A ids that share a B id's highest count) all
count as best.  Columns other than id and text are not looked at, so their names
can't clash.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import dropped, removed, shared_path, slices, text_or_empty, written

#: Bytes of text in a block of documents.
BLOCK_BYTES = 8 << 20
#: Blocks that one task gathers at the end, on average.
BLOCKS_PER_TASK = 1
#: Pairs of ids up to which their counts are sent to every executor.
BROADCAST_PAIRS = 500_000


@dataclass(frozen=True)
class Tokenizers:
    """Where the two vocabularies are: A as ranks with its pattern, B as a piece model."""

    ranks_path: str
    pattern: str
    model_path: str


def public_pair() -> Tokenizers:
    import public_tokenizers

    return Tokenizers(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


@functools.cache
def encoders(names: Tokenizers):
    """(encode A, bytes of A's ids, encode B, bytes of B's ids, may texts be cut at blanks)."""
    import sentencepiece
    import tiktoken

    with open(names.ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("aligned", pat_str=names.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    a_bytes = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        a_bytes[i] = token
    pieces = sentencepiece.SentencePieceProcessor(model_file=names.model_path)
    b_bytes, apart = [], True
    for i in range(pieces.get_piece_size()):
        piece = pieces.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else piece.replace("▁", " ").encode())
        apart = apart and "▁" not in piece.lstrip("▁")
    return (
        lambda texts: [plain(" " + t) for t in texts],
        a_bytes,
        lambda texts: pieces.encode(texts, num_threads=1),
        b_bytes,
        apart,
    )


_uneven = re.compile(r"\s\s|^\s|\s$").search
_lone_blank = re.compile(r"(?<=\S) (?=\S)").split


def chunks(text: str) -> list[str]:
    """The text cut at blanks that stand alone between other characters."""
    if not text:
        return []
    return _lone_blank(text) if _uneven(text) else text.split(" ")


def blocks(docs: DataFrame, names: Tokenizers, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """Rows (block, id, low, high) of documents, with the halves of their codes, and (block,
    words, counts) of block dictionaries; `kind` is 'texts' or 'words'."""
    names_of = ["block", "id", "low", "high", "words", "counts", "kind"]
    shorts = lambda x: pa.array(x.astype(np.uint16).view(np.int16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = encoders(names)[4]
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in slices(whole, "text", block_bytes):
                n, found, parts = batch.num_rows, [], [pa.array([], pa.string())]
                for part in slices(batch, "text"):  # chunks are Python strings for a part only
                    split = [chunks(t) if apart or not t else [t] for t in part.column("text").to_pylist()]
                    found += map(len, split)
                    parts.append(pa.array([w for s in split for w in s], pa.string()))
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum(found, out=offsets[1:])
                offsets = pa.array(offsets)
                coded = pa.concat_arrays(parts).dictionary_encode()
                codes = coded.indices.to_numpy()
                counts = np.bincount(codes, minlength=len(coded.dictionary))
                size = len(coded.dictionary)
                one = np.array([0, size], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), batch.column("id"), *[pa.ListArray.from_arrays(offsets, shorts(x)) for x in (codes & 0xFFFF, codes >> 16)], pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64())), pa.array(["texts"] * n)],
                    names=names_of,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.list_(pa.int16()))] * 2, pa.ListArray.from_arrays(pa.array(one), coded.dictionary), pa.ListArray.from_arrays(pa.array(one), pa.array(counts, pa.int64())), pa.array(["words"])],
                    names=names_of,
                )
                block += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "block long, id long, low array<short>, high array<short>, words array<string>, counts array<long>, kind string")


def codes_of(low: Column, high: Column) -> Column:
    """The codes whose halves these are: halves take less of a shuffle than whole codes."""
    return F.zip_with(low, high, lambda a, b: F.shiftleft(b.cast("int"), 16).bitwiseOR(a.cast("int").bitwiseAND(0xFFFF)))


def encode(words: DataFrame, names: Tokenizers) -> DataFrame:
    """Add to rows (word, n) the ids and byte lengths of both tokenizers; `ok`
    says that both give the chunk's bytes back (else the lists are empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, a_bytes, encode_b, b_bytes, _ = encoders(names)
        sizes = [np.array([len(x) for x in table], np.int32) for table in (a_bytes, b_bytes)]
        for batch in batches:
            texts = batch.column("word").to_pylist()
            if not texts:
                continue
            sides = [encode_a(texts), encode_b(texts)]
            ok = []
            for i, text in enumerate(texts):
                raw = b" " + text.encode()
                good = b"".join([a_bytes[x] for x in sides[0][i]]) == raw and b"".join([b_bytes[x] for x in sides[1][i]]) == raw
                ok.append(good)
                if not good:
                    sides[0][i] = sides[1][i] = []
            columns = []
            for ids, size in zip(sides, sizes, strict=True):
                at = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=at[1:])
                flat = np.array([x for row in ids for x in row], np.int32)
                columns += [pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.ListArray.from_arrays(pa.array(at), pa.array(size[flat]))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(ok), *columns], names=["word", "n", "ok", "a", "a_len", "b", "b_len"])

    return words.mapInArrow(run, "word string, n long, ok boolean, a array<int>, a_len array<int>, b array<int>, b_len array<int>")


def token_ends(encoded: DataFrame, side: str) -> DataFrame:
    """One row per token: (key, end, id), `end` in bytes from the chunk's start."""
    rows = encoded.select("key", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_len").alias("length"))).alias("pos", "t"))
    running = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("key", F.sum("t.length").over(running).alias("end"), F.col("t.id").alias(side))


def groups(encoded: DataFrame, side: str) -> DataFrame:
    """One row per token of `side`: (key, end, id, other, group_id); `other` is the
    other tokenizer's token that ends there too, or null."""
    other = "b" if side == "a" else "a"
    met = token_ends(encoded, side).join(token_ends(encoded, other), ["key", "end"], "left")
    before = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cuts = F.sum(F.col(other).isNotNull().cast("int")).over(before)
    return met.select("key", "end", F.col(side).alias("id"), F.col(other).alias("other"), F.coalesce(cuts, F.lit(0)).alias("group_id"))


def links(encoded: DataFrame, how: str = "end") -> DataFrame:
    """Pairs (key, group_id, a, b) of token occurrences: those that end together,
    or with how='group' all A-B pairs of a group (an equi-join on the group)."""
    if how == "end":
        return groups(encoded, "a").filter(F.col("other").isNotNull()).select("key", "group_id", F.col("id").alias("a"), F.col("other").alias("b"))
    sides = [groups(encoded, s).select("key", "group_id", F.col("end").alias(f"{s}_end"), F.col("id").alias(s)) for s in "ab"]
    return sides[0].join(sides[1], ["key", "group_id"])


def aligned(encoded: DataFrame) -> DataFrame:
    """One row per chunk with tokens: (key, groups, links); groups as text
    `a1,a2|b1;a3|b2,b3`, links as an array of (a, b)."""
    tokens = lambda mark: F.collect_list(F.struct("group_id", F.lit(mark).alias("side"), "end", "id"))
    pair = F.struct(F.col("id").alias("a"), F.col("other").alias("b"))
    a = groups(encoded, "a").groupBy("key").agg(tokens(0).alias("x"), F.collect_list(F.when(F.col("other").isNotNull(), pair)).alias("links"))
    b = groups(encoded, "b").groupBy("key").agg(tokens(1).alias("y"))
    rows = a.join(b, "key").select("key", F.array_sort(F.concat("x", "y")).alias("x"), "links")

    def joined(x: Column) -> Column:
        def part(e: Column, i: Column) -> Column:
            last = F.get(x, i - 1)
            lead = F.when(i == 0, "").when(e["group_id"] != last["group_id"], ";").when(e["side"] != last["side"], "|").otherwise(",")
            return F.concat(lead, e["id"].cast("string"))

        return F.array_join(F.transform(x, part), "")

    return rows.select("key", joined(F.col("x")).alias("groups"), "links")


@contextmanager
def _plans_that_keep_partitions(spark: SparkSession) -> Iterator[None]:
    """Rows dealt by chunk stay where they are in a join on chunk and end, and
    shuffle files go when the written result is there."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _without_bad(words: DataFrame, entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Take the occurrences in texts that have no tokens out of the counts."""
    bad = words.filter(~F.col("ok")).select("word")
    codes = entries.join(bad, "word").groupBy("block").agg(F.collect_list("code").alias("bad"))
    gone = docs.join(codes, "block").filter(F.arrays_overlap("codes", "bad")).select("block", F.explode("codes").alias("code"))
    less = gone.groupBy("block", "code").count().join(entries, ["block", "code"]).groupBy("word").agg(F.sum("count").alias("less"))
    return words.join(less, "word", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")


def pair_counts(chunk_links: DataFrame) -> DataFrame:
    """(a, b, count, best) from rows (links, n): how many links hold the pair, and
    whether no other A id is linked to that B id more often."""
    found = chunk_links.select("n", F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    top = found.groupBy("b").agg(F.max("count").alias("top"))
    return found.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def _tables(docs: DataFrame, names: Tokenizers, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Texts (block, id, low, high) and entries (block, code, mark, count_sum, groups),
    what a chunk adds to a text: mark is n_a and n_best in the halves of a long, and null
    where it makes the text have no tokens."""
    spark = docs.sparkSession
    folder, both = shared_path(spark, "alignment-blocks"), blocks(docs, names, id_col, text_col, block_bytes)
    # In two folders: the dictionaries go before the texts are shuffled.
    both.write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    kept = spark.read.schema(both.schema).parquet(folder)
    texts = kept.filter(F.col("kind") == "texts").select("block", "id", "low", "high")
    dictionaries = kept.filter(F.col("kind") == "words").select("block", "words", "counts")
    entries = dictionaries.select("block", F.posexplode("words").alias("code", "word"))
    counted = dictionaries.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n")))).groupBy("word").agg(F.sum("n").alias("n"))
    words = written(encode(counted, names).withColumn("key", F.monotonically_increasing_id()), "alignment-words")
    # Dealt by chunk once, as arrays: windows, joins and groups keep that partitioning.
    dealt = words.repartition("key")
    sized = dealt.select("key", "word", "n", "ok", F.size("a").alias("n_a"))
    found = written(sized.join(aligned(dealt), "key", "left").drop("key"), "alignment-forms")
    dropped(words)
    forms = found if found.filter(~F.col("ok")).isEmpty() else _without_bad(found, entries, texts.select("block", codes_of(F.col("low"), F.col("high")).alias("codes")))
    pairs = written(pair_counts(forms.filter(F.size("links") > 0).select("n", "links")), "alignment-pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        pairs = F.broadcast(pairs)
    linked = found.select("*", F.inline_outer("links")).drop("links").join(pairs, ["a", "b"], "left")
    best = F.coalesce(F.sum(F.col("best").cast("int")), F.lit(0))
    facts = linked.groupBy("word").agg(
        F.first(F.when(F.col("ok"), F.col("n_a"))).alias("n_a"),
        F.first("groups").alias("groups"),
        best.alias("n_best"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("count_sum"),
    )
    # A text has fewer than 2^31 tokens, so sums of marks are marks of sums.
    mark = F.shiftleft(F.col("n_a").cast("long"), 32) + F.col("n_best")
    facts = facts.select("word", mark.alias("mark"), "count_sum", "groups")
    entry = written(entries.join(facts, "word").select("block", "code", "mark", "count_sum", "groups"), "alignment-entries")
    dropped(found)
    removed(spark, f"{folder}/kind=words")
    return texts, entry


def align(docs: DataFrame, names: Tokenizers | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, with_groups: bool = False) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256 (and with `with_groups` the text form itself)."""
    names = names or public_pair()
    with _plans_that_keep_partitions(docs.sparkSession):
        texts, entry = _tables(docs, names, id_col, text_col, block_bytes)
    together = entry.unionByName(texts.select("block", F.lit(-1).alias("code"), F.struct("id", "low", "high").alias("doc")), allowMissingColumns=True)
    n_blocks = texts.agg(F.count_distinct("block")).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // BLOCKS_PER_TASK))
    whole = together.repartition(tasks, "block").sortWithinPartitions("block", "code").groupBy("block").agg(F.collect_list("doc").alias("docs"), F.array_sort(F.collect_list(F.when(F.col("code") >= 0, F.struct("code", "mark", "count_sum", "groups")))).alias("entries"))
    whole = whole.select("entries", F.transform("docs", lambda d: F.struct(d["id"].alias("id"), codes_of(d["low"], d["high"]).alias("codes"))).alias("docs"))

    def facts_of(d: Column) -> Column:
        of = lambda c: F.get(F.col("entries"), c)
        total = lambda name: F.aggregate(d["codes"], F.lit(0).cast("long"), lambda s, c: s + of(c)[name])
        form = F.array_join(F.transform(d["codes"], lambda c: of(c)["groups"]), ";")
        return F.struct(d["id"].alias("id"), total("mark").alias("mark"), total("count_sum").alias("count_sum"), form.alias("form"))

    good = F.col("n_a") > 0
    rows = whole.select(F.inline(F.transform("docs", facts_of))).withColumns({"n_a": F.shiftright("mark", 32), "n_best": F.col("mark").bitwiseAND((1 << 32) - 1)})
    rows = rows.select("id", *[F.when(good, F.col(c)).otherwise(0).alias(c) for c in ("n_a", "n_best", "count_sum")], F.when(good, F.col("form")).otherwise("").alias("form"))
    # The form has a `|` a group, and a `,` between tokens of one side of a group.
    signs = lambda sign: F.length("form") - F.length(F.replace("form", F.lit(sign)))
    rows = rows.withColumn("n_groups", signs("|").cast("long")).withColumn("n_b", (signs(",") + 2 * F.col("n_groups") - F.col("n_a")).cast("long"))
    hashed = F.when(F.col("form") == "", "").otherwise(F.sha2("form", 256))
    columns = ["id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", hashed.alias("groups_sha256")]
    return rows.select(*columns, *([F.col("form").alias("groups")] if with_groups else []))
