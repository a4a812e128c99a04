"""Alignment of two tokenizers against a plain version over whole texts."""

import hashlib
from bisect import bisect_right
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plyframe.llm import alignment

ROWS = [
    (1, "The quick brown fox, it's said, jumps over the lazy dog."),
    (2, "The quick  brown fox \n\n jumps\tover tokenization, tokenization."),
    (3, "Über die Straße läuft ein Hund; élève, niño."),
    (4, "日本語 テキスト 🎉🎉 ok"),
    (5, "<|endoftext|> the <s> </s> <0x41>"),
    (6, "the a▁b quick"),
    (6, "the a▁b quick"),
    (7, None),
    (8, ""),
    (9, " "),
    (10, " leading and trailing "),
    (11, "x y　z \x85 w ​ \x00 \x1f end"),
    (12, "The quick brown fox, it's said, jumps over the lazy dog."),
    (None, "no id, the same the"),
]


def plain_tokens():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def both(text):
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)]
        parts = [bytes(back[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            return ([], []), ([], [])
        ends = []
        for p in parts:
            at, mine = 0, []
            for x in p:
                at += len(x)
                mine.append(at)
            ends.append(mine)
        return ids, ends

    return both


def plain(rows):
    both, docs = plain_tokens(), []
    for doc, text in rows:
        (a, b), (ea, eb) = both(text or "")
        cuts = sorted(set(ea) & set(eb))
        of = dict(zip(ea, a)), dict(zip(eb, b))
        form = [",".join(map(str, a[bisect_right(ea, lo) : bisect_right(ea, hi)])) + "|" + ",".join(map(str, b[bisect_right(eb, lo) : bisect_right(eb, hi)])) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((doc, len(a), len(b), [(of[0][c], of[1][c]) for c in cuts], ";".join(form)))
    count = Counter(pair for d in docs for pair in d[3])
    top = {}
    for (_, y), n in count.items():
        top[y] = max(n, top.get(y, 0))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest() if x else ""
    return [(d, na, nb, len(p), len(p), sum(count[x] == top[x[1]] for x in p), sum(count[x] for x in p), sha(form)) for d, na, nb, p, form in docs]


@pytest.mark.parametrize("block_bytes", [1, 1 << 21])
def test_align_equals_plain_version(spark, block_bytes):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"block": F.lit(3), "key": F.lit("x"), "id": F.lit(1)}).repartition(3)
    got = alignment.align(docs, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(ROWS), key=str)


def test_shuffled_pair_counts_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", 0)
    got = alignment.align(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(ROWS), key=str)


def test_groups_and_links_of_the_tables(spark):
    rows = spark.createDataFrame([("tokenization", 1)], "word string, n long")
    encoded = alignment.encode(rows, alignment.public_pair()).withColumn("key", F.lit(0).cast("long"))
    form = alignment.aligned(encoded).first()
    assert [tuple(x) for x in form.links] == [(r.a, r.b) for r in alignment.links(encoded).orderBy("group_id").collect()]
    inside = {(a, b) for part in form.groups.split(";") for a in part.split("|")[0].split(",") for b in part.split("|")[1].split(",")}
    assert {(str(r.a), str(r.b)) for r in alignment.links(encoded, "group").collect()} == inside


def test_one_long_text_without_blanks_and_an_empty_table(spark):
    text = "word" * 30_000 + " " + "a b " * 100_000
    rows = [(1, text)]
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), with_groups=True).first()
    assert got.n_groups == got.groups.count(";") + 1 and hashlib.sha256(got.groups.encode()).hexdigest() == got.groups_sha256
    assert (got.n_a, got.n_b) == tuple(len(x) for x in plain_tokens()(text)[0])
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
