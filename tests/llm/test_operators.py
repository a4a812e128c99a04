"""Each operator against brute force, on a table of awkward rows and on a sample."""

import base64
import hashlib
import io
import itertools
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.llm import exact_dedup, iblt, jaccard_join, language_id, line_dedup, mixing, packing, substring_dedup, toxicity, warc
from plyframe.llm._shared import WHITE

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, carry string, id int, `rep.x` string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choices(string.ascii_lowercase, k=RNG.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


LONG = prose(6000, 1)
PASSAGE = prose(60, 2)
ROWS = [
    (1, "Hello world", "en", "a", "c", 1, "x"),
    (2, "Hello  world\n", "en", "b", None, 2, "x"),
    (2, "Hello  world\n", "en", "b", None, 2, "x"),
    (3, None, None, None, None, None, None),
    (4, "", "en", "a", "c", 4, "y"),
    (None, "no id here " + PASSAGE, "en", "a", "c", 5, "y"),
    (5, LONG, "en", "big", "c", 6, "y"),
    (6, LONG.replace(LONG.split()[700], "changed", 1), "en", "big", "c", 6, "y"),
    (7, " \t\n", "en", "a", "c", 7, "y"),
    (8, "éü 漢字 <|endoftext|>  two  blanks", "fr", "c", "c", 8, "y"),
    (9, prose(80, 3) + " " + PASSAGE + " " + prose(40, 4), "en", "a", "c", 9, "y"),
    (10, "12345 %%%", "en", "a", "c", 9, "y"),
] + [(100 + i, "the very same text of copies", "en", "hot", "c", i, "z") for i in range(30)] + [(200 + i, "a line that is long enough to count\nown %d\n  A LINE that is long enough to count " % i, "en", "hot", "c", i, "z") for i in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def norm(text):
    return (text or "").translate({ord(c): None for c in WHITE})


# ------------------------------------------------------------------ 1


def test_exact_groups(docs, none):
    got = exact_dedup.exact_groups(docs).collect()
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append(r)
    assert len(got) == len(ROWS)
    for r in got:
        mine = next(g for k, g in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        best = min(mine, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r.keep_id, r.group_size) == (best[0], len(mine))
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_trie_spills_by_subtree():
    rng = random.Random(1)
    keys = [bytes(rng.choices(b"ab", k=rng.randint(0, 12))) * rng.randint(1, 3) for _ in range(3000)]
    owner = exact_dedup._Owner(20_000)
    for i, k in enumerate(keys):
        owner.add(k, (len(k), i, i), 1, [i])
    assert owner.spilled
    seen = {k: item for k, item in owner.groups()}
    assert set(seen) == set(keys)
    for k, (best, count, members) in seen.items():
        assert count == keys.count(k) == len(members) and best[1] == keys.index(k)


# ------------------------------------------------------------------ 2


def test_language_shares_and_accuracy(sample, docs, none):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.train(sample, ~held)
    got = language_id.identify(sample, model).select("carry.doc_id", "carry.lang", "lang_pred", "score").filter(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    texts = {r.lang: r.text for r in sample.filter("length(text) > 3000").collect()}
    two = sample.sparkSession.createDataFrame([(1, texts["en"][:1500] + " " + texts["fr"][:1500])], "doc_id long, text string")
    share = language_id.identify(two, model).first().shares
    assert set(share) >= {"en", "fr"} and min(share["en"], share["fr"]) > 0.3
    odd = language_id.identify(docs, model).select("carry.*", "lang_pred", "score").collect()
    assert len(odd) == len(ROWS)
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in odd)
    assert language_id.identify(none, model).count() == 0
    assert language_id.train(none, F.lit(True)).languages == []
    assert language_id.keep_identified(docs, model, min_score=0.0).columns == docs.columns


# ------------------------------------------------------------------ 3


def test_packing(docs, none):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_paths()[0])
    pieces = packing.pack(packing.token_pieces(docs, with_ids=True)).collect()
    by_text = {}
    for r in pieces:
        by_text.setdefault(r.id, []).append(r)
    for doc, text, *_ in ROWS:
        ids = exact.encode(text or "", add_special_tokens=False).ids + [2]
        if doc is not None and sum(x[0] == doc for x in ROWS) == 1:
            own = sorted(by_text[doc], key=lambda r: r.piece)
            assert [t for r in own for t in r.ids] == ids
            assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own[:-1]]))
    seqs = {}
    for r in pieces:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.token_pieces(none)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_keeps_every_piece(seed):
    rng = np.random.default_rng(seed)
    histogram = np.bincount(rng.integers(1, 256, rng.integers(1, 4000)), minlength=257)
    runs = packing.plan(histogram[:256], 256, groups=12)
    back = np.zeros(256, int)
    for items, n in runs:
        assert sum(items) <= 256
        for x in items:
            back[x] += n
    assert (back == histogram[:256]).all()
    total = int((histogram * np.arange(257)).sum())
    assert sum(n for _, n in runs) <= 1.1 * total / 256 + 2


def test_token_library_agreement():
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_paths()[0])
    encode = packing.encoder(*packing.tokenizer_paths())
    for text in ["", " ", "a  b", "\n\n x\t\ty ", "It's 3 o'clock  now", "<|endoftext|>", "漢字 😀 é", "x" * 3000]:
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()]
    for text, want in zip(texts, exact.encode_batch(texts, add_special_tokens=False)):
        assert encode(text) == want.ids


# ------------------------------------------------------------------ 4


def test_toxicity_held_out(spark, docs, none):
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    languages = language_id.train(big, ~held)
    model = toxicity.train(big, labels, ~held, languages)
    got = toxicity.score(big, model, languages).withColumnRenamed("id", "doc_id").join(labels, "doc_id").filter(held).select("score", "toxic").toPandas()
    hit = ((got.score >= 0.5) & (got.toxic == 1)).sum()
    assert hit / (got.toxic == 1).sum() > 0.7 and hit / (got.score >= 0.5).sum() > 0.85
    odd = toxicity.score(docs, model, languages).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(none, model, languages).count() == 0
    assert toxicity.train(none, labels.limit(0), F.lit(True), languages) is None
    assert {r.score for r in toxicity.score(docs, None, languages).collect()} == {0.0}


# ------------------------------------------------------------------ 5


def near_truth(rows, n=5, threshold=0.8):
    cut = re.compile(r"[\x09-\x0D\x20!-/:-@\[-`{-~]+")
    grams = []
    for _, text in rows:
        w = cut.sub(" ", (text or "").lower()).strip().split(" ")
        grams.append(frozenset() if w == [""] else frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))))
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if grams[i] and grams[j] and len(grams[i] & grams[j]) >= threshold * len(grams[i] | grams[j]):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    parts = {}
    for i in range(len(rows)):
        parts.setdefault(find(i), []).append(rows[i][0])
    return links, [min((x for x in parts[find(i)] if x is not None), default=None) for i in range(len(rows))]


def test_near_groups(spark, docs, none, sample):
    base = prose(300, 9)
    near = [(1000 + k, " ".join(w if i != 7 * k else "other%d" % k for i, w in enumerate(base.split()))) for k in range(25)]
    rows = [(r[0], r[1]) for r in ROWS] + near + [(r.doc_id, r.text) for r in sample.limit(60).collect() if r.doc_id > 300 or True][:60]
    rows = [(i if i is None else i + 10_000 * (k >= len(ROWS) + 25), t) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links, groups = near_truth(rows)
    want = sorted((repr(i), l, repr(g)) for (i, _), l, g in zip(rows, links, groups))
    for block in (512, 8):
        got = sorted((repr(r.id), r.n_links, repr(r.group_id)) for r in jaccard_join.near_groups(df, block=block).collect())
        assert got == want
    assert jaccard_join.near_groups(none).count() == 0
    kept = jaccard_join.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    stay = {norm(r.text): 1 for r in kept.collect()}
    assert len([r for r in kept.collect() if r.source == "hot" and r.text.startswith("the very")]) == 1 and norm("") in stay


def test_forest_depth_reaches_recall():
    d = jaccard_join.forest_depth(0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** jaccard_join.TREES >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** jaccard_join.TREES


# ------------------------------------------------------------------ 6


def test_mixing(docs, none):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(ROWS)
    sources = sorted({r.source for r in got if r.source is not None}) + [None]
    size = {s: sum(r.size for r in got if r.source == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:
        level = (sum(size.values()) - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level >= 3 * size[s]}
        target |= {s: 3.0 * size[s] for s in over} if over else {s: weight[s] * level for s in open_}
        open_ = open_ - over if over else set()
    for s in sources:
        assert next(r.target for r in got if r.source == s) == pytest.approx(target[s])
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= 3
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert sorted(map(repr, mixing.mix_counts(docs).collect())) == sorted(map(repr, got))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert abs(mixed.select(F.sum(mixing.n_words(F.coalesce("text", F.lit(""))))).first()[0] - sum(r.taken for r in got)) <= 3
    assert mixing.mix_counts(none).count() == 0 and mixing.mix(none).count() == 0


# ------------------------------------------------------------------ 7


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "", None, "<p>same</p>", "<p>same</p>", "<p>same</p>", "x" * 300_000, "é" * 10, "\x1f\x8b\x08 WARC/1.1 \r\n\r\n"]
    pages = spark.createDataFrame([(i, f"http://e/{i}\n", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    archives = warc.write_archives(pages)
    for split in (997, 16 << 20):
        got = {r.page_id: r for r in warc.page_records(warc.read_archives(archives, split_bytes=split)).collect()}
        assert len(got) == len(html)
        for i, h in enumerate(html):
            body = (h or "").encode()
            top = max(k for k, x in enumerate(html) if (x or "") == (h or ""))
            r = got[i]
            assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
            assert (r.record_type, r.refers_to) == (("response", None) if i == top else ("revisit", top))
    texts = {r.path: 1 for r in archives.collect()}
    assert len(texts) >= 1
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_records(warc.read_archives(warc.write_archives(empty))).count() == 0


def test_every_split_finds_each_record_once():
    data, at = b"", []
    rng = random.Random(2)
    for i in range(60):
        at.append(len(data))
        data += warc.record_bytes("response", str(i), "u", bytes(rng.choices(b"\x1f\x8b\x08abc", k=rng.randint(0, 900))), "D", 0, None)
    for split in (1, 7, 100, 1000, len(data)):
        got = [p for s in range(0, len(data), split) for p, _ in warc.records_in_range(io.BytesIO(data), s, min(s + split, len(data)))]
        assert got == at


# ------------------------------------------------------------------ 8


def test_fingerprints(spark, docs, none):
    rows = sorted({r[0]: r[1] or "" for r in ROWS if r[0] is not None}.items(), reverse=True)
    df = spark.createDataFrame([(i, t or None) for i, t in rows], "doc_id long, text string")
    got = {r.id: r for r in iblt.fingerprints(df).collect()}
    third_of = lambda k: rows[k][1][: len(rows[k][1]) - len(rows[k][1]) // 3] + rows[(k + 1) % len(rows)][1][: len(rows[k][1]) // 3]
    texts = spark.createDataFrame([(k, t, third_of(k)) for k, (_, t) in enumerate(rows)], "k int, own string, edited string")
    of = {r.k: (set(r.a), set(r.b)) for r in texts.select("k", iblt.piece_digests("own").alias("a"), iblt.piece_digests("edited").alias("b")).collect()}
    like = lambda a, b: 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(like(*of[k])) and got[i].near_next == pytest.approx(like(of[k][0], of[(k + 1) % len(rows)][0]))
    assert len({r.fingerprint for i, r in got.items() if 100 <= i < 130}) == 1
    assert iblt.fingerprints(docs).count() == len(ROWS)
    assert iblt.fingerprints(none).count() == 0


def test_sparse_ids_follow_each_other(spark):
    ids = [-(1 << 62), -5, 0, 1, 4095, 4096, 1 << 40, (1 << 62) + 1]
    df = spark.createDataFrame([(i,) for i in ids], "x long")
    got = dict(iblt.next_smaller(df, ids[0], ids[-1]).collect())
    assert got == {x: (ids[k - 1] if k else None) for k, x in enumerate(ids)}


# ------------------------------------------------------------------ 9


def test_line_dedup(docs, none):
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(ROWS)
    key = lambda x: x.strip(WHITE).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    holders = {}
    for doc, text, *_ in ROWS:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(-1 if doc is None else doc)
    want = []
    for doc, text, *_ in ROWS:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == (-1 if doc is None else doc)]
        want.append((repr(doc), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted((repr(r.id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == sorted(want)
    assert line_dedup.dedup_lines(none).count() == 0
    assert np.array_equal(line_dedup.read_bitmap(None, 3), [True] * 3)


# ------------------------------------------------------------------ 10


def test_substring_dedup(spark, docs, none):
    clean = [(500 + i, prose(150, 1000 + i)) for i in range(40)]
    planted = [(600 + i, prose(30 + i, 2000 + i) + " " + PASSAGE + " " + prose(20, 3000 + i)) for i in range(40)]
    periodic = [(700, "thly " * 80), (701, "x " + "thly " * 70)]
    df = spark.createDataFrame(clean + planted + periodic, "doc_id long, text string")
    found = substring_dedup.repeated_passages(df).collect()
    assert {r.doc for r in found} == {i for i, _ in planted + periodic}
    texts = dict(clean + planted + periodic)
    for r in found:
        if r.doc < 700:
            # Neighbouring chunks may be repeated by chance (two words of few).
            assert PASSAGE[100:-100] in texts[r.doc].encode()[r.start : r.end].decode()
    cut = {r.doc_id: r.text for r in substring_dedup.cut_repeats(df).collect()}
    assert all(cut[i] == t for i, t in clean) and cut[600] == texts[600] and len(cut[610]) < len(texts[610]) - 100
    assert substring_dedup.cut_repeats(docs).columns == docs.columns and substring_dedup.cut_repeats(docs).count() == len(ROWS)
    assert substring_dedup.repeated_passages(none).count() == 0


def test_chunks_cover_texts():
    texts = [b"", b"a", LONG.encode(), b"ab" * 500, "é".encode() * 77]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    row, start, end = substring_dedup.chunk_spans(data, offsets)
    for i, t in enumerate(texts):
        assert b"".join(data[a:b].tobytes() for a, b in zip(start[row == i], end[row == i])) == t
