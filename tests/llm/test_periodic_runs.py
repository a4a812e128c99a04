"""Periodic runs against a search over all periods, and the query's digests."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from plyframe.llm import periodic_runs


def every_run(words, least=12):
    """All maximal runs by trying every period: (start, length, period)."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            s = k
            while k < n - q and words[k] == words[k + q]:
                k += 1
            if k - s + q >= max(least, 2 * q):
                found.setdefault((s, k - s + q), q)
            k += k == s
    return sorted((s, q, length) for (s, length), q in found.items())


def made(rng):
    kind, n = rng.randrange(6), rng.randrange(0, 140)
    if kind < 2:
        return [rng.randrange(2 + kind) for _ in range(n)]
    if kind == 2:
        return ([rng.randrange(4) for _ in range(rng.randrange(1, 20))] * 200)[:n]
    if kind == 3:  # Fibonacci words have most runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 4:  # Thue-Morse words
        w = [0]
        while len(w) < n:
            w += [1 - x for x in w]
        return w[:n]
    w = []
    while len(w) < n:
        w += [rng.randrange(5) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 9)
        if rng.random() < 0.5:
            w += w[-rng.randrange(1, 60) :]  # whole runs are copied
    return w


@pytest.mark.parametrize("seed", range(4))
def test_all_runs_equal_the_search_over_all_periods(seed):
    rng = random.Random(seed)
    texts = [made(rng) for _ in range(200)]
    rows = np.cumsum([0] + [len(t) for t in texts])
    (start, length, period), at = periodic_runs.all_runs(np.array([x for t in texts for x in t], np.int64), rows)
    for k, t in enumerate(texts):
        mine = slice(at[k], at[k + 1])
        assert list(zip(start[mine].tolist(), period[mine].tolist(), length[mine].tolist())) == every_run(t)


def plain(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_run(words)
    top = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else None
    gone = {i for s, q, k in runs for i in range(s + q, s + k)}
    listed = "".join(f"{s},{k},{q}\n" for s, q, k in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), top and top[0], top and top[2], top and top[1], top and 1000 * top[2] // top[1], sha(listed), sha(kept))


def test_query_equals_plain_version(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{x}" for x in made(rng)), "x") for i in range(120)]
    rows += [(None, "a b " * 20, "x"), (500, None, "x"), (501, "", "x"), (502, " \t\n", None), (7, rows[7][1], "again"), (503, "né a   \x85 x\x0by\x1fz " * 9, "x")]
    rows += [(504, " ".join(f"v{i % 700}" for i in range(3000)), "x"), (505, "x y " * 30, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").repartition(3)
    got = periodic_runs.find_runs(docs, change=periodic_runs.repeated).collect()
    assert sorted(map(tuple, got), key=str) == sorted((plain(r[0], r[1]) for r in rows), key=str)


def test_runs_and_collapsed_text_come_out(spark):
    docs = spark.createDataFrame([(1, "so " + "a b c " * 5 + "end")], "doc_id long, text string")
    row = periodic_runs.find_runs(docs, with_runs=True).first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3)] and row.collapsed == "so a b c end"


def test_one_very_long_text(spark):
    text = "again " * 400_000 + "end"  # 2.4 MB of one word
    row = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), with_runs=True).first()
    assert (row.n_runs, row.start, row.length, row.period, row.collapsed) == (1, 0, 400_000, 1, "again end")


def test_empty_table(spark):
    assert periodic_runs.find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
