"""Chunks of substring deduplication end between characters, so that no cut loses one."""

import random

import numpy as np
import pytest

from plyframe.llm import substring_dedup

LETTERS = {"cyrillic": "абвгдежзийклмнопрст", "cjk": "日本語学校先生時間会社電車", "mixed": "aé日🎉ö中bñ🙂"}


def prose(letters, rng, words):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(words))


@pytest.mark.parametrize("script", LETTERS)
def test_every_chunk_is_whole_characters(script):
    rng = random.Random(1)
    texts = [prose(LETTERS[script], rng, n).encode() for n in (0, 1, 40, 400, 3)]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    data = b"".join(texts)
    row, start, end = substring_dedup.chunk_spans(np.frombuffer(data, np.uint8), offsets)
    assert b"".join(data[a:b] for a, b in zip(start, end)) == data
    assert all(data[a:b].decode() for a, b in zip(start, end))


@pytest.mark.parametrize("script", LETTERS)
def test_first_occurrences_keep_every_character(spark, script):
    rng = random.Random(2)
    rows, first = [], {}
    for k in range(20):
        a, b = prose(LETTERS[script], rng, 90), prose(LETTERS[script], rng, 90)
        rows += [(3 * k, a), (3 * k + 1, f"{a} {b}"), (3 * k + 2, f"{a} {b}")]
        first[k] = (a, b)
    kept = {r.doc_id: r.text for r in substring_dedup.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (a, b) in first.items():
        assert kept[3 * k] == a and kept[3 * k + 1].endswith(b)
        assert len(kept[3 * k + 2]) < len(f"{a} {b}") / 2
