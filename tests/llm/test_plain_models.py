"""Language shares and toxicity scores against plain loops on small models."""

import math

import numpy as np
import pytest

from plyframe.llm import language_id as lid
from plyframe.llm import toxicity as tox
from plyframe.llm._shared import byte_buffer

import pyarrow as pa

TEXTS = ["un gato y el perro con la casa", "the cat and the dog with a house", "the cat y el perro and la casa with una", "der hund und die katze", "x", "", "12 34 !", "the " * 50 + "el " * 3, "ñandú über the"]


def tables():
    """A model of four languages from a few words each."""
    seed = {"de": "der hund und die katze das haus mit", "en": "the cat and the dog with a house of", "es": "el gato y el perro con la casa una", "fr": "le chat et le chien avec la maison"}
    logp = []
    for text in seed.values():
        data, offsets = byte_buffer(pa.array([text]))
        counts = np.full(lid.BUCKETS, 0.02)
        np.add.at(counts, lid.trigram_codes(data, offsets)[lid.LETTER[data]], 1)
        logp.append(np.log(counts / counts.sum()))
    return lid.LanguageModel(list(seed), np.array(logp, np.float32))


def word_likelihoods(model, text):
    """Per word the likelihood in each language, from its trigrams one by one."""
    raw = text.lower().encode()
    letter = [b >= 0x80 or 97 <= b <= 122 for b in raw]
    words, at = [], 0
    while at < len(raw):
        if not letter[at]:
            at += 1
            continue
        end = at
        while end < len(raw) and letter[end]:
            end += 1
        total = [0.0] * len(model.languages)
        for i in range(at, end):
            left, right = (raw[i - 1] if i > at else 32), (raw[i + 1] if i + 1 < end else 32)
            bucket = (((left << 16 | raw[i] << 8 | right) * 0x9E3779B1) & 0xFFFFFFFF) >> 16
            for k in range(len(total)):
                total[k] += float(model.logp[k, bucket])
        words.append(total)
        at = end
    return words


def mixture(words, share, rounds):
    for _ in range(rounds):
        new = [0.0] * len(share)
        for w in words:
            joint = [s * math.exp(max(x - max(w), -60)) for s, x in zip(share, w)]
            total = max(sum(joint), 1e-30)
            new = [a + b / total for a, b in zip(new, joint)]
        share = [x / len(words) for x in new]
    fit = sum(math.log(max(sum(s * math.exp(max(x - max(w), -60)) for s, x in zip(share, w)), 1e-30)) for w in words)
    return share, fit


def plain_shares(model, text):
    words, n = word_likelihoods(model, text), len(model.languages)
    if not words:
        return [0.0] * n
    penalty = 0.5 * math.log(max(len(words), 2))
    share, fit = mixture(words, [1 / n] * n, lid.EM_ROUNDS)
    alone = [sum(math.log(max(math.exp(max(w[k] - max(w), -60)), 1e-30)) for w in words) for k in range(n)]
    best = max(range(n), key=lambda k: (alone[k], -k))
    if alone[best] >= fit - penalty:
        return [float(k == best) for k in range(n)]
    while True:
        active = [k for k in range(n) if share[k] > lid.MIN_SHARE]
        if len(active) < 2:
            break
        least = min(active, key=lambda k: (share[k], k))
        trial = [s if k in active and k != least else 0.0 for k, s in enumerate(share)]
        trial, new = mixture(words, [s / sum(trial) for s in trial], lid.SET_ROUNDS)
        if new < fit - penalty:
            break
        share, fit = trial, new
    return [s if s > lid.MIN_SHARE else 0.0 for s in share]


def test_shares_equal_a_plain_mixture():
    model = tables()
    data, offsets = byte_buffer(pa.array([t.lower() for t in TEXTS]))
    got = lid.infer_shares(model, data, offsets).T
    for text, row in zip(TEXTS, got):
        want = plain_shares(model, text)
        assert row == pytest.approx(want, abs=2e-3), text
        assert {k for k, x in enumerate(row) if x} == {k for k, x in enumerate(want) if x}, text
    assert sum(x > 0 for x in got[2]) == 2 and got[2].argmax() in (1, 2)


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    model = tox.ConvModel(
        rng.normal(0, 1, (tox.BUCKETS, tox.DIM)).astype(np.float32),
        [rng.normal(0, 1, (w, tox.DIM, tox.FILTERS)).astype(np.float32) for w in tox.WIDTHS],
        [rng.normal(0, 1, tox.FILTERS).astype(np.float32) for _ in tox.WIDTHS],
        rng.normal(0, 1, len(tox.WIDTHS) * tox.FILTERS).astype(np.float32),
        -0.3,
    )
    data, offsets = byte_buffer(pa.array([t.lower() for t in TEXTS]))
    words, rows = tox.word_buckets(data, offsets)
    got = tox.logits(model, words, rows)
    for i in range(len(TEXTS)):
        mine, total = words[rows[i] : rows[i + 1]].tolist(), model.bias
        for w, width in enumerate(tox.WIDTHS):
            for f in range(tox.FILTERS):
                values = [sum(float(model.embedding[mine[at + k]] @ model.kernels[w][k][:, f]) for k in range(width)) for at in range(len(mine) - width + 1)]
                pooled = max(0.0, max(values) + float(model.offsets[w][f])) if values else 0.0
                total += pooled * float(model.weight[w * tox.FILTERS + f])
        assert got[i] == pytest.approx(total, abs=1e-3), TEXTS[i]


def test_texts_without_words_are_never_toxic(spark):
    model = tox.fit(np.array([1, 2, 3, 4]), np.array([0, 1, 2, 3, 4]), np.array([1, 1, 1, 0]))
    model.bias, model.thresholds = 9.0, {-1: 0.0}
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "word")], "doc_id long, text string")
    got = {r.id: r.score for r in tox.score(docs, model, tables()).collect()}
    assert max(got[i] for i in (1, 2, 3)) < 0.5
