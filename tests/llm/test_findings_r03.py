"""What the third round's findings named in the training-data operators."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from plyframe.llm import _sorted_runs, alignment, language_id, toxicity


def test_decided_rows_and_totals_are_read_once(spark, monkeypatch):
    """op10: one join over the rows found, none of them a second time for the undecided."""
    monkeypatch.setattr(_sorted_runs, "HOLD", 50)
    rows = spark.range(600).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).cast("long").alias("h"), F.col("id").alias("doc"), F.lit(0).cast("long").alias("ver"), F.lit(0).cast("long").alias("place"))
    found = _sorted_runs.repeated(rows, ["h"], 2, "test")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "MapInArrow" not in plan and "Union" not in plan
    assert found.count() == found.select("h", "doc").distinct().count() == 600


@pytest.mark.parametrize("block", [3, 10_000])
def test_thresholds_of_counted_rows(spark, monkeypatch, block):
    """running counts in Spark give what the sorted rows of each language give."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(int(y), float(round(x + y, 1)), int(k)) for y, x, k in zip(rng.random(900) < 0.3, rng.normal(0, 1, 900), rng.integers(-1, 3, 900))] + [(1, 0.5, 3)] * 4
    got = toxicity.thresholds(spark.createDataFrame(rows, "label int, logit double, lang int"))
    label, logit, lang = (np.array(c) for c in zip(*rows))
    want = {-1: toxicity.best_threshold(logit, label)} | {k: toxicity.best_threshold(logit[lang == k], label[lang == k]) for k in (0, 1, 2)}
    assert got == pytest.approx(want)


def test_thresholds_see_all_rows_that_the_fit_has_not(spark, monkeypatch):
    """labelled rows beyond max_train_docs take part."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "bad words here").otherwise("good words there").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    seen = {}
    fit, told = toxicity.fit, toxicity.thresholds
    monkeypatch.setattr(toxicity, "fit", lambda words, at, label: seen.update(fit=len(label)) or fit(words, at, label))
    monkeypatch.setattr(toxicity, "thresholds", lambda rows: seen.update(held=rows.count()) or told(rows))
    toxicity.train(docs, labels, F.lit(True), language_id.LanguageModel(["x"], np.zeros((1, language_id.BUCKETS), np.float32)), max_train_docs=100)
    assert seen["fit"] + seen["held"] == 400 and seen["fit"] <= 100


def test_no_text_is_shuffled_to_its_label(spark, monkeypatch):
    """op4: texts give logits below the join with labels, and the fit's ids are broadcast."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "bad words here").otherwise("good words there").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    plans = []
    kind, told = type(docs), toxicity.thresholds
    monkeypatch.setattr(kind, "toArrow", lambda self, f=kind.toArrow: plans.append(self._jdf.queryExecution().executedPlan().toString()) or f(self))
    monkeypatch.setattr(toxicity, "thresholds", lambda rows: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or told(rows))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        model = toxicity.train(docs, labels, F.lit(True), language_id.LanguageModel(["x"], np.zeros((1, language_id.BUCKETS), np.float32)), max_train_docs=100)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    fit, held = plans
    assert "BroadcastHashJoin" in fit and "SortMergeJoin" not in fit
    assert held.index("Join") < held.index("MapInArrow")
    assert set(model.thresholds) == {-1, 0}


def test_words_are_gone_and_codes_are_halves_when_texts_are_shuffled(spark):
    """op11: the final shuffle finds no dictionaries on disk and moves codes as two shorts."""
    docs = spark.createDataFrame([(1, "the quick fox"), (2, "the fox"), (3, None)], "doc_id long, text string")
    found = alignment.align(docs)
    kept = {f.split("/alignment-blocks")[1].split("/")[1] for f in found.inputFiles() if "/alignment-blocks" in f and os.path.exists(f.removeprefix("file:"))}
    assert kept == {"kind=texts"}
    codes = np.array([0, 1, 255, 256, 32767, 32768, 65535, 65536, 1 << 30, (1 << 31) - 1])
    halves = [(codes & 0xFFFF).astype(np.uint16).view(np.int16).tolist(), (codes >> 16).astype(np.uint16).view(np.int16).tolist()]
    row = spark.createDataFrame([tuple(halves)], "low array<short>, high array<short>").select(alignment.codes_of(F.col("low"), F.col("high")).alias("codes")).first()
    assert row.codes == codes.tolist()
    assert sorted((r.id, r.n_a) for r in found.collect()) == [(1, 3), (2, 2), (3, 0)]
