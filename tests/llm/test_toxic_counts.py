"""What the toxicity model counts, and the sample it is fitted on."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_every_labelled_row_is_counted(spark, monkeypatch):
    from lodestrata.llm import toxicity as X

    counted, tables = [], X.difference_tables

    def seen(counts):
        counted.append({r.gram: (r.n_toxic, r.n_ordinary) for r in counts.collect()})
        return tables(counts)

    monkeypatch.setattr(X, "difference_tables", seen)
    rows = [(k, f"text number {k} of {k % 7} kinds", int(k % 9 == 0)) for k in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    X.toxicity(docs, labels, F.lit(True)).count()
    want = spark.createDataFrame([r[1:] for r in rows], "text string, toxic int").mapInArrow(X.count_grams, "gram long, n_toxic long, n_ordinary long")
    want = {r.gram: (r.t, r.o) for r in want.groupBy("gram").agg(F.sum("n_toxic").alias("t"), F.sum("n_ordinary").alias("o")).collect()}
    assert counted[-1] == want


def test_sample_holds_both_labels(spark, monkeypatch):
    from lodestrata.llm import toxicity as X

    monkeypatch.setattr(X, "FIT_ROWS", 50)
    marks = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") == 77).cast("int").alias("toxic"))
    got = X.fit_sample(marks).collect()
    assert {r.toxic for r in got} == {0, 1} and len(got) <= 50


def test_ngrams_share_no_number(spark):
    """Two n-grams of one slot of the former table keep their own numbers; what is unseen has none."""
    import pickle

    import numpy as np

    from lodestrata.llm import toxicity as X

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 60_000, np.uint64))
    assert len(np.unique(X._slots(keys, X.GRAM_SLOTS))) < len(keys)
    rows = spark.createDataFrame([(int(k), float(i)) for i, k in enumerate(keys)], "gram long, d double")
    held = pickle.loads(pickle.dumps(X._exact(rows)))
    assert (held.of(keys) == np.arange(len(keys))).all()
    assert np.isnan(held.of(np.setdiff1d(keys + np.uint64(1), keys))).all()
    assert np.isnan(X._exact(rows.limit(0)).of(keys)).all()


def test_joined_numbers_give_the_same_scores(spark, monkeypatch):
    """Beyond the bound of the broadcast the numbers are joined to blocks; blocks of any size give the same rows."""
    from lodestrata.llm import toxicity as X

    rows = [(k, f"Text number {k} of {k % 7} kinds, {'vile rot ' * (k % 9 == 0)} and é {'x' * (k % 5)}" * (1 + k % 3), int(k % 9 == 0)) for k in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(3, None), (None, "vile"), (5, ""), (6, "vile rot " * 3000), (6, "vile rot " * 3000)], "doc_id long, text string").withColumn("block", F.lit(1))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    learn = F.col("doc_id") % 4 != 0

    def result():
        return sorted(X.toxicity(docs, labels, learn).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))

    want = result()
    monkeypatch.setattr(X, "HELD_GRAMS_MAX", 0)
    monkeypatch.setattr(X, "BLOCK_BYTES", 300)
    got = result()
    assert got == want and len({r.score for r in got}) > 20
    assert X.toxicity(docs.limit(0), labels, learn).count() == 0
    assert X.toxicity(docs, labels.limit(0), learn).count() == docs.count()
