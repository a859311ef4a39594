from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import ODD_TEXTS
from pyspark.sql import functions as F

from evitrust.llm import line_crf as crf
from evitrust.llm.queries import op7_line_crf


def test_marginals_match_enumeration():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 5, 1]
    owner = np.repeat(np.arange(5), sizes)
    unary, table = rng.normal(size=len(owner)) * 2, rng.normal(size=(2, 2))
    got, pairs = crf.marginals(unary, owner, table, pairs=True)
    want, both = np.zeros(len(owner)), np.zeros((2, 2))
    for text in range(5):
        at = np.flatnonzero(owner == text)
        total = 0.0
        p, q = np.zeros(len(at)), np.zeros((2, 2))
        for y in product((0, 1), repeat=len(at)):
            w = np.exp(sum(unary[i] * v for i, v in zip(at, y)) + sum(table[a, b] for a, b in zip(y, y[1:])))
            total += w
            p += w * np.array(y)
            for a, b in zip(y, y[1:]):
                q[a, b] += w
        want[at] = p / total
        both += q / total
    assert got == pytest.approx(want) and pairs == pytest.approx(both)


def test_gradient_of_fit_moves_to_the_labels():
    texts = pa.array(["plain words here\nmore plain words", "### %%% $$$\n*** &&& !!!"] * 30)
    x, owner, weight = crf.line_features(texts)
    labels = np.array([1, 0] * 30)
    model = crf.fit(x, owner, weight, labels)
    p, _, _ = model.lines(texts)
    assert p[owner % 2 == 0].min() > 0.9 and p[owner % 2 == 1].max() < 0.1


def test_features_of_neighbours():
    x, owner, weight = crf.line_features(pa.array(["a !\nB", "", None and "", "c c c"]).fill_null(""))
    k = len(crf.FEATURES)
    assert owner.tolist() == [0, 0, 1, 2, 3] and weight.tolist() == [4, 2, 1, 1, 6]
    assert (x[1, k:2 * k] == x[0, :k]).all() and (x[0, 2 * k:3 * k] == x[1, :k]).all()
    assert (x[0, k:2 * k] == 0).all() and (x[2, k:] [:-1] == 0).all()
    assert x[4, 3] == pytest.approx(2 / 3)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_texts_nulls_and_empty_tables(spark, table):
    rows = ["plain words in a row and some more", "## !! $$ %% ## !! $$"] * 20 + ODD_TEXTS
    docs = table(rows, extra=["label", "_id", "score", "x"])
    labels = labelled(spark, [(i, (i + 1) % 2, 0) for i in range(40)] + [(41, None, 0), (None, 1, 0), (40, 1, 0)])
    model = crf.train(docs, labels, F.lit(True))
    got = crf.predict(docs, model, keep_lines=True).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and len(r.line_scores) == r.n_lines for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i + 1) % 2 for i in range(40))
    assert by[40].score == by[41].score and by[40].n_lines == 1
    assert crf.predict(table([]), model).count() == 0
    assert crf.train(table([]), labels, F.lit(True)) is None
    assert {(r.score, r.predicted) for r in crf.predict(docs, None).collect()} == {(0.5, 1)}


def test_held_out_quality(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = op7_line_crf(spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([g >= crf.THRESHOLD for g in good]) > 0.98
