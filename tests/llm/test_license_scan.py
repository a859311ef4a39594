import re

import numpy as np
import pytest
from conftest_llm import ODD_TEXTS
from pyspark.sql import functions as F

from evitrust.llm import license_scan as scan
from evitrust.llm.license_templates import OTHER, TEMPLATES


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return scan.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokens(text):
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def trigrams(text):
    t = tokens(text)
    return {" ".join(t[i:i + 3]) for i in range(len(t) - 2)} if len(t) >= 3 else {" ".join(t)}


def test_features_match_brute_force(table):
    texts = ["A license", "licence", "x", "", "Some words, then a License: and more words", "the GNU/Linux gpl-3 a b c"]
    rows = scan._featured(table(texts).withColumn("words", scan.words(F.col("text")))).collect()
    for r in rows:
        t = tokens(texts[r.doc_id])
        assert r.features == [" ".join(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)]
        assert set(r.trigrams) == trigrams(texts[r.doc_id])


def test_scan_matches_brute_force(table, model):
    """Probability, family and similarity of every line, computed from the coefficients."""
    texts = [t for ts in TEMPLATES.values() for t in ts] + list(OTHER) + ["see the MIT site", "license license of the gpl"]
    place = {g: i for i, g in enumerate(model.vectors.vocabulary)}
    b, w = model.regression.interceptVector.toArray(), model.regression.coefficientMatrix.toArray()
    got = {r.doc_id: r for r in scan.scan(table(texts), model, every=True).collect()}
    for i, text in enumerate(texts):
        t = tokens(text)
        held = sorted({place[g] for n in (1, 2, 3) for k in range(len(t) - n + 1) if (g := " ".join(t[k:k + n])) in place})
        z = b + w[:, held].sum(axis=1)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = p[1:].max()
        assert got[i].probability == pytest.approx(best, abs=1e-9)
        family = scan.FAMILIES[1 + int(p[1:].argmax())] if best >= model.least else scan.UNKNOWN
        assert got[i].family == family
        near = max((len(trigrams(text) & trigrams(x)) / min(len(trigrams(text)), len(trigrams(x))) for x in TEMPLATES.get(family, ())), default=0.0)
        assert got[i].similarity == pytest.approx(near) and got[i].confirmed == (near >= scan.CONFIRM)


@pytest.mark.parametrize("notice,family", [("Released under MIT.", "mit"), ("Distributed under Apache 2.0.", "apache"),
                                           ("This file is licensed under the MIT License.", "mit")])
def test_a_notice_that_every_document_holds_is_found(table, notice, family):
    docs = table([f"the story of number {i} and its friends\n{notice}\nthey went home" for i in range(300)])
    got = scan.scan(docs, scan.train(docs)).collect()
    assert len(got) == 300 and all(r.family == family and r.line == 1 for r in got)


def test_templates_are_found_and_confirmed(table, model):
    texts = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    df = table([f"before\n  {t}  \nafter" for _, t in texts])
    got = {r.doc_id: r for r in scan.scan(df, model).collect()}
    right = [i for i, (f, _) in enumerate(texts) if i in got and got[i].family == f]
    assert len(right) >= 0.95 * len(texts)
    assert all(got[i].confirmed and got[i].similarity == 1 and got[i].line == 1 for i in right)
    for i in right:
        assert texts[i][1] == TEMPLATES[got[i].family][got[i].template] or got[i].similarity == 1


def test_changed_notices_and_unknown_paragraphs(table, model):
    notices = [("gpl", "The code is licensed under the GNU General Public License, version 3, by us."), ("mit", "released under the mit license"),
               ("apache", "// Licensed under the Apache License, Version 2.0."), ("cc-by-nc", "Text: licensed under CC BY-NC 4.0")]
    rows = [t for _, t in notices] + list(OTHER) + ["A new license for the shop in our street.", "plain text without such words"]
    got = {r.doc_id: r for r in scan.scan(table(rows), model).collect()}
    for i, (family, text) in enumerate(notices):
        assert got[i].family == family and got[i].confirmed
        near = max(len(trigrams(text) & trigrams(t)) / min(len(trigrams(text)), len(trigrams(t))) for t in TEMPLATES[family])
        assert got[i].similarity == pytest.approx(near)
    assert not [i for i in got if i >= len(notices) and got[i].confirmed]
    every = scan.scan(table(rows), model, every=True)
    assert every.where("family = 'unknown'").count() >= len(OTHER) - 2


def test_no_feature_is_unknown_by_the_intercept(model):
    b = model.regression.interceptVector.toArray()
    assert scan.FAMILIES[b.argmax()] == scan.UNKNOWN


def test_odd_texts_and_tables(table, model):
    assert scan.scan(table(ODD_TEXTS, extra=["words", "features", "vector", "probability", "line", "family"]), model).count() == 0
    assert scan.scan(table([]), model).count() == 0
    got = scan.scan(table([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "x\nLicensed under CC BY-NC 4.0.")]), model)
    assert sorted((r.family, r.line) for r in got.collect()) == [("cc-by-nc", 1), ("mit", 0), ("mit", 0)]
    assert scan.train(table([])).least >= 0.3


def test_plan_is_native(documents, model):
    plan = scan.scan(documents, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "SortMergeJoin" not in plan


def test_documents(documents, model):
    want = {(r.doc_id, i) for r in documents.collect() for i, x in enumerate(r.text.split("\n")) if re.search("(?i)licensed under|under the MIT", x)}
    got = scan.scan(documents, model)
    assert {(r.doc_id, r.line) for r in got.collect()} == want
    assert got.where("NOT confirmed").count() == 0


def test_notices_without_an_anchor_are_classified(table, model):
    texts = [("mit", "Released under MIT."), ("apache", "Distributed under Apache 2.0."), ("apache", "Source code: Apache-2.0"),
             ("mit", "to use, copy, modify, merge, publish, distribute")]
    got = {r.doc_id: r.family for r in scan.scan(table([t for _, t in texts]), model).collect()}
    assert got == {i: f for i, (f, _) in enumerate(texts)}
