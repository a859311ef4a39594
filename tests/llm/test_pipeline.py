import corpus_pipeline as cp
import pytest
from conftest_llm import ODD_TEXTS
from test_signature_tree import brute
from test_winnow_lines import brute as brute_lines


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stage(spark, out[-1], sf_dir).cache())
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_classifier", "line_dedup", "near_duplicates", "packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_filters_keep_clean_documents_and_drop_junk(spark, sf_dir, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    start, spoken, good = (dict(rows(s)) for s in stages[:3])
    assert len(spoken) >= 0.99 * len(start)
    clean = [i for i in spoken if labels.get(i) == 1]
    junk = [i for i in spoken if labels.get(i) == 0]
    assert sum(i in good for i in clean) >= 0.98 * len(clean) and sum(i in good for i in junk) <= 0.2 * len(junk)
    assert all(good[i] == start[i] for i in good)


def test_line_and_near_duplicate_stages_match_brute_force(stages):
    good, lines, single = (rows(s) for s in stages[2:5])
    assert dict(lines) == brute_lines(good, 50)
    assert sorted(i for i, _, name in brute(lines) if i == name) == sorted(i for i, _ in single)
    assert dict(single).items() <= dict(lines).items()
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_packing_takes_every_document(stages):
    ids = {i for i, _ in rows(stages[4])}
    pieces = stages[5].collect()
    assert {p.doc_id for p in pieces} == ids and all(p.offset + p.length <= 2048 for p in pieces)


def test_odd_rows_pass_all_stages(spark, table, sf_dir):
    docs = table([*enumerate(ODD_TEXTS), (0, "zero again"), (None, "no id at all")], extra=["score", "rejected", "n_lines"])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    docs.collect()


def test_empty_table(spark, table, sf_dir):
    docs = table([])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_run(spark, sf_dir, stages):
    def places(df):
        return sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert places(cp.run(spark, sf_dir)) == places(stages[5])
