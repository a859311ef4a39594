import random
import re

import pyarrow as pa
import pytest
from conftest_llm import ODD_TEXTS
from pyspark.sql import functions as F

from evitrust.llm import winnow_lines as wl


def brute(rows, k):
    """Texts without the lines of runs that stand before, by plain search; rows are (id, text), ids distinct."""
    parts = {}
    for i, t in rows:
        counted = [(j, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for j, x in enumerate((t or "").split("\n"))]
        parts[i] = [p for p in counted if p[2]]
    out = {}
    places = {}
    for i in sorted(parts):
        for s in range(len(parts[i])):
            n = 0
            for e in range(s, len(parts[i])):
                n += parts[i][e][2]
                if n >= k:
                    places.setdefault(tuple(x for _, x, _ in parts[i][s:e + 1]), []).append((i, s, e))
                    break
    gone = {i: set() for i in parts}
    for spots in places.values():
        (a, s0, e0), rest = spots[0], spots[1:]
        for b, s, e in rest:
            m = 0
            while s - m > 0 and s0 - m > 0 and parts[a][s0 - m - 1][1] == parts[b][s - m - 1][1]:
                m += 1
            r = 0
            while e + r + 1 < len(parts[b]) and e0 + r + 1 < len(parts[a]) and parts[a][e0 + r + 1][1] == parts[b][e + r + 1][1]:
                r += 1
            gone[b] |= {parts[b][x][0] for x in range(s - m, e + r + 1)}
    for i, t in rows:
        out[i] = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i])
    return out


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 4), (3, 6), (4, 9)])
def test_matches_brute_force(table, seed, k):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 9))) for _ in range(6)] + ["", "  ", "one two three", "x\ty"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12)))) for i in range(40)]
    got = {r.doc_id: r for r in wl.dedup_lines(table(rows), min_words=k).collect()}
    want = brute(rows, k)
    assert {i: r.text for i, r in got.items()} == want
    for i, t in rows:
        assert got[i].n_lines == len(t.split("\n"))
        assert got[i].n_deleted == len(t.split("\n")) - (len(want[i].split("\n")) if want[i] or got[i].n_deleted < got[i].n_lines else 0)


def passage(n, word="w"):
    return " ".join(f"{word}{i}" for i in range(n))


def test_shared_passages_go_and_clean_texts_stay(table):
    long = passage(51)
    multi = "\n".join(passage(10, f"m{j}x") for j in range(6))
    rows = [(1, f"own a\n{long}\nown b"), (2, f"{long}\nown c"), (3, "own d\nown e"), (4, multi), (5, f"head\n\n{multi}\n\ntail"),
            (6, passage(49)), (7, passage(49)), (8, f"{passage(49)}\nnew")]
    got = {r.doc_id: r.text for r in wl.dedup_lines(table(rows)).collect()}
    assert got == {1: rows[0][1], 2: "own c", 3: rows[2][1], 4: multi, 5: "head\n\n\ntail", 6: passage(49), 7: passage(49),
                   8: f"{passage(49)}\nnew"}


def test_odd_texts_repeated_rows_null_ids_and_clashing_columns(table):
    rows = [*enumerate(ODD_TEXTS)] + [(50, passage(60)), (50, passage(60)), (51, passage(60)), (None, passage(60, "n")), (60, passage(60, "n"))]
    df = table(rows, extra=["n_lines", "runs", "id", "text_hash", "hash"])
    got = wl.dedup_lines(df).collect()
    assert len(got) == len(rows) and wl.dedup_lines(df).columns[-2:] == ["n_lines", "n_deleted"]
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 50}
    assert all(by[i].text == t for i, t in enumerate(ODD_TEXTS))
    assert by[0].n_lines == 0 and by[1].n_lines == 1
    assert [r.text for r in got if r.doc_id == 50] == [passage(60)] * 2 and by[51].text == "" and by[51].n_deleted == 1
    assert by[60].text == ""
    assert wl.dedup_lines(table([])).count() == 0


def test_every_repeated_run_shares_a_fingerprint():
    rnd = random.Random(5)
    pool = [passage(rnd.randint(1, 20), f"p{i}x") for i in range(30)]
    run = pool[:8]
    texts = ["\n".join(rnd.sample(pool[8:], 4) + run + rnd.sample(pool[8:], 4)) for _ in range(2)]
    found, owner = wl.windows_of(pa.array(texts), 30)
    sets = [{f for f, o in zip(found.field("fingerprint").to_pylist(), owner) if o == t} for t in (0, 1)]
    assert sum(len(x.split()) for x in run) >= 30 and sets[0] & sets[1]


def test_no_window_is_lost_on_the_documents(documents):
    done = wl.dedup_lines(documents).cache()
    assert done.count() == documents.count()
    again = wl.dedup_lines(done).agg(F.sum("n_deleted")).first()[0]
    assert again <= 0.02 * done.agg(F.sum("n_lines")).first()[0]


def brute_every_place(rows, k):
    """Texts without the lines of any run of k words that stands at any place before."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        counted = [(j, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for j, x in enumerate((t or "").split("\n"))]
        p, gone = [c for c in counted if c[2]], set()
        for s in range(len(p)):
            runs = [(e, tuple(x for _, x, _ in p[s:e + 1])) for e in range(s, len(p)) if sum(n for _, _, n in p[s:e + 1]) >= k]
            gone |= {j for e, r in runs if r in seen for j, _, _ in p[s:e + 1]}
            seen |= {r for _, r in runs}
        out[i] = "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone)
    return out


@pytest.mark.parametrize("seed,k", [(1, 1), (2, 4), (3, 6), (4, 9), (5, 12)])
def test_every_place_matches_brute_force(table, seed, k):
    rnd = random.Random(seed)
    lines = ["".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 9))) for _ in range(6)] + ["", "  ", "one two three", "x\ty"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12)))) for i in range(40)]
    got = {r.doc_id: r.text for r in wl.dedup_lines(table(rows), min_words=k, every_place=True).collect()}
    assert got == brute_every_place(rows, k)


def test_queries_find_the_longer_run_behind_a_popular_passage(spark, table, tmp_path):
    from evitrust.llm.queries import QUERIES
    import corpus_pipeline
    p, x = passage(60), passage(10, "x")
    docs = table([(1, p), (2, f"{p}\n{x}"), (3, f"{p}\n{x}")])
    assert {r.doc_id: r.text for r in corpus_pipeline.without_repeated_lines(spark, docs, "").collect()} == {1: p, 2: x, 3: ""}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op10_winnow_lines"](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.n_deleted for r in found} == {1: 0, 2: 1, 3: 2}
