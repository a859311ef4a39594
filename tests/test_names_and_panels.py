"""Names, suggestions, panels and layout against hand-made cases and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evitrust.functions import columns as C, names as N, text as X
from evitrust.operators import layout, panel, resolve


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,normalized,parent", [
    ("  Quinidine Sulfate ", "quinidinesulfate", "quinidine"),
    ("D,L-Sotalol HCl", "dlsotalolhcl", "dlsotalol"),
    ("Sodium Chloride", "sodiumchloride", "sodiumchloride"),  # all words left out: keep them
    ("diltizem", "diltiazem", "diltiazem"),
    ("Maßol-hydrobromide", "massolhydrobromide", "massol"),
    ("acetateX", "acetatex", "acetatex"),
    ("blinded 7", "blinded7", "7"),
])
def test_normalize(spark, raw, normalized, parent):
    df = N.normalize_names(spark.createDataFrame([(raw,)], "n string"), "n")
    r = df.first()
    assert (r["name_normalized"], r["name_parent"], r["name_alias_applied"]) == (normalized, parent, False)


def test_identity_alias_reason(spark):
    df = spark.createDataFrame([("DL-Sotalol",)], "n string")
    r = N.normalize_names(df, "n", identity_aliases=True).first()
    assert r["name_parent"] == "sotalol" and r["name_alias_applied"] and len(r["name_alias_reason"]) == 1


def test_units_and_casts(spark):
    got = [one(spark, C.to_micromolar(F.lit(5.0), F.lit(u))) for u in ("nM", " uM", "µM", "μM", "mM", "pM", "mg")]
    assert got == [0.005, 5.0, 5.0, 5.0, 5000.0, 5.0 / 1e6, None]
    assert [one(spark, C.to_long(F.lit(x))) for x in ("3.0", "2.5", "nan", "x", " 7 ")] == [3, None, None, None, 7]


def test_censored_and_headers(spark):
    assert tuple(one(spark, X.censored_number(F.lit("> 1,234.5 uM")))) == (1234.5, ">")
    assert tuple(one(spark, X.censored_number(F.lit("none")))) == (None, "NA")
    assert one(spark, X.header_value_type(F.lit("Free Cmax"))) == "block_cmax"
    assert one(spark, X.repair_glyphs(F.lit(" M"))) == "10.5 uM"


def test_closest_names_match_brute_force(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(2, 9)))
    q, c = sorted({word() for _ in range(40)}), sorted({word() for _ in range(120)})
    dq, dc = spark.createDataFrame([(x,) for x in q], "q string"), spark.createDataFrame([(x,) for x in c], "c string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row[0], [i, *row[1:]]
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for cutoff in (0.0, 0.45):
        got = {}
        for row in resolve.closest_names(dq, "q", dc, "c", 4, cutoff, names_per_block=7).collect():
            got.setdefault(row["query"], {})[row["rank"]] = (row["candidate"], pytest.approx(row["score"]))
        for x in q:
            s = sorted((-(1 - distance(x, y) / max(len(x), len(y))), y) for y in c)
            want = {i + 1: (y, -v) for i, (v, y) in enumerate([z for z in s if -z[0] >= cutoff][:4])}
            assert got.get(x, {}) == want


def test_levenshtein_blocks_do_not_change_the_result(spark):
    names = spark.createDataFrame([(f"name{i % 37}{'x' * (i % 5)}",) for i in range(200)], "n string")
    q = spark.createDataFrame([("name12xx",), ("nam",)], "q string")
    a = resolve.closest_names(q, "q", names, "n", 6, 0.0).collect()
    b = resolve.closest_names(q, "q", names, "n", 6, 0.0, names_per_block=3).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_best_split_is_optimal():
    r = np.random.default_rng(1)
    for _ in range(30):
        n, k = int(r.integers(2, 8)), 0
        k = int(r.integers(1, n + 1))
        v, m = np.round(r.normal(size=n), 1), np.round(r.normal(size=k), 1)
        groups = panel._best_split(v, m)
        assert np.concatenate(groups).tolist() == v.tolist() and all(len(g) for g in groups)
        cost = sum((g.mean() - x) ** 2 for g, x in zip(groups, m))
        best = min(sum((v[a:b].mean() - x) ** 2 for a, b, x in zip((0, *cut), (*cut, n), m))
                   for cut in itertools.combinations(range(1, n), k - 1))
        assert cost == pytest.approx(best)


PANEL = """Appendix

Dofetilide HCl

Current block 1 nM 10 nM 0.1 uM
hERG 5, 6 50, 52 90, 92
X ± SEM 5.5 ± 0.5 51 ± 1 91 ± 1
ignored text
Cav1.2 1 2 3 4 5 6 7
not a channel 8
Kir2.1
1, 2 3, 4 5, 6 X ± SEM
Nothing

Current
hERG 1 2 3
"""


def test_panel_rules(spark):
    docs = spark.createDataFrame([("d", PANEL)], "doc_id string, text string")
    rows = panel.parse_panels(docs).orderBy("run", "conc_no").collect()
    assert {r["name_raw"] for r in rows} == {"Dofetilide HCl"}
    by = {}
    for r in rows:
        by.setdefault(r["channel"], []).append(r)
    assert [r["block_pct_mean"] for r in by["hERG"]] == [5.5, 51.0, 91.0]
    assert by["hERG"][0]["method"] == "dp_means" and by["hERG"][2]["concentration_uM"] == pytest.approx(0.1)
    # no SEM line: text up to the next channel is taken, 1.2 is not part of it
    assert by["Cav1.2"][0]["method"] == "fallback_equal"
    assert [r["block_pct_replicates"] for r in by["Cav1.2"]] == ["[1.0,2.0]", "[3.0,4.0]", "[5.0,6.0]"]
    assert [r["block_pct_mean"] for r in by["IK1"]] == [1.5, 3.5, 5.5] and by["IK1"][0]["method"] == "regex"
    issues = {(r["issue"], r["channel"]) for r in panel.parse_warnings(docs).collect()}
    assert issues == {("replicate_group_fallback", "Cav1.2"), ("missing_concentration", None)}


def test_lines_anchor_on_first_word(spark):
    words = spark.createDataFrame([(1, float(y), float(x), t) for y, x, t in [
        (0, 5, "a"), (9, 1, "b"), (10, 3, "c"), (11, 2, "d"), (21, 0, "e"), (60, 0, "f")]],
        "page int, y_center double, x_center double, text string")
    got = {r["text"]: r["line_y"] for r in layout.assign_lines(words, 10.0).collect()}
    assert got == {"a": 0.0, "b": 0.0, "c": 0.0, "d": 11.0, "e": 11.0, "f": 60.0}


def test_many_terms_use_the_same_rule(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    terms = ["the", "nicht", "eau"] + [f"zq{i}" for i in range(100)]
    few, many = panel.term_mentions(docs, terms[:3]), panel.term_mentions(docs, terms)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_squeezed_terms_follow_the_rule_of_the_text(spark):
    docs = spark.createDataFrame([(1, "DL-Sotalol was given"), (2, "d,l sotalol"), (3, None)], "doc_id long, text string")
    got = {tuple(r) for r in panel.term_mentions(docs, ["DL-Sotalol", "was  GIVEN", "-"], squeeze=True).collect()}
    assert got == {(1, "DL-Sotalol"), (2, "DL-Sotalol"), (1, "was  GIVEN")}
    assert panel.term_mentions(docs, []).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_parsed_inside_their_row(spark):
    docs = spark.createDataFrame([("d", PANEL, 1), ("d", PANEL, 2), ("e", None, 1), ("f", "", 1), ("g", "Current 1 nM\nhERG 5", 1)],
                                 "doc_id string, text string, block int")
    cells, warnings = panel.parse_panels(docs), panel.parse_warnings(docs)
    for df in (cells, warnings, panel.parse_legacy_panels(docs), panel.detect_tables(docs), panel.table_cells(docs)):
        assert "Exchange" not in plan_of(df)
    one_row = panel.parse_panels(docs.where("doc_id = 'd' and block = 1")).collect()
    assert sorted(map(str, cells.collect())) == sorted(map(str, one_row + one_row))  # rows with one id stay apart
    found = {(r["doc_id"], r["entity"], r["channel"], r["issue"], r["detail"]) for r in warnings.collect()}
    assert ("g", "<unknown>", None, "missing_drug_name", "at line 0") in found and {d for d, *_ in found} == {"d", "g"}
    assert panel.parse_panels(docs.where("false")).collect() == []


def test_fold_of_lines_against_a_rule_for_each_line():
    r = random.Random(11)
    for _ in range(300):
        n = r.randint(0, 14)
        kinds = [r.choice([0, 0, 1, 2, 2, 3]) for _ in range(n)]
        named = [r.choice(["", f"n{i}"]) for i in range(n)]
        pieces = ["" if k == 3 and r.random() < .5 else r.choice(["", f"p{i}"]) for i, k in enumerate(kinds)]
        want = []
        for i, k in enumerate(kinds):
            heads = [j for j in range(i + (k == 1)) if kinds[j] == 1]
            if not heads or k not in (1, 2):
                continue
            h = heads[-1]
            entity = next((named[j] for j in range(h - 1, -1, -1) if named[j]), None)
            if k == 1:
                want.append((len(heads), None, i, entity, None, pieces[h], None, None))
                continue
            run = sum(kinds[j] == 2 for j in range(heads[0], i + 1))
            stop = next((j for j in range(i + 1, n) if kinds[j] in (1, 2)), n)
            sem = next((j for j in range(i + 1, stop) if kinds[j] == 3), None)
            text = [pieces[j] for j in range(i, stop if sem is None else sem + 1) if pieces[j]]
            want.append((len(heads), run, i, entity, f"c{i}", pieces[h], " ".join(text), None if sem is None else f"m{sem}"))
        got = panel._fold_lines(named, kinds, pieces, [f"c{i}" for i in range(n)], [f"m{i}" for i in range(n)])
        assert got == want


def test_tables_in_text(spark):
    text = "a  1  2  b\n\n c  3  4  d\nplain\nx  1  2  y\nplain\nq  5  6  r\ns  7  8  t  9"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    assert sorted(map(tuple, panel.detect_tables(docs).collect())) == [(1, 0, 0, 2, 2, 4), (1, 2, 6, 7, 2, 5)]
    cells = {(r["table_no"], r["row_no"], r["col_no"]): r["cell_text"] for r in panel.table_cells(docs).collect()}
    assert cells[(0, 1, 0)] == "c" and cells[(2, 1, 4)] == "9" and len(cells) == 17


def test_text_is_searched_once_for_means_and_once_for_numbers(spark):
    """The extraction query names its pairs twice; each row is searched once for them all the same."""
    from evitrust.functions import text as X
    from evitrust.plans import Tables, load_all
    plan = load_all()["extract_numbers_and_pairs"].run(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2
    df = spark.createDataFrame([("SEM 5 ± 0.5 7  ±x -2.5\t±\n3",), ("1 sem",), ("4 ± 2 ± 3",), (None,)], "t string")
    got = [r.p and [(x["mean"], x["sem"]) for x in r.p] for r in df.select(X.mean_sem_pairs(F.col("t")).alias("p")).collect()]
    assert got == [[(5.0, 0.5), (7.0, None), (-2.5, 3.0)], [], [(4.0, 2.0), (3.0, None)], None]


def test_catalogue_keys_are_made_once_for_each_distinct_name(spark):
    from evitrust.operators import resolve
    cat = spark.createDataFrame([(3, "Sodium", ["Alpha HCl", None]), (1, "Beta", ["alpha"]), (2, "beta", None), (4, "ALPHA", ["Beta"])],
                                "id int, pref string, syn array<string>")
    keys = resolve.catalogue_keys(cat, "id", "pref", "syn", "id")
    got = {r.query_parent: (r.id, r.resolved_name, r.resolution_method) for r in keys.collect()}
    assert got == {"sodium": (3, "Sodium", "pref_name"), "alpha": (4, "ALPHA", "pref_name"), "beta": (1, "Beta", "pref_name")}
    plan = keys._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hydrochloride") <= 2 and plan.index("hydrochloride") < plan.index("Generate explode")
    assert any("Aggregate [resolved_name" in line for line in plan.splitlines())


def test_large_panels_of_words_are_dealt_by_rows(spark, monkeypatch):
    """the tasks of large tables hold a bounded number of rows, and the cells stay the same."""
    import re

    from evitrust import ordering
    words = [(p, 3.0, 50.0, "Current") for p in range(6)] + [(p, 3.0, 300.0 + 200 * c, f"{c + 1}µM") for p in range(6) for c in range(3)]
    words += [(p, 30.0, 0.0, "hERG") for p in range(6)] + [(p, 34.0, 300.0 + 200 * c + 5 * k, str(p + c + k)) for p in range(6) for c in range(3) for k in range(2)]
    df = spark.createDataFrame(words, "page int, y_center double, x_center double, text string")
    plain = layout.panel_from_words(df)
    monkeypatch.setattr(ordering, "ROWS_PER_TASK", 5)
    dealt = layout.panel_from_words(df)
    plan = dealt._jdf.queryExecution().analyzed().toString()
    assert re.search(r"RepartitionByExpression \[page#\d+, line_y#\d+\], 14", plan) and re.search(r"RepartitionByExpression \[page#\d+\], 14", plan)
    assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))
    assert dealt.count() == 18
