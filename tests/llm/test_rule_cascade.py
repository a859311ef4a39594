import re

from conftest_llm import ODD_TEXTS

from evitrust.llm import rule_cascade as rc

MORE = ["one two three four five six seven eight nine ten " * 3, "a|b #c $d % & < > *" * 4, "Loud WORDS! " * 12, "line one\n" * 9]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    n = len(words)
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": n < 10 or 100 * len(covered) > 20 * n}


def test_measures_match_brute_force(table, documents):
    texts = ODD_TEXTS + MORE + [r.text for r in documents.limit(60).collect()]
    got = {r.doc_id: r.asDict() for r in rc.cascade(table(texts, extra=["kept", "n_words"]), measures=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, t
        assert not (got[i]["kept"] and want["base_failed"])


def test_order_never_changes_verdicts(table):
    df = table(ODD_TEXTS + MORE)
    names = [r.name for r in rc.RULES]
    a = {r.doc_id: r.kept for r in rc.cascade(df, order=names).collect()}
    b = {r.doc_id: r.kept for r in rc.cascade(df, order=names[::-1], measures=True).collect()}
    assert a == b


def test_short_circuit_and_estimate(table):
    df = table(["ab", "good text with many different plain words in one short english line"] * 20)
    first = rc.estimate(df)
    assert first[0]["rule"] == "few_words" and first[0]["selectivity"] == 0.5
    tried = {(r.kept, r.n_rules) for r in rc.cascade(df).collect()}
    assert (False, 1) in tried and (True, len(rc.RULES)) in tried


def test_empty_table(table):
    assert rc.cascade(table([]), measures=True).count() == 0
    assert {x["selectivity"] for x in rc.estimate(table([]))} == {0.0}
