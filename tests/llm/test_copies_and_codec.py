import hashlib

import public_tokenizers
import pytest
import tiktoken
from conftest_llm import ODD_TEXTS

from evitrust.llm import progressive_dedup as dedup, sentencepiece_bpe as bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
REAL = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def expected_copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if len(groups[t or ""]) > 1 and ids else i
        out.append((i, keep, len(groups[t or ""]), i == keep, sha(t)))
    return out


@pytest.mark.parametrize("prefix", [1, 256])
def test_exact_dedup(table, prefix):
    rows = [*enumerate([*ODD_TEXTS, "ab", "ac", "ab", None, "x" * 5000, "x" * 4999 + "y"])] + [(100, "solo"), (100, "ab")]
    df = table(rows, extra=["kept", "_n", "text_sha256", "count"])
    got = dedup.exact_dedup(df, prefix_chars=prefix).collect()
    key = lambda r: (r[4], -1 if r[0] is None else r[0])
    assert sorted(map(tuple, got), key=key) == sorted(expected_copies(rows), key=key)


def test_exact_dedup_null_ids_and_empty_table(table):
    assert dedup.exact_dedup(table([])).count() == 0
    got = {r.text_sha256: r for r in dedup.exact_dedup(table([(None, "a"), (3, "a"), (None, "b")])).collect()}
    assert got[sha("a")].keep_id == 3 and got[sha("a")].group_size == 2
    assert got[sha("b")].keep_id is None and got[sha("b")].group_size == 1 and got[sha("b")].kept


def test_exact_dedup_plan_is_native(documents):
    plan = dedup.exact_dedup(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def texts_of(documents):
    return [r.text for r in documents.collect()]


def test_encode_matches_rank_library(table, documents):
    texts = ODD_TEXTS + texts_of(documents) + ["\x1c\x1d a\x85b  c　 d", "a \n b", "   lead", "\r\n\r\n x"]
    df = table(texts, extra=["ids"])
    got = {r.doc_id: r.ids for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    assert [got[i] for i in range(len(texts))] == [REAL.encode_ordinary(t or "") for t in texts]
    ids = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS).collect()}
    assert [back[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]
    trip = {r.doc_id: r for r in bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = REAL.encode_ordinary(t or "")
        assert tuple(trip[i])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), sha(t))


def test_small_cache_and_empty_table(table):
    codec = bpe.Codec(bpe.serialise_model(RANKS), public_tokenizers.PATTERN, cached=2)
    for text in ("one two three four", "two five six one", "", "one one one"):
        assert codec.encode(text) == REAL.encode_ordinary(text)
    assert bpe.encode(table([]), RANKS, public_tokenizers.PATTERN).count() == 0


def test_model_refuses_gaps():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})
