"""Quality rules as a short-circuit cascade, ordered by rejections per second on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from evitrust.llm.words import count_bytes, hash_strings, lines_of, mix, shingles, slices, words_of

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SAMPLE_DOCS = 2_000


class Texts:
    """A batch of texts and what is known of them so far; each part is computed when a rule first asks for it."""

    def __init__(self, texts: pa.Array):
        self.texts, self.n = texts, len(texts)

    @cached_property
    def words(self):
        return words_of(self.texts)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[1], minlength=self.n)

    @cached_property
    def word_chars(self) -> np.ndarray:
        words, owner = self.words
        return np.bincount(owner, np.asarray(pc.utf8_length(words)), minlength=self.n).astype(np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return count_bytes(self.texts, SYMBOLS)

    @cached_property
    def n_marks(self) -> np.ndarray:
        return count_bytes(self.texts, b"!?")

    @cached_property
    def lines(self):
        lines, owner = lines_of(self.texts)
        real = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0))
        return lines.filter(pa.array(real)), owner[real]

    @cached_property
    def n_lines(self) -> np.ndarray:
        return np.bincount(self.lines[1], minlength=self.n)

    @cached_property
    def n_dup_lines(self) -> np.ndarray:
        lines, owner = self.lines
        codes = np.asarray(lines.dictionary_encode().indices, dtype=np.int64)
        distinct = np.unique(owner * (codes.max(initial=0) + 1) + codes)
        return self.n_lines - np.bincount(distinct // (codes.max(initial=0) + 1), minlength=self.n)

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside windows of five words that the text holds twice or more."""
        words, owner = self.words
        keys, at = shingles(hash_strings(words), owner, WINDOW)
        keys = mix(keys ^ mix(owner[at].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(len(words) + WINDOW, np.int32)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        covered = np.cumsum(edge)[:len(words)] > 0
        return np.bincount(owner[covered], minlength=self.n)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return count_bytes(self.texts, bytes(range(65, 91)))

    @cached_property
    def n_lower(self) -> np.ndarray:
        return count_bytes(self.texts, bytes(range(97, 123)))


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` is true for it; ``fails`` sees a batch and gives one boolean a text."""

    name: str
    fails: Callable[[Texts], np.ndarray]


MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
RULES = (
    Rule("few_words", lambda t: t.n_words < MIN_WORDS),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > np.maximum(t.n_lines, 1)),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
    Rule("capitals", lambda t: t.n_upper > t.n_lower),
    Rule("marks", lambda t: 5 * t.n_marks > 2 * t.n_words),
)
BASE = ("few_words", "repeated_windows")


def estimate(docs: DataFrame, rules=RULES, text_col: str = "text", sample_docs: int = SAMPLE_DOCS,
             total: int | None = None) -> list[dict]:
    """Seconds per text and rejected share of each rule on about ``sample_docs`` texts, best rule first.

    The sample takes texts by a hash of the text. Every rule runs alone on it, with nothing computed before. Only one
    row for each rule and task reaches the driver. The order changes the time of a cascade, never its verdicts.
    """
    total = docs.count() if total is None else total
    share = min(1.0, sample_docs / max(total, 1))
    sample = docs.select(text_col)
    if share < 1:
        sample = sample.where(F.pmod(F.xxhash64(text_col), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            rows = []
            for rule in rules:
                start = time.thread_time()
                fails = rule.fails(Texts(batch.column(0)))
                rows.append((rule.name, time.thread_time() - start, batch.num_rows, int(fails.sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["rule", "seconds", "n", "rejected"])

    rows = sample.mapInArrow(run, "rule string, seconds double, n long, rejected long").groupBy("rule").agg(
        F.sum("seconds").alias("seconds"), F.sum("n").alias("n"), F.sum("rejected").alias("rejected")).collect()
    found = {r["rule"]: r for r in rows}
    out = []
    for rule in rules:
        r = found.get(rule.name)
        cost, rejected = (max(r["seconds"] / r["n"], 1e-9), r["rejected"] / r["n"]) if r else (1.0, 0.0)
        out.append({"rule": rule.name, "cost": cost, "selectivity": rejected, "gain": rejected / cost})
    return sorted(out, key=lambda x: (-x["gain"], x["cost"], x["rule"]))


def cascade(docs: DataFrame, rules=RULES, order: list[str] | None = None, id_col: str = "doc_id",
            text_col: str = "text", measures: bool = False) -> DataFrame:
    """Rows (id, rejected_by, n_rules, kept): each rule sees only the texts that passed all rules before it.

    ``order`` names the rules in the order to try; by default ``estimate`` finds it. n_rules counts the rules tried.
    ``measures`` adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every text,
    whatever rule stopped it; the rules then share what is computed. Null and empty texts have no words and fail
    few_words; repeated rows are judged one by one; columns other than id and text are ignored.
    """
    order = order or [x["rule"] for x in estimate(docs, rules, text_col)]
    named = {r.name: r for r in rules}
    chain = [named[n] for n in order]
    if len(chain) != len(named):
        raise ValueError("order must name every rule once")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            whole = Texts(batch.column(1))
            alive, stopped, tried = np.arange(whole.n), np.full(whole.n, -1), np.zeros(whole.n, np.int64)
            part = whole
            for i, rule in enumerate(chain):
                if not len(alive):
                    break
                tried[alive] += 1
                fails = rule.fails(part)[alive] if measures else rule.fails(part)
                if fails.any():
                    stopped[alive[fails]] = i
                    alive = alive[~fails]
                    if not measures:
                        part = Texts(whole.texts.take(pa.array(alive)))
            by = [chain[i].name if i >= 0 else None for i in stopped]
            columns = [batch.column(0), pa.array(by, pa.string()), pa.array(tried), pa.array(stopped < 0)]
            if measures:
                few = whole.n_words < MIN_WORDS
                columns += [pa.array(np.asarray(getattr(whole, n)).astype(np.int64)) for n in names]
                columns.append(pa.array(few | (100 * whole.n_repeat_words > MAX_REPEAT_PERCENT * whole.n_words)))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "rejected_by", "n_rules", "kept"]
                                             + (names + ["base_failed"] if measures else []))

    rows = docs.select(id_col, text_col)
    more = ", ".join(f"{n} long" for n in names) + ", base_failed boolean"
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, rejected_by string, n_rules long, "
                                f"kept boolean" + (", " + more if measures else ""))
