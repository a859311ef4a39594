"""One query for each operator over whole tables, with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evitrust.llm import (bin_completion, blocked_search, deleted_interpolation, hash_ring, language_id, license_scan, line_crf, progressive_dedup,
                          recompressed_runs, rule_cascade, sentencepiece_bpe, signature_tree, winnow_lines)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = deleted_interpolation.score(docs, remainder(10) != 0)
    return scored.withColumn("held_out", F.coalesce(remainder(10) == 0, F.lit(False)))


def op2_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return rule_cascade.cascade(docs, measures=True).drop("n_rules")


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``divisor``: the folds that keep held-out rows out of learning."""
    return F.crc32(F.col(id_col).cast("string")) % divisor


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.train(docs))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs, remainder(4) != 2)
    return language_id.predict(docs, model).withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))


def op5_sentencepiece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    ranks = sentencepiece_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return sentencepiece_bpe.round_trip(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op6_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.similar_documents(_table(spark, sf_dir, "documents"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = line_crf.train(docs, _table(spark, sf_dir, "labels"), remainder(5) != 0)
    return line_crf.predict(docs, model).withColumn("held_out", F.coalesce(remainder(5) == 0, F.lit(False)))


def op8_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = _table(spark, sf_dir, "documents")
    return bin_completion.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)


def op9_progressive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progressive_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op10_winnow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = winnow_lines.dedup_lines(_table(spark, sf_dir, "documents"), every_place=True)
    return done.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op11_hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = hash_ring.shard(_table(spark, sf_dir, "documents"), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_periods(docs: DataFrame) -> DataFrame:
    """Texts, of which one in ten by crc32 of the id goes on periodically from some word on. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        at = F.struct(F.pmod(F.floor(h / 10), n).alias("a"))
        at = at.withField("p", 1 + F.floor((n - at.a) / (3 + F.floor(h / 10) % 8)))
        where = F.transform(F.array(at), lambda x: F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p)))[0]
        return F.when(n > 0, F.concat_ws(" ", F.transform(where, lambda i: w[i.cast("int")]))).otherwise("")

    changed = F.transform(F.array(words), periodic)[0]      # the words are taken out once
    return docs.select("doc_id", F.when(h % 10 == 0, changed).otherwise(text).alias("text"))


def op12_recompressed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = recompressed_runs.collapse_runs(_with_periods(_table(spark, sf_dir, "documents")))
    better = lambda x, y: (x.length * y.period > y.length * x.period)  # noqa: E731, runs stand by start, then period
    top = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, x: F.when(better(x, best), x).otherwise(best))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", *(x[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    done = done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, top).alias("top"),
                       F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return done.select("doc_id", "n_runs", *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
                       F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_deleted_interpolation, op2_rule_cascade, op3_license_scan, op4_language_id, op5_sentencepiece_bpe, op6_signature_tree,
    op7_line_crf, op8_bin_completion, op9_progressive_dedup, op10_winnow_lines, op11_hash_ring, op12_recompressed_runs, op13_blocked_search)}

ORACLES = {
    "op9_progressive_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op13_blocked_search": r"""
        WITH said AS (
            SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        asked AS (
            SELECT item_id, unnest(list_distinct(regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
        sizes AS (SELECT place, doc_id, len(terms) AS n FROM said),
        totals AS (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
        hits AS (
            SELECT place, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT place, unnest(terms) AS term FROM said)
            WHERE term IN (SELECT term FROM asked) GROUP BY place, term),
        weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM hits, totals GROUP BY term, docs),
        scored AS (
            SELECT item_id, doc_id, place, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
            FROM asked JOIN hits USING (term) JOIN weights USING (term) JOIN sizes USING (place), totals
            GROUP BY item_id, doc_id, place),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, place) AS rank, doc_id, score
            FROM scored WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
