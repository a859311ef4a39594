"""Resolution of names against a catalogue, and closest-name suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from evitrust.functions.names import DEFAULT_RULES, NameRules, identity_alias, parent_name

NAMES_PER_BLOCK = 1000


def catalogue_keys(catalogue: DataFrame, entry_id: str, preferred: str, synonyms: str, order: str,
                   rules: NameRules = DEFAULT_RULES, identity_aliases: bool = False) -> DataFrame:
    """Best catalogue entry per parent name: preferred names before synonyms, then catalogue order.

    Folding by parent name before any join keeps a parent shared by many entries from multiplying. Equal names are folded
    before that, so a parent name is made once for each distinct name, in the tasks that the names are dealt to.
    """
    names = catalogue.select(
        entry_id, order,
        F.explode(F.concat(
            F.array(F.struct(F.col(preferred).alias("resolved_name"), F.lit(0).alias("_m"), F.lit(0).alias("_s"))),
            F.transform(F.coalesce(F.col(synonyms), F.array().cast("array<string>")),
                        lambda x, i: F.struct(x.alias("resolved_name"), F.lit(1).alias("_m"), i.alias("_s"))),
        )).alias("n"),
    ).select(entry_id, order, "n.*").where(F.coalesce(F.trim("resolved_name"), F.lit("")) != "")
    key = parent_name(F.col("resolved_name"), rules)
    if identity_aliases:
        key = identity_alias(key, rules)
    first = names.groupBy("resolved_name").agg(
        F.min(F.struct("_m", F.col(order).alias("_o"), "_s", F.col(entry_id).alias("_id"))).alias("_first"))
    best = first.withColumn("query_parent", key).where(F.col("query_parent") != "").groupBy("query_parent").agg(
        F.min_by(F.struct(F.col("_first._id").alias(entry_id), "resolved_name", "_first._m"), "_first").alias("b"))
    return best.select(
        "query_parent", f"b.{entry_id}", "b.resolved_name",
        F.when(F.col("b._m") == 0, "pref_name").otherwise("synonym").alias("resolution_method"))


def resolve_names(queries: DataFrame, name: str, keys: DataFrame, rules: NameRules = DEFAULT_RULES,
                  identity_aliases: bool = False) -> DataFrame:
    """Each query row with its catalogue entry; unresolved rows keep nulls."""
    key = parent_name(F.col(name), rules)
    if identity_aliases:
        key = identity_alias(key, rules)
    return queries.withColumn("query_parent", key).join(keys, "query_parent", "left")


def _block_counts(candidates: DataFrame, name: str, per_block: int) -> tuple[DataFrame, DataFrame]:
    """Distinct names with their length, and how many blocks of about ``per_block`` names each length gets."""
    names = candidates.select(F.col(name).alias("cand")).where(F.col("cand") != "").distinct()
    names = names.withColumn("len", F.length("cand"))
    sizes = names.groupBy("len").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(per_block))).cast("int").alias("_k"))
    return names, sizes


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def closest_names(queries: DataFrame, query: str, candidates: DataFrame, candidate: str, k: int = 5,
                  cutoff: float = 0.6, names_per_block: int = NAMES_PER_BLOCK) -> DataFrame:
    """The k most similar candidate names of each distinct query name, exact, ties in name order.

    Candidates are packed into bounded arrays of equal-length names. A query meets only blocks whose length can reach
    the cutoff, under keys of (length, block), so the work of a frequent length is spread over its blocks. It keeps k
    names per block inside one expression (pairs never become rows), and the short lists are merged. A cutoff of zero
    visits every block. The similarity is 1 - edit distance / longer length.
    """
    names, sizes = _block_counts(candidates, candidate, names_per_block)
    sizes = F.broadcast(sizes)  # one row for each length of a name
    blocks = names.join(sizes, "len").groupBy("len", F.pmod(F.xxhash64("cand"), F.col("_k")).cast("int").alias("block")).agg(
        F.collect_list("cand").alias("cands"))
    q = queries.select(F.col(query).alias("query")).where(F.col("query") != "").distinct()
    n = F.length("query")
    reach = (F.least(n, F.col("len")) >= F.greatest(n, F.col("len")) * F.lit(float(cutoff)) - 1e-9)
    routed = q.join(sizes, reach).select("query", "len", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("block"))
    met = routed.join(blocks, ["len", "block"])
    scored = F.transform("cands", lambda c: F.struct((-levenshtein_similarity(F.col("query"), c)).alias("neg"), c.alias("cand")))
    short = F.slice(F.array_sort(F.filter(scored, lambda s: -s["neg"] >= cutoff)), 1, k)
    pairs = met.select("query", F.explode(short).alias("s")).select("query", "s.*")
    w = Window.partitionBy("query").orderBy("neg", "cand")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query", F.col("cand").alias("candidate"), (-F.col("neg")).alias("score"), "rank")
