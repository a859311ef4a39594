"""Licence families of paragraphs: sparse word n-gram logistic regression, a calibrated unknown class, and a comparison
with the family's templates that confirms a prediction. DataFrame and Spark ML functions only.

A paragraph is a line, and every one is classified. Its features are the word n-grams (1 to 3) that a template holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evitrust.llm.license_templates import OTHER, TEMPLATES

UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *TEMPLATES]
SAMPLE_DOCS = 500       # documents whose lines show the classifier ordinary text, about
SAMPLE_CHARS = 100_000  # longer documents are not in that sample
JUDGE_STEPS = 15        # of the models that judge the sampled lines
WINDOW_WORDS = 7
CONFIRM = 0.6           # share of trigrams in common with a template


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def grams(tokens: str, n: int) -> Column:
    """The n-grams of an array column, in order; none if it is shorter."""
    return F.expr(f"if(size({tokens}) < {n}, cast(array() as array<string>), "
                  f"transform(sequence(0, greatest(size({tokens}) - {n}, 0)), i -> array_join(slice({tokens}, i + 1, {n}), ' ')))")


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later expressions and filters read and do not compute anew: a generator stands between."""
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def every_gram() -> Column:
    return F.concat(grams("words", 1), grams("words", 2), grams("words", 3))


def _featured(df: DataFrame) -> DataFrame:
    """Adds ``features`` (n-grams) and ``trigrams`` to a frame with ``words``; shorter paragraphs than three words have
    their whole sequence as the one trigram."""
    return _trigrams(df.withColumn("features", every_gram()))


def _trigrams(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "trigrams", F.when(F.size("words") < 3, F.array(F.array_join("words", " "))).otherwise(F.array_distinct(grams("words", 3))))


def templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(family).alias("family"), F.lit(i).alias("template"), F.lit(text).alias("text"))
            for family, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    return _featured(spark.range(1).select(F.inline(F.array(*rows))).withColumn("words", words(F.col("text"))))


@dataclass
class Model:
    vectors: CountVectorizerModel
    regression: LogisticRegressionModel
    least: float   # probability that a family needs


def training_rows(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Rows (family, words, features, trigrams, sampled): templates whole, without "the" and "license", and in windows of
    words, ordinary uses of the same words, and the lines of about ``sample_docs`` documents that share no trigram with
    any of those of a family."""
    spark = docs.sparkSession
    known = templates(spark)
    step = F.expr(f"transform(sequence(0, greatest(size(words) - {WINDOW_WORDS}, 0), 2), i -> slice(words, i + 1, {WINDOW_WORDS}))")
    brief = F.filter("words", lambda w: ~w.isin("the", "license"))  # as in 'Released under MIT'
    parts = known.select("family", F.explode(F.array_union(F.array("words", brief), step)).alias("words"))
    parts = _featured(parts)
    ambiguous = parts.groupBy("words").agg(F.countDistinct("family").alias("n")).where("n > 1").select("words")
    parts = parts.join(F.broadcast(ambiguous), "words", "left_anti").select("family", "words", "features", "trigrams")
    other = spark.range(1).select(F.explode(F.array(*map(F.lit, OTHER))).alias("text"))
    share = min(1.0, sample_docs / max(docs.count(), 1))
    picked = (F.pmod(F.xxhash64(text_col, F.lit("licence")), F.lit(1_000_000)) <= int(share * 1_000_000)) & (F.length(text_col) <= SAMPLE_CHARS)
    lines = docs.where(picked).select(F.explode(F.split(text_col, "\n")).alias("text"))
    both = other.withColumn("sampled", F.lit(False)).union(lines.withColumn("sampled", F.lit(True)))
    ordinary = _featured(both.withColumn("words", words(F.col("text")))).where(F.size("words") > 0)
    seen = sorted({g for r in parts.select("trigrams").collect() for g in r[0]})  # of the templates only
    ordinary = ordinary.where(~F.arrays_overlap(F.col("trigrams"), F.lit(seen)) | (F.size("words") < 3) | ~F.col("sampled"))
    return parts.withColumn("sampled", F.lit(False)).union(ordinary.select(F.lit(UNKNOWN), "words", "features", "trigrams", "sampled"))


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on four fifths of the learning rows; the rest sets the probability below which a paragraph is unknown.

    The learning rows are the templates' and a bounded sample of lines, whatever the size of the corpus. A sampled line may
    itself be a notice, and one that the corpus holds often would be learnt as unknown. So the lines are dealt into two
    halves by their features, a model that has learnt from one half judges the other, and lines in which it sees a family
    are left out; of those that stay, a line with any template n-gram counts once however often it stands there.
    """
    vocabulary = sorted({g for r in templates(docs.sparkSession).select("features").collect() for g in r[0]})
    rows = training_rows(docs, text_col, sample_docs).select(
        "family", "sampled", F.array_sort(F.array_intersect("features", F.lit(vocabulary))).alias("features"))
    rows = rows.withColumn("label", F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family")) - 1.0)
    often = F.when(F.col("sampled") & (F.size("features") > 0), F.lit(1)).otherwise(F.lit(20))
    rows = rows.groupBy("label", "features", "sampled").agg(F.count(F.lit(1)).alias("n")).withColumn("weight", F.least("n", often).cast("double"))
    rows = rows.coalesce(1).sortWithinPartitions("label", "features", "sampled").cache()
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="features", outputCol="vector", binary=True)
    regression = LogisticRegression(featuresCol="vector", weightCol="weight", family="multinomial", regParam=2e-4,
                                    elasticNetParam=0.3, maxIter=80)
    rough = regression.copy({regression.maxIter: JUDGE_STEPS})
    half = F.pmod(F.xxhash64("features", F.lit("half")), F.lit(2))
    judged = []
    for h in (0, 1):
        other = rough.fit(vectors.transform(rows.where(~F.col("sampled") | (half != h))))
        own = rows.where(F.col("sampled") & (half == h))
        judged.append(other.transform(vectors.transform(own)).where(F.col("prediction") == 0).select(*rows.columns))
    kept = rows.where(~F.col("sampled")).union(judged[0]).union(judged[1]).coalesce(1).sortWithinPartitions("label", "features").cache()
    held = F.pmod(F.xxhash64("features"), F.lit(5)) == 0
    first = regression.fit(vectors.transform(kept.where(~held)))
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1))
    sides = first.transform(vectors.transform(kept.where(held))).select("label", best.alias("p")).groupBy(F.col("label") > 0).agg(
        F.max("p").alias("high"), F.percentile("p", F.lit(0.05)).alias("low")).collect()
    found = {r[0]: r for r in sides}
    negative = found[False]["high"] if False in found else 0.0
    positive = found[True]["low"] if True in found else 1.0
    least = min(0.9, max(0.3, (negative + max(positive, negative)) / 2))
    model = Model(vectors, regression.fit(vectors.transform(kept)), float(least))
    kept.unpersist()
    rows.unpersist()
    return model


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM,
         every: bool = False) -> DataFrame:
    """Rows (id, line, paragraph, family, probability, template, similarity, confirmed) of paragraphs that name a licence.

    line counts from 0. probability is that of the likeliest family; below the calibrated least the paragraph is unknown.
    similarity is the largest share of trigrams that the paragraph has in common with a template of that family, of the
    smaller of both sets; a family is confirmed from ``confirm`` on. ``every`` also gives unknown paragraphs. Null and empty texts give no row, repeated rows each their own. Nothing is shuffled.
    """
    spark = docs.sparkSession
    lines = docs.select(
        F.col(id_col).alias(id_col), F.posexplode(F.split(text_col, "\n")).alias("line", "paragraph"))
    rows = _once(lines, "words", words(F.col("paragraph"))).where(F.size("words") > 0).withColumn("features", every_gram())
    judged = model.regression.transform(model.vectors.transform(rows))
    judged = _once(judged, "_p", F.slice(vector_to_array("probability"), 2, len(FAMILIES) - 1)).withColumn("_best", F.array_max("_p"))
    named = F.element_at(F.array(*map(F.lit, FAMILIES[1:])), F.array_position("_p", F.col("_best")).cast("int"))
    judged = judged.withColumn("family", F.when(F.col("_best") >= model.least, named).otherwise(UNKNOWN))
    judged = _trigrams(judged if every else judged.where(F.col("family") != UNKNOWN))
    shapes = templates(spark).groupBy("family").agg(F.array_sort(F.collect_list(F.struct("template", "trigrams"))).alias("_shapes"))
    same = F.expr("transform(_shapes, t -> struct(size(array_intersect(t.trigrams, trigrams)) / "
                  "least(size(t.trigrams), size(trigrams)) AS similarity, -t.template AS template))")
    out = judged.join(F.broadcast(shapes), "family", "left").withColumn("_near", F.array_max(same))
    out = out.select(id_col, "line", "paragraph", "family", F.col("_best").alias("probability"),
                     (-F.col("_near.template")).alias("template"), F.coalesce("_near.similarity", F.lit(0.0)).alias("similarity"))
    return out.withColumn("confirmed", F.col("similarity") >= confirm)
