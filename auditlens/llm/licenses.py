"""Licence scan: a trained classifier of paragraphs, a calibrated unknown class, and templates that confirm what it says.

Logistic regression over word n-grams (one and two words), sparse by its L1 penalty, is fitted on the labelled sample of
`license_templates`; the sample's size is its documented bound. Its n-grams are those of three rows of the sample or more. The weights
are a small table. A paragraph without any n-gram of positive weight for a licence family can only be unknown, so a regular
expression of these, taken from the weights, finds the paragraphs to be scored; all texts are searched in full. Scores are sums
within the row, over weights that an expression looks up by the n-gram's checksum, so that no paragraph is shuffled. Temperature and the least probability are set on held-out rows and on
notices of licences that the sample does not hold. A prediction counts when the paragraph shares enough two-word sequences with a
template of the predicted family, one that no other family's templates have among them.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.llm.common import cut, one_per_id
from auditlens.llm.license_templates import TEMPLATES, UNKNOWN, UNSEEN, labelled, short

PENALTY, ROUNDS = 0.0006, 60
CONFIRM = 0.6
LEAST_ROWS = 3
WRONG = 0.005


@dataclass
class Model:
    families: list[str]
    intercept: list[float]
    weights: str  # JSON: by checksum, lists of {"g": n-gram, "w": weights}
    trigger: str
    temperature: float = 1.0
    least: float = 0.5


def terms(text: Column) -> Column:
    """Words of letters and digits in lower case; a version such as 2.0 is one word."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+(?:\.[0-9]+)*"), F.lit(0))


def ngrams(words: Column) -> Column:
    """Single words and pairs of neighbours, each once."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))
    return F.array_distinct(F.concat(words, F.coalesce(pairs, F.array().cast("array<string>"))))


def pairs_of(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))))


def fit(spark: SparkSession) -> Model:
    """Fit on two thirds of the sample, calibrate on the rest."""
    rows = labelled() + short()
    families = [UNKNOWN, *TEMPLATES]
    schema = "text string, label double"
    train = spark.createDataFrame([(t, float(families.index(f))) for k, (t, f) in enumerate(rows) if k % 3], schema)
    tried = [(t, float(families.index(f))) for k, (t, f) in enumerate(rows) if k % 3 == 0] + [(t, 0.0) for t in UNSEEN]
    held = spark.createDataFrame([(k, *row) for k, row in enumerate(tried)], "id long, text string, label double")
    grams = cut(train.select("label", ngrams(terms(F.col("text"))).alias("grams")))
    known = grams.select(F.explode("grams").alias("gram")).groupBy("gram").count().where(F.col("count") >= LEAST_ROWS).orderBy("gram")
    vocabulary = [r.gram for r in known.select("gram").collect()]  # of the sample, not of the corpus
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    fitted = LogisticRegression(family="multinomial", elasticNetParam=1.0, regParam=PENALTY, maxIter=ROUNDS, standardization=False).fit(
        counter.transform(grams).select("label", "features"))
    table = fitted.coefficientMatrix.toArray()
    used = [(g, [float(x) for x in table[:, k]]) for k, g in enumerate(counter.vocabulary) if abs(table[:, k]).max() > 1e-6]
    lead = sorted({g for g, w in used if max(w[1:]) - w[0] > 0}, key=lambda g: (-len(g), g))
    single = {g for g in lead if " " not in g}
    lead = [g for g in lead if " " not in g or not single & set(g.split(" "))]  # a pair with such a word is found by it
    cells: list[list[dict]] = [[] for _ in range(4 * len(used) + 1)]
    for g, w in used:
        cells[zlib.crc32(g.encode()) % len(cells)].append({"g": g, "w": w})
    model = Model(families, [float(x) for x in fitted.interceptVector], json.dumps(cells),
                  r"(?i)(?<![\p{L}\p{Nd}])(?:" + "|".join(r"[^\p{L}\p{Nd}]+".join(map(re.escape, g.split(" "))) for g in lead) + r")(?![\p{L}\p{Nd}])")
    return _calibrated(model, [(r.label, r.scores) for r in _scores(held, model, ["id", "label"]).select("label", "scores").collect()])


def _calibrated(model: Model, held: list[tuple[float, list[float]]]) -> Model:
    """The temperature with the least log loss on held-out rows, then the least probability that lets at most WRONG of the rows of
    no licence, or of another one, through."""
    def probabilities(scores: list[float], t: float) -> list[float]:
        top = max(scores)
        e = [math.exp((s - top) / t) for s in scores]
        return [x / sum(e) for x in e]

    grid = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0]
    model.temperature = min(grid, key=lambda t: -sum(math.log(max(1e-12, probabilities(s, t)[int(y)])) for y, s in held))
    wrong = []
    for y, s in held:
        p = probabilities(s, model.temperature)
        best = max(range(1, len(p)), key=p.__getitem__)
        if best != int(y):
            wrong.append(p[best])
    wrong.sort(reverse=True)
    allowed = int(WRONG * len(held))
    model.least = max(0.5, wrong[allowed] + 1e-9 if allowed < len(wrong) else 0.5)
    return model


def _scores(paragraphs: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """Paragraphs (keys, text) as keys, terms and a score per family."""
    cells, n = F.from_json(F.lit(model.weights), "array<array<struct<g:string,w:array<double>>>>"), len(json.loads(model.weights))
    split = paragraphs.withColumn("terms", terms(F.col("text")))
    held = F.flatten(F.transform(ngrams(F.col("terms")), lambda x: F.filter(
        F.get(cells, (F.crc32(x.cast("binary")) % n).cast("int")), lambda e: e["g"] == x)))
    score = F.aggregate(held, F.array(*map(F.lit, model.intercept)), lambda acc, e: F.zip_with(acc, e["w"], lambda a, b: a + b))
    return split.select(*keys, "terms", F.explode(F.array(score)).alias("scores"))  # so that a filter does not compute it again


def license_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, line, family, probability, likeness, confirmed) of paragraphs that the classifier gives to a family.

    A paragraph is a line. NULL and empty texts have none; rows that repeat an id are one document, with the greatest text. Further
    columns are not looked at. Equal scores go to the family that is listed first. Likeness is the share of two-word sequences,
    of the paragraph or of the template, whichever has fewer, that both have; it is the best over the family's templates.
    """
    model = model or fit(docs.sparkSession)
    source = one_per_id(docs.select("doc_id", "text"), "doc_id", "text")
    lines = source.where(F.col("text").rlike(model.trigger)).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    lines = lines.where(F.col("text").rlike(model.trigger)).withColumn("doc_id", F.struct("doc_id"))
    scored = _scores(lines, model, ["doc_id", "line"])
    scaled = F.transform("scores", lambda s: F.exp((s - F.array_max("scores")) / F.lit(model.temperature)))
    known = F.slice("scores", 2, len(model.families) - 1)
    best = F.array_position(known, F.array_max(known)).cast("int")
    said = scored.withColumn("e", scaled).withColumn("best", best).select(
        "doc_id", "line", "terms", F.get(F.array(*map(F.lit, model.families)), F.col("best")).alias("family"),
        (F.get("e", F.col("best")) / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias("probability"))
    said = said.where(F.col("probability") >= model.least).where(F.size("terms") > 1)
    rows = [(f, list(texts), [t for g, other in TEMPLATES.items() if g != f for t in other]) for f, texts in TEMPLATES.items()]
    pairs = lambda name: F.transform(name, lambda t: pairs_of(terms(t)))
    known_by = docs.sparkSession.createDataFrame(rows, "family string, templates array<string>, others array<string>").select(
        "family", pairs("templates").alias("templates"), F.flatten(pairs("others")).alias("elsewhere"))
    own = pairs_of(F.col("terms"))
    # What stands in the templates of this family alone; "licensed under the" fits any of them.
    shared = F.array_except(F.array_intersect(F.col("own"), F.flatten("templates")), F.col("elsewhere"))
    like = F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(F.col("own"), t)) / F.least(F.size("own"), F.size(t))))
    confirmed = said.withColumn("own", own).join(known_by, "family").withColumn("likeness", like).withColumn("telling", F.size(shared) > 0)
    return confirmed.select("doc_id.doc_id", "line", "family", "probability", "likeness", ((F.col("likeness") >= CONFIRM) & F.col("telling")).alias("confirmed"))


def license_verdicts(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Rows (doc_id, licenses, n_paragraphs, n_unconfirmed): confirmed families by name, comma-joined, for every document."""
    found = license_paragraphs(docs, model).groupBy("doc_id").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("licenses"),
        F.count(F.when(F.col("confirmed"), 1)).alias("n"), F.count(F.when(~F.col("confirmed"), 1)).alias("m")).withColumnRenamed("doc_id", "_id")
    ids = one_per_id(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id")
    zero = F.lit(0).cast("long")
    return ids.join(found, ids.doc_id.eqNullSafe(F.col("_id")), "left").select(
        "doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n", zero).alias("n_paragraphs"), F.coalesce("m", zero).alias("n_unconfirmed"))
