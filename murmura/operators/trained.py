"""A scorer fitted on labelled texts: hashed words and a sparse linear model."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmura.functions.constants import NEUTRAL
from murmura.functions.text import tokens
from murmura.operators.scoring import Scorer


def word_grams(text, pairs: bool = False):
    """The text's words, with ``pairs`` also its pairs of neighbouring words."""
    t = tokens(text)
    if not pairs:
        return t
    n = F.size(t)
    return F.concat(t, F.when(n > 1, F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1),
                                                lambda a, b: F.concat_ws(" ", a, b)))
                    .otherwise(F.array().cast("array<string>")))


def _without_summary(model, spark):
    """The fitted model written and read back.  The summary of a training with two
    labels holds the session, which goes to no task while an observation is open."""
    from murmura.session import work_dir
    path = work_dir(spark, "scorer")
    model.write().save(path)
    return type(model).load(path)


class TrainedScorer(Scorer):
    """Multinomial logistic regression over the presence of hashed words (and
    pairs of words), weighed by their rarity; words of under ``least`` training
    texts weigh nothing, and an L1 penalty leaves only telling words a weight.

    Fitting and applying run in the JVM (MLlib): gradients are summed in a tree
    of partial aggregates, and what the driver holds is ``features`` numbers a
    label, whatever the number of rows.  Rows without a text or a label are not
    learnt from.  With a single label the answer is that label; without any it
    is ``default``, as it is for a null text.
    """

    def __init__(self, labels: list[str], model=None, features: int = 1 << 16, pairs: bool = False,
                 default: str = NEUTRAL):
        self.labels, self.model, self.features, self.pairs, self.default = labels, model, features, pairs, default

    def _featured(self, df: DataFrame, text_col: str, grams: str, out: str) -> DataFrame:
        from pyspark.ml.feature import HashingTF
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        tf = HashingTF(inputCol=grams, outputCol=out, numFeatures=self.features, binary=True)
        return tf.transform(df.withColumn(grams, word_grams(text, self.pairs))).drop(grams)

    @classmethod
    def fit(cls, df: DataFrame, text_col: str, label_col: str, *, features: int = 1 << 16,
            pairs: bool = False, reg: float = 3e-3, least: int = 3, max_iter: int = 40, default: str = NEUTRAL) -> "TrainedScorer":
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import IDF
        rows = df.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")) \
                 .where("text IS NOT NULL AND label IS NOT NULL")
        labels = sorted(r["label"] for r in rows.select("label").distinct().limit(1001).collect())
        if len(labels) > 1000:
            raise ValueError("more than 1000 labels")
        scorer = cls(labels, None, features, pairs, default)
        if len(labels) < 2:
            return scorer
        y = (F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1).cast("double")
        x = scorer._featured(rows.withColumn("y", y), "text", "grams", "seen").select("seen", "y")
        x = x.persist(StorageLevel.MEMORY_AND_DISK)            # every step reads it
        try:
            rarity = IDF(inputCol="seen", outputCol="x", minDocFreq=least).fit(x)
            lr = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=reg,
                                    elasticNetParam=1.0, maxIter=max_iter, standardization=False)
            scorer.model = (rarity, _without_summary(lr.fit(rarity.transform(x)), df.sparkSession))
        finally:
            x.unpersist()
        return scorer

    def transform(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """``df`` with the answer in ``out_col``; every other column as it was."""
        if self.model is None:
            answer = F.lit(self.labels[0] if self.labels else self.default)
            return df.withColumn(out_col, F.when(F.col(text_col).isNull(), F.lit(self.default)).otherwise(answer))
        taken = {c.lower() for c in [*df.columns, out_col]}
        own = []
        for name in ("grams", "seen", "x", "raw", "prob", "pred"):     # names that the caller does not use
            while name in taken:
                name = "_" + name
            own.append(name)
        grams, seen, x, raw, prob, pred = own
        rarity, model = (m.copy() for m in self.model)
        for stage, param, name in ((rarity, "inputCol", seen), (rarity, "outputCol", x), (model, "featuresCol", x),
                                   (model, "rawPredictionCol", raw), (model, "probabilityCol", prob),
                                   (model, "predictionCol", pred)):
            stage.set(stage.getParam(param), name)
        told = model.transform(rarity.transform(self._featured(df, text_col, grams, seen)))
        label = F.element_at(F.array(*map(F.lit, self.labels)), F.col(pred).cast("int") + 1)
        return (told.withColumn(out_col, F.when(F.col(text_col).isNull(), F.lit(self.default)).otherwise(label))
                .drop(seen, x, raw, prob, pred))
