"""Walk-forward models and text classifiers."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("logit", "ridge", "ols")


def _standardised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, s = x.mean(0), x.std(0)
    return m, np.where(s > 0, s, 1.0)


def fit_logit(x: np.ndarray, y: np.ndarray, c: float = 0.01) -> np.ndarray:
    """Weights, constant first and not penalised: least of sum(log loss) + |w|^2 / 2c, by Newton's method."""
    a = np.column_stack((np.ones(len(x)), x))
    ridge = np.diag([0.0, *[1 / c] * x.shape[1]])
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.pinv((a * (p * (1 - p))[:, None]).T @ a + ridge) @ (a.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_ridge(x: np.ndarray, y: np.ndarray, penalties: Sequence[float] = tuple(10.0**k for k in np.arange(0, 6.5, 0.5)), folds: int = 5) -> np.ndarray:
    """Weights, constant first; the penalty with the best mean R2 over folds that each follow what they were fitted on."""

    def solve(a: np.ndarray, b: np.ndarray, lam: float) -> np.ndarray:
        m = a.mean(0)
        w = np.linalg.pinv((a - m).T @ (a - m) + lam * np.eye(a.shape[1])) @ (a - m).T @ (b - b.mean())
        return np.concatenate(([b.mean() - m @ w], w))

    size = len(x) // (folds + 1)
    best, most = penalties[0], -math.inf
    if size > 1:
        for lam in penalties:
            score = []
            for k in range(folds):
                start = len(x) - (folds - k) * size
                w = solve(x[:start], y[:start], lam)
                t = y[start : start + size]
                score.append(1 - ((t - w[0] - x[start : start + size] @ w[1:]) ** 2).sum() / max(((t - t.mean()) ** 2).sum(), 1e-300))
            if np.mean(score) > most:
                best, most = lam, np.mean(score)
    return solve(x, y, best)


def fit(kind: str, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if kind == "logit":
        return fit_logit(x, y)
    if kind == "ridge":
        return fit_ridge(x, y)
    if kind == "ols":
        return np.linalg.pinv(np.column_stack((np.ones(len(x)), x))) @ y
    raise ValueError(f"unknown kind of model: {kind}")


def walk_forward(df: DataFrame, by: Sequence[str], order: str, features: Sequence[str], target: str, kind: str, least: int = 250, refit: int = 21, clip: float = 0.01) -> DataFrame:
    """(by, order, pred, train_end) from row `least` on: each block of `refit` rows is predicted by a model of all rows before it.

    Rows with a null feature or target are left out first. For ridge and ols the target is cut at
    its clip and 1 - clip quantiles within the rows fitted on. A logit target is 0 or 1; blocks
    before which only one class was seen get no prediction. Features are standardised by the
    rows fitted on. A group is a series of days.
    """
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model: {kind}")
    names = list(features)
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        x, y = pdf[names].to_numpy(float), pdf[target].to_numpy(float)
        out = []
        for start in range(least, len(pdf), refit):
            a, b = x[:start], y[:start]
            if kind == "logit" and len(set(b)) < 2:
                continue
            if kind != "logit":
                b = np.clip(b, *np.quantile(b, [clip, 1 - clip]))
            m, s = _standardised(a)
            w = fit(kind, (a - m) / s, b)
            z = w[0] + (x[start : start + refit] - m) / s @ w[1:]
            part = pdf.loc[start : start + refit - 1, [*by, order]].copy()
            part["pred"] = 1 / (1 + np.exp(-z)) if kind == "logit" else z
            part["train_end"] = pdf[order][start - 1]
            out.append(part)
        return pd.concat(out) if out else pdf.loc[:-1, [*by, order]].assign(pred=0.0, train_end=None).iloc[:0]

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*by, order)) + f", pred double, train_end {kinds[order]}"
    return df.dropna(subset=[*names, target]).select(*dict.fromkeys([*by, order, *names, target])).groupBy(*by).applyInPandas(run, schema)


def char_ngrams(text: Column, lo: int = 1, hi: int = 3) -> Column:
    """The substrings of lo to hi characters, in order."""
    size = F.char_length(text)

    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(size >= n, every).otherwise(F.expr("cast(array() as array<string>)"))

    return F.concat(*[of(n) for n in range(lo, hi + 1)])


class TextClassifier:
    """Character n-grams, weighed by 1 + ln(tf) and ln((1 + n) / (1 + df)) + 1, and a balanced logistic regression."""

    def __init__(self, features: int = 200_000, least_docs: int = 3, c: float = 2.0) -> None:
        self.features, self.least_docs, self.c = features, least_docs, c
        self.vocabulary = self.weights = self.model = self.labels = None
        self.meta: dict = {}

    def _vectors(self, df: DataFrame, text: str) -> DataFrame:
        from pyspark.ml.linalg import VectorUDT

        grams = df.withColumn("__g", char_ngrams(F.coalesce(F.col(text), F.lit(""))))
        counted = self.vocabulary.transform(grams.withColumnRenamed("__g", "grams"))
        weights = self.weights
        return counted.withColumn("features", F.udf(lambda v: _weighted(v, weights), VectorUDT())("counts"))

    def fit(self, df: DataFrame, text: str, label: str) -> TextClassifier:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizer

        grams = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("__label"), F.col(text), char_ngrams(F.coalesce(F.col(text), F.lit(""))).alias("grams"))
        self.vocabulary = CountVectorizer(inputCol="grams", outputCol="counts", minDF=self.least_docs, vocabSize=self.features).fit(grams)
        per = grams.groupBy("__label").count().collect()  # a row per label
        self.labels = sorted(r["__label"] for r in per)
        n = sum(r["count"] for r in per)
        index = {w: i for i, w in enumerate(self.vocabulary.vocabulary)}
        seen = grams.select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").count().filter(F.col("count") >= self.least_docs)
        self.weights = np.ones(len(index))
        for r in seen.join(df.sparkSession.createDataFrame([(w,) for w in index] or [("",)], "g string"), "g").collect():  # at most `features` rows
            if r.g in index:
                self.weights[index[r.g]] = math.log((1 + n) / (1 + r["count"])) + 1
        balance = F.create_map(*[F.lit(x) for r in per for x in (r["__label"], n / (len(per) * r["count"]))])
        number = F.create_map(*[F.lit(x) for i, lab in enumerate(self.labels) for x in (lab, float(i))])
        rows = self._vectors(grams.drop("grams").withColumn("w", balance[F.col("__label")]).withColumn("y", number[F.col("__label")]), text).select("features", "y", "w").cache()
        self.model = LogisticRegression(featuresCol="features", labelCol="y", weightCol="w", regParam=1 / (self.c * n), elasticNetParam=0.0, standardization=False, maxIter=200).fit(rows)
        rows.unpersist()
        self.meta = {"n": n, "labels": self.labels, "features": len(index)}
        return self

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        """df with label and p_<label> for each label.

        Texts go to Python by Arrow batches, and only probabilities come back: no vector is made
        of a row. The vocabulary and its weights, at most `features` entries, are sent to each task.
        """
        k = len(self.labels)
        matrix, intercept = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        if len(matrix) < k:  # two labels have one margin
            matrix, intercept = np.vstack([np.zeros_like(matrix), matrix]), np.concatenate([np.zeros_like(intercept), intercept])
        words = self.vocabulary.vocabulary
        sent = df.sparkSession.sparkContext.broadcast(({w: i for i, w in enumerate(words)}, self.weights, matrix, intercept))

        def probabilities(texts: pd.Series) -> pd.Series:
            index, weights, coefficients, base = sent.value
            return pd.Series([_probabilities(t or "", index, weights, coefficients, base) for t in texts.fillna("")])

        p = df.withColumn("__p", F.pandas_udf(probabilities, "array<double>")(F.col(text)))
        names, best = F.array(*[F.lit(x) for x in self.labels]), F.array_position("__p", F.array_max("__p")).cast("int")
        return p.select(*df.columns, F.element_at(names, best).alias("label"), *[F.col("__p")[i].alias(f"p_{x}") for i, x in enumerate(self.labels)])

    def save(self, path: str) -> None:
        self.vocabulary.write().overwrite().save(f"{path}/vocabulary")
        self.model.write().overwrite().save(f"{path}/model")
        Path(path, "meta.json").write_text(json.dumps(self.meta | {"weights": self.weights.tolist(), "version": 1}))

    @classmethod
    def load(cls, path: str) -> TextClassifier:
        from pyspark.ml.classification import LogisticRegressionModel
        from pyspark.ml.feature import CountVectorizerModel

        at = Path(path, "meta.json")
        if not at.exists():
            raise FileNotFoundError(f"no model in {path}")
        meta = json.loads(at.read_text())
        if meta["version"] != 1:
            import warnings

            warnings.warn(f"the model in {path} is of version {meta['version']}", stacklevel=2)
        out = cls()
        out.vocabulary, out.model = CountVectorizerModel.load(f"{path}/vocabulary"), LogisticRegressionModel.load(f"{path}/model")
        out.weights, out.labels = np.array(meta.pop("weights")), meta["labels"]
        out.meta = {k: v for k, v in meta.items() if k != "version"}
        return out


def _weighted(v, weights: np.ndarray):
    from pyspark.ml.linalg import Vectors

    x = (1 + np.log(v.values)) * weights[v.indices]
    norm = np.sqrt((x * x).sum())
    return Vectors.sparse(v.size, v.indices, x / norm if norm else x)


def _probabilities(text: str, index: dict[str, int], weights: np.ndarray, coefficients: np.ndarray, base: np.ndarray) -> np.ndarray:
    """What the fitted model gives for one text: its n-grams counted, weighed and normed as _weighted does, and the classes' shares of the margins."""
    counts = Counter(i for n in (1, 2, 3) for a in range(len(text) - n + 1) if (i := index.get(text[a : a + n])) is not None)
    at = np.fromiter(counts, dtype=np.int64, count=len(counts))
    x = (1 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))) * weights[at]
    norm = np.sqrt((x * x).sum())
    margin = base + coefficients[:, at] @ (x / norm if norm else x)
    e = np.exp(margin - margin.max())
    return e / e.sum()


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """(label, precision, recall, f1, n) of each label, from the counts of label and prediction."""
    cells = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("a"), F.col(pred).alias("b")).agg(F.count("*").alias("n"))
    right = cells.filter("a = b").select(F.col("a").alias("label"), F.col("n").alias("tp"))
    actual = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("n"))
    said = cells.groupBy(F.col("b").alias("label")).agg(F.sum("n").alias("said"))
    j = actual.join(said, "label", "left").join(right, "label", "left").fillna(0, ["tp", "said"])
    p, r = F.col("tp") / F.nullif(F.col("said"), F.lit(0)), F.col("tp") / F.col("n")
    return j.select("label", F.coalesce(p, F.lit(0.0)).alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"), "n")


def time_split(df: DataFrame, order: str, share: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """df with train: whether a row is among the first share of its group by order, the number of them cut to a whole one."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order, *[c for c in df.columns if c not in (order, *by)])
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("train", F.row_number().over(w) <= F.floor(n * F.lit(share)))


def polarity(bull: Column, bear: Column, neither: Column) -> Column:
    """bull less bear, of probabilities; null where neither is the greatest."""
    return F.when(~((neither > bull) & (neither > bear)), bull - bear)


def lexicon_baseline(df: DataFrame, score: str, label: str, up: str = "bullish", down: str = "bearish") -> DataFrame:
    """(coverage, accuracy): the share of rows whose score has a sign, and of those the share whose label it is."""
    said = F.when(F.col(score) > 0, up).when(F.col(score) < 0, down)
    return df.filter(F.col(label).isNotNull()).agg(F.avg(said.isNotNull().cast("double")).alias("coverage"), F.avg((said == F.col(label)).cast("double")).alias("accuracy"))
