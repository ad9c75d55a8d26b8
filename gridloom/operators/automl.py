"""Model training and scoring on the Spark ML pipeline API."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.filters import distinct_counts
from gridloom.plans.ordered import with_position
from gridloom.plans.stacked import date_columns, numeric_columns, text_columns
from gridloom.session import settle

# Name words of continuous and of graded targets.
REGRESSION_WORDS = ["amount", "price", "revenue", "cost", "qty", "quantity", "total", "age", "salary", "income", "weight", "height", "size", "count",
                    "duration", "distance", "temperature"]
SCORE_WORDS = ["score", "rating", "rank", "satisfaction", "risk", "rate", "index", "nps", "grade"]
FOLDS, TREES, REPEATS = 5, 100, 5


def problem_types(df: DataFrame, targets: list[str]) -> DataFrame:
    """Classification or regression per target column, by kind, name and number of values."""
    texts = text_columns(df)
    has = lambda words, c: any(w in c.lower() for w in words)
    facts = df.agg(*[
        F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.lit(c in texts).alias("text"), F.lit(has(REGRESSION_WORDS, c)).alias("reg"),
                 F.lit(has(SCORE_WORDS, c)).alias("graded"),
                 (F.coalesce(F.bool_or(F.col(c) % 1 != 0), F.lit(False)) if c not in texts else F.lit(False)).alias("decimals")).alias(f"_{i}")
        for i, c in enumerate(targets)])
    long = facts.select(F.inline(F.array(*[f"_{i}" for i in range(len(targets))]))).join(F.broadcast(distinct_counts(df, targets)), "column", "left")
    k = F.coalesce("n_unique", F.lit(0))
    kind = (
        F.when(F.col("text"), "classification").when(F.col("reg"), "regression").when(F.col("graded") & (k <= 15), "classification")
        .when(~F.col("decimals") & (k <= 15), "classification").when((k / F.greatest("n", F.lit(1)) > 0.05) | (k > 20), "regression").otherwise("classification"))
    return long.select("column", "n", k.alias("n_unique"), kind.alias("problem_type"))


@dataclass
class Prepared:
    data: DataFrame
    numeric: list[str]
    categorical: list[str]
    problem: str
    notes: list[str] = field(default_factory=list)


def prepare(df: DataFrame, row_id: str, target: str) -> Prepared:
    """Rows with a target; without sparse (> 70 % missing), ID-like text and date columns."""
    rows = df.where(F.col(target).isNotNull())
    cols = [c for c in df.columns if c not in (row_id, target)]
    share = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    if share["n"] < 10:
        raise ValueError("at least 10 rows with a target are needed")
    keep = [c for c in cols if (share[c] or 0) <= 0.7]
    texts = [c for c in keep if c in text_columns(df)]
    ids = [r["column"] for r in distinct_counts(rows, texts).where(F.col("n_unique") == share["n"]).collect()] if texts else []
    dates = [c for c in keep if c in date_columns(df)]
    numeric = [c for c in keep if c in numeric_columns(df)]
    categorical = [c for c in texts if c not in ids]
    problem = problem_types(rows, [target]).first()["problem_type"]
    notes = [f"dropped {len(x)} {what} columns" for x, what in ((ids, "ID-like"), (dates, "date"), ([c for c in cols if c not in keep], "sparse")) if x]
    data = rows.select(row_id, target, *[F.col(c).cast("double").alias(c) for c in numeric], *[F.coalesce(F.col(c), F.lit("(missing)")).alias(c) for c in categorical])
    return Prepared(data, numeric, categorical, problem, notes)


def feature_stages(numeric: list[str], categorical: list[str]) -> list:
    stages, parts = [], []
    if numeric:
        stages += [Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__f" for c in numeric]),
                   VectorAssembler(inputCols=[f"{c}__f" for c in numeric], outputCol="_num"), StandardScaler(inputCol="_num", outputCol="_scaled", withMean=True)]
        parts.append("_scaled")
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep"),
                   OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__o" for c in categorical], handleInvalid="keep")]
        parts += [f"{c}__o" for c in categorical]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def split(df: DataFrame, row_id: str, label: str | None, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by hashed id; the hash also takes the class, so every class is cut at the same share."""
    u = F.pmod(F.xxhash64(F.col(row_id), *([F.col(label).cast("string")] if label else []), F.lit(seed)), F.lit(10_000)) / 10_000
    return df.where(u < share), df.where(u >= share)


def model_zoo(problem: str, classes: int = 2) -> dict:
    if problem == "regression":
        return {
            "Linear Regression": LinearRegression(labelCol="label"), "Ridge": LinearRegression(labelCol="label", regParam=1.0, elasticNetParam=0.0),
            "Random Forest": RandomForestRegressor(labelCol="label", numTrees=TREES, seed=42), "Gradient Boosting": GBTRegressor(labelCol="label", maxIter=50, maxDepth=3, seed=42)}
    gbt = GBTClassifier(labelCol="label", maxIter=50, maxDepth=3, seed=42)
    return {
        "Logistic Regression": LogisticRegression(labelCol="label", maxIter=100), "Ridge Classifier": LogisticRegression(labelCol="label", regParam=1.0, elasticNetParam=0.0),
        "Random Forest": RandomForestClassifier(labelCol="label", numTrees=TREES, seed=42),
        "Gradient Boosting": gbt if classes == 2 else OneVsRest(classifier=gbt, labelCol="label")}


@dataclass
class Trained:
    leaderboard: DataFrame
    best: PipelineModel
    best_name: str
    problem: str
    test: DataFrame
    labels: list[str] | None
    features: list[str]


def train_models(df: DataFrame, row_id: str, target: str, models: list[str] | None = None, folds: int = FOLDS) -> Trained:
    """Cross-validated candidates on 80 % of the rows, measured on the rest, best first."""
    p = prepare(df, row_id, target)
    labels = None
    if p.problem == "classification":
        labels = [r[0] for r in p.data.select(F.col(target).cast("string")).distinct().orderBy(F.col(target).cast("string")).limit(1001).collect()]
        if not 2 <= len(labels) <= 1000:
            raise ValueError("a classification target needs 2 to 1000 classes")
        data = p.data.withColumn("label", (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(target).cast("string")) - 1).cast("double"))
    else:
        data = p.data.withColumn("label", F.col(target).cast("double"))
    train, test = split(settle(data), row_id, target if labels else None)
    features = [*p.numeric, *p.categorical]
    if labels:
        metric = MulticlassClassificationEvaluator(labelCol="label", metricName="weightedFMeasure")
    else:
        metric = RegressionEvaluator(labelCol="label", metricName="r2")
    rows, fitted = [], {}
    for name, model in model_zoo(p.problem, len(labels or [])).items():
        if models and name not in models:
            continue
        pipe = Pipeline(stages=[*feature_stages(p.numeric, p.categorical), model])
        if folds > 1:
            cv = CrossValidator(estimator=pipe, estimatorParamMaps=ParamGridBuilder().build(), evaluator=metric, numFolds=folds, parallelism=4, seed=42).fit(train)
            fitted[name], cv_score, cv_std = cv.bestModel, float(cv.avgMetrics[0]), float(cv.stdMetrics[0])
        else:
            fitted[name], cv_score, cv_std = pipe.fit(train), None, None
        out = fitted[name].transform(test)
        if labels:
            ev = lambda m: MulticlassClassificationEvaluator(labelCol="label", metricName=m).evaluate(out)
            auc = BinaryClassificationEvaluator(labelCol="label").evaluate(out) if len(labels) == 2 and "rawPrediction" in out.columns else None
            rows.append((name, ev("accuracy"), ev("weightedFMeasure"), auc, None, None, None, cv_score, cv_std))
        else:
            ev = lambda m: RegressionEvaluator(labelCol="label", metricName=m).evaluate(out)
            rows.append((name, None, None, None, ev("rmse"), ev("r2"), ev("mae"), cv_score, cv_std))
    rows = [(r[0], *[None if v is None else float(v) for v in r[1:]]) for r in rows]
    schema = "name string, accuracy double, f1 double, auc double, rmse double, r2 double, mae double, cv_score double, cv_std double"
    board = df.sparkSession.createDataFrame(rows, schema)
    board = board.select("name", *[F.round(c, 4).alias(c) for c in board.columns[1:]]).orderBy(F.desc("cv_score"), "name")
    best = max(rows, key=lambda r: r[2] if labels else r[5])[0]
    return Trained(board, fitted[best], best, p.problem, test, labels, features)


def permutation_importance(model: Trained, row_id: str, repeats: int = REPEATS, top: int | None = None) -> DataFrame:
    """Mean loss of the metric when one column's values are moved to other rows: rows meet by their positions in two
    hashed orders, so no task holds the column. All features, or the ``top`` ones."""
    test = settle(model.test)
    score = (MulticlassClassificationEvaluator(labelCol="label", metricName="weightedFMeasure") if model.labels
             else RegressionEvaluator(labelCol="label", metricName="r2"))
    base = score.evaluate(model.best.transform(test))
    unit = lambda salt: F.pmod(F.xxhash64(F.col(row_id), F.lit(salt)), F.lit(2**50)).cast("double")
    home = settle(with_position(test.withColumn("_o", unit(0)), [], "_o", row_id, pos="_p").drop("_o"))
    losses: dict[str, float] = {c: 0.0 for c in model.features}
    for r in range(1, repeats + 1):
        other = settle(with_position(test.select(row_id, *model.features).withColumn("_o", unit(r)), [], "_o", row_id, pos="_p").drop("_o", row_id))
        for c in model.features:
            moved = home.drop(c).join(other.select("_p", c), "_p")
            losses[c] += (base - score.evaluate(model.best.transform(moved))) / repeats
    rows = sorted(losses.items(), key=lambda x: -abs(x[1]))[:top]
    return test.sparkSession.createDataFrame([(c, round(v, 4)) for c, v in rows], "feature string, importance double")


def confusion_matrix(model: Trained) -> DataFrame:
    return model.best.transform(model.test).groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def prediction_sample(model: Trained, row_id: str, n: int = 20) -> DataFrame:
    return score_rows(model.best, model.test, model.labels).orderBy(row_id).limit(n)


def score_rows(model: PipelineModel, df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Predictions of a fitted or loaded model, with the decoded label and the class confidence."""
    out = model.transform(df)
    if labels:
        out = out.withColumn("predicted", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1))
        if "probability" in out.columns:
            out = out.withColumn("class_confidence", F.round(F.array_max(vector_to_array("probability")), 4))
    else:
        out = out.withColumn("predicted", F.col("prediction"))
    keep = [c for c in df.columns] + ["predicted"] + (["class_confidence"] if "class_confidence" in out.columns else [])
    return out.select(*keep)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
