"""A small learning surface: training set, linear regression, evaluation, explanation, search."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.selection import exact_quantile
from millrace.registry import Tables, query

NUMERIC, CODED, LABEL = ["quantity", "price"], ["flag", "status"], "discount"
PENALTY = 0.01


def training_set(t: Tables) -> DataFrame:
    """Identifiers as text, rows without a price left out."""
    return t.lineitem.filter("l_extendedprice <> 0").select(
        F.col("l_suppkey").cast("string").alias("supplier"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias(LABEL)
    )


def pipeline(regression: LinearRegression | None = None, coded: list[str] = CODED) -> Pipeline:
    """Numbers centred and scaled, codes one-hot, and a linear regression."""
    index = StringIndexer(inputCols=coded, outputCols=[f"{c}_i" for c in coded], handleInvalid="keep", stringOrderType="alphabetAsc")
    one_hot = OneHotEncoder(inputCols=[f"{c}_i" for c in coded], outputCols=[f"{c}_v" for c in coded])
    numbers = VectorAssembler(inputCols=NUMERIC, outputCol="numbers")
    scaled = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)
    features = VectorAssembler(inputCols=["scaled", *(f"{c}_v" for c in coded)], outputCol="features")
    return Pipeline(stages=[*([index, one_hot] if coded else []), numbers, scaled, features, regression or LinearRegression(labelCol=LABEL, regParam=PENALTY)])


def feature_names(model: PipelineModel) -> list[str]:
    """The names of the features in the order of their coefficients; a code's value is named code=value."""
    index = next((stage for stage in model.stages if isinstance(stage, StringIndexerModel)), None)
    return NUMERIC + [f"{column}={value}" for column, values in zip(CODED, index.labelsArray if index else [], strict=False) for value in values]


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by a hash of the row."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(10))
    return df.filter(part < 8), df.filter(part >= 8)


def evaluate(predicted: DataFrame) -> DataFrame:
    """mae, mse, msle, median absolute error, r2 and explained variance."""
    y, p = F.col(LABEL), F.col("prediction")
    error = y - p
    total = F.var_pop(y)
    return predicted.agg(
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.avg(F.pow(F.log1p(F.greatest(p, F.lit(0.0))) - F.log1p(y), 2)).alias("msle"),
        F.median(F.abs(error)).alias("median_ae"),
        (1 - F.avg(error * error) / total).alias("r2"),
        (1 - F.var_pop(error) / total).alias("explained_variance"),
    )


def explain(model: PipelineModel, df: DataFrame, k: int = 3) -> DataFrame:
    """Per row the k features with the largest contributions (coefficient times value), by name."""
    weights, names = [float(w) for w in model.stages[-1].coefficients], F.array(*map(F.lit, feature_names(model)))
    values = vector_to_array("features")
    parts = F.zip_with(values, F.array(*map(F.lit, weights)), lambda v, w: v * w)
    named = F.transform(parts, lambda c, i: F.struct(F.abs(c).alias("size"), F.get(names, i).alias("feature"), c.alias("contribution")))
    return model.transform(df).select(*(c for c in df.columns if c in ("supplier", "row")), "prediction", F.slice(F.sort_array(named, asc=False), 1, k).alias("top_features"))


@query("ml_1_training_set", "ML-1", sql="SELECT l_suppkey::VARCHAR AS supplier, l_quantity AS quantity, l_extendedprice AS price, l_returnflag AS flag, l_linestatus AS status, l_discount AS discount FROM lineitem WHERE l_extendedprice <> 0")
def ml_training_set(t: Tables) -> DataFrame:
    return training_set(t)


@query(
    "ml_3_feature_info",
    "ML-3",
    sql="""SELECT 'quantity' AS feature, min(l_quantity)::DOUBLE AS low, max(l_quantity)::DOUBLE AS high, round(avg(l_quantity), 6)::DOUBLE AS mean, median(l_quantity)::DOUBLE AS median, round(stddev_samp(l_quantity), 6)::DOUBLE AS deviation, count(l_quantity)::BIGINT AS n FROM lineitem WHERE l_extendedprice <> 0
UNION ALL SELECT 'price', min(l_extendedprice), max(l_extendedprice), round(avg(l_extendedprice), 6), median(l_extendedprice), round(stddev_samp(l_extendedprice), 6), count(l_extendedprice) FROM lineitem WHERE l_extendedprice <> 0""",
)
def feature_info(t: Tables) -> DataFrame:
    df = training_set(t)
    long = df.select(F.explode(F.create_map(*(x for c in NUMERIC for x in (F.lit(c), F.col(c))))).alias("feature", "v"))
    found = exact_quantile(long, ["feature"], "v", low=F.min("v"), high=F.max("v"), mean=F.round(F.avg("v"), 6), deviation=F.round(F.stddev_samp("v"), 6), n=F.count("v"))
    return found.withColumnRenamed("quantile", "median")


@query("ml_2_4_evaluate", "ML-2", "ML-4")
def ml_evaluate(t: Tables) -> DataFrame:
    train, test = split(training_set(t))
    return evaluate(pipeline().fit(train).transform(test))


@query("ml_5_explain", "ML-5")
def ml_explain(t: Tables) -> DataFrame:
    train, test = split(training_set(t))
    return explain(pipeline().fit(train), test)


def numbered_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Numbers and label with a row's number, split by it."""
    rows = t.lineitem.filter("l_extendedprice <> 0").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias(LABEL))
    return rows.filter(F.col("row") * 7 % 10 < 8), rows.filter(F.col("row") * 7 % 10 >= 8)


#: The same ridge regression in closed form: two standardised features, the penalty over the label's deviation.
RIDGE = f"""WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q, l_extendedprice AS p, l_discount AS y FROM lineitem WHERE l_extendedprice <> 0),
m AS (SELECT avg(q) AS mq, avg(p) AS mp, avg(y) AS my, stddev_pop(q) AS sq, stddev_pop(p) AS sp, stddev_pop(y) AS sy, corr(q, p) AS r, corr(q, y) AS rq, corr(p, y) AS rp, 1 + {PENALTY} / stddev_pop(y) AS k
  FROM d WHERE id * 7 % 10 < 8),
b AS (SELECT *, (k * rq - r * rp) / (k * k - r * r) * sy / sq AS bq, (k * rp - r * rq) / (k * k - r * r) * sy / sp AS bp FROM m),
t AS (SELECT id, y, bq * (q - mq) AS cq, bp * (p - mp) AS cp, my + bq * (q - mq) + bp * (p - mp) AS f FROM d, b WHERE id * 7 % 10 >= 8)
"""


@query(
    "ml_2_4_ridge",
    "ML-2",
    "ML-4",
    sql=RIDGE
    + """SELECT round(avg(abs(y - f)), 7) AS mae, round(avg((y - f) ** 2), 7) AS mse, round(avg((ln(1 + greatest(f, 0)) - ln(1 + y)) ** 2), 7) AS msle, round(median(abs(y - f)), 7) AS median_ae,
  round(1 - avg((y - f) ** 2) / var_pop(y), 7) AS r2, round(1 - var_pop(y - f) / var_pop(y), 7) AS explained_variance FROM t""",
)
def ml_ridge(t: Tables) -> DataFrame:
    """The evaluation of a regression whose closed form SQL can state."""
    train, test = numbered_rows(t)
    measures = evaluate(pipeline(coded=[]).fit(train).transform(test))
    return measures.select(*(F.round(c, 7).alias(c) for c in measures.columns))


@query(
    "ml_5_explain_ridge",
    "ML-5",
    sql=RIDGE
    + """SELECT id AS row, round(f, 9) AS prediction, CASE WHEN abs(cq) > abs(cp) THEN 'quantity' ELSE 'price' END AS feature, round(CASE WHEN abs(cq) > abs(cp) THEN cq ELSE cp END, 9) AS contribution FROM t""",
)
def ml_explain_ridge(t: Tables) -> DataFrame:
    """Each prediction with the feature that moved it most."""
    train, test = numbered_rows(t)
    top = F.get("top_features", F.lit(0))
    return explain(pipeline(coded=[]).fit(train), test, 1).select("row", F.round("prediction", 9).alias("prediction"), top["feature"].alias("feature"), F.round(top["contribution"], 9).alias("contribution"))


#: Trials: weights of the absolute and of the squared penalty.
TRIALS = ((0.0, 0.0), (0.0, 0.1), (5.0, 1.0), (10.0, 10.0), (20.0, 0.1))


@query("ml_6_search", "ML-6")
def ml_search(t: Tables) -> DataFrame:
    """Regularisation by a validation split: five trials of absolute penalties up to 20 and squared ones up to 10."""
    train, _ = split(training_set(t))
    regression = LinearRegression(labelCol=LABEL, maxIter=20)
    grid = [{regression.regParam: l1 + l2, regression.elasticNetParam: l1 / (l1 + l2) if l1 else 0.0} for l1, l2 in TRIALS]
    tuned = TrainValidationSplit(estimator=pipeline(regression), estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=LABEL, metricName="mae"), trainRatio=0.8, seed=7, parallelism=2).fit(train)
    rows = [(l1, l2, float(m)) for (l1, l2), m in zip(TRIALS, tuned.validationMetrics, strict=True)]
    return t.spark.createDataFrame(rows, "l1 double, l2 double, mae double")


def successive_halving(train: DataFrame, valid: DataFrame, trials: list[tuple[float, float]], shares: tuple[float, ...] = (0.25, 0.5, 1.0)) -> list[tuple]:
    """rung, l1, l2, mae: all trials on a share of the rows, the better half of them on a larger one, and so on.

    A share is the same rows for every trial, and part of the next share. Of equal errors the smaller penalty goes on.
    """
    evaluator, place, out = RegressionEvaluator(labelCol=LABEL, metricName="mae"), F.pmod(F.xxhash64(*train.columns), F.lit(1000)), []
    for rung, share in enumerate(shares):
        some, scored = train.filter(place < int(1000 * share)).persist(), []
        try:
            for l1, l2 in trials:
                regression = LinearRegression(labelCol=LABEL, maxIter=20, regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 else 0.0)
                scored.append((float(evaluator.evaluate(pipeline(regression).fit(some).transform(valid))), l1, l2))
        finally:
            some.unpersist()
        out += [(rung, l1, l2, mae) for mae, l1, l2 in scored]
        trials = [(l1, l2) for _, l1, l2 in sorted(scored)[: -(-len(scored) // 2)]]
    return out


@query("ml_6_halving", "ML-6")
def ml_halving(t: Tables) -> DataFrame:
    """Trials over penalties of both kinds, halved from rung to rung."""
    train, test = split(training_set(t))
    return t.spark.createDataFrame(successive_halving(train, test, list(TRIALS)), "rung int, l1 double, l2 double, mae double")
