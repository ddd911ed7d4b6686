"""Multiclass tree ensemble, importances, predictions (ML5-ML7, ML10).

The reference trains gradient-boosted trees with a single-machine library.
Spark's ``GBTClassifier`` is binary only, so the multiclass model here is
Spark ML's ``RandomForestClassifier`` (distributed training; results are not
meant to equal the reference's boosting).  Importances are the forest's
impurity importances scaled to a total of 100.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wideprep.operators._util import col
from wideprep.session import checkpoint_dir

SEED = 42


def train_forest(train: DataFrame, features, label: str, num_trees: int = 50, max_depth: int = 6,
                 seed: int = SEED) -> PipelineModel:
    """ML5: fit ``VectorAssembler`` + ``RandomForestClassifier`` (label: class index)."""
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees, maxDepth=max_depth,
                                seed=seed, probabilityCol="probability", predictionCol="prediction")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), rf])
    return pipe.fit(train.select(*[col(c) for c in features], col(label).cast("double").alias(label)))


def train_boosted(train: DataFrame, features, label: str, max_iter: int = 50, max_depth: int = 5,
                  step_size: float = 0.1, seed: int = SEED) -> PipelineModel:
    """ML5 alternative: boosted trees per class (``OneVsRest(GBTClassifier)``;
    Spark's GBT is binary only).  Each class model trains distributed."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    gbt = GBTClassifier(maxIter=max_iter, maxDepth=max_depth, stepSize=step_size, seed=seed)
    ovr = OneVsRest(classifier=gbt, parallelism=4, featuresCol="features", labelCol=label, predictionCol="prediction")
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), ovr])
    return pipe.fit(train.select(*[col(c) for c in features], col(label).cast("double").alias(label)))


def forest(model: PipelineModel):
    return model.stages[-1]


def _is_ovr(model: PipelineModel) -> bool:
    return hasattr(forest(model), "models")


def importances(model: PipelineModel, features, top: int | None = None) -> DataFrame:
    """ML6/JN3/SO2: ``feature, importance`` (total 100), descending; for the
    per-class boosted model the mean over the class models."""
    if _is_ovr(model):
        import numpy as np
        imp = np.mean([m.featureImportances.toArray() for m in forest(model).models], axis=0)
    else:
        imp = forest(model).featureImportances.toArray()
    total = float(imp.sum()) or 1.0
    rows = [(f, float(v) * 100.0 / total) for f, v in zip(features, imp)]  # one row per feature
    from pyspark.sql import SparkSession
    df = SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")
    df = df.orderBy(F.col("importance").desc(), "feature")
    return df.limit(top) if top else df


def predict(model: PipelineModel, df: DataFrame, keep=()) -> DataFrame:
    """ML7: ``*keep, prediction, probability (array<double>)``.  For the
    per-class boosted model the probability is each class model's logistic
    score ``1 / (1 + exp(-2 margin))``, normalised to sum 1."""
    out = model.transform(df)
    if _is_ovr(model):
        scores = F.transform(vector_to_array("rawPrediction"), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
        total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
        prob = F.transform(scores, lambda x: x / total)
    else:
        prob = vector_to_array("probability")
    return out.select(*[col(k) for k in keep], F.col("prediction").cast("int").alias("prediction"),
                      prob.alias("probability"))


def embedding_features(df: DataFrame, array_col: str, n: int, prefix: str = "f") -> DataFrame:
    """Flatten an array column of ``n`` elements into ``f0..f{n-1}``."""
    return df.select("*", *[F.col(array_col)[i].cast("double").alias(f"{prefix}{i}") for i in range(n)])


def end_to_end(df: DataFrame, key: str, target: str, numeric=None, categorical=None, test_share: float = 0.2,
               seed: int = SEED, hints: DataFrame | None = None, n_header: int = 0, fit_on: str = "all",
               stratify: bool = False, **training):
    """ML10: header promotion (``n_header`` > 0: the first rows by ``key`` name the other columns) -> classification (when the feature
    lists are not given: hints, then data heuristics, CL2) -> decimal comma -> scaling and one-hot -> split -> train -> importances.

    ``fit_on``: ``all`` fits scaling and categories on all rows, as the reference does, ``train`` on the training part only (a category
    that only the test part has becomes zeros).  ``stratify`` keeps the test share exact within every target value.  ``training`` goes to
    ``train_forest``.  Categories are indexed and encoded by ``StringIndexer`` and ``OneHotEncoder`` into sparse vectors.
    Returns ``(model, importances, scored_test, feature_names)``."""
    from wideprep.functions.text import decimal_comma_to_double
    from wideprep.operators import features as FE
    if n_header:
        from wideprep.plans import header as HD
        header, df = HD.header_table(df, key, n_header)
        given = [c for c in df.columns if c != key]
        named = HD.dedupe_names(HD.pick_names(header), "name", "col_idx")
        names = {r["col_idx"]: r["name"] for r in named.collect()}                # one name per column
        df = df.select(col(key), *[col(c).alias(names[i]) for i, c in enumerate(given)])
    if numeric is None or categorical is None:
        from wideprep.operators.classify import classify_features
        texts = {f.name for f in df.schema.fields if isinstance(f.dataType, StringType)}
        feats = df.drop(key, target)
        comma = r"^\s*[+-]?[0-9]*,[0-9]+\s*$"
        feats = feats.select(*[F.when(col(c).rlike(comma), F.replace(col(c), F.lit(","), F.lit("."))).otherwise(col(c)).alias(c)
                               if c in texts else col(c) for c in feats.columns])
        kinds = {r["column"]: r["kind"] for r in classify_features(feats, hints, use_patterns=False).collect()}
        numeric = [c for c in feats.columns if kinds[c] == "numerical"] if numeric is None else numeric
        categorical = [c for c in feats.columns if kinds[c] == "categorical"] if categorical is None else categorical
    # converted texts are written once: every later step reads numbers instead of parsing again
    checkpoint_dir(df.sparkSession)
    data = df.select(col(key), col(target).cast("int").alias(target), *[decimal_comma_to_double(col(c)).alias(c) for c in numeric],
                     *[FE.category_text(c).alias(c) for c in categorical]).checkpoint()
    split = FE.split_hash(data, key, test_share, seed, exact=stratify, stratify=target if stratify else None)
    fitted = split.where(F.col("split") == "train") if fit_on == "train" else split
    stages = []
    if categorical:
        coded, vectors = [f"_i{i}" for i in range(len(categorical))], [f"_v{i}" for i in range(len(categorical))]
        stages = [StringIndexer(inputCols=list(categorical), outputCols=coded, handleInvalid="keep", stringOrderType="alphabetAsc"),
                  OneHotEncoder(inputCols=coded, outputCols=vectors, dropLast=True, handleInvalid="keep")]
    encoder = Pipeline(stages=stages).fit(fitted)
    scaled = FE.standardize(encoder.transform(split), list(numeric), FE.fit_standard(fitted, list(numeric)))
    names = [f"num__{c}" for c in numeric]
    if categorical:
        for c, labels in zip(categorical, encoder.stages[0].labelsArray):
            names += [f"cat__{c}_{v}" for v in labels]
    ready = scaled.select(col(key), col(target), "split", *[col(c) for c in numeric], *([F.col(v) for v in vectors] if categorical else []))
    inputs = [*numeric, *(vectors if categorical else [])]
    model = train_forest(ready.where(F.col("split") == "train"), inputs, target, seed=seed, **training)
    return model, importances(model, names), predict(model, ready.where(F.col("split") == "test"), keep=(key, target)), names
