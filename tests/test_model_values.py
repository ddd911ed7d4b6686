"""Importances, probabilities and contributions where only one feature says anything."""

from pyspark.sql import functions as F

from wideprep.operators import explain as EX
from wideprep.operators import model as MD


def test_values_name_the_only_telling_feature(spark):
    rows = [(i, float(i % 10), float((i * 7) % 11), int(i % 10 >= 5)) for i in range(220)]
    df = spark.createDataFrame(rows, "id long, told double, noise double, label int")
    model = MD.train_forest(df, ["told", "noise"], "label", num_trees=8)
    imp = {r["feature"]: r["importance"] for r in MD.importances(model, ["told", "noise"]).collect()}
    assert imp["told"] > 90 and abs(sum(imp.values()) - 100) < 1e-9
    made = {r["id"]: r for r in MD.predict(model, df, keep=("id", "label")).collect()}
    assert sum(r["prediction"] == r["label"] for r in made.values()) >= 218
    long = EX.explain(MD.forest(model), df, "id", ["told", "noise"], "label")
    first = {int(r["row_key"]): r for r in EX.explain_topk(long, 1).collect()}
    assert sum(r["feature_name"] == "told" and r["shap_value"] > 0 for r in first.values()) >= 210
    sums = long.where("class = 1").groupBy("row_key").agg((F.sum("shap_value") + F.first("base_value")).alias("p")).collect()
    assert all(abs(r["p"] - made[int(r["row_key"])]["probability"][1]) < 1e-9 for r in sums)
    mean = {(r["feature_name"], r["class"]): r["mean_abs_shap"] for r in EX.explain_global(long).collect()}
    assert mean[("told", 1)] > 5 * mean[("noise", 1)] > 0 or mean[("noise", 1)] == 0


def test_defaults_are_the_library_s_own(spark):
    import inspect
    forest, boosted = (inspect.signature(f).parameters for f in (MD.train_forest, MD.train_boosted))
    assert (forest["num_trees"].default, forest["max_depth"].default, boosted["max_iter"].default) == (50, 6, 50)
