"""Agreement measures, clusterings and classifiers."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from demescope.operators import class_metrics, classify, cluster, cluster_metrics, contingency, distance, reduce, reshape, trees
from demescope.session import cut_lineage
from registry.catalogue import query, r6
from registry.cohort import numbered, regions, table

# --- agreement of two labellings (customers: region against a grouping of their keys) -----

PRED = """
with pred as (
  select n_regionkey as label, cast(c_custkey % 5 as int) as prediction, r_name, c_mktsegment
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), cells as (select label, prediction, count(*) as n from pred group by 1, 2),
a as (select label, sum(n) as n from cells group by 1), b as (select prediction, sum(n) as n, max(n) as top from cells group by 1),
s as (
  select (select sum(n) from cells) as n, (select sum(n * (n - 1) / 2.0) from cells) as c,
    (select sum(n * (n - 1) / 2.0) from a) as r, (select sum(n * (n - 1) / 2.0) from b) as k, (select sum(top) from b) as top
), t as (select *, n * (n - 1) / 2.0 as every from s)
"""


def customers(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("n_regionkey").alias("label"), (F.col("c_custkey") % 5).cast("int").alias("prediction"), "r_name", "c_mktsegment")


def cells(spark, sf):
    return contingency.confusion(customers(spark, sf))


@query("confusion", f"{PRED} select r_name as label, c_mktsegment as prediction, count(*) as n from pred group by 1, 2", base=False)
def confusion(spark, sf):
    return contingency.confusion(customers(spark, sf), "r_name", "c_mktsegment")


@query("confusion_matrix", f"""{PRED} select label, {", ".join(f"coalesce(sum(n) filter (where prediction = {i}), 0)::bigint as p{i}" for i in range(5))}
from cells group by label""", base=False)
def confusion_matrix(spark, sf):
    return contingency.confusion_matrix(cells(spark, sf), list(range(5))).toDF("label", *[f"p{i}" for i in range(5)])


@query("purity", f"{PRED} select round(top * 100.0 / n, 6) as purity from t", base=False)
def purity(spark, sf):
    return contingency.agreement(cells(spark, sf)).select(r6("purity").alias("purity"))


@query("rand_index", f"{PRED} select round((every + 2 * c - r - k) * 100.0 / every, 6) as ri from t", base=False)
def rand_index(spark, sf):
    return contingency.agreement(cells(spark, sf)).select(r6("ri").alias("ri"))


@query("adjusted_rand", f"{PRED} select round((c - r * k / every) / ((r + k) / 2.0 - r * k / every) * 100, 6) + 0.0 as ari from t", base=False)
def adjusted_rand(spark, sf):
    return contingency.agreement(cells(spark, sf)).select((r6("ari") + 0.0).alias("ari"))


REPORT = f"""{PRED}, rep as (
  select a.label, a.n as support, b.n as predicted, coalesce(c.n, 0) as hits from a join b on a.label = b.prediction
  left join cells c on c.label = a.label and c.prediction = a.label)"""


@query("class_report", f"""{REPORT} select cast(label as varchar) as label, cast(support as bigint) as support, cast(predicted as bigint) as predicted,
  cast(hits as bigint) as hits, round(hits * 100.0 / predicted, 6) as precision, round(hits * 100.0 / support, 6) as recall,
  round(hits * 200.0 / (support + predicted), 6) as f1, round(hits * 100.0 / support, 6) as ref_precision, round(hits * 100.0 / predicted, 6) as ref_recall from rep""", base=False)
def class_report(spark, sf):
    rates = ("precision", "recall", "f1", "ref_precision", "ref_recall")
    return class_metrics.class_report(cells(spark, sf)).select("label", "support", "predicted", "hits", *[r6(c).alias(c) for c in rates])


@query("macro_metrics", f"""{REPORT}, m as (
  select sum(support) as n, sum(hits) * 100.0 / sum(support) as accuracy, avg(hits * 100.0 / predicted) as precision, avg(hits * 100.0 / support) as recall,
    avg(hits * 200.0 / (support + predicted)) as f1, sum(support * hits * 200.0 / (support + predicted)) / sum(support) as wf1,
    sum(support * cast(predicted as double)) * 100.0 / sum(support) / sum(support) as expected from rep)
select cast(n as bigint) as n, round(100.0 - accuracy, 6) as error, round(accuracy, 6) as accuracy, round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1, 6) as f1, round(100.0 - wf1, 6) as f1_error, round((accuracy - expected) / (100.0 - expected), 6) + 0.0 as kappa from m""", base=False)
def macro_metrics(spark, sf):
    rates = ("error", "accuracy", "precision", "recall", "f1", "f1_error", "kappa")
    return class_metrics.macro_metrics(cells(spark, sf)).select("n", *[(r6(c) + 0.0).alias(c) for c in rates])


@query("multiclass_auc", f"""{PRED}, med as (select label, median(prediction) as m from pred group by 1), area as (
  select x.label as li, y.label as lj, sum(x.n * y.n * case when x.prediction < y.prediction then 1.0 when x.prediction = y.prediction then 0.5 else 0.0 end)
    / cast(sum(x.n * y.n) as double) as auc from cells x join cells y on x.label < y.label group by 1, 2)
select round(avg(case when p.m <= q.m then auc else 1.0 - auc end), 6) as auc from area join med p on p.label = li join med q on q.label = lj""", base=False)
def multiclass_auc(spark, sf):
    return class_metrics.multiclass_auc(cells(spark, sf)).select(r6("auc").alias("auc"))


@query("repeat_means", """
select l_linestatus as split, round(avg(l_discount), 6) as error, round(avg(l_tax), 6) as kappa from lineitem group by 1""", base=False)
def repeat_means(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("split"), F.col("l_linenumber").alias("repeat"), F.col("l_discount").alias("error"), F.col("l_tax").alias("kappa"))
    means = class_metrics.mean_metrics(rows, ["split"])
    return means.select("split", r6("error").alias("error"), r6("kappa").alias("kappa"))


# --- separation in feature space (embeddings with their label as the cluster) --------------

EMB = """
with e as (select vec_id, label, [cast(x as double) for x in embedding] as v from embeddings),
x as (select vec_id, label, i, v[i] as x from e, unnest(range(1, len(v) + 1)) u(i)),
c as (select label, i, avg(x) as m, count(*) as n from x group by 1, 2)
"""


def points(spark, sf):
    return distance.as_points(table(spark, sf, "embeddings"), "vec_id", "embedding", cluster="label")


@query("centroids", f"{EMB} select label as cluster, n, cast(i - 1 as int) as i, round(m, 6) + 0.0 as x from c", base=False)
def centroids(spark, sf):
    return cluster_metrics.centroids(points(spark, sf)).select("cluster", "n", F.posexplode("centre").alias("i", "x")).withColumn("x", r6("x") + 0.0)


@query("calinski_harabasz", f"""{EMB}, w as (select sum((x - m) * (x - m)) as w from x join c using (label, i)),
g as (select i, avg(x) as g from x group by 1), b as (select sum(n * (m - g) * (m - g)) as b from c join g using (i)),
k as (select count(distinct label) as k, count(*) as n from e)
select round((b / (k - 1.0)) / (w / (n - k)), 6) as ch from w, b, k""", base=False)
def calinski_harabasz(spark, sf):
    return cluster_metrics.calinski_harabasz(points(spark, sf)).select(r6("ch").alias("ch"))


@query("dunn_index", f"""{EMB}, d as (select a.label = b.label as same, list_distance(a.v, b.v) as d from e a join e b on a.vec_id < b.vec_id)
select round(min(d) filter (where not same) / max(d) filter (where same), 6) as dunn from d""", base=False)
def dunn_index(spark, sf):
    return cluster_metrics.dunn(points(spark, sf)).select(r6("dunn").alias("dunn"))


KNN = f"""{EMB}, d as (
  select a.vec_id as query_id, b.vec_id as id, b.label, a.label as truth, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as rank
  from e a join e b on a.vec_id <> b.vec_id
), ks as (select unnest(range(1, 11)) as k), votes as (
  select query_id, truth, k, label, count(*) as votes from d join ks on rank <= k group by 1, 2, 3, 4
), best as (select query_id, truth, k, label from votes qualify row_number() over (partition by query_id, k order by votes desc, label) = 1)
"""


def labelled_points(spark, sf):
    return distance.as_points(table(spark, sf, "embeddings"), "vec_id", "embedding", label="label")


@query("knn_errors", f"{KNN} select cast(k as int) as k, round(avg(cast(label <> truth as double)) * 100, 6) as error from best group by 1", base=False)
def knn_errors(spark, sf):
    return classify.knn_errors(labelled_points(spark, sf)).select("k", r6("error").alias("error"))


KNN_SPLIT = EMB + """, s as (select *, cast(('0x' || substr(md5(cast(vec_id as varchar) || ':1234'), 1, 8)) as bigint) / 4294967296.0 < 0.7 as tr from e), d as (
  select a.vec_id as query_id, b.label, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as rank
  from s a join s b on not a.tr and b.tr
), votes as (select query_id, label, count(*) as votes from d where rank <= 5 group by 1, 2)
select query_id, label as prediction from votes qualify row_number() over (partition by query_id order by votes desc, label) = 1"""


@query("knn_vote", KNN_SPLIT, base=False)
def knn_vote(spark, sf):
    train, test = reshape.split_rows(labelled_points(spark, sf), 0.7, key="id")
    return classify.knn_predict(train, test, 5).select("query_id", "prediction")


# --- clusterings of the cohort's components -----------------------------------------------


def components(spark, sf, k=4):
    """Sample components with labels, written out once for the model fits."""
    scores, _ = reduce.sample_pca(numbered(spark, sf), k)
    return cut_lineage(reduce.labelled(scores, regions(spark, sf)))


def clustered(name, fit):
    @query(name)
    def run(spark, sf):
        return fit(components(spark, sf)).select("sample_id", "region", F.col("prediction").cast("int").alias("prediction"))

    return run


clustered("kmeans", lambda df: cluster.kmeans(df, 5)[0])
clustered("kmeans_standardised", lambda df: cluster.kmeans(df, 5, init_mode="random", standardise=True)[0])
clustered("gaussian_mixture", lambda df: cluster.gaussian_mixture(df, 5)[0])
clustered("bisecting_kmeans", lambda df: cluster.bisecting_kmeans(df, 5)[0])
clustered("ward", lambda df: cluster.ward(df, 5))
clustered("ward_few_leaves", lambda df: cluster.ward(df, 5, leaves=40))
clustered("ward_kmeans", lambda df: cluster.ward_kmeans(df, 5))
clustered("em_clusters", lambda df: cluster.em_clusters(df, 5))


@query("tune_k")
def tune_k(spark, sf):
    return cluster.tune_k(components(spark, sf), "bkm", (2, 3, 4, 5), repeats=2)


@query("best_k")
def best_k(spark, sf):
    return cluster.best_k(cluster.tune_k(components(spark, sf), "kmeans", (2, 3, 4, 5)), "ari")


@query("cluster_summary")
def cluster_summary(spark, sf):
    df = components(spark, sf)
    found = {name: cut_lineage(fit(df, 5)) for name, fit in cluster.TUNED.items()}
    return cluster_metrics.summary_table({name: cluster_metrics.cluster_metrics(p) for name, p in found.items()})


# --- classifiers on the cohort's components ------------------------------------------------


def classified(name, fit):
    @query(name)
    def run(spark, sf):
        train, test = reshape.split_rows(components(spark, sf), 0.7)
        model = fit(train)
        return classify.predicted(model, test).select("sample_id", "region", "label", "prediction")

    return run


classified("svm_linear", lambda df: classify.svm(df, "linear"))
classified("svm_quadratic", lambda df: classify.svm(df, "quadratic"))
classified("svm_rbf", lambda df: classify.svm(df, "RBF"))
classified("decision_tree", lambda df: classify.decision_tree(df, maxDepth=6))
classified("decision_tree_cv", lambda df: classify.decision_tree(df, cv=True))
classified("random_forest", lambda df: classify.random_forest(df, numTrees=50))
classified("svm_linear_cv", lambda df: classify.svm_cv(df, folds=2, reg=(0.01, 0.1), intercept=(True,)))
classified("naive_bayes", classify.naive_bayes)
classified("linear_discriminant", lambda df: classify.discriminant(df))
classified("quadratic_discriminant", lambda df: classify.discriminant(df, quadratic=True))


@query("pruned_tree_search")
def pruned_tree_search(spark, sf):
    return trees.pruned_tree(components(spark, sf))[1]


@query("forest_report")
def forest_report(spark, sf):
    train, test = reshape.split_rows(components(spark, sf), 0.7)
    return trees.forest_report(train, test)[1]


@query("forest_importance")
def forest_importance(spark, sf):
    return classify.feature_importance(classify.random_forest(components(spark, sf), numTrees=500))


@query("svm_grid")
def svm_grid(spark, sf):
    return classify.svm_grid(components(spark, sf), "RBF", (1.0, 10.0), (1.0,), folds=2)


@query("train_test_errors")
def train_test_errors(spark, sf):
    return classify.train_test_errors(components(spark, sf))


@query("repeated_metrics")
def repeated_metrics(spark, sf):
    runs = classify.repeated_metrics(components(spark, sf), lambda df: classify.decision_tree(df, maxDepth=6), repeats=10)
    return class_metrics.mean_metrics(runs, ["split"])
