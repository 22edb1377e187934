import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from demescope.functions import alleles as al
from demescope.operators import qc, reshape
from demescope.plans import stratify
from demescope.sources import readers, writers


def test_dosage_and_filters_on_odd_alleles(spark):
    rows = [
        (1, ["Alt", "Alt"]), (2, ["Alt", "Ref"]), (3, ["OtherAlt", "OtherAlt"]), (4, ["OtherAlt", "Alt"]),
        (5, ["Ref"]), (6, []), (7, None), (8, ["Alt", "Alt", "Alt"]),
    ]
    df = spark.createDataFrame(rows, "i int, alleles array<string>")
    got = {
        r["i"]: (r["a"], r["n"], r["k"])
        for r in df.select("i", al.dosage("alleles").alias("a"), al.dosage("alleles", "non_ref").alias("n"), al.has_known_allele("alleles").alias("k")).collect()
    }
    assert got[1] == (2, 2, True)
    assert got[2] == (1, 1, True)
    assert got[3] == (0, 2, False)
    assert got[4] == (1, 2, True)
    assert got[5][:2] == (0, 0)
    assert got[6][:2] == (0, 0)
    assert got[7][:2] == (None, None)
    assert got[8][:2] == (2, 3)
    with pytest.raises(ValueError):
        al.dosage("alleles", "other")


def test_unpack_orders_by_sample_and_splits_at_last_colon(spark):
    df = spark.createDataFrame([(["b:1", "a:x:2"],)], "g array<string>")
    got = df.select(al.unpack_genotypes("g").alias("g")).first()["g"]
    assert [(r["sample_id"], r["dosage"]) for r in got] == [("a:x", 2), ("b", 1)]


def calls(spark):
    rows = [
        ("a", "1", 10, "A", "C", ["Alt", "Ref"]), ("b", "1", 10, "A", "C", ["Ref", "Ref"]), ("c", "1", 10, "A", "C", ["Alt", "Alt"]),
        ("a", "1", 20, "A", "C", ["Alt", "Ref"]), ("b", "1", 20, "A", "G", ["Alt", "Alt"]),
        ("a", "2", 5, "AT", "C", ["Alt", "Ref"]), ("b", "2", 7, "A", "T", None),
    ]
    df = spark.createDataFrame(rows, "sample_id string, contig string, pos bigint, ref_allele string, alt_allele string, alleles array<string>")
    return df.withColumn("dosage", al.dosage("alleles"))


def test_variant_summary_rates(spark):
    got = {(r["pos"], r["alt_allele"]): r for r in qc.variant_summary(calls(spark)).collect()}
    assert len(got) == 4  # the two-base reference is gone
    r = got[(10, "C")]
    assert (r["nonmissing"], r["alt_count"], r["mean_dosage"], r["af"], r["maf"]) == (3, 3, 1.0, 0.5, 0.5)
    assert got[(7, "T")]["nonmissing"] == 0 and got[(7, "T")]["af"] is None
    assert qc.variant_summary(calls(spark), n_samples=6).filter("pos = 10").first()["missing_rate"] == 0.5


def test_biallelic_complete_and_bounds(spark):
    v = qc.variant_summary(calls(spark))
    assert {r["pos"] for r in qc.biallelic(v).collect()} == {10, 7}
    assert {r["pos"] for r in qc.complete(v, 3).collect()} == {10}
    assert {r["pos"] for r in qc.complete(v, 3, 0.67).collect()} == {10, 20}
    assert qc.frequency_between(v, 0.5, 1.0, "maf", "strict").count() == 0
    assert qc.frequency_between(v, 0.5, 1.0, "maf").count() == 2
    with pytest.raises(ValueError):
        qc.complete(v, 3, 1.5)
    with pytest.raises(ValueError):
        qc.frequency_between(v, 0, 1, "maf", "open")


def test_split_puts_null_with_the_failed(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    yes, no = qc.split_by(df, F.col("x") > 2)
    assert [r["x"] for r in yes.collect()] == [3]
    assert {r["x"] for r in no.collect()} == {1, None}


def test_dense_index_is_gap_free_over_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    got = reshape.dense_index(df, ["k"], "n").collect()
    assert all(r["k"] == r["n"] for r in got) and len(got) == 1000


@pytest.mark.parametrize("block", [4096, 1])
def test_sample_vectors_align_and_fill(spark, block):
    rows = [("a", 3, 2), ("a", 9, 1), ("b", 3, 0), ("c", 9, 2)]
    df = spark.createDataFrame(rows, "sample_id string, snp_idx bigint, dosage int")
    panel = spark.createDataFrame([("a", "X"), ("b", "Y")], "sample_id string, region string")
    got = {r["sample_id"]: (r["region"], list(r["features"])) for r in reshape.sample_vectors(df, panel, block=block).collect()}
    assert got == {"a": ("X", [2.0, 1.0]), "b": ("Y", [0.0, 1.5]), "c": ("Unknown", [1.0, 2.0])}
    zero = {r["sample_id"]: list(r["features"]) for r in reshape.sample_vectors(df, panel, "zero", block).collect()}
    assert zero["b"] == [0.0, 0.0]
    assert reshape.sample_vectors(df.limit(0), panel).count() == 0


def test_transpose_twice_is_identity(spark):
    rows = [(i, [i * 10 + j for j in range(4)]) for i in range(6)]
    df = spark.createDataFrame(rows, "i bigint, v array<bigint>")
    once = reshape.transpose_rows(df, "i", "v")
    back = reshape.transpose_rows(once, "col_no", "values")
    assert sorted((r["col_no"], list(r["values"])) for r in back.collect()) == rows
    blocks = reshape.transpose_rows(df, "i", "v", block=4)
    assert blocks.count() == 8


def test_splits_are_disjoint_whole_and_stable(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("sample_id"))
    a, b = reshape.split_rows(df, 0.7, seed=3)
    c, _ = reshape.split_rows(df.repartition(5), 0.7, seed=3)
    left = {r[0] for r in a.collect()}
    assert left == {r[0] for r in c.collect()}
    assert len(left) + b.count() == 500 and not left & {r[0] for r in b.collect()}
    assert 300 < len(left) < 400


def test_half_samples_differ_by_repeat(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("sample_id"))
    rows = reshape.half_samples(df, 3).collect()
    sizes = [sum(k in r["repeats"] for r in rows) for k in (1, 2, 3)]
    assert all(110 < s < 190 for s in sizes)
    assert len({tuple(r["repeats"]) for r in rows}) > 4


def test_wide_csv_and_parquet_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("a", "X", 1.0, 2.0), ("b", "Y", 0.0, None)], "SampleId string, Region string, `1:10` double, `1:20` double")
    wide.write.option("header", True).option("sep", ";").csv(str(tmp_path / "w.csv"))
    wide.write.parquet(str(tmp_path / "w.parquet"))
    back = readers.read_wide_csv(spark, str(tmp_path / "w.csv"))
    assert dict(back.dtypes)["1:10"] == "double" and back.count() == 2
    long = readers.read_wide_parquet(spark, str(tmp_path / "w.parquet"))
    assert {(r["SampleId"], r["variant_id"], r["value"]) for r in long.collect()} == {("a", "1:10", 1.0), ("a", "1:20", 2.0), ("b", "1:10", 0.0)}
    assert len(readers.first_feature_columns(wide, 1).columns) == 3
    assert len(readers.first_feature_columns(wide, 0).columns) == 4
    df = reshape.assemble(wide.na.fill(0.0))
    assert list(df.filter("sample_id = 'a'").first()["features"]) == [1.0, 2.0]


def test_prediction_sink(spark, tmp_path):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([Row(sample_id="a", region="X", prediction=1, label=0.0, features=Vectors.dense([1.0, 2.0]))])
    writers.write_predictions(df, str(tmp_path / "p"))
    got = spark.read.parquet(str(tmp_path / "p")).first()
    assert got["SampleId"] == "a" and got["features"] == [1.0, 2.0]
    writers.write_predictions(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first()["features"] == "1.0 2.0"
    assert writers.prediction_path("out", "pca", "", "kmeans") == "out_pca_kmeans"


def test_study_refuses_bad_options(spark):
    df = calls(spark)
    panel = spark.createDataFrame([("a", "X")], "sample_id string, region string")
    for bad in ({"missing_rate": 2}, {"ld_method": "d2"}, {"clustering": "dbscan"}, {"ld_max_bp": -1}, {"reduction": "tsne"}):
        with pytest.raises(ValueError):
            stratify.stratify(df, panel, **bad)
