import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitehex.operators import atscale


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows, its values have a heavy tail and many copies."""
    rng = np.random.default_rng(7)
    big = np.round(rng.pareto(1.2, 90_000), 3)
    return pd.DataFrame(
        {
            "k": ["hot"] * 90_000 + ["warm"] * 25_000 + ["one"] + ["two"] * 2,
            "v": np.concatenate([big, rng.normal(size=25_000), [5.0], [1.0, 2.0]]),
        }
    )


@pytest.mark.parametrize("accuracy", [10_000, 1_000])
def test_exact_quantiles_match_linear_interpolation(spark, skewed, accuracy, monkeypatch):
    monkeypatch.setattr(atscale, "SKETCH_ACCURACY", accuracy)
    wanted = {"a": 0.05, "m": 0.5, "b": 0.95, "c": 0.999}
    got = {r.k: r for r in atscale.exact_quantiles(spark.createDataFrame(skewed), ["k"], "v", wanted, 4).collect()}
    for k, g in skewed.groupby("k"):
        for name, p in wanted.items():
            assert got[k][name] == pytest.approx(np.quantile(g.v, p), abs=1e-12), (k, name)


def test_quantiles_ignore_null_and_skip_empty_groups(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "k string, v double")
    rows = atscale.exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()
    assert [(r.k, r.m) for r in rows] == [("a", 2.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 11, 19, 20, 21, 99, 100, 101, 1000])
def test_quantiles_of_small_groups(spark, n):
    values = [float((i * 7919) % 1009) for i in range(n)]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    wanted = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 0.999, "f": 1.0}
    row = atscale.exact_quantiles(df, ["k"], "v", wanted).first()
    for name, p in wanted.items():
        assert row[name] == pytest.approx(np.quantile(values, p), abs=1e-9), name
    picked = atscale.exact_quantiles(df, ["k"], "v", {"p": 0.95}, None, lambda c, q: F.least(c - 1, F.floor(c * F.lit(q)))).first()
    assert picked.p == sorted(values)[min(n - 1, int(n * 0.95))]


def test_cut_lineage_is_a_written_table(spark):
    df = atscale.cut_lineage(spark.range(1234).where("id % 2 = 0"))
    assert df.count() == 617 and df.inputFiles()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        atscale.checkpoint_dir(Session())


def test_ranks_with_one_far_value_and_common_prefixes(spark):
    rows = [("l", 0.001 * (i % 50), f"way/{i:07d}") for i in range(20_000)] + [("l", 1e9, "way/far"), ("m", 1.0, "x")]
    df = spark.createDataFrame(rows, "layer string, d double, id string")
    got = {(r.layer, r.id): r.idx for r in atscale.range_ranks(df, ["layer"], ["d", "id"], "idx").collect()}
    want = {(k, i): n for n, (k, _, i) in enumerate(sorted(rows)[:-1])} | {("m", "x"): 0}
    assert got == want
    sizes = df.repartitionByRange(8, "layer", "d", "id").groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) <= 2 * len(rows) / len(sizes)


def test_constant_group(spark):
    df = spark.range(50_000).select(F.lit("a").alias("k"), F.lit(4.0).alias("v"))
    assert atscale.exact_quantiles(df, ["k"], "v", {"m": 0.95}).first().m == 4.0


@pytest.mark.parametrize("levels", [1, 2])
def test_bucketed_running_sum(spark, levels):
    pdf = pd.DataFrame({"k": ["x"] * 1000 + ["y"] * 10, "o": list(range(1000)) + list(range(10)), "f": [1, 0, 0, 1, 1] * 202})
    buckets = [F.floor(F.col("o") / 64), F.floor(F.col("o") / 8)][:levels]
    df = atscale.bucketed_running_sum(
        spark.createDataFrame(pdf).repartition(7), ["k"], buckets, [F.col("o").asc()], F.col("f"), "run"
    )
    got = df.toPandas().sort_values(["k", "o"])
    want = pdf.sort_values(["k", "o"]).groupby("k").f.cumsum()
    assert got.run.tolist() == want.tolist()
