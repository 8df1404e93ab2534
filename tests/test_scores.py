import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import scoring


def one(spark, expr):
    return spark.range(1).select(expr.alias("r")).first()["r"]


def two(spark, judge, failed, reference):
    return one(spark, scoring.two_level(F.lit(1.0), F.lit(1.0), F.lit(judge), F.lit(failed), F.lit(reference), text_weight=0.0, image_weight=1.0))


def test_two_level_renormalizes_a_failed_judge_only(spark):
    assert two(spark, 0.0, True, 0.8) == pytest.approx(0.8)
    assert two(spark, None, True, 0.72) == pytest.approx(0.72)
    assert two(spark, 0.9, False, 0.0) == pytest.approx(0.09)


def test_judge_marks(spark):
    marks = {k: F.lit("10") for k in scoring.JUDGE_WEIGHTS} | {"semantic_consistency": F.lit("bad")}
    assert one(spark, scoring.judge_score(marks)) == pytest.approx(0.85)


def test_pairs(spark):
    a = F.array(*[F.lit(0.5)] * 6)
    assert one(spark, scoring.psnr(scoring.mse(a, a))) == 100.0
    assert one(spark, scoring.mse(a, F.array(F.lit(0.1)))) is None
    assert one(spark, scoring.pair_score(F.lit(100.0), F.lit(1.0))) == 1.0
    assert one(spark, scoring.three_image_score(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(True))) == 0.0


def test_local_ssim_against_loops(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random((9, 8, 3)), rng.random((9, 8, 3))
    pad = lambda a: np.pad(a, ((3, 3), (3, 3), (0, 0)))
    p, q, vals = pad(x), pad(y), []
    for i in range(9):
        for j in range(8):
            for c in range(3):
                a, b = p[i : i + 7, j : j + 7, c], q[i : i + 7, j : j + 7, c]
                ma, mb = a.sum() / 49, b.sum() / 49
                va, vb, cov = (a * a).sum() / 49 - ma * ma, (b * b).sum() / 49 - mb * mb, (a * b).sum() / 49 - ma * mb
                vals.append((2 * ma * mb + 1e-4) * (2 * cov + 9e-4) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4)))
    assert scoring.box_ssim(x, y) == pytest.approx(np.mean(vals))
    assert scoring.box_ssim(x, x) == pytest.approx(1.0)
    df = spark.createDataFrame([(x.ravel().tolist(), y.ravel().tolist(), 9, 8), (None, None, 9, 8)], "x array<double>, y array<double>, h int, w int")
    got = [r["r"] for r in df.select(scoring.local_ssim("x", "y", "h", "w").alias("r")).collect()]
    assert got[0] == pytest.approx(np.mean(vals)) and got[1] is None or np.isnan(got[1])


def test_divergence(spark):
    assert one(spark, scoring.k3_divergence(F.lit(-1.0), F.lit(-1.0))) == 0.0
    assert one(spark, scoring.clipped_objective(F.lit(0.0), F.lit(-1.0), F.lit(1.0))) == pytest.approx(1.2)
