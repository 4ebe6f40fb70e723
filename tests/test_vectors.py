import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filtra.functions import vectors as V


def _one(spark, expr, a, b=None):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(expr).first()[0]


def test_inner_l2_cosine_match_numpy(spark):
    a = [0.5, -1.0, 2.0]
    b = [1.5, 0.25, -0.5]
    na, nb = np.array(a), np.array(b)
    assert _one(spark, V.inner_product("a", "b"), a, b) == pytest.approx(float(na @ nb))
    assert _one(spark, V.l2_distance("a", "b"), a, b) == pytest.approx(float(np.linalg.norm(na - nb)))
    cos = float(na @ nb / (np.linalg.norm(na) * np.linalg.norm(nb)))
    assert _one(spark, V.cosine("a", "b"), a, b) == pytest.approx(cos)


def test_zero_vector_cosine_and_normalize(spark):
    z = [0.0, 0.0, 0.0]
    assert _one(spark, V.cosine("a", "b"), z, [1.0, 2.0, 3.0]) == 0.0
    assert _one(spark, V.normalize("a"), z) == z


def test_normalize_unit_norm(spark):
    v = _one(spark, V.normalize("a"), [3.0, 4.0])
    assert math.isclose(math.hypot(*v), 1.0, rel_tol=1e-6)


def test_sparse_inner_product(spark):
    df = spark.createDataFrame([({"a": 1.0, "b": 2.0}, {"b": 3.0, "c": 5.0})],
                               "m1 map<string,double>, m2 map<string,double>")
    assert df.select(V.sparse_inner_product("m1", "m2")).first()[0] == 6.0
    empty = spark.createDataFrame([({}, {"b": 3.0})], "m1 map<string,double>, m2 map<string,double>")
    assert empty.select(V.sparse_inner_product("m1", "m2")).first()[0] == 0.0


def test_vector_literal_is_folded(spark):
    lit = V.vector_literal([0.1, 0.2, 0.3])
    df = spark.range(1).select(lit.alias("v"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower()
    assert df.first()["v"] == [0.1, 0.2, 0.3]


def test_unknown_metric_rejected():
    with pytest.raises(ValueError):
        V.score_expr("DOT", F.col("a"), F.col("b"))
