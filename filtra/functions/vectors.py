"""Vector and sparse-vector scalar functions as Spark column expressions.

Everything here is a built-in higher-order expression (``zip_with``,
``aggregate``, ``map_zip_with``), so it runs inside whole-stage codegen with no
Python on the data path. Products are accumulated in double.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scores are rounded to this many decimals before ordering so that two
# engines (or the expression and the block kernel) that sum in a different
# order still agree on ranks; ties are then broken by ascending id.
SCORE_SCALE = 6


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _dsum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def inner_product(a, b) -> Column:
    """sum(a_i * b_i); higher is nearer."""
    return _dsum(F.zip_with(_col(a), _col(b),
                            lambda x, y: x.cast("double") * y.cast("double")))


def l2_distance(a, b) -> Column:
    """Euclidean distance; lower is nearer."""
    def sq(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d
    return F.sqrt(_dsum(F.zip_with(_col(a), _col(b), sq)))


def l2_norm(a) -> Column:
    return F.sqrt(_dsum(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b) -> Column:
    """Cosine similarity; 0 when either vector has norm 0."""
    na, nb = l2_norm(a), l2_norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(inner_product(a, b) / (na * nb))


def normalize(a) -> Column:
    """Divide by the L2 norm; a zero norm counts as 1 (the vector stays zero)."""
    n = l2_norm(a)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    return F.transform(_col(a), lambda x: (x.cast("double") / safe).cast("float"))


def sparse_inner_product(m1, m2) -> Column:
    """sum over shared keys of w1 * w2 for two map<key, weight> columns."""
    prod = F.map_zip_with(_col(m1), _col(m2),
                          lambda k, v1, v2: F.coalesce(v1.cast("double"), F.lit(0.0))
                          * F.coalesce(v2.cast("double"), F.lit(0.0)))
    return _dsum(F.map_values(prod))


def higher_is_nearer(metric: str) -> bool:
    m = metric.upper()
    if m not in ("IP", "L2", "COSINE"):
        raise ValueError(f"unknown metric {metric!r}")
    return m != "L2"


def score_expr(metric: str, vec, query) -> Column:
    """Rounded score of ``vec`` against ``query`` under ``metric``."""
    m = metric.upper()
    if m == "IP":
        s = inner_product(vec, query)
    elif m == "L2":
        s = l2_distance(vec, query)
    elif m == "COSINE":
        s = cosine(vec, query)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    return F.round(s, SCORE_SCALE)


def vector_literal(values: Sequence[float]) -> Column:
    """A foldable array<double> literal (one plan node, whatever the dimension)."""
    text = json.dumps([float(v) for v in values])
    return F.from_json(F.lit(text), "array<double>")
