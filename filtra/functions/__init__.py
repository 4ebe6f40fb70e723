from filtra.functions.vectors import (  # noqa: F401
    inner_product, l2_distance, cosine, l2_norm, normalize, sparse_inner_product,
    score_expr, higher_is_nearer, vector_literal, SCORE_SCALE,
)
from filtra.functions.hashing import md5_uniform  # noqa: F401
