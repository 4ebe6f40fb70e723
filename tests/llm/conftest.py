import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

sys.path.insert(0, os.path.join(ROOT, "tests", "llm"))

from made_texts import SCHEMA, prose  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    shared = prose(900, 60)
    near = prose(901, 120).split()
    rows = [
        (0, None, "en", "a"), (1, "", None, None), (2, " \n\t ", "en", None), (None, "x y", None, "a"),
        (None, "x y", None, "a"), (3, "one two three", "en", "a"), (4, "one two three", "en", "a"),
        (4, "one two three", "en", "a"), (5, prose(5, 40000), "en", "a"), (6, "a" * 30000, "en", "a"),
        (7, " ".join(near), "en", "b"), (8, " ".join(near[:-2] + ["other", "end"]), "en", "b"),
        (9, " ".join(near[:60] + ["cut"] + near[60:]), "en", "b"),
        (10, prose(10, 80) + " " + shared + " " + prose(11, 50), "de", "b"),
        (11, prose(12, 30) + " " + shared + " " + prose(13, 90), "de", "b"),
        (12, "again and " * 40, "en", "b"), (13, "\n".join(["same line of words here"] * 12), "en", "b"),
        (14, "### $$$ %%% " * 30 + prose(14, 30), "en", "b"), (15, "É ß ñ 日本 😀 " * 10, "fr", "b"),
        (16, "mail a.b@c.de, 10.0.0.1, 4111 1111 1111 1111, +1 (212) 555-0100 " + prose(16, 30), "en", "b"),
    ]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "clash", 1) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def spark():
    from filtra.session import build_session
    return build_session("local[4]", shuffle_partitions=4)
