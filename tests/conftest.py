import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from filtra.session import build_session
    s = build_session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def chunks(spark):
    from filtra.sources.tables import chunks_view
    from testdirs import SF_SMALL
    return chunks_view(spark, SF_SMALL)


@pytest.fixture(scope="session")
def chunk_rows(chunks):
    return [r.asDict() for r in chunks.select("id", "kbId", "site", "study", "embedding").collect()]
