from filtra.plans.catalog import QUERIES, register  # noqa: F401
from filtra.plans.oracle import ORACLE_SQL  # noqa: F401
