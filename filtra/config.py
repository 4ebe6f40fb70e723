"""Defaults of the retrieval workload.

Fixed values: these must equal the workload this engine re-implements so that
results line up (pool sizes, formats, ranker constants, BM25 constants).
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -----------------------------------------------------------
KB_CARD = 10
STUDY_CARD = 30
SITE_CARD = 30
PATIENT_CARD = 30
VISIT_CARD = 30
ZIPF_ALPHA = 1.0
CHUNKS_PER_DOC_MIN = 20
CHUNKS_PER_DOC_MAX = 500
CONTENT_LENGTH = 256
DIM = 3072
SPARSE_VOCAB = 30000
SPARSE_NNZ_ROW = 64
SPARSE_NNZ_QUERY = 32
RRF_K = 60
WEIGHT_DENSE = 1.0
WEIGHT_SPARSE = 1.0
TOP_K = 10
IVF_NLIST = 4096
IVF_NPROBE = 16
NUM_PARTITIONS = 16
SEED = 42
QUERY_SEED = 43
PREDICATE_SEED = 44
CONCURRENCY_LEVELS = (1, 4, 16, 32)
SAMPLE_EVERY = 50
COLLECTION_LIMIT = 65536
Q3_LIST_SIZE = 100
HIT_RATE_TARGETS_PCT = (0.01, 0.1, 1.0, 10.0, 30.0)
BM25_K1 = 1.2
BM25_B = 0.75
# column length limits of the chunk schema
MAX_LEN = {
    "kbId": 16,
    "documentId": 64,
    "content": 2048,
    "study": 32,
    "site": 32,
    "patient": 64,
    "visit": 32,
}
# ----------------------------------------------------------------------------

SCALAR_FIELDS = ("kbId", "study", "site", "patient", "visit")
OUTPUT_FIELDS = ("documentId", "study", "site", "patient", "visit")
METRICS = ("IP", "L2", "COSINE")


@dataclass(frozen=True)
class PoolSpec:
    """Cardinalities of the five value pools."""

    kb: int = KB_CARD
    study: int = STUDY_CARD
    site: int = SITE_CARD
    patient: int = PATIENT_CARD
    visit: int = VISIT_CARD

    def as_dict(self) -> dict[str, int]:
        return {"kbId": self.kb, "study": self.study, "site": self.site,
                "patient": self.patient, "visit": self.visit}


@dataclass(frozen=True)
class GeneratorSpec:
    chunks_min: int = CHUNKS_PER_DOC_MIN
    chunks_max: int = CHUNKS_PER_DOC_MAX
    alpha: float = ZIPF_ALPHA
    dim: int = DIM
    vocab: int = SPARSE_VOCAB
    nnz: int = SPARSE_NNZ_ROW
    content_length: int = CONTENT_LENGTH
    seed: int = SEED
    pools: PoolSpec = field(default_factory=PoolSpec)
