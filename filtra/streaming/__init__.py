from filtra.streaming.ingest import stream_ingest  # noqa: F401
from filtra.streaming.monitor import latency_counts, latency_windows  # noqa: F401
from filtra.streaming.search import stream_search  # noqa: F401
