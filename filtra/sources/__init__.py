from filtra.sources.tables import (  # noqa: F401
    TABLES, read_table, chunks_view, request_log_view, event_log_view, anchor_row,
)
