"""Incremental and streaming maintenance of aggregated relations."""
