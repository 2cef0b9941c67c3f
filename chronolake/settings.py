"""Thresholds and sizes that users may set, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame


@dataclass
class Settings:
    embedding_tokens: int = 409
    embedding_overlap: int = 100
    pool: int = 40
    recency_weight: float = 0.02
    recency_days: float = 30.0
    similarity_floor: float = 0.0
    duplicate_threshold: float = 0.97
    cluster_threshold: float = 0.7
    cluster_least: int = 3
    cluster_most: int = 30
    session_gap: int = 600
    debounce_seconds: float = 0.5
    poll_seconds: int = 15
    idle_seconds: float = 120.0
    cache_seconds: float = 7200.0
    retry_batch: int = 500
    breaker_failures: int = 3

    @classmethod
    def of(cls, table: DataFrame) -> Settings:
        """Settings of a (key, value) table of strings; unknown keys and values that can't be read leave the default."""
        known = {f.name: type(f.default) for f in fields(cls)}
        out = cls()
        for r in table.select("key", "value").limit(1000).collect():
            if r.key in known and r.value is not None:
                try:
                    setattr(out, r.key, known[r.key](r.value))
                except ValueError:
                    continue
        return out
