"""Parameters of all operators, with the published defaults."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # splitting
    chunk_size: int = 2000
    chunk_overlap: int = 300
    page_chunk_size: int = 500
    page_chunk_overlap: int = 50
    table_chunk_size: int = 6000
    table_chunk_overlap: int = 500
    # retrieval
    top_k: int = 8
    k_per_collection: int = 5
    total_k: int = 10
    similarity_threshold: float = 0.2
    fused_threshold: float = 0.05
    chat_threshold: float = 0.05
    rrf_k: int = 60
    per_source_cap: int = 2
    merged_k: int = 20
    # lexical weights
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    # table scans
    block_rows: int = 1000
    connected_block_rows: int = 200
    table_hit_limit: int = 10
    # chat windows
    window_size: int = 10
    window_overlap: int = 2
    # physical bounds
    vector_dim: int = 64
    broadcast_bytes: int = 64 << 20
    order_block: int = 65_536
    question_block: int = 1024
    pattern_bytes: int = 2 << 20


DEFAULTS = Settings()
