"""Engine parameters, passed explicitly to the plans that need them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    # dense index
    embedding_dim: int = 768
    query_instruction: str = "Represent this sentence for searching relevant passages: "
    # retrieval
    k_dense: int = 25
    k_sparse: int = 25
    rrf_k: int = 60
    candidate_k: int = 10
    top_k: int = 5
    exact_top_k: int = 10
    threshold: float = 0.75
    # user documents
    user_top_k: int = 5
    user_dense_k: int = 10
    user_sparse_k: int = 10
    # BM25
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    # chunking
    section_max_chars: int = 3200
    chunk_target_chars: int = 1800
    chunk_overlap_chars: int = 200
    chunk_min_chars: int = 1
    # evidence
    context_chars: int = 8000
    combined_statute_floor: float = 0.35
    # structure
    max_section: int = 531
    max_schedule_section: int = 356
    expected_forms: int = 58
    note_gap: float = 14.0
    note_tolerance: float = 55.0
    # admission
    rate_limit: int = 60
    rate_window_seconds: int = 60
    # uploads
    upload_max_bytes: int = 25 * 1024 * 1024
    ocr_max_pages: int = 10
    ocr_min_chars: int = 50
    # model calls
    max_retries: int = 2
    price_per_1k_input: float = 0.0
    price_per_1k_output: float = 0.0
    # sizes behind which a side may be broadcast; beyond them the operators
    # fall back to shuffled, skew-split joins or to several passes
    broadcast_rows: int = 200_000
    query_block_rows: int = 4_096
