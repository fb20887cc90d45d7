"""Every tunable number of the library in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    # Candidate extraction.
    min_candidate_chars: int = 6
    max_candidate_chars: int = 80
    min_candidate_area: float = 2500.0
    line_tolerance: float = 18.0
    min_height_ratio: float = 0.8
    max_candidates: int = 8

    # Pairing.
    max_vertical_distance: float = 100.0
    max_pair_similarity: float = 0.8
    max_overlap: float = 0.7

    # Catalog matching.
    podcast_similarity: float = 0.7
    fuzzy_podcast_similarity: float = 0.85
    episode_similarity: float = 0.2
    exact_episode_similarity: float = 0.5
    episode_list_similarity: float = 0.1
    episode_rank_similarity: float = 0.3
    feed_item_similarity: float = 0.7
    keyword_score: float = 0.3
    any_keyword_score: float = 0.00001
    podcast_page: int = 10
    episode_page: int = 200
    episode_results: int = 10
    suggestions: int = 3
    min_term_chars: int = 2
    max_keywords: int = 8

    # Requests and transcripts.
    max_files: int = 5
    max_file_bytes: int = 10 * 1024 * 1024
    warn_file_mb: float = 5.0
    low_confidence: float = 0.8
    snap_seconds: tuple[int, ...] = (15, 30, 45, 60, 90, 120)
    max_range_seconds: int = 120

    # Our own scale settings; none of them changes a result.
    hot_pairs: int = 50_000
    few_keys: int = 100_000
    running_chunk: int = 4_096
    range_bucket_ms: int = 60_000


DEFAULT = Limits()
