"""Settings with the defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Defaults of chunking, retrieval, limits, sessions and synthesis."""

    chunk_size: int = 512
    chunk_overlap: int = 64
    embed_batch_size: int = 32
    vector_size: int = 768
    top_k: int = 10
    score_threshold: float = 0.0
    max_chunks_per_note: int = 2
    over_fetch_factor: int = 3
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    rrf_k: int = 60
    sync_interval_minutes: int = 0
    session_ttl_seconds: int = 3600
    max_sessions: int = 100
    max_history: int = 20
    connect_timeout_s: int = 5
    chat_timeout_s: int = 120
    embed_timeout_s: int = 30
    max_retries: int = 3
    retry_base_s: float = 0.5

    def __post_init__(self) -> None:
        if self.chunk_overlap >= self.chunk_size:
            raise ValueError(f"chunk_overlap ({self.chunk_overlap}) must be less than chunk_size ({self.chunk_size})")


@dataclass(frozen=True)
class SearchFilter:
    """Tags match if any is present; the others by equality. Falsy fields don't filter."""

    tags: tuple[str, ...] = ()
    note_id: str | None = None
    note_path: str | None = None
    note_title: str | None = None

    @property
    def active(self) -> bool:
        return bool(self.tags or self.note_id or self.note_path or self.note_title)


#: Results that a search, and the context of an answer, may ask for.
MOST_RESULTS = {"search": 50, "answer": 20}


@dataclass(frozen=True)
class RetrievalQuery:
    """What a search asks for. ``symmetric_penalty`` and ``filter_keyword`` change two quirks kept by default: the
    penalty of fusion depends on the order of lists, and keyword results ignore filters."""

    top_k: int = 10
    score_threshold: float = 0.0
    filters: SearchFilter = field(default_factory=SearchFilter)
    deduplicate: bool = True
    max_chunks_per_note: int = 2
    over_fetch_factor: int = 3
    mode: str = "hybrid"  # semantic, keyword or hybrid
    semantic_weight: float = 0.7
    keyword_weight: float = 0.3
    rrf_k: int = 60
    symmetric_penalty: bool = False
    filter_keyword: bool = False

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= MOST_RESULTS["search"]:
            raise ValueError(f"top_k must be from 1 to {MOST_RESULTS['search']}, not {self.top_k}")
        if self.mode not in ("semantic", "keyword", "hybrid"):
            raise ValueError(f"unknown mode {self.mode!r}")


#: Limits per minute and burst of the two kinds of request.
RATE_POLICIES = {"chat": (30, 10), "ingest": (5, 2)}
#: Fixed value: requests that take longer, in ms, count as slow.
SLOW_REQUEST_MS = 5000
