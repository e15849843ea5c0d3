"""Parameters of the engine, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Retrieval:
    chunk_size: int = 500
    chunk_overlap: int = 10
    max_results: int = 5
    min_score: float = 0.5
    routing: bool = True
    fallback_when_empty: bool = True
    #: "relevance" is (1 + cosine) / 2, "cosine" the cosine itself.
    score_mode: str = "relevance"


@dataclass(frozen=True)
class Hybrid:
    enabled: bool = True
    candidate_multiplier: int = 4
    rrf_k: int = 60
    min_vector_score: float = 0.7
    k1: float = 1.2
    b: float = 0.75
    #: What a stretch that holds all terms and no other word counts.
    cover_weight: float = 0.1
    #: simple, unicode, english or german, of texts and questions alike.
    analyzer: str = "simple"


@dataclass(frozen=True)
class Rerank:
    enabled: bool = True
    provider: str = "none"
    pool_size: int = 10
    fail_open: bool = True
    passage_chars: int = 800


@dataclass(frozen=True)
class Memory:
    max_turns: int = 5
    max_history_chars: int = 4000
    retention_days: int = 30


@dataclass(frozen=True)
class Feedback:
    boost_weight: float = 0.03
    max_boost: float = 0.2
    min_votes: int = 1
    comment_ttl_minutes: int = 5


@dataclass(frozen=True)
class Cache:
    ttl_minutes: int = 60
    max_size: int = 500
    normalize_whitespace: bool = True
    case_sensitive: bool = False


@dataclass(frozen=True)
class Sheets:
    rows_per_chunk: int = 1
    header_detection: bool = True
    max_cell_length: int = 2000
    skip_blank_rows: bool = True
    range_validation: bool = True
    # Spreadsheet header -> metadata key.
    business_fields: dict[str, str] = field(
        default_factory=lambda: {"Offering Name": "offeringName", "Flat Offering ID": "flatOfferingId", "Offering ID": "offeringId", "External ID": "externalId", "TUTI": "tuti"}
    )


@dataclass(frozen=True)
class Commits:
    max_per_sync: int = 20_000
    sprint_length_days: int = 14


@dataclass(frozen=True)
class Config:
    retrieval: Retrieval = Retrieval()
    hybrid: Hybrid = Hybrid()
    rerank: Rerank = Rerank()
    memory: Memory = Memory()
    feedback: Feedback = Feedback()
    cache: Cache = Cache()
    sheets: Sheets = field(default_factory=Sheets)
    commits: Commits = Commits()
