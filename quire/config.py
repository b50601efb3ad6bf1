"""All settings in one frozen value; importing it touches no file and no environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    domains: tuple[str, ...] = ("biomedical research",)
    papers_per_domain: int = 500
    date_from: str = "2018/01/01"
    date_to: str = "2024/12/31"
    min_text_length: int = 50
    max_text_length: int = 10_000
    sentence_splitter: str = "rule"  # or "trained"
    sentence_min_chars: int = 20
    chunk_words: int = 512
    top_k: int = 10
    summary_top_k: int = 5
    summary_method: str = "lead"  # or "graph"
    summary_sentences: int = 6
    summary_max_words: int = 150
    summary_min_chars: int = 50
    input_max_words: int = 1_000
    index_recall: float = 0.95
    min_topic_size: int = 10
    embedding: str = "hashed"  # or "latent"
    embedding_dim: int = 256
    latent_dim: int = 64
    latent_vocabulary: int = 20_000
    num_topics: int = 10
    topic_method: str = "kmeans"  # or "density"
    topic_runs: int = 10
    topic_components: int = 5
    vocabulary_size: int = 1_000
    keyword_candidates: int = 100
    keywords: int = 10
    seed: int = 42

    @property
    def vector_dim(self) -> int:
        return self.latent_dim if self.embedding == "latent" else self.embedding_dim

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> EngineConfig:
        """RESEARCH_DOMAINS (comma-separated), PAPERS_PER_DOMAIN, DATE_FROM, DATE_TO, TOP_K_RESULTS, MIN_TOPIC_SIZE."""
        env = os.environ if env is None else env
        own: dict = {}
        domains = tuple(d.strip() for d in env.get("RESEARCH_DOMAINS", env.get("RESEARCH_DOMAIN", "")).split(",") if d.strip())
        if domains:
            own["domains"] = domains
        for key, name, kind in (("PAPERS_PER_DOMAIN", "papers_per_domain", int), ("DATE_FROM", "date_from", str), ("DATE_TO", "date_to", str), ("TOP_K_RESULTS", "top_k", int), ("MIN_TOPIC_SIZE", "min_topic_size", int)):
            if env.get(key):
                own[name] = kind(env[key])
        return cls(**own)
