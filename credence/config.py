"""The settings that change results."""

from __future__ import annotations

from dataclasses import dataclass

#: Owner of statements that nobody in particular makes.
GLOBAL = "GlobalContext"
ENTITY, BELIEF, CHUNK = "entity-", "proposition-", "chunk-"


@dataclass(frozen=True)
class Settings:
    passage_weight: float = 0.05
    synonym_top_k: int = 2047
    synonym_threshold: float = 0.8
    synonym_most: int = 101
    beam_width: int = 4
    path_length: int = 3
    rescore_k: int = 40
    linking_top_k: int = 5
    retrieval_top_k: int = 200
    qa_top_k: int = 5
    damping_single: float = 0.75
    damping_first: float = 0.75
    damping_second: float = 0.45
    focus_docs: int = 50
    first_paths: int = 20
    first_entities: int = 40
    second_paths: int = 5
    second_entities: int = 5


DEFAULT = Settings()
