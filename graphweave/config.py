"""Settings of the engine: one frozen value. Each setting states its own bounds, and they are checked when it is made."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any


def _setting(default: Any, over: float | None = None, least: float | None = None, below: str | None = None, most: float | None = None, among: tuple[str, ...] = ()) -> Any:
    """over: it is greater; least, most: it is no less, no more; below: it is less than that other setting. None passes."""
    return field(default=default, metadata={"over": over, "least": least, "below": below, "most": most, "among": among})


def _count(default: int) -> Any:
    return _setting(default, least=1)


@dataclass(frozen=True)
class EngineConfig:
    # text units
    chunk_size: int = _count(1000)
    chunk_overlap: int = _setting(160, least=0, below="chunk_size")
    # extraction
    max_entities: int = _count(20)
    max_relations: int = _count(30)
    max_retry: int = _setting(3, least=0)
    #: Calls of a provider that are in flight at once in the whole cluster.
    provider_parallelism: int = _count(4)
    #: Answers are joined from pieces where a provider streams them.
    stream: bool = False
    #: Keep every prompt and answer as a table: of an index build with the index, of a question with its details.
    keep_payloads: bool = False
    # resolution and descriptions
    entity_resolution: str = _setting("normalized", among=("normalized", "none"))
    describe: bool = True
    max_description_mentions: int = _count(12)
    # pruning
    prune_enabled: bool = False
    min_node_frequency: int = _count(1)
    max_node_frequency_std: float | None = _setting(None, least=0)
    min_node_degree: int = _setting(0, least=0)
    max_node_degree_std: float | None = _setting(None, least=0)
    min_edge_weight_percentile: float = _setting(0.0, least=0, most=100)
    remove_ego_nodes: bool = False
    largest_component_only: bool = False
    # claims
    claims_enabled: bool = False
    max_claims_per_chunk: int = _count(10)
    #: Entity names that a claim prompt shows, the first of the alphabet; None: all. The lookup covers all names anyway.
    claim_names: int | None = _setting(None, least=1)
    # communities
    community_algorithm: str = _setting("louvain", among=("louvain", "leiden"))
    community_resolution: float = _setting(1.0, over=0)
    community_resolution_multiplier: float = _setting(1.5, over=1)
    max_community_levels: int = _count(3)
    max_cluster_size: int = _count(20)
    #: Passes of Leiden; Louvain's end when nothing moves.
    leiden_iterations: int = _count(10)
    #: Rounds of local moving in a pass, after which it ends even if nodes still gain.
    community_rounds: int = _count(100)
    seed: int = 42
    # embeddings
    embedding_dimension: int = _count(256)
    # retrieval
    neighbor_depth: int = _count(1)
    global_community_level: int = _setting(1, least=0)
    global_top_k: int = _count(24)
    max_text_units: int = _count(12)
    max_top_k: int = _count(50)
    #: Entities, relations and claims that a local prompt lists, of each; None: all. The context itself has all.
    shown_items: int | None = _setting(None, least=1)
    local_tokens: int = _count(4000)
    global_tokens: int = _count(8000)
    map_tokens: int = _count(2000)
    reduce_tokens: int = _count(4000)
    # drift
    drift_community_level: int = _setting(1, least=0)
    drift_depth: int = _count(2)
    drift_actions: int = _count(12)
    drift_followups: int = _count(3)
    drift_primer_folds: int = _count(3)
    drift_primer_tokens: int = _count(5000)
    drift_local_k: int = _count(5)
    drift_local_tokens: int = _count(2500)
    drift_reduce_tokens: int = _count(5000)
    drift_confidence_gate: float = _setting(0.35, least=0, most=1)
    # guards; None lifts them, as bulk jobs do
    max_documents: int | None = _setting(200, least=1)
    max_characters: int | None = _setting(500_000, least=1)
    max_query_characters: int | None = _setting(8000, least=1)

    def __post_init__(self) -> None:
        for f in fields(self):
            value, m = getattr(self, f.name), f.metadata
            if value is None or not m:
                continue
            limits = {
                f"above {m['over']}": m["over"] is None or value > m["over"], f"at least {m['least']}": m["least"] is None or value >= m["least"],
                f"below {m['below']}": m["below"] is None or value < getattr(self, m["below"]), f"at most {m['most']}": m["most"] is None or value <= m["most"],
                f"one of {m['among']}": not m["among"] or value in m["among"],
            }
            broken = [text for text, holds in limits.items() if not holds]
            if broken:
                raise ValueError(f"{f.name} is {value!r}; it must be {' and '.join(broken)}")
