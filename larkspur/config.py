"""Settings of indexing and retrieval."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

#: Keywords of questions about attributes (fixed values).
ATTRIBUTE_KEYWORDS = (
    "born", "birth", "where", "when", "located", "location", "founded", "founder", "died", "death", "nationality", "capital", "date", "year",
)


@dataclass(frozen=True)
class Config:
    """Prior: `partners` an entity at a fused weight of at least `partner_weight`, co-occurrence weighing `alpha` against the
    similarity of the `similar` nearest entities, found exactly or, with `approximate`, by hashing. Spreading: `hops`, each over the
    `sentences` nearest to the question of an entity, while scores stay above `gate`. Ranking: `passages` a question; a passage
    counts `passage_share` beside entities, and below a similarity of `related` as not similar (0 takes any); `damping`, at most
    `rank_steps` steps, ranks below `rank_least` are dropped. `boost` is the weight of shared keywords, 0 is off.
    """

    alpha: float = 0.5
    partners: int = 5
    partner_weight: float = 0.5
    similar: int = 10
    approximate: bool = False
    hops: int = 2
    gate: float = 0.5
    sentences: int = 1
    passages: int = 5
    passage_share: float = 0.05
    related: float = 0.0
    damping: float = 0.5
    rank_steps: int = 20
    rank_least: float = 0.0
    boost: float = 0.0
    keywords: tuple[str, ...] = ATTRIBUTE_KEYWORDS

    @classmethod
    def load(cls, prefix: str = "LARKSPUR_", **given) -> Config:
        """An argument goes before an environment variable, that before the default."""
        seen = {}
        for f in fields(cls):
            env = os.environ.get(prefix + f.name.upper())
            if env is not None and f.name != "keywords":
                kind = type(getattr(cls, f.name))
                seen[f.name] = env.strip().lower() in ("1", "true", "yes") if kind is bool else kind(env)
        return replace(cls(), **(seen | {k: v for k, v in given.items() if v is not None}))
