"""Settings, weights and constants in one place."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class EdgeWeights:
    """Shares of the parts of a hybrid edge score."""

    semantic: float = 0.7
    links: float = 0.15
    tags: float = 0.08
    keywords: float = 0.05
    folder: float = 0.02


#: Limits of the numeric settings.
LIMITS = {"debounce_ms": (500, 60_000), "detail": (1, 10), "min_notes": (2, 50), "max_indexes": (1, 10), "threshold": (0, 100), "top_k": (5, 50)}


@dataclass(frozen=True)
class Settings:
    """Every setting with its default; ``from_raw`` repairs what a user stored."""

    excluded_folders: tuple[str, ...] = ()
    excluded_tags: tuple[str, ...] = ()
    config_dir: str = ".config"
    index_folder: str = "Indexes"
    debounce_ms: int = 3000
    detail: int = 5
    min_notes: int = 3
    max_indexes: int = 3
    threshold: int = 25
    top_k: int = 15
    ask_before_assigning: bool = True
    add_frontmatter: bool = True
    add_visible_links: bool = False
    move_notes: bool = False
    move_target: str = ""
    weights: EdgeWeights = field(default_factory=EdgeWeights)

    @classmethod
    def from_raw(cls, raw: dict | None) -> Settings:
        """Clamp numbers, trim lists, keep defaults for whatever has another type (F-12)."""
        raw, good = raw or {}, {}
        for f in fields(cls):
            value, default = raw.get(f.name), getattr(cls(), f.name)
            if f.name in LIMITS and isinstance(value, (int, float)) and not isinstance(value, bool) and value == value:
                low, high = LIMITS[f.name]
                good[f.name] = int(min(high, max(low, round(value))))
            elif isinstance(default, bool) and isinstance(value, bool):
                good[f.name] = value
            elif isinstance(default, str) and isinstance(value, str):
                good[f.name] = value.strip()
            elif isinstance(default, tuple) and isinstance(value, (list, tuple)):
                good[f.name] = tuple(dict.fromkeys(v.strip() for v in value if isinstance(v, str) and v.strip()))
            elif f.name == "weights" and isinstance(value, dict):
                known = {w.name: value[w.name] for w in fields(EdgeWeights) if isinstance(value.get(w.name), (int, float)) and not isinstance(value[w.name], bool)}
                good["weights"] = EdgeWeights(**{k: min(1.0, max(0.0, float(v))) for k, v in known.items()})
        return cls(**good)


def resolution_for_detail(detail: int) -> float:
    """Louvain resolution of a level of detail; 5 is 3 (C-05)."""
    return round(3 * 1.3 ** (detail - 5), 3)


def confidence_for_threshold(threshold: float) -> float:
    """Least member confidence for a threshold setting; 25 is 0.3 (I-03)."""
    return round(0.2 + 0.4 * min(100, max(0, threshold)) / 100, 3)


LOW_CONTENT_CHARS = 40
MAX_CHARS, MAX_HEADINGS = 2000, 10
TEMPLATE_MIN_NOTES, TEMPLATE_MIN_SHARE = 5, 0.03
GRAPH_LOW, GRAPH_HIGH, WEIGHT_FLOOR = 0.05, 0.95, 1e-6
REFINE_SHARE, REFINE_SIZE, REFINE_DEPTH = 0.15, 10, 3
RESCUE, SECONDARY, CHUNK_DISCOUNT, AGREEMENT_NEIGHBOURS = 0.25, 0.1, 0.95, 10
COLLECTION_LOW_SHARE, FOLDER_MIN, FOLDER_LOW_SHARE = 0.5, 5, 0.8
RELATED_TOP, RELATED_QUANTILE = 3, 0.9
SIGNIFICANT_COSINE, INCREMENTAL_PERCENTILE, MIN_MEMBERS = 0.97, 0.1, 2
QUEUE_CAP, HISTORY_KEEP, RECONCILE_JACCARD = 200, 50, 0.4
RECENTRE_SHARE = 0.2
