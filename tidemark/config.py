"""Configuration: a tree with dotted access, overrides and variants (SRC-7)."""

from __future__ import annotations

import copy
import random
from typing import Any

# The default parameters.
DEFAULTS: dict[str, Any] = {
    "experiment": {"name": "default", "seed": 42},
    "brand": "Product",
    "chunking": {
        "strategy": "per_source",
        "docs": {"min_tokens": 120, "max_tokens": 800, "split_overlap_sentences": 1},
        "forum": {"min_votes_for_non_accepted": 3, "include_op_followups": True, "strip_quoted_replies": True, "max_question_tokens": 180},
        "blog": {"window_tokens": 700, "overlap_ratio": 0.15, "semantic_split": False, "semantic_percentile": 25},
        "uniform": {"chunk_tokens": 1000, "overlap_tokens": 200},
        "contextual": {"enabled": True, "include_version": True, "include_date": True, "include_authority": True},
    },
    "index": {"bm25": {"enabled": True, "k1": 1.5, "b": 0.75}, "dense": {"enabled": True, "backend": "lsa", "dims": 256, "min_df": 2, "sublinear_tf": True}},
    "retrieval": {
        "top_k_per_source": 20,
        "candidate_pool": 60,
        "min_per_source": 2,
        "rrf_k": 60,
        "query_analysis": {"expand_queries": True, "max_expansions": 3, "expansion_weight": 0.35, "version_filter_is_hard": True},
        "weights": {
            "api_reference": {"docs": 1.00, "forum": 0.45, "blog": 0.35},
            "how_to": {"docs": 0.90, "forum": 0.70, "blog": 0.60},
            "troubleshooting": {"docs": 0.65, "forum": 1.00, "blog": 0.55},
            "conceptual": {"docs": 0.70, "forum": 0.45, "blog": 1.00},
            "version_migration": {"docs": 0.95, "forum": 0.70, "blog": 0.75},
            "opinion": {"docs": 0.30, "forum": 0.85, "blog": 0.95},
            "unknown": {"docs": 0.85, "forum": 0.70, "blog": 0.70},
        },
        "authority": {
            "beta": 0.30,
            "docs_type_prior": {"reference": 1.00, "api": 0.95, "changelog": 0.90, "guide": 0.80, "tutorial": 0.65},
            "forum_accepted_weight": 0.50,
            "forum_votes_weight": 0.30,
            "forum_staff_weight": 0.20,
            "forum_votes_saturation": 40,
            "blog_staff_bonus": 1.00,
            "blog_guest_bonus": 0.30,
        },
        "recency": {"enabled": True, "strength": 0.50, "half_life_days": 400, "floor": 0.60, "skip_for_intents": ["conceptual", "opinion"], "reference_date": "2026-10-01"},
    },
    "rerank": {"enabled": True, "backend": "surrogate", "rerank_top_n": 60, "final_k": 8, "alpha": 0.70, "mmr": {"enabled": True, "lambda": 0.70}, "caps": {"max_per_source": 5, "max_per_document": 3}},
    "contradiction": {
        "enabled": True,
        "pair_selection": {"min_similarity": 0.60, "cross_source_only": False, "max_pairs": 12},
        "precedence": ["version_scoping", "explicit_deprecation", "empirical_override", "source_authority", "recency_within_tier", "unresolved"],
        "empirical_override": {"min_independent_reports": 2},
        "source_authority_order": ["docs:changelog", "docs", "forum:staff", "blog:staff", "forum:accepted", "forum:high_votes", "blog:guest", "forum:low_votes"],
        "disclosure": {"always_disclose_unresolved": True},
    },
    "generation": {"quote_pivot_terms": 2, "refuse_below_score": 0.18, "refuse_above_unknown_ratio": 0.40, "refuse_below_coverage": 0.34, "max_context_chunks": 8},
    "evaluation": {"bootstrap_samples": 1000},
}

#: Named variants of the ablation study (EVL-11).
VARIANTS: dict[str, dict[str, Any]] = {
    "bm25_only": {"index.dense.enabled": False, "rerank.enabled": False, "chunking.contextual.enabled": False, "retrieval.query_analysis.expand_queries": False},
    "dense_only": {"index.bm25.enabled": False, "rerank.enabled": False, "chunking.contextual.enabled": False, "retrieval.query_analysis.expand_queries": False},
    "hybrid": {"rerank.enabled": False, "chunking.contextual.enabled": False, "retrieval.query_analysis.expand_queries": False},
    "headers": {"rerank.enabled": False, "retrieval.query_analysis.expand_queries": False},
    "expansion": {"rerank.enabled": False},
    "rerank": {"rerank.mmr.enabled": False, "rerank.caps.max_per_source": 99, "rerank.caps.max_per_document": 99},
    "default": {},
    "reranker_only": {"rerank.alpha": 1.0},
    "uniform": {"chunking.strategy": "uniform"},
}


def coerce(text: str) -> Any:
    """An override's value: bool, none, int, float, comma list or text."""
    low = text.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if low in ("none", "null", ""):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return [coerce(p) for p in text.split(",")] if "," in text else text.strip()


class EngineConfig:
    """An immutable tree of parameters."""

    def __init__(self, tree: dict[str, Any] | None = None):
        self._tree = merge(DEFAULTS, tree or {})

    def get(self, path: str, default: Any = None) -> Any:
        node: Any = self._tree
        for key in path.split("."):
            if not isinstance(node, dict) or key not in node:
                return default
            node = node[key]
        return copy.deepcopy(node) if isinstance(node, (dict, list)) else node

    def variant(self, overrides: dict[str, Any]) -> EngineConfig:
        tree = copy.deepcopy(self._tree)
        for path, value in overrides.items():
            *above, last = path.split(".")
            node = tree
            for key in above:
                node = node.setdefault(key, {})
            node[last] = value
        return EngineConfig(tree)

    def with_overrides(self, pairs: list[str]) -> EngineConfig:
        """``a.b=c`` texts, as from a command line."""
        return self.variant({k.strip(): coerce(v) for k, _, v in (p.partition("=") for p in pairs)})


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load_config(path: str | None = None, overrides: list[str] | None = None) -> EngineConfig:
    """YAML over the defaults, then overrides; seeds Python's generator."""
    tree = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            tree = yaml.safe_load(f) or {}
    config = EngineConfig(tree).with_overrides(overrides or [])
    random.seed(config.get("experiment.seed"))
    return config
