"""Configurations: YAML over defaults, checked by a table of rules.

A configuration is a tree of namespaces. Unknown keys are errors. Sections and keys that concern model training or devices are
read, so that existing files load, but nothing here acts on them.
"""

from __future__ import annotations

import copy
import warnings
from types import SimpleNamespace
from typing import Any

from lumenspan.functions.scores import METRICS
from lumenspan.functions.scores import budget_bytes as _budget

#: Sections, keys and defaults.
DEFAULTS: dict[str, Any] = {
    "data": {
        "pyterrier_dataset": None, "dataset_provider": None, "topics_variant": None, "qrels_variant": None,
        "eval_pyterrier_dataset": None, "eval_dataset_provider": None, "eval_topics_variant": None, "eval_qrels_variant": None,
        "text_fields": ["text"], "max_docs": None, "max_queries": None, "topic_column": "query", "docno_column": "docno", "qrels_label_column": "label",
        "local_corpus_path": None, "local_topics_path": None, "local_qrels_path": None, "local_eval_corpus_path": None, "local_eval_topics_path": None, "local_eval_qrels_path": None,
        "single_log_policy": "shared", "candidate_source": "pyterrier_bm25", "candidates_per_query": 200,
        "training_dataset_name": None, "training_local_path": None, "training_split": "train", "training_format": "hf_triplet",
        "query_column": "query", "positive_column": "positive", "negative_column": "negative",
        "tevatron_positive_passages_column": "positive_passages", "tevatron_negative_passages_column": "negative_passages", "tevatron_passage_text_field": "text",
        "local_terrier_index_path": None, "build_local_terrier_index_if_missing": False, "terrier_index_threads": 4, "terrier_index_overwrite": False, "terrier_meta_lengths": {"docno": 64, "text": 4096},
        "full_embeddings_source": "auto", "hf_embeddings_repo_id": None, "hf_embeddings_split": "train", "hf_embeddings_docno_column": "docno", "hf_embeddings_vector_column": "full_embedding",
    },
    "model": {
        "mode": "pretrained", "backend": "sentence_transformers", "model_name_or_path": "hashing", "tokenizer_name_or_path": None, "adapter_type": None, "adapter_path": None, "adapter_name": "default",
        "trust_remote_code": False, "query_prompt": "", "document_prompt": "", "similarity": "dot", "full_profile_name": "full", "pooling": "mean", "sentence_transformer_truncate_dim": None,
    },
    "profiles": [],
    "utility": {
        "estimator": "query_log", "metric": "relative_score_dissimilarity", "epsilon": 1e-6, "alpha": 0.7, "margin_negatives": 4, "aggregate": "mean", "sample_pairs_per_query": 64,
        "relevance_threshold": 1.0, "seed": 13, "default_utility_profile_name": None, "residual_norm": {"norm": 2, "epsilon": 1e-12},
        "relevance": {
            "mode": "weak", "weak_source": "bm25", "calibration": "minmax_score", "cross_encoder_model_name": None, "top_k_candidates": 200, "rerank_k": 50, "uncertainty": "margin",
            "qrel_adjustment": "hard_override", "high_impact_fraction": 0.2, "validation_qids_limit": 200, "scale": {"mode": "minmax", "min_label": 0.0, "max_label": 3.0, "explicit_map": {}},
        },
        "tail": {"mode": "static_default", "target_residual": 0.01, "conservatism_beta": 0.5, "expected_fraction": 0.5, "max_tail_relevance": 0.01, "profile_quality": "cosine_padding", "sampled_quality_queries": 32, "utility_low": 0.0},
    },
    "optimization": {"budget_bytes": None, "budget_gb": 2.0, "algorithm": "lagrangian_relaxation", "max_iter": 64, "tolerance": 1e-3, "lambda_low": 0.0, "lambda_high": 1.0, "streaming_reestimate_every_docs": 5000, "mode": "batch"},
    "retrieval": {"mode": "dense_exact", "top_k": 100, "candidate_k": 2000, "include_bm25_baseline": False, "batch_size_queries": 32, "batch_size_docs": 256, "use_pyterrier_bm25": True, "terrier_wmodel": "BM25", "use_torch_gpu_exact": True},
    "execution": {
        "output_dir": "outputs", "experiment_name": "experiment", "device": "cuda", "retrieval_device": "cuda", "dtype": "float16", "doc_batch_size": 256, "query_batch_size": 32, "num_workers": 0, "seed": 13,
        "save_embeddings": False, "save_score_pairs": True, "save_runs": True, "verbose": True, "retrieval_vram_utilization_limit": 0.9, "retrieval_vram_temp_overhead_factor": 1.2,
        "embedding_checkpoint_enabled": True, "embedding_checkpoint_every_docs": 1_000_000, "embedding_checkpoint_dir": None, "embedding_checkpoint_resume": "auto",
    },
}
PROFILE = {"name": None, "dimension": None, "layer": None, "normalize": True, "cost_bytes": None, "cost_is_explicit": False}
#: Read as they are.
FREE = frozenset(("training", "explicit_map", "terrier_meta_lengths"))
CHOICES = {
    "model.backend": ("sentence_transformers", "transformers"),
    "model.similarity": ("dot", "cosine"),
    "retrieval.mode": ("dense_exact", "pyterrier_candidates"),
    "utility.estimator": ("query_log", "residual_norm"),
    "utility.metric": METRICS,
    "utility.aggregate": ("mean",),
    "utility.relevance.mode": ("weak", "model", "hybrid"),
    "utility.relevance.weak_source": ("bm25", "dense", "hybrid_rerank"),
    "utility.relevance.calibration": ("minmax_score", "rank_log_discount", "constant_one"),
    "utility.relevance.uncertainty": ("margin",),
    "utility.relevance.qrel_adjustment": ("hard_override", "relevant_only_to_one"),
    "utility.relevance.scale.mode": ("minmax", "explicit_map"),
    "utility.tail.mode": ("static_default", "rbp_residual_interval"),
    "utility.tail.profile_quality": ("cosine_padding", "sampled_dense_score_preservation"),
    "data.single_log_policy": ("shared", "split_by_qrels"),
    "data.training_format": ("hf_triplet", "hf_tevatron_passage", "jsonl_triplet"),
    "data.full_embeddings_source": ("auto", "hf_dataset", "compute"),
    "optimization.algorithm": ("lagrangian_relaxation", "lagrangian_dual"),
    "execution.embedding_checkpoint_resume": ("auto", "restart", "fail"),
}
POSITIVE = (
    "retrieval.candidate_k", "retrieval.top_k", "utility.margin_negatives", "utility.residual_norm.epsilon",
    "utility.relevance.top_k_candidates", "utility.relevance.rerank_k", "utility.relevance.validation_qids_limit",
    "utility.tail.sampled_quality_queries", "execution.embedding_checkpoint_every_docs"
)
UNIT = ("utility.relevance.high_impact_fraction", "utility.tail.target_residual", "utility.tail.expected_fraction")


class ConfigError(ValueError):
    pass


def _over(default: Any, given: Any, at: str) -> Any:
    if isinstance(default, dict) and at.rpartition(".")[2] not in FREE:
        if given is not None and not isinstance(given, dict):
            raise ConfigError(f"{at} is a section")
        unknown = set(given or {}) - set(default)
        if unknown:
            raise ConfigError(f"unknown keys in {at}: {sorted(unknown)}")
        return SimpleNamespace(**{k: _over(v, (given or {}).get(k, v), f"{at}.{k}" if at else k) for k, v in default.items()})
    return copy.deepcopy(given)


def get(cfg: SimpleNamespace, path: str) -> Any:
    for part in path.split("."):
        cfg = getattr(cfg, part)
    return cfg


def parse(raw: dict[str, Any]) -> SimpleNamespace:
    raw = dict(raw or {})
    training = raw.pop("training", {}) or {}
    unknown = set(raw) - set(DEFAULTS)
    if unknown:
        raise ConfigError(f"unknown sections: {sorted(unknown)}")
    cfg = SimpleNamespace(**{k: _over(v, raw.get(k, v), k) for k, v in DEFAULTS.items() if k != "profiles"})
    cfg.profiles = [_over(PROFILE, p, "profiles") for p in raw.get("profiles") or []]
    for p in cfg.profiles:
        p.cost_is_explicit = p.cost_bytes is not None
    cfg.training = training
    _older_names(cfg, raw.get("data") or {}, raw.get("retrieval") or {})
    check(cfg)
    return cfg


def read_yaml(text: str) -> dict:
    import yaml

    return yaml.safe_load(text)


def load(path: str) -> SimpleNamespace:
    with open(path) as f:  # a driver's own file
        return parse(read_yaml(f.read()))


def _older_names(cfg: SimpleNamespace, data: dict, retrieval: dict) -> None:
    """Keys that have moved: the new name wins, the old one is mapped with a warning."""
    modes = {"pyterrier_bm25": "pyterrier_candidates", "dense_exact": "dense_exact"}
    if "candidates_per_query" in data:
        if "candidate_k" not in retrieval:
            cfg.retrieval.candidate_k = int(data["candidates_per_query"])
        warnings.warn("data.candidates_per_query is now retrieval.candidate_k", stacklevel=3)
    if "candidate_source" in data:
        mode = modes.get(str(data["candidate_source"]).strip().lower())
        if mode is None:
            raise ConfigError(f"data.candidate_source is one of {sorted(modes)}")
        if "mode" not in retrieval:
            cfg.retrieval.mode = mode
        warnings.warn("data.candidate_source is now retrieval.mode", stacklevel=3)
    if cfg.optimization.algorithm == "lagrangian_dual":
        cfg.optimization.algorithm = "lagrangian_relaxation"
        warnings.warn("lagrangian_dual is now lagrangian_relaxation", stacklevel=3)


def check(cfg: SimpleNamespace) -> None:
    from lumenspan.operators import profiles as P

    if cfg.optimization.mode != "batch":
        raise ConfigError("optimization.mode is batch; streams take a finished multiplier, see streaming.online")
    for path, allowed in CHOICES.items():
        if get(cfg, path) not in allowed:
            raise ConfigError(f"{path} is one of {sorted(allowed)}, not {get(cfg, path)!r}")
    for path in POSITIVE:
        if not get(cfg, path) > 0:
            raise ConfigError(f"{path} is positive")
    for path in UNIT:
        if not 0 <= get(cfg, path) <= 1 or path.endswith("high_impact_fraction") and get(cfg, path) == 0:
            raise ConfigError(f"{path} is within 0 and 1")
    u = cfg.utility
    if int(u.residual_norm.norm) not in (1, 2):
        raise ConfigError("utility.residual_norm.norm is 1 or 2")
    if u.relevance.scale.max_label <= u.relevance.scale.min_label:
        raise ConfigError("utility.relevance.scale: max_label is above min_label")
    if u.relevance.scale.mode == "explicit_map" and not u.relevance.scale.explicit_map:
        raise ConfigError("utility.relevance.scale.explicit_map is needed for that mode")
    if u.tail.conservatism_beta is not None and u.tail.conservatism_beta < 0 or u.tail.max_tail_relevance < 0:
        raise ConfigError("utility.tail: conservatism_beta and max_tail_relevance aren't negative")
    try:
        P.check(catalogue(cfg), full=cfg.model.full_profile_name)
    except ValueError as e:
        raise ConfigError(str(e)) from e
    u.default_utility_profile_name = u.default_utility_profile_name or cfg.model.full_profile_name
    if u.default_utility_profile_name not in [p.name for p in cfg.profiles]:
        raise ConfigError("utility.default_utility_profile_name is no profile")
    own, ev = cfg.data, evaluation(cfg).data
    source = own if u.estimator == "query_log" else ev
    if source.pyterrier_dataset is None:
        missing = [f"data.{k}" for k in ("local_topics_path", "local_qrels_path", "local_corpus_path") if not getattr(source, k)]
        if missing:
            raise ConfigError(f"without a named dataset these are needed: {', '.join(missing)}")


def catalogue(cfg: SimpleNamespace) -> list:
    from lumenspan.operators.profiles import Profile

    return [Profile(p.name, int(p.dimension), p.cost_bytes, p.layer, p.normalize) for p in cfg.profiles]


_EVAL = {
    "pyterrier_dataset": "eval_pyterrier_dataset", "dataset_provider": "eval_dataset_provider",
    "topics_variant": "eval_topics_variant", "qrels_variant": "eval_qrels_variant",
    "local_corpus_path": "local_eval_corpus_path", "local_topics_path": "local_eval_topics_path",
    "local_qrels_path": "local_eval_qrels_path"
}


def has_eval_overrides(cfg: SimpleNamespace) -> bool:
    return any(getattr(cfg.data, e) for e in _EVAL.values() if e != "local_eval_corpus_path")


def fallback_warnings(cfg: SimpleNamespace) -> list[str]:
    """What an evaluation that is only partly configured falls back to."""
    d, out = cfg.data, []
    for kind in ("topics", "qrels"):
        if d.eval_pyterrier_dataset and not (getattr(d, f"eval_{kind}_variant") or getattr(d, f"local_eval_{kind}_path")):
            out.append(f"eval_pyterrier_dataset is set without eval_{kind}_variant or local_eval_{kind}_path: the dataset's default {kind} are used")
    for kind, other in (("topics", "qrels"), ("qrels", "topics")):
        if getattr(d, f"local_eval_{kind}_path") and not getattr(d, f"local_eval_{other}_path"):
            out.append(f"local_eval_{kind}_path is set without local_eval_{other}_path: {other} come from the dataset")
    if d.local_eval_corpus_path and not (d.local_eval_topics_path or d.eval_pyterrier_dataset):
        out.append("local_eval_corpus_path is set without a source of evaluation topics: topics come from the primary source")
    return out


def evaluation(cfg: SimpleNamespace) -> SimpleNamespace:
    """The configuration with its data section as evaluation sees it: each evaluation key, or else the plain one."""
    out = copy.copy(cfg)
    out.data = copy.copy(cfg.data)
    for plain, own in _EVAL.items():
        setattr(out.data, plain, getattr(cfg.data, own) or getattr(cfg.data, plain))
    return out


def budget(cfg: SimpleNamespace) -> int:
    return _budget(cfg.optimization.budget_bytes, cfg.optimization.budget_gb)


def as_dict(cfg: Any) -> Any:
    if isinstance(cfg, SimpleNamespace):
        return {k: as_dict(v) for k, v in vars(cfg).items()}
    return [as_dict(v) for v in cfg] if isinstance(cfg, list) else cfg


def snapshot(cfg: SimpleNamespace) -> dict:
    """as_dict without what parse() derives, so that it can be parsed again."""
    out = as_dict(cfg)
    for p in out.get("profiles", []):
        p.pop("cost_is_explicit", None)
    for moved in ("candidate_source", "candidates_per_query"):  # retrieval has them under their new names
        out["data"].pop(moved, None)
    return out
