"""Continual learning and distribution-shift analytics over tabular batch streams, on Spark DataFrames."""

import importlib

#: Public names and their modules, which are imported when first asked for, so that Python workers start fast.
_NAMES = {
    "AdaptiveModel": "model", "DriftConfig": "operators.drift", "PolicyConfig": "operators.policy", "Settings": "plans.lifecycle",
    "StreamLearner": "streaming.runner", "StreamRunner": "streaming.runner", "TaskSpec": "operators.spec", "actions": "operators.policy",
    "feature_scores": "operators.drift", "infer_task_spec": "operators.spec", "load_config": "sources.config", "reference_sample": "operators.drift",
    "replay_update": "operators.sampling", "select_farthest": "operators.sampling",
}
__all__ = list(_NAMES)


def __getattr__(name: str):
    if name not in _NAMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(f"{__name__}.{_NAMES[name]}"), name)
