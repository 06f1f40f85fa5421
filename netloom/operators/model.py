"""Gradient-boosted tree ensembles read from JSON, applied in an Arrow-batched UDF."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


def _base(score, classes: int) -> np.ndarray:
    """A number as text for all classes, or a bracketed list of one each; anything else counts as zeros."""
    zeros = np.zeros(classes)
    if not isinstance(score, str):
        return zeros
    text, given = score.strip(), []
    for x in text.strip("[]").split(",") if text.startswith("[") else [text]:
        try:
            given.append(float(x))
        except ValueError:
            continue
    if text.startswith("["):
        return np.array(given) if len(given) == classes else zeros
    return np.full(classes, given[0]) if given else zeros


def _number(x, default: int) -> int:
    return int(x) if (isinstance(x, int) and x >= 0) or (isinstance(x, str) and x.isdigit()) else default


def load(text: str, leaves: str = "base_weights") -> dict:
    """Arrays per tree, checked for equal lengths; without tree_info all trees are of the one class."""
    learner = json.loads(text)["learner"]
    model, param = learner["gradient_booster"]["model"], learner["learner_model_param"]
    trees = []
    for t in model["trees"]:
        arrays = {k: np.array(t[k]) for k in ("left_children", "right_children", "split_indices", "split_conditions", "default_left", leaves)}
        if len({len(a) for a in arrays.values()}) != 1:
            raise ValueError("a tree's arrays differ in length")
        trees.append((arrays["left_children"], arrays["right_children"], arrays["split_indices"], arrays["split_conditions"].astype(np.float32), arrays["default_left"].astype(bool), arrays[leaves].astype(np.float32)))
    classes = max(1, _number(param.get("num_class"), 1))
    info = model.get("tree_info")
    if info is None and classes > 1:
        raise ValueError("a model of several classes needs tree_info")
    info = [0] * len(trees) if info is None else [_number(k, 0) for k in info]
    if len(info) != len(trees):
        raise ValueError(f"tree_info has {len(info)} entries for {len(trees)} trees")
    return {"trees": trees, "class_of": info, "classes": classes, "base": _base(param.get("base_score"), classes), "features": _number(param.get("num_feature"), 0)}


def check(model: dict, dim: int, labels: int) -> None:
    """Raises if the model does not take two features a packet (unless it states none), or has other classes than the labels."""
    if model["features"] and model["features"] != 2 * dim:
        raise ValueError(f"the model takes {model['features']} features, flows have {2 * dim}")
    if model["classes"] != labels:
        raise ValueError(f"the model has {model['classes']} classes, there are {labels} labels")


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Sum of leaves per class plus the base score; a missing value takes the default side."""
    out = np.tile(model["base"].astype(float), (len(x), 1))
    for (left, right, feature, cut, default, leaf), k in zip(model["trees"], model["class_of"]):
        at = np.zeros(len(x), int)
        while (inner := left[at] >= 0).any():
            f = feature[at]
            v = np.where(f < x.shape[1], x[np.arange(len(x)), np.minimum(f, x.shape[1] - 1)], np.nan)
            to = np.where(np.isnan(v), np.where(default[at], left[at], right[at]), np.where(v < cut[at], left[at], right[at]))
            at = np.where(inner, to, at)
        out[:, k] += leaf[at]
    return out


def predict(model: dict, features: Column) -> Column:
    """Softmax class probabilities, array<double>."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        x = np.array([np.array(r, np.float32) for r in rows], np.float32).reshape(len(rows), -1)
        s = raw_scores(model, x)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return pd.Series(list(e / e.sum(axis=1, keepdims=True)))

    return run(features)


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x.cast("double") - F.array_max(scores).cast("double")))
    return F.transform(shifted, lambda e: e / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def argmax(scores: Column) -> Column:
    """Position of the first largest value, from 0."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
