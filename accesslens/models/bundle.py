"""The trained detector: layer weights, scaler, threshold."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from importlib import resources

import numpy as np

from accesslens.schemas import FEATURE_NAMES


@dataclass(frozen=True)
class Bundle:
    """Weights are (out, in) per layer; the scaler and threshold fit normal traffic.

    Its size is fixed by the architecture (about 700 numbers), never by the data.
    """

    weights: list[list[list[float]]]
    biases: list[list[float]]
    mean: list[float]
    std: list[float]
    threshold: float
    feature_names: list[str]
    n_features: int
    hidden: int
    latent: int

    @classmethod
    def from_arrays(cls, weights, biases, mean, std, threshold):
        weights = [np.asarray(w, float).tolist() for w in weights]
        biases = [np.asarray(b, float).tolist() for b in biases]
        return cls(weights, biases, list(map(float, mean)), list(map(float, std)), float(threshold),
                   list(FEATURE_NAMES), len(mean), len(biases[0]), len(biases[1]))

    @classmethod
    def from_dict(cls, d: dict) -> Bundle:
        bundle = cls(**{k: d[k] for k in cls.__dataclass_fields__})
        bundle.check()
        return bundle

    def with_threshold(self, threshold: float) -> Bundle:
        return replace(self, threshold=float(threshold))

    def to_dict(self) -> dict:
        return asdict(self)

    def check(self) -> None:
        n = self.n_features
        sizes = [n, self.hidden, self.latent, self.hidden, n]
        shapes = [(len(w), len(w[0])) for w in self.weights]
        if shapes != [(sizes[i + 1], sizes[i]) for i in range(4)]:
            raise ValueError(f"layer shapes {shapes} do not fit {sizes}")
        if [len(b) for b in self.biases] != sizes[1:] or len(self.mean) != n or len(self.std) != n:
            raise ValueError("bias or scaler length does not fit the layers")
        if len(self.feature_names) != n or not all(s > 0 for s in self.std):
            raise ValueError("feature names or standard deviations are not usable")


def packaged() -> Bundle:
    """The detector that ships with the library."""
    return Bundle.from_dict(json.loads(resources.files(__package__).joinpath("detector.json").read_text()))
