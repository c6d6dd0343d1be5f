"""Numpy helper of a training task: the network's loss and gradient on one batch.

The state is one flat vector, layer by layer, weights (out, in) before biases.
"""

import numpy as np

# Widths of the two inner layers.
HIDDEN, LATENT = 12, 6


def shapes(n: int) -> list[tuple[int, int]]:
    return [(HIDDEN, n), (LATENT, HIDDEN), (HIDDEN, LATENT), (n, HIDDEN)]


def initial(n: int, seed: int) -> np.ndarray:
    """Uniform in +-1/sqrt(fan-in), weights and biases alike, as one flat vector."""
    rng = np.random.default_rng(seed)
    parts = []
    for out, fan_in in shapes(n):
        bound = fan_in ** -0.5
        parts += [rng.uniform(-bound, bound, out * fan_in), rng.uniform(-bound, bound, out)]
    return np.concatenate(parts)


def views(flat: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight and bias views into the flat vector."""
    layers, at = [], 0
    for out, fan_in in shapes(n):
        w = flat[at:at + out * fan_in].reshape(out, fan_in)
        at += out * fan_in
        layers.append((w, flat[at:at + out]))
        at += out
    return layers


def gradient(flat: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean squared reconstruction error of a batch and its gradient."""
    layers = views(flat, x.shape[1])
    activations = [x]
    for i, (w, b) in enumerate(layers):
        z = activations[-1] @ w.T + b
        activations.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
    diff = activations[-1] - x
    grad = np.empty_like(flat)
    parts = views(grad, x.shape[1])
    delta = 2.0 * diff / diff.size
    for i in range(len(layers) - 1, -1, -1):
        parts[i][0][...] = delta.T @ activations[i]
        parts[i][1][...] = delta.sum(axis=0)
        if i:
            delta = (delta @ layers[i][0]) * (activations[i] > 0)
    return float((diff ** 2).mean()), grad
