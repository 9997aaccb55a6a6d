"""Reverse-mode derivatives of NumPy expressions: what a network's step needs inside a task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    """A value, and what its derivative means for those it was made from."""

    def __init__(self, value: np.ndarray, parents: tuple[tuple[Var, Callable], ...] = ()):
        self.value, self.parents, self.grad = np.asarray(value, float), parents, None

    def __add__(self, other: Var | float) -> Var:
        other = other if isinstance(other, Var) else Var(other)
        return Var(self.value + other.value, ((self, lambda g: _like(g, self)), (other, lambda g: _like(g, other))))

    def __mul__(self, other: Var | float) -> Var:
        other = other if isinstance(other, Var) else Var(other)
        return Var(self.value * other.value, ((self, lambda g: _like(g * other.value, self)), (other, lambda g: _like(g * self.value, other))))

    def __sub__(self, other: Var | float) -> Var:
        return self + (other if isinstance(other, Var) else Var(other)) * -1.0

    def __getitem__(self, key) -> Var:
        def back(g: np.ndarray) -> np.ndarray:
            out = np.zeros_like(self.value)
            out[key] = g
            return out

        return Var(self.value[key], ((self, back),))


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def affine(x: Var, w: Var, b: Var) -> Var:
    """[..., a] by [a, b], plus [b]."""
    value = _flat(x.value) @ w.value
    value += b.value
    back = lambda g: (_flat(g) @ w.value.T).reshape(x.value.shape)
    return Var(value.reshape(*x.value.shape[:-1], -1), ((x, back), (w, lambda g: _flat(x.value).T @ _flat(g)), (b, lambda g: _flat(g).sum(axis=0))))


def normalised(x: Var, scale: Var, shift: Var, least: float = 1e-5) -> tuple[Var, np.ndarray, np.ndarray]:
    """x less its mean by its deviation over all axes but the last, times scale, plus shift; the mean; the variance."""
    hat = _flat(x.value)
    n, mid = len(hat), hat.mean(axis=0)
    hat = hat - mid
    wide = np.einsum("ij,ij->j", hat, hat) / n
    by = 1 / np.sqrt(wide + least)
    hat *= by
    value = hat * scale.value
    value += shift.value

    def to_x(g: np.ndarray) -> np.ndarray:
        flat = _flat(g)
        out = hat * (np.einsum("ij,ij->j", flat, hat) / -n)
        out += flat
        out -= flat.mean(axis=0)
        out *= scale.value * by
        return out.reshape(x.value.shape)

    parents = ((x, to_x), (scale, lambda g: np.einsum("ij,ij->j", _flat(g), hat)), (shift, lambda g: _flat(g).sum(axis=0)))
    return Var(value.reshape(x.value.shape), parents), mid, wide


def _like(g: np.ndarray, x: Var) -> np.ndarray:
    """A derivative summed over what was broadcast."""
    while g.ndim > x.value.ndim:
        g = g.sum(axis=0)
    for axis, n in enumerate(x.value.shape):
        if n == 1 and g.shape[axis] != 1:
            g = g.sum(axis=axis, keepdims=True)
    return g


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def relu(x: Var) -> Var:
    return Var(np.maximum(x.value, 0), ((x, lambda g: g * (x.value > 0)),))


def sigmoid(x: Var) -> Var:
    s = _sigmoid(x.value)
    return Var(s, ((x, lambda g: g * s * (1 - s)),))


def tanh(x: Var) -> Var:
    t = np.tanh(x.value)
    return Var(t, ((x, lambda g: g * (1 - t * t)),))


def mean(x: Var, axis: int, keep: bool = False) -> Var:
    n = x.value.shape[axis]
    return Var(x.value.mean(axis=axis, keepdims=keep), ((x, lambda g: np.broadcast_to(g if keep else np.expand_dims(g, axis), x.value.shape) / n),))


def total(x: Var) -> Var:
    return Var(x.value.sum(), ((x, lambda g: np.broadcast_to(g, x.value.shape)),))


def log(x: Var) -> Var:
    return Var(np.log(x.value), ((x, lambda g: g / x.value),))


def joined(parts: list[Var]) -> Var:
    """Parts side by side along the last axis."""
    ends = np.cumsum([p.value.shape[-1] for p in parts])
    cut = lambda i: lambda g: g[..., ends[i] - parts[i].value.shape[-1] : ends[i]]
    return Var(np.concatenate([p.value for p in parts], axis=-1), tuple((p, cut(i)) for i, p in enumerate(parts)))


def shifted(x: Var, by: int) -> Var:
    """[n, places, channels] moved along the places, with zeros behind."""

    def move(v: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(v)
        if abs(by) < v.shape[1]:
            out[:, max(0, by) : v.shape[1] + min(0, by)] = v[:, max(0, -by) : v.shape[1] - max(0, by)]
        return out

    return Var(move(x.value, by), ((x, lambda g: move(g, -by)),))


def project(z: np.ndarray) -> np.ndarray:
    """The nearest point of the simplex to each row."""
    high = -np.sort(-z, axis=-1)
    sums, k = np.cumsum(high, axis=-1), np.arange(1, z.shape[-1] + 1)
    size = (1 + k * high > sums).sum(axis=-1, keepdims=True)
    return np.maximum(z - (np.take_along_axis(sums, size - 1, -1) - 1) / size, 0)


def sparsemax(x: Var) -> Var:
    p = project(x.value)
    on = p > 0
    return Var(p, ((x, lambda g: on * (g - (g * on).sum(axis=-1, keepdims=True) / on.sum(axis=-1, keepdims=True))),))


def cross_entropy(logits: Var, labels: np.ndarray, weights: np.ndarray) -> Var:
    """The sum over rows of the weighted cross-entropy."""
    z = logits.value
    loss = np.maximum(z, 0) - z * labels + np.log1p(np.exp(-np.abs(z)))
    return Var((weights * loss).sum(), ((logits, lambda g: g * weights * (_sigmoid(z) - labels)),))


def derivatives(out: Var, of: dict[str, Var]) -> dict[str, np.ndarray]:
    """The derivative of out (a number) with respect to each variable."""
    order, seen = [], set()
    stack = [(out, False)]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack += [(v, True), *((p, False) for p, _ in v.parents)]
    for v in order:
        v.grad = None
    out.grad = np.ones(())
    for v in reversed(order):
        if v.grad is None:
            continue
        for parent, back in v.parents:
            g = back(v.grad)
            parent.grad = g if parent.grad is None else parent.grad + g
    return {k: v.grad if v.grad is not None else np.zeros_like(v.value) for k, v in of.items()}
