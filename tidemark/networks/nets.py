"""Networks over feature vectors [n, inputs] or sequences [n, steps, inputs]: weights by name, and the logits that they give.

A normalised layer takes the mean and variance of the rows that a task has at hand (in training), and running ones (else).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tidemark.networks import tape
from tidemark.networks.tape import Var

Weights = dict[str, np.ndarray]


@dataclass
class Pass:
    """One forward pass: weights as variables, running statistics, and what training needs besides."""

    weights: dict[str, Var]
    running: Weights
    rng: np.random.Generator | None = None  # in training
    seen: Weights = field(default_factory=dict)
    extra: Var | None = None  # added to the loss
    masks: list[np.ndarray] = field(default_factory=list)  # of attention steps

    def norm(self, x: Var, name: str) -> Var:
        scale, shift = self.weights[f"{name}.scale"], self.weights[f"{name}.shift"]
        if self.rng is not None:
            out, self.seen[f"{name}.mean"], self.seen[f"{name}.var"] = tape.normalised(x, scale, shift)
            return out
        by = scale * (1 / np.sqrt(self.running[f"{name}.var"] + 1e-5))
        return x * by + (shift - by * self.running[f"{name}.mean"])

    def dense(self, x: Var, name: str) -> Var:
        return tape.affine(x, self.weights[f"{name}.w"], self.weights[f"{name}.b"])

    def drop(self, x: Var, share: float) -> Var:
        if self.rng is None or not share:
            return x
        return x * ((self.rng.random(x.value.shape) >= share) / (1 - share))


def _dense(rng: np.random.Generator, name: str, a: int, b: int) -> Weights:
    return {f"{name}.w": rng.normal(size=(a, b)) * np.sqrt(2 / (a + b)), f"{name}.b": np.zeros(b)}


def _norm(name: str, n: int) -> Weights:
    return {f"{name}.scale": np.ones(n), f"{name}.shift": np.zeros(n)}


def _running(name: str, n: int) -> Weights:
    return {f"{name}.mean": np.zeros(n), f"{name}.var": np.ones(n)}


@dataclass(frozen=True)
class Net:
    """weights and running statistics to begin with, and the logits of inputs."""

    weights: Weights
    running: Weights
    logits: Callable[[Pass, np.ndarray], Var]


def perceptron(inputs: int, rng: np.random.Generator, hidden: int = 64, dropout: float = 0.1) -> Net:
    """Two hidden layers, normalised."""
    weights = _dense(rng, "one", inputs, hidden) | _norm("n1", hidden) | _dense(rng, "two", hidden, hidden // 2) | _norm("n2", hidden // 2) | _dense(rng, "out", hidden // 2, 1)

    def logits(p: Pass, x: np.ndarray) -> Var:
        h = p.drop(tape.relu(p.norm(p.dense(Var(x), "one"), "n1")), dropout)
        h = p.drop(tape.relu(p.norm(p.dense(h, "two"), "n2")), dropout)
        return p.dense(h, "out")[:, 0]

    return Net(weights, _running("n1", hidden) | _running("n2", hidden // 2), logits)


def _convolved(p: Pass, x: Var, name: str) -> Var:
    """Kernels of three places, with zeros around."""
    return p.dense(tape.joined([tape.shifted(x, 1), x, tape.shifted(x, -1)]), name)


def convolutional(inputs: int, rng: np.random.Generator, filters: int = 32, dropout: float = 0.1) -> Net:
    """Two convolutions along the features, their mean, and two dense layers."""
    weights = _dense(rng, "c1", 3, filters) | _norm("n1", filters) | _dense(rng, "c2", 3 * filters, 2 * filters) | _norm("n2", 2 * filters)
    weights |= _dense(rng, "one", 2 * filters, filters) | _dense(rng, "out", filters, 1)

    def logits(p: Pass, x: np.ndarray) -> Var:
        h = tape.relu(p.norm(_convolved(p, Var(x[:, :, None]), "c1"), "n1"))
        h = tape.relu(p.norm(_convolved(p, h, "c2"), "n2"))
        return p.dense(tape.relu(p.dense(p.drop(tape.mean(h, 1), dropout), "one")), "out")[:, 0]

    return Net(weights, _running("n1", filters) | _running("n2", 2 * filters), logits)


def _lstm_weights(rng: np.random.Generator, name: str, inputs: int, hidden: int) -> Weights:
    return _dense(rng, name, inputs + hidden, 4 * hidden)


def _lstm(p: Pass, steps: list[Var], name: str, hidden: int) -> list[Var]:
    h = c = Var(np.zeros((steps[0].value.shape[0], hidden)))
    out = []
    for x in steps:
        z = p.dense(tape.joined([x, h]), name)
        i, f, o = (tape.sigmoid(z[:, k * hidden : (k + 1) * hidden]) for k in range(3))
        c = f * c + i * tape.tanh(z[:, 3 * hidden :])
        h = o * tape.tanh(c)
        out.append(h)
    return out


def _rnn(p: Pass, steps: list[Var], name: str, hidden: int) -> list[Var]:
    h, out = Var(np.zeros((steps[0].value.shape[0], hidden))), []
    for x in steps:
        h = tape.tanh(p.dense(tape.joined([x, h]), name))
        out.append(h)
    return out


def _steps(x: np.ndarray) -> list[Var]:
    x = x if x.ndim == 3 else x[:, None, :]
    return [Var(x[:, i]) for i in range(x.shape[1])]


def _head(p: Pass, h: Var, dropout: float) -> Var:
    return p.dense(p.drop(tape.relu(p.dense(h, "one")), dropout), "out")[:, 0]


def recurrent(inputs: int, rng: np.random.Generator, cells: tuple[str, ...] = ("lstm",), hidden: int = 64, dropout: float = 0.1) -> Net:
    """Layers of `lstm` or `rnn` cells over the steps of a sequence, then two dense layers on the last step's state."""
    weights = _dense(rng, "one", hidden, hidden // 2) | _dense(rng, "out", hidden // 2, 1)
    for k, cell in enumerate(cells):
        a = hidden if k else inputs
        weights |= _lstm_weights(rng, f"r{k}", a, hidden) if cell == "lstm" else _dense(rng, f"r{k}", a + hidden, hidden)

    def logits(p: Pass, x: np.ndarray) -> Var:
        steps = _steps(x)
        for k, cell in enumerate(cells):
            steps = (_lstm if cell == "lstm" else _rnn)(p, steps, f"r{k}", hidden)
        return _head(p, steps[-1], dropout)

    return Net(weights, {}, logits)


def convolutional_lstm(inputs: int, rng: np.random.Generator, filters: int = 32, hidden: int = 64, dropout: float = 0.1) -> Net:
    """A convolution along the features, whose mean at each step an LSTM takes in."""
    weights = _dense(rng, "c1", 3, filters) | _lstm_weights(rng, "r0", filters, hidden) | _dense(rng, "one", hidden, hidden // 2) | _dense(rng, "out", hidden // 2, 1)

    def logits(p: Pass, x: np.ndarray) -> Var:
        steps = [tape.mean(tape.relu(_convolved(p, Var(s.value[:, :, None]), "c1")), 1) for s in _steps(x)]
        return _head(p, _lstm(p, steps, "r0", hidden)[-1], dropout)

    return Net(weights, {}, logits)


def attentive(inputs: int, rng: np.random.Generator, width: int = 16, steps: int = 3, gamma: float = 1.3, sparse: float = 1e-3) -> Net:
    """Steps of attention over the features: sparsemax masks, with a prior scale on what was used, each feeding gated layers."""
    weights = _norm("n0", inputs) | _dense(rng, "shared", inputs, 4 * width) | _dense(rng, "out", width, 1)
    running = _running("n0", inputs)
    for s in range(steps + 1):
        weights |= _dense(rng, f"t{s}", 2 * width, 4 * width)
    for s in range(steps):
        weights |= _dense(rng, f"a{s}", width, inputs) | _norm(f"m{s}", inputs)
        running |= _running(f"m{s}", inputs)

    def gated(z: Var) -> Var:
        return z[:, : 2 * width] * tape.sigmoid(z[:, 2 * width :])

    def transformed(p: Pass, x: Var, s: int) -> Var:
        h = gated(p.dense(x, "shared"))
        return (h + gated(p.dense(h, f"t{s}"))) * np.sqrt(0.5)

    def logits(p: Pass, x: np.ndarray) -> Var:
        x0 = p.norm(Var(x), "n0")
        prior, h, decided = Var(np.ones(x.shape)), transformed(p, x0, 0), None
        for s in range(steps):
            mask = tape.sparsemax(p.norm(p.dense(h[:, width:], f"a{s}"), f"m{s}") * prior)
            p.masks.append(mask.value)
            prior = prior * (mask * -1.0 + gamma)
            entropy = tape.total(mask * tape.log(mask + 1e-10)) * (-sparse / steps)
            p.extra = entropy if p.extra is None else p.extra + entropy
            h = transformed(p, mask * x0, s + 1)
            d = tape.relu(h[:, :width])
            decided = d if decided is None else decided + d
        return p.dense(decided, "out")[:, 0]

    return Net(weights, running, logits)


def net(kind: str, inputs: int, seed: int, **params) -> Net:
    """A network of this kind with new weights; the same for a seed."""
    rng = np.random.default_rng(seed)
    kinds = {"mlp": perceptron, "cnn": convolutional, "cnn_lstm": convolutional_lstm, "tabnet": attentive}
    if kind in kinds:
        return kinds[kind](inputs, rng, **params)
    cells = {"rnn": ("rnn",), "lstm": ("lstm",), "rnn_lstm": ("rnn", "lstm")}
    if kind in cells:
        return recurrent(inputs, rng, cells[kind] * params.pop("layers", 1), **params)
    raise ValueError(f"no network {kind}")
