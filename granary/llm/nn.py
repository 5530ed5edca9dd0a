"""A small bidirectional LSTM with Adam, in numpy, for the sequence labellers."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd

Parts = list[dict[str, np.ndarray]]
_fitted: dict[str, bytes] = {}


def fitted(spark, name: str, train: Callable[[], Parts], into: Parts) -> None:
    """Fill the parameters `into` with those that `train` gives. Training has fixed seeds; it runs in one Spark task
    (with one BLAS thread, and again elsewhere if its executor is lost), once per driver process."""
    if name not in _fitted:

        def work(batches):
            for _ in batches:
                yield pd.DataFrame({"model": [pickle.dumps(train())]})

        _fitted[name] = bytes(spark.range(1, numPartitions=1).mapInPandas(work, "model binary").first()["model"])
    for part, got in zip(into, pickle.loads(_fitted[name]), strict=True):
        part.update(got)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Lstm:
    """One direction. Inputs are (steps, sequences, features); mask (steps, sequences, 1) is 0 on padding, where the
    state is carried on unchanged."""

    def __init__(self, rng: np.random.Generator, inputs: int, hidden: int, backwards: bool) -> None:
        self.hidden, self.backwards = hidden, backwards
        self.p = {
            "w": (rng.normal(0, 1 / np.sqrt(inputs), (inputs, 4 * hidden))).astype(np.float32),
            "u": (rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))).astype(np.float32),
            "b": np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32),
        }

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        steps, n, _ = x.shape
        k = self.hidden
        pre = x.reshape(steps * n, -1) @ self.p["w"]
        pre = pre.reshape(steps, n, 4 * k) + self.p["b"]
        h = c = np.zeros((n, k), np.float32)
        out = np.empty((steps, n, k), np.float32)
        self.kept = []
        order = range(steps - 1, -1, -1) if self.backwards else range(steps)
        for t in order:
            z = pre[t] + h @ self.p["u"]
            gates = sigmoid(z[:, : 3 * k])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            c2 = f * c + i * g
            tc = np.tanh(c2)
            m = mask[t]
            if keep:
                self.kept.append((t, h, c, i, f, o, g, tc, m))
            h = m * (o * tc) + (1 - m) * h
            c = m * c2 + (1 - m) * c
            out[t] = h
        if keep:
            self.x = x
        return out

    def backward(self, dout: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        steps, n, _ = dout.shape
        k = self.hidden
        dh = np.zeros((n, k), np.float32)
        dc = np.zeros((n, k), np.float32)
        dz_all = np.zeros((steps, n, 4 * k), np.float32)
        grad_u = np.zeros_like(self.p["u"])
        for t, h, c, i, f, o, g, tc, m in reversed(self.kept):
            dh = dh + dout[t]
            dhn, dcn = dh * m, dc * m
            do = dhn * tc
            dc2 = dcn + dhn * o * (1 - tc * tc)
            dz = np.concatenate([dc2 * g * i * (1 - i), dc2 * c * f * (1 - f), do * o * (1 - o), dc2 * i * (1 - g * g)], axis=1)
            dz_all[t] = dz
            grad_u += h.T @ dz
            dh = dz @ self.p["u"].T + dh * (1 - m)
            dc = dc2 * f + dc * (1 - m)
        flat = dz_all.reshape(steps * n, -1)
        grads = {"w": self.x.reshape(steps * n, -1).T @ flat, "u": grad_u, "b": flat.sum(axis=0)}
        return (flat @ self.p["w"].T).reshape(self.x.shape), grads


class BiLstm:
    """Both directions and a linear layer to `outputs` scores per step."""

    def __init__(self, seed: int, inputs: int, hidden: int, outputs: int) -> None:
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng, inputs, hidden, False), Lstm(rng, inputs, hidden, True)
        self.p = {"v": (rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, outputs))).astype(np.float32), "a": np.zeros(outputs, np.float32)}

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> np.ndarray:
        both = np.concatenate([self.ahead.forward(x, mask, keep), self.back.forward(x, mask, keep)], axis=2)
        if keep:
            self.both = both
        return both @ self.p["v"] + self.p["a"]

    def backward(self, d: np.ndarray) -> tuple[np.ndarray, list[dict[str, np.ndarray]]]:
        k = self.ahead.hidden
        flat = d.reshape(-1, d.shape[2])
        own = {"v": self.both.reshape(-1, 2 * k).T @ flat, "a": flat.sum(axis=0)}
        dboth = d @ self.p["v"].T
        dx1, g1 = self.ahead.backward(dboth[:, :, :k])
        dx2, g2 = self.back.backward(dboth[:, :, k:])
        return dx1 + dx2, [own, g1, g2]

    def parts(self) -> list[dict[str, np.ndarray]]:
        return [self.p, self.ahead.p, self.back.p]


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.n, self.state = rate, 0, {}

    def step(self, parts: list[dict[str, np.ndarray]], grads: list[dict[str, np.ndarray]]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for one in grads for g in one.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, (part, grad) in enumerate(zip(parts, grads, strict=True)):
            for name, g in grad.items():
                g = g * scale
                m, v = self.state.get((k, name), (0, 0))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                self.state[k, name] = m, v
                part[name] -= (self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)).astype(np.float32)
