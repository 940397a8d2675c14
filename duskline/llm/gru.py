"""A gated recurrent layer in numpy, forward and backward, and Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def step(xp: np.ndarray, h: np.ndarray, wh: np.ndarray) -> np.ndarray:
    """One step: xp has the projected input of the gates z, r and the candidate."""
    n = h.shape[1]
    g = h @ wh
    zr = sigmoid(xp[:, : 2 * n] + g[:, : 2 * n])
    c = np.tanh(xp[:, 2 * n :] + zr[:, n:] * g[:, 2 * n :])
    return c + zr[:, :n] * (h - c)


def _across(x: np.ndarray) -> np.ndarray:
    """(T, B, n) as (T, n, B): the rows of a gate then lie together, which is what the steps below run over."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def forward(xp: np.ndarray, wh: np.ndarray, h: np.ndarray, keep: np.ndarray | None = None, reset: np.ndarray | None = None):
    """States (T, B, H) of inputs (T, B, 3H). Where keep is 0 the state stays; where reset is 1 it starts from 0."""
    out, cache = [], []
    n = h.shape[1]
    xt, h, w = _across(xp), np.ascontiguousarray(h.T), np.ascontiguousarray(wh.T)
    for t in range(len(xt)):
        if reset is not None:
            h = h * (1 - reset[t])
        g = w @ h
        zr = sigmoid(xt[t, : 2 * n] + g[: 2 * n])
        z, r = zr[:n], zr[n:]
        c = np.tanh(xt[t, 2 * n :] + r * g[2 * n :])
        new = c + z * (h - c)
        if keep is not None:
            new = h + keep[t] * (new - h)
        cache.append((h, z, r, c, g[2 * n :]))
        h = new
        out.append(h)
    return _across(np.stack(out)), cache


def backward(grad: np.ndarray, cache: list, wh: np.ndarray, keep: np.ndarray | None = None, reset: np.ndarray | None = None):
    """Gradients of inputs and recurrent weights from those of the states."""
    n = grad.shape[2]
    gt = _across(grad)
    dwh, dxp = np.zeros_like(wh.T), np.empty((len(gt), 3 * n, gt.shape[2]), gt.dtype)
    dh = np.zeros_like(gt[0])
    dg = np.empty_like(dxp[0])
    for t in range(len(gt) - 1, -1, -1):
        h, z, r, c, gn = cache[t]
        dh = dh + gt[t]
        new = dh if keep is None else dh * keep[t]
        past = new * z if keep is None else new * z + dh * (1 - keep[t])
        dz, dr, dc = dxp[t, :n], dxp[t, n : 2 * n], dxp[t, 2 * n :]
        np.multiply(new * (1 - z), 1 - c * c, out=dc)
        np.multiply(new * (h - c), z * (1 - z), out=dz)
        np.multiply(dc * gn, r * (1 - r), out=dr)
        dg[: 2 * n] = dxp[t, : 2 * n]
        np.multiply(dc, r, out=dg[2 * n :])
        dwh += dg @ h.T
        dh = past + wh @ dg
        if reset is not None:
            dh = dh * (1 - reset[t])
    return _across(dxp), np.ascontiguousarray(dwh.T)


class Adam:
    """Adam over a dict of arrays; sparse rows may be given as (index, gradient)."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01, clip: float = 1.0):
        self.params, self.rate, self.clip, self.n = params, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float | None = None) -> None:
        self.n += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads.values())))
        scale = min(1.0, self.clip / max(norm, 1e-9))
        step = float((rate or self.rate) * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (step * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(np.float32)
