"""A bidirectional gated recurrent network over bytes, in numpy.

Arrays are [feature, lane]: a lane is one window of bytes.  Each direction has
an input table (256 bytes to the three gates), a recurrent matrix, and a bias in
the table; a position's label comes from both directions' states there.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Gru:
    """One direction. table: [3 * h, 256]; u: [3 * h, h]; gates in the order update, reset, candidate."""

    table: np.ndarray
    u: np.ndarray

    @property
    def h(self) -> int:
        return self.u.shape[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def step(net: Gru, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """(next state, update, reset, candidate, recurrent part of the candidate) for the bytes x."""
    k = net.h
    a = net.table.take(x, axis=1)
    r = net.u @ h
    gates = _sigmoid(a[: 2 * k] + r[: 2 * k])
    z, reset, inner = gates[:k], gates[k:], r[2 * k :]
    n = a[2 * k :]
    n += reset * inner
    np.tanh(n, out=n)
    out = h - n
    out *= z
    out += n
    return out, z, reset, n, inner


def states(net: Gru, x: np.ndarray, length: np.ndarray, back: bool) -> np.ndarray:
    """[position, feature, lane] states. x: [position, lane]; lengths descend, and what follows a lane's end has no effect."""
    t, n = x.shape
    out = np.zeros((t, net.h, n), np.float32)
    h = np.zeros((net.h, n), np.float32)
    for i in range(t - 1, -1, -1) if back else range(t):
        live = int(np.searchsorted(-length, -i, side="left"))
        if live:
            h[:, :live] = out[i, :, :live] = step(net, h[:, :live], x[i, :live])[0]
    return out


@dataclass
class Labeller:
    forward: Gru
    backward: Gru
    #: [label, 2 * h] and [label, 1]
    v: np.ndarray
    b: np.ndarray

    def pooled(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """[label, lane] sums over the positions of the labels' probabilities."""
        f, g = states(self.forward, x, length, False), states(self.backward, x, length, True)
        k, total = self.forward.h, np.zeros((len(self.b), x.shape[1]), np.float32)
        for i in range(len(x)):
            live = int(np.searchsorted(-length, -i, side="left"))
            p = self.v[:, :k] @ f[i, :, :live] + self.v[:, k:] @ g[i, :, :live] + self.b
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            total[:, :live] += p
        return total


def _backward(net: Gru, x: np.ndarray, dout: np.ndarray, order: list[int], kept: dict) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the table and the recurrent matrix, through time."""
    k = net.h
    du, dtable, dh = np.zeros_like(net.u), np.zeros_like(net.table), np.zeros_like(dout[0])
    d_all = np.empty((len(order), 3 * k, x.shape[1]), np.float32)
    for i in reversed(order):
        h, z, r, n, inner = kept[i]
        dh = dh + dout[i]
        da = d_all[i]
        dn = dh * (1 - z) * (1 - n * n)
        da[:k] = dh * (h - n) * z * (1 - z)
        da[k : 2 * k] = dn * inner * r * (1 - r)
        da[2 * k :] = dn
        d_rec = np.concatenate([da[: 2 * k], dn * r])
        du += d_rec @ h.T
        dh = dh * z + net.u.T @ d_rec
    flat = d_all.transpose(1, 0, 2).reshape(3 * k, -1)
    for j in range(3 * k):
        dtable[j] = np.bincount(x.ravel(), weights=flat[j], minlength=256)
    return dtable, du


def train(x: np.ndarray, y: np.ndarray, n_labels: int, *, h: int, steps: int, batch: int, rate: float, seed: int = 7) -> Labeller:
    """Fit to windows x [lane, position] of whole length with a label y each, every position being labelled; Adam."""
    rng = np.random.default_rng(seed)
    def net() -> Gru:
        return Gru(rng.normal(0, 0.3, (3 * h, 256)).astype(np.float32), rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h)).astype(np.float32))
    nets = [net(), net()]
    v, b = rng.normal(0, 0.1, (n_labels, 2 * h)).astype(np.float32), np.zeros((n_labels, 1), np.float32)
    params = [nets[0].table, nets[0].u, nets[1].table, nets[1].u, v, b]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t = x.shape[1]
    orders = [list(range(t)), list(range(t - 1, -1, -1))]
    for it in range(1, steps + 1):
        at = rng.integers(0, len(x), batch)
        xb, yb = np.ascontiguousarray(x[at].T), y[at]
        out, kept = [], []
        for g, order in zip(nets, orders, strict=True):
            state, own, keep = np.zeros((h, batch), np.float32), np.empty((t, h, batch), np.float32), {}
            for i in order:
                new, z, r, n, inner = step(g, state, xb[i])
                keep[i] = (state, z, r, n, inner)
                state = own[i] = new
            out.append(own)
            kept.append(keep)
        both = np.concatenate(out, axis=1)
        p = np.einsum("lk,tkb->tlb", v, both) + b
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[:, yb, np.arange(batch)] -= 1
        p /= t * batch
        grads = []
        d = np.einsum("lk,tlb->tkb", v, p)
        for g, order, keep, part in zip(nets, orders, kept, (d[:, :h], d[:, h:]), strict=True):
            grads += _backward(g, xb, part, order, keep)
        grads += [np.einsum("tlb,tkb->lk", p, both), p.sum(axis=(0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for k, (param, g) in enumerate(zip(params, grads, strict=True)):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            param -= (rate * (m[k] / (1 - 0.9**it)) / (np.sqrt(s[k] / (1 - 0.99**it)) + 1e-6)).astype(np.float32)
    return Labeller(nets[0], nets[1], v, b)
