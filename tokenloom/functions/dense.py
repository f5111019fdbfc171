"""Numpy kernels for whole layers, run inside Arrow batches where row-wise expressions would be slow."""

from __future__ import annotations

import numpy as np


def rms_norm(x: np.ndarray, gain: np.ndarray | None, eps: float = 1e-5) -> np.ndarray:
    y = x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps)
    return y if gain is None else y * gain


def silu(x: np.ndarray) -> np.ndarray:
    return x / (1.0 + np.exp(-x))


def softmax(x: np.ndarray, axis: int = -1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def rope(x: np.ndarray, positions: np.ndarray, theta: float = 10000.0) -> np.ndarray:
    """x: (..., positions, d); interleaved pairs."""
    d = x.shape[-1]
    angle = positions[:, None] * theta ** (-np.arange(0, d, 2) / d)
    even, odd = x[..., 0::2], x[..., 1::2]
    out = np.empty_like(x)
    out[..., 0::2] = even * np.cos(angle) - odd * np.sin(angle)
    out[..., 1::2] = even * np.sin(angle) + odd * np.cos(angle)
    return out


def attention(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    s = q @ np.swapaxes(k, -1, -2) / np.sqrt(q.shape[-1])
    if mask is not None:
        s = np.where(mask, s, -np.inf)
    return softmax(s) @ v


def multi_head(x: np.ndarray, w: dict[str, np.ndarray], heads: int, theta: float | None) -> np.ndarray:
    """Causal self-attention over x (positions, d); theta None: no rotation."""
    n, d = x.shape
    split = lambda y: y.reshape(n, heads, d // heads).transpose(1, 0, 2)
    q, k, v = (split(x @ w[name].T) for name in ("q", "k", "v"))
    if theta is not None:
        q, k = rope(q, np.arange(n), theta), rope(k, np.arange(n), theta)
    out = attention(q, k, v, np.tril(np.ones((n, n), dtype=bool)))
    return out.transpose(1, 0, 2).reshape(n, d) @ w["o"].T


def feed_forward(x: np.ndarray, w: dict[str, np.ndarray], kind: str = "swiglu") -> np.ndarray:
    if kind == "swiglu":
        return (silu(x @ w["w1"].T) * (x @ w["w3"].T)) @ w["w2"].T
    if kind == "silu":
        return silu(x @ w["w1"].T) @ w["w2"].T
    raise ValueError(f"unknown feed-forward: {kind}")


def block(x: np.ndarray, w: dict[str, np.ndarray], heads: int, theta: float | None = 10000.0, norm: str = "pre", ffn: str = "swiglu") -> np.ndarray:
    """A Transformer block; norm: pre, post or none."""
    if norm == "pre":
        x = x + multi_head(rms_norm(x, w["ln1"]), w, heads, theta)
        return x + feed_forward(rms_norm(x, w["ln2"]), w, ffn)
    if norm == "post":
        x = rms_norm(x + multi_head(x, w, heads, theta), w["ln1"])
        return rms_norm(x + feed_forward(x, w, ffn), w["ln2"])
    if norm == "none":
        x = x + multi_head(x, w, heads, theta)
        return x + feed_forward(x, w, ffn)
    raise ValueError(f"unknown norm: {norm}")


def language_model(ids: np.ndarray, w: dict, heads: int, theta: float | None = 10000.0, norm: str = "pre", ffn: str = "swiglu") -> np.ndarray:
    """Logits (positions, vocabulary), not normalised."""
    x = w["embedding"][ids]
    for layer in w["layers"]:
        x = block(x, layer, heads, theta, norm, ffn)
    if norm != "none":
        x = rms_norm(x, w["ln_final"])
    return x @ w["head"].T


class Decoder:
    """A language model (pre-norm) that reads ids as they come: keys and values of each layer are kept, by head and position,
    so a new id attends with one query and nothing before it is computed again."""

    def __init__(self, w: dict, heads: int, theta: float | None = 10000.0):
        self.w, self.heads, self.theta = w, heads, theta
        self.forget()

    def forget(self) -> None:
        self.length, self.kept = 0, [None] * len(self.w["layers"])

    def read(self, ids: np.ndarray) -> np.ndarray:
        """Logits after the last of ids, which follow those read before."""
        x, at = self.w["embedding"][ids], np.arange(self.length, self.length + len(ids))
        for n, layer in enumerate(self.w["layers"]):
            x = x + self._attend(rms_norm(x, layer["ln1"]), layer, n, at)
            x = x + feed_forward(rms_norm(x, layer["ln2"]), layer)
        self.length += len(ids)
        return rms_norm(x[-1:], self.w["ln_final"])[0] @ self.w["head"].T

    def _attend(self, x: np.ndarray, w: dict, n: int, at: np.ndarray) -> np.ndarray:
        m, d = x.shape
        q, k, v = ((x @ w[c].T).reshape(m, self.heads, d // self.heads).transpose(1, 0, 2) for c in "qkv")
        if self.theta is not None:
            q, k = rope(q, at, self.theta), rope(k, at, self.theta)
        if self.kept[n] is not None:
            k, v = (np.concatenate([old, new], axis=1) for old, new in zip(self.kept[n], (k, v)))
        self.kept[n] = (k, v)
        out = attention(q, k, v, np.arange(k.shape[1])[None, :] <= at[:, None])
        return out.transpose(1, 0, 2).reshape(m, d) @ w["o"].T
