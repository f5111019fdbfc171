"""Reverse mode for a Transformer language model: each layer returns its value and the function that carries gradients back.

Kernels for Arrow batches: arrays are (sequences, positions, features); parameters are a dictionary of matrices.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import dense

EPS = 1e-5
Back = Callable[[np.ndarray], np.ndarray]


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


class Tape:
    """Parameters and what their gradients add up to."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.params, self.grads = params, {n: np.zeros_like(p) for n, p in params.items()}

    def linear(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        w = self.params[name]

        def back(dy: np.ndarray) -> np.ndarray:
            self.grads[name] += _flat(dy).T @ _flat(x)
            return dy @ w

        return x @ w.T, back

    def norm(self, x: np.ndarray, name: str) -> tuple[np.ndarray, Back]:
        gain, root = self.params[name][0], 1 / np.sqrt((x * x).mean(axis=-1, keepdims=True) + EPS)

        def back(dy: np.ndarray) -> np.ndarray:
            self.grads[name][0] += _flat(dy * x * root).sum(axis=0)
            t = dy * gain
            return root * t - x * root**3 * (t * x).mean(axis=-1, keepdims=True)

        return x * root * gain, back

    def attention(self, x: np.ndarray, layer: str, heads: int, theta: float) -> tuple[np.ndarray, Back]:
        """Causal, with rotated queries and keys."""
        b, n, d = x.shape
        split = lambda y: y.reshape(b, n, heads, d // heads).transpose(0, 2, 1, 3)
        join = lambda y: y.transpose(0, 2, 1, 3).reshape(b, n, d)
        (q, back_q), (k, back_k), (v, back_v) = (self.linear(x, f"{layer}.{c}") for c in "qkv")
        places = np.arange(n)
        q, k, v = dense.rope(split(q), places, theta), dense.rope(split(k), places, theta), split(v)
        root = np.sqrt(d // heads)
        p = dense.softmax(np.where(np.tril(np.ones((n, n), dtype=bool)), q @ k.swapaxes(-1, -2) / root, -np.inf))
        y, back_o = self.linear(join(p @ v), f"{layer}.o")

        def back(dy: np.ndarray) -> np.ndarray:
            do = split(back_o(dy))
            dp = do @ v.swapaxes(-1, -2)
            ds = p * (dp - (dp * p).sum(axis=-1, keepdims=True)) / root
            unturned = lambda g: join(dense.rope(g, -places, theta))  # noqa: E731  a rotation's transpose turns the other way
            return back_q(unturned(ds @ k)) + back_k(unturned(ds.swapaxes(-1, -2) @ q)) + back_v(join(p.swapaxes(-1, -2) @ do))

        return y, back

    def swiglu(self, x: np.ndarray, layer: str) -> tuple[np.ndarray, Back]:
        (a, back_a), (c, back_c) = self.linear(x, f"{layer}.w1"), self.linear(x, f"{layer}.w3")
        s = 1 / (1 + np.exp(-a))
        y, back_y = self.linear(a * s * c, f"{layer}.w2")

        def back(dy: np.ndarray) -> np.ndarray:
            du = back_y(dy)
            return back_a(du * c * s * (1 + a * (1 - s))) + back_c(du * a * s)

        return y, back

    def block(self, x: np.ndarray, layer: str, heads: int, theta: float) -> tuple[np.ndarray, Back]:
        """Pre-norm."""
        n1, back_n1 = self.norm(x, f"{layer}.ln1")
        at, back_at = self.attention(n1, layer, heads, theta)
        mid = x + at
        n2, back_n2 = self.norm(mid, f"{layer}.ln2")
        ff, back_ff = self.swiglu(n2, layer)

        def back(dy: np.ndarray) -> np.ndarray:
            dy = dy + back_n2(back_ff(dy))
            return dy + back_n1(back_at(dy))

        return mid + ff, back


def loss_and_gradients(x: np.ndarray, y: np.ndarray, params: dict[str, np.ndarray], heads: int, theta: float = 10000.0, gradients: bool = True) -> tuple[float, dict[str, np.ndarray]]:
    """Sum of cross-entropies of targets y after ids x (sequences, positions), and its gradient by every parameter."""
    tape, backs = Tape(params), []
    h = params["embedding"][x]
    for layer in sorted({n.rpartition(".")[0] for n in params if n.startswith("layers.")}, key=lambda n: int(n.split(".")[1])):
        h, back = tape.block(h, layer, heads, theta)
        backs.append(back)
    h, back = tape.norm(h, "ln_final")
    logits, back_head = tape.linear(h, "head")
    p = dense.softmax(logits)
    at = (*np.indices(y.shape), y)
    loss = float(-np.log(p[at]).sum())
    if gradients:
        p[at] -= 1
        dh = back(back_head(p))
        for back in reversed(backs):
            dh = back(dh)
        np.add.at(tape.grads["embedding"], x, dh)
    return loss, tape.grads
