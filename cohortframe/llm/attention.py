"""A small causal self-attention model in numpy: one masked head, one hidden layer, classes of symbols as output."""

from __future__ import annotations

import numpy as np

WINDOW, CONTEXT = 32, 16        # tokens a window sees, and how many of them the window before has scored already
STRIDE = WINDOW - CONTEXT
WIDTH, HIDDEN = 16, 32
NAMES = ["e", "p", "wq", "wk", "wv", "w1", "b1", "w2", "b2"]
LARGE = 60          # exponents up to here need no shift in single precision
_MASK = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences laid end to end: first position of each window, and its sequence.

    The first window of a sequence scores all its positions, a later one those after its first ``CONTEXT``; together
    they score every position once.
    """
    n = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    of = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return (np.cumsum(lengths) - lengths)[of] + STRIDE * k, of


class Attention:
    def __init__(self, symbols: int, classes: int, seed: int = 3):
        rng = np.random.default_rng(seed)

        def draw(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) == 2 and shape[0] <= HIDDEN else WIDTH)).astype(np.float32)

        self.shapes = {"e": (symbols, WIDTH), "p": (WINDOW, WIDTH), "wq": (WIDTH, WIDTH), "wk": (WIDTH, WIDTH), "wv": (WIDTH, WIDTH),
                       "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, classes), "b2": (classes,)}
        self.w = {k: np.zeros(s, np.float32) if len(s) == 1 else draw(*s) for k, s in self.shapes.items()}
        self.load(self.flat())

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].reshape(-1) for k in NAMES])

    def load(self, flat: np.ndarray) -> Attention:
        """Take these weights; the slopes of earlier steps are forgotten."""
        at = 0
        self.g2 = {k: np.full(s, 1e-3, np.float32) for k, s in self.shapes.items()}
        for k in NAMES:
            n = int(np.prod(self.shapes[k]))
            self.w[k] = flat[at:at + n].reshape(self.shapes[k]).astype(np.float32)
            at += n
        return self

    def _attend(self, s: np.ndarray, lo: int = 0) -> tuple:
        """The hidden state of each position from ``lo`` on of windows of symbols, and what led to it; those before are only looked back at."""
        w = self.w
        x = w["e"].take(s, 0)
        x += w["p"]
        mixed = (x.reshape(-1, WIDTH) @ np.concatenate([w["wk"], w["wv"]], 1)).reshape(len(s), WINDOW, 2 * WIDTH)
        k, v = mixed[:, :, :WIDTH], mixed[:, :, WIDTH:]
        own = x[:, lo:]
        q = (own.reshape(-1, WIDTH) @ (w["wq"] / np.float32(np.sqrt(WIDTH)))).reshape(own.shape)
        a = q @ k.transpose(0, 2, 1)
        if a.max(initial=0) > LARGE:
            a -= a.max(2, keepdims=True)
        a += _MASK[lo:]                 # a token sees itself and those before it
        np.exp(a, out=a)
        total = a @ np.ones((WINDOW, 1), a.dtype)
        got = a @ v
        got /= total
        return x, q, k, v, a, total, got, own + got

    def _judge(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and class scores of hidden states."""
        w = self.w
        u = h @ w["w1"]
        u += w["b1"]
        np.maximum(u, 0, out=u)
        z = u @ w["w2"]
        z += w["b2"]
        if z.max(initial=0) > LARGE:
            z -= z.max(1, keepdims=True)
        return u, z

    def log_classes(self, s: np.ndarray, target: np.ndarray, scored: np.ndarray) -> np.ndarray:
        """Natural log-probability of the target class at the scored positions, one after the other (all n x WINDOW)."""
        lo = _first(scored)
        scored = scored[:, lo:]
        z = self._judge(self._attend(s, lo)[-1][scored])[1]
        picked = z[np.arange(len(z)), target[:, lo:][scored]]
        np.exp(z, out=z)
        return picked - np.log(z @ np.ones(z.shape[1], z.dtype))

    def learn(self, s: np.ndarray, target: np.ndarray, valid: np.ndarray, rate: float) -> None:
        """One Adagrad step on the mean cross-entropy of the valid positions."""
        w = self.w
        lo = _first(valid)
        target, valid = target[:, lo:].reshape(-1), valid[:, lo:].reshape(-1, 1)
        x, q, k, v, a, total, got, h = self._attend(s, lo)
        flat = h.reshape(-1, WIDTH)
        u, p = self._judge(flat)
        np.exp(p, out=p)
        share = np.float32(1 / max(1, np.count_nonzero(valid)))
        p *= share / (p @ np.ones((p.shape[1], 1), p.dtype))
        p[np.arange(len(p)), target] -= share
        if not valid.all():
            p *= valid
        g = {"w2": u.T @ p, "b2": np.ones(len(p), p.dtype) @ p}
        du = p @ w["w2"].T
        du *= u > 0
        g["w1"], g["b1"] = flat.T @ du, np.ones(len(du), du.dtype) @ du
        dh = (du @ w["w1"].T).reshape(h.shape)
        part = dh / total               # the weights of the attention are a / total
        ds = part @ v.transpose(0, 2, 1)
        ds -= np.einsum("ijk,ijk->ij", part, got)[:, :, None]
        ds *= a
        dq = (ds @ k).reshape(-1, WIDTH)
        dq *= np.float32(1 / np.sqrt(WIDTH))
        dkv = np.empty((len(s), WINDOW, 2 * WIDTH), dq.dtype)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
        np.matmul(a.transpose(0, 2, 1), part, out=dkv[:, :, WIDTH:])
        dkv = dkv.reshape(-1, 2 * WIDTH)
        g["wq"] = x[:, lo:].reshape(-1, WIDTH).T @ dq
        both = x.reshape(-1, WIDTH).T @ dkv
        g["wk"], g["wv"] = both[:, :WIDTH], both[:, WIDTH:]
        dx = (dkv @ np.concatenate([w["wk"], w["wv"]], 1).T).reshape(x.shape)
        dq = dq @ w["wq"].T
        dq += dh.reshape(-1, WIDTH)
        dx[:, lo:] += dq.reshape(h.shape)
        g["p"] = dx.sum(0)
        # a symbol that does not occur has no slope and keeps its embedding
        every, met = np.zeros(w["e"].size, dx.dtype), np.zeros(len(w["e"]), bool)
        np.add.at(every, (s.reshape(-1, 1) * WIDTH + np.arange(WIDTH)).reshape(-1), dx.reshape(-1))
        met[s.reshape(-1)] = True
        met = np.flatnonzero(met)
        d = every.reshape(-1, WIDTH).take(met, 0)
        for name, slope in g.items():
            self.g2[name] += slope * slope
            w[name] -= rate * slope / np.sqrt(self.g2[name])
        g2 = self.g2["e"].take(met, 0)
        g2 += d * d
        self.g2["e"][met] = g2
        w["e"][met] = w["e"].take(met, 0) - rate * d / np.sqrt(g2)


def _first(asked: np.ndarray) -> int:
    """From where on windows are asked about: all of them, or what follows the context of later windows."""
    return 0 if asked[:, :CONTEXT].any() else CONTEXT
