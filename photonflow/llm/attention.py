"""A small causal self-attention model over subwords, in numpy: forward, backward, Adam.

One head looks back over the window and predicts the next subword's class; a table of class odds after the previous
subword is added to its logits. Which member of the class follows is told by a table of shares after the previous
subword. Classes are cut from the most frequent subwords by spectral bisection; all rarer ones form one more class.
Windows of 16 subwords overlap by 8, and each scores its last 8, so every target is scored once with 8 to 16 subwords
in sight.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH = 16
WINDOW = 16
STRIDE = 8
#: Subwords with an input vector of their own, by rank (the last stands for all rarer ones).
RANKS = 4096
#: Classes and members of one; the most frequent GROUPS * MEMBERS subwords are predicted each by itself.
GROUPS = 32
MEMBERS = 32
OUTPUTS = GROUPS * MEMBERS
START = RANKS
#: Windows computed at once.
BATCH = 1024
_DISTANCE = np.arange(STRIDE, WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_MASK = np.where(_DISTANCE < 0, np.float32(-1e9), np.float32(0))
SHAPES = {"e": (RANKS + 1, WIDTH), "q": (WIDTH, WIDTH), "k": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "r": (WINDOW,), "w": (WIDTH, WIDTH), "b": (WIDTH,), "o": (WIDTH, GROUPS + 1)}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())


def start_weights(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = {n: rng.normal(0, 0.3 if n == "e" else WIDTH**-0.5, s) for n, s in SHAPES.items()}
    parts |= {n: np.zeros(SHAPES[n]) for n in ("r", "b", "o")}
    return np.concatenate([p.ravel() for p in parts.values()]).astype(np.float32)


def named(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the flat weights by name."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def windows(before: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences laid out one after the other (starts: where each begins; none is empty), by the rank that stands before
    each target: (windows, 16) inputs, and the place of each window's 8 targets, -1 beyond a sequence's end."""
    lengths = np.diff(np.append(starts, len(before)))
    blocks = -(-lengths // STRIDE)
    offsets = np.concatenate([[0], np.cumsum((blocks + 1) * STRIDE)[:-1]])
    at = np.arange(len(before)) + np.repeat(offsets - starts + STRIDE, lengths)
    padded = np.full(int(((blocks + 1) * STRIDE).sum()), START, np.uint16)
    padded[at] = before
    places = np.full(len(padded), -1, np.int32)
    places[at] = np.arange(len(before))
    first = STRIDE * (np.arange(int(blocks.sum())) + np.repeat(np.arange(len(blocks)), blocks))
    return padded[first[:, None] + np.arange(WINDOW)], places[first[:, None] + np.arange(STRIDE, WINDOW)]


def _bisect(rows: np.ndarray, members: np.ndarray, groups: int) -> list[np.ndarray]:
    if groups == 1:
        return [members]
    part = rows[members] - rows[members].mean(axis=0)
    along = np.ones(part.shape[1])
    for _ in range(30):  # the leading direction, by power iteration
        along = part.T @ (part @ along)
        along /= max(float(np.linalg.norm(along)), 1e-12)
    order = members[np.argsort(part @ along, kind="stable")]
    return [g for half in np.array_split(order, 2) for g in _bisect(rows, half, groups // 2)]


@dataclass
class Outputs:
    """place: a rank's place among the outputs, class by class (the last: any rarer subword); odds: logarithms of the
    classes' shares after a subword; members: logarithms of the outputs' shares in their classes."""

    place: np.ndarray
    odds: np.ndarray
    members: np.ndarray

    @classmethod
    def of(cls, table: np.ndarray, back: float = 4.0) -> Outputs:
        """table: (RANKS + 1, OUTPUTS + 1) counts of the next subword's rank among the outputs after a subword's among the inputs."""
        whole = table.sum(axis=0) + 0.5
        whole /= whole.sum()
        kinds = (table > 0).sum(axis=1, keepdims=True) + back  # the more kinds follow, the more goes to the general shares
        p = (table + kinds * whole) / (table.sum(axis=1, keepdims=True) + kinds)
        near = table[:, :OUTPUTS].T + 0.1
        rows = np.sqrt(near / near.sum(axis=1, keepdims=True))
        order = np.append(np.concatenate(_bisect(rows, np.arange(OUTPUTS), GROUPS)), OUTPUTS)
        place = np.empty(OUTPUTS + 1, np.int64)
        place[order] = np.arange(OUTPUTS + 1)
        p = p[:, order]
        classes = np.concatenate([p[:, :OUTPUTS].reshape(-1, GROUPS, MEMBERS).sum(axis=2), p[:, OUTPUTS:]], axis=1)
        return cls(place, np.log(classes).astype(np.float32), np.log(p / classes[:, np.arange(OUTPUTS + 1) // MEMBERS]).astype(np.float32))

    def targets(self, ranks: np.ndarray) -> np.ndarray:
        return self.place[np.minimum(ranks, OUTPUTS)]


class Scorer:
    """The model made ready for scoring: every product that depends on one subword alone is a table."""

    def __init__(self, flat: np.ndarray, outputs: Outputs):
        p = named(flat)
        self.q = p["e"] @ p["q"] * np.float32(WIDTH**-0.5)
        self.k = p["e"] @ p["k"]
        self.v = p["e"] @ p["v"] @ p["w"]
        self.own = p["e"] @ p["w"] + p["b"]
        self.o, self.outputs = p["o"], outputs
        self.bias = p["r"][np.maximum(_DISTANCE, 0)] + _MASK

    def log_probability(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each target (of the last one: of any rare subword)."""
        out = np.empty(targets.shape, np.float32)
        for i in range(0, len(inputs), BATCH):
            x, y = inputs[i : i + BATCH], targets[i : i + BATCH].ravel()
            mine = x[:, STRIDE:]
            a = np.matmul(self.q[mine], self.k[x].transpose(0, 2, 1))
            a += self.bias
            np.exp(a, out=a)
            a /= a.sum(axis=2, keepdims=True)
            h = np.matmul(a, self.v[x])
            h += self.own[mine]
            h /= 1 + np.abs(h)
            before = mine.ravel()
            logits = h.reshape(-1, WIDTH) @ self.o
            logits += self.outputs.odds[before]
            found = logits[np.arange(len(y)), y // MEMBERS] + self.outputs.members[before, y]
            np.exp(logits, out=logits)
            out[i : i + BATCH] = (found - np.log(logits.sum(axis=1))).reshape(-1, STRIDE)
        return out


def gradient(flat: np.ndarray, outputs: Outputs, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each target's class, and the gradient of their weighted mean cross entropy. Tables are not trained."""
    p, g = named(flat), named(grad := np.zeros_like(flat))
    scale = np.float32(WIDTH**-0.5)
    flat2 = lambda t: t.reshape(-1, t.shape[-1])
    before, group = x[:, STRIDE:].ravel(), y.ravel() // MEMBERS
    share = (weight.ravel() / max(weight.sum(), 1e-9)).astype(flat.dtype)
    e = p["e"][x]
    eq = np.ascontiguousarray(e[:, STRIDE:])
    q, k, v = eq @ p["q"] * scale, e @ p["k"], e @ p["v"]
    a = np.matmul(q, k.transpose(0, 2, 1))
    a += (p["r"][np.maximum(_DISTANCE, 0)] + _MASK).astype(flat.dtype)
    a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    a /= a.sum(axis=2, keepdims=True)
    u = flat2(eq + np.matmul(a, v))
    s = u @ p["w"] + p["b"]
    soft = 1 + np.abs(s)
    h = s / soft
    d = h @ p["o"] + outputs.odds[before]
    d -= d.max(axis=1, keepdims=True)
    at = np.arange(len(group))
    found = d[at, group]
    np.exp(d, out=d)
    total = d.sum(axis=1, keepdims=True)
    found -= np.log(total[:, 0])
    d /= total
    d[at, group] -= 1
    d *= share[:, None]
    g["o"] += h.T @ d
    dh = (d @ p["o"].T) / (soft * soft)
    g["w"] += u.T @ dh
    g["b"] += dh.sum(axis=0)
    du = (dh @ p["w"].T).reshape(eq.shape)
    da = np.matmul(du, v.transpose(0, 2, 1))
    dv = np.matmul(a.transpose(0, 2, 1), du)
    da -= (da * a).sum(axis=2, keepdims=True)
    da *= a
    np.add.at(g["r"], np.maximum(_DISTANCE, 0).ravel(), np.where(_DISTANCE < 0, 0, da.sum(axis=0)).ravel())
    dq, dk = np.matmul(da, k) * scale, np.matmul(da.transpose(0, 2, 1), q)
    g["q"] += flat2(eq).T @ flat2(dq)
    g["k"] += flat2(e).T @ flat2(dk)
    g["v"] += flat2(e).T @ flat2(dv)
    de = dk @ p["k"].T
    de += dv @ p["v"].T
    de[:, STRIDE:] += dq @ p["q"].T + du
    order = np.argsort(x, axis=None, kind="stable")
    seen, first = np.unique(x.ravel()[order], return_index=True)
    g["e"][seen] += np.add.reduceat(flat2(de)[order], first, axis=0)
    return found, grad


@dataclass
class Adam:
    weights: np.ndarray
    rate: float = 0.01

    def __post_init__(self):
        self.weights = self.weights.copy()
        self.m, self.s, self.t = np.zeros_like(self.weights), np.zeros_like(self.weights), 0

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.s += 0.01 * (grad * grad - self.s)
        self.weights -= (self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
