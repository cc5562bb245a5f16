"""A causal self-attention language model in numpy: forward, gradients and Adam.

Inputs are an id and the one before it at every place; one attention layer over the
window, a residual, and a two-layer perceptron give a state of ``WIDTH`` numbers.
The next id's distribution is one softmax in two steps: over the ``HEAD`` most
frequent ids and the clusters of all others, then over the ids of a cluster, whose
sizes grow with the rank.  Both steps take their logits from the state, so attention decides
every id's probability.  Exponents have base two, which numpy computes fastest.  The probabilities of all ids sum to one.

Ids are ranks by frequency here; ``rest`` is one more id that stands for all that
training never saw.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

WINDOW, OVERLAP = 64, 8
WIDTH, KEYS, HIDDEN, HEAD = 24, 8, 32, 128
#: Windows in a training step, and places in a scoring step.
BATCH, PLACES = 32, 1024

f32 = np.float32
LN2 = f32(np.log(2))
_CAUSAL: dict[int, np.ndarray] = {}
_ROOM: dict[str, np.ndarray] = {}


def room(name: str, *shape: int) -> np.ndarray:
    """An array to be overwritten, the same memory at each call with this name: fresh pages cost more than the arithmetic."""
    size = math.prod(shape)
    if name not in _ROOM or _ROOM[name].size < size:
        _ROOM[name] = np.empty(size, f32)
    return _ROOM[name][:size].reshape(shape)


def causal(t: int) -> np.ndarray:
    if t not in _CAUSAL:
        _CAUSAL[t] = np.tril(np.ones((t, t), f32))
    return _CAUSAL[t]


def windows(lens: np.ndarray, size: int = WINDOW, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's text, its first place in the text, and the place in the window from which it scores.

    A window begins ``overlap`` places before the last one's end, so together they score every place once.
    """
    step = size - overlap
    per = 1 + np.maximum(0, -(-(lens - size) // step))
    text = np.repeat(np.arange(lens.size), per)
    k = np.arange(text.size) - np.repeat(np.cumsum(per) - per, per)
    return text, k * step, np.where(k > 0, overlap, 0)


def _flat(x: np.ndarray) -> np.ndarray:
    return x.reshape(-1, x.shape[-1])


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first, axis=0)


@dataclass
class Net:
    params: dict[str, np.ndarray]
    #: First rank of each cluster, with a final end; ranks below the first are the head.
    cuts: np.ndarray
    #: What scoring computes from the parameters once.
    ready: dict[str, np.ndarray] = field(default_factory=dict, repr=False)

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 0) -> Net:
        """``counts``: training counts by rank, descending; the last stands for ``rest``."""
        size = counts.size
        cuts = [min(HEAD, size)]
        while cuts[-1] < size:
            cuts.append(min(size, cuts[-1] + max(HEAD // 2, cuts[-1] // 4)))
        rng = np.random.default_rng(seed)
        share = (counts + 0.5) / (counts.sum() + 0.5 * size)
        bias = np.log2(np.concatenate([share, [share[a:b].sum() for a, b in zip(cuts, cuts[1:])]]))
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(f32)
        params = {
            # The row after the last rank is the start of a text.
            "now": draw(0.3, size + 1, WIDTH), "before": draw(0.1, size + 1, WIDTH), "place": draw(0.05, WINDOW, WIDTH),
            "q": draw(0.3, WIDTH, KEYS), "k": draw(0.3, WIDTH, KEYS), "v": draw(0.1, WIDTH, WIDTH),
            "in": draw(WIDTH**-0.5, WIDTH, HIDDEN), "lift": np.zeros(HIDDEN, f32), "out": draw(0.3 * HIDDEN**-0.5, HIDDEN, WIDTH),
            # Rows after the last rank are the clusters.
            "next": draw(0.02, size + len(cuts) - 1, WIDTH), "bias": bias.astype(f32),
        }
        return cls(params, np.array(cuts))

    @property
    def size(self) -> int:
        return self.params["now"].shape[0] - 1

    def _joined(self) -> dict[str, np.ndarray]:
        """Weights of what is computed together: queries, keys, values and a column for sums; head and clusters."""
        if self.ready:
            return self.ready
        p, size, head = self.params, self.size, self.cuts[0]
        return {
            "qkv": np.concatenate([p["q"] * f32(KEYS**-0.5), p["k"], p["v"], np.zeros((WIDTH, 1), f32)], axis=1),
            "top": np.concatenate([p["next"][:head], p["next"][size:]]), "bias": np.concatenate([p["bias"][:head], p["bias"][size:]]),
        }

    def column(self, y: np.ndarray) -> np.ndarray:
        """Where targets' head ids or clusters stand in the first step."""
        if "column" in self.ready:
            return self.ready["column"][y]
        return np.where(y < self.cuts[0], y, self.cuts[0] + np.searchsorted(self.cuts, y, "right") - 1)

    # -- forward --------------------------------------------------------------------

    def states(self, x: np.ndarray, x2: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The state at every place (windows x places x width) for inputs ``x`` and the inputs before them; what the gradient needs."""
        p, (n, t) = self.params, x.shape
        e = p["now"].take(x.reshape(-1), axis=0, out=room("e", n * t, WIDTH), mode="clip")
        e += p["before"].take(x2.reshape(-1), axis=0, out=room("more", n * t, WIDTH), mode="clip")
        e = e.reshape(n, t, WIDTH)
        e += p["place"][:t]
        flat = _flat(e)
        w = self._joined()["qkv"]
        qkv = np.matmul(flat, w, out=room("qkv", n * t, w.shape[1]))
        qkv[:, -1] = 1  # so that sums of weights come with the products
        qkv = qkv.reshape(n, t, -1)
        q, k, v = qkv[..., :KEYS], qkv[..., KEYS : 2 * KEYS], qkv[..., 2 * KEYS :]
        a = np.matmul(q, k.transpose(0, 2, 1), out=room("a", n, t, t))
        np.exp2(a, out=a)
        a *= causal(t)
        h = np.matmul(a, v, out=room("h", n, t, WIDTH + 1))
        if not np.isfinite(h[..., WIDTH]).all():  # exponents too large for the plain form
            np.matmul(q, k.transpose(0, 2, 1), out=a)
            a -= np.where(causal(t) > 0, a, -np.inf).max(axis=2, keepdims=True)
            np.exp2(np.minimum(a, 0), out=a)
            a *= causal(t)
            np.matmul(a, v, out=h)
        total = h[..., WIDTH:]
        h = np.divide(h[..., :WIDTH], total, out=room("mean", n, t, WIDTH))
        r = np.add(_flat(h), flat, out=room("r", n * t, WIDTH))
        u = np.matmul(r, p["in"], out=room("u", n * t, HIDDEN))
        u += p["lift"]
        np.maximum(u, 0, out=u)
        z = u @ p["out"]
        z += r
        return z, (e, q, k, v[..., :WIDTH], a, total, h, r, u)

    def first_step(self, z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binary log probability of each target's head id or cluster, exponents over their sums' (rows, sums), and the target's column."""
        joined, col = self._joined(), self.column(y)
        return *_softmax(z, joined["top"], joined["bias"], col), col

    def log_probs(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Binary log probability of targets ``y`` given states ``z``."""
        out = self.first_step(z, y)[0]
        far = np.flatnonzero(y >= self.cuts[0])
        out[far] += self.tail_log_probs(z[far], y[far])
        return out

    def score(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ``ids``: ranks of all texts, one after another, which begin at ``at``.

        Each place is scored by one window; windows of like length are attended to together.
        """
        if not self.ready:
            self.ready = self._joined() | {"column": self.column(np.arange(self.size))}
        lens = np.diff(at)
        x = np.concatenate([[self.size], ids[:-1]])
        x[at[:-1]] = self.size
        x2 = np.concatenate([[self.size], x[:-1]])
        x2[at[:-1]] = self.size
        text, begin, since = windows(lens)
        last = np.minimum(lens[text] - begin, WINDOW)
        order = np.lexsort((since, -last))
        begin += at[text]
        out = np.zeros(ids.size)
        far: list[tuple[np.ndarray, np.ndarray]] = []
        for lo in range(0, order.size, PLACES // WINDOW):
            own = order[lo : lo + PLACES // WINDOW]
            t, skip = int(last[own[0]]), since[own]
            flat = begin[own][:, None] + np.arange(t)
            if last[own[-1]] == t and skip[0] == skip[-1]:  # windows of one shape
                z = self.states(x[flat], x2[flat])[0].reshape(own.size, t, WIDTH)[:, skip[0] :].reshape(-1, WIDTH)
                flat = flat[:, skip[0] :].reshape(-1)
            else:
                inside = np.arange(t) < last[own][:, None]
                flat = np.where(inside, flat, begin[own][:, None])
                z, _ = self.states(x[flat], x2[flat])
                ok = np.flatnonzero(inside & (np.arange(t) >= skip[:, None]))
                z, flat = z[ok], flat.reshape(-1)[ok]
            y = ids[flat]
            out[flat] = self.first_step(z, y)[0]
            tail = np.flatnonzero(y >= self.cuts[0])
            far.append((z[tail], flat[tail]))
        if far:
            flat = np.concatenate([f for _, f in far])
            out[flat] += self.tail_log_probs(np.concatenate([z for z, _ in far]), ids[flat])
        return np.add.reduceat(out, at[:-1]) * np.log10(2) if lens.size else np.zeros(0)

    def tail_log_probs(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Binary log probability of targets within their clusters."""
        p, out = self.params, np.zeros(y.size, f32)
        cluster = np.searchsorted(self.cuts, y, "right") - 1
        order = np.argsort(cluster, kind="stable")
        ends = np.cumsum(np.bincount(cluster, minlength=self.cuts.size))
        for c, end in enumerate(ends[:-1].tolist()):
            lo, hi = self.cuts[c], self.cuts[c + 1]
            step = max(1, (1 << 17) // int(hi - lo))
            for s in range(int(ends[c - 1]) if c else 0, end, step):
                at = order[s : min(s + step, end)]
                out[at] = _softmax(z[at], p["next"][lo:hi], p["bias"][lo:hi], y[at] - lo)[0]
        return out

    # -- training -------------------------------------------------------------------

    def loss(self, x: np.ndarray, x2: np.ndarray, y: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, tuple]]:
        """Mean bits of the valid places; gradients as (rows or None, values)."""
        p, size, head = self.params, self.size, self.cuts[0]
        z, (e, q, k, v, a, total, h, r, u) = self.states(x, x2)
        at = np.flatnonzero(valid.reshape(-1))
        n, zs, ys = at.size, z[at], y.reshape(-1)[at]
        logs, soft, sums, col = self.first_step(zs, ys)
        top = np.concatenate([np.arange(head), np.arange(size, p["bias"].size)])
        soft *= np.exp2(p["bias"][top])
        soft /= sums[:, None]
        soft[np.arange(n), col] -= 1
        dz = soft @ p["next"][top]
        rows, grads, bias = [top], [soft.T @ zs], [soft.sum(axis=0)]
        cluster = np.searchsorted(self.cuts, ys, "right") - 1
        for c in range(self.cuts.size - 1):
            own = np.flatnonzero(cluster == c)
            if own.size:
                lo, hi = self.cuts[c], self.cuts[c + 1]
                more, soft, sums = _softmax(zs[own], p["next"][lo:hi], p["bias"][lo:hi], ys[own] - lo)
                logs[own] += more
                soft *= np.exp2(p["bias"][lo:hi])
                soft /= sums[:, None]
                soft[np.arange(own.size), ys[own] - lo] -= 1
                dz[own] += soft @ p["next"][lo:hi]
                rows.append(np.arange(lo, hi))
                grads.append(soft.T @ zs[own])
                bias.append(soft.sum(axis=0))
        rows, scale = np.concatenate(rows), f32(1 / max(n, 1))
        out = {"next": (rows, np.concatenate(grads) * scale), "bias": (rows, np.concatenate(bias) * scale)}
        d = np.zeros_like(z)
        d[at] = dz * scale
        du = (d @ p["out"].T) * (u > 0)
        out["out"], out["in"], out["lift"] = (None, u.T @ d), (None, r.T @ du), (None, du.sum(axis=0))
        d += du @ p["in"].T
        a /= total
        dh = d.reshape(h.shape)
        da = dh @ v.transpose(0, 2, 1)
        dv = _flat(a.transpose(0, 2, 1) @ dh)
        ds = a * (da - (dh * h).sum(axis=2, keepdims=True))
        ds *= LN2
        dq, dk = _flat(ds @ k) * f32(KEYS**-0.5), _flat(ds.transpose(0, 2, 1) @ q)
        for name, g in (("q", dq), ("k", dk), ("v", dv)):
            out[name] = (None, _flat(e).T @ g)
            d += g @ p[name].T
        place = np.zeros_like(p["place"])
        place[: x.shape[1]] = d.reshape(e.shape).sum(axis=0)
        out["place"] = (None, place)
        out["now"], out["before"] = _summed(x.reshape(-1), d), _summed(x2.reshape(-1), d)
        return -float(logs.sum() * scale), out


def _softmax(z: np.ndarray, w: np.ndarray, b: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary log probabilities of the targets, exponents without the factors 2**b of the biases, and their sums with them."""
    m = np.matmul(z, w.T, out=room("logits", y.size, b.size))
    own = m[np.arange(y.size), y]
    np.exp2(m, out=m)
    sums = m @ np.exp2(b)
    if not (np.isfinite(sums).all() and (sums > 1e-30).all()):  # the plain form leaves float32's range
        m = z @ w.T
        top = (m + b).max(axis=1, keepdims=True)
        np.exp2(m - top, out=m)
        own, sums = own - top[:, 0], m @ np.exp2(b)
    return own + b[y] - np.log2(sums), m, sums


class Adam:
    """Adam that moves only the rows that a gradient names, and counts how often each was moved."""

    def __init__(self, params: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}
        self.moved = {k: np.zeros(v.shape[0], f32) for k, v in params.items()}
        self.steps = 0

    def step(self, params: dict[str, np.ndarray], grads: dict[str, tuple], rate: float) -> None:
        self.steps += 1
        fit, spread = f32(rate / (1 - 0.9**self.steps)), f32(1 / (1 - 0.99**self.steps))
        for name, (rows, g) in grads.items():
            at = slice(None) if rows is None else rows
            m, s = self.m[name][at], self.s[name][at]
            m += f32(0.1) * (g - m)
            s += f32(0.01) * (g * g - s)
            if rows is not None:
                self.m[name][at], self.s[name][at] = m, s
            params[name][at] -= fit * m / (np.sqrt(s * spread) + f32(1e-8))
            self.moved[name][at] += 1


def lay(ids: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows' inputs, the inputs before them, and targets, padded with 0 (masked by the lengths).  Each of ``ids``: two ids before the first target, then the targets."""
    t = max(map(len, ids)) - 2
    out = np.zeros((len(ids), t + 2), np.int64)
    for row, x in zip(out, ids):
        row[: len(x)] = x
    return out[:, 1:-1], out[:, :-2], out[:, 2:]


def train(net: Net, ids: list[np.ndarray], since: np.ndarray, steps: int, rate: float, least: float = 0.0, warm: int = 20, seed: int = 0, batch: int = BATCH, adam: Adam | None = None) -> tuple[Adam, list[float]]:
    """Adam over windows in random order, again and again; the rate rises over ``warm`` steps and falls to ``least`` of it.

    ``since``: the place from which each window's targets count.  ``adam`` goes on where it was.  Each window comes once
    at least if there are as many steps as batches.
    """
    rng, adam, losses = np.random.default_rng(seed), adam or Adam(net.params), []
    net.ready = {}
    lens = np.array([len(x) - 2 for x in ids])
    order = np.zeros(0, np.int64)
    for step in range(steps):
        if order.size < batch:
            order = np.concatenate([order, rng.permutation(len(ids))])
        own, order = order[:batch], order[batch:]
        x, x2, y = lay([ids[i] for i in own], net.size)
        place = np.arange(x.shape[1])
        valid = (place < lens[own][:, None]) & (place >= since[own][:, None])
        loss, grads = net.loss(x, x2, y, valid)
        adam.step(net.params, grads, rate * min(1.0, (adam.steps + 1) / warm) * max(least, 1 - step / steps))
        losses.append(loss)
    return adam, losses
