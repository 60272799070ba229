"""Word streams from bytes and a bidirectional gated recurrent network with attention pooling, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# A word is a run of ASCII letters, digits and non-ASCII bytes; ASCII capitals count as small letters.
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_inside = np.zeros(256, bool)
_inside[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_value = np.random.default_rng(29).integers(1, 2**63, 256, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
CHUNK = 1 << 20
HEAD, TAIL = 4, 4


def _powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]))


_up, _down = _powers(_FACTOR, CHUNK + 1), _powers(_INVERSE, CHUNK + 1)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin of every word, hashes of whole word, of its first HEAD and of its last TAIL bytes as columns); at most CHUNK bytes."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _inside[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edges[::2], edges[1::2]
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_value[_lower[data]] * _up[:len(data)], out=total[1:])
        span = lambda a, b: (total[b] - total[a]) * _down[a]
        found = np.stack([span(begin, end), span(begin, np.minimum(begin + HEAD, end)), span(np.maximum(end - TAIL, begin), end)])
    return begin, found


class Vocabulary:
    """Exact look-up of 64-bit hashes: a table by their top bits with the whole hash beside it; 0 is unknown."""

    def __init__(self, hashes: np.ndarray):
        self.bits = 20
        self.hashes = hashes
        slots = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.table = np.zeros(1 << self.bits, np.int32)
        # Of two hashes in one slot the first, more frequent one stays; the other counts as unknown.
        self.table[slots[::-1]] = np.arange(len(hashes), 0, -1)
        self.known = np.concatenate([[np.uint64(0)], hashes])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        guess = self.table[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        return np.where(self.known[guess] == hashes, guess, 0)


@dataclass
class Windows:
    """Overlapping windows of `size` words: ids by (input, step, window), and the text each belongs to."""

    ids: np.ndarray
    mask: np.ndarray
    owner: np.ndarray


def windows(counts: np.ndarray, ids: np.ndarray, size: int, stride: int) -> Windows:
    """`ids` has one column per word of all texts, `counts` words per text. The last window ends with its text."""
    per = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - size) // stride)), 0)
    owner = np.repeat(np.arange(len(counts)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    first = np.cumsum(counts) - counts
    start = np.minimum(nth * stride, np.maximum(counts[owner] - size, 0))
    steps = start[None, :] + np.arange(size)[:, None]
    mask = steps < counts[owner][None, :]
    at = np.where(mask, first[owner][None, :] + steps, 0)
    return Windows(ids[:, at] if ids.shape[1] else np.zeros((ids.shape[0], size, 0), np.int32), mask, owner)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Sum of a word and two character-piece embeddings, a GRU in each direction, attention over the states, a logistic output."""

    def __init__(self, sizes: list[int], embed: int = 12, hidden: int = 10, seed: int = 2):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w: dict[str, np.ndarray] = {f"e{i}": rng.normal(0, 0.3, (n, embed)) for i, n in enumerate(sizes)}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, embed ** -0.5, (embed, 3 * hidden))
            self.w["c" + d] = np.zeros(3 * hidden)
            self.w["u" + d] = rng.normal(0, hidden ** -0.5, (hidden, 2 * hidden))
            self.w["n" + d] = rng.normal(0, hidden ** -0.5, (hidden, hidden))
        self.w["a"] = rng.normal(0, 0.3, 2 * hidden)
        self.w["o"] = rng.normal(0, 0.3, 2 * hidden)
        self.w["p"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def projected(self) -> dict[str, np.ndarray]:
        """Embeddings times input weights: what a step adds to the gates, by id and direction."""
        both = np.concatenate([self.w["xf"], self.w["xb"]], 1)
        return {k: (self.w[k] @ both).astype(np.float32) for k in ("e0", "e1", "e2")}

    def _run(self, gates: np.ndarray, mask: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        steps, n, _ = gates.shape
        hd, u, v = self.h, self.w["u" + d], self.w["n" + d]
        h = np.zeros((n, hd), np.float32)
        states, tape = np.empty((steps, n, hd), np.float32), []
        full = mask.all(1)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            s = _sigmoid(gates[t, :, :2 * hd] + h @ u)
            r, z = s[:, :hd], s[:, hd:]
            rh = r * h
            g = np.tanh(gates[t, :, 2 * hd:] + rh @ v)
            new = h + z * (g - h)
            if not full[t]:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                tape.append((t, h, r, z, rh, g))
            h = states[t] = new
        return states, tape

    def _pool(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = np.where(mask, states @ self.w["a"], -1e9)
        e = np.exp(e - e.max(0))
        attention = e / e.sum(0)
        pooled = np.einsum("tn,tnh->nh", attention, states)
        return attention, pooled, pooled @ self.w["o"] + self.w["p"][0]

    def _gates(self, ids: np.ndarray, tables: dict[str, np.ndarray]) -> np.ndarray:
        both = tables["e0"][ids[0]]
        both += tables["e1"][ids[1]]
        both += tables["e2"][ids[2]]
        return both

    def logits(self, w: Windows, tables: dict[str, np.ndarray], batch: int = 1024) -> np.ndarray:
        out = np.empty(len(w.owner), np.float32)
        k = 3 * self.h
        for at in range(0, len(out), batch):
            mask = w.mask[:, at:at + batch]
            gates = self._gates(w.ids[:, :, at:at + batch], tables)
            states = [self._run(gates[:, :, i * k:(i + 1) * k] + self.w["c" + d], mask, d, False)[0] for i, d in enumerate("fb")]
            out[at:at + batch] = self._pool(np.concatenate(states, 2), mask)[2]
        return out

    def gradients(self, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x = self.w["e0"][ids[0]] + self.w["e1"][ids[1]] + self.w["e2"][ids[2]]
        runs = {d: self._run(x @ self.w["x" + d] + self.w["c" + d], mask, d, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        attention, pooled, logit = self._pool(states, mask)
        p = _sigmoid(logit)
        n = len(y)
        loss = -np.mean(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))
        dl = (p - y) / n
        grads = {"o": pooled.T @ dl, "p": dl.sum(keepdims=True)}
        dp = dl[:, None] * self.w["o"]
        da = np.einsum("nh,tnh->tn", dp, states)
        de = attention * (da - (attention * da).sum(0))
        grads["a"] = np.einsum("tn,tnh->h", de, states)
        ds = attention[:, :, None] * dp + de[:, :, None] * self.w["a"]
        hd = self.h
        dx = np.zeros_like(x)
        for i, d in enumerate("fb"):
            gx, gc, gu, gn = (np.zeros_like(self.w[k + d]) for k in "xcun")
            carry = np.zeros((n, hd), np.float32)
            for t, h, r, z, rh, g in reversed(runs[d][1]):
                m = mask[t][:, None]
                dh = ds[t][:, i * hd:(i + 1) * hd] + carry
                dn = np.where(m, dh, 0)
                dg = dn * z * (1 - g * g)
                drh = dg @ self.w["n" + d].T
                dz = np.concatenate([drh * h * r * (1 - r), dn * (g - h) * z * (1 - z)], 1)
                gn += rh.T @ dg
                gu += h.T @ dz
                gates = np.concatenate([dz, dg], 1)
                gx += x[t].T @ gates
                gc += gates.sum(0)
                dx[t] += gates @ self.w["x" + d].T
                carry = np.where(m, dn * (1 - z) + drh * r + dz @ self.w["u" + d].T, dh)
            grads |= {"x" + d: gx, "c" + d: gc, "u" + d: gu, "n" + d: gn}
        flat = np.where(mask[:, :, None], dx, 0).reshape(-1, dx.shape[2])
        for k in range(3):
            g = np.zeros_like(self.w[f"e{k}"])
            np.add.at(g, ids[k].ravel(), flat)
            grads[f"e{k}"] = g
        return float(loss), grads

    def fit(self, w: Windows, y: np.ndarray, epochs: int = 6, least_steps: int = 400, batch: int = 128, rate: float = 0.015, seed: int = 4) -> float:
        """Adam; few windows are shown more often, so that at least `least_steps` steps are made."""
        epochs = max(epochs, -(-least_steps // max(1, -(-len(y) // batch))))
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, losses = 0, []
        for epoch in range(epochs):
            losses = []
            order = rng.permutation(len(y))
            for at in range(0, len(order), batch):
                part = order[at:at + batch]
                loss, grads = self.gradients(w.ids[:, :, part], w.mask[:, part], y[part].astype(np.float32))
                losses.append(loss)
                step += 1
                size = sum(float((v * v).sum()) for v in grads.values()) ** 0.5
                scale = rate * 0.1 ** (epoch / epochs) * (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step)
                for name, value in grads.items():
                    value = value * min(1.0, 2.0 / (size + 1e-9))
                    first[name] += 0.1 * (value - first[name])
                    second[name] += 0.01 * (value * value - second[name])
                    self.w[name] = (self.w[name] - scale * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)
        return float(np.mean(losses)) if losses else 0.0
