"""A bidirectional LSTM in numpy that labels every block of a page as article text or not."""

from __future__ import annotations

import zlib

import numpy as np

from .blocks import Block

BINS = 1024
PATH, WORD, PLAIN = 32, 12, 6
WIDTH = PATH + WORD + PLAIN
_rng = np.random.default_rng(11)
# Fixed random vectors of hashed path words and text words.
PATH_VECTORS = _rng.normal(0, 1, (BINS, PATH)).astype(np.float32)
WORD_VECTORS = _rng.normal(0, 1, (BINS, WORD)).astype(np.float32)

_path_cache: dict[tuple[str, ...], np.ndarray] = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    known = _path_cache.get(path)
    if known is None:
        if len(_path_cache) > 20_000:
            _path_cache.clear()
        total = np.zeros(PATH, np.float32)
        for step in path:
            for word in step.split():
                total += PATH_VECTORS[zlib.crc32(word.encode()) % BINS]
        known = _path_cache[path] = total / max(1.0, len(path)) ** 0.5
    return known


def features(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), WIDTH), np.float32)
    if not page:
        return out
    split = [b.text.lower().split() for b in page]
    bins = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % BINS for ws in split for w in ws), np.int64)
    counts = np.array([len(ws) for ws in split])
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    out[:, :PATH] = [path_vector(b.path) for b in page]
    out[:, PATH:PATH + WORD] = np.add.reduceat(WORD_VECTORS[bins], starts, axis=0) / np.sqrt(counts)[:, None]
    length = np.array([len(b.text) for b in page], float)
    stops = np.array([b.text.count(". ") + b.text.endswith(".") for b in page])
    out[:, PATH + WORD:] = np.column_stack([
        np.log1p(length) / 5, [b.linked / len(b.text) for b in page], np.log1p(stops), np.log1p(counts) / 3,
        np.linspace(0, 1, len(page)), np.ones(len(page)),
    ])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Weights: for each direction input, state and bias of the four gates; a logistic output over both states."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w["x" + d] = rng.normal(0, WIDTH ** -0.5, (WIDTH, 4 * hidden))
            self.w["h" + d] = rng.normal(0, hidden ** -0.5, (hidden, 4 * hidden))
            self.w["c" + d] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)])
        self.w["o"] = rng.normal(0, (2 * hidden) ** -0.5, (2 * hidden, 1))
        self.w["p"] = np.zeros(1)
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """States over time of one direction; padded steps keep the state before."""
        steps, n, _ = x.shape
        gates_in = x @ self.w["x" + d] + self.w["c" + d]
        h = c = np.zeros((n, self.h), np.float32)
        states, tape = np.zeros((steps, n, self.h), np.float32), []
        hd = self.h
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = gates_in[t] + h @ self.w["h" + d]
            s = _sigmoid(z[:, :3 * hd])
            i, f, o, g = s[:, :hd], s[:, hd:2 * hd], s[:, 2 * hd:], np.tanh(z[:, 3 * hd:])
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            m = mask[t][:, None]
            tape.append((t, h, c, i, f, o, g, tc, m))
            h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
            states[t] = h
        return states, tape

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]], 2)
        return (both @ self.w["o"] + self.w["p"])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        p = _sigmoid((both @ self.w["o"] + self.w["p"])[..., 0])
        n = mask.sum()
        loss = -(np.where(y, np.log(p + 1e-9), np.log(1 - p + 1e-9)) * mask).sum() / n
        dz = ((p - y) * mask / n)[..., None]
        grads = {"o": np.einsum("tni,tnj->ij", both, dz), "p": dz.sum((0, 1))}
        back = dz @ self.w["o"].T
        hd = self.h
        for k, d in enumerate("fb"):
            dh_next = dc_next = np.zeros((x.shape[1], hd), np.float32)
            gx, gh, gc = (np.zeros_like(self.w[name + d]) for name in "xhc")
            for t, h, c, i, f, o, g, tc, m in reversed(runs[d][1]):
                dh = dh_next + back[t][:, k * hd:(k + 1) * hd]
                dhm = np.where(m, dh, 0)
                dc = np.where(m, dc_next, 0) + dhm * o * (1 - tc * tc)
                z = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dhm * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
                gx += x[t].T @ z
                gh += h.T @ z
                gc += z.sum(0)
                dh_next = np.where(m, z @ self.w["h" + d].T, dh)
                dc_next = np.where(m, dc * f, dc_next)
            grads |= {"x" + d: gx, "h" + d: gh, "c" + d: gc}
        return float(loss), grads

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over batches of pages of similar length; gives the last mean loss."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = np.argsort([len(p) for p in pages], kind="stable")
        groups = [order[i:i + batch] for i in range(0, len(order), batch)]
        step, losses = 0, []
        for epoch in range(epochs):
            losses = []
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[i] for i in groups[g]])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(groups[g]):
                    y[:len(labels[i]), j] = labels[i]
                loss, grads = self.gradients(x, mask, y)
                losses.append(loss)
                step += 1
                size = sum(float((v * v).sum()) for v in grads.values()) ** 0.5
                for name, value in grads.items():
                    value = value * min(1.0, 5.0 / (size + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * value
                    second[name] = 0.99 * second[name] + 0.01 * value * value
                    scale = rate * 0.75 ** epoch * (1 - 0.99 ** step) ** 0.5 / (1 - 0.9 ** step)
                    self.w[name] = (self.w[name] - scale * first[name] / (np.sqrt(second[name]) + 1e-7)).astype(np.float32)
        return float(np.mean(losses)) if losses else 0.0

    def label(self, pages: list[np.ndarray], batch: int = 512) -> list[np.ndarray]:
        """Probabilities per block; pages of similar length share a batch, and a batch holds a bounded number of blocks."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        at = 0
        while at < len(order):
            group = order[at:at + max(1, min(batch, 60_000 // len(pages[order[min(at + batch, len(order)) - 1]])))]
            at += len(group)
            x, mask = padded([pages[i] for i in group])
            p = _sigmoid(self.logits(x, mask))
            for j, i in enumerate(group):
                out[i] = p[:len(pages[i]), j]
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x = np.zeros((steps, len(pages), WIDTH), np.float32)
    mask = np.zeros((steps, len(pages)), bool)
    for j, p in enumerate(pages):
        x[:len(p), j], mask[:len(p), j] = p, True
    return x, mask
