"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Every step of a sequence is a few whole-array operations over all windows, so the cost of
the interpreter is shared by a thousand of them.  Tags: 0 outside, 1.. one per kind; a kind
can't follow another kind directly.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 8
#: Character classes: code points below 127 are their own class, letters above share one, the rest another.
LETTER, OTHER, PAD = 127, 128, 129
CLASSES = 130
NEVER = np.float32(-1e4)


class Tagger:
    def __init__(self, tags: int, hidden: int = HIDDEN, seed: int = 3):
        random = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        draw = lambda *shape: random.normal(0, 0.3, shape).astype(np.float32)
        self.values = {"table0": draw(4 * hidden, CLASSES), "table1": draw(4 * hidden, CLASSES), "loop0": draw(4 * hidden, hidden), "loop1": draw(4 * hidden, hidden), "out0": draw(tags, hidden), "out1": draw(tags, hidden), "bias": np.zeros((tags, 1), np.float32), "move": np.zeros((tags, tags), np.float32)}
        for d in ("table0", "table1"):
            self.values[d][hidden : 2 * hidden] += 2.0  # open forget gates
        self.allowed = np.full((tags, tags), NEVER, dtype=np.float32)
        self.allowed[0], self.allowed[:, 0] = 0, 0
        np.fill_diagonal(self.allowed, 0)

    def _direction(self, chars: np.ndarray, d: int, keep: list | None = None):
        """Hidden states (windows, hidden) of one direction, a step at a time; chars: (window length, windows).

        The sigmoid of x is half of tanh(x / 2), shifted, so one tanh over all gates does.
        """
        h_, n = self.hidden, chars.shape[1]
        half = np.array([0.5, 0.5, 0.5, 1.0], np.float32)[:, None, None]
        table = np.ascontiguousarray(self.values[f"table{d}"].reshape(4, h_, CLASSES).transpose(0, 2, 1) * half)
        loop = np.ascontiguousarray(self.values[f"loop{d}"].reshape(4, h_, h_).transpose(0, 2, 1) * half)
        h, c = np.zeros((n, h_), np.float32), np.zeros((n, h_), np.float32)
        z, back = np.empty((4, n, h_), np.float32), np.empty((4, n, h_), np.float32)
        for t in range(len(chars)) if d == 0 else range(len(chars) - 1, -1, -1):
            for k in range(4):
                np.take(table[k], chars[t], axis=0, out=z[k], mode="clip")
                np.matmul(h, loop[k], out=back[k])
            z += back
            np.tanh(z, out=z)
            gates = z[:3]
            gates += 1
            gates *= 0.5
            before, prior = c, h
            c = z[1] * c
            c += z[0] * z[3]
            s = np.tanh(c)
            h = z[2] * s
            if keep is not None:
                keep.append((t, z.copy(), before, s, prior))
            yield t, h

    def emissions(self, chars: np.ndarray) -> np.ndarray:
        """(window length, tags, windows)."""
        chars = chars.astype(np.intp)
        out = np.empty((len(chars), self.tags, chars.shape[1]), np.float32)
        for t, h in self._direction(chars, 0):
            np.matmul(self.values["out0"], h.T, out=out[t])
        for t, h in self._direction(chars, 1):
            out[t] += self.values["out1"] @ h.T
        out += self.values["bias"]
        return out

    def decode(self, chars: np.ndarray) -> np.ndarray:
        """The best tag sequence of every window (Viterbi): (window length, windows)."""
        e = self.emissions(chars)
        length, tags, n = e.shape
        move = self.values["move"]
        enter, stay, leave = move[0, 1:, None], np.diag(move)[1:, None].copy(), move[:, :1].copy()
        stayed, came = np.empty((length, tags - 1, n), bool), np.zeros((length, n), np.int8)
        score, to_out = e[0].copy(), np.empty((tags, n), np.float32)
        fresh, same = np.empty((tags - 1, n), np.float32), np.empty((tags - 1, n), np.float32)
        for t in range(1, length):
            np.add(score[:1], enter, out=fresh)
            np.add(score[1:], stay, out=same)
            np.add(score, leave, out=to_out)
            np.greater(same, fresh, out=stayed[t])
            best = to_out.max(axis=0)
            left = np.flatnonzero(best > to_out[0])
            if len(left):
                came[t, left] = to_out[:, left].argmax(axis=0)
            score[0] = best
            np.maximum(fresh, same, out=score[1:])
            score += e[t]
        path = np.empty((length, n), np.int8)
        tag = score.argmax(axis=0).astype(np.int8)
        for t in range(length - 1, 0, -1):
            path[t] = tag
            inside = np.flatnonzero(tag)
            own, tag = tag[inside], came[t].copy()
            tag[inside] = np.where(stayed[t, own - 1, inside], own, 0)
        path[0] = tag
        return path

    def _crf(self, e: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss, gradient of emissions and of moves, by forward and backward sums."""
        length, tags, n = e.shape
        move = self.values["move"] + self.allowed
        total = lambda x, axis: (m := x.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis=axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, length):
            alpha[t] = total(alpha[t - 1][:, None] + move[:, :, None], 0) + e[t]
        for t in range(length - 2, -1, -1):
            beta[t] = total(move[:, :, None] + (e[t + 1] + beta[t + 1])[None], 1)
        z = total(alpha[-1], 0)
        grad = np.exp(alpha + beta - z)
        pairs = np.zeros((tags, tags), np.float32)
        for t in range(1, length):
            pairs += np.exp(alpha[t - 1][:, None] + move[:, :, None] + (e[t] + beta[t])[None] - z).sum(axis=2)
        t_, n_ = np.meshgrid(np.arange(length), np.arange(n), indexing="ij")
        loss = z.sum() - e[t_, gold, n_].sum() - move[gold[:-1], gold[1:]].sum()
        grad[t_, gold, n_] -= 1
        np.subtract.at(pairs, (gold[:-1], gold[1:]), 1)
        return float(loss) / n, grad / n, pairs / n

    def step(self, chars: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch, by back-propagation through time."""
        chars = chars.astype(np.intp)
        h_ = self.hidden
        kept: list[list] = [[], []]
        states = [np.empty((len(chars), chars.shape[1], h_), np.float32) for _ in range(2)]
        for d in range(2):
            for t, h in self._direction(chars, d, kept[d]):
                states[d][t] = h
        e = sum(np.einsum("kh,tnh->tkn", self.values[f"out{d}"], states[d]) for d in range(2)) + self.values["bias"]
        loss, de, dmove = self._crf(e, gold)
        grads = {"bias": de.sum(axis=(0, 2))[:, None], "move": dmove}
        for d in range(2):
            grads[f"out{d}"] = np.einsum("tkn,tnh->kh", de, states[d])
            loop = self.values[f"loop{d}"].reshape(4, h_, h_)
            dloop, dtable = np.zeros_like(loop), np.zeros((CLASSES, 4 * h_), np.float32)
            dh, dc = np.zeros((chars.shape[1], h_), np.float32), np.zeros((chars.shape[1], h_), np.float32)
            for t, z, before, s, prior in reversed(kept[d]):
                i, f, o, g = z
                dh = dh + de[t].T @ self.values[f"out{d}"]
                dc = dc + dh * o * (1 - s * s)
                dz = np.stack([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * s * o * (1 - o), dc * i * (1 - g * g)])
                dloop += np.einsum("knh,nj->khj", dz, prior)
                np.add.at(dtable, chars[t], dz.transpose(1, 0, 2).reshape(len(dh), 4 * h_))
                dh, dc = np.einsum("knh,khj->nj", dz, loop), dc * f
            grads[f"loop{d}"], grads[f"table{d}"] = dloop.reshape(4 * h_, h_), dtable.T
        return loss, grads

    def fit(self, chars: np.ndarray, gold: np.ndarray, epochs: int, batch: int = 128, rate: float = 0.02, seed: int = 1) -> list[float]:
        """Adam with a falling rate; chars and gold: (window length, windows). Losses by epoch."""
        random = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.values.items()}
        second = {k: np.zeros_like(v) for k, v in self.values.items()}
        losses, step, steps = [], 0, epochs * -(-chars.shape[1] // batch)
        for _ in range(epochs):
            order, total = random.permutation(chars.shape[1]), 0.0
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                loss, grads = self.step(chars[:, own], gold[:, own])
                norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
                total, step = total + loss * len(own), step + 1
                now = rate * (1 - 0.9 * step / steps)
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.values[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(total / len(order))
        return losses
