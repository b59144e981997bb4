"""A bidirectional LSTM over characters with a conditional random field on top, in numpy.

Arrays run over time first: ``(steps, windows, ...)``. Gates are in the order input, forget, output, candidate.
"""

from __future__ import annotations

import numpy as np


def squash(x: np.ndarray, spare: np.ndarray | None = None) -> np.ndarray:
    """In place, ``c (2 - |c|)`` of ``x`` clipped to -1 and 1: as a function of ``2 x`` it stands for tanh, with its slope at 0,
    and takes a fifth of its time."""
    x.clip(-1, 1, out=x)
    spare = np.abs(x, out=spare)
    np.subtract(2, spare, out=spare)
    x *= spare
    return x


class Tagger:
    """Weights, training by backpropagation with Adam, and Viterbi decoding."""

    def __init__(self, symbols: int, tags: int, hidden: int = 10, seed: int = 0):
        rng = np.random.default_rng(seed)
        h, self.hidden, self.tags = hidden, hidden, tags
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        bias = np.zeros(4 * h, np.float32)
        bias[h : 2 * h] = 1
        self.p = {"xf": draw(symbols, 4 * h), "hf": draw(h, 4 * h), "bf": bias, "xb": draw(symbols, 4 * h), "hb": draw(h, 4 * h), "bb": bias.copy(), "e": draw(2 * h, tags), "c": np.zeros(tags, np.float32), "t": np.zeros((tags, tags), np.float32), "s": np.zeros(tags, np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.step = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "moments"}

    # Forward

    def _gates(self) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Input tables and recurrent weights with the scales of :func:`squash` and of the sigmoid folded in."""
        half = np.repeat([0.25, 0.25, 0.25, 0.5], self.hidden).astype(np.float32)
        return {d: ((self.p["x" + d] + self.p["b" + d]) * half, self.p["h" + d] * half) for d in "fb"}

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores ``(steps, windows, tags)`` of symbols ``(steps, windows)``."""
        return self._emissions(x).transpose(0, 2, 1)

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores ``(steps, tags, windows)``: gates and tags are rows, so that each is contiguous over the windows."""
        steps, n = x.shape
        h = self.hidden
        (fore, fw), (back, bw) = (self._gates()[d] for d in "fb")
        fore, back = np.ascontiguousarray(fore.T), np.ascontiguousarray(back.T)
        # A gate is (1 + y) / 2: the state's half is in its weights.
        weight = np.stack([fw.T, bw.T]) * np.float32(0.5)
        emit = self.p["e"].reshape(2, h, self.tags).transpose(0, 2, 1) * np.float32(0.5)
        z, rec, spare = (np.empty((2, 4 * h, n), np.float32) for _ in range(3))
        u, less, cell, state = (np.zeros((2, h, n), np.float32) for _ in range(4))
        gates, into, forget, outof, fresh = z[:, : 3 * h], z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
        states = np.empty((2, steps, h, n), np.float32)
        for t in range(steps):
            # Both directions go at once: the other one from the end.
            fore.take(x[t], axis=1, out=z[0], mode="clip")
            back.take(x[steps - 1 - t], axis=1, out=z[1], mode="clip")
            np.matmul(weight, state, out=rec)
            z += rec
            squash(z, spare)
            gates += 1
            cell *= forget
            np.multiply(into, fresh, out=u)
            cell += u
            cell *= 0.5
            np.multiply(cell, 0.5, out=u)
            squash(u, less)
            np.multiply(u, outof, out=state)
            states[0, t], states[1, steps - 1 - t] = state
        out = np.matmul(emit[0], states[0])
        out += np.matmul(emit[1], states[1], out=np.empty_like(out))
        out += self.p["c"][:, None]
        return out

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The best tags of each window. ``mask`` is true inside the window; outside tags are 0.

        A run of other tags gains over tag 0 at most the best way in and out, and at each step its emission over that
        of tag 0 and the best transition among other tags. Where even the best run through a step gains nothing, the
        step's tag is 0 and needs no search; Viterbi runs over the stretches between such steps.
        """
        e = self._emissions(x)
        t, s = self.p["t"] - self.p["t"][0, 0], self.p["s"] - self.p["s"][0]
        enter, leave, stay = max(float(t[0, 1:].max()), float(s[1:].max())), max(0.0, float(t[1:, 0].max())), float(t[1:, 1:].max())
        gain = e[:, 1:].max(axis=1)
        gain -= e[:, 0]
        gain += np.float32(stay)
        gain[~mask] = -1e6
        # The best run that ends at a step, and that begins at one.
        steps = len(x)
        through, best = gain.copy(), np.empty(x.shape[1], np.float32)
        for i in range(1, steps):
            np.maximum(through[i - 1], 0, out=best)
            through[i] += best
        after = gain[-1].copy()
        for i in range(steps - 2, -1, -1):
            np.maximum(after, 0, out=after)
            through[i] += after
            after += gain[i]
        # Parts of a path that touch, as two runs with no tag 0 between, are one run here.
        hot = (through > np.float32(stay - enter - leave - 1e-2)) & mask
        out = np.zeros(x.shape, np.int8)
        flat = np.zeros((x.shape[1], steps + 2), np.int8)
        flat[:, 1:-1] = hot.T
        change = np.diff(flat, axis=1)
        window, first = np.nonzero(change == 1)
        _, end = np.nonzero(change == -1)
        size = mask.sum(axis=0)
        order = np.argsort(end - first, kind="stable")
        for lot in range(0, len(order), 256):
            pick = order[lot : lot + 256]
            w, a, z = window[pick], first[pick], end[pick]
            at = a + np.arange(int((z - a).max()))[:, None]
            inside = at < z
            at = np.minimum(at, steps - 1)
            start = np.where((a == 0)[:, None], s, t[0])
            last = np.where((z < size[w])[:, None], t[:, 0], 0)
            got = self._viterbi(e[at, :, w], inside, t, start, last)
            out[at[inside], np.broadcast_to(w, at.shape)[inside]] = got[inside]
        return out

    def _viterbi(self, e: np.ndarray, mask: np.ndarray, t: np.ndarray, start: np.ndarray, last: np.ndarray | float = 0.0) -> np.ndarray:
        """The best path with ``start`` added to its first step's scores and ``last`` to its last one's."""
        steps, n, k = e.shape
        score = np.ascontiguousarray((e[0] + start).T)
        back = np.zeros((steps, k, n), np.int8)
        for i in range(1, steps):
            best, of = score[0] + t[0][:, None], np.zeros((k, n), np.int8)
            for j in range(1, k):
                other = score[j] + t[j][:, None]
                of[other > best] = j
                np.maximum(best, other, out=best)
            score = np.where(mask[i], best + e[i].T, score)
            back[i] = np.where(mask[i], of, np.arange(k, dtype=np.int8)[:, None])
        out = np.zeros((steps, n), np.int8)
        out[-1] = (score + np.broadcast_to(np.asarray(last), (n, k)).T).argmax(axis=0)
        at = np.arange(n)
        for i in range(steps - 1, 0, -1):
            out[i - 1] = back[i, out[i], at]
        return out

    # Training

    def _run(self, x: np.ndarray, d: str) -> list[tuple]:
        steps, n = x.shape
        h = self.hidden
        table, weight = self._gates()[d]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = squash(table[x[t]] + state @ weight)
            g = 0.5 * z[:, : 3 * h] + 0.5
            before, c = state, cell
            cell = g[:, h : 2 * h] * c + g[:, :h] * z[:, 3 * h :]
            u = squash(cell * np.float32(0.5))
            state = u * g[:, 2 * h :]
            kept.append((t, before, c, z, g, u, state))
        return kept

    def loss(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags ``y``, and its gradients. Windows fill from the first step on."""
        p, h, k = self.p, self.hidden, self.tags
        steps, n = x.shape
        runs = {d: self._run(x, d) for d in "fb"}
        both = np.empty((steps, n, 2 * h), np.float32)
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            for t, *_, state in runs[d]:
                both[t, :, part] = state
        e = both @ p["e"] + p["c"]
        m = mask[:, :, None].astype(np.float32)

        def lse(a, axis):
            top = a.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        alpha = np.empty((steps, n, k), np.float32)
        alpha[0] = e[0] + p["s"]
        for t in range(1, steps):
            new = lse(alpha[t - 1][:, :, None] + p["t"], 1) + e[t]
            alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
        whole = lse(alpha[-1], 1)
        beta = np.zeros((steps, n, k), np.float32)
        for t in range(steps - 2, -1, -1):
            new = lse(p["t"] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
            beta[t] = np.where(mask[t + 1][:, None], new, beta[t + 1])
        grad = {name: np.zeros_like(v) for name, v in p.items()}
        gold = np.zeros((steps, n, k), np.float32)
        np.put_along_axis(gold, y[:, :, None].astype(np.int64), 1, axis=2)
        gold *= m
        de = (np.exp(alpha + beta - whole[None, :, None]) * m - gold) / n
        score = (e * gold).sum() + p["s"][y[0]].sum()
        grad["s"] = de[0].sum(axis=0)
        for t in range(1, steps):
            live = mask[t]
            joint = np.exp(alpha[t - 1][:, :, None] + p["t"] + (e[t] + beta[t])[:, None, :] - whole[:, None, None]) * live[:, None, None]
            grad["t"] += joint.sum(axis=0) / n
            np.add.at(grad["t"], (y[t - 1][live], y[t][live]), -1 / n)
            score += p["t"][y[t - 1][live], y[t][live]].sum()
        grad["e"] = np.einsum("tnh,tnk->hk", both, de)
        grad["c"] = de.sum(axis=(0, 1))
        dh = de @ p["e"].T
        half = np.repeat([0.5, 0.5, 0.5, 1], h).astype(np.float32)
        slope = lambda y: np.sqrt(np.maximum(0, 1 - np.abs(y)))  # of squash, from its value
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            down, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            dzs, idx = [], []
            for t, before, c, z, g, u, _ in reversed(runs[d]):
                ds = dh[t, :, part] + down
                dc = dc + ds * g[:, 2 * h :] * slope(u)
                dg = np.concatenate([dc * z[:, 3 * h :], dc * c, ds * u], axis=1) * 0.5
                dz = np.concatenate([dg, dc * g[:, :h]], axis=1) * slope(z)  # before squash
                dz *= half
                grad["h" + d] += before.T @ dz
                down = dz @ p["h" + d].T
                dc = dc * g[:, h : 2 * h]
                dzs.append(dz)
                idx.append(x[t])
            dz, idx = np.concatenate(dzs), np.concatenate(idx)
            onehot = np.zeros((len(p["x" + d]), len(idx)), np.float32)
            onehot[idx, np.arange(len(idx))] = 1
            grad["x" + d] = onehot @ dz
            grad["b" + d] = dz.sum(axis=0)
        # The sigmoid's inner half is in `half`, its outer one in dg.
        return float(whole.sum() - score) / n, grad

    def update(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.step += 1
        for name, g in grad.items():
            g = np.clip(g, -5, 5)
            one, two = self.moments[name]
            one += 0.1 * (g - one)
            two += 0.001 * (g * g - two)
            self.p[name] -= rate * (one / (1 - 0.9**self.step)) / (np.sqrt(two / (1 - 0.999**self.step)) + 1e-8)
