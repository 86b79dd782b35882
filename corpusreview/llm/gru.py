"""A small gated recurrent language model in numpy with a class-factored softmax and truncated backpropagation."""

from __future__ import annotations

import numpy as np

HIDDEN = 24
#: Time steps of a window of backpropagation, and of a block of scoring; the state is carried from one to the next.
WINDOW = 24
SPAN = 64
LANES = 512
RATE = 0.006
#: Weights that one step of the optimiser works on.
PIECE = 1 << 14
#: Token 0 ends a text; it also stands before the first token.
END = 0


def classes_of(frequencies: np.ndarray) -> np.ndarray:
    """First output of each class: about the square root of the outputs, cut at equal shares of the root of the frequency.

    Classes are runs of the outputs, in whatever order these come.
    """
    size = len(frequencies)
    wanted = max(1, int(np.sqrt(size)))
    mass = np.cumsum(np.sqrt(frequencies + 1.0))
    cuts = np.searchsorted(mass, mass[-1] * np.arange(1, wanted) / wanted, "right")
    return np.unique(np.concatenate([[0], np.clip(cuts, 0, size - 1)]))


def _odds(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, chosen: np.ndarray, rows: np.ndarray, shares: bool, logs: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The exponentials of every row, as shares of the row if asked for, and the log probability of the choice of each row, too."""
    scores = states @ weights
    scores += bias
    # far from what states in -1..1 reach; keeps the exponential finite without a maximum per row
    np.minimum(scores, np.float32(80), out=scores)
    picked = scores[rows, chosen].astype(np.float64) if logs else None
    odds = np.exp(scores, out=scores)
    # sums of short rows are products with ones
    total = odds @ np.ones(odds.shape[1], np.float32)
    if shares:
        odds *= np.reciprocal(total)[:, None]
    return odds, picked - np.log(total) if logs else None


class Gru:
    """Weights in one flat vector, so that models can be summed and averaged."""

    def __init__(self, starts: np.ndarray, size: int, hidden: int = HIDDEN, flat: np.ndarray | None = None):
        self.starts, self.size, self.hidden = starts, size, hidden
        self.ends = np.append(starts[1:], size)
        self.class_of = np.repeat(np.arange(len(starts)), self.ends - starts)
        # short numbers sort faster
        self.short_class = self.class_of.astype(np.uint16) if len(starts) < 1 << 16 else self.class_of
        shapes = {"x": (size, 3 * hidden), "u": (hidden, 3 * hidden), "c": (hidden, len(starts)), "cb": (len(starts),), "w": (size, hidden), "wb": (size,)}
        total = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(total, np.float32) if flat is None else flat.astype(np.float32)
        self.shapes = shapes
        self.part = self.views(self.flat)

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, shape in self.shapes.items():
            out[name] = flat[at : at + int(np.prod(shape))].reshape(shape)
            at += int(np.prod(shape))
        return out

    def seed(self, frequencies: np.ndarray) -> None:
        """Small random weights; output biases give the unigram distribution."""
        draw = np.random.default_rng(11)
        for name in ("x", "u", "c", "w"):
            self.part[name][...] = draw.normal(0, 0.08, self.shapes[name])
        self.part["x"][:, : self.hidden] += 1.0  # update gates start by keeping most of the state
        share = (frequencies + 0.5) / (frequencies.sum() + 0.5 * self.size)
        mass = np.add.reduceat(share, self.starts)
        self.part["cb"][...] = np.log(mass)
        self.part["wb"][...] = np.log(share / mass[self.class_of])

    def step(self, tokens: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, and what backpropagation needs."""
        n = self.hidden
        given = self.part["x"][tokens]
        kept = state @ self.part["u"]
        gates = given[:, : 2 * n] + kept[:, : 2 * n]
        gates *= np.float32(0.5)
        np.tanh(gates, out=gates)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        update, reset = gates[:, :n], gates[:, n:]
        fresh = reset * kept[:, 2 * n :]
        fresh += given[:, 2 * n :]
        np.tanh(fresh, out=fresh)
        after = state - fresh
        after *= update
        after += fresh
        return after, update, reset, fresh, kept[:, 2 * n :]

    def losses(self, states: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None, told: bool = True) -> tuple[np.ndarray | None, np.ndarray | None]:
        """Natural log probability of each target: its class given the state, then the word given class and state.

        The states are sorted by the class of their target once; each class then works on a slice.  Gradients can do without
        the probabilities (``told``).
        """
        p = self.part
        kind = self.short_class[targets]
        order = np.argsort(kind, kind="stable")
        kind = kind[order].astype(np.int64)
        hidden, at = states[order], targets[order] - self.starts[kind]
        rows = np.arange(len(targets))
        odds, own = _odds(hidden, p["c"], p["cb"], kind, rows, grads is not None, told)
        logs = own
        back = None
        if grads is not None:
            odds[rows, kind] -= 1.0
            grads["c"] += hidden.T @ odds
            grads["cb"] += np.ones(len(odds), np.float32) @ odds
            back = odds @ p["c"].T
        cuts = np.searchsorted(kind, np.arange(len(self.starts) + 1))
        for c in np.flatnonzero(np.diff(cuts)):
            low, high = self.starts[c], self.ends[c]
            if high - low == 1:
                continue
            mine = slice(cuts[c], cuts[c + 1])
            place = rows[: cuts[c + 1] - cuts[c]]
            odds, own = _odds(hidden[mine], p["w"][low:high].T, p["wb"][low:high], at[mine], place, grads is not None, told)
            if told:
                logs[mine] += own
            if grads is not None:
                odds[place, at[mine]] -= 1.0
                grads["w"][low:high] += odds.T @ hidden[mine]
                grads["wb"][low:high] += np.ones(len(odds), np.float32) @ odds
                back[mine] += odds @ p["w"][low:high]
        unsorted = None
        if told:
            unsorted = np.empty_like(logs)
            unsorted[order] = logs
        if back is None:
            return unsorted, None
        gradient = np.empty_like(back)
        gradient[order] = back
        return unsorted, gradient

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray, told: bool = True) -> tuple[np.ndarray, np.ndarray, float | None]:
        """Flat gradient of the mean loss over one window (steps x lanes), the state after it and, if asked for, the summed log probability.

        The state is set to zero where a text begins; nothing is propagated further back than the window.
        """
        steps, lanes = inputs.shape
        n = self.hidden
        kept = []
        states = np.empty((steps, lanes, n), np.float32)
        alive = (inputs != END).astype(np.float32)[:, :, None]
        for t in range(steps):
            state = state * alive[t]
            kept.append((state, *self.step(inputs[t], state)))
            states[t] = state = kept[-1][1]
        flat = np.zeros_like(self.flat)
        grads = self.views(flat)
        logs, back = self.losses(states.reshape(-1, n), targets.ravel(), grads, told)
        back = back.reshape(steps, lanes, n)
        later = np.zeros((lanes, n), np.float32)
        given = np.empty((steps, lanes, 3 * n), np.float32)
        through = np.empty((lanes, 3 * n), np.float32)
        update, reset, side, away, d_fresh, d_gate = (np.empty((lanes, n), np.float32) for _ in range(6))
        turned = np.ascontiguousarray(self.part["u"].T)
        for t in range(steps - 1, -1, -1):
            before, _, gate, other, fresh, inner = kept[t]
            # whole rows of their own are faster than parts of longer ones
            update[...], reset[...], side[...] = gate, other, inner
            d = back[t]
            d += later
            own = given[t]
            np.subtract(1, update, out=away)
            np.multiply(d, away, out=d_fresh)
            away *= update
            np.subtract(before, fresh, out=d_gate)
            away *= d_gate
            away *= d
            own[:, :n] = through[:, :n] = away
            np.multiply(fresh, fresh, out=away)
            np.subtract(1, away, out=away)
            d_fresh *= away
            own[:, 2 * n :] = d_fresh
            d_fresh *= reset
            through[:, 2 * n :] = d_fresh
            np.subtract(1, reset, out=away)
            away *= side
            away *= d_fresh
            own[:, n : 2 * n] = through[:, n : 2 * n] = away
            grads["u"] += before.T @ through
            later = through @ turned
            d *= update
            later += d
            later *= alive[t]
        order = np.argsort(inputs.ravel().astype(np.uint16 if self.size < 1 << 16 else np.int64), kind="stable")
        tokens = inputs.ravel()[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        grads["x"][tokens[first]] += np.add.reduceat(given.reshape(-1, 3 * n)[order], first, axis=0)
        flat /= np.float32(inputs.size)
        return flat, state, float(logs.sum()) if told else None

    def train(self, tokens: np.ndarray, state: dict | None = None) -> dict:
        """One pass over a stream of texts, each closed by ``END``; ``state`` carries the optimiser from call to call.

        The stream is cut into lanes that are read side by side, window by window.
        """
        state = state or {"m": np.zeros_like(self.flat), "v": np.zeros_like(self.flat), "t": 0, "seen": 0}
        lanes = max(1, min(LANES, len(tokens) // (16 * WINDOW)))
        steps = len(tokens) // lanes
        if not steps:
            return state
        targets = tokens[: steps * lanes].reshape(lanes, steps).T
        inputs = np.concatenate([np.full((1, lanes), END, targets.dtype), targets[:-1]])
        hidden = np.zeros((lanes, self.hidden), np.float32)
        for begin in range(0, steps, WINDOW):
            grad, hidden, _ = self.gradient(inputs[begin : begin + WINDOW], targets[begin : begin + WINDOW], hidden, told=False)
            norm = float(np.sqrt(np.dot(grad, grad)))
            if norm > 1.0:
                grad /= np.float32(norm)
            state["t"] += 1
            scale = RATE * np.sqrt(1 - 0.99 ** state["t"]) / (1 - 0.9 ** state["t"])
            # piece by piece, so that a piece stays in the cache
            for low in range(0, len(grad), PIECE):
                own, m, v = grad[low : low + PIECE], state["m"][low : low + PIECE], state["v"][low : low + PIECE]
                m *= np.float32(0.9)
                m += np.float32(0.1) * own
                own *= own
                own *= np.float32(0.01)
                v *= np.float32(0.99)
                v += own
                root = np.sqrt(v, out=own)
                root += np.float32(1e-6)
                np.divide(m, root, out=root)
                root *= np.float32(scale)
                self.flat[low : low + PIECE] -= root
        state["seen"] += steps * lanes
        return state

    def score(self, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log probability of each whole text, given all tokens in order and their number in each text.

        Texts run side by side, the longest first, so that those still running stay together; the state is carried from
        window to window to a text's end.
        """
        order = np.argsort(-counts, kind="stable")
        starts = (np.cumsum(counts) - counts)[order]
        sizes = counts[order]
        result = np.zeros(len(counts))
        state = np.zeros((len(counts), self.hidden), np.float32)
        longest = int(sizes[0]) if len(sizes) else 0
        running = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest), "right")
        last = np.full(len(counts), END, tokens.dtype)
        for begin in range(0, longest, SPAN):
            span = running[begin : begin + SPAN]
            states = np.empty((int(span.sum()), self.hidden), np.float32)
            targets = np.empty(len(states), tokens.dtype)
            lane = np.empty(len(states), np.int64)
            at = 0
            for t, lanes in enumerate(span):
                state = self.step(last[:lanes], state[:lanes])[0]
                last = tokens[starts[:lanes] + begin + t]
                states[at : at + lanes], targets[at : at + lanes], lane[at : at + lanes] = state, last, np.arange(lanes)
                at += lanes
            result += np.bincount(lane, weights=self.losses(states, targets)[0], minlength=len(counts))
        out = np.empty(len(counts))
        out[order] = result
        return out


def streams(tokens: np.ndarray, counts: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The tokens of the texts to keep, one after the other."""
    return tokens[np.repeat(keep, counts)]

