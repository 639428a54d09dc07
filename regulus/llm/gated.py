"""A gated recurrent network over symbols, in numpy, with a class-factored output.

A symbol is either a word of its own or a class of rarer words. The network
gives the probability of the next symbol's class and, for a word of its own, of
the word among those of its class, so each step normalises over some dozens of
entries instead of the whole vocabulary. Texts run side by side in lanes, one
after the other, and the state is set back where a text begins. Windows of some
steps are worked out at once; the state is carried from one to the next, and
gradients end at a window's first step.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Entries of the state; words to a class; steps of a window; texts side by side when learning and when scoring.
STATE, PER_CLASS, STEPS, LEARN_LANES, SCORE_LANES = 16, 32, 32, 256, 512
#: Windows that a pass should have at least, and lanes that it keeps all the same.
WINDOWS, LEAST_LANES = 100, 8
#: States whose classes are worked out at once, so that their exponentials stay near the processor.
BLOCK = 1024
#: Adam's step, decay rates and guard; largest norm of a gradient.
RATE, DECAYS, GUARD, NORM = 0.01, (0.9, 0.99), 1e-8, 1.0


@dataclass
class Shape:
    """``own`` words, in classes of :data:`PER_CLASS`, then ``rare`` classes; the last input starts a text."""

    own: int
    rare: int
    state: int = STATE

    @property
    def word_classes(self) -> int:
        return -(-self.own // PER_CLASS)

    @property
    def classes(self) -> int:
        return self.word_classes + self.rare

    @property
    def start(self) -> int:
        return self.own + self.rare

    def parts(self) -> dict[str, tuple[int, ...]]:
        h = self.state
        return {"inputs": (self.own + self.rare + 1, 3 * h), "again": (h, 3 * h), "to_class": (h, self.classes), "class_bias": (self.classes,), "to_word": (self.own, h), "word_bias": (self.own,)}

    def split(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The weights as views of one vector."""
        held, at = {}, 0
        for name, shape in self.parts().items():
            n = int(np.prod(shape))
            held[name] = flat[at : at + n].reshape(shape)
            at += n
        return held

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())

    def class_of(self, symbols: np.ndarray) -> np.ndarray:
        known = np.arange(self.start)
        return np.where(known < self.own, known // PER_CLASS, known - self.own + self.word_classes).astype(np.int16)[symbols]


def untrained(shape: Shape, counts: np.ndarray, seed: int = 42) -> np.ndarray:
    """Weights that know how often each symbol occurs, and nothing of order."""
    flat = (np.random.default_rng(seed).standard_normal(shape.size) * 0.1).astype(np.float32)
    w = shape.split(flat)
    w["inputs"][:, : shape.state] += 1.0  # gates that keep most of the state at first
    for name in ("to_class", "to_word"):
        w[name][:] *= 0.1
    seen = counts + 0.5
    of_class = np.bincount(shape.class_of(np.arange(shape.start)), seen, shape.classes)
    w["class_bias"][:] = np.log(of_class / of_class.sum())
    w["word_bias"][:] = np.log(seen[: shape.own] / seen[: shape.own].max(initial=1))
    return flat


class Lanes:
    """Texts dealt out to lanes, the longest first to the shortest lane; windows over all lanes that are not over yet."""

    def __init__(self, texts: list[np.ndarray], lanes: int, start: int):
        lengths = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-lengths, kind="stable")
        free = [(0, k) for k in range(max(1, min(lanes, len(texts))))]
        mine: list[list[int]] = [[] for _ in free]
        for i in order:
            n, k = heapq.heappop(free)
            mine[k].append(int(i))
            heapq.heappush(free, (n + int(lengths[i]), k))
        mine.sort(key=lambda m: -sum(int(lengths[i]) for i in m))
        self.order = np.array([i for m in mine for i in m], np.int64)
        self.targets = np.concatenate([texts[i] for i in self.order]) if len(texts) else np.empty(0, np.int16)
        self.firsts = np.cumsum([0, *lengths[self.order]])[:-1]
        self.inputs = np.empty(len(self.targets), np.int32)
        self.inputs[1:] = self.targets[:-1]
        self.inputs[self.firsts] = start
        self.lengths = np.array([sum(int(lengths[i]) for i in m) for m in mine], np.int64)
        self.starts = np.cumsum([0, *self.lengths])[:-1]
        self.start = start

    def windows(self, steps: int = STEPS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(at, there)``: places in ``targets``, steps by lanes, and which of them exist; lanes go from the end."""
        for t in range(0, int(self.lengths.max(initial=0)), steps):
            on = int(np.searchsorted(-self.lengths, -t))
            step = np.arange(t, min(t + steps, int(self.lengths[0])))[:, None]
            there = step < self.lengths[:on]
            yield np.where(there, self.starts[:on] + step, self.starts[:on]), there

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` (as ``targets``) over each text, in the order in which the texts came."""
        out = np.empty(len(self.order))
        if len(self.order):
            out[self.order] = np.add.reduceat(values, self.firsts)
        return out


def logits(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Rows of logits, shifted only where their exponentials could leave the range; entries of states are at most one in size, the last is one."""
    x = states @ np.vstack([weights, bias])
    if float((np.abs(weights).sum(axis=0) + np.abs(bias)).max(initial=0)) > 60:
        x -= x.max(axis=1, keepdims=True)
    return x


def chosen(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The log-probability of entry ``at`` of each row of logits; the rows' exponentials, in place, and their sums."""
    picked = x[np.arange(len(at)), at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    return picked - np.log(total), x, total


def off(exps: np.ndarray, total: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Probabilities less one at the chosen entries, in place."""
    exps /= total[:, None]
    exps[np.arange(len(at)), at] -= 1
    return exps


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def by_gate(weights: np.ndarray) -> np.ndarray:
    """The columns of each gate apart, so that a gate's numbers of all lanes lie together."""
    return weights.reshape(len(weights), 3, -1).transpose(1, 0, 2).copy()


def begins(keep: np.ndarray) -> list[np.ndarray]:
    """Of each step the lanes where a text begins."""
    step, lane = np.nonzero(keep == 0)
    return np.split(lane, np.searchsorted(step, np.arange(1, len(keep))))


class Network:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat, self.w = shape, flat, shape.split(flat)

    def forward(self, inputs: np.ndarray, keep: np.ndarray, state: np.ndarray) -> dict[str, np.ndarray]:
        """States of steps by lanes; ``keep`` is zero where a text begins, and one elsewhere."""
        h, (steps, lanes) = self.shape.state, inputs.shape
        x, u = by_gate(self.w["inputs"]).take(inputs, axis=1), by_gate(self.w["again"])
        before, after, new, back = (np.empty((steps, lanes, h), np.float32) for _ in range(4))
        gates, moved = np.empty((steps, 2, lanes, h), np.float32), np.empty((3, lanes, h), np.float32)
        for t, begin in enumerate(begins(keep)):
            held = before[t]
            held[:] = state
            held[begin] = 0
            np.matmul(held, u, out=moved)
            g = gates[t]
            np.add(x[:2, t], moved[:2], out=g)
            sigmoid(g)
            back[t] = moved[2]
            n = np.multiply(g[1], moved[2], out=new[t])
            n += x[2, t]
            np.tanh(n, out=n)
            state = np.subtract(held, n, out=after[t])
            state *= g[0]
            state += n
        return {"before": before, "after": after, "gates": gates, "new": new, "back": back}

    def output(self, states: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The log-probability of each target after its state; with ``grads``, adds to them and gives the gradient of the states.

        The probability of a rare class stands for all of its words.
        """
        w, shape = self.w, self.shape
        of_class = shape.class_of(targets)
        states = np.hstack([states, np.ones((len(states), 1), states.dtype)])  # the bias is the weight of a one
        kind = np.result_type(states, w["to_class"])
        found, back = np.empty(len(states), kind), None if grads is None else np.empty((len(states), shape.state), kind)
        for s in range(0, len(states), BLOCK):
            mine = slice(s, s + BLOCK)
            found[mine], *rest = chosen(logits(states[mine], w["to_class"], w["class_bias"]), of_class[mine])
            if grads is not None:
                d = off(*rest, of_class[mine])
                change = states[mine].T @ d
                grads["to_class"] += change[:-1]
                grads["class_bias"] += change[-1]
                np.matmul(d, w["to_class"].T, out=back[mine])
        by_class = np.argsort(of_class, kind="stable")  # of short integers, so in linear time
        ends = np.searchsorted(of_class[by_class], np.arange(shape.word_classes + 1))
        by_class = by_class[: ends[-1]]
        ordered, local, logs = states.take(by_class, axis=0), targets[by_class], np.empty(len(by_class), found.dtype)
        d_ordered = None if grads is None else np.empty((len(by_class), shape.state), back.dtype)
        for k in range(shape.word_classes):
            mine = slice(ends[k], ends[k + 1])
            if ends[k] == ends[k + 1]:
                continue
            words = slice(k * PER_CLASS, min((k + 1) * PER_CLASS, shape.own))
            here, at = ordered[mine], local[mine] - words.start
            logs[mine], *rest = chosen(logits(here, w["to_word"][words].T, w["word_bias"][words]), at)
            if grads is not None:
                d = off(*rest, at)
                change = d.T @ here
                grads["to_word"][words] += change[:, :-1]
                grads["word_bias"][words] += change[:, -1]
                np.matmul(d, w["to_word"][words], out=d_ordered[mine])
        found[by_class] += logs
        if grads is not None:
            back[by_class] += d_ordered
        return found, back

    def backward(self, run: dict[str, np.ndarray], keep: np.ndarray, inputs: np.ndarray, d_after: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Adds the gradients of a window, from those of its states; none goes back beyond its first step."""
        h, (steps, lanes) = self.shape.state, inputs.shape
        u = by_gate(self.w["again"]).transpose(0, 2, 1).copy()
        d_x, d_back = np.empty((3, steps, lanes, h), np.float32), np.empty((steps, lanes, h), np.float32)
        d_state, two = np.zeros((lanes, h), np.float32), np.empty((2, lanes, h), np.float32)
        before, gates, new, back = run["before"], run["gates"], run["new"], run["back"]
        # what does not depend on later steps, for all of them at once
        z, r = gates[:, 0], gates[:, 1]
        less = 1 - z
        to_n = new * new
        np.subtract(1, to_n, out=to_n)
        to_n *= less
        to_z = before - new
        to_z *= z
        to_z *= less
        to_r = np.subtract(1, r, out=less)
        to_r *= r
        to_r *= back
        for t, begin in reversed(list(enumerate(begins(keep)))):
            d = d_state
            d += d_after[t]
            d_n = np.multiply(d, to_n[t], out=d_x[2, t])
            np.multiply(d, to_z[t], out=d_x[0, t])
            np.multiply(d_n, to_r[t], out=d_x[1, t])
            np.multiply(d_n, r[t], out=d_back[t])
            np.matmul(d_x[:2, t], u[:2], out=two)
            d_state = d_back[t] @ u[2]
            d_state += two[0]
            d_state += two[1]
            d_state += np.multiply(d, z[t], out=d)
            d_state[begin] = 0
        flat = inputs.reshape(-1).astype(np.int16)
        order = np.argsort(flat, kind="stable")
        rows, states = np.empty((len(flat), 3 * h), np.float32), before.reshape(-1, h).T
        for k, d in enumerate((d_x[0], d_x[1], d_back)):
            mine = slice(k * h, (k + 1) * h)
            grads["again"][:, mine] += states @ d.reshape(-1, h)
            rows[:, mine] = d_x[k].reshape(-1, h).take(order, axis=0)
        flat = flat[order]
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        grads["inputs"][flat[first]] += np.add.reduceat(rows, first)

    def score(self, texts: list[np.ndarray], lanes: int = SCORE_LANES, steps: int = STEPS) -> np.ndarray:
        """The natural logarithm of each text's probability, rare words taken as their classes."""
        dealt = Lanes(texts, lanes, self.shape.start)
        logs = np.zeros(len(dealt.targets))
        state = np.zeros((len(dealt.lengths), self.shape.state), np.float32)
        for at, there in dealt.windows(steps):
            inputs = dealt.inputs[at]
            run = self.forward(inputs, (inputs != self.shape.start).astype(np.float32), state[: at.shape[1]])
            state = run["after"][-1]
            places = at[there]
            logs[places] = self.output(run["after"][there], dealt.targets[places])[0]
        return dealt.sums(logs)

    def learn(self, texts: list[np.ndarray], moments: Moments, lanes: int = LEARN_LANES, steps: int = STEPS) -> int:
        """One pass over the texts by truncated backpropagation, in fewer lanes where there is little to learn from; the number of symbols."""
        lanes = max(LEAST_LANES, min(lanes, sum(map(len, texts)) // (steps * WINDOWS)))
        dealt = Lanes(texts, lanes, self.shape.start)
        state = np.zeros((len(dealt.lengths), self.shape.state), np.float32)
        change = np.zeros_like(self.flat)
        grads = self.shape.split(change)
        for at, there in dealt.windows(steps):
            change[:] = 0
            inputs = dealt.inputs[at]
            keep = (inputs != self.shape.start).astype(np.float32)
            run = self.forward(inputs, keep, state[: at.shape[1]])
            state = run["after"][-1]
            if there.all():
                d_after = self.output(run["after"].reshape(-1, self.shape.state), dealt.targets[at.reshape(-1)], grads)[1].reshape(run["after"].shape)
            else:
                d_after = np.zeros_like(run["after"])
                d_after[there] = self.output(run["after"][there], dealt.targets[at[there]], grads)[1]
            self.backward(run, keep, inputs, d_after, grads)
            change /= there.sum()
            moments.step(self.flat, change)
        return len(dealt.targets)


class Moments:
    """Adam."""

    def __init__(self, size: int):
        self.first, self.second, self.turn = np.zeros(size, np.float32), np.zeros(size, np.float32), 0

    def step(self, flat: np.ndarray, change: np.ndarray) -> None:
        self.turn += 1
        if (norm := float(np.linalg.norm(change))) > NORM:
            change *= NORM / norm
        a, b = DECAYS
        self.first += (1 - a) * (change - self.first)
        self.second += (1 - b) * (change * change - self.second)
        flat -= RATE / (1 - a**self.turn) * self.first / (np.sqrt(self.second / (1 - b**self.turn)) + GUARD)
