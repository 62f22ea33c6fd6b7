"""Gated recurrent language model with a class-factored output, in NumPy.

A token is one of the shortlist's words, or the class of a word outside it. The model
gives ``P(token | all tokens before) = P(class | state) P(token | class, state)``: the
shortlist is cut into classes of about equal weight (square roots of counts), each with a
softmax over its words; a class of other words is a class of its own whose words are
spread by their counts, outside this module.

Training is truncated backpropagation: streams of documents are cut into windows of
``WINDOW`` tokens; the state passes from window to window, the gradient does not; a new
document starts from the zero state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 16
CLASSES = 32
#: Runs read side by side at most, and tokens that each of them has at least.
STREAMS = 512
STREAM_TOKENS = 2048
WINDOW = 16
RATE = 0.1
CLIP = 5.0


@dataclass
class Layout:
    """Fixed facts of a model: how tokens map to classes."""

    words: int  # shortlist tokens 0 .. words - 1, in class order
    others: int  # tokens words .. words + others - 1, one class each
    first: np.ndarray  # first token of each shortlist class, and ``words`` at the end

    @property
    def classes(self) -> int:
        return len(self.first) - 1

    def class_of(self, token: np.ndarray) -> np.ndarray:
        inside = np.searchsorted(self.first, token, side="right") - 1
        return np.where(token < self.words, inside, self.classes + token - self.words)


def layout(counts: np.ndarray, others: int, classes: int = CLASSES) -> Layout:
    """Classes of a shortlist whose counts are given in descending order."""
    words = len(counts)
    weight = np.cumsum(np.sqrt(counts.astype(np.float64) + 1))
    share = weight / weight[-1] if words else weight
    of = np.minimum((share * classes * (1 - 1e-12)).astype(np.int64), classes - 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [words])) if words else np.zeros(1, np.int64)
    return Layout(words, others, first.astype(np.int64))


#: Arrays of a model, in the order in which they are laid out as one vector.
def shapes(lay: Layout, hidden: int = HIDDEN) -> list[tuple[str, tuple[int, ...]]]:
    tokens = lay.words + lay.others
    return [
        ("input", (tokens, 3 * hidden)),
        ("loop", (hidden, 3 * hidden)),
        ("classes", (hidden, lay.classes + lay.others)),
        ("class_bias", (lay.classes + lay.others,)),
        ("words", (lay.words, hidden)),
        ("word_bias", (lay.words,)),
    ]


def unpack(vector: np.ndarray, lay: Layout, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Views of a parameter vector by name."""
    out, at = {}, 0
    for name, shape in shapes(lay, hidden):
        size = int(np.prod(shape))
        out[name] = vector[at : at + size].reshape(shape)
        at += size
    return out


def start(counts: np.ndarray, lay: Layout, seed: int = 7, hidden: int = HIDDEN) -> np.ndarray:
    """First parameters: small draws, and biases that reproduce the token frequencies."""
    rng = np.random.default_rng(seed)
    total = sum(int(np.prod(shape)) for _, shape in shapes(lay, hidden))
    vector = (rng.standard_normal(total) * 0.1).astype(np.float32)
    model = unpack(vector, lay, hidden)
    model["loop"][:] = (rng.standard_normal(model["loop"].shape) / np.sqrt(hidden)).astype(np.float32)
    model["input"][:, :hidden] += 1.0  # gates begin by keeping some of the state
    frequency = np.log(counts + 1.0)
    model["word_bias"][:] = frequency[: lay.words]
    of = lay.class_of(np.arange(lay.words + lay.others))
    model["class_bias"][:] = np.log(np.bincount(of, weights=counts + 1.0, minlength=lay.classes + lay.others))
    model["class_bias"] -= model["class_bias"].max(initial=0)
    return vector


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def step(model: dict, token: np.ndarray, state: np.ndarray) -> tuple:
    """New states after ``token``, with what the way back needs."""
    h = state.shape[1]
    pre, rec = model["input"][token], state @ model["loop"]
    gates = _sigmoid(pre[:, : 2 * h] + rec[:, : 2 * h])
    keep, reset = gates[:, :h], gates[:, h:]
    inner = rec[:, 2 * h :]
    fresh = np.tanh(pre[:, 2 * h :] + reset * inner)
    return fresh + keep * (state - fresh), keep, reset, inner, fresh


def _class_order(of: np.ndarray, lay: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Positions of shortlist tokens ordered by class, and the bounds of each class."""
    order = np.argsort(of.astype(np.uint16), kind="stable")
    bounds = np.searchsorted(of[order], np.arange(lay.classes + 1))
    return order, bounds


def _softmax(logits: np.ndarray, logs: bool = True) -> np.ndarray:
    """Probabilities in place; returns the log of each row's normaliser with its maximum, if asked."""
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    np.exp(logits, out=logits)
    total = logits.sum(axis=1, keepdims=True)
    logits /= total
    return (np.log(total) + top)[:, 0] if logs else top[:, 0]


def _log_normaliser(logits: np.ndarray) -> np.ndarray:
    """Log of each row's sum of exponentials, in place."""
    top = logits.max(axis=1, keepdims=True)
    logits -= top
    np.exp(logits, out=logits)
    return (np.log(logits.sum(axis=1, keepdims=True)) + top)[:, 0]


def log_probabilities(model: dict, lay: Layout, states: np.ndarray, token: np.ndarray, rows: int = 1 << 14) -> np.ndarray:
    """Natural log of P(class) P(token | class) for tokens given their states."""
    cuts = range(0, len(token), rows)
    parts = [_log_probabilities(model, lay, states[a : a + rows], token[a : a + rows]) for a in cuts]
    return np.concatenate(parts) if parts else np.zeros(0)


def _log_probabilities(model: dict, lay: Layout, states: np.ndarray, token: np.ndarray) -> np.ndarray:
    of = lay.class_of(token)
    logits = states @ model["classes"] + model["class_bias"]
    out = logits[np.arange(len(token)), of].astype(np.float64)
    out -= _log_normaliser(logits)
    order, bounds = _class_order(of, lay)
    for k in range(lay.classes):
        at = order[bounds[k] : bounds[k + 1]]
        if len(at):
            a, b = lay.first[k], lay.first[k + 1]
            inner = states[at] @ model["words"][a:b].T + model["word_bias"][a:b]
            chosen = inner[np.arange(len(at)), token[at] - a].astype(np.float64)
            out[at] += chosen - _log_normaliser(inner)
    return out


class Trainer:
    """Windows of truncated backpropagation with AdaGrad steps, one worker's share."""

    def __init__(self, vector: np.ndarray, squares: np.ndarray, lay: Layout, rate: float = RATE, hidden: int = HIDDEN):
        self.lay, self.rate, self.hidden = lay, rate, hidden
        self.vector, self.squares = vector.copy(), squares.copy()
        self.model, self.past = unpack(self.vector, lay, hidden), unpack(self.squares, lay, hidden)

    def _move(self, name: str, rows, gradient: np.ndarray) -> None:
        past = self.past[name][rows] + gradient * gradient
        self.past[name][rows] = past
        self.model[name][rows] -= self.rate * gradient / np.sqrt(past + 1e-6)

    def window(
        self, before: np.ndarray, token: np.ndarray, begins: np.ndarray, state: np.ndarray, lossy: bool = True
    ) -> tuple[np.ndarray, float]:
        """One update from (streams, steps) tokens; returns the state and, if ``lossy``, the loss."""
        lay, model, hidden = self.lay, self.model, self.hidden
        streams, steps = token.shape
        states = np.empty((steps + 1, streams, hidden), np.float32)
        states[0] = state
        kept = []
        for t in range(steps):
            entering = states[t] * ~begins[:, t, None]
            new, *rest = step(model, before[:, t], entering)
            states[t + 1] = new
            kept.append((entering, *rest))
        flat = states[1:].reshape(-1, hidden)
        target = token.T.ravel()
        of = lay.class_of(target)
        n = len(target)
        every = np.arange(n)
        logits = flat @ model["classes"] + model["class_bias"]
        loss = -float(logits[every, of].sum(dtype=np.float64)) if lossy else 0.0
        normaliser = _softmax(logits, lossy)
        loss += float(normaliser.sum(dtype=np.float64)) if lossy else 0.0
        logits[every, of] -= 1.0
        logits *= 1.0 / n
        back = logits @ model["classes"].T
        classes, class_bias = flat.T @ logits, logits.sum(axis=0)
        words = np.zeros_like(model["words"])
        word_bias = np.zeros_like(model["word_bias"])
        order, bounds = _class_order(of, lay)
        for k in range(lay.classes):
            at = order[bounds[k] : bounds[k + 1]]
            if not len(at):
                continue
            a, b = int(lay.first[k]), int(lay.first[k + 1])
            own = flat[at]
            inner = own @ model["words"][a:b].T + model["word_bias"][a:b]
            chosen = (every[: len(at)], target[at] - a)
            loss -= float(inner[chosen].sum(dtype=np.float64)) if lossy else 0.0
            normaliser = _softmax(inner, lossy)
            loss += float(normaliser.sum(dtype=np.float64)) if lossy else 0.0
            inner[chosen] -= 1.0
            inner *= 1.0 / n
            back[at] += inner @ model["words"][a:b]
            words[a:b] = inner.T @ own
            word_bias[a:b] = inner.sum(axis=0)
        back = back.reshape(steps, streams, hidden)
        ahead = np.zeros((streams, hidden), np.float32)
        loop = np.zeros_like(model["loop"])
        inputs = np.empty((steps, streams, 3 * hidden), np.float32)
        for t in range(steps - 1, -1, -1):
            entering, keep, reset, inner, fresh = kept[t]
            d = ahead + back[t]
            d_fresh = d * (1 - keep) * (1 - fresh * fresh)
            gates = inputs[t]
            gates[:, :hidden] = d * (entering - fresh) * keep * (1 - keep)
            gates[:, hidden : 2 * hidden] = d_fresh * inner * reset * (1 - reset)
            gates[:, 2 * hidden :] = d_fresh
            through = gates.copy()
            through[:, 2 * hidden :] *= reset
            loop += entering.T @ through
            ahead = (d * keep + through @ model["loop"].T) * ~begins[:, t, None]
        used = before.T.ravel()
        order = np.argsort(used, kind="stable")
        rows, heads = np.unique(used[order], return_index=True)
        summed = np.add.reduceat(inputs.reshape(-1, 3 * hidden)[order], heads, axis=0)
        norm = np.sqrt(sum(float((g * g).sum()) for g in (loop, classes, words, summed)))
        scale = np.float32(min(1.0, CLIP / max(norm, 1e-9)))
        self._move("input", rows, summed * scale)
        self._move("loop", slice(None), loop * scale)
        self._move("classes", slice(None), classes * scale)
        self._move("class_bias", slice(None), class_bias * scale)
        # Words of classes that did not occur have no gradient and stay where they are.
        self._move("words", slice(None), words * scale)
        self._move("word_bias", slice(None), word_bias * scale)
        return states[-1], loss

    def learn(self, tokens: np.ndarray, begins: np.ndarray, end: int, steps: int = WINDOW, lossy: bool = True) -> float:
        """One pass over documents laid end to end; ``begins`` marks their first tokens.

        The row is cut into ``streams`` runs that are read side by side; the last window may
        be shorter, and tokens that do not fill a run are read as a run of their own.
        """
        loss = 0.0
        before = np.concatenate(([end], tokens[:-1])).astype(np.int64)
        before[begins] = end
        streams = max(1, min(STREAMS, len(tokens) // STREAM_TOKENS))
        length = len(tokens) // streams
        body = length * streams
        for a, b, count in ((0, body, streams), (body, len(tokens), 1)):
            if a == b:
                continue
            t, p, s = (x[a:b].reshape(count, -1) for x in (tokens, before, begins))
            state = np.zeros((count, self.hidden), np.float32)
            for at in range(0, t.shape[1], steps):
                cut = slice(at, at + steps)
                state, lost = self.window(p[:, cut], t[:, cut], s[:, cut], state, lossy)
                loss += lost
        return loss


def document_scores(
    model: dict, lay: Layout, token: np.ndarray, first: np.ndarray, end: int, hidden: int = HIDDEN, rows: int = 1 << 14
) -> np.ndarray:
    """Natural log probability of each whole document, all documents a step at a time.

    Only the states of about ``rows`` tokens are kept before they are scored, so a long
    document shares its steps with all others and costs no memory of its own.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    heads = first[:-1][order]
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    out = np.zeros(len(order))
    state = np.zeros((len(order), hidden), np.float32)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0

    def score() -> None:
        tokens = np.concatenate([t for t, _ in held]).astype(np.int64)
        chance = log_probabilities(model, lay, np.concatenate([s for _, s in held]), tokens)
        at = 0
        for t, _ in held:
            out[: len(t)] += chance[at : at + len(t)]
            at += len(t)
        held.clear()

    last = np.full(len(order), end, np.int64)
    for t, n in enumerate(active.tolist()):
        now = token[heads[:n] + t]
        state = step(model, last[:n], state[:n])[0]
        held.append((now, state))
        last, count = now, count + n
        if count >= rows or len(held) >= rows:
            score()
            count = 0
    if held:
        score()
    back = np.empty(len(order))
    back[order] = out
    return back


def states_of(model: dict, lay: Layout, token: np.ndarray, first: np.ndarray, end: int, hidden: int = HIDDEN) -> np.ndarray:
    """State before each token of whole documents, all documents a step at a time."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    heads = first[:-1][order]
    active = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    out = np.empty((len(token), hidden), np.float32)
    state = np.zeros((len(order), hidden), np.float32)
    for t, n in enumerate(active.tolist()):
        at = heads[:n] + t
        last = token[at - 1] if t else np.full(n, end, np.int64)
        state = step(model, last, state[:n])[0]
        out[at] = state
    return out
