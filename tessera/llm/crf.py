"""A linear-chain conditional random field in numpy: training and batched Viterbi.

A token is given by a tuple of feature names. Its score for a label sums the
weights of its own features, of the token before and of the token after.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SIDES = 3  # own features, those of the token before, those of the token after


@dataclass
class ChainModel:
    labels: list[str]
    features: dict[str, int]
    weights: np.ndarray  # SIDES x features x labels
    transitions: np.ndarray  # labels x labels
    tables: list[np.ndarray] = field(default_factory=list, repr=False)  # of known feature tuples, SIDES x labels each
    known: dict[tuple, int] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"labels": self.labels, "features": self.features, "weights": self.weights, "transitions": self.transitions}

    def __setstate__(self, state):
        self.__init__(**state)

    def number(self, names: tuple) -> int:
        """A dense number for the feature tuple; equal tuples share one."""
        found = self.known.get(names)
        if found is None:
            rows = [self.features[n] for n in names if n in self.features]
            self.tables.append(self.weights[:, rows].sum(axis=1))
            found = self.known[names] = len(self.tables) - 1
        return found

    def forget(self, most: int = 1 << 17) -> bool:
        """Drops what ``number`` has learnt once it passes ``most``; numbers given before are then void."""
        if len(self.known) <= most:
            return False
        self.tables, self.known = [], {}
        return True

    def emissions(self, numbers: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """tokens x labels; first and last mark where sequences begin and end."""
        table = np.stack(self.tables).astype(np.float32)
        out = table[numbers, 0]
        if len(numbers) > 1:
            out[1:] += table[numbers[:-1], 1] * ~first[1:, None]
            out[:-1] += table[numbers[1:], 2] * ~last[:-1, None]
        return out

    def decode(self, numbers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labels of sequences laid end to end; label 0 is "outside".

        A token that no run of inner labels could hold with a gain, even with
        the best transitions, is certain to have label 0; only the parts between
        such tokens go through Viterbi. That is exact.
        """
        out = np.zeros(len(numbers), np.int8)
        if not len(numbers):
            return out
        ends = np.cumsum(lengths)
        starts = ends - lengths
        first, last = np.zeros(len(numbers), bool), np.zeros(len(numbers), bool)
        filled = lengths > 0
        first[starts[filled]], last[ends[filled] - 1] = True, True
        scores = self.emissions(numbers, first, last)
        # A step between labels costs what it does beyond one that stays outside: all of it is
        # charged to the one inner label of the two, or half to each where both are inner.
        step = self.transitions - self.transitions[0, 0]
        enter = np.maximum(step[0, 1:], step[1:, 1:].max(axis=0) / 2)
        leave = np.maximum(step[1:, 0], step[1:, 1:].max(axis=1) / 2)
        most = scores[:, 1:] - scores[:, :1] + (enter + leave)
        most[first] += np.maximum(0, -enter)
        most[last] += np.maximum(0, -leave)
        worth = most.max(axis=1).astype(np.float64) + 1e-3
        # The best sum of a run that holds the token, by prefix sums; falling steps between sequences keep runs inside one.
        fall = np.repeat(np.arange(len(lengths)) * (np.abs(worth).max() * (lengths.max() + 2) + 1), lengths)
        total = np.cumsum(worth)
        base = np.repeat(np.concatenate([[0.0], total])[starts], lengths)
        upto = total - base - fall
        before = np.minimum.accumulate(upto - worth)
        after = np.maximum.accumulate(upto[::-1])[::-1]
        inner = np.nonzero(after - before > 0)[0]
        if not len(inner):
            return out
        owner = np.repeat(np.arange(len(lengths)), lengths)
        cut = np.nonzero((np.diff(inner) > 1) | (np.diff(owner[inner]) > 0))[0] + 1
        begin, stop = inner[np.concatenate([[0], cut])], inner[np.concatenate([cut - 1, [len(inner) - 1]])] + 1
        order = np.argsort(stop - begin, kind="stable")
        at = 0
        while at < len(order):  # batches of like lengths
            longest = (stop - begin)[order[at]] * 1.25 + 4
            upper = at + int(np.searchsorted((stop - begin)[order[at:]], longest, side="right"))
            batch = order[at : min(upper, at + 4096)]
            parts = []
            for k in batch:  # the places just outside a part are certain to have label 0
                part = scores[begin[k] : stop[k]].copy()
                part[0] += 0 if first[begin[k]] else self.transitions[0]
                part[-1] += 0 if last[stop[k] - 1] else self.transitions[:, 0]
                parts.append(part)
            for k, path in zip(batch, viterbi(parts, self.transitions)):
                out[begin[k] : stop[k]] = path
            at += len(batch)
        return out


def viterbi(sequences: list[np.ndarray], transitions: np.ndarray) -> list[np.ndarray]:
    """The best path of each sequence of scores (tokens x labels), all in step."""
    lengths = np.array([len(s) for s in sequences])
    steps, n, labels = int(lengths.max()), len(sequences), len(transitions)
    score = np.zeros((steps, n, labels), np.float32)
    for k, s in enumerate(sequences):
        score[: len(s), k] = s
    back = np.zeros((steps, n, labels), np.int8)
    best = score[0].copy()
    for t in range(1, steps):
        options = best[:, :, None] + transitions[None]
        back[t] = options.argmax(axis=1)
        moved = options.max(axis=1) + score[t]
        best = np.where((t < lengths)[:, None], moved, best)
    state = best.argmax(axis=1)
    paths = np.zeros((steps, n), np.int8)
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        paths[t] = state
        if t:
            state = np.where(t < lengths, back[t, rows, state], state)
    return [paths[: lengths[k], k] for k in range(n)]


def train(sequences: list[tuple[list[tuple], list[str]]], labels: list[str], epochs: int = 40, rate: float = 0.1, decay: float = 1e-4, batch: int = 256) -> ChainModel:
    """Maximises the likelihood of the labelled sequences by Adam; the order of the sequences fixes the result."""
    names = sorted({n for tokens, _ in sequences for t in tokens for n in t})
    features = {n: k for k, n in enumerate(names)}
    sequences = [s for s in sequences if s[0]]
    kinds = {t: k for k, t in enumerate(dict.fromkeys(t for tokens, _ in sequences for t in tokens))}
    uses = np.zeros((len(kinds) + 1, len(features)))  # the last row is for places outside a sequence
    for token, k in kinds.items():
        uses[k, [features[n] for n in token]] = 1
    none, count = len(kinds), len(labels)
    groups = []
    sequences = sorted(sequences, key=lambda s: len(s[0]))
    for at in range(0, len(sequences), batch):
        part = sequences[at : at + batch]
        steps = max(len(t) for t, _ in part)
        x, y = np.full((len(part), steps + 2), none), np.zeros((len(part), steps), np.int64)
        mask = np.zeros((len(part), steps), bool)
        for k, (tokens, tags) in enumerate(part):
            x[k, 1 : len(tokens) + 1] = [kinds[t] for t in tokens]
            y[k, : len(tags)] = [labels.index(t) for t in tags]
            mask[k, : len(tokens)] = True
        groups.append((np.stack([x[:, 1:-1], x[:, :-2], x[:, 2:]]), y, mask))
    w, trans = np.zeros((SIDES, len(features), count)), np.zeros((count, count))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)]
    tick = 0
    for _ in range(epochs):
        for x, y, mask in groups:
            table = uses @ w
            grad_e, grad_t = _gradients(sum(table[side][x[side]] for side in range(SIDES)), trans, y, mask)
            tokens = mask.sum()
            by_kind = np.zeros_like(table)
            for side in range(SIDES):
                for label in range(count):
                    by_kind[side, :, label] = np.bincount(x[side].ravel(), weights=grad_e[:, :, label].ravel(), minlength=none + 1)
            grad_w = uses.T @ by_kind / tokens + decay * w
            grad_t = grad_t / tokens + decay * trans
            tick += 1
            for value, grad, k in ((w, grad_w, 0), (trans, grad_t, 2)):
                moments[k] = 0.9 * moments[k] + 0.1 * grad
                moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * grad**2
                value -= rate * (moments[k] / (1 - 0.9**tick)) / (np.sqrt(moments[k + 1] / (1 - 0.999**tick)) + 1e-8)
    return ChainModel(labels, features, w.astype(np.float32), trans.astype(np.float32))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _gradients(score, trans, y, mask):
    """Expected less observed counts of labels and of label pairs, by forward and backward sums."""
    n, steps, count = score.shape
    ahead, behind = np.zeros_like(score), np.zeros_like(score)
    ahead[:, 0] = score[:, 0]
    for t in range(1, steps):
        moved = _log_sum(ahead[:, t - 1, :, None] + trans[None], 1) + score[:, t]
        ahead[:, t] = np.where(mask[:, t, None], moved, ahead[:, t - 1])
    for t in range(steps - 2, -1, -1):
        moved = _log_sum(trans[None] + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(mask[:, t + 1, None], moved, 0)
    total = _log_sum(ahead[:, -1], 1)
    share = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
    rows = np.arange(n)[:, None]
    grad_e = share.copy()
    grad_e[rows, np.arange(steps)[None], y] -= mask
    grad_t = np.zeros_like(trans)
    for t in range(1, steps):
        live = mask[:, t]
        pair = ahead[live, t - 1, :, None] + trans[None] + (score[live, t] + behind[live, t])[:, None, :] - total[live, None, None]
        grad_t += np.exp(pair).sum(axis=0)
        np.subtract.at(grad_t, (y[live, t - 1], y[live, t]), 1)
    return grad_e, grad_t
