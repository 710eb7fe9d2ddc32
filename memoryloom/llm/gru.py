"""A gated recurrent language model in numpy: class-factored output, truncated backpropagation, state carried on."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HIDDEN = 16
#: Documents run side by side in so many lanes, in windows of so many steps.
LANES, STEPS = 512, 16
TRAIN_LANES = 256
#: Texts are trained on in stretches of so many tokens, each from a fresh state, so that lanes are of like length.
STRETCH = 512
#: Adagrad's step size.
RATE = 0.15
#: Tokens that are laid out in lanes at once.
LAYOUT_TOKENS = 1 << 21


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)
    return x


@dataclass
class Gru:
    """Weights. Inputs are ids 0 to inputs-1; targets have a class each, and a place among its members or none.

    first, size: where the members of each class are in the word weights. Classes without members (size 0) stand for
    words that are told apart outside of the network.
    """

    x: np.ndarray  # inputs, 3 * HIDDEN: what an input adds to the update gate, the reset gate and the candidate
    h: np.ndarray  # HIDDEN, 3 * HIDDEN
    c: np.ndarray  # HIDDEN, classes
    cb: np.ndarray
    w: np.ndarray  # members, HIDDEN
    wb: np.ndarray
    first: np.ndarray
    size: np.ndarray

    NAMES = ("x", "h", "c", "cb", "w", "wb")

    @classmethod
    def start(cls, inputs: int, class_mass: np.ndarray, member_mass: np.ndarray, first: np.ndarray, size: np.ndarray) -> Gru:
        """Small random recurrent weights; output biases that give the masses' distribution from the start."""
        rng = np.random.default_rng(7)
        f = np.float32
        return cls(
            rng.normal(0, 0.1, (inputs, 3 * HIDDEN)).astype(f), rng.normal(0, 0.15, (HIDDEN, 3 * HIDDEN)).astype(f), np.zeros((HIDDEN, len(class_mass)), f), np.log(class_mass / class_mass.sum()).astype(f),
            np.zeros((len(member_mass), HIDDEN), f), np.log(member_mass / member_mass.sum()).astype(f), first, size,
        )

    def __post_init__(self) -> None:
        self.tame = False

    def settle(self) -> Gru:
        """Note whether no state, all of whose parts are between -1 and 1, can make an exponential overflow."""
        most = [float((np.abs(w).sum(axis=a) + np.abs(b)).max()) for w, a, b in ((self.c, 0, self.cb), (self.w, 1, self.wb))]
        self.tame = max(most) < 80
        return self

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def replaced(self, vector: np.ndarray) -> Gru:
        out, at = {}, 0
        for n in self.NAMES:
            a = getattr(self, n)
            out[n] = vector[at : at + a.size].reshape(a.shape).astype(np.float32)
            at += a.size
        return Gru(**out, first=self.first, size=self.size)

    def steps(self, state: np.ndarray, ids: np.ndarray, fresh: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The states after each step of a window (lanes, steps), and the last one. fresh: a document begins here."""
        k, shape = HIDDEN, (ids.shape[1], len(state))
        out, added, begins = np.empty((*shape, k), np.float32), self.x[ids.T], fresh.any(axis=0)
        if keep is not None:
            keep += [np.empty((*shape, w * k), np.float32) for w in (1, 2, 1, 1)]
        for t in range(ids.shape[1]):
            if begins[t]:
                state = state * ~fresh[:, t, None]
            x, g = added[t], state @ self.h
            gates = _sigmoid(x[:, : 2 * k] + g[:, : 2 * k])
            z, r = gates[:, :k], gates[:, k:]
            n = np.tanh(x[:, 2 * k :] + r * g[:, 2 * k :])
            if keep is not None:
                for whole, part in zip(keep, (state, gates, n, g[:, 2 * k :]), strict=True):
                    whole[t] = part
            state = n + z * (state - n)
            out[t] = state
        return out, state

    def losses(self, hidden: np.ndarray, classes: np.ndarray, members: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of targets from states; with grads, also the gradient of their negated sum.

        Rows are put in order of class once, with a column of ones, so that biases and sums are part of the products.
        """
        k, rows, order = hidden.shape[1], np.arange(len(hidden)), np.argsort(classes.astype(np.uint16), kind="stable")
        classes, members, states = classes[order], members[order], np.ones((len(hidden), hidden.shape[1] + 1), np.float32)
        states[:, :k] = hidden[order]
        logits = states @ np.vstack((self.c, self.cb))
        if not self.tame:
            logits -= logits.max(axis=1, keepdims=True)
        ones = np.ones(max(logits.shape[1], self.size.max()), np.float32)
        of = logits[rows, classes]
        np.exp(logits, out=logits)
        total = logits @ ones[: logits.shape[1]]
        got = of - np.log(total)
        back = None
        if grads is not None:
            logits /= total[:, None]
            logits[rows, classes] -= 1
            both = states.T @ logits
            grads["c"], grads["cb"] = both[:k], both[k]
            back, of_words = logits @ self.c.T, np.zeros((len(self.w), k + 1), np.float32)
        ends = np.searchsorted(classes, np.arange(len(self.size) + 1))
        words = np.hstack((self.w, self.wb[:, None]))
        for c in np.flatnonzero((np.diff(ends) > 0) & (self.size > 1)).tolist():
            at = slice(int(ends[c]), int(ends[c + 1]))
            cols = slice(int(self.first[c]), int(self.first[c] + self.size[c]))
            some = states[at]
            own = some @ words[cols].T
            if not self.tame:
                own -= own.max(axis=1, keepdims=True)
            lane, member = rows[: len(some)], members[at]
            of = own[lane, member]
            np.exp(own, out=own)
            total = own @ ones[: own.shape[1]]
            got[at] += of - np.log(total)
            if grads is not None:
                own /= total[:, None]
                own[lane, member] -= 1
                of_words[cols] = own.T @ some
                back[at] += own @ self.w[cols]
        out = np.empty_like(got)
        out[order] = got
        if grads is None:
            return out, None
        grads["w"], grads["wb"] = of_words[:, :k], of_words[:, k]
        placed = np.empty_like(back)
        placed[order] = back
        return out, placed


class Trainer:
    """Adagrad over windows, truncated at their ends while the state is carried on."""

    def __init__(self, model: Gru) -> None:
        self.m = Gru(*(getattr(model, n).copy() for n in Gru.NAMES), model.first, model.size)
        self.sums = {n: np.full(getattr(model, n).shape, 1e-6, np.float32) for n in Gru.NAMES}

    def _step(self, name: str, at, grad: np.ndarray) -> None:
        s = self.sums[name]
        s[at] += grad * grad
        getattr(self.m, name)[at] -= RATE * grad / np.sqrt(s[at])

    def gradients(self, state: np.ndarray, ids: np.ndarray, fresh: np.ndarray, live: np.ndarray, classes: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """Of the window's summed negated log-likelihood, the entering state held fixed: (last state, gradients of what
        each input adds, by step and lane, of the recurrent weights, and of the output's as losses gives them)."""
        m, k, keep = self.m.settle(), HIDDEN, []
        out, last = m.steps(state, ids, fresh, keep)
        lit = live.T.ravel()
        grads: dict = {}
        _, back = m.losses(out.reshape(-1, k)[lit], classes.T.ravel()[lit], members.T.ravel()[lit], grads)
        full = np.zeros((out.shape[0] * out.shape[1], k), np.float32)
        full[lit] = back
        full = full.reshape(out.shape)
        before, gates, n, g = keep
        z, r = gates[..., :k], gates[..., k:]
        # what the loss's gradient is multiplied by for each gate, of all steps at once
        stay = 1 - z
        to_n, to_z, to_r = stay * (1 - n * n), (before - n) * z * stay, g * r * (1 - r)
        dx, inner = np.empty((*out.shape[:2], 3 * k), np.float32), np.empty((*out.shape[:2], 3 * k), np.float32)
        ahead, begins, back_h = np.zeros_like(state), fresh.any(axis=0), m.h.T
        for t in range(ids.shape[1] - 1, -1, -1):
            d, row = full[t] + ahead, inner[t]
            dn = np.multiply(d, to_n[t], out=dx[t, :, 2 * k :])
            np.multiply(d, to_z[t], out=row[:, :k])
            np.multiply(dn, to_r[t], out=row[:, k : 2 * k])
            np.multiply(dn, r[t], out=row[:, 2 * k :])
            ahead = row @ back_h
            ahead += d * z[t]
            if begins[t]:
                ahead *= ~fresh[:, t, None]
        dx[..., : 2 * k] = inner[..., : 2 * k]
        return last, dx, before.reshape(-1, k).T @ inner.reshape(-1, 3 * k), grads

    def window(self, state: np.ndarray, ids: np.ndarray, fresh: np.ndarray, live: np.ndarray, classes: np.ndarray, members: np.ndarray) -> np.ndarray:
        last, dx, dh, grads = self.gradients(state, ids, fresh, live, classes, members)
        k, scale = HIDDEN, np.float32(1 / max(1, live.sum()))
        clip = lambda g: np.clip(g * scale, -0.1, 0.1)
        flat = ids.T.ravel()
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[order]
        starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
        self._step("x", flat[starts], clip(np.add.reduceat(dx.reshape(-1, 3 * k)[order], starts, axis=0)))
        self._step("h", slice(None), clip(dh))
        for name in ("c", "cb", "w", "wb"):  # words of classes that the window hasn't have no gradient and stay
            self._step(name, slice(None), clip(grads[name]))
        return last


def layouts(docs: list[np.ndarray], lanes: int):
    """Documents (target ids each, the end last) dealt to lanes of nearly equal length, a bounded number of tokens at once.

    Yields (rows of docs in this layout, owner, targets, fresh): matrices of lanes x length, longest lane first; owner
    is the document's place among rows, or -1 past the end of a lane.
    """
    order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
    while order:
        part, n = [], 0
        while order and (not part or n + len(docs[order[0]]) <= LAYOUT_TOKENS):
            part.append(order.pop(0))
            n += len(docs[part[-1]])
        width = min(lanes, len(part))
        filled = [[] for _ in range(width)]
        loads = np.zeros(width, np.int64)
        for i in range(len(part)):
            j = int(loads.argmin())
            filled[j].append(i)
            loads[j] += len(docs[part[i]])
        by = np.argsort(-loads, kind="stable").tolist()
        length = int(loads.max())
        owner, target = np.full((width, length), -1, np.int32), np.zeros((width, length), np.int32)
        fresh = np.zeros((width, length), bool)
        for row, j in enumerate(by):
            at = 0
            for i in filled[j]:
                ids = docs[part[i]]
                owner[row, at : at + len(ids)], target[row, at : at + len(ids)], fresh[row, at] = i, ids, True
                at += len(ids)
        yield part, owner, target, fresh


def windows(owner: np.ndarray, target: np.ndarray, fresh: np.ndarray, end: int):
    """Windows of a layout, without the lanes that have run out: (lanes, inputs, targets, owner, fresh)."""
    loads = (owner >= 0).sum(axis=1)
    inputs = np.full_like(target, end)
    inputs[:, 1:] = target[:, :-1]
    inputs[fresh] = end
    for t in range(0, owner.shape[1], STEPS):
        live = int((loads > t).sum())
        cut = slice(t, min(t + STEPS, owner.shape[1]))
        yield live, inputs[:live, cut], target[:live, cut], owner[:live, cut], fresh[:live, cut]


def train(model: Gru, docs: list[np.ndarray], class_of: np.ndarray, member_of: np.ndarray, end: int, trainer: Trainer | None = None) -> Trainer:
    trainer = trainer or Trainer(model)
    lanes = min(TRAIN_LANES, max(16, sum(map(len, docs)) // 4096))  # few tokens: fewer lanes and so more steps
    for _, owner, target, fresh in layouts([d[i : i + STRETCH] for d in docs for i in range(0, len(d), STRETCH)], lanes):
        state = np.zeros((len(owner), HIDDEN), np.float32)
        for live, ids, want, own, new in windows(owner, target, fresh, end):
            state = trainer.window(state[:live], ids, new, own >= 0, class_of[want], member_of[want])
    return trainer


def log_likelihoods(model: Gru, docs: list[np.ndarray], class_of: np.ndarray, member_of: np.ndarray, end: int) -> np.ndarray:
    """The natural log-likelihood of each whole document, the state carried over all of its windows."""
    out = np.zeros(len(docs))
    model.settle()
    for part, owner, target, fresh in layouts(docs, LANES):
        state, sums = np.zeros((len(owner), HIDDEN), np.float32), np.zeros(len(part))
        for live, ids, want, own, new in windows(owner, target, fresh, end):
            hidden, state = model.steps(state[:live], ids, new)
            lit = (own >= 0).T.ravel()
            want = want.T.ravel()[lit]
            lp, _ = model.losses(hidden.reshape(-1, HIDDEN)[lit], class_of[want], member_of[want])
            sums += np.bincount(own.T.ravel()[lit], lp.astype(np.float64), len(part))
        out[part] = sums
    return out
