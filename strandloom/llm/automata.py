"""Probabilistic automata by state merging: prefix trees whose compatible states become one."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np

#: Character classes, the automata's alphabet. Fixed values.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = {c: i for i, cs in enumerate(CLASSES) for c in cs}
_OTHER = len(CLASSES)


class Automaton:
    """A deterministic probabilistic automaton over character classes.

    Learned by blue-fringe merging: a fringe state is merged with the first settled state whose
    outgoing frequencies agree within Hoeffding's bound, here and at all common descendants;
    otherwise it settles itself. Counts are smoothed by `smooth` a symbol when scoring.
    """

    def __init__(self, alpha: float = 0.05, smooth: float = 0.2) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.count: list[dict[int, float]] = [defaultdict(float)]
        self.end: list[float] = [0.0]
        self.alpha, self.smooth = alpha, smooth

    def _total(self, s: int) -> float:
        return self.end[s] + sum(self.count[s].values())

    def _add(self, word: Sequence[int]) -> None:
        s = 0
        for c in word:
            self.count[s][c] += 1
            if c not in self.next[s]:
                self.next[s][c] = len(self.next)
                self.next.append({})
                self.count.append(defaultdict(float))
                self.end.append(0.0)
            s = self.next[s][c]
        self.end[s] += 1

    def _alike(self, a: int, b: int) -> bool:
        todo, width = [(a, b)], math.sqrt(0.5 * math.log(2 / self.alpha))
        while todo:
            a, b = todo.pop()
            m, n = self._total(a), self._total(b)
            if not m or not n:
                continue
            bound = width * (m**-0.5 + n**-0.5)
            if abs(self.end[a] / m - self.end[b] / n) > bound:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / m - self.count[b].get(c, 0) / n) > bound:
                    return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.end[a] += self.end[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, t in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def learn(self, words: Iterable[str]) -> Automaton:
        for w in words:
            self._add([_CLASS.get(c, _OTHER) for c in w])
        red, settled = [0], {0}
        while True:
            fringe = [(-self._total(t), s, c, t) for s in red for c, t in self.next[s].items() if t not in settled]
            if not fringe:
                break
            _, s, c, t = min(fringe)
            for r in red:
                if self._alike(r, t):
                    self.next[s][c] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
                settled.add(t)
        place = {s: i for i, s in enumerate(red)}
        self.next = [{c: place[t] for c, t in self.next[s].items()} for s in red]
        self.count = [self.count[s] for s in red]
        self.end = [self.end[s] for s in red]
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next states and log-probabilities by (state, class), and those of ending by state; unseen transitions restart at the root."""
        k, width = self.smooth, len(CLASSES) + 1
        to = np.zeros((len(self.next), width), np.int64)
        step, end = np.zeros((len(self.next), width)), np.zeros(len(self.next))
        for s in range(len(self.next)):
            size = self._total(s) + k * (width + 1)
            for c in range(width):
                to[s, c] = self.next[s].get(c, 0)
                step[s, c] = math.log((self.count[s].get(c, 0.0) + k) / size)
            end[s] = math.log((self.end[s] + k) / size)
        return to, step, end

    def log_likelihood(self, word: str) -> float:
        """Log-probability of the word's classes, its end included."""
        return float(log_likelihoods(self.tables(), [word])[0])


_CODES = np.full(128, _OTHER, np.int64)
for _c, _i in _CLASS.items():
    _CODES[ord(_c)] = _i


def log_likelihoods(tables: tuple[np.ndarray, np.ndarray, np.ndarray], words: Sequence[str]) -> np.ndarray:
    """log_likelihood() of many words, a character of all at a time, the longest first."""
    to, step, end = tables
    out = np.zeros(len(words))
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    size = np.array([len(words[i]) for i in order], np.int64)
    flat = np.frombuffer("".join(words[i] for i in order).encode("latin-1", "replace"), np.uint8)
    codes = _CODES[np.minimum(flat, 127)]
    first = np.cumsum(size) - size
    state, total = np.zeros(len(words), np.int64), np.zeros(len(words))
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size, -k, "left"))  # words longer than k
        c = codes[first[:n] + k]
        total[:n] += step[state[:n], c]
        state[:n] = to[state[:n], c]
    out[order] = total + end[state]
    return out
