"""A generalised suffix automaton over sequences of word numbers."""

from __future__ import annotations


class SuffixAutomaton:
    """All substrings of the sequences added. State 0 is the root.

    ``length[s]`` is the longest substring of state ``s``; ``link[s]`` the state
    of its longest suffix in another class; ``step[s]`` the next states by word.
    """

    def __init__(self) -> None:
        self.length, self.link, self.step = [0], [-1], [{}]

    def add(self, words: list[int]) -> None:
        """Add one sequence. Building on from the root keeps sequences apart without separators."""
        length, link, step = self.length, self.link, self.step
        last = 0
        for w in words:
            known = step[last].get(w)
            if known is not None:
                if length[known] == length[last] + 1:
                    last = known
                    continue
                last = self._split(last, w, known)
                continue
            now = len(length)
            length.append(length[last] + 1)
            link.append(0)
            step.append({})
            p = last
            while p != -1 and w not in step[p]:
                step[p][w] = now
                p = link[p]
            if p != -1:
                q = step[p][w]
                link[now] = q if length[q] == length[p] + 1 else self._split(p, w, q)
            last = now

    def _split(self, p: int, w: int, q: int) -> int:
        """A state for the part of ``q`` that ends at ``p`` followed by ``w``."""
        length, link, step = self.length, self.link, self.step
        new = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        step.append(dict(step[q]))
        while p != -1 and step[p].get(w) == q:
            step[p][w] = new
            p = link[p]
        link[q] = new
        return new

    def matching(self, words: list[int]) -> list[int]:
        """Matching statistics: at each word, the longest suffix up to it that was added."""
        length, link, step = self.length, self.link, self.step
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in step[state]:
                state = link[state]
                n = length[state]
            nxt = step[state].get(w)
            if nxt is None:
                n = 0
            else:
                state, n = nxt, n + 1
            out.append(n)
        return out
