"""Levenshtein distance by bit vectors and a BK-tree over it."""

from __future__ import annotations


def levenshtein(a: str, b: str) -> int:
    """Unit-cost edit distance, a true metric; one machine step per character of b (Myers' bit vectors)."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    pv, mv = full, 0
    for ch in b:
        eq = at.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | 1) & full
        pv, mv = (mh << 1 & full) | (full & ~(xv | ph)), ph & xv
    return score


class BKTree:
    """Phrases with payloads; `within` returns every phrase in a radius.

    A child on edge d holds phrases at distance d from its parent, so by the
    triangle inequality only edges in [distance - radius, distance + radius]
    can hold a hit.
    """

    def __init__(self, phrases: dict[str, list] | None = None) -> None:
        self.root: tuple[str, list, dict] | None = None
        for phrase, payload in (phrases or {}).items():
            for p in payload:
                self.add(phrase, p)

    def add(self, phrase: str, payload: object) -> None:
        if self.root is None:
            self.root = (phrase, [payload], {})
            return
        node = self.root
        while True:
            d = levenshtein(node[0], phrase)
            if d == 0:
                node[1].append(payload)
                return
            if d not in node[2]:
                node[2][d] = (phrase, [payload], {})
                return
            node = node[2][d]

    def within(self, phrase: str, radius: int) -> list[tuple[int, str, list]]:
        found, todo = [], [self.root] if self.root else []
        while todo:
            at, payload, below = todo.pop()
            d = levenshtein(at, phrase)
            if d <= radius:
                found.append((d, at, payload))
            todo.extend(node for edge, node in below.items() if d - radius <= edge <= d + radius)
        return found
