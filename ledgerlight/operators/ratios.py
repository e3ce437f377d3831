"""Ratios of matching blocks (difflib's, without its junk rule) of quotes and many passages at once.

difflib takes the longest common run of a quote and a passage, of several the first in the quote and then in the passage, and
goes on before and behind it. Here all passages are taken apart together: at runs of at least LONG characters, then at those
of SHORT, then at the rest. A passage is left out as soon as it can't be better than what its text has shown already, even if
all letters that its quote and what is left of it have in common were matched. The most promising are finished first.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Least lengths of the runs of the first two steps.
LONG, SHORT = 4, 3
#: Common trigrams, and cells of what is left, that are held at once.
HELD = 1 << 19
#: Characters of texts that are looked at together, and passages of each that are finished before the others.
TOGETHER, AHEAD = 1 << 16, 3
#: The most frequent letters, which are counted each; the others are counted as one.
LETTERS = 15
#: Rows that are looked at as bits of one number, and columns up to which that is done.
WORD, WIDE = 64, 256
#: Bits of a trigram by which most that no quote has are passed over; and of a place, where places and lengths share a number.
SLOTS = (1 << 18) - 1
PLACES = (1 << 21) - 1


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _places(counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges that begin at `first`, with so many places each: all places, and which range they are of."""
    at = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts - first, counts), at


class _Passages:
    """Pieces (number, quote, text, first, last: places of passages) side by side, with a mark between them that matches
    nothing; `found` has the best ratio for each number. Areas (passage, from and to in the quote, from and to in the text,
    most that may match there) are what is left of passages."""

    def __init__(self, pieces: list[tuple], found: np.ndarray):
        self.found = found
        quotes, texts = [p[1] for p in pieces], [p[2][p[3].min(): p[4].max()] for p in pieces]
        letters, own = np.unique(np.concatenate(quotes), return_inverse=True)
        text = np.concatenate(texts)
        at = np.minimum(np.searchsorted(letters, text), len(letters) - 1)
        text = np.where(letters[at] == text, at, len(letters))
        self.letters, self.marked, begins = len(letters), [], []
        for k, (parts, x) in enumerate(((quotes, own), (texts, text))):
            ends = np.cumsum([0, *map(len, parts)])
            self.marked.append((np.insert(x, ends, len(letters) + 1 + k), np.repeat(np.arange(len(parts)), np.diff(ends) + 1)))
            begins.append(ends[:-1] + np.arange(1, len(parts) + 1))
        self.own, self.text = self.marked[0][0], self.marked[1][0]
        times = [len(p[3]) for p in pieces]
        self.number, top, n = np.repeat([p[0] for p in pieces], times), np.repeat(begins[0], times), np.repeat([len(q) for q in quotes], times)
        first, last = (np.concatenate([p[k] - p[3].min() + b for p, b in zip(pieces, begins[1])]) for k in (3, 4))
        self.total = n + last - first
        self.matched, self.hopes = np.zeros(len(n), np.int64), np.minimum(n, last - first)
        self.areas = np.stack((np.arange(len(n)), top, top + n, first, last, self.hopes))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Common runs of SHORT characters or more, in the text's order: where in the quote, in the text, length. None if
        there are too many."""
        base = self.letters + 3
        own, text = (((p[:len(x) - 2] * base + x[:-2]) * base + x[1:-1]) * base + x[2:] for x, p in self.marked)
        order = np.argsort(own, kind="stable")
        known, begin, times = np.unique(own[order], return_index=True, return_counts=True)
        some = np.zeros(SLOTS + 1, bool)
        some[known & SLOTS] = True
        hit = np.flatnonzero(some[text & SLOTS])  # all that are known, and some others
        at = np.minimum(np.searchsorted(known, text[hit]), len(known) - 1)
        same = known[at] == text[hit]
        hit, at = hit[same], at[same]
        if times[at].sum() > HELD:
            return None
        place, k = _places(times[at], begin[at])
        i, j = order[place], hit[k]
        begins = np.flatnonzero(self.own[i - 1] != self.text[j - 1])
        i, j = i[begins], j[begins]
        n, longer = np.full(len(i), SHORT), np.arange(len(i))
        while len(longer):
            longer = longer[self.own[(i + n)[longer]] == self.text[(j + n)[longer]]]
            n[longer] += 1
        return i, j, n

    def count_letters(self) -> None:
        """How often the letters stand before each place."""
        rank = np.full(self.letters, LETTERS)
        often = np.argsort(-np.bincount(self.own, minlength=self.letters)[:self.letters], kind="stable")[:LETTERS]
        rank[often] = np.arange(len(often))
        self.before = []
        for x in (self.own, self.text):
            seen = np.zeros((len(x) + 1, LETTERS + 1), np.int16 if (self.total < 1 << 15).all() else np.int32)  # only differences count
            there = np.flatnonzero(x < self.letters)
            seen[there + 1, rank[x[there]]] = 1
            self.before.append(np.cumsum(seen, 0, seen.dtype, seen))
        # which of the WORD characters from each place of the quotes on are a letter
        self.bits = (self.own == np.arange(self.letters + 3)[:, None]).astype(np.uint64)
        for k in (1, 2, 4, 8, 16, 32):
            self.bits[:, :-k] |= self.bits[:, k:] << np.uint64(k)

    def most(self, top, bottom, first, last) -> np.ndarray:
        """How many letters can match in an area."""
        own, text = self.before
        return np.minimum(own[bottom] - own[top], text[last] - text[first]).sum(1)

    def sharpen(self, areas: np.ndarray) -> np.ndarray:
        """The areas that stay open if no more can match in them than the longest common subsequence, which is counted by bits."""
        _, top, bottom, first, last, _ = areas
        high, wide = bottom - top, last - first
        few = np.flatnonzero((high <= WORD) & (wide <= WIDE))
        few = few[np.argsort(-wide[few], kind="stable")]
        top, first, wide = top[few], first[few], wide[few]
        bits, length, left = self.bits.ravel(), len(self.own), np.full(len(few), ~np.uint64(0))
        for k, n in enumerate(len(few) - np.searchsorted(wide[::-1], np.arange(wide[0] if len(few) else 0), "right")):
            now = left[:n]
            met = bits[self.text[first[:n] + k] * length + top[:n]] & now
            left[:n] = (now + met) | (now ^ met)
        hope = np.minimum(areas[5, few], np.bitwise_count(~left << (WORD - high[few]).astype(np.uint64)))
        np.subtract.at(self.hopes, areas[0, few], areas[5, few] - hope)
        areas[5, few] = hope
        return self.open(areas[:, areas[5] > 0])

    def open(self, areas: np.ndarray) -> np.ndarray:
        """The areas of passages that may still be better than what is found."""
        better = self.matched + self.hopes > self.found[self.number] * self.total / 2
        return areas[:, better[areas[0]]]

    def within(self, runs, areas: np.ndarray, least: int):
        """The parts of runs that lie in areas, and in which."""
        i, j, n = runs
        reach = np.maximum.accumulate(j + n) if len(j) else j
        _, top, bottom, first, last, _ = areas
        begin = np.searchsorted(reach, first + least)
        k, at = _places(np.maximum(np.searchsorted(j, last - least, "right") - begin, 0), begin)
        i, j, n = i[k], j[k], n[k]
        skip = np.maximum(np.maximum(top[at] - i, first[at] - j), 0)
        n = np.minimum(np.minimum(bottom[at] - i, last[at] - j), n) - skip
        some = n >= least
        return (i + skip)[some], (j + skip)[some], n[some], at[some]

    def rest(self, areas: np.ndarray):
        """The runs in areas that have none of SHORT characters, and in which they are."""
        _, top, bottom, first, last, _ = areas
        i, row = _places(bottom - top, top)
        j, cell = _places((last - first)[row], first[row])
        same = np.flatnonzero(self.own[i][cell] == self.text[j])
        j, cell = j[same], cell[same]
        i, at = i[cell], row[cell]
        begins = (i == top[at]) | (j == first[at]) | (self.own[i - 1] != self.text[j - 1])
        i, j, at = i[begins], j[begins], at[begins]
        more = (i + 1 < bottom[at]) & (j + 1 < last[at]) & (self.own[i + 1] == self.text[j + 1])
        return i, j, 1 + more.astype(np.int64), at

    def split(self, runs, areas: np.ndarray, least: int) -> np.ndarray:
        """Match the longest run of each area, then of what is left before and behind it, until no run is left. Returns what
        is left of passages that may be better."""
        i, j, n, at = runs
        left = []
        while len(at):
            head = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            times = np.diff(np.append(head, len(at)))
            alone = np.ones(areas.shape[1], bool)
            alone[at[head]] = False
            left.append(areas[:, alone])
            passage, top, bottom, first, last, hope = areas[:, at[head]]
            best = -np.maximum.reduceat((n << 42) - (i << 21) - j, head)
            most, up, back = -(best >> 42), best >> 21 & PLACES, best & PLACES
            down, on = up + most, back + most
            before, behind = self.most(top, up, first, back), self.most(down, bottom, on, last)
            self.matched += np.bincount(passage, most, len(self.total)).astype(np.int64)
            self.hopes += np.bincount(passage, before + behind - hope, len(self.total)).astype(np.int64)
            areas = np.concatenate((np.stack((passage, top, up, first, back, before)), np.stack((passage, down, bottom, on, last, behind))), 1)
            better = self.matched + self.hopes > self.found[self.number] * self.total / 2
            stay = better[passage]
            if not stay.all():
                some = np.repeat(stay, times)
                i, j, n, times = i[some], j[some], n[some], times * stay
            at = np.repeat(np.arange(len(head)), times)
            short = np.minimum(np.minimum(up[at] - i, back[at] - j), n)
            skip = np.maximum(np.maximum(down[at] - i, on[at] - j), 0)
            a, b = np.flatnonzero(short >= least), np.flatnonzero(n - skip >= least)
            i, j, n, at = (np.concatenate(x) for x in ((i[a], (i + skip)[b]), (j[a], (j + skip)[b]), (short[a], (n - skip)[b]), (at[a], at[b] + len(head))))
        left.append(areas)
        np.maximum.at(self.found, self.number, 2.0 * self.matched / self.total)
        areas = np.concatenate(left, 1)
        return self.open(areas[:, areas[5] > 0])

    def plain(self, passages: np.ndarray) -> None:
        """difflib itself, in little memory."""
        for k in passages:
            _, top, bottom, first, last, _ = self.areas[:, k]
            if min(bottom - top, last - first) > self.found[self.number[k]] * self.total[k] / 2:
                ratio = SequenceMatcher(None, self.own[top:bottom].tolist(), self.text[first:last].tolist(), autojunk=False).ratio()
                self.found[self.number[k]] = max(self.found[self.number[k]], ratio)

    def finish(self, runs, areas: np.ndarray) -> None:
        """Match the other runs of areas that have none of LONG characters."""
        areas = self.sharpen(self.split(self.within(runs, areas, SHORT), areas, SHORT))
        cells = (areas[2] - areas[1]) * (areas[4] - areas[3])
        if (cells > HELD).any():
            vast = np.unique(areas[0, cells > HELD])
            self.plain(vast)
            small = ~np.isin(areas[0], vast)
            areas, cells = areas[:, small], cells[small]
        which = np.cumsum(cells) // HELD
        for k in np.unique(which):
            some = self.open(areas[:, which == k])
            self.split(self.rest(some), some, 1)

    def best(self) -> bool:
        """Raise `found` to the best ratios; False if there are too many runs to do it at once."""
        if len(self.own) > PLACES >> 1 or len(self.text) > PLACES:
            return False
        runs = self.runs()
        if runs is None:
            return False
        self.count_letters()
        long = np.flatnonzero(runs[2] >= LONG)
        areas = self.sharpen(self.split(self.within([x[long] for x in runs], self.areas, LONG), self.areas, LONG))
        likely = (self.matched + self.hopes) / self.total
        order = np.lexsort((-likely, self.number))
        number = self.number[order]
        ahead = np.zeros(len(order), bool)
        ahead[order[np.arange(len(order)) - np.searchsorted(number, number) < AHEAD]] = True
        first = ahead[areas[0]]
        self.finish(runs, areas[:, first])
        self.finish(runs, self.open(areas[:, ~first]))
        return True


def _raise(pieces: list[tuple], found: np.ndarray) -> None:
    passages = _Passages(pieces, found)
    if passages.best():
        return
    if len(pieces) > 1:
        halves = pieces[:len(pieces) // 2], pieces[len(pieces) // 2:]
    else:
        number, quote, text, first, last = pieces[0]
        k = len(first) // 2
        if not k:
            return passages.plain(np.array([0]))
        halves = [(number, quote, text, first[:k], last[:k])], [(number, quote, text, first[k:], last[k:])]
    for half in halves:
        _raise(half, found)


def best_ratios(quotes: list[str], texts: list[str], spans: list[np.ndarray], found: list[float], stretch: int) -> list[float]:
    """For each quote and text, both case-folded, the greatest ratio of the quote and one of the spans of the text; `found` if
    none is greater. Passages are cut out of stretches of a text, so that what is held does not grow with its length."""
    best, pieces, size = np.array(found, np.float64), [], 0
    for number, (quote, text, of) in enumerate(zip(quotes, texts, spans)):
        own, other, n = codes(quote), codes(text), len(quote)
        places = of[np.lexsort((of[:, 1], of[:, 0]))]
        wide = places[:, 1] - places[:, 0]
        places = places[np.minimum(n, wide) > best[number] * (n + wide) / 2]
        k = 0
        while k < len(places):
            end = max(k + 1, int(np.searchsorted(places[:, 0], places[k, 0] + stretch)))
            over = np.flatnonzero(places[k + 1: end, 1] > places[k, 0] + stretch)
            end = k + 1 + int(over[0]) if len(over) else end
            pieces.append((number, own, other, places[k:end, 0], places[k:end, 1]))
            size += n + int(places[k:end, 1].max() - places[k, 0])
            k = end
            if size >= TOGETHER:
                _raise(pieces, best)
                pieces, size = [], 0
    if pieces:
        _raise(pieces, best)
    return best.tolist()
