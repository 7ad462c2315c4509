"""Alignment of a reference with a prediction, and the counts that all metrics are made from.

The edit counts are those of the least (distance, number of insertions and deletions), so that they depend on
no backtrace: with an insertion or deletion costing B and a substitution B - 1, the least cost holds both.
Where a path is needed, moves are chosen from the end, diagonal before deletion before insertion. The distance comes first, from bit-parallel
columns; it bounds the diagonals that a best path can touch, and only these are worked out. Long paths are found part by part between
kept rows, so memory is that of some rows of the table and not of the table.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

B = 1 << 20


def _codes(a, b) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(a, str):
        return tuple(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for x in (a, b))
    names: dict = {}
    return tuple(np.array([names.setdefault(w, len(names)) for w in x], np.int64) for x in (a, b))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many items at the start are equal."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def distance(x: np.ndarray, y: np.ndarray) -> int:
    """The edit distance, a column of the table at a time in the bits of whole numbers."""
    if not len(x) or not len(y):
        return max(len(x), len(y))
    if len(x) > len(y):
        x, y = y, x
    at: dict[int, int] = {}
    for i, c in enumerate(x.tolist()):
        at[c] = at.get(c, 0) | 1 << i
    full, last = (1 << len(x)) - 1, len(x) - 1
    up, down, score = full, 0, len(x)  # where a column goes up by one from row to row, and where down
    for c in y.tolist():
        equal = at.get(c, 0)
        level = equal | down
        right = ((equal & up) + up ^ up) | equal
        rise, fall = down | full & ~(right | up), up & right
        score += (rise >> last & 1) - (fall >> last & 1)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | full & ~(level | rise), rise & level
    return score


ONE = np.int64(B - 1)


class _Band:
    """The table of costs about the diagonals that a path of the least distance can touch: a row of it at a time, by j - i."""

    FAR = np.int64(1) << 60

    def __init__(self, x: np.ndarray, y: np.ndarray):
        n, m = len(x), len(y)
        self.distance = distance(x, y)
        spare = (self.distance - abs(m - n)) // 2  # steps off the diagonals between start and end, and back
        self.x, self.m = x.tolist(), m
        self.lo, hi = min(0, m - n) - spare, max(0, m - n) + spare
        self.width = hi - self.lo + 1
        self.y = np.concatenate([np.full(max(0, -self.lo), -1, np.int64), y, np.full(max(0, n + hi - m) + 1, -1, np.int64)])  # y[j - 1] stands at j - 1 + max(0, -lo)
        self.steps = np.arange(self.width, dtype=np.int64) * B
        self.k = np.arange(self.width) + self.lo

    def first(self) -> np.ndarray:
        return np.where((self.k >= 0) & (self.k <= self.m), self.k * B, self.FAR)

    def rows(self, row: np.ndarray, i: int, to: int):
        """(row, cost by deletion, cost by the diagonal) of the rows after i, up to `to`."""
        for i in range(i + 1, to + 1):
            at = i - 1 + max(0, self.lo)
            diagonal = (self.y[at : at + self.width] != self.x[i - 1]) * ONE
            diagonal += row
            deleted = np.empty_like(row)
            np.add(row[1:], B, out=deleted[:-1])
            deleted[-1] = self.FAR
            new = np.minimum(deleted, diagonal)
            new -= self.steps
            np.minimum.accumulate(new, out=new)
            new += self.steps
            yield new, deleted, diagonal  # costs left of column 0 stay far, and none right of the last column comes back
            row = new


def counts(a, b) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) from reference a to prediction b: strings or lists of words. Equal ends cost nothing and are left out."""
    if a == b:
        return 0, 0, 0
    x, y = _codes(a, b)
    start = _shared(x, y)
    x, y = x[start:], y[start:]
    end = _shared(x[::-1], y[::-1])
    x, y = x[: len(x) - end], y[: len(y) - end]
    n, m = len(x), len(y)
    if not n or not m:
        return 0, n, m
    band = _Band(x, y)
    if band.distance == abs(m - n):  # nothing but deletions or insertions
        return 0, max(0, n - m), max(0, m - n)
    if n == m and band.distance == np.count_nonzero(x != y):
        return band.distance, 0, 0
    row = band.first()
    for row, _, _ in band.rows(row, 0, n):
        pass
    cost = int(row[m - n - band.lo])
    distance = -(-cost // B)
    s = distance * B - cost
    return s, (distance - s + n - m) // 2, (distance - s - n + m) // 2


#: Cells whose moves are kept at once, two bytes each, and rows that are kept of a larger part.
CELLS, PARTS = 1 << 22, 16


def _back(band: _Band, row: np.ndarray, i: int, to: int, j: int, out: list[str]) -> int:
    """Moves of the rows after i up to `to`, from column j of the last; the column that it comes to in row i. A part with many cells keeps some of its rows and is solved between them from its end, so memory is that of a few rows."""
    if (to - i) * band.width > CELLS and to - i > 1:
        step = -(-(to - i) // PARTS)
        kept = {i: row}
        for at, (row, _, _) in enumerate(band.rows(row, i, to - 1), i + 1):
            if (at - i) % step == 0:
                kept[at] = row
        for at in sorted(kept, reverse=True):
            j = _back(band, kept.pop(at), at, min(at + step, to), j, out)
        return j
    marks = [(new == diagonal, new == deleted) for new, deleted, diagonal in band.rows(row, i, to)]
    at = to
    while at > i:
        k = j - at - band.lo
        if j and marks[at - i - 1][0][k]:
            out.append("=" if band.x[at - 1] == band.y[j - 1 + max(0, -band.lo)] else "S")
            at, j = at - 1, j - 1
        elif not j or marks[at - i - 1][1][k]:
            out.append("D")
            at -= 1
        else:
            out.append("I")
            j -= 1
    return j


def _plain_path(a, b) -> str | None:
    """The same moves, where no table is needed to tell them: one of the two is what is left of the other, or what is exchanged on the diagonal comes back nowhere else on it (then no path has fewer moves), or it is at most two items. None elsewhere."""
    n, m = len(a), len(b)
    if n == m:
        apart = [(p, q) for p, q in zip(a, b, strict=True) if p != q]
        if len(apart) <= 2 or {p for p, _ in apart}.isdisjoint([q for _, q in apart]):
            return "".join("=" if p == q else "S" for p, q in zip(a, b, strict=True))
        return None
    long, k, short, gone = (a, m, b, "D") if n > m else (b, n, a, "I")
    out, spare = [], len(long) - k
    for c in reversed(long):
        if k and c == short[k - 1]:
            out.append("=")
            k -= 1
        elif spare:
            out.append(gone)
            spare -= 1
        else:
            return None
    return "".join(reversed(out))


def path(a, b) -> str:
    """The moves from start to end: = match, S, D, I. Equal items at the end are matches whatever stands before them."""
    if a == b:
        return "=" * len(a)
    if (moves := _plain_path(a, b)) is not None:
        return moves
    x, y = _codes(a, b)
    end = _shared(x[::-1], y[::-1])
    x, y = x[: len(x) - end], y[: len(y) - end]
    band, out = _Band(x, y), ["=" * end]
    if len(x) == len(y) and band.distance == np.count_nonzero(x != y):  # the diagonal is a best path, and goes first
        return "".join(np.where(x == y, "=", "S").tolist()) + "=" * end
    j = _back(band, band.first(), 0, len(x), len(y), out)
    out.append("I" * j)
    return "".join(reversed(out))


def move_counts(moves: str) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a path; those of `counts`, as a path has the least cost."""
    return moves.count("S"), moves.count("D"), moves.count("I")


def longest_omission(moves: str) -> int:
    return max((len(run) for run in moves.replace("S", "=").replace("I", "").split("=")), default=0)


NONE, SPACE, ZWNJ, ODD = 0, 1, 2, 3


def gaps(text: str) -> tuple[str, list[int]]:
    """(text without spaces and ZWNJ, label of the gap before each of its characters and at its end)."""
    base, labels, gap = [], [], ""
    for c in text:
        if c in " ‌":
            gap += c
        else:
            base.append(c)
            labels.append(gap)
            gap = ""
    labels.append(gap)
    return "".join(base), [{"": NONE, " ": SPACE, "‌": ZWNJ}.get(g, ODD) for g in labels]


def spacing(a: str, b: str) -> tuple[int, int, int, int, int, int, int, int]:
    """(space TP, FP, FN, ZWNJ TP, FP, FN, ZWNJ read as space, ZWNJ deleted) over the gaps between characters aligned next to each other.

    A gap counts where the two characters around it are aligned and nothing else lies between them on
    either side; other gaps of the reference are missed, and other gaps of the prediction are false.
    """
    (x, gx), (y, gy) = gaps(a), gaps(b)
    moves = path(x, y)
    got, i, j, last = Counter(), 0, 0, None
    seen_a, seen_b = set(), set()
    for m in moves:
        if m in "=S":
            if last == (i - 1, j - 1):
                seen_a.add(i)
                seen_b.add(j)
                r, p = gx[i], gy[j]
                for name, label in (("space", SPACE), ("zwnj", ZWNJ)):
                    got[name, "tp"] += r == p == label
                    got[name, "fp"] += p == label != r
                    got[name, "fn"] += r == label != p
                got["as_space"] += r == ZWNJ and p == SPACE
                got["gone"] += r == ZWNJ and p == NONE
            last = (i, j)
        i += m in "=SD"
        j += m in "=SI"
    for k in range(1, len(gx) - 1):
        if k not in seen_a:
            got["space", "fn"] += gx[k] == SPACE
            got["zwnj", "fn"] += gx[k] == ZWNJ
    for k in range(1, len(gy) - 1):
        if k not in seen_b:
            got["space", "fp"] += gy[k] == SPACE
            got["zwnj", "fp"] += gy[k] == ZWNJ
    return tuple(got[k] for k in (("space", "tp"), ("space", "fp"), ("space", "fn"), ("zwnj", "tp"), ("zwnj", "fp"), ("zwnj", "fn"), "as_space", "gone"))


CHARS, WORDS = 6, 2
_EDGE = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _chrf_words(text: str) -> list[str]:
    """White-space tokens with one punctuation mark split off the end, or else the start."""
    out = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _EDGE:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _EDGE:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf(a: str, b: str) -> list[int]:
    """For orders 1 to 6 of characters (no white space) and 1 to 2 of words: n-grams of the prediction, of the reference, matched."""
    out = []
    for (x, y), orders in ((("".join(a.split()), "".join(b.split())), CHARS), ((_chrf_words(a), _chrf_words(b)), WORDS)):
        for n in range(1, orders + 1):
            r, p = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (x, y))
            out += [sum(p.values()), sum(r.values()), sum((r & p).values())]
    return out


def numeric(moves: str, spans: list[tuple[int, int, str]], found: list[tuple[int, int, str]]) -> tuple[list[bool], int]:
    """(whether each reference span is exact, unmatched extra spans of the prediction). moves: the path from a to b; spans and found: (start, end, value) in a and b.

    A reference span's place in b is what its characters are aligned with; the found spans that overlap it
    are taken in order of overlap, each once. A match with a wrong value is no extra.
    """
    where, j = [], 0
    for m in moves:
        if m in "=SD":
            where.append(j)
        j += m in "=SI"
    n = len(where)
    where.append(j)
    pairs = []
    for r, (s, e, _) in enumerate(spans):
        lo, hi = where[min(s, n)], where[min(e, n)]
        for f, (fs, fe, _) in enumerate(found):
            if (over := min(hi, fe) - max(lo, fs)) > 0:
                pairs.append((-over, r, f))
    used_f, exact, used_r = set(), [False] * len(spans), set()
    for _, r, f in sorted(pairs):
        if r not in used_r and f not in used_f:
            used_r.add(r)
            used_f.add(f)
            exact[r] = spans[r][2] == found[f][2]
    return exact, len(found) - len(used_f)
