"""Suffix sorting by recursive induction, in blocks: queues on disk hold suffixes and their common-prefix values.

The scheme is that of external induced sorting. Suffixes are of type S (smaller than the next) or L.
Those S that follow an L (left-most S, "marks") cut the text into substrings. Sorting the marks sorts
all: a scan in ascending order puts the suffix before each scanned one, if L, on the queue of its first
character; a scan in descending order does the same for S. A suffix enters its queue in sorted order, so
the queues are a priority queue, and they are read and written in blocks. The value that a
suffix shares with the one before it in its queue is one more than the least value between their
sources in the scan, so common prefixes are induced along with the order.

Marks are first put in the order of their substrings by the same two scans; the substrings' names make
a text a third as long or less, whose order gives that of the marks. That text is sorted by the same
induction, level by level, until one fits in memory. Where characters are names, a queue has a range of
them and is put in order when its turn comes. Texts, names, marks and orders are mapped files, queues beyond
their share of memory go to files, so a text can be far larger than memory. Values are capped: what follows
the first `cap` characters neither orders nor counts.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 18
IN_MEMORY = 64  # bytes a name that ordering names in memory takes
PART = 300  # bytes of a queue's part beside its items


def block_of(ram: int) -> int:
    """Suffixes to work on at a time."""
    return max(2, min(BLOCK, ram // 256))


def mapped(n: int, kind: type, folder: str | None) -> np.ndarray:
    """An array of zeros in a file without a name, which goes with the array."""
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(max(1, n) * np.dtype(kind).itemsize)
        return np.memmap(f, kind, "r+", shape=(max(1, n),))[:n]


class Queues:
    """A queue of (suffix, value) for each character. Beyond `ram` bytes in all, the fullest goes to the file that all share."""

    def __init__(self, n: int, ram: int, folder: str | None = None):
        self.held = [deque() for _ in range(n)]
        self.size = np.zeros(n, np.int64)  # in memory, by queue
        self.spilt: list[deque] = [deque() for _ in range(n)]  # (offset, items) in the file
        self.bytes, self.ram, self.folder, self.block, self.file = 0, ram, folder, block_of(ram), None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.held[c].append((pos, lcp))
        self.size[c] += 6 * len(pos) + PART
        self.bytes += 6 * len(pos) + PART
        while self.bytes > self.ram and self.bytes:
            self._spill(int(self.size.argmax()))

    def _spill(self, c: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)  # has no name, and goes when closed
        pos, lcp = (np.concatenate([x[i] for x in self.held[c]]) for i in (0, 1))
        for i in range(0, len(pos), self.block):
            at = self.file.seek(0, 2)
            self.file.write(pos[i : i + self.block].astype(np.int32).tobytes() + lcp[i : i + self.block].astype(np.uint16).tobytes())
            self.spilt[c].append((at, len(pos[i : i + self.block])))
        self.bytes -= int(self.size[c])
        self.size[c] = 0
        self.held[c].clear()

    def _read(self, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(at)
        b = self.file.read(6 * n)
        return np.frombuffer(b, np.int32, n), np.frombuffer(b, np.uint16, n, 4 * n)

    def pop(self, c: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The next block of the queue, or the one at its end."""
        spilt, held = self.spilt[c], self.held[c]
        if spilt and not (last and held):
            return self._read(*(spilt.pop() if last else spilt.popleft()))
        if not held:
            return None
        parts, n = [], 0
        while held and (not parts or n + len(held[-1 if last else 0][0]) <= self.block):
            parts.append(held.pop() if last else held.popleft())
            n += len(parts[-1][0])
        self.size[c] -= 6 * n + PART * len(parts)
        self.bytes -= 6 * n + PART * len(parts)
        parts = parts[::-1] if last else parts
        return parts[0] if len(parts) == 1 else tuple(np.concatenate([x[i] for x in parts]) for i in (0, 1))

    def pop_all(self, c: int) -> np.ndarray:
        """All suffixes of a queue, in the order in which they came."""
        out = []
        while block := self.pop(c):
            out.append(block[0])
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class Scan:
    """Moves what scanned suffixes induce to the queues, with the values that they share."""

    def __init__(self, text: np.ndarray, queues: Queues, cap: int):
        self.text, self.queues, self.cap = text, queues, cap
        n = len(queues.held)
        self.least = np.zeros(n, np.int64)  # least value since the last push, by queue; 0 before the first
        self.log = np.zeros(queues.block * 2 + BLOCK // 64 + 2, np.int8)
        for i in range(1, 20):
            self.log[1 << i :] = i

    def step(self, pos: np.ndarray, lcp: np.ndarray, allowed) -> None:
        """pos: suffixes in scan order; lcp: shared with the one scanned before; allowed: which characters before induce."""
        n = len(pos)
        if not n:
            return
        before = self.text[np.maximum(pos - 1, 0)]
        src = np.flatnonzero(allowed(before) & (pos > 0))
        to = before[src]
        o = np.argsort(to, kind="stable")
        src, to = src[o], to[o]
        low = int(lcp.min())
        if not len(src):
            np.minimum(self.least, low, out=self.least)
            return
        cut = np.flatnonzero(to[1:] != to[:-1]) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(src)]])
        chars = to[starts].astype(np.int64)
        # ranges of the scan since the last source of the same queue
        a = np.empty(len(src), np.int64)
        a[1:] = src[:-1] + 1
        a[starts] = 0
        tail = src[ends - 1] + 1
        level = self.log[src + 1 - a]
        more = self.log[np.maximum(n - tail, 1)]
        least, rest = np.empty(len(src), np.uint16), np.full(len(tail), self.cap, np.uint16)
        table, top = lcp, max(int(level.max()), int(more.max()))
        by_level = np.argsort(level, kind="stable")
        upto = np.searchsorted(level[by_level], np.arange(top + 2))
        for k in range(top + 1):
            i = by_level[upto[k] : upto[k + 1]]
            least[i] = np.minimum(table[a[i]], table[src[i] + 1 - (1 << k)])
            j = np.flatnonzero((more == k) & (tail < n))
            rest[j] = np.minimum(table[tail[j]], table[n - (1 << k)])
            if k < top:
                table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        least[starts] = np.minimum(least[starts], self.least[chars])
        value = np.minimum(least + np.uint16(1), np.uint16(self.cap)).astype(np.uint16)
        np.minimum(self.least, low, out=self.least)
        self.least[chars] = rest
        new = (pos[src] - 1).astype(np.int32)
        for c, i, j in zip(chars.tolist(), starts.tolist(), ends.tolist(), strict=True):
            self.queues.push(c, new[i:j], value[i:j])


def shared(text: np.ndarray, a: int, b: int, cap: int) -> int:
    """The common prefix of two suffixes, compared."""
    n = min(cap, len(text) - max(a, b))
    differ = np.flatnonzero(text[a : a + n] != text[b : b + n])
    return int(differ[0]) if len(differ) else n


def induce(text: np.ndarray, chars: int, marks: np.ndarray, lcp: np.ndarray | None, cap: int, ram: int, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in blocks with the values shared with the one before.

    marks: the left-most S suffixes, grouped by first character; in order, if the result is to be.
    lcp: their values, none where only the order of their substrings is wanted.
    """
    waiting, larger = Queues(chars, ram // 3, folder), Queues(chars, ram // 3, folder)
    size = np.zeros(chars + 1, np.int64)
    for i in range(0, len(marks), waiting.block):
        size[1:] += np.bincount(text[marks[i : i + waiting.block]], minlength=chars)[:chars]
    bounds = np.cumsum(size)
    scan = Scan(text, waiting, cap)
    for c in range(chars):
        end, fresh = None, True
        while block := waiting.pop(c):
            pos, val = block
            if fresh:  # another first character
                val = val.copy()
                val[0], fresh = 0, False
            scan.step(pos, val, lambda x, c=c: x >= c)
            larger.push(c, pos, val)
            end = int(pos[-1])
        for i in range(bounds[c], bounds[c + 1], larger.block):
            j = min(i + larger.block, bounds[c + 1])
            val = np.zeros(j - i, np.uint16) if lcp is None else np.array(lcp[i:j])
            if i == bounds[c]:
                val[0] = 0 if end is None else shared(text, end, int(marks[i]), cap)
            scan.step(np.asarray(marks[i:j]), val, lambda x, c=c: x > c)
    waiting.close()
    waiting = Queues(chars, ram // 3, folder)
    scan = Scan(text, waiting, cap)
    for c in range(chars - 1, -1, -1):
        end, fresh = None, True
        while block := waiting.pop(c):
            pos, val = block
            if fresh:
                val = val.copy()
                val[0], fresh = 0, False
            scan.step(pos, val, lambda x, c=c: x <= c)
            end = int(pos[-1])
            yield pos, val
        carried = None
        while block := larger.pop(c, last=True):
            pos, up = block[0][::-1], block[1]
            val = np.empty(len(pos), np.uint16)
            val[1:] = up[:0:-1]
            val[0] = carried if carried is not None else 0 if end is None else shared(text, end, int(pos[0]), cap)
            carried = up[0]
            scan.step(pos, val, lambda x, c=c: x < c)
            yield pos, val
    waiting.close()
    larger.close()


def left_most(text: np.ndarray, ram: int, folder: str | None = None) -> np.ndarray:
    """Places of S suffixes that follow an L suffix; the last character is the least and a mark."""
    n, block = len(text), block_of(ram)
    out, at = mapped(n // 2 + 1, np.int32, folder), n // 2 + 1
    then_s = True  # whether the suffix after the block is S
    for j in range(n, 0, -block):
        i = max(0, j - block)
        here, after = np.asarray(text[i:j], np.int64), np.append(text[i + 1 : j], text[j] if j < n else 0).astype(np.int64)
        kind = np.sign(after - here).astype(np.int8)  # 1: S, -1: L, 0: as the next
        if j == n:
            kind[-1] = 1
        first = np.where(kind != 0, np.arange(len(kind)), len(kind))
        s = np.append(kind, 1 if then_s else -1)[np.minimum.accumulate(first[::-1])[::-1]] == 1
        found = np.flatnonzero(s[1:] & ~s[:-1]) + i + 1
        if j < n and then_s and not s[-1]:
            found = np.append(found, j)
        out[at - len(found) : at] = found
        at -= len(found)
        then_s = bool(s[0])
    return out[at:]


def same_substrings(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether text[a:a+n] and text[b:b+n] are equal, for each."""
    ok, left, k = np.ones(len(a), bool), np.arange(len(a)), 0
    while len(left):
        left = left[n[left] > k]
        eq = text[a[left] + k] == text[b[left] + k]
        ok[left[~eq]] = False
        left, k = left[eq], k + 1
    return ok


def rank_names(names: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of a text of names by its first `depth` names at least, and ranks by 1, 2, 4, ... of them."""
    n = len(names)
    sa = np.argsort(names, kind="stable").astype(np.int32)
    k = names[sa]
    head = np.ones(n, bool)
    head[1:] = k[1:] != k[:-1]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    levels, step = [rank.copy()], 1
    tied = np.flatnonzero(~head | ~np.append(head[1:], True))
    while len(tied) and step < depth:
        s = sa[tied]
        then = np.zeros(len(s), np.int64)
        ok = s + step < n
        then[ok] = rank[s[ok] + step] + 1
        k = rank[s].astype(np.int64) * (n + 1) + then
        o = np.argsort(k, kind="stable")
        s, k = s[o], k[o]
        sa[tied] = s
        head = np.ones(len(k), bool)
        head[1:] = k[1:] != k[:-1]
        rank[s] = tied[np.maximum.accumulate(np.where(head, np.arange(len(k)), 0))]
        levels.append(rank.copy())
        tied = tied[~head | ~np.append(head[1:], True)]
        step *= 2
    return sa, levels


def by_first(text: np.ndarray, marks: np.ndarray, chars: int, ram: int, folder: str | None = None) -> np.ndarray:
    """The marks grouped by their character, each group in order of place: a counting sort in blocks."""
    block = block_of(ram)
    size = np.zeros(chars, np.int64)
    for i in range(0, len(marks), block):
        size += np.bincount(text[marks[i : i + block]], minlength=chars)[:chars]
    to, out = np.cumsum(size) - size, mapped(len(marks), np.int32, folder)
    for i in range(0, len(marks), block):
        m = np.asarray(marks[i : i + block])
        c = np.asarray(text[m], np.int64)
        o = np.argsort(c, kind="stable")
        c, first = c[o], np.searchsorted(c[o], np.arange(chars))
        out[to[c] + np.arange(len(c)) - first[c]] = m[o]
        to += np.bincount(c, minlength=chars)
    return out


class Ranges:
    """Ranges of names that hold few suffixes each, cut where a sample of the text says; a very frequent name has one of its own."""

    def __init__(self, text: np.ndarray, ram: int):
        n = len(text)
        # few enough that a range is put in order in few steps, and that the parts of all queues are some 256 suffixes long
        wanted = max(1, min(n // max(16, int((2 * n) ** 0.5)), ram // 6000))
        sample = np.sort(np.asarray(text[:: max(1, n // (32 * wanted))], np.int64))
        self.edges = np.unique(np.append(0, sample[:: max(1, len(sample) // wanted)]))

    def __len__(self) -> int:
        return len(self.edges)

    def of(self, names: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.edges, names, side="right") - 1

    def end(self, k: int) -> int:
        return int(self.edges[k + 1]) if k + 1 < len(self.edges) else 1 << 62


def _deal(queues: Queues, ranges: Ranges, names: np.ndarray, pos: np.ndarray) -> None:
    """Suffixes to the queues of their names' ranges, in the given order."""
    to = ranges.of(names)
    o = np.argsort(to, kind="stable")
    to, pos = to[o], pos[o].astype(np.int32)
    cut = np.flatnonzero(to[1:] != to[:-1]) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(to)], strict=True):
        if i < j:
            queues.push(int(to[i]), pos[i:j], np.zeros(j - i, np.uint16))


def induce_names(text: np.ndarray, marks: np.ndarray, ram: int, folder: str | None = None) -> Iterator[np.ndarray]:
    """All suffixes of a text of names but its end in descending order, in blocks.

    marks: as in induce(). A range of names is put in order when the scan comes to it. What it induces into
    itself goes in at its place, and the scan stops before each such place, so nothing is passed by.
    """
    ranges = Ranges(text, ram)
    waiting, larger, starts = (Queues(len(ranges), ram // 4, folder) for _ in range(3))
    for i in range(0, len(marks), starts.block):
        m = np.asarray(marks[i : i + starts.block])
        _deal(starts, ranges, text[m], m)

    def scanned(k: int, key: np.ndarray, pos: np.ndarray, queues: Queues, up: bool) -> tuple[np.ndarray, np.ndarray]:
        """One range in scan order, with what it induces into itself; key: 2 * name + (1 for S), descending ones negative."""
        i, low, high = 0, int(ranges.edges[k]), ranges.end(k)
        while i < len(pos):
            p = pos[i:].astype(np.int64)
            here = np.abs(key[i:])
            name, is_s = here >> 1, (here & 1) == 1
            before = np.asarray(text[np.maximum(p - 1, 0)], np.int64)
            if up:
                ok = (p > 0) & ((before > name) | (before == name) & ~is_s)
            else:
                ok = (p > 0) & ((before < name) | (before == name) & is_s)
            inside = np.flatnonzero(ok & (before >= low) & (before < high))
            stop, new = len(p), inside[:0]
            if len(inside):
                # behind the others of its kind and name: in ascending order L before S, in descending order S before L
                place = np.searchsorted(key, 2 * before[inside] + 1 if up else -2 * before[inside]) - i
                stop = int(place.min())
                new = inside[inside < stop]
            out = np.flatnonzero(ok[:stop] & ((before[:stop] < low) | (before[:stop] >= high)))
            _deal(queues, ranges, before[out], p[out] - 1)
            if len(new):
                more = 2 * before[new] if up else -(2 * before[new] + 1)
                o = np.argsort(more, kind="stable")
                place = place[: len(new)][o] + i
                pos, key = np.insert(pos, place, (p[new[o]] - 1).astype(np.int32)), np.insert(key, place, more[o])
            i += stop
        return key, pos

    for k in range(len(ranges)):
        a, m = waiting.pop_all(k), starts.pop_all(k)
        pos = np.concatenate([a, m])
        key = 2 * np.asarray(text[pos], np.int64) + np.repeat([0, 1], [len(a), len(m)])
        o = np.argsort(key, kind="stable")
        key, pos = scanned(k, key[o], pos[o], waiting, True)
        large = pos[key & 1 == 0]
        if len(large):
            larger.push(k, large, np.zeros(len(large), np.uint16))
    waiting.close()
    starts.close()
    waiting = Queues(len(ranges), ram // 4, folder)
    for k in range(len(ranges) - 1, -1, -1):
        a, m = waiting.pop_all(k), larger.pop_all(k)[::-1]
        pos = np.concatenate([a, m])
        key = -(2 * np.asarray(text[pos], np.int64) + np.repeat([1, 0], [len(a), len(m)]))
        o = np.argsort(key, kind="stable")
        yield scanned(k, key[o], pos[o], waiting, False)[1]
    waiting.close()
    larger.close()


def order_of_names(names: np.ndarray, depth: int, ram: int, folder: str | None = None) -> np.ndarray:
    """The suffix array of a text of names whose last is its only least one, by the same induction once more."""
    n = len(names)
    marks, sa, _ = mark_order(names, None, depth, ram, folder)
    out, at = mapped(n, np.int32, folder), n
    by_order = mapped(len(marks), np.int32, folder)
    for i in range(0, len(marks), block_of(ram)):
        by_order[i : i + block_of(ram)] = marks[sa[i : i + block_of(ram)]]
    for pos in induce_names(names, by_order, ram, folder):
        out[at - len(pos) : at] = pos[::-1]
        at -= len(pos)
    out[0] = n - 1
    return out


def mark_order(text: np.ndarray, chars: int | None, depth: int, ram: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray, list[np.ndarray] | None]:
    """The marks, their order (which mark is the least, the next, ...), and ranks by names where those were made in memory.

    chars: how many characters there are, none if they are names; what follows `depth` of them need not count.
    """
    marks = left_most(text, ram, folder)
    n = len(marks)
    if n == 1:
        return marks, np.zeros(1, np.int32), None
    if chars is None:
        substrings = induce_names(text, marks, ram, folder)
    else:
        substrings = (pos for pos, _ in induce(text, chars, by_first(text, marks, chars, ram, folder), None, 1, ram, folder))
    # the stream names substrings from the greatest down; the end of the text, the least mark, is not in it
    names, order = mapped(n, np.int32, folder), mapped(n, np.int32, folder)
    count, at, last = 0, n, -1
    is_mark = mapped(len(text), np.bool_, folder)
    for i in range(0, n, block_of(ram)):
        is_mark[marks[i : i + block_of(ram)]] = True
    for pos in substrings:
        i = np.searchsorted(marks, pos[is_mark[pos]]).astype(np.int64)
        if not len(i):
            continue
        b, a = i, np.concatenate([[last], i[:-1]])
        size = lambda x: marks[x + 1] - marks[x] + 1  # up to and with the next mark
        new = np.ones(len(i), bool)
        maybe = np.flatnonzero(a >= 0)
        maybe = maybe[size(a[maybe]) == size(b[maybe])]
        new[maybe] = ~same_substrings(text, marks[a[maybe]], marks[b[maybe]], size(a[maybe]))
        names[i] = count + np.cumsum(new)
        count, last = count + int(new.sum()), int(i[-1])
        order[at - len(i) : at] = i[::-1]
        at -= len(i)
    for i in range(0, n, block_of(ram)):
        names[i : i + block_of(ram)] = count + 2 - names[i : i + block_of(ram)]
    names[n - 1] = 1
    order[0] = n - 1
    if count == n - 1:  # no two are alike
        return marks, order, None
    depth = depth // 2 + 1  # marks are two characters apart at least
    if n * IN_MEMORY <= ram:
        return marks, *rank_names(np.array(names, np.int64), depth)
    return marks, order_of_names(names, depth, ram, folder), None


def sorted_marks(text: np.ndarray, chars: int, cap: int, ram: int, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The marks in the order of their suffixes, and the values they share with the one before."""
    marks, sa, levels = mark_order(text, chars, cap, ram, folder)
    n, block = len(marks), block_of(ram)
    out, lcp = mapped(n, np.int32, folder), mapped(n, np.uint16, folder)
    window = np.lib.stride_tricks.sliding_window_view(text, 16) if len(text) >= 16 else None
    for i in range(0, n, block):
        out[i : i + block] = marks[sa[i : i + block]]
    for i in range(1, n, block):
        j = min(i + block, n)
        p, q = (np.asarray(out[k : k + j - i], np.int64) for k in (i - 1, i))
        k = np.zeros(j - i, np.int64)
        if levels is not None:  # names shared by neighbours, then characters
            a, b = np.asarray(sa[i - 1 : j - 1], np.int64), np.asarray(sa[i:j], np.int64)
            for step in range(len(levels) - 1, -1, -1):
                ok = (a < n) & (b < n)
                ok[ok] = levels[step][a[ok]] == levels[step][b[ok]]
                a, b = a + (ok << step), b + (ok << step)
            k = np.minimum(np.where(a < n, marks[np.minimum(a, n - 1)], len(text)) - p, cap)
        lcp[i:j] = _extended(text, window, p, q, k, cap)
    return out, lcp


def _extended(text: np.ndarray, window: np.ndarray | None, p: np.ndarray, q: np.ndarray, k: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes of suffixes, compared from the k-th character on: 16 at a time, then one by one."""
    far = np.maximum(p, q)
    for wide in (16, 1):
        left = np.flatnonzero((k < cap) & (far + k + wide <= len(text))) if wide == 1 or window is not None else k[:0]
        while len(left):
            x, y = p[left] + k[left], q[left] + k[left]
            left = left[text[x] == text[y]] if wide == 1 else left[(window[x] == window[y]).all(axis=1)]
            k[left] += wide
            left = left[(k[left] < cap) & (far[left] + k[left] + wide <= len(text))]
    return np.minimum(k, cap)


def shard_text(parts: list[bytes], folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the parts in the text they make, and that text: a file that is mapped, with one separator after each part and the least character at its end."""
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    n = int(size.sum()) + 1
    if n > 1 << 31:
        raise ValueError("a shard has 2 GB at most")
    with tempfile.TemporaryFile(dir=folder) as f:
        for p in parts:
            f.write((np.frombuffer(p, np.uint8).astype(np.uint16) + np.uint16(2)).tobytes() + b"\1\0")
        f.write(b"\0\0")
        f.flush()
        return np.cumsum(size) - size, np.memmap(f, np.uint16, "r", shape=(n,))


def in_order(text: np.ndarray, cap: int, ram: int, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of a shard's text in descending order with capped common prefixes."""
    marks, lcp = sorted_marks(text, 258, cap, ram, folder)
    return induce(text, 258, marks, lcp, cap, ram, folder)


def suffixes(parts: list[bytes], cap: int, ram: int = 96 << 20, folder: str | None = None) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Starts of the parts in the text they make, and its suffixes in descending order with capped common prefixes."""
    starts, text = shard_text(parts, folder)
    return starts, in_order(text, cap, ram, folder)


def word_starts(text: np.ndarray, ram: int, folder: str | None = None) -> np.ndarray:
    """How many words start before each place of a shard's text; words are runs without white space or separator."""
    out, block = mapped(len(text) + 1, np.int32, folder), block_of(ram)
    blank = np.zeros(258, bool)
    blank[[0, 1, *(c + 2 for c in (9, 10, 11, 12, 13, 32))]] = True
    count, after = 0, True
    for i in range(0, len(text), block):
        b = blank[text[i : i + block]]
        c = np.cumsum(~b & np.append(after, b[:-1]))
        out[i + 1 : i + 1 + len(b)] = count + c
        count, after = count + int(c[-1]), bool(b[-1])
    return out


def open_runs(step: np.ndarray, ram: int) -> list[tuple[int, int]]:
    """Where the running sum of the steps is above zero."""
    edges, block, total, inside = [], block_of(ram), 0, False
    for i in range(0, len(step), block):
        c = total + np.cumsum(step[i : i + block], dtype=np.int64)
        now = c > 0
        edges += (np.flatnonzero(now != np.append(inside, now[:-1])) + i).tolist()
        total, inside = int(c[-1]), bool(now[-1])
    return list(zip(edges[::2], edges[1::2], strict=True))


def repeated(
    parts: list[bytes], length: int, ram: int = 96 << 20, folder: str | None = None, words: int | None = None, own: list[int] | None = None
) -> list[tuple[np.ndarray, list[tuple[int, int]]]]:
    """For each part, where strings of that length start that also start elsewhere in the parts, and spans of passages.

    Passages are covered by repeats, up to that length, of more than `words` words; none without `words`. Of each part
    only the first `own` places begin one: parts may overlap in what follows those.
    """
    starts, text = shard_text(parts, folder)
    ends = starts + np.fromiter(map(len, parts), np.int64, len(parts))
    hit, last = mapped(len(text), np.bool_, folder), -1
    if words is not None:
        seen, step = word_starts(text, ram, folder), mapped(len(text) + 1, np.int32, folder)
        begins = mapped(len(text) + 1, np.int8, folder)  # +1 where own places start, -1 where they end
        begins[starts] += 1
        np.subtract.at(begins, starts + np.array(own if own is not None else ends - starts, np.int64), 1)
        first, open_ = mapped(len(text), np.bool_, folder), 0
        for i in range(0, len(text), block_of(ram)):
            c = open_ + np.cumsum(begins[i : i + block_of(ram)][: len(text) - i], dtype=np.int64)
            first[i : i + len(c)], open_ = c > 0, int(c[-1])
        held, low = -1, 0  # the last suffix that may begin a passage, and the least value since
    for pos, val in in_order(text, length, ram, folder):
        i = np.flatnonzero(val >= length)
        hit[pos[i]] = True
        hit[np.where(i > 0, pos[i - 1], last)] = True
        last = int(pos[-1])
        if words is None:
            continue
        k = np.flatnonzero(first[pos])
        if not len(k):
            low = min(low, int(val.min()))
            continue
        least = np.minimum.reduceat(val, np.append(0, k[:-1] + 1)).astype(np.int64)
        least[0] = min(int(least[0]), low)
        p = pos[k].astype(np.int64)
        before = np.append(held, p[:-1])
        held, low = int(p[-1]), int(val[k[-1] + 1 :].min(initial=length))
        i = np.flatnonzero(least > 2 * words)
        i = i[seen[p[i] + 1] > seen[p[i]]]  # from the start of a word
        v = np.minimum(least[i], ends[np.searchsorted(starts, p[i], side="right") - 1] - p[i])  # not over a separator
        many = seen[p[i] + v] - seen[p[i]] > words
        for q in (p[i[many]], before[i[many]]):
            np.add.at(step, q, 1)
            np.subtract.at(step, q + v[many], 1)
    passages: list[list[tuple[int, int]]] = [[] for _ in parts]
    if words is not None:
        for a, b in open_runs(step, ram):
            k = int(np.searchsorted(starts, a, side="right")) - 1
            passages[k].append((a - int(starts[k]), b - int(starts[k])))
    # strings that lie over a separator are none
    return [(np.flatnonzero(hit[a : max(a, b - length + 1)]), p) for a, b, p in zip(starts.tolist(), ends.tolist(), passages, strict=True)]
