"""Suffix sorting with common-prefix values by external induced sorting.

Text, types, suffix lists and queues lie on disk; memory holds chunks of them, so many that they stay within a budget,
whatever the length of the text. Suffixes are typed L (greater than their successor) or S. The starred S suffixes (an S after
an L) are sorted by their substrings in sorted runs that are merged, named, and where names repeat sorted by recursion on
the text of names. One pass from the least symbol up then induces the L suffixes, one from the greatest down the S
suffixes. A pass pops a priority queue keyed by symbol and order of arrival; entries of one symbol arrive in sorted order. At
the top the queue is a row of first-in-first-out buckets by symbol, and its entries are tuples of a suffix and the
prefix it shares with the entry before it. Texts of names have about as many symbols as suffixes; there the queue is a row of
buckets by ranges of symbols, and as many symbols are popped at once as do not induce into one another. A chunk
is an array, and NumPy does for the array what a loop would do for each suffix.
"""

from __future__ import annotations

import os
import tempfile
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: Reduced texts up to this length are sorted by prefix doubling in memory, longer ones by another induction.
BASE = 1 << 14
BUDGET = 16 << 20
#: Bytes of memory that one entry of a chunk stands for while it is worked on.
ENTRY_BYTES = 512


class Disk:
    """Arrays in files of one folder, which a process maps; the system may drop their pages from memory at any time."""

    def __init__(self, folder: str, budget: int):
        self.folder, self.budget, self.count = folder, budget, 0
        self.chunk = max(64, budget // ENTRY_BYTES)

    def path(self) -> str:
        self.count += 1
        return os.path.join(self.folder, f"array-{os.getpid()}-{self.count}")

    def array(self, n: int, dtype: np.dtype | type) -> np.ndarray:
        return np.memmap(self.path(), dtype=dtype, mode="w+", shape=(n,)) if n else np.empty(0, dtype)

    def drop(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if isinstance(a, np.memmap):
                os.unlink(a.filename)


class RunSort:
    """(key, value) records by key: sorted runs of a quarter of the budget, one after the other in two files, merged in chunks."""

    def __init__(self, disk: Disk):
        self.disk, self.held, self.size = disk, [], 0
        self.limit = max(64, disk.budget // 64)
        self.paths, self.ends = (disk.path(), disk.path()), array("q", [0])

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        if not len(keys):
            return
        self.held.append((keys, values))
        self.size += len(keys)
        if self.size >= self.limit:
            for path, column, kind in zip(self.paths, self._sorted(), (np.uint64, np.int64), strict=True):
                with open(path, "ab") as out:
                    column.astype(kind, copy=False).tofile(out)
                n = len(column)
            self.ends.append(self.ends[-1] + n)

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = (np.concatenate([h[c] for h in self.held]) for c in (0, 1))
        self.held, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        return keys[order], values[order]

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        last = self._sorted() if self.held else None
        if len(self.ends) == 1:
            if last is not None:
                yield last
            return
        whole = [np.asarray(np.memmap(p, dtype=kind, mode="r")) for p, kind in zip(self.paths, (np.uint64, np.int64), strict=True)]
        runs = [(whole[0][a:b], whole[1][a:b]) for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]
        runs += [last] if last is not None else []
        step = max(16, self.limit // len(runs))
        at = [0] * len(runs)
        while any(a < len(k) for a, (k, _) in zip(at, runs, strict=True)):
            # Keys up to the least of the blocks' last ones are all in memory.
            cut = min((k[a + step - 1] for a, (k, _) in zip(at, runs, strict=True) if a + step < len(k)), default=np.uint64((1 << 64) - 1))
            parts = []
            for r, (k, v) in enumerate(runs):
                block = np.asarray(k[at[r] : at[r] + step])
                n = int(np.searchsorted(block, cut, side="right"))
                if n:
                    parts.append((block[:n], np.asarray(v[at[r] : at[r] + n])))
                    at[r] += n
            keys, values = (np.concatenate([p[c] for p in parts]) for c in (0, 1))
            order = np.argsort(keys, kind="stable")
            yield keys[order], values[order]
        for path in self.paths:
            os.unlink(path)


class BucketQueue:
    """First-in-first-out buckets of (suffix, common prefix) by number; beyond a quarter of the budget they go to two files."""

    def __init__(self, disk: Disk, width: np.dtype | type):
        self.disk, self.width, self.chunk = disk, np.dtype(width), disk.chunk
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.spilled: dict[int, tuple[array, array]] = {}  # first records and numbers of records
        self.heads: dict[int, int] = {}  # segments of a bucket that are used up
        self.bytes, self.records, self.spills = 0, 0, 0
        self.files = [open(disk.path(), "w+b") for _ in range(2)]

    def push(self, bucket: int, suffixes: np.ndarray, shared: np.ndarray) -> None:
        self.held.setdefault(bucket, []).append((suffixes, shared))
        self.bytes += suffixes.nbytes + shared.nbytes + 128
        if self.bytes > self.disk.budget // 4:
            self._spill()

    def deal(self, buckets: np.ndarray, suffixes: np.ndarray, shared: np.ndarray) -> None:
        """Push entries that are ordered by bucket."""
        if len(buckets):
            starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True):
                self.push(int(buckets[a]), suffixes[a:b].copy(), shared[a:b].copy())

    def _spill(self) -> None:
        for f in self.files:
            f.seek(0, 2)
        for bucket, parts in self.held.items():
            n = sum(len(a) for a, _ in parts)
            for a, b in parts:
                self.files[0].write(a.astype(np.int64, copy=False).tobytes())
                self.files[1].write(b.astype(self.width, copy=False).tobytes())
            first, count = self.spilled.setdefault(bucket, (array("q"), array("q")))
            first.append(self.records)
            count.append(n)
            self.records += n
        self.held, self.bytes, self.spills = {}, 0, self.spills + 1

    def _read(self, first: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for f, t in zip(self.files, (np.dtype(np.int64), self.width), strict=True):
            f.seek(first * t.itemsize)
            out.append(np.frombuffer(f.read(n * t.itemsize), t))
        return out[0], out[1]

    def pop(self, bucket: int, back: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The next entries of the bucket in order of arrival, at most a chunk; with back the last ones. None if it is empty."""
        segments, held = self.spilled.get(bucket), self.held.get(bucket)
        if held and (back or not segments):
            size, k = 0, 0
            while k < len(held) and (not k or size + len(held[-1 - k if back else k][0]) <= self.chunk):
                size += len(held[-1 - k if back else k][0])
                k += 1
            parts = held[-k:] if back else held[:k]
            self.bytes -= sum(a.nbytes + b.nbytes + 128 for a, b in parts)
            if k == len(held):
                del self.held[bucket]
            else:
                del held[-k if back else 0 : None if back else k]
            return parts[0] if k == 1 else (np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
        if not segments:
            return None
        k = -1 if back else self.heads.get(bucket, 0)
        first, n = segments[0][k], segments[1][k]
        take = min(n, self.chunk)
        if take < n:
            segments[1][k] -= take
            segments[0][k] += 0 if back else take
        elif back:
            segments[0].pop()
            segments[1].pop()
        else:
            self.heads[bucket] = k + 1
        if len(segments[0]) == self.heads.get(bucket, 0):
            del self.spilled[bucket]
            self.heads.pop(bucket, None)
        return self._read(first + n - take if back else first, take)

    def all(self, bucket: int) -> np.ndarray:
        """All suffixes of the bucket in order of arrival; for buckets that are made small enough."""
        parts = []
        while (got := self.pop(bucket)) is not None:
            parts.append(got[0])
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def close(self) -> None:
        for f in self.files:
            f.close()
            os.unlink(f.name)


class _Sorter:
    """One level: `text` holds n symbols from 1 up, then zeros that stand for the end, below all symbols."""

    def __init__(self, text: np.ndarray, n: int, cap: int, disk: Disk, base: int):
        self.text, self.n, self.cap, self.disk, self.base = np.asarray(text), n, cap, disk, base
        self.width = np.uint8 if cap < 256 else np.int32
        self.spills, self.levels = 0, 1
        self.top = max((int(text[a : min(n, a + disk.chunk * 8)].max()) for a in range(0, n, disk.chunk * 8)), default=0)

    # -- types and starred suffixes

    def _typed(self) -> tuple[np.ndarray, np.ndarray]:
        """(is S of each suffix, starred suffixes in falling order), from the text's end to its beginning by chunks."""
        n, t, disk = self.n, self.text, self.disk
        kinds, found, count = disk.array(n, np.bool_), disk.path(), 0
        after = False
        with open(found, "wb") as out:
            for b in range(n, 0, -disk.chunk):
                a = max(0, b - disk.chunk)
                part = np.asarray(t[a : b + 1]).astype(np.int64)
                step = np.flatnonzero(part[:-1] != part[1:])
                kind = np.full(b - a + 1, after)
                if len(step):
                    kind[: step[-1] + 1] = np.repeat(part[step] < part[step + 1], np.diff(np.r_[-1, step]))
                kinds[a:b] = kind[:-1]
                star = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1 + a
                star = star[star < n][::-1]
                out.write(star.astype(np.int64).tobytes())
                count += len(star)
                after = bool(kind[0])
        stars = np.memmap(found, dtype=np.int64, mode="r+", shape=(count,)) if count else np.empty(0, np.int64)
        if not count:
            os.unlink(found)
        return kinds, stars

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes a[k] and b[k] share, up to the cap; four at a time where a symbol has two bytes."""
        out = np.full(len(a), self.cap, dtype=np.int64)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        if self.text.dtype == np.uint16:
            words = np.ndarray((len(self.text) - 3,), dtype="<u8", buffer=self.text, strides=(2,))
            for k in range(0, self.cap, 4):
                differ = words[a + k] ^ words[b + k]
                end = differ != 0
                low = differ[end]
                low &= ~low + np.uint64(1)
                out[live[end]] = np.minimum(k + (np.frexp(low.astype(np.float64))[1] - 1) // 16, self.cap)
                live, a, b = live[~end], a[~end], b[~end]
                if not len(live):
                    break
        else:
            for k in range(self.cap):
                end = self.text[a + k] != self.text[b + k]
                out[live[end]] = k
                live, a, b = live[~end], a[~end], b[~end]
                if not len(live):
                    break
        return out.astype(self.width)

    def _starred_order(self) -> np.ndarray:
        """The starred suffixes, sorted: named by substring, then by recursion where names repeat."""
        disk = self.disk
        kinds, falling = self._typed()
        m = len(falling)
        stars = falling[::-1]
        names, repeat = self._named(kinds, stars)
        out = disk.array(m, np.int64)
        if not repeat:
            for a in range(0, m, disk.chunk):
                out[np.asarray(names[a : a + disk.chunk])] = stars[a : a + disk.chunk]
        elif m <= self.base:
            out[_double(np.array(names))] = stars
        else:
            reduced = disk.array(m + 8, np.int64)
            for a in range(0, m, disk.chunk):
                reduced[a : min(m, a + disk.chunk)] = names[a : a + disk.chunk] + 1
            deeper, end = _Sorter(reduced, m, 0, disk, self.base), m
            for part in deeper.ordered():
                out[end - len(part) : end] = stars[part[::-1]]
                end -= len(part)
            self.levels, self.spills = 1 + deeper.levels, self.spills + deeper.spills
            disk.drop(reduced)
        disk.drop(kinds, names, falling)
        return out

    def _named(self, kinds: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, bool]:
        """(for each starred suffix how many have a smaller substring, whether some are equal).

        Substrings reach to the next starred suffix. Rounds of sorted runs order those still alike by some more symbols.
        """
        disk, n, m = self.disk, self.n, len(stars)
        names = disk.array(m, np.int64)
        bits, name_bits = (2 * self.top + 2).bit_length(), max(1, m.bit_length())
        active: np.ndarray | None = None  # all
        done, repeat, first = 0, False, True
        while first or active is not None:
            each = max(1, (63 - (0 if first else name_bits)) // bits)
            runs = RunSort(disk)
            for a in range(0, m if first else len(active), disk.chunk):
                k = np.arange(a, min(m, a + disk.chunk)) if first else np.asarray(active[a : a + disk.chunk])
                at = np.asarray(stars[k])
                end = np.where(k + 1 < m, stars[np.minimum(k + 1, m - 1)] + 1, n)
                key = np.zeros(len(k), dtype=np.uint64) if first else np.asarray(names[k]).astype(np.uint64)
                for x in range(done, done + each):
                    inside = at + x < end
                    p = np.where(inside, at + x, 0)
                    code = np.where(inside, 2 * self.text[p].astype(np.int64) + kinds[p] + 1, 0)
                    key = (key << np.uint64(bits)) | code.astype(np.uint64)
                runs.add(key, k)
            more, count = disk.path(), 0
            low = np.uint64((1 << bits) - 1)
            shift = np.uint64(bits * each)
            seen, group_start, name_start, last, held = 0, 0, 0, None, None
            with open(more, "wb") as out:
                for key, k in runs.chunks():
                    fresh = np.r_[last is None or key[0] != last, key[1:] != key[:-1]]
                    old = np.r_[last is None or (key[0] >> shift) != (last >> shift), (key[1:] >> shift) != (key[:-1] >> shift)] if not first else np.r_[last is None, np.zeros(len(key) - 1, bool)]
                    place = np.arange(seen, seen + len(key))
                    start = np.maximum.accumulate(np.where(fresh, place, group_start))
                    name_first = np.maximum.accumulate(np.where(old, place, name_start))
                    base = np.zeros(len(key), dtype=np.int64) if first else (key >> shift).astype(np.int64)
                    names[k] = base + start - name_first
                    # Alike with a neighbour and not yet at the end: another round.
                    if held is not None and (held[1] or not fresh[0]) and held[2]:
                        out.write(np.int64(held[0]).tobytes())
                        count += 1
                    open_ = (key & low) != 0
                    alike = ~fresh | np.r_[~fresh[1:], False]
                    repeat |= bool((~fresh & ~open_).any())
                    go = k[:-1][(alike & open_)[:-1]]
                    out.write(go.astype(np.int64).tobytes())
                    count += len(go)
                    held = int(k[-1]), bool(alike[-1]), bool(open_[-1])
                    seen, group_start, name_start, last = seen + len(key), int(start[-1]), int(name_first[-1]), key[-1]
                if held is not None and held[1] and held[2]:
                    out.write(np.int64(held[0]).tobytes())
                    count += 1
            if active is not None:
                disk.drop(active)
            active = np.memmap(more, dtype=np.int64, mode="r+", shape=(count,)) if count else None
            if not count:
                os.unlink(more)
            done, first = done + each, False
        return names, repeat

    # -- many symbols: positions only

    def ordered(self) -> Iterator[np.ndarray]:
        """All suffixes from the greatest down, in chunks, by buckets of ranges of symbols."""
        if not self.n:
            return
        stars = self._starred_order()
        n, disk = self.n, self.disk
        ranges = int(min(self.top, max(1, n * ENTRY_BYTES * 2 // disk.budget)))
        span = -(-(self.top + 1) // ranges)
        queue, done = BucketQueue(disk, np.uint8), BucketQueue(disk, np.uint8)
        try:
            up = _Wave(self, queue, span, False)
            up.push(np.array([n], dtype=np.int64))
            at = 0
            for r in range(ranges):
                end = at
                while end < len(stars) and self.text[stars[min(end + disk.chunk, len(stars)) - 1]] // span <= r:
                    end = min(end + disk.chunk, len(stars))
                tail = np.asarray(stars[end : end + disk.chunk])
                end += int(np.searchsorted(self.text[tail] // span, r, side="right")) if len(tail) else 0
                for dynamic, _ in up.range(queue.all(r), np.asarray(stars[at:end])):
                    if len(dynamic):
                        done.push(r, dynamic.copy(), np.zeros(len(dynamic), np.uint8))
                at = end
            down = _Wave(self, queue, span, True)
            for r in range(ranges - 1, -1, -1):
                for _, both in down.range(queue.all(r), done.all(r)[::-1]):
                    yield both
        finally:
            self.spills += queue.spills + done.spills
            queue.close()
            done.close()
            disk.drop(stars)

    # -- few symbols: positions and common prefixes

    def tracked(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffixes, common prefix with the one before) from the greatest down, in chunks."""
        if not self.n:
            return
        stars = self._starred_order()
        n, t, disk = self.n, self.text, self.disk
        queue, done = BucketQueue(disk, self.width), BucketQueue(disk, self.width)
        try:
            up, at = _Pass(self, queue, False), 0
            up.source(np.array([n], dtype=np.int64), np.zeros(1, dtype=self.width))
            for c in range(1, self.top + 1):
                last = None
                while (got := queue.pop(c)) is not None:
                    done.push(c, *got)
                    up.source(*got)
                    last = got[0][-1:]
                while at < len(stars):
                    part = np.asarray(stars[at : at + disk.chunk])
                    part = part[: int(np.searchsorted(t[part], c, side="right"))]
                    if not len(part):
                        break
                    before = np.r_[last if last is not None else part[:1], part[:-1]]
                    shared = self.prefix(before, part)
                    if last is None:
                        shared[0] = 0
                    up.source(part, shared)
                    last, at = part[-1:], at + len(part)
            # L suffixes are read back as sources of the S suffixes.
            down = _Pass(self, queue, True)
            for c in range(self.top, 0, -1):
                last = None
                while (got := queue.pop(c)) is not None:
                    down.source(*got)
                    yield got
                    last = got[0][-1:]
                above = None
                while (got := done.pop(c, back=True)) is not None:
                    lower, shared = got
                    back = np.empty(len(lower), dtype=self.width)
                    back[1:] = shared[1:][::-1]
                    back[0] = above if above is not None else self.prefix(lower[-1:], last)[0] if last is not None else 0
                    above = shared[0]
                    lower = lower[::-1]
                    down.source(lower, back, own=False)
                    yield lower, back
        finally:
            self.spills += queue.spills + done.spills
            queue.close()
            done.close()
            disk.drop(stars)


class _Pass:
    """One direction of induction: sources arrive in sorted order; their predecessors of the wanted type join its buckets."""

    def __init__(self, sorter: _Sorter, queue: BucketQueue, want_s: bool):
        self.sorter, self.queue, self.want_s = sorter, queue, want_s
        self.since = np.full(sorter.top + 1, sorter.cap, dtype=sorter.width)  # least common prefix since a bucket's last arrival
        self.fresh = np.ones(sorter.top + 1, dtype=bool)

    def source(self, suffixes: np.ndarray, shared: np.ndarray, own: bool = True) -> None:
        s = self.sorter
        index, symbol = _induced(s.text, suffixes, self.want_s, own)
        tail = np.minimum.accumulate(shared[::-1])[::-1]
        if not len(index):
            np.minimum(self.since, tail[0], out=self.since)
            return
        order = np.argsort(symbol.astype(np.uint16) if s.top < 1 << 16 else symbol, kind="stable")  # two bytes go by radix
        index, symbol = index[order], symbol[order]
        first = np.r_[True, symbol[1:] != symbol[:-1]]
        low = np.where(first, 0, np.r_[0, index[:-1] + 1])
        least = _range_minima(shared, low, index)
        heads = symbol[first]
        least[first] = np.minimum(least[first], self.since[heads])
        made = (np.minimum(least.astype(np.int64), s.cap - 1) + 1).astype(s.width)
        made[np.flatnonzero(first)[self.fresh[heads]]] = 0
        self.fresh[heads] = False
        np.minimum(self.since, tail[0], out=self.since)
        last = index[np.r_[first[1:], True]]
        self.since[heads] = np.where(last + 1 < len(shared), tail[np.minimum(last + 1, len(shared) - 1)], s.cap)
        self.queue.deal(symbol, suffixes[index] - 1, made)


def _induced(text: np.ndarray, suffixes: np.ndarray, want_s: bool, own: bool | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the sources have a predecessor of the wanted type, its symbol).

    A suffix before an equal symbol has the type of that; own tells which sources are of the wanted type. Starred suffixes
    follow a greater symbol, so on the way up equal ones may pass.
    """
    before = suffixes - 1
    index = np.flatnonzero(before >= 0)
    mine = text[suffixes[index]].astype(np.int64)
    symbol = text[before[index]].astype(np.int64)
    ok = (symbol < mine if want_s else symbol > mine) | ((symbol == mine) & (own if isinstance(own, bool) else own[index]))
    return index[ok], symbol[ok]


class _Wave:
    """One direction over a text of many symbols: ranges of symbols that do not induce into one another go at once.

    Keys are symbols on the way up, and symbols counted from the top on the way down.
    """

    def __init__(self, sorter: _Sorter, queue: BucketQueue, span: int, want_s: bool):
        self.sorter, self.queue, self.span, self.want_s = sorter, queue, span, want_s
        self.at_once = 64

    def _key(self, symbols: np.ndarray) -> np.ndarray:
        return self.sorter.top - symbols if self.want_s else symbols

    def _made(self, suffixes: np.ndarray, own: bool | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(predecessors of the wanted type in order of their sources, their keys)."""
        index, symbol = _induced(self.sorter.text, suffixes, self.want_s, own)
        return suffixes[index] - 1, self._key(symbol)

    def push(self, suffixes: np.ndarray) -> None:
        self._send(*self._made(suffixes, True))

    def _send(self, made: np.ndarray, key: np.ndarray) -> None:
        bucket = (self.sorter.top - key if self.want_s else key) // self.span
        order = np.argsort(bucket, kind="stable")
        self.queue.deal(bucket[order], made[order], np.zeros(len(made), np.uint8))

    def range(self, arrived: np.ndarray, fixed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(arrived entries, all entries) of one bucket in order: per symbol those that arrive, then the fixed ones."""
        if not len(arrived) and not len(fixed):
            return
        text = self.sorter.text
        keyed = lambda s: self._key(text[s].astype(np.int64))
        key = keyed(arrived)
        order = np.argsort(key, kind="stable")
        arrived, key, fixed_key = arrived[order], key[order], keyed(fixed)
        bucket = int(text[(arrived if len(arrived) else fixed)[0]]) // self.span
        last = self._key(bucket * self.span) if self.want_s else (bucket + 1) * self.span - 1  # the bucket's last key
        a = f = 0
        while a < len(arrived) or f < len(fixed):
            w = self.at_once
            now = int(min([*key[a : a + 1], *fixed_key[f : f + 1]]))
            end = int(min([*key[a + w : a + w + 1], *fixed_key[f + w : f + w + 1], last + 1]))
            end = max(end, now + 1)
            b, g = int(np.searchsorted(key, end)), int(np.searchsorted(fixed_key, end))
            mine = arrived[a:b]
            order = np.argsort(np.concatenate([key[a:b], fixed_key[f:g]]), kind="stable")
            both = np.concatenate([mine, fixed[f:g]])[order]
            made, made_key = self._made(both, order < b - a)
            cut = int(made_key.min()) if len(made) else end
            if now < cut < end:
                # Below the least key that is induced all entries are known: those go, the others wait for what joins them.
                end = cut
                b, g = int(np.searchsorted(key, end)), int(np.searchsorted(fixed_key, end))
                mine = arrived[a:b]
                order = np.argsort(np.concatenate([key[a:b], fixed_key[f:g]]), kind="stable")
                both = np.concatenate([mine, fixed[f:g]])[order]
                made, made_key = self._made(both, order < b - a)
                self.at_once = max(8, 2 * max(b - a, g - f))
            elif cut == now:
                end = now + 1
                b, g = int(np.searchsorted(key, end)), int(np.searchsorted(fixed_key, end))
                mine = arrived[a:b]
                # One symbol that induces into itself: entries arrive in waves, before the fixed ones.
                waves, more = [], mine
                while len(more):
                    waves.append(more)
                    made, made_key = self._made(more, True)
                    inner = made_key < end
                    arrived, key = self._late(arrived, key, made[~inner], made_key[~inner], last)
                    more = made[inner]
                mine = np.concatenate(waves) if waves else mine
                made, made_key = self._made(fixed[f:g], False)
                both = np.concatenate([mine, fixed[f:g]])
            else:
                self.at_once = min(2 * w, self.sorter.disk.chunk)
            arrived, key = self._late(arrived, key, made, made_key, last)
            yield mine, both
            a, f = b, g

    def _late(self, arrived: np.ndarray, key: np.ndarray, made: np.ndarray, made_key: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries for this bucket go behind those of their symbol, others to their buckets."""
        here = made_key <= last
        if not here.all():
            self._send(made[~here], made_key[~here])
        if not here.any():
            return arrived, key
        order = np.argsort(made_key[here], kind="stable")
        made, made_key = made[here][order], made_key[here][order]
        at = np.searchsorted(key, made_key, side="right")
        return np.insert(arrived, at, made), np.insert(key, at, made_key)


def _range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low[k] .. high[k]]) for each k, by a table of minima over powers of two."""
    width = high - low + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), dtype=values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table[:0]
    return out


def _ranks(keys: np.ndarray) -> np.ndarray:
    """For each key, how many keys are smaller."""
    order = np.argsort(keys)
    ordered = keys[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.repeat(starts, np.diff(np.r_[starts, len(keys)]))
    return out


def _refined(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks of whole groups of equal rank, told apart by key: a group's rank plus its smaller keys."""
    order = np.lexsort((key, rank))
    r, k = rank[order], key[order]
    group = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    part = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])])
    base = np.repeat(group, np.diff(np.r_[group, len(r)]))
    out = np.empty(len(rank), dtype=np.int64)
    out[order] = r - base + np.repeat(part, np.diff(np.r_[part, len(r)]))
    return out


def _double(rank: np.ndarray) -> np.ndarray:
    """Suffix ranks of a sequence of ranks, by prefix doubling over the groups that are not yet told apart."""
    m, step = len(rank), 1
    while True:
        sub = np.flatnonzero(np.bincount(rank, minlength=m)[rank] > 1)
        if not len(sub):
            return rank
        ahead = sub + step
        rank[sub] = _refined(rank[sub], np.where(ahead < m, rank[np.minimum(ahead, m - 1)], -1))
        step *= 2


def sorted_suffixes(pieces: np.ndarray | Iterable[np.ndarray], cap: int, scratch: str | None = None, budget: int = BUDGET, base: int = BASE, report: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of a text from the greatest down, in chunks, with the prefix each shares with the one before it, up to cap.

    The text comes as an array of whole numbers from 0 up, or as pieces of one, which go to disk as they come. A suffix
    that ends is smaller than one that goes on. Memory follows the budget, not the text. report, if given, receives the
    number of levels of the recursion and of spills.
    """
    with tempfile.TemporaryDirectory(dir=scratch) as folder:
        disk, path, n, wide = Disk(folder, budget), os.path.join(folder, "text"), 0, False
        with open(path, "wb") as out:
            for piece in [pieces] if isinstance(pieces, np.ndarray) else pieces:
                piece = piece.reshape(-1)
                for a in range(0, len(piece), 8 * disk.chunk):
                    part = piece[a : a + 8 * disk.chunk].astype(np.int64) + 1
                    wide |= len(part) > 0 and int(part.max()) >= 1 << 16
                    out.write((part.astype(np.int64) if wide else part.astype(np.uint16)).tobytes())
                    if wide and n:
                        raise ValueError("symbols beyond 65,534 must be met in the first piece")
                    n += len(part)
            out.write(bytes((cap + 8) * (8 if wide else 2)))
        text = np.memmap(path, dtype=np.int64 if wide else np.uint16, mode="r+")
        sorter = _Sorter(text, n, cap, disk, base)
        yield from sorter.tracked()
        if report is not None:
            report.update(levels=sorter.levels, spills=sorter.spills)
