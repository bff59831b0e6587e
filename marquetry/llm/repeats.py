"""Suffix-array dedup: remove bytes that a long string repeats from a smaller document.

Shards are suffix-sorted by external induction (`suffixes`): text, suffixes and queues on disk. A shard must hold every
copy of the strings it judges, so texts are dealt by content. A window of `length` bytes holds GRAM-byte grams at length - GRAM + 1 places; the one of
least hash is its anchor, the same for equal windows wherever they stand. Every window lies in the context of its
anchor: the bytes from length - GRAM before the anchor to length after its start. All contexts of one gram meet in
one shard. Grams of one text only are found first, by hashes alone, and send no context. Equal contexts of a group of
texts go as one, that of the least document.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import materialize, release
from marquetry.llm.suffixes import BUDGET, Disk, RunSort, sorted_suffixes

LENGTH = 50
GRAM = 16
#: Text bytes that one group of texts and one shard of grams stand for, and bounds on the shards (and so on what a batch sends).
SHARD_BYTES = 8 << 20
MIN_SHARDS, MAX_SHARDS = 48, 4096
#: Text bytes whose grams or contexts are sent together, and window starts that are hashed at a time.
BATCH_BYTES = 16 << 20
CHUNK = 1 << 18
#: Contexts of a shard that are judged at once (about 150 bytes each in memory; their text and its suffixes are on disk);
#: more are dealt to files, FAN at a time, and judged in parts of a quarter of that.
PART_ROWS = 3 << 16
FAN = 32
#: Contexts of a gram from which on they go to shards by the bytes beside the gram as well.
HOT_CONTEXTS = 1 << 15
#: Bytes of digests up to which the list of repeated texts is broadcast.
MAX_BROADCAST_BYTES = 16 << 20
#: Stands for a null key inside: not smaller than any other.
NO_DOC = int(np.iinfo(np.int64).max)
#: Stands for more than one text.
SEVERAL = np.uint64((1 << 64) - 1)

#: Rows that are copied at a time, and ranges of windows that are told apart by their common bytes.
ROWS, PARTS = 1 << 14, 4

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(body: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    sizes = np.frombuffer(raw, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


def _gram_hashes(buffer: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place."""
    n = len(buffer) - GRAM + 1
    words = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=np.ascontiguousarray(buffer), strides=(1,))
    h = words[:n] * _M1
    more = h >> np.uint64(29)
    h ^= more
    h ^= words[8 : 8 + n]
    h *= _M2
    np.right_shift(h, np.uint64(32), out=more)
    h ^= more
    return h


def _sliding(reduce: np.ufunc, values: np.ndarray, span: int) -> np.ndarray:
    step = 1
    while step * 2 <= span:
        values = reduce(values[:-step], values[step:])
        step *= 2
    return reduce(values[: -(span - step)], values[span - step :]) if span > step else values


def anchors(buffer: np.ndarray, lengths: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of the anchors of all windows that lie within one of the texts joined in buffer.

    Where grams of one window tie in 32 bits of their hashes, all are anchors, so the choice rests on content alone.
    """
    span = length - GRAM + 1
    ends = np.cumsum(lengths)
    places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for lo in range(0, len(buffer) - length + 1, CHUNK):  # windows that start in a chunk; its bytes reach over its end
        part = buffer[lo : lo + CHUNK + length - 1]
        h = _gram_hashes(part)
        short = np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))  # 0 marks windows without an anchor
        least = _sliding(np.minimum, short, span)
        # Windows that reach over a text's end have no anchor; 0 is below all others and so never the greatest of the least.
        a, b = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, lo + len(part), side="left")
        for end in (ends[a:b] - lo).tolist():
            least[max(0, end - length + 1) : end] = 0
        padded = np.zeros(len(least) + 2 * (span - 1), dtype=np.uint32)
        padded[span - 1 : span - 1 + len(least)] = least
        place = np.flatnonzero(_sliding(np.maximum, padded, span) == short)
        places.append(place + lo)
        hashes.append(h[place])
    place, first = np.unique(np.concatenate(places), return_index=True)  # neighbouring chunks share places
    return place, np.concatenate(hashes)[first]


def _batches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], dtype=np.int64)


def _sorted_group(pdf: pd.DataFrame) -> tuple[np.ndarray, list[str], list[bytes]]:
    """Distinct texts of a group in order: both stages that read the group number them alike."""
    pdf = pdf.drop_duplicates("digest").sort_values(["doc", "digest"])
    return pdf["doc"].to_numpy(), pdf["digest"].tolist(), [t.encode("utf-8", "replace") for t in pdf["text"]]


def _row_keys(rows: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(padded rows, 64-bit hash of each row of bytes)."""
    m, width = rows.shape
    words = np.zeros((m, -(-(width + len(more)) // 8) * 8), dtype=np.uint8)
    words[:, :width] = rows
    for k, column in enumerate(more):
        words[:, width + k] = column
    keys = np.zeros(m, dtype=np.uint64)
    for column in words.view("<u8").T:
        keys = (keys ^ column) * _M1
        keys ^= keys >> np.uint64(31)
    return words, keys


def _with_kin(contexts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of each context, all different, may belong to a window that another holds too: (first, end), equal for none.

    Windows are taken by where they start before the anchor, in PARTS ranges. All windows of a range hold its core: the
    bytes from the range's nearest start to its farthest start's end. Only ranges whose core another context holds count.
    """
    edges = np.linspace(0, length - GRAM + 1, PARTS + 1).astype(np.int64)
    near, far = np.full(len(contexts), length), np.full(len(contexts), -1)
    for lo, hi in zip(edges[:-1].tolist(), (edges[1:] - 1).tolist(), strict=True):
        at = np.flatnonzero((offsets >= lo) & (sizes - offsets >= length - hi))
        if hi < lo or not len(at):
            continue
        keys = np.empty(len(at), dtype=np.uint64)
        for k in range(0, len(at), ROWS):
            part = at[k : k + ROWS]
            place = (offsets[part] - lo)[:, None] + np.arange(length - hi + lo)
            keys[k : k + ROWS] = _row_keys(np.take_along_axis(contexts[part], place, axis=1))[1]
        order = np.argsort(keys)
        same = np.r_[False, keys[order][1:] == keys[order][:-1]]
        kin = at[order[same | np.r_[same[1:], False]]]
        near[kin], far[kin] = np.minimum(near[kin], lo), np.maximum(far[kin], hi)
    first = np.where(far < 0, 0, np.maximum(offsets - far, 0))
    return first, np.where(far < 0, 0, np.minimum(offsets - near + length, sizes))


class _Runs:
    """Marks the windows of each run that belong to documents beyond the run's least; runs come in chunks and may go on."""

    def __init__(self, docs: np.ndarray, folder: str | None):
        self.docs, self.folder, self.mask = docs, folder, np.zeros(len(docs), dtype=np.uint64)
        self.least, self.open, self.size = None, [], 0
        self.spool = None

    def _mark(self, row: np.ndarray, start: np.ndarray, least: np.ndarray | int) -> None:
        hit = self.docs[row] > least
        np.bitwise_or.at(self.mask, row[hit], np.uint64(1) << start[hit].astype(np.uint64))

    def _keep(self, row: np.ndarray, start: np.ndarray) -> None:
        """Hold part of the open run; much of it goes to a file."""
        self.open.append((row, start))
        self.size += len(row)
        least = int(self.docs[row].min())
        self.least = least if self.least is None else min(self.least, least)
        if self.size > ROWS:
            if self.spool is None:
                self.spool = tempfile.TemporaryFile(dir=self.folder)
            for r, s in self.open:
                np.stack([r, s]).T.astype(np.int64).tofile(self.spool)
            self.open, self.size = [], 0

    def close(self) -> None:
        """The open run ends."""
        if self.spool is not None:
            self.spool.seek(0)
            while len(got := np.fromfile(self.spool, np.int64, 2 * ROWS).reshape(-1, 2)):
                self._mark(got[:, 0], got[:, 1], self.least)
            self.spool.close()
        for row, start in self.open:
            self._mark(row, start, self.least)
        self.least, self.open, self.size, self.spool = None, [], 0, None

    def add(self, row: np.ndarray, start: np.ndarray, joins: np.ndarray) -> None:
        """Windows in order; joins tells which belong to the run of the one before."""
        begins = np.flatnonzero(~joins)
        if not len(begins):
            if len(row):
                self._keep(row, start)
            return
        if begins[0]:
            self._keep(row[: begins[0]], start[: begins[0]])
        self.close()
        a, b = begins[0], begins[-1]
        if b > a:
            inner = begins[:-1] - a
            least = np.repeat(np.minimum.reduceat(self.docs[row[a:b]], inner), np.diff(np.r_[inner, b - a]))
            self._mark(row[a:b], start[a:b], least)
        self._keep(row[b:], start[b:])


def repeated_starts(docs: np.ndarray, contexts: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, length: int = LENGTH, scratch: str | None = None, budget: int = BUDGET) -> np.ndarray:
    """For each context, a bit for each start of a window that also starts in the context of a smaller document.

    contexts: one row of bytes each, of which sizes[k] count, with the anchor at offsets[k]. Equal contexts stand for their
    least document; the others of the group repeat all their windows. Those left that may share a window with another
    are suffix-sorted: runs of suffixes that share `length` bytes hold equal windows.
    """
    m, width = contexts.shape
    keys = np.empty(m, dtype=np.uint64)
    for k in range(0, m, ROWS):
        keys[k : k + ROWS] = _row_keys(contexts[k : k + ROWS], sizes[k : k + ROWS])[1]
    order = np.lexsort((docs, keys))
    first = np.r_[True, keys[order][1:] != keys[order][:-1]]
    head = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    other = np.zeros(m, dtype=bool)  # unequal texts of one hash stand for themselves
    for k in range(0, m, ROWS):
        a, b = order[k : k + ROWS], head[k : k + ROWS]
        other[k : k + ROWS] = (contexts[a] != contexts[b]).any(axis=1) | (sizes[a] != sizes[b])
    first[other], head[other] = True, order[other]
    every = (np.uint64(1) << np.maximum(sizes - length + 1, 0).astype(np.uint64)) - np.uint64(1)
    out = np.zeros(m, dtype=np.uint64)
    later = docs[order] > docs[head]
    out[order[later]] = every[order[later]]

    heads = order[first]
    left, right = _with_kin(contexts[heads], sizes[heads], offsets[heads], length)
    some = np.flatnonzero(right - left >= length)
    kin, left, right = heads[some], left[some], right[some]
    column = np.arange(width)
    begins = np.cumsum(right - left + 1) - (right - left + 1)  # where each piece stands in the text

    def pieces() -> Iterator[np.ndarray]:
        for k in range(0, len(kin), ROWS):
            part, lo, hi = kin[k : k + ROWS], left[k : k + ROWS, None], right[k : k + ROWS, None]
            text = np.zeros((len(part), width + 1), dtype=np.uint16)
            text[:, :width] = contexts[part]
            text[:, :width] += 1
            text[:, :width][column >= hi] = 0
            yield text[(np.arange(width + 1) >= lo) & (np.arange(width + 1) <= hi)]  # each ends with a zero

    runs = _Runs(docs[kin], scratch)
    for at, shared in sorted_suffixes(pieces(), length, scratch, budget):
        joins = shared >= length
        use = joins | np.r_[joins[1:], True]  # the last may be joined by the next chunk
        at, joins = at[use], joins[use]
        row = np.searchsorted(begins, at, side="right") - 1
        start = at - begins[row] + left[row]
        whole = start + length <= right[row]  # of a run all or none
        runs.add(row[whole], start[whole], joins[whole])
    runs.close()
    mask = np.zeros(m, dtype=np.uint64)
    mask[kin] = runs.mask
    of = np.empty(m, dtype=np.int64)
    of[order] = head
    same = docs == docs[of]
    out[same] = mask[of[same]]
    return out


def _context_type(width: int) -> np.dtype:
    return np.dtype([("doc", "i8"), ("left", "i8"), ("number", "u4"), ("group", "i4"), ("size", "u1"), ("offset", "u1"), ("many", "u1"), ("context", "u1", (width,))])


class _Judge:
    """repeated_starts over a stream of contexts, of which at most `limit` and a chunk are in memory at a time.

    What exceeds the limit is dealt to files by the bytes that all windows of a range share: those that start lo to hi
    bytes before the anchor hold its `core`, from lo bytes before the anchor to length - hi after its start. The first
    range is all windows, with the gram as core. Equal windows meet in one file, as they stand alike to their anchors. A
    file that is still too large goes by another hash; if one core fills it, equal contexts collapse to their least
    document and the range is halved, until the core is the window itself and one pass of minima settles it.
    """

    def __init__(self, length: int, folder: str, budget: int, limit: int, fan: int = FAN):
        self.length, self.folder, self.budget, self.limit, self.fan = length, folder, budget, limit, fan
        self.type = _context_type(2 * length - GRAM)
        self.chunk = max(1, min(1 << 15, limit))
        self.files, self.most = 0, 0

    def rows(self, chunks: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(contexts, a bit for each window that a smaller document holds); a context may come more than once."""
        held, n = [], 0
        for part in chunks:
            held.append(part)
            n += len(part)
            if n > self.limit:
                self.limit = max(1, self.limit // 4)
                yield from self._dealt(itertools.chain(held, chunks), 0, self.length - GRAM)
                return
        if n:
            yield self._sorted(np.concatenate(held))

    def _sorted(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.most = max(self.most, len(rows))
        size, offset = rows["size"].astype(np.int64), rows["offset"].astype(np.int64)
        return rows, repeated_starts(rows["doc"], np.ascontiguousarray(rows["context"]), size, offset, self.length, self.folder, self.budget)

    def _path(self) -> str:
        self.files += 1
        return os.path.join(self.folder, f"contexts-{self.files}")

    def _read(self, path: str) -> Iterator[np.ndarray]:
        with open(path, "rb") as file:
            while len(rows := np.fromfile(file, self.type, self.chunk)):
                yield rows

    def _cores(self, rows: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """(padded cores, hashes) of rows that all hold a core of the range."""
        span = self.length - hi + lo
        first = rows["offset"].astype(np.int64) - lo
        return _row_keys(np.take_along_axis(rows["context"], first[:, None] + np.arange(span), axis=1))

    def _dealt(self, chunks: Iterator[np.ndarray], lo: int, hi: int, salt: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        paths, counts = [self._path() for _ in range(self.fan)], np.zeros(self.fan, dtype=np.int64)
        files = [open(p, "wb") for p in paths]
        try:
            for rows in chunks:
                offset = rows["offset"].astype(np.int64)
                rows = rows[(offset >= lo) & (rows["size"] - offset >= self.length - hi)]  # others have no window of the range
                key = (self._cores(rows, lo, hi)[1] ^ np.uint64(salt * int(_M2) & (1 << 64) - 1)) * _M1
                to = ((key >> np.uint64(40)) % np.uint64(self.fan)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cuts = np.searchsorted(to[order], np.arange(self.fan + 1))
                for k in np.flatnonzero(np.diff(cuts)).tolist():
                    rows[order[cuts[k] : cuts[k + 1]]].tofile(files[k])
                counts += np.diff(cuts)
        finally:
            for file in files:
                file.close()
        total = int(counts.sum())
        for path, n in zip(paths, counts.tolist(), strict=True):
            if 0 < n <= self.limit:
                yield self._sorted(np.fromfile(path, self.type))
            elif n > self.limit and 4 * n < 3 * total:
                yield from self._dealt(self._read(path), lo, hi, salt + 1)
            elif n > self.limit:
                rest = self._path()
                yield from self._least(path, rest, lo if lo == hi else None)
                left = os.path.getsize(rest) // self.type.itemsize
                if 0 < left <= self.limit:
                    yield self._sorted(np.fromfile(rest, self.type))
                elif left:
                    middle = (lo + hi) // 2
                    for a, b in [(lo, hi)] if lo == hi else [(lo, middle), (middle + 1, hi)]:
                        yield from self._dealt(self._read(rest), a, b, salt + 1)
                os.unlink(rest)
            os.unlink(path)

    def _least(self, path: str, rest: str, back: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Settle by minima the rows of larger documents whose context, or window `back` before the anchor, is in a table.

        The table takes the first `limit` different ones. What it does not settle goes to the file rest: rows beside
        the table, and for contexts also those of the least document.
        """

        def keyed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return _row_keys(rows["context"], rows["size"]) if back is None else self._cores(rows, back, back)

        keys = np.empty(0, np.uint64)
        body, least = None, np.empty(0, np.int64)

        def found(words: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return at, (keys[at] == key) & (body[at] == words).all(axis=1)

        for rows in self._read(path):
            words, key = keyed(rows)
            if len(keys) < self.limit:
                fresh, first = np.unique(key, return_index=True)
                first = first[~np.isin(fresh, keys)][: self.limit - len(keys)]
                every = np.concatenate([keys, key[first]])
                order = np.argsort(every)
                keys = every[order]
                body = (words[first] if body is None else np.concatenate([body, words[first]]))[order]
                least = np.concatenate([least, np.full(len(first), NO_DOC)])[order]
            at, same = found(words, key)
            np.minimum.at(least, at[same], rows["doc"][same])
        with open(rest, "wb") as out:
            for rows in self._read(path):
                at, same = found(*keyed(rows))
                later = same & (rows["doc"] > least[at])
                rows[~later if back is None else ~same].tofile(out)
                if back is None:
                    windows = np.maximum(rows["size"][later].astype(np.int64) - self.length + 1, 0).astype(np.uint64)
                    mask = (np.uint64(1) << windows) - np.uint64(1)
                else:
                    mask = np.uint64(1) << (rows["offset"][later].astype(np.uint64) - np.uint64(back))
                if later.any():
                    yield rows[later], mask


def _rows_at(text: np.ndarray, left: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The `width` bytes of text from each place, zeros after the first size[k] of them."""
    out = np.empty((len(left), width), dtype=np.uint8)
    column = np.arange(width)
    for k in range(0, len(left), ROWS):  # an index takes eight times the bytes that it picks
        part = out[k : k + ROWS]
        part[:] = text[left[k : k + ROWS, None] + column]
        part[column >= size[k : k + ROWS, None]] = 0
    return out


def _kept(text: bytes, starts: np.ndarray, length: int) -> tuple[np.ndarray, int]:
    """(mask of removed bytes, number of removed runs)."""
    edge = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    removed = np.cumsum(edge)[:-1] > 0
    return removed, int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())


def _distinct_texts(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, digest, text): of each text the row of least doc, once. Only digests of repeated texts are joined."""
    again = keys.groupBy("digest").agg(F.min("doc").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("digest", "least")
    again = materialize(again, "again")
    n = again.count()
    if not n:
        return rows
    first = keys.join(again, "digest").where("doc = least").groupBy("digest").agg(F.count("*").alias("firsts"))
    again = materialize(again.join(first, "digest"), "firsts")  # how often a text comes under its least key
    marked = rows.join(F.broadcast(again) if n * 96 <= MAX_BROADCAST_BYTES else again, "digest", "left").where("least is null or doc = least")
    if not again.where("firsts > 1").head(1):
        return marked.select("doc", "digest", "text")
    twice = marked.where("firsts > 1").groupBy("digest").agg(F.first("doc").alias("doc"), F.first("text").alias("text"))  # each task sends one row
    return marked.where("coalesce(firsts, 1) = 1").select("doc", "digest", "text").unionByName(twice)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, key_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, shard_bytes: int = SHARD_BYTES, budget: int = BUDGET, part_rows: int = PART_ROWS, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """Remove each byte covered by a `length`-byte string that also starts in a document of smaller key.

    One row per row of docs: key_col, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text also kept_text (the
    remaining bytes as text, broken characters left out) and digest (SHA-256 of the text). Strings are judged on the input;
    null texts count as empty and texts shorter than `length` lose nothing. A null key counts as larger than all others
    (but for the largest long, which counts alike); rows of equal key are not smaller than each other, so a repeated
    row keeps its text unless a smaller key holds it. An empty table gives an empty result; other columns of docs, whatever
    their names, are not looked at.

    Copies of a whole text are settled by digest, and only the least of them goes on. Hashes of grams are shipped first,
    then contexts of grams that two texts hold, compressed in blocks, equal ones of a group of texts as one; texts are dealt
    once, by digest, and that exchange serves both the cutting of contexts and the removal. A gram of more than
    hot_contexts contexts is cut in two by where windows start, and goes to shards by the bytes that all windows of a
    half share. A shard of more than part_rows contexts is dealt to files on disk and judged in parts. `length` must lie
    between GRAM + 1 and 63 + GRAM. Working files lie in the task's own temporary folder and end with the task.
    """
    spark = docs.sparkSession
    before = length - GRAM
    width = before + length
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(key_col).cast("long"), F.lit(NO_DOC)).alias("doc"), F.sha2(text, 256).alias("digest"), text.alias("text"))
    keys = materialize(rows.select("doc", "digest", F.octet_length("text").alias("bytes")), "keys")
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    shards = int(min(MAX_SHARDS, max(MIN_SHARDS, total // shard_bytes)))
    groups = int(max(MIN_SHARDS, total // shard_bytes))
    dealt = _distinct_texts(rows, keys).withColumn("q", F.pmod(F.xxhash64("digest"), F.lit(groups)).cast("int"))

    def send_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t.encode("utf-8", "replace") for t in batch.pop("text")]
            number, group = batch["number"].to_numpy(dtype=np.uint64), batch["q"].to_numpy(dtype=np.int64)
            for lo, hi in _batches(texts):
                buffer, lengths = _joined(texts[lo:hi])
                place, h = anchors(buffer, lengths, length)
                if not len(place):
                    continue
                owner = lo + np.searchsorted(np.cumsum(lengths), place, side="right")
                shard = ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
                h, to, d = h.astype(np.uint32), shard * groups + group[owner], number[owner]
                del buffer, place, owner, shard
                order = np.lexsort((h, to))
                h, to, d = h[order], to[order], d[order]
                del order
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (to[1:] != to[:-1])])
                both = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)  # two texts here already
                times = np.minimum(np.diff(np.r_[first, len(h)]), 65_535).astype(np.uint16)
                h, to, d = h[first], to[first], np.where(both, SEVERAL, d[first])
                cuts = np.searchsorted(to // groups, np.arange(shards + 1))
                found = [(s, _pack((to[a:b] % groups).astype(np.uint32), h[a:b], d[a:b], times[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pd.DataFrame(found, columns=["s", "body"])
                del h, to, d, times, first, both, found
                release()

    def find_shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each group of texts the grams of this shard that it shares with another text, by two sorts in runs."""
        with tempfile.TemporaryDirectory() as folder:
            disk, s = Disk(folder, 4 * budget), 0
            runs, held, kind = RunSort(disk), 0, np.dtype([("d", "u8"), ("times", "u2")])
            path = os.path.join(folder, "entries")
            with open(path, "wb") as file:
                for batch in batches:
                    for s, body in zip(batch["s"], batch["body"], strict=True):
                        group, h, d, times = _unpack(body, "u4", "u4", "u8", "u2")
                        # Sorted by gram; the value leads to the rest of the entry.
                        runs.add((h.astype(np.uint64) << np.uint64(32)) | group, np.arange(held, held + len(h)))
                        np.rec.fromarrays([d, times], dtype=kind).tofile(file)
                        held += len(h)
            entries = np.memmap(path, dtype=kind, mode="r") if held else np.empty(0, kind)
            by_group, rest = RunSort(disk), None
            for key, value in itertools.chain(runs.chunks(), [(None, None)]):
                if key is not None:
                    part = key, value
                    if rest is not None:
                        part = np.concatenate([rest[0], key]), np.concatenate([rest[1], value])
                    gram = part[0] >> np.uint64(32)
                    cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                    rest = part[0][cut:], part[1][cut:]
                    key, value = part[0][:cut], part[1][:cut]
                elif rest is not None:
                    key, value = rest
                if key is None or not len(key):
                    continue
                gram = key >> np.uint64(32)
                first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
                d = entries["d"][value]
                most = np.maximum.reduceat(d, first)
                live = (np.minimum.reduceat(d, first) != most) | (most == SEVERAL)
                hot = np.add.reduceat(entries["times"][value].astype(np.int64), first) > hot_contexts
                size = np.diff(np.r_[first, len(key)])
                live, hot = np.repeat(live, size), np.repeat(hot, size)
                by_group.add(((key[live] & np.uint64(0xFFFFFFFF)) << np.uint64(32)) | gram[live], hot[live].astype(np.int64))
            now, parts = None, []

            def message() -> tuple[int, int, bytes]:
                return int(now), int(s), _pack(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

            for key, hot in by_group.chunks():
                group = key >> np.uint64(32)
                starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
                out = []
                for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                    if parts and group[a] != now:
                        out.append(message())
                        parts = []
                    now = group[a]
                    parts.append((key[a:b].astype(np.uint32), hot[a:b].astype(np.uint8)))
                yield pd.DataFrame(out, columns=["q", "s", "body"])
            yield pd.DataFrame([message()] if parts else [], columns=["q", "s", "body"])
            del entries, runs, by_group, rest, parts
        release()

    half = before // 2

    def cut_contexts(texts: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        columns = ["s", "q", "settled", "body"]
        if not len(texts) or not len(shared):
            return pd.DataFrame(columns=columns)
        known = [(np.uint64(s) << np.uint64(32), *_unpack(b, "u4", "u1")) for s, b in zip(shared["s"], shared["body"], strict=True)]
        live = np.concatenate([s | h.astype(np.uint64) for s, h, _ in known])
        hot = np.concatenate([f for *_, f in known])
        order = np.argsort(live)
        live, hot = live[order], hot[order].astype(bool)
        doc, _, every = _sorted_group(texts)
        q, out = int(texts["q"].iloc[0]), []
        for lo, hi in _batches(every):
            buffer, lengths = _joined(every[lo:hi])
            place, h = anchors(buffer, lengths, length)
            shard = (h >> np.uint64(32)) % np.uint64(shards)
            key = (shard << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(live, key), len(live) - 1)
            keep = live[at] == key
            place, shard, crowded = place[keep], shard[keep].astype(np.int64), hot[at[keep]]
            if not len(place):
                continue
            ends = np.cumsum(lengths)
            padded = np.concatenate([buffer, np.zeros(width, np.uint8)])
            # Windows that start nearest to farthest bytes before the anchor: all of them, or two halves of a hot gram's.
            nearest, farthest = np.zeros(len(place), np.int64), np.full(len(place), before)
            if crowded.any():
                more = np.flatnonzero(crowded)
                farthest[more] = half
                place, shard, crowded = np.r_[place, place[more]], np.r_[shard, shard[more]], np.r_[crowded, crowded[more]]
                nearest, farthest = np.r_[nearest, np.full(len(more), half + 1)], np.r_[farthest, np.full(len(more), before)]
            owner = np.searchsorted(ends, place, side="right")
            begin = ends[owner] - lengths[owner]
            left = np.maximum(place - farthest, begin)
            size = np.minimum(place - nearest + length, ends[owner]) - left
            able = (size >= length) & (place - nearest >= begin)
            for lead, reach in ((0, half), (half + 1, before)):  # both halves go by the bytes that all their windows share
                k = np.flatnonzero(crowded & able & (nearest == lead))
                if len(k):
                    core = padded[(place[k] - lead)[:, None] + np.arange(lead + length - reach)]
                    shard[k] = (_row_keys(core)[1] >> np.uint64(32)).astype(np.int64) % shards
            place, shard, owner, begin, left, size = (x[able] for x in (place, shard, owner, begin, left, size))
            if not len(place):
                continue
            context = _rows_at(padded, left, size, width)
            # A context that a text holds more than once is sent once; the removal finds its other places.
            code = _row_keys(context, size, place - left)[1]
            own = doc[lo + owner]
            order = np.lexsort((left, owner, own, code, shard))
            equal = np.r_[False, (code[order][1:] == code[order][:-1]) & (shard[order][1:] == shard[order][:-1])]
            equal[1:] &= size[order][1:] == size[order][:-1]
            for k in range(0, len(order), ROWS):  # all but the first of a chunk's rows, which begins with the last of the one before
                near = context[order[max(0, k - 1) : k + ROWS]]
                equal[max(1, k) : k + ROWS] &= (near[1:] == near[:-1]).all(axis=1)
            same = equal & np.r_[False, owner[order][1:] == owner[order][:-1]]
            again = np.r_[same[1:], False]
            # Of equal contexts those of larger documents are settled: the least one's document holds all their windows.
            least = own[order][np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
            settled = own[order] > least
            pick, many, settled = order[~same], again[~same], settled[~same]
            for done in (False, True):
                mine, twice = pick[settled == done], many[settled == done]
                cuts = np.searchsorted(shard[mine], np.arange(shards + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[s], cuts[s + 1]
                    p = mine[a:b]
                    number, at, wide, often = (lo + owner[p]).astype(np.uint32), left[p] - begin[p], size[p].astype(np.uint8), twice[a:b].astype(np.uint8)
                    if done:
                        mask = (np.uint64(1) << (size[p] - length + 1).astype(np.uint64)) - np.uint64(1)
                        out.append((s, q, True, _pack(number, at, wide, often, mask)))
                    else:
                        out.append((s, q, False, _pack(own[p], number, at, wide, (place[p] - left[p]).astype(np.uint8), often, np.ascontiguousarray(context[p]))))
            del buffer, padded, context, place, shard, owner, begin, left, size, order
            release()
        return pd.DataFrame(out, columns=columns)

    kinds = ("i8", "u4", "i8", "u1", "u1", "u1", "u1")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: list[tuple[int, bytes]] = []  # settled before; passed on as they come

        def unpacked() -> Iterator[np.ndarray]:
            for batch in batches:
                for q, settled, body in zip(batch["q"], batch["settled"], batch["body"], strict=True):
                    if settled:
                        ready.append((int(q), body))
                        continue
                    doc, number, left, size, offset, many, context = _unpack(body, *kinds)
                    rows = np.empty(len(doc), dtype=_context_type(width))
                    rows["doc"], rows["number"], rows["left"], rows["size"], rows["offset"], rows["many"] = doc, number, left, size, offset, many
                    rows["group"], rows["context"] = q, context.reshape(-1, width)
                    yield rows

        with tempfile.TemporaryDirectory() as folder:
            for rows, mask in _Judge(length, folder, budget, part_rows).rows(unpacked()):
                hit = np.flatnonzero(mask)
                hit = hit[np.argsort(rows["group"][hit], kind="stable")]
                rows, mask = rows[hit], mask[hit]
                to = rows["group"]
                starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else []
                out = [(int(to[a]), _pack(*(rows[c][a:b] for c in ("number", "left", "size", "many")), mask[a:b])) for a, b in zip(starts, [*starts[1:], len(to)], strict=True)] if len(to) else []
                yield pd.DataFrame(ready + out, columns=["q", "body"])
                ready.clear()
                del rows, mask, to, out
                release()
        yield pd.DataFrame(ready, columns=["q", "body"])

    made = "doc long, digest string, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * keep_text

    def remove(texts: pd.DataFrame, hits: pd.DataFrame) -> pd.DataFrame:
        doc, digest, every = _sorted_group(texts) if len(texts) else (np.empty(0, np.int64), [], [])
        parts = [_unpack(b, "u4", "i8", "u1", "u1", "u8") for b in hits["body"]]
        number, left, size, many, mask = (np.concatenate([p[k] for p in parts]) for k in range(5)) if parts else [np.empty(0, np.int64)] * 5
        order = np.argsort(number, kind="stable")
        number, left, size, many, mask = number[order], left[order], size[order], many[order], mask[order]
        bounds = np.searchsorted(number, np.arange(len(every) + 1))
        bit = np.arange(64, dtype=np.uint64)
        out = []
        for k, text in enumerate(every):
            a, b = bounds[k], bounds[k + 1]
            row = [int(doc[k]), digest[k], len(text)]
            if a == b:
                out.append([*row, 0, 0, hashlib.sha256(text).hexdigest()] + [text.decode()] * keep_text)
                continue
            which, start = np.nonzero((mask[a:b, None] >> bit) & np.uint64(1))
            starts = [left[a:b][which] + start]
            for r in np.flatnonzero(many[a:b]):
                context = text[left[a + r] : left[a + r] + int(size[a + r])]
                bits = np.flatnonzero((mask[a + r] >> bit) & np.uint64(1))
                at, places = text.find(context), []
                while at >= 0:
                    places.append(at)
                    at = text.find(context, at + 1)
                starts.append((np.array(places)[:, None] + bits).reshape(-1))
            removed, spans = _kept(text, np.unique(np.concatenate(starts)), length)
            kept = np.frombuffer(text, np.uint8)[~removed].tobytes()
            out.append([*row, int(removed.sum()), spans, hashlib.sha256(kept).hexdigest()] + [kept.decode("utf-8", "ignore")] * keep_text)
        del texts, hits, every, parts, number, left, size, many, mask, order
        release()
        return pd.DataFrame(out, columns=[f.split()[0] for f in made.split(", ")])

    grams = dealt.withColumn("number", F.monotonically_increasing_id()).mapInPandas(send_grams, "s int, body binary")
    shared = grams.groupBy("s").applyInPandas(find_shared, "q int, s int, body binary")
    by_group = dealt.groupBy("q")
    contexts = by_group.cogroup(shared.groupBy("q")).applyInPandas(cut_contexts, "s int, q int, settled boolean, body binary")
    hits = contexts.groupBy("s").applyInPandas(judge, "q int, body binary")
    cut = materialize(by_group.cogroup(hits.groupBy("q")).applyInPandas(remove, made), "cut").withColumnRenamed("doc", "least")

    final = keys.join(cut, "digest")
    whole = (F.col("least") < F.col("doc")) & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return final.select(
        F.nullif("doc", F.lit(NO_DOC)).alias(key_col),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), "digest"] if keep_text else []),
    )
