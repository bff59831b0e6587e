"""SentencePiece encoding and decoding by suffix-array matching of all pieces against a batch's text."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquetry.llm.suffixes import _ranks, _refined

SPACE = "▁"
#: Characters of text per batch, bytes of new words that are indexed together, and words whose ids are remembered.
BATCH_CHARS = 2 << 20
INDEX_BYTES = 1 << 17
KNOWN_WORDS = 500_000
#: Words of more symbols keep their edges in a heap, others relax one each in rounds over all words: the same edges, the same order.
LONG = 192
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


@dataclass(frozen=True)
class Pieces:
    """A vocabulary: pieces by id, scores, kinds (n normal, b byte, u unknown, c control or unused) and the way to segment."""

    texts: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: str
    unknown: int
    unigram: bool = False
    dummy_prefix: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message's fields: whole numbers and byte strings; fixed-width values as bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, data[at : at + size]
        at += size


#: Fixed values of the model file: field numbers, and the kinds of models and pieces.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_MODELS = {1: "unigram", 2: "bpe", 3: "word", 4: "char"}
_KINDS = {1: "n", 2: "u", 3: "c", 4: "d", 5: "c", 6: "b"}


def load_pieces(path: str) -> Pieces:
    """Read a model file on the driver; the vocabulary then travels with the tasks.

    The file says how it segments (byte pairs or unigrams) and whether texts get a mark in front. Models that change the
    text in other ways, segment by words or characters or declare symbols of the user's are refused.
    """
    with open(path, "rb") as file:
        fields = list(_fields(file.read()))
    trainer = dict(kv for k, v in fields if k == _TRAINER for kv in _fields(v))
    normalizer = dict(kv for k, v in fields if k == _NORMALIZER for kv in _fields(v))
    pieces = [dict(_fields(v)) for k, v in fields if k == _PIECE]
    kinds = "".join(_KINDS[p.get(3, 1)] for p in pieces)
    model = _MODELS[trainer.get(3, 1)]
    refused = {
        f"model of kind {model}": model not in ("unigram", "bpe"),
        "character map": bool(normalizer.get(2)),
        "removal of spaces": bool(normalizer.get(4, 1)),
        "spaces that stay as they are": not normalizer.get(5, 1),
        "marks behind words": bool(trainer.get(24, 0)),
        "symbols of the user's": "d" in kinds,
    }
    if any(refused.values()):
        raise ValueError(f"{path}: not supported: {', '.join(k for k, bad in refused.items() if bad)}")
    scores = tuple(struct.unpack("<f", p.get(2, bytes(4)))[0] for p in pieces)
    return Pieces(tuple(p[1].decode() for p in pieces), scores, kinds, kinds.index("u"), model == "unigram", bool(normalizer.get(3, 1)))


class _Numbered(dict):
    """Numbers its keys in order of first use and lists those that are new."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number


class Codec:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        normal = [i for i, k in enumerate(pieces.kinds) if k == "n"]
        self.ids = {pieces.texts[i]: i for i in normal}
        self.bytes = {int(pieces.texts[i][3:5], 16): i for i, k in enumerate(pieces.kinds) if k == "b"}
        self.as_byte = {i: b for b, i in self.bytes.items()}
        #: What each id decodes to, in bytes: runs of byte pieces join to characters.
        plain = {"u": " ⁇ ", "c": ""}
        self.decoded = [bytes([self.as_byte[i]]) if k == "b" else plain.get(k, t.replace(SPACE, " ")).encode() for i, (k, t) in enumerate(zip(pieces.kinds, pieces.texts, strict=True))]
        self.scores = np.array(pieces.scores)
        #: Words are segmented alone where no piece goes on past a word's end.
        self.by_word = not any(SPACE in t.lstrip(SPACE) for t in self.ids)
        encoded = [(t.encode(), i) for t, i in self.ids.items()]
        self.piece_ids = np.array([i for _, i in encoded], dtype=np.int32)
        self.lengths = np.array([len(b) for b, _ in encoded], dtype=np.int32)
        self.longest = int(self.lengths.max(initial=1))
        words = -(-self.longest // 8)
        at = lambda pad: np.frombuffer(b"".join(b.ljust(8 * words, pad) for b, _ in encoded), ">u8").reshape(-1, words).astype(np.uint64)
        self.low, self.high = at(b"\x00"), at(b"\xff")
        self.unknown_score = float(self.scores[self.piece_ids].min(initial=0.0)) - 10.0

        self._forget()

    def _forget(self) -> None:
        """Start with no known words; `flat` holds the ids of known ones, from `begin`, `size` of them each."""
        self.index = _Numbered()
        self.flat, self.begin, self.size = (np.empty(0, np.int32) for _ in range(3))

    # -- matching

    def edges(self, buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, id) of every occurrence of every piece in the buffer, by start, then length.

        The buffer's suffixes, from places where a character starts, are sorted to the depth of the longest piece; a
        piece's occurrences are the range between two binary searches, eight bytes at a time.
        """
        n, words = len(buffer), self.low.shape[1]
        padded = np.concatenate([buffer, np.full(8 * words + 8, 0xFF, np.uint8)])
        packed = np.ndarray((n + 8 * words,), dtype=">u8", buffer=padded, strides=(1,))
        starts = np.flatnonzero((buffer & 0xC0) != 0x80)
        first = packed[starts].astype(np.uint64)
        rank = _ranks(first)
        ended = np.zeros(len(starts), dtype=bool)
        for w in range(1, words):
            # A word of the text that has ended (0xFF) needs no further order.
            ended |= (packed[starts + 8 * (w - 1)].astype(np.uint64) & np.uint64(0xFF)) == np.uint64(0xFF)
            sub = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1)
            if not len(sub) or ended[sub].all():
                break
            rank[sub] = _refined(rank[sub], np.where(ended[sub], np.uint64(0), packed[starts[sub] + 8 * w].astype(np.uint64)))
        array = starts[np.argsort(rank)]
        top = packed[array].astype(np.uint64)
        lo = np.searchsorted(top, self.low[:, 0], side="left")
        hi = np.searchsorted(top, self.high[:, 0], side="right")
        for w in range(1, words):
            deep = np.flatnonzero((self.lengths > 8 * w) & (hi > lo))
            for target, side in ((self.low, False), (self.high, True)):
                a, b = lo[deep].copy(), hi[deep].copy()
                while (open_ := a < b).any():
                    mid = (a + b) // 2
                    value = packed[array[np.minimum(mid, len(array) - 1)] + 8 * w].astype(np.uint64)
                    goal = target[deep, w]
                    right = open_ & ((value <= goal) if side else (value < goal))
                    a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
                if side:
                    hi[deep] = a
                else:
                    kept = a
            lo[deep] = kept
        count = np.maximum(hi - lo, 0)
        wide = np.int32 if n * (self.longest + 1) < 1 << 31 else np.int64
        piece = np.repeat(np.arange(len(lo), dtype=np.int32), count)
        inside = np.arange(len(piece), dtype=wide) + np.repeat((lo - (np.cumsum(count) - count)).astype(wide), count)
        start, length = array.astype(wide)[inside], self.lengths[piece]
        order = np.argsort(start * wide(self.longest + 1) + length)
        return start[order], length[order], self.piece_ids[piece[order]]

    def segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all units one after the other, and where each unit's begin."""
        parts, a, size = [], 0, 0
        for b, unit in enumerate(units, 1):
            size += len(unit)
            if size >= INDEX_BYTES or b == len(units):
                parts.append(self._segment(units[a:b]))
                a, size = b, 0
        counts = np.concatenate([np.diff(bounds) for _, bounds in parts])
        return np.concatenate([ids for ids, _ in parts]), np.r_[0, np.cumsum(counts)]

    def _segment(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [u.encode("utf-8", "replace") for u in units]
        buffer = np.frombuffer(b"\xff".join(encoded) + b"\xff", np.uint8)
        size = np.array([len(e) for e in encoded], dtype=np.int64)
        begin = np.cumsum(size + 1) - (size + 1)
        start, length, piece = self.edges(buffer)
        matched = start, length, piece
        relax = self._shortest if self.pieces.unigram else self._merged
        at, end, ids = relax(buffer, begin, begin + size, matched)
        # Characters without a piece become bytes, or the unknown id.
        missing = np.flatnonzero(ids < 0)
        if len(missing) and self.bytes:
            table = np.array([self.bytes.get(b, self.pieces.unknown) for b in range(256)], dtype=np.int32)
            times = np.ones(len(ids), dtype=np.int64)
            times[missing] = (end - at)[missing]
            spread = np.repeat(np.arange(len(ids)), times)
            inner = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
            out, place = ids[spread], at[spread] + inner
            out = np.where(out < 0, table[buffer[place]], out)
        else:
            out, place = np.where(ids < 0, self.pieces.unknown, ids), at
        return out.astype(np.int32), np.searchsorted(place, np.r_[begin, len(buffer)])

    # -- relaxing

    def _merged(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, matched: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Byte-pair order: in each unit the matching edge of best score that joins two neighbours is relaxed first, ties leftmost.

        A round relaxes one edge in every unit that still has one.
        """
        e_start, e_length, e_id = matched
        width = self.longest + 1
        table = np.full(len(buffer) * width, -1, dtype=np.int32)
        table[e_start * width + e_length] = e_id
        at = np.flatnonzero(((buffer & 0xC0) != 0x80) & (buffer != 0xFF))
        unit = np.searchsorted(end, at, side="right")
        stop = np.minimum(np.r_[at[1:], len(buffer)], end[unit])

        def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The id of the edge from a to b, or -1."""
            size = b - a
            return np.where(size < width, table[a * width + np.minimum(size, width - 1)], -1)

        ids = joined(at, stop)
        symbols = np.bincount(unit, minlength=len(begin))
        done = []
        alone = symbols[unit] > LONG
        for u in np.flatnonzero(symbols > LONG).tolist():
            done.append(self._merge_long(table, width, at[unit == u], int(end[u])))
        at, stop, unit, ids = at[~alone], stop[~alone], unit[~alone], ids[~alone]

        def pair_ids(k: np.ndarray) -> np.ndarray:
            """The id that symbol k and the next make, -1 at a unit's end."""
            out = np.full(len(k), -1, dtype=np.int32)
            ok = np.flatnonzero(k + 1 < len(at))
            ok = ok[unit[k[ok]] == unit[k[ok] + 1]]
            out[ok] = joined(at[k[ok]], stop[k[ok] + 1])
            return out

        pair = pair_ids(np.arange(len(at)))
        while len(at):
            score = np.where(pair >= 0, self.scores[np.maximum(pair, 0)], -np.inf)
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            counts = np.diff(np.r_[first, len(unit)])
            best = np.repeat(np.maximum.reduceat(score, first), counts)
            rest = np.isneginf(best)
            if rest.any():
                done.append((at[rest], stop[rest], ids[rest]))
                at, stop, unit, ids, pair, score, best = (x[~rest] for x in (at, stop, unit, ids, pair, score, best))
                if not len(at):
                    break
            hit = np.flatnonzero(score == best)
            hit = hit[np.r_[True, unit[hit[1:]] != unit[hit[:-1]]]]  # the leftmost of each unit
            ids[hit], stop[hit] = pair[hit], stop[hit + 1]
            keep = np.ones(len(at), dtype=bool)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            at, stop, unit, ids, pair = at[keep], stop[keep], unit[keep], ids[keep], pair[keep]
            now = place[hit]
            pair[now] = pair_ids(now)
            left = now[now > 0] - 1
            pair[left] = pair_ids(left)
        at, stop, ids = (np.concatenate([d[k] for d in done]) if done else np.empty(0, np.int64) for k in range(3))
        order = np.argsort(at, kind="stable")
        return at[order], stop[order], ids[order]

    def _merge_long(self, table: np.ndarray, width: int, at: np.ndarray, end: int) -> tuple[np.ndarray, ...]:
        """The same edges in the same order for one long unit: a heap keeps them, where a round each would pass over all symbols."""
        n = len(at)
        begin, stop = at.tolist(), [*at[1:].tolist(), end]
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ids = [int(table[a * width + b - a]) if b - a < width else -1 for a, b in zip(begin, stop, strict=True)]
        heap: list[tuple[float, int, int]] = []

        def offer(k: int) -> None:
            if k >= 0 and (m := after[k]) >= 0 and (size := stop[m] - begin[k]) < width and (i := int(table[begin[k] * width + size])) >= 0:
                heapq.heappush(heap, (-self.pieces.scores[i], k, stop[m]))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, goal = heapq.heappop(heap)
            m = after[k]
            if m < 0 or stop[k] < 0 or stop[m] != goal:
                continue
            ids[k], stop[k], stop[m] = int(table[begin[k] * width + goal - begin[k]]), goal, -1
            after[k] = after[m]
            if after[m] >= 0:
                before[after[m]] = k
            offer(before[k])
            offer(k)
        kept = [k for k in range(n) if stop[k] >= 0]
        return at[kept], np.array([stop[k] for k in kept], dtype=np.int64), np.array([ids[k] for k in kept], dtype=np.int32)

    def _shortest(self, buffer: np.ndarray, begin: np.ndarray, end: np.ndarray, matched: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        """Unigram order: edges are relaxed by position for the path of greatest total score; a lone character may be unknown."""
        start, length, piece = matched
        at = np.flatnonzero(((buffer & 0xC0) != 0x80) & (buffer != 0xFF))
        stop = np.r_[at[1:], len(buffer)]
        stop = np.minimum(stop, end[np.searchsorted(end, at, side="right")])
        lone = ~np.isin(at * (len(buffer) + 1) + stop, start * np.int64(len(buffer) + 1) + start + length)
        start, stop, ids = np.r_[start, at[lone]], np.r_[start + length, stop[lone]], np.r_[piece, np.full(lone.sum(), -1, np.int32)]
        gain = np.where(ids >= 0, self.scores[np.maximum(ids, 0)], self.unknown_score)
        offset = start - begin[np.searchsorted(end, start, side="right")]
        order = np.lexsort((stop, start, offset))
        start, stop, ids, gain, offset = start[order], stop[order], ids[order], gain[order], offset[order]
        total = np.full(len(buffer) + 1, -np.inf)
        total[begin] = 0.0
        back = np.full(len(buffer) + 1, -1, dtype=np.int64)
        cuts = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1]]) if len(offset) else []
        for a, b in zip(cuts, [*cuts[1:], len(offset)], strict=True):  # all edges of one offset have their start settled
            value = total[start[a:b]] + gain[a:b]
            better = np.flatnonzero(value > total[stop[a:b]])
            total[stop[a:b][better]] = value[better]  # ends differ: one start per unit and offset
            back[stop[a:b][better]] = a + better
        path, here = [], end[end > begin]
        while len(here):
            edge = back[here]
            path.append(edge)
            here = start[edge]
            here = here[~np.isin(here, begin)]
        edges = np.sort(start[np.concatenate(path)] * np.int64(len(start) + 1) + np.concatenate(path)) % (len(start) + 1) if path else np.empty(0, np.int64)
        return start[edges], stop[edges], ids[edges]

    # -- texts

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; none for null and empty texts."""
        if len(self.index) > KNOWN_WORDS:
            self._forget()
        index = self.index
        words: list[np.ndarray | None] = []
        for text in texts:
            if not text:
                words.append(None)
                continue
            marked = (SPACE if self.pieces.dummy_prefix else "") + text.replace(" ", SPACE)
            found = _UNITS.findall(marked) if self.by_word else [marked]
            words.append(np.fromiter(map(index.__getitem__, found), np.int32, len(found)))
        empty = np.empty(0, np.int32)
        if index.fresh:
            more, bounds = self.segment(index.fresh)
            index.fresh = []
            self.begin = np.concatenate([self.begin, (bounds[:-1] + len(self.flat)).astype(np.int32)])
            self.size = np.concatenate([self.size, np.diff(bounds).astype(np.int32)])
            self.flat = np.concatenate([self.flat, more])
        ids, begin, size = self.flat, self.begin, self.size
        out = []
        for own in words:
            if own is None:
                out.append(empty)
                continue
            n = size[own]
            ends = np.cumsum(n, dtype=np.int32)
            out.append(ids[np.repeat(begin[own] - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)])
        return out

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """Text of ids: runs of byte pieces as UTF-8 (broken ones as U+FFFD), marks as spaces, the dummy prefix taken off."""
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.pieces.dummy_prefix and text[:1] == " " else text


def encode(docs: DataFrame, pieces: Pieces, text_col: str = "text", check: bool = False) -> DataFrame:
    """Add ids (array of int; empty for null and empty texts) and, with check, round_trip: decoding gives the text again.

    A literal mark `▁` in a text decodes as a space, as the format has it, and counts as one in the check. Rows are encoded
    in Arrow batches without a shuffle; columns of docs that bear these names are replaced. An empty table stays empty.
    """
    docs = docs.drop(*[c for c in ("ids", "round_trip") if c in docs.columns and c != text_col])
    made = "struct<ids:array<int>" + ",round_trip:boolean>" if check else "struct<ids:array<int>>"

    @F.pandas_udf(made)
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(pieces)
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and size < BATCH_CHARS:
                    size += len(texts[end] or "")
                    end += 1
                rows = codec.encode(texts[at:end])
                out = {"ids": rows}
                if check:
                    out["round_trip"] = [codec.decode(r.tolist()) == (t or "").replace(SPACE, " ") for r, t in zip(rows, texts[at:end], strict=True)]
                yield pd.DataFrame(out)
                at = end
            if not texts:
                yield pd.DataFrame({"ids": [], "round_trip": []} if check else {"ids": []})

    return docs.withColumn("_e", encoded(F.col(text_col))).select(*[F.col(f"`{c}`") for c in docs.columns], "_e.*")


def decode(rows: DataFrame, pieces: Pieces, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of each row's ids as text_col, in place of a column of that name; null for null. An empty table stays empty."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(pieces)
        for batch in batches:
            yield pd.Series([None if r is None else codec.decode(list(r)) for r in batch], dtype=object)

    return rows.withColumn(text_col, decoded(F.col(ids_col)))
