"""Fill-in-middle: a byte DFA counts units and sentinels in one scan, a second pass over the rows that hold a cut finds its byte."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import fresh, release

#: Fixed values of the output format: what stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are rearranged, and of these so many with the suffix first.
REARRANGED, SUFFIX_FIRST = 90, 20
#: Bytes of a row of the scan, and rows that are scanned in step.
ROW = 256
ROWS = 16_384
#: No UTF-8 text holds this byte: it fills rows up and takes the automaton back to its start.
FILL = 0xFF
_UNIT, _HIT = 1, 1 << 16
NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")


class ByteDfa:
    """The product of three automata over bytes: continuation bytes still to come, begin of a unit, sentinels read so far.

    Units are code points, or lines (each with the line feed that ends it). `step` holds 256 times the next state for each
    256 * state + byte, `emit` what the transition counts: _UNIT where a unit begins, _HIT where a sentinel ends. A byte that
    continues nothing counts as a code point. The state after any byte depends on the `memory` bytes before it only, so
    that rows of one text can be scanned in step.
    """

    def __init__(self, sentinels: Sequence[str] = (PREFIX, SUFFIX, MIDDLE), unit: str = "code_point"):
        if unit not in ("code_point", "line"):
            raise ValueError(f"unit {unit!r} is neither code_point nor line")
        tries, ends, back = self._matcher([s.encode() for s in sentinels if s])
        ids, todo, step, emit = {(0, 0, True): 0}, deque([(0, 0, True)]), [], []
        while todo:
            node, pending, fresh_line = todo.popleft()
            for byte in range(256):
                if byte == FILL:
                    to, out = (0, 0, True), 0
                else:
                    inside = pending > 0 and 0x80 <= byte < 0xC0
                    left = pending - 1 if inside else 1 if 0xC2 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF5 else 0
                    here = node
                    while here and byte not in tries[here]:
                        here = back[here]
                    here = tries[here].get(byte, 0)
                    begins = fresh_line if unit == "line" else not inside
                    to = (here, left, unit == "line" and byte == 0x0A)
                    out = _UNIT * begins + _HIT * ends[here]
                if to not in ids:
                    ids[to] = len(ids)
                    todo.append(to)
                step.append(256 * ids[to])
                emit.append(out)
        self.step, self.emit = np.array(step, dtype=np.int32), np.array(emit, dtype=np.int32)
        self.memory = max(3, *(len(s.encode()) for s in sentinels), 1)

    @staticmethod
    def _matcher(patterns: list[bytes]) -> tuple[list[dict[int, int]], list[bool], list[int]]:
        """Children, whether a pattern ends, and the longest proper suffix that is a prefix, for each prefix of a pattern."""
        tries, ends, back = [{}], [False], [0]
        for pattern in patterns:
            node = 0
            for byte in pattern:
                if byte not in tries[node]:
                    tries[node][byte] = len(tries)
                    tries.append({})
                    ends.append(False)
                    back.append(0)
                node = tries[node][byte]
            ends[node] = True
        todo = deque(tries[0].values())
        while todo:
            node = todo.popleft()
            for byte, child in tries[node].items():
                here = back[node]
                while here and byte not in tries[here]:
                    here = back[here]
                back[child] = tries[here].get(byte, 0)
                ends[child] |= ends[back[child]]
                todo.append(child)
        return tries, ends, back

    def _states(self, rows: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The state that each row in `at` is entered with: that after the last bytes of the row before, unless a text begins."""
        state = np.zeros(len(at), dtype=np.int32)
        goes_on = np.flatnonzero(~first[at])
        for column in range(ROW - self.memory, ROW):
            state[goes_on] = self.step[state[goes_on] + rows[at[goes_on] - 1, column]]
        return state

    def counts(self, rows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that begin and sentinels that end in each row; `first` marks the rows that begin a text."""
        total = np.zeros(len(rows), dtype=np.int32)
        for a in range(0, len(rows), ROWS):
            at = np.arange(a, min(a + ROWS, len(rows)))
            columns, state, sums = np.ascontiguousarray(rows[at].T), self._states(rows, at, first), np.zeros(len(at), dtype=np.int32)
            for column in columns:
                code = state + column
                sums += self.emit[code]
                state = self.step[code]
            total[at] = sums
        return total % _HIT, total // _HIT

    def find(self, rows: np.ndarray, first: np.ndarray, at: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """In which column of row at[i] its unit number nth[i] (from 0) begins."""
        found = np.zeros(len(at), dtype=np.int64)
        for a in range(0, len(at), ROWS):
            part = at[a : a + ROWS]
            state, left, where = self._states(rows, part, first), nth[a : a + ROWS] + 1, found[a : a + ROWS]
            for k, column in enumerate(np.ascontiguousarray(rows[part].T)):
                code = state + column
                begins = self.emit[code] & _UNIT
                left = left - begins
                where[(left == 0) & (begins == 1)] = k
                state = self.step[code]
        return found


def cut_texts(dfa: ByteDfa, texts: list[bytes], draws: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units and sentinels of each text, the two cuts in units and the same in bytes.

    The cuts are the smaller and the larger of the two draws modulo (units + 1).
    """
    heights = np.array([-(-len(t) // ROW) for t in texts], dtype=np.int64)
    base = np.r_[0, np.cumsum(heights)]
    rows = np.full((int(base[-1]), ROW), FILL, dtype=np.uint8)
    flat = rows.reshape(-1)
    for text, row in zip(texts, base.tolist(), strict=False):
        flat[row * ROW : row * ROW + len(text)] = np.frombuffer(text, dtype=np.uint8)
    first = np.zeros(len(rows), dtype=bool)
    first[base[:-1][heights > 0]] = True
    units, hits = dfa.counts(rows, first)
    before, hits_before = np.r_[0, np.cumsum(units, dtype=np.int64)], np.r_[0, np.cumsum(hits, dtype=np.int64)]
    n, sentinels = before[base[1:]] - before[base[:-1]], hits_before[base[1:]] - hits_before[base[:-1]]
    cuts = np.sort(np.array(draws, dtype=np.int64).reshape(-1, 2) % (n[:, None] + 1), axis=1)
    offsets = np.repeat(np.array([len(t) for t in texts], dtype=np.int64)[:, None], 2, axis=1)  # where the cut is the text's end
    inside = np.flatnonzero((cuts < n[:, None]).reshape(-1))
    if len(inside):
        owner = inside // 2
        wanted = before[base[owner]] + cuts.reshape(-1)[inside]
        at = np.searchsorted(before, wanted, side="right") - 1
        column = dfa.find(rows, first, at, wanted - before[at])
        offsets.reshape(-1)[inside] = (at - base[owner]) * ROW + column
    return n, sentinels, cuts, offsets


def rearranged(text: bytes, form: str, a: int, b: int) -> bytes:
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if form == "psm":
        return b"".join([PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle])
    if form == "spm":
        return b"".join([SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle])
    return text


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from. Rearranged texts hold no sentinel, so those in the output are its own."""
    parts = lambda mark: F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), f"{mark}|{MIDDLE}")
    psm, spm = parts(SUFFIX), parts(PREFIX)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ROWS rows; a longer text is a run of its own."""
    a = held = 0
    for k, text in enumerate(texts):
        height = -(-len(text) // ROW)
        if k > a and held + height > ROWS:
            yield a, k
            a, held = k, 0
        held += height
    if len(texts) > a:
        yield a, len(texts)


def fill_in_middle(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", salt: str = "1:", unit: str = "code_point", rearrange: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Rearrange each whole text as prefix, suffix, middle; adds n, form, prefix_chars, middle_chars and output.

    Four numbers of 32 bits from the SHA-256 of salt and key decide: the first two, modulo n + 1, where the text of n units
    is cut (both may fall together, or at an end), the third modulo 100 whether it is rearranged (below `rearrange`), the
    fourth modulo 100 whether the suffix comes first (form spm, below `suffix_first`; else psm). Texts that are empty or
    hold a sentinel stay plain: their output is the text, prefix_chars and middle_chars null. A null text counts as empty,
    a null key as an empty string. Rows are judged one by one, without a shuffle: rows that repeat a key are cut by the
    same numbers, repeated rows fare alike, an empty table gives an empty result. Columns of docs stay, whatever their
    names; those that bear a new name are replaced. A task holds an Arrow batch and the rows of one text of it.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in NAMES or c in (key_col, text_col)])
    kept = docs.columns
    dfa = ByteDfa(unit=unit)
    made = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"

    @F.arrow_udf(made)
    def transformed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, digests in batches:
            raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            draws = [[int(d[8 * k : 8 * k + 8], 16) for k in range(4)] for d in digests.to_pylist()]
            columns: list[list] = [[], [], [], [], []]
            for a, b in _slices(raw):
                n, hits, cuts, offsets = cut_texts(dfa, raw[a:b], [(d[0], d[1]) for d in draws[a:b]])
                for k, text in enumerate(raw[a:b]):
                    plain = not text or hits[k] or draws[a + k][2] % 100 >= rearrange
                    form = "plain" if plain else "spm" if draws[a + k][3] % 100 < suffix_first else "psm"
                    sizes = (None, None) if plain else (int(cuts[k, 0]), int(cuts[k, 1] - cuts[k, 0]))
                    for column, value in zip(columns, (int(n[k]), form, *sizes, rearranged(text, form, *offsets[k].tolist())), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.StructArray.from_arrays([*arrays[:4], arrays[4].cast(pa.string())], names=list(NAMES))
            del raw, columns, arrays
            release()

    work = fresh(kept, "fim")
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))).cast("binary"), 256)
    out = docs.withColumn(work, transformed(F.col(f"`{text_col}`"), digest))
    names = [c for c in NAMES if c not in kept]
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{work}`.{c}") for c in names])
