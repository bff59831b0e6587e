"""Words one edit apart by errata tries: light subtrees are merged into their node's tree with one character skipped, put in or replaced."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import discard, materialize, release

#: A word's characters, and the letters that are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a trie at most; a larger group is dealt into smaller ones by more of what its words share.
GROUP_WORDS = 65_536
#: Words that a task takes up at once (and the rest of the last group).
CHUNK_WORDS = 200_000
#: Any odd number has an inverse modulo 2^64.
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NO_CAP = 2**31 - 1


def corpus_words(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", min_chars: int = 5, min_count: int = 3, noise: int | None = 97) -> DataFrame:
    """(word, n): the words of whole texts with at least min_chars code points and min_count occurrences.

    A run is lower-cased in A-Z only. With noise, the crc32 h of `<key>:<run>` is taken; where noise divides it, the run loses
    code point h % length. A null text has no words, a null key counts as an empty string. Rows count each, repeated ones too;
    other columns are not looked at. Counts are summed before they are shuffled.
    """
    found = F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(RUN), F.lit(0))
    runs = docs.select(F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit("")).alias("key"), F.explode(found).alias("run")).where(F.length("run") >= min_chars)
    runs = runs.select("key", F.translate("run", _UPPER, _LOWER).alias("run"))
    word = F.col("run")
    if noise is not None:
        h, size = F.crc32(F.concat_ws(":", "key", "run").cast("binary")), F.length("run")
        at = (h % size).cast("int")
        word = F.when(h % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, size))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _split(rows: DataFrame) -> DataFrame:
    """Deal the words of each group by half of what lies between the ends that they share.

    A group is (p, s, m, cap): its words agree in p characters in front and s behind, and the shorter word of a pair has m between.
    Two words one edit apart agree in m - 1 or more of these, hence in half of them, in front or behind. So each word goes into two
    smaller groups; pairs that agree in the front half are found there, and the others, below cap, in the group behind.
    """
    half = (F.col("m") / 2).cast("int")
    front = F.struct((F.col("p") + half).alias("p"), F.col("s").alias("s"), (F.col("m") - half).alias("m"), F.col("cap").alias("cap"))
    behind = F.struct(F.col("p").alias("p"), (F.col("s") + half).alias("s"), (F.col("m") - half).alias("m"), F.least("cap", F.col("p") + half).alias("cap"))
    return rows.select("word", "n", F.explode(F.array(front, behind)).alias("g")).select("word", "n", "g.*").where("p < cap")


def _key() -> Column:
    head = F.substring("word", F.lit(1), F.col("p"))
    tail = F.substring("word", F.length("word") - F.col("s") + 1, F.col("s"))
    return F.xxhash64(head, tail, "p", "s", "m", "cap")


def _groups(words: DataFrame, group_words: int) -> DataFrame:
    """(key, word, n, p, s, m, cap): every word in the groups that it may find a partner in, none of more than group_words."""
    m = F.explode(F.array(F.length("word"), F.length("word") - 1))  # as the shorter or equal word of a pair, and as the longer
    rows = words.select("word", "n", F.lit(0).alias("p"), F.lit(0).alias("s"), m.alias("m"), F.lit(_NO_CAP).alias("cap")).where("m > 0")
    rows = materialize(_split(rows).withColumn("key", _key()), "dealt")
    done: DataFrame | None = None
    while True:
        large = rows.where("m > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group_words).select("key")
        large = materialize(large, "large")
        if not large.head(1):
            return rows if done is None else done.unionByName(rows)
        small = rows.join(large, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = materialize(_split(rows.join(large, "key", "left_semi")).withColumn("key", _key()), "dealt")


def _expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


class ErrataTries:
    """The tries of several groups of words, as sorted words with the lengths of common prefixes.

    A node at depth d is a run of words that agree in d characters; its heaviest child stays, words in the other children are light
    there. On its way up a word is light at most log2(size) times, and only then it is merged: with the node's character replaced
    or skipped, or the heavy child's put in front of it. Terminals are told by hashes of (group, string), which one multiplication
    moves along, and compared as strings where they coincide.
    """

    def __init__(self, words: list[str], group: np.ndarray):
        self.words, self.group = words, group
        self.size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.base = np.r_[0, np.cumsum(self.size)]
        self.chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        longest = int(self.size.max(initial=0)) + 2
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(longest, _ODD)], dtype=np.uint64)
        depth = np.arange(len(self.chars)) - np.repeat(self.base[:-1], self.size)
        self.sums = np.r_[np.uint64(0), np.cumsum(self._mixed(self.chars) * self.power[depth], dtype=np.uint64)]
        self.common = self._common()

    @staticmethod
    def _mixed(chars: np.ndarray) -> np.ndarray:
        x = (chars + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x * np.uint64(0x94D049BB133111EB)

    def _prefix(self, row: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        return self.sums[self.base[row] + k] - self.sums[self.base[row]]

    def _common(self) -> np.ndarray:
        """Characters that each word shares with the one before it; -1 where a group begins."""
        out = np.zeros(len(self.words), dtype=np.int64)
        starts = np.r_[True, self.group[1:] != self.group[:-1]] if len(self.words) else np.zeros(0, bool)
        active, d = np.flatnonzero(~starts), 0
        while len(active):
            active = active[(self.size[active] > d) & (self.size[active - 1] > d)]
            active = active[self.chars[self.base[active] + d] == self.chars[self.base[active - 1] + d]]
            out[active] += 1
            d += 1
        out[starts] = -1
        return out

    def light(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """By depth: the light words there, their nodes (numbers within the depth) and the heavy children's characters."""
        n = len(self.words)
        active, d = np.arange(n), 0
        while len(active):
            node_starts = np.r_[True, (self.common[active[1:]] < d) | (np.diff(active) > 1)]
            node = np.cumsum(node_starts) - 1
            active = active[np.bincount(node)[node] > 1]  # nothing branches below a single word
            if not len(active):
                return
            node_starts = np.r_[True, (self.common[active[1:]] < d) | (np.diff(active) > 1)]
            node = np.cumsum(node_starts) - 1
            child_starts = node_starts | (self.common[active] < d + 1)
            child = np.cumsum(child_starts) - 1
            first = np.flatnonzero(child_starts)
            ended = self.size[active[first]] == d
            weight = np.where(ended, 0, np.bincount(child))  # a word that ends at the node is light
            owner = node[first]
            order = np.lexsort((np.arange(len(first)), -weight, owner))
            heavy = order[np.r_[True, owner[order][1:] != owner[order][:-1]]]  # one for each node, in order
            is_light = child != heavy[node]
            if is_light.any():
                letter = self.chars[self.base[active[first[heavy]]] + d]
                yield d, active[is_light], node[is_light], letter[node[is_light]]
            active = active[self.size[active] > d]
            d += 1

    def _coinciding(self, asked: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """(row, row) of words whose changed form has the hash of a word of the same group."""
        salt = self._mixed(self.group.astype(np.uint64))
        rows = np.arange(len(self.words))
        table = self._prefix(rows, self.size) + salt
        order = np.argsort(table, kind="stable")
        table = table[order]
        row, wanted = np.concatenate([r for r, _ in asked]), np.concatenate([h + salt[r] for r, h in asked])
        low, high = np.searchsorted(table, wanted), np.searchsorted(table, wanted, side="right")
        return np.repeat(row, high - low), order[_expand(low, high - low)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, row, characters in common in front) of words of a group that are one edit apart, each pair once."""
        asked, a, b = [], [], []
        for d, row, node, letter in self.light():
            head, whole = self._prefix(row, d), self._prefix(row, self.size[row])
            put = head + self._mixed(letter) * self.power[d]
            asked.append((row, put + (whole - head) * _ODD))  # heavy character put in
            goes_on = self.size[row] > d
            row, node, head, whole, put = row[goes_on], node[goes_on], head[goes_on], whole[goes_on], put[goes_on]
            rest = whole - self._prefix(row, d + 1)
            asked.append((row, put + rest))  # replaced by the heavy character
            more = self.size[row] > d + 1
            follows = np.full(len(row), -1, dtype=np.int64)
            follows[more] = self.chars[self.base[row[more]] + d + 1].astype(np.int64)
            skips = follows != self.chars[self.base[row] + d].astype(np.int64)  # in a run of one character the last is skipped
            asked.append((row[skips], (head + rest * _INVERSE)[skips]))
            order = np.lexsort((row, rest, self.size[row], node))  # light words that agree below their characters
            same = (node[order][1:] == node[order][:-1]) & (rest[order][1:] == rest[order][:-1]) & (self.size[row[order]][1:] == self.size[row[order]][:-1])
            run = np.cumsum(np.r_[True, ~same]) - 1 if len(order) else np.empty(0, np.int64)
            ends = np.cumsum(np.bincount(run))[run] if len(order) else run
            ahead = ends - np.arange(len(order)) - 1
            a.append(np.repeat(row[order], ahead))
            b.append(row[order][_expand(np.arange(len(order)) + 1, ahead)] if len(order) else row)
        if asked:
            left, right = self._coinciding(asked)
            a.append(left)
            b.append(right)
        if not a:
            return (np.empty(0, np.int64),) * 3
        return self._verified(np.concatenate(a), np.concatenate(b))

    def _verified(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w, kept, common = self.words, [], []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            s, t = (w[x], w[y]) if len(w[x]) <= len(w[y]) else (w[y], w[x])
            d = 0
            while d < len(s) and s[d] == t[d]:
                d += 1
            fits = len(t) - len(s) <= 1 and s != t and (s[d:] == t[d + 1 :] or (len(s) == len(t) and s[d + 1 :] == t[d + 1 :]))
            kept.append(fits)
            common.append(d)
        fine = np.array(kept, dtype=bool)
        return a[fine], b[fine], np.array(common, dtype=np.int64)[fine]


def _near(chunk: pd.DataFrame) -> pd.DataFrame:
    """Of each word of whole groups: its near words there, and of them the one of largest n (ties to the smaller)."""
    columns = ["word", "n_near", "form_n", "form"]
    frame = chunk[chunk.groupby("key", sort=False)["key"].transform("size") > 1].reset_index(drop=True)
    if not len(frame):
        return pd.DataFrame(columns=columns)
    words = frame["word"].tolist()
    p, s, m, cap = (frame[c].to_numpy(dtype=np.int64) for c in ("p", "s", "m", "cap"))
    head = np.fromiter((hash(w[:k]) for w, k in zip(words, p.tolist(), strict=True)), dtype=np.int64, count=len(words))
    tail = np.fromiter((hash(w[len(w) - k :]) for w, k in zip(words, s.tolist(), strict=True)), dtype=np.int64, count=len(words))
    marks = np.stack([frame["key"].to_numpy(), p, s, m, cap, head, tail], axis=1)
    order = np.lexsort(marks.T[::-1])  # stable, so words stay sorted; keys that collide come apart
    words, marks = [words[i] for i in order.tolist()], marks[order]
    group = np.cumsum(np.r_[True, (marks[1:] != marks[:-1]).any(axis=1)]) - 1
    n, cap, shorter = frame["n"].to_numpy()[order], cap[order], (p + s + m)[order]
    tries = ErrataTries(words, group)
    a, b, common = tries.pairs()
    mine = (common < cap[a]) & (np.minimum(tries.size[a], tries.size[b]) == shorter[a])  # another group has the others
    a, b = a[mine], b[mine]
    a, b = np.r_[a, b], np.r_[b, a]
    order = np.lexsort((b, -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(a)])
    return pd.DataFrame({"word": [words[i] for i in a[first].tolist()], "n_near": times, "form_n": n[b[first]], "form": [words[i] for i in b[first].tolist()]}, columns=columns)


def _near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key and word, taken up in whole groups."""
    held: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= CHUNK_WORDS:
            rows = pd.concat(held, ignore_index=True)
            whole = int((rows["key"] != rows["key"].iloc[-1]).sum())
            held, size = [rows.iloc[whole:]], len(rows) - whole
            if whole:
                yield _near(rows.iloc[:whole])
                release()
    if held:
        yield _near(pd.concat(held, ignore_index=True))
        release()


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, form_n, form) of the words (word, n) that have near ones: how many, and the one of largest n, ties to the smaller.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. No pair leaves its task: a group
    gives each word's count and best, which are summed by word.
    """
    dealt = _groups(words, group_words).repartition("key").sortWithinPartitions("key", "word")
    found = dealt.mapInPandas(_near_words, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): each round follows twice as many forms as the one before."""
    links = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = materialize(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(links)
        links = longer.select("word", "root")
        if not longer.where("moved").head(1):
            return links


def spelling_groups(words: DataFrame, ratio: int = 2, group_words: int = GROUP_WORDS) -> DataFrame:
    """Group spelling variants: (word, form, root, n, n_near, form_n) for each of the words (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order) where that n is at least ratio times its
    own, else null; its root is the last word that forms lead to, itself without a form. n at least doubles with each step, so
    forms make no circle. n_near is 0 without near words. Words that are null take no part; words must not repeat. An empty table
    gives an empty result.
    """
    words = materialize(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, group_words)
    fits = F.coalesce(F.col("near_n") >= ratio * F.col("n"), F.lit(False))
    near = near.withColumnsRenamed({"form_n": "near_n", "form": "near"})
    joined = words.join(near, "word", "left").select("word", F.when(fits, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("near_n")).alias("form_n"))
    found = materialize(joined, "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
