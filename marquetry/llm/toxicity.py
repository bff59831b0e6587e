"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes, calibrated."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import fresh, materialize, release

#: Labelled rows that the model is fitted on, at most about (each row is drawn by a hash of its key), and terms of its vocabulary.
#: They bound the index: at most EXAMPLES * (TERMS + 1) postings, in practice some ten for each example.
EXAMPLES = 16_384
TERMS = 2_048
#: A term is a feature if its occurrence and the label depend on each other by a chi-squared of this, and enough examples hold it.
MIN_CHI2 = 20.0
MIN_EXAMPLES = 5
#: Neighbours that vote, the weight of the base rate among them, and the least distance.
NEIGHBOURS = 15
PRIOR_VOTES = 0.5
NEAREST = 0.05
#: Examples of a block, blocks that a query opens in the first and in the second wave, and queries that are asked together.
BLOCK = 64
WAVES = (4, 16)
ASKED = 256
#: The step of weights: a product takes 48 of a double's 53 bits.
GRAIN = 2.0**-24
#: From this score on a text is called toxic.
THRESHOLD = 0.3
#: Texts beyond so many characters are tokenised word by word instead of by a list.
LONG = 1 << 20

#: Beside a word, its first letters are terms: so many of them, for stems that are inflected or compounded.
STEMS = range(4, 9)

_WORD = re.compile(r"[^\W\d_]+")
NAMES = ("score", "predicted", "neighbours")


def word_counts(text: str | None) -> Counter:
    """Runs of letters of a whole text, in lower case, with their occurrences; none for null."""
    lower = (text or "").lower()
    return Counter((m.group() for m in _WORD.finditer(lower)) if len(lower) > LONG else _WORD.findall(lower))


def terms_of(word: str) -> list[str]:
    """The word and its stems; these are marked with an asterisk."""
    return [word, *[word[:k] + "*" for k in STEMS if k <= len(word)]]


def term_counts(text: str | None, vocabulary: dict[str, int], heads: frozenset[str] | None = None) -> Counter:
    """Occurrences of the vocabulary's terms in a whole text; all its words together are one more term, the last.

    Through that term a vector knows how much else a text says beside the terms that speak for a label. `heads` are the first
    letters, four at most, of the vocabulary's terms, if they are known: words that begin otherwise are passed over.
    """
    counts = word_counts(text)
    out: Counter = Counter({len(vocabulary): counts.total()} if counts else {})
    head = STEMS[0]
    for word in counts if heads is None else [w for w in counts if w[:head] in heads]:
        for term in terms_of(word):
            if (found := vocabulary.get(term)) is not None:
                out[found] += counts[word]
    return out


def held_terms(text: str | None, vocabulary: dict[str, int], heads: frozenset[str]) -> set[int]:
    """The terms that `term_counts` would count."""
    lower, head = (text or "").lower(), STEMS[0]
    words = {m.group() for m in _WORD.finditer(lower)} if len(lower) > LONG else set(_WORD.findall(lower))
    out = {len(vocabulary)} if words else set()
    for word in [w for w in words if w[:head] in heads]:
        out.update(vocabulary[t] for t in terms_of(word) if t in vocabulary)
    return out


def heads_of(vocabulary: dict[str, int]) -> frozenset[str]:
    return frozenset(term.rstrip("*")[: STEMS[0]] for term in vocabulary)


def unit_vector(counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms in rising order and their weights (1 + ln count) * idf, scaled to length 1, in whole steps of GRAIN.

    Products of such weights and their sums are exact in doubles, in whatever order they are added: equal vectors tie exactly.
    """
    terms = np.array(sorted(counts), dtype=np.int64)
    weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * idf[terms]
    return terms, np.maximum(np.round(weights / np.sqrt((weights * weights).sum()) / GRAIN), 1) * GRAIN if len(terms) else weights


class BlockMaxIndex:
    """Postings by term, then block of vectors, with the greatest weight of each such run.

    Examples of one vector are one entry. Entries that share their heaviest term stand together, so that blocks differ in what
    they can reach. A block's runs are a matrix of its terms and entries, 0 where an entry lacks the term.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK):
        members: dict[tuple[bytes, bytes], list[int]] = {}
        for i, (t, w) in enumerate(vectors):
            members.setdefault((t.tobytes(), w.tobytes()), []).append(i)
        single = [vectors[m[0]] for m in members.values()]
        heaviest = np.array([t[np.argmax(w)] for t, w in single], dtype=np.int64)
        weight = np.array([w.max() for _, w in single])
        order = np.lexsort((np.arange(len(single)), -weight, heaviest))
        grouped = list(members.values())
        self.members = [np.array(grouped[k], dtype=np.int64) for k in order.tolist()]
        self.times = np.array([len(m) for m in self.members], dtype=np.int64)
        self.entry = np.empty(len(vectors), dtype=np.int64)
        for k, m in enumerate(self.members):
            self.entry[m] = k
        single = [single[k] for k in order.tolist()]
        self.blocks = max(1, -(-len(single) // block))
        none = np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(single)), [len(t) for t, _ in single])
        terms = np.concatenate([none, *(t for t, _ in single)])
        turn = np.lexsort((owner, terms))
        owner, weights = owner[turn], np.concatenate([np.empty(0), *(w for _, w in single)])[turn]
        keys = owner // block * (1 << 32) + terms[turn]
        by_block = np.argsort(keys, kind="stable")
        keys, owner, weights = keys[by_block], owner[by_block], weights[by_block]
        starts = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=bool)
        run, keys = np.cumsum(starts) - 1, keys[starts]
        runs = np.zeros((len(keys), block))
        runs[run, owner % block] = weights
        cut = np.searchsorted(keys, np.arange(self.blocks + 1) << 32)
        self.parts = [(keys[a:b] & (2**32 - 1), runs[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        self.width, self.n_terms = block, int(terms.max(initial=-1)) + 1
        self.most = np.zeros((self.n_terms, self.blocks))
        self.most[keys & (2**32 - 1), keys >> 32] = runs.max(axis=1, initial=0)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of greatest cosine above 0 (ties to the smaller number) and their cosines; `barred` ones take no part."""
        left_out = 0 if barred is None else len(barred)
        ids, cosines = self.nearest_each([(terms, weights)], [k + left_out])[0]
        free = ~np.isin(ids, barred) if left_out else np.ones(len(ids), dtype=bool)
        return ids[free][:k], cosines[free][:k]

    def nearest_each(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector its k[i] examples of greatest cosine above 0, ties to the smaller number.

        A vector's blocks stand by falling bound. The first wave opens the first of them, the second some more, the last all
        others whose bound reaches the kth cosine found before. Vectors at the same block share one product.
        """
        asked = np.zeros((self.n_terms, len(vectors)))
        for q, (terms, weights) in enumerate(vectors):
            known = terms < self.n_terms
            asked[terms[known], q] = weights[known]
        bounds = asked.T @ self.most
        rank = np.empty(bounds.shape, dtype=np.int64)
        np.put_along_axis(rank, np.argsort(-bounds, axis=1, kind="stable"), np.arange(self.blocks)[None, :], axis=1)
        wanted, kth = np.asarray(k, dtype=np.int64), np.full(len(vectors), GRAIN * GRAIN)
        query, entry, cosine = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for low, high in zip((0, *WAVES), (*WAVES, self.blocks), strict=True):
            opens = (rank >= low) & (rank < high) & (bounds >= kth[:, None])
            found = [(query, entry, cosine)]
            for b in np.flatnonzero(opens.any(axis=0)).tolist():
                q = np.flatnonzero(opens[:, b])
                terms, runs = self.parts[b]
                scores = asked[np.ix_(terms, q)].T @ runs
                at, e = np.nonzero(scores >= kth[q][:, None])
                found.append((q[at], b * self.width + e, scores[at, e]))
            query, entry, cosine = (np.concatenate([f[c] for f in found]) for c in range(3))
            order = np.lexsort((entry, -cosine, query))
            query, entry, cosine = query[order], entry[order], cosine[order]
            before = np.cumsum(self.times[entry]) - self.times[entry]
            first = np.searchsorted(query, np.arange(len(vectors)))
            before -= np.concatenate([before, [0]])[first][query]
            holds_kth = np.flatnonzero((before < wanted[query]) & (before + self.times[entry] >= wanted[query]))
            kth[query[holds_kth]] = cosine[holds_kth]
            near = cosine >= kth[query]
            query, entry, cosine = query[near], entry[near], cosine[near]
        cut, out = np.searchsorted(query, np.arange(len(vectors) + 1)), []
        for q in range(len(vectors)):
            hits = entry[cut[q] : cut[q + 1]]
            ids = np.concatenate([np.empty(0, np.int64), *(self.members[h] for h in hits.tolist())])
            cosines = np.repeat(cosine[cut[q] : cut[q + 1]], self.times[hits])
            best = np.lexsort((ids, -cosines))[: wanted[q]]
            out.append((ids[best], cosines[best]))
        return out


def vote(cosines: np.ndarray, toxic: np.ndarray, base: float) -> float:
    """The share of toxic among the neighbours, each weighted by 1 / (distance + NEAREST), the base rate by PRIOR_VOTES.

    A neighbour at distance 0 weighs 1, so PRIOR_VOTES counts in such neighbours.
    """
    weights = NEAREST / (1 - np.minimum(cosines, 1.0) + NEAREST)
    return float((weights @ toxic + PRIOR_VOTES * base) / (weights.sum() + PRIOR_VOTES))


def calibration(raw: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve through (raw, label) of least squares: knots and values, to be read off between them.

    Pooled runs count half an example of the base rate, so that no value is 0 or 1.
    """
    order = np.argsort(raw, kind="stable")
    x, y = raw[order], labels[order].astype(np.float64)
    cut = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    runs: list[list[float]] = []
    for total, size, at in zip(np.add.reduceat(y, cut), np.diff(np.r_[cut, len(x)]), x[cut], strict=True):
        runs.append([total, size, at, at])
        while len(runs) > 1 and runs[-2][0] * runs[-1][1] >= runs[-1][0] * runs[-2][1]:
            total2, size2, _, hi = runs.pop()
            runs[-1] = [runs[-1][0] + total2, runs[-1][1] + size2, runs[-1][2], hi]
    base = float(y.mean())
    knots, values = [], []
    for total, size, lo, hi in runs:
        knots += [lo, hi]
        values += [(total + 0.5 * base) / (size + 0.5)] * 2
    return np.array(knots), np.maximum.accumulate(values)


@dataclass
class Model:
    """What tasks score with. Its size is bounded by EXAMPLES and TERMS."""

    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    index: BlockMaxIndex
    base: float
    blank: float
    knots: np.ndarray
    values: np.ndarray
    heads: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        self.heads = heads_of(self.vocabulary)

    def votes(self, texts: list[str | None], k: int, barred: list[np.ndarray] | None = None) -> Iterator[tuple[float | None, np.ndarray, np.ndarray]]:
        """For each text the vote (null where it has no neighbour), its neighbours and their cosines, without the barred examples."""
        for a in range(0, len(texts), ASKED):
            vectors = [unit_vector(term_counts(t, self.vocabulary, self.heads), self.idf) for t in texts[a : a + ASKED]]
            out = barred[a : a + ASKED] if barred else [np.empty(0, np.int64)] * len(vectors)
            for (ids, cosines), left_out in zip(self.index.nearest_each(vectors, [k + len(x) for x in out]), out, strict=True):
                if len(left_out):
                    free = ~np.isin(ids, left_out)
                    ids, cosines = ids[free][:k], cosines[free][:k]
                yield (vote(cosines, self.toxic[ids], self.base) if len(ids) else None), ids, cosines

    def score(self, raw: float | None) -> float:
        return self.blank if raw is None else float(np.interp(raw, self.knots, self.values))


def in_fold(key: Column) -> Column:
    """Whether a row's label may be learned from: crc32 of its key as text, modulo 4, is not 2. A null key is never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def sampled_labels(labels: DataFrame, key_col: str, label_col: str, examples: int) -> DataFrame:
    """One (id, toxic) for each labelled key of the learning folds, drawn by a hash of the key so that about `examples` are left.

    Keys that bear both labels equally often count as toxic.
    """
    rows = labels.where(in_fold(F.col(key_col)) & F.col(label_col).isNotNull()).groupBy(F.col(key_col).alias("id")).agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("toxic"))
    n = rows.count()
    share = min(1.0, examples / max(n, 1))
    unit = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(unit < share)


def features(train: DataFrame, terms: int, min_chi2: float) -> list[str]:
    """The terms whose occurrence depends on the label, by chi-squared over the examples' different texts; the `terms` strongest."""

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, toxic = Counter(), Counter()
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                found = {t for w in word_counts(text) for t in terms_of(w)}
                seen.update(found)
                if label:
                    toxic.update(found)
            yield pd.DataFrame({"term": list(seen), "n": list(seen.values()), "n_toxic": [toxic[t] for t in seen]})
            release()

    distinct = train.groupBy("digest").agg(F.max(F.struct("toxic", "text")).alias("row")).select("row.*")
    n, n_toxic = train.groupBy("digest").agg(F.max("toxic").alias("toxic")).agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    counts = distinct.mapInPandas(held, "term string, n long, n_toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic")).where(F.col("n") >= MIN_EXAMPLES)
    a, b = F.col("n_toxic").cast("double"), (F.col("n") - F.col("n_toxic")).cast("double")
    c, d = n_toxic - a, (n - n_toxic) - b
    chi2 = F.try_divide(n * F.pow(a * d - b * c, F.lit(2)), (a + b) * (c + d) * (a + c) * (b + d))
    scored = counts.withColumn("chi2", chi2).where(F.col("chi2") >= min_chi2)
    return sorted(r["term"] for r in scored.orderBy(F.desc("chi2"), "term").limit(terms).collect())


def document_counts(docs: DataFrame, text_col: str, vocabulary: dict[str, int]) -> tuple[int, np.ndarray]:
    """All documents, and those that hold each term: counted over the whole corpus, summed by term before they leave a batch.

    One row for each term of the vocabulary reaches the driver.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, heads_of(vocabulary)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter({-1: batch.num_rows})
            for text in batch.column(0).to_pylist():
                seen.update(held_terms(text, *shared.value))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])
            release()

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found, out = {r["term"]: r["n"] for r in rows}, np.zeros(len(vocabulary) + 1)
    for term, n in found.items():
        if term >= 0:
            out[term] = n
    return found.get(-1, 0), out


def fit(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = EXAMPLES, terms: int = TERMS, min_chi2: float = MIN_CHI2, k: int = NEIGHBOURS) -> Model:
    """Learn from the labelled rows of the learning folds, `examples` of them at most about; idf is counted over all of docs.

    Votes are calibrated on the examples themselves, each scored without those of its own text. Examples without words are no
    neighbours; their share of toxic ones, with half an example of the base rate, is the score of texts without words. Labels of keys that docs lacks are left
    out. Without examples everything scores 0.
    """
    drawn = F.broadcast(sampled_labels(labels, key_col, label_col, examples))  # bounded by `examples`
    rows = docs.select(F.col(f"`{key_col}`").alias("key"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(drawn, F.col("key") == F.col("id"))
    train = materialize(rows.select("id", "text", "toxic", F.sha2("text", 256).alias("digest")), "examples")
    vocabulary = {t: i for i, t in enumerate(features(train, terms, min_chi2))}
    n, held = document_counts(docs, text_col, vocabulary)
    idf = np.log((n + 1) / (held + 1)) + 1

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [unit_vector(term_counts(t, vocabulary), idf) for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "digest": batch["digest"], "toxic": batch["toxic"], "terms": [t for t, _ in made], "weights": [w for _, w in made]})
            release()

    kind = docs.schema[key_col].dataType.simpleString()
    found = train.mapInPandas(vectors, f"id {kind}, digest string, toxic int, terms array<bigint>, weights array<double>").orderBy("id", "digest").toPandas()
    toxic = found["toxic"].to_numpy(dtype=np.float64)
    base = float(toxic.mean()) if len(found) else 0.0
    empty = np.array([not len(t) for t in found["terms"]], dtype=bool)
    shown = found[~empty].reset_index(drop=True) if len(found) else found
    index = BlockMaxIndex([(np.asarray(t, dtype=np.int64), np.asarray(w, dtype=np.float64)) for t, w in zip(shown["terms"], shown["weights"], strict=True)])
    blank = float((toxic[empty].sum() + 0.5 * base) / (empty.sum() + 0.5)) if len(found) else 0.0
    flat = np.array([0.0, 1.0])
    model = Model(vocabulary, idf, shown["id"].to_numpy(), shown["toxic"].to_numpy(dtype=np.float64), index, base, blank, flat, flat)
    if not len(shown):
        return model
    same = {d: g.to_numpy() for d, g in shown.reset_index().groupby("digest")["index"]}
    shared = docs.sparkSession.sparkContext.broadcast((model, same))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, same = shared.value
        for batch in batches:
            own = [same.get(d, np.empty(0, np.int64)) for d in batch["digest"]]
            raw = [r for r, _, _ in model.votes(batch["text"].tolist(), k, own)]
            yield pd.DataFrame({"raw": [math.nan if r is None else r for r in raw], "toxic": batch["toxic"]})

    votes = train.mapInPandas(judged, "raw double, toxic int").where("raw is not null and not isnan(raw)").toPandas()
    if len(votes):
        model.knots, model.values = calibration(votes["raw"].to_numpy(), votes["toxic"].to_numpy())
    return model


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", k: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """Score each whole text by its k nearest examples; adds score (0 to 1), predicted (int) and neighbours (id, toxic, cosine), nearest first.

    Nothing but the text is looked at. Texts without words, empty and null ones too, have no neighbours and the score of such
    examples. Rows are scored one by one, without a shuffle: repeated rows score alike, an empty table gives an
    empty result. Columns of docs stay, whatever their names; those that bear a new name are replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in NAMES or c == text_col])
    kept, shared = docs.columns, docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<score:double,predicted:int,neighbours:array<struct<id:string,toxic:int,cosine:double>>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        ids, labels = pa.array(model.ids).cast(pa.string()), pa.array(model.toxic.astype(np.int32))
        for texts in batches:
            scores, near, cosines = [], [np.empty(0, np.int64)], [np.empty(0)]
            for raw, found, each in model.votes(texts.to_pylist(), k):
                scores.append(model.score(raw))
                near.append(found)
                cosines.append(each)
            at = pa.array(np.concatenate(near))
            rows = pa.StructArray.from_arrays([ids.take(at), labels.take(at), pa.array(np.concatenate(cosines))], names=["id", "toxic", "cosine"])
            evidence = pa.ListArray.from_arrays(pa.array(np.cumsum([len(x) for x in near]), pa.int32()), rows)
            called = pa.array([int(s >= threshold) for s in scores], pa.int32())
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), called, evidence], names=list(NAMES))
            release()

    work = fresh(kept, "toxicity")
    out = docs.withColumn(work, scored(F.col(f"`{text_col}`")))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{work}`.{c}") for c in NAMES if c not in kept])
