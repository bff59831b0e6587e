"""The corpus pipeline against a brute-force version of every stage that shares no code with the operators."""

import collections
import re

import pytest

import corpus_pipeline
from marquetry.llm import packing, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STOP = (
    "a and are as at be by for from he in is it of on or that the this to was with au dans de des du elle est et la le les pas pour que qui un une "
    "con del el en es los por se su y auf das dem der die ein eine für ich in ist mit nicht sich und von zu"
).split()


def kept_by_quality(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    if len(words) < 10:
        return False
    times = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {i + k for i in range(len(words) - 4) if times[tuple(words[i : i + 5])] > 1 for k in range(5)}
    if 100 * len(again) > 20 * len(words):
        return False
    every = {v for w in STOP for v in (w, w.capitalize(), w.upper())}
    shares = [
        (2 <= sum(map(len, words)) / len(words) <= 20),
        len(re.findall(r"[#*$%&|<>]", text)) <= 0.3 * len(words),
        text.count("!") <= 0.5 * len(words),
    ]
    if len(words) >= 50:
        shares.append(sum(w in every for w in words) >= 0.02 * len(words))
        shares.append(2 * (len(lines) - len(set(lines))) <= len(lines))
        shares.append(sum(bool(re.match(r"\s*[-*•]", x)) for x in lines) <= 0.9 * len(lines))
    return all(shares)


def masked(text):
    """Base patterns and plainly assigned literals in the text, in place of a mark; runs of overlapping spans as one."""
    spans = [m.span() for m in re.finditer(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m[1]) >= 6]
    spans += [m.span() for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [m.span() for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def brute(rows):
    """Documents after quality, one of each similar group, cut repeats, and masks."""
    rows = [(i, t) for i, t in rows if kept_by_quality(t)]
    sets = {}
    for i, t in rows:
        w = WORD.findall(t)
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inverted[g].append(i)
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in sets.items():
        shared = collections.Counter(o for g in s for o in inverted[g] if o > i)
        for o, n in shared.items():
            if 5 * n >= 4 * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(i), find(o)))
                label[b] = a
    rows = sorted((i, t) for i, t in rows if find(i) == i)
    first, out = {}, {}
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out[i] = masked(text)
    return out


def test_pipeline(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = brute([(r["doc_id"], r["text"] or "") for r in docs.collect()])
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = corpus_pipeline.materialize(f(spark, stage, folder), name)
        assert stage.dtypes == docs.dtypes
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in stage.collect())
    bins, spans = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        spans[r["doc_id"]].append((r["start"], r["length"]))
        if r["length"]:
            bins[r["bin_id"], r["bin_capacity"]].append((r["bin_offset"], r["length"]))
    for i, text in want.items():  # every word of every text has one place
        own, at = sorted(spans.pop(i)), 0
        for start, length in own:
            assert start == at and length <= max(packing.CAPACITIES)
            at += length
        assert at == len(WORD.findall(text))
    assert not spans and len({b for b, _ in bins}) == len(bins)
    for (_, capacity), own in bins.items():
        own.sort()
        used = sum(n for _, n in own)
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert capacity == min(c for c in packing.CAPACITIES if c >= used)
    assert sum(c for _, c in bins) - sum(len(WORD.findall(t)) for t in want.values()) <= 2 * max(packing.CAPACITIES)


PROSE = "the quick brown fox jumps over a lazy dog while seven wise owls watch from the old oak tree and sing of rivers that never sleep in spring"


@pytest.fixture(scope="module")
def odd(spark):
    near = PROSE.replace("spring", "autumn")
    long = " ".join(f"word{k} of" for k in range(9000))
    other = "completely different words stand here so that this row is like no other row of the table at all my friend"
    rows = [(1, PROSE, "x", 1), (1, PROSE, "x", 1), (1, PROSE, "y", None), (None, PROSE, "x", 1), (None, near, "x", 1), (5, near, "x", 1), (5, other, "x", 1), (7, None, "x", 1), (8, "", None, 1), (9, long, "x", 1), (None, None, None, None), (None, other + " or so it seems", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, bin_id string, n_chars long").repartition(3)


def test_stages_take_nulls_repeats_and_further_columns(spark, odd):
    good = corpus_pipeline.keep_good(spark, odd, "")
    assert good.columns == odd.columns and good.count() == 9
    one = corpus_pipeline.materialize(corpus_pipeline.one_of_each_group(spark, good, ""), "one")
    assert one.dtypes == odd.dtypes
    found = sorted((r["doc_id"] or 0, r["text"][:9]) for r in one.collect())
    assert found == [(1, PROSE[:9]), (5, "completel"), (9, "word0 of ")]  # one row each, those of null keys are like others
    cut = corpus_pipeline.cut_repeats(spark, odd, "")
    assert cut.dtypes == odd.dtypes and cut.count() == odd.count()
    texts = [(r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect()]
    assert sum(t == PROSE and i == 1 for i, t, _ in texts) == 3 and (None, "", 0) in texts and (8, "", 0) in texts
    assert all(n == len(t) for _, t, n in texts)
    masks = corpus_pipeline.mask_secrets(spark, odd, "")
    assert masks.dtypes == odd.dtypes and masks.count() == odd.count()
    packed = corpus_pipeline.pack(spark, odd, "")
    assert packed.groupBy().sum("length").first()[0] == sum(len(WORD.findall(r["text"] or "")) for r in odd.collect())


def test_stages_take_empty_tables(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), "").count() == 0


def test_registry_names():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert set(registry.oracle_sql()) <= set(names)
