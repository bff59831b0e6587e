"""Fill-in-middle, spelling groups and toxicity against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from marquetry.llm import infill, toxicity, variants

TEXTS = [None, "", " ", "a", "é", "日本語", "😀😀", "a<P>b", "<", "<P", "<S>", "x<<M>>y", "<P<S", "naïve 😀 日本 " * 40, "word " * 4000, "é" * 255, "é" * 256 + "x", "<" * 300, "<P" * 200, "\x00zero", "line\nline\n\nlast"]
ODD = "doc_id long, text string, n string, `a.b` int, output long, _fim int, score int, _toxicity int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = list(enumerate(TEXTS)) + [(100 + k, "".join(rng.choice("ab<PSM>é日😀 ") for _ in range(rng.randint(1, 900)))) for k in range(60)]
    return out + [(3, "another text of key 3"), (3, "another text of key 3"), (None, "keyless"), (None, None), (2**63 - 1, "last key"), (-5, "negative key")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1, 2, 3, 4, 5) for i, t in rows], ODD).repartition(3)


def infilled(key, text, unit="code_point"):
    """The definition, on strings."""
    text = text or ""
    units = list(text) if unit == "code_point" else re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    d = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or d[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if d[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("unit", ["code_point", "line"])
def test_infill_equals_the_definition(docs, rows, unit):
    out = infill.fill_in_middle(docs, unit=unit)
    assert set(docs.columns) | set(infill.NAMES) == set(out.columns)
    got = out.withColumn("back", infill.restored(out["output"], out["form"])).collect()
    want = Counter((i, t, *infilled(i, t, unit)) for i, t in rows)
    assert Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    assert all(r.back == (r.text or "") and r["a.b"] == 1 and r["_fim"] == 3 and r["score"] == 4 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_infill_of_nothing(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_scan_recognises_any_sentinels_and_cuts_everywhere():
    rng = random.Random(4)
    dfa = infill.ByteDfa(("aab", "ab", "é<"))
    texts = ["".join(rng.choice("abé<😀") for _ in range(rng.randint(0, 700))) for _ in range(80)]
    draws = [(rng.randrange(2**32), rng.randrange(2**32)) for _ in texts]
    n, hits, cuts, offsets = infill.cut_texts(dfa, [t.encode() for t in texts], draws)
    for k, t in enumerate(texts):
        assert n[k] == len(t)
        assert hits[k] == sum(any(t.startswith(s, i - len(s) + 1) for s in ("aab", "ab", "é<") if i + 1 >= len(s)) for i in range(len(t)))
        assert cuts[k].tolist() == sorted(d % (len(t) + 1) for d in draws[k])
        assert offsets[k].tolist() == [len(t[:c].encode()) for c in cuts[k].tolist()]


def test_a_long_text_is_cut_in_linear_time():
    dfa, took = infill.ByteDfa(), []
    for size in (500_000, 2_000_000):
        text = ("naïve 日本 " * (size // 14)).encode()
        began = time.perf_counter()
        infill.cut_texts(dfa, [text], [(2**31 + 7, 99)])
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


def near(s, t):
    if len(s) > len(t):
        s, t = t, s
    if len(t) - len(s) > 1 or s == t:
        return False
    d = next((i for i in range(len(s)) if s[i] != t[i]), len(s))
    return s[d:] == t[d + 1 :] or (len(s) == len(t) and s[d + 1 :] == t[d + 1 :])


def grouped(words):
    out = {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        out[w] = (best if best is not None and words[best] >= 2 * n else None, n, len(others))
    rows = set()
    for w, (form, n, times) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, times, None if form is None else words[form]))
    return rows


@pytest.mark.parametrize("group_words", [variants.GROUP_WORDS, 3, 40])
@pytest.mark.parametrize("kind", ["dense", "runs", "shared", "wide"])
def test_spelling_groups_equal_brute_force(spark, kind, group_words):
    rng = random.Random(len(kind) + group_words)
    alphabet = {"dense": "ab", "runs": "aab", "shared": "abc", "wide": "aé日😀"}[kind]
    make = lambda: ("same" * 4 if kind == "shared" else "") + "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) + ("tail" if kind == "shared" and rng.random() < 0.5 else "")
    words = {make(): rng.choice([1, 2, 3, 4, 8, 16, 40]) for _ in range(260)}
    got = variants.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long").repartition(3), group_words=group_words)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == grouped(words)


def test_tries_find_each_pair_once():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(400)})
    tries = variants.ErrataTries(words, np.zeros(len(words), dtype=np.int64))
    a, b, common = tries.pairs()
    got = Counter(frozenset((words[x], words[y])) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert max(got.values()) == 1
    assert set(got) == {frozenset((s, t)) for s in words for t in words if near(s, t)}
    times = np.zeros(len(words), dtype=np.int64)
    for _, row, _, _ in tries.light():
        times[row] += 1
    assert times.max() <= math.log2(len(words)) + 1  # a word is merged at most log2(size) times


def test_corpus_words_equal_the_definition(spark, rows):
    texts = [(i, t) for i, t in rows] + [(i, f"Wörter WÖRTER wörter× señor Señor{i} x" + "lang" * 3) for i in range(400, 800)] + [(None, "Wörter Wörter")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in texts], "doc_id long, text string, run int, `wo.rd` string")
    count = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            count[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low] += 1
    want = {(w, n) for w, n in count.items() if len(w) >= 5 and n >= 3}
    assert {tuple(r) for r in variants.corpus_words(docs).collect()} == want
    assert any(len(w) < 17 and w not in ("wörter", "wÖrter", "señor") for w, _ in want)
    assert variants.spelling_groups(variants.corpus_words(docs.limit(0))).collect() == []


def brute_nearest(vectors, terms, weights, k, barred=()):
    scored = []
    asked = dict(zip(terms.tolist(), weights.tolist(), strict=True))
    for i, (t, w) in enumerate(vectors):
        total = 0.0
        for term, x in zip(t.tolist(), w.tolist(), strict=True):
            total += asked.get(term, 0.0) * x
        if total > 0 and i not in barred:
            scored.append((-total, i))
    return sorted(scored)[:k]


@pytest.mark.parametrize("block", [1, 4, 64])
def test_block_max_search_is_exact(block):
    rng = np.random.default_rng(6)
    idf = rng.uniform(1, 5, 30)
    vectors = [toxicity.unit_vector(Counter(dict.fromkeys(rng.choice(30, rng.integers(1, 8)).tolist(), int(rng.integers(1, 4)))), idf) for _ in range(300)]
    vectors += vectors[:80]  # equal vectors: ties go to the smaller number
    index = toxicity.BlockMaxIndex(vectors, block)
    for q in range(0, 380, 7):
        barred = np.array([q, (q * 3) % 380])
        for left_out in (None, barred):
            ids, cosines = index.nearest(*vectors[q], 15, left_out)
            want = brute_nearest(vectors, *vectors[q], 15, set() if left_out is None else set(left_out.tolist()))
            assert ids.tolist() == [i for _, i in want]
            assert cosines.tolist() == [-c for c, _ in want]


def toxic_corpus(n=700):
    rng = random.Random(12)
    plain = ["".join(rng.choice("abdehilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [rng.choice(plain) for _ in range(rng.randint(10, 120))], rng.random() < 0.2
        for _ in range(rng.randint(3, 6) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilecreep", "gruntling", "Foulmouth" + rng.choice(["ed", "er", "ing", "s"])]))
        rows.append((i, " ".join(words)))
        if i % 5:
            labels.append((i, int(toxic)))
    return rows, labels, rng


def test_toxicity_learns_from_its_folds_only_and_generalises(spark):
    rows, labels, _ = toxic_corpus()
    extra = [(None, "vilecreep"), (9001, None), (9002, ""), (9003, "123 456"), (3, rows[3][1]), (9004, "calm " * 250_000 + "vilecreep gruntling vilecreep")]
    docs = spark.createDataFrame([(i, t, "s", 1, 2, 3, 4, 5) for i, t in rows + extra], ODD).repartition(3)
    of = spark.createDataFrame([(i, 1, y, "x") for i, y in labels] + [(None, 1, 1, "x"), (5, 1, None, "x"), (10_000, 1, 1, "x")], "doc_id long, quality int, toxic int, `te.xt` string")
    model = toxicity.fit(docs, of)
    learned = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2}
    assert set(model.ids.tolist()) <= learned
    out = toxicity.toxicity(docs, model)
    assert set(out.columns) == set(docs.columns) | set(toxicity.NAMES)
    got = out.select("doc_id", "text", "score", "predicted", "neighbours", "`a.b`").collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    score, truth = {r.doc_id: r for r in got}, dict(labels)
    held = [i for i, _ in labels if i not in learned]
    assert sum(score[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert abs(sum(score[i].score for i in held) / len(held) - sum(truth[i] for i in held) / len(held)) < 0.05  # calibrated
    assert score[9001].score == score[9002].score == score[9003].score and score[9001].neighbours == []
    assert {int(n.id) for r in got for n in r.neighbours} <= learned
    flipped = of.withColumn("toxic", (1 - of["toxic"]).cast("int")).where("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2").unionByName(of.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"))
    again = toxicity.toxicity(docs, toxicity.fit(docs, flipped)).select("doc_id", "text", "score").collect()
    assert Counter((r.doc_id, r.text, r.score) for r in again) == Counter((r.doc_id, r.text, r.score) for r in got)


def test_toxicity_idf_covers_every_document_and_the_sample_is_bounded(spark):
    rows, labels, _ = toxic_corpus()
    docs, of = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, of, examples=200, terms=20)
    assert len(model.vocabulary) <= 20 and 120 < len(model.ids) < 280
    counts = [toxicity.term_counts(t, model.vocabulary) for _, t in rows]
    assert all(toxicity.held_terms(t, model.vocabulary, model.heads) == set(c) for (_, t), c in zip(rows, counts, strict=True))
    assert all(toxicity.term_counts(t, model.vocabulary, model.heads) == c for (_, t), c in zip(rows, counts, strict=True))
    for term in range(len(model.idf)):
        assert model.idf[term] == pytest.approx(math.log((len(rows) + 1) / (sum(term in c for c in counts) + 1)) + 1)


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, toxicity.fit(docs, none)).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), toxicity.fit(docs.limit(0), none)).collect() == []
    one = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, toxicity.fit(docs, one)).collect())


def test_calibration_rises_and_meets_the_rates():
    rng = np.random.default_rng(2)
    raw = rng.uniform(size=4000)
    labels = rng.uniform(size=4000) < raw**2
    knots, values = toxicity.calibration(raw, labels)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    got = np.interp(raw, knots, values)
    assert abs(got - raw**2).mean() < 0.06
