"""External induced sorting against sorted slices, with spills, runs and recursion forced, and its memory."""

import random
import tracemalloc

import numpy as np
import pytest

from marquetry.llm import suffixes


def checked(text, cap, **more):
    report = {}
    found = list(suffixes.sorted_suffixes(np.array(text, dtype=np.int64), cap, report=report, **more))
    at = [int(x) for p, _ in found for x in p]
    shared = [int(x) for _, s in found for x in s]
    want = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    assert at == want

    def prefix(a, b):
        k = 0
        while a + k < len(text) and b + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        return min(k, cap)

    assert shared == [0][: len(want)] + [prefix(a, b) for a, b in zip(want, want[1:], strict=False)]
    return report


@pytest.mark.parametrize("seed", range(6))
def test_random(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.3:
            text = text + text[: len(text) // 2] + text
        checked(text, rng.choice([3, 50, 300]), budget=rng.choice([10, 1000, 1 << 20]), base=rng.choice([1, 2, 8, 1000]))


@pytest.mark.parametrize("symbols", [2, 4, 300])
def test_recursion_runs_and_spills(symbols, tmp_path):
    rng = random.Random(symbols)
    text = [rng.randrange(symbols) for _ in range(1500)]
    report = checked(text + text[:700] + text[300:], 50, budget=3000, base=4, scratch=str(tmp_path))
    assert report["levels"] >= 2 and report["spills"] > 10
    assert list(tmp_path.iterdir()) == []


def test_runs_and_periods():
    checked([0] * 200, 50)
    checked([0, 1] * 100, 255, base=1)
    checked(list(range(100)) * 2, 300, base=4)
    checked([70_000, 1, 70_000], 5)


def test_run_sort_merges_in_order(tmp_path):
    rng = np.random.default_rng(2)
    disk = suffixes.Disk(str(tmp_path), 1 << 13)
    runs, keys = suffixes.RunSort(disk), []
    for _ in range(50):
        part = rng.integers(0, 500, 37).astype(np.uint64)
        keys.append(part)
        runs.add(part, part.astype(np.int64) * 3)
    got = list(runs.chunks())
    assert len(got) > 5
    assert (np.concatenate([k for k, _ in got]) == np.sort(np.concatenate(keys))).all()
    assert (np.concatenate([v for _, v in got]) == 3 * np.sort(np.concatenate(keys)).astype(np.int64)).all()


def test_memory_follows_the_budget_not_the_text(tmp_path):
    rng, peaks = np.random.default_rng(3), []
    passage = rng.integers(0, 30, 400)

    def pieces(n):
        for _ in range(n // 1000):
            yield np.r_[rng.integers(0, 30, 600), passage]

    for n in (250_000, 2_000_000):
        tracemalloc.start()
        count = sum(len(p) for p, _ in suffixes.sorted_suffixes(pieces(n), 50, str(tmp_path), budget=1 << 20))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert count == n
    assert peaks[1] < 1.25 * peaks[0] and peaks[1] < 5 << 19  # eight times the text
