"""Texts of one very long line, and vectors with very large components."""

import time

import pytest
from pyspark.sql import functions as F

from marquetry.llm import secrets, topk


@pytest.mark.parametrize("unit", ['"key1":"value one",', "a=b;", 'x = ["q", ', "<a>b</a>", 'f("s",', 'password = "abcdef123", '])
def test_the_lexer_is_linear_in_a_single_line(unit):
    took = []
    for size in (500_000, 1_000_000, 2_000_000):
        text = unit * (size // len(unit))
        began = time.perf_counter()
        secrets.scan_text(text, secrets.MIN_SCORE)
        took.append(time.perf_counter() - began)
    assert took[2] < 3.2 * took[1] + 0.5 and took[1] < 3.2 * took[0] + 0.5


def test_indentation_is_that_of_the_target_s_own_line():
    text = "a = 1; b = 2\n\n  token_name = 'x'\n    password = 'hunter2hunter2'\nkey = token_name\n" * 3
    lines = text.split("\n")
    found = secrets.scan_text(text, secrets.MIN_SCORE)[1]
    assert any(text[a:b] in lines[3] for a, b, _ in found)


@pytest.mark.parametrize("large", [1e17, 1e300, -1e300, 2.0**40])
def test_scores_beyond_64_bits_are_an_error(spark, large):
    rows = spark.createDataFrame([(i, [float(i), large if i == 3 else 1.0]) for i in range(8)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(rows, F.col("vec_id") % 2 == 0)


def test_scores_beyond_53_bits_are_exact(spark):
    value = [[2**20 + i / 256, 2**19 + (i * 7 % 5) / 256, -3.0 * i] for i in range(40)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(value)], "vec_id long, embedding array<double>")
    whole = [[int(256 * x // 1) for x in v] for v in value]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(rows, F.col("vec_id") % 5 == 0, k=3).collect()}
    for q in range(0, 40, 5):
        best = sorted((-sum(x * y for x, y in zip(whole[q], whole[i], strict=True)), i) for i in range(40) if i != q)[:3]
        assert [got[q, k + 1] for k in range(3)] == [(i, -s) for s, i in best]
