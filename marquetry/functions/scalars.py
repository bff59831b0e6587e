"""Scalar functions as column expressions."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Sequence
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_price(text: Column) -> Column:
    """Dollars from price text: blank or text with `free` is 0; every character but digits and points is dropped (a sign, too); else null."""
    bare = F.regexp_replace(text, "[^0-9.]", "")
    free = (F.trim(text) == "") | F.lower(text).contains("free")
    return F.when(text.isNull(), F.lit(None).cast("double")).when(free, F.lit(0.0)).otherwise(bare.try_cast("double"))


def parse_discount(text: Column) -> Column:
    """A rate from percent text; a value of at most 1 is a rate already, so `1%` is 1."""
    value = F.regexp_replace(text, "[^0-9.]", "").try_cast("double")
    return F.when(value > 1, value / 100).otherwise(value)


def to_cents(amount: Column) -> Column:
    """Whole cents, ties to even."""
    return F.bround(amount * 100, 0).cast("long")


def normalize_label(text: str | None) -> str | None:
    """HTML entities resolved, NFKC, white space collapsed; null if nothing is left."""
    if text is None:
        return None
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(text))).strip() or None


@F.pandas_udf(T.StringType())
def normalized_label(texts: pd.Series) -> pd.Series:
    """`normalize_label` in Arrow batches: no built-in function resolves entities or NFKC."""
    known = {t: normalize_label(t) for t in texts.dropna().unique()}
    return texts.map(known)


def label_tokens(text: Column, separator: str = ",") -> Column:
    """Sorted distinct labels of a separated list; ASCII clean-up only (trim and collapse)."""
    each = F.transform(F.split(text, re.escape(separator)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: x != "")))


def primary_label(text: Column) -> Column:
    """The first label in code point order; null for none."""
    return F.array_min(label_tokens(text))


def activity_band(activity: Column, bounds: Sequence[int]) -> Column:
    """Index of the largest lower bound that is at most the activity; -1 below the first."""
    return F.aggregate(F.array(*[F.lit(int(b)) for b in bounds]), F.lit(-1), lambda n, b: n + F.when(b <= activity, F.lit(1)).otherwise(F.lit(0)))


def observed_confidence(playtime: Column, alpha_o: float, alpha_p: float, tau: float) -> Column:
    """1 + alpha_o + alpha_p * min(log1p(playtime), tau) of an observed edge."""
    return F.lit(1.0) + F.lit(float(alpha_o)) + F.lit(float(alpha_p)) * F.least(F.log1p(playtime), F.lit(float(tau)))


def dcg_prefix(k: int) -> list[float]:
    """Sums of 1 / log2(rank + 1) over ranks 1..n, for n from 0 to k."""
    out = [0.0]
    for rank in range(1, k + 1):
        out.append(out[-1] + 1.0 / math.log2(rank + 1))
    return out


def expected_recall(above: Column, tied: Column, k: int) -> Column:
    """Chance that a target among `tied` equal scores, `above` ones higher, is in the first k of a random order of ties."""
    room = F.least(F.greatest(F.lit(k) - above, F.lit(0)), tied)
    return room.cast("double") / tied


def expected_ndcg(above: Column, tied: Column, k: int) -> Column:
    """Expected gain of the target under a random order of ties, by prefix sums of discounts."""
    prefix = F.array(*[F.lit(x) for x in dcg_prefix(k)])
    at = lambda n: F.get(prefix, F.least(n, F.lit(k)).cast("int"))
    return (at(above + tied) - at(above)) / tied


def expected_rank(above: Column, tied: Column) -> Column:
    return above + (tied + 1) / F.lit(2.0)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in one order of summation."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def logit(rate: Column) -> Column:
    return F.log(rate / (1.0 - rate))


def logistic(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow on either side."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


@F.pandas_udf(T.DoubleType())
def probit(rates: pd.Series) -> pd.Series:
    """Normal quantile; no built-in function has it."""
    normal = NormalDist()
    return rates.map(lambda r: normal.inv_cdf(r) if 0.0 < r < 1.0 else None)


@F.pandas_udf(T.DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * math.erfc(-x / math.sqrt(2.0)))


@F.pandas_udf(T.DoubleType())
def python_round3(values: pd.Series) -> pd.Series:
    """Rounding to three places on the binary double, which neither round nor bround gives."""
    return values.map(lambda x: None if pd.isna(x) else round(float(x), 3))


def clip_rate(rate: Column, n_users: Column | int) -> Column:
    """Rates kept half a count off 0 and 1."""
    floor = F.lit(0.5) / (n_users if isinstance(n_users, Column) else F.lit(float(n_users)))
    return F.least(F.greatest(rate, floor), F.lit(1.0) - floor)


def shift_scale(score: Column, low: Column, q05: Column, q95: Column) -> Column:
    span = F.greatest(q95 - q05, F.lit(1e-6))
    return F.least(F.greatest((score - low) / span, F.lit(0.0)), F.lit(1e6))


def robust_softplus(score: Column, median: Column, q25: Column, q75: Column) -> Column:
    scale = F.greatest(q75 - q25, F.lit(1e-6))
    return F.log1p(F.exp(F.least(F.greatest((score - median) / scale, F.lit(-40.0)), F.lit(40.0))))


def affine_valuation(score: Column, a: float, b: float, floor: bool = True) -> Column:
    value = F.lit(float(a)) + F.lit(float(b)) * score
    return F.greatest(value, F.lit(0.0)) if floor else value


def float_slug(value: float) -> str:
    """A number as part of an identifier."""
    return f"{float(value):.12g}".translate({ord("-"): "m", ord("."): "p", ord("+"): None})
