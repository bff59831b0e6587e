"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquetry.llm.common import held, words

#: Frequent function words of English, French, Spanish and German.
STOP_WORDS = (
    "a and are as at be by for from he in is it of on or that the this to was with "
    "au dans de des du elle est et la le les pas pour que qui un une "
    "con del el en es los por se su y "
    "auf das dem der die ein eine für ich in ist mit nicht sich und von zu"
)


@dataclass(frozen=True)
class Rule:
    """Keep a text if low <= numerator / denominator <= high, or if it has fewer than min_words words."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    min_words: int = 0


#: The threshold table. Numerators and denominators are columns of `measures`. Shares of stop words and lines say little about
#: texts of a few words (a title has none, two equal lines are half of four), so these rules ask for 50 words.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.3),
    Rule("exclamations", "n_marks", "n_words", 0.0, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.02, 1.0, 50),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5, 50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 0.0, 0.9, 50),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_marks", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_repeat_words")
WINDOW = 5


def _stop_list() -> list[str]:
    base = dict.fromkeys(STOP_WORDS.split())
    return list(dict.fromkeys(v for w in base for v in (w, w.capitalize(), w.upper())))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of MEASURES, counted over each whole text without user functions or shuffles.

    A null text counts as an empty one, for which every measure is 0. Rows are judged one by one, so repeated
    rows, ties and null keys need no care. Working columns start with `_q_` and are dropped; columns of docs that
    bear the name of a measure are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = r"[^\x20\x09-\x0D]"
    long = lambda c: c.cast("long")
    docs = docs.drop(*[m for m in MEASURES if m != text_col and m in docs.columns])
    out = docs.withColumn("_q_words", words(F.col(text_col))).withColumn("_q_lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(blank)))
    # Hashes of the windows only tell which texts can repeat one; those few compare the words themselves.
    def window_hash(w: Column, i: Column) -> Column:
        return F.xxhash64(w, *[F.get("_q_words", i + k) for k in range(1, WINDOW)])

    out = out.withColumn("_q_n", F.size("_q_words")).withColumn("_q_hash", F.slice(F.transform("_q_words", window_hash), 1, F.greatest(F.col("_q_n") - (WINDOW - 1), F.lit(0))))
    out = out.withColumn("_q_again", F.size(F.array_distinct("_q_hash")) < F.size("_q_hash"))
    window = lambda i: F.struct(F.array_join(F.slice("_q_words", i + 1, WINDOW), " ").alias("w"), i.alias("i"))
    out = out.withColumn("_q_sorted", F.when(F.col("_q_again"), F.array_sort(F.transform(F.sequence(F.lit(0), F.col("_q_n") - WINDOW), window))))
    same = lambda x, k: F.coalesce(F.get("_q_sorted", k)["w"] == x["w"], F.lit(False))
    twice = F.transform("_q_sorted", lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    out = out.withColumn("_q_starts", F.when(F.col("_q_again"), F.array_sort(F.array_compact(twice))))
    # Each repeated window covers five words, or as many as lie before the next repeated window.
    covers = F.transform("_q_starts", lambda p, k: F.least(F.coalesce(F.get("_q_starts", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.aggregate(covers, F.lit(0), lambda a, b: a + b)
    stop = _stop_list()
    spaces = F.length(text) - F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        held(long(F.col("_q_n"))).alias("n_words"),
        long(F.length(text) - spaces).alias("word_chars"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.regexp_count(text, F.lit("!"))).alias("n_marks"),
        long(F.size(F.filter("_q_words", lambda w: w.isin(stop)))).alias("n_stop_words"),
        long(F.size("_q_lines")).alias("n_lines"),
        long(F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).alias("n_dup_lines"),
        long(F.size(F.filter("_q_lines", lambda x: x.rlike(r"^\s*[-*•]")))).alias("n_bullet_lines"),
        held(long(F.coalesce(F.when(F.col("_q_again"), repeated), F.lit(0)))).alias("n_repeat_words"),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> list[tuple[str, Column]]:
    """(name, passes) of each rule over the columns of `measures`; a zero denominator passes."""
    out = []
    for r in rules:
        ratio = F.col(r.numerator).cast("double") / F.nullif(F.col(r.denominator), F.lit(0))
        out.append((r.name, F.coalesce(ratio.between(r.low, r.high), F.lit(True)) | (F.col("n_words") < r.min_words)))
    return out


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Judge each text: the measures, base_failed, failed_rules (names) and kept.

    base_failed: fewer than ten words, or over a fifth of the words in five-word windows that the text repeats.
    kept: not base_failed and no rule of the table failed. Null and empty texts have no words and so fail.
    """
    compiled = compile_rules(rules)
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in compiled])) if compiled else F.array().cast("array<string>")
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    docs = docs.drop(*[c for c in ("base_failed", "failed_rules", "kept") if c in docs.columns])
    out = measures(docs, text_col).withColumns({"base_failed": base, "failed_rules": failed})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
