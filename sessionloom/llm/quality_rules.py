"""Quality rules: a threshold table compiled into one projection of length, symbol, stop-word and line ratios.

Everything is built-in functions on one row: no shuffle, no Python, and a document costs n log n in its own words.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, words

#: The commonest function words of the corpus languages.
STOP_WORDS = {
    "en": "the of and to in is it that for was on are as with by he be this have from or an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur avec elle".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
}
SYMBOLS = "#*$%&|<>"
WINDOW = 5


class Rule(NamedTuple):
    """``low`` * denominator <= numerator + ``slack``, and numerator <= ``high`` * denominator; None sets no bound."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None
    slack: float = 0.0


#: Chosen once on the labelled tables: every bound leaves a wide margin to the documents labelled as good.
DEFAULT_RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 0.06, None, 1.0),
    Rule("duplicate_lines_per_line", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 1.5, None),
)


def measures(text: Column, stop_words: dict[str, list[str]] | None = None) -> Column:
    """Struct of the counts of one text; null and empty texts have zeros.

    n_words, word_chars (code points in words), n_symbols, n_lines (lines with a word), n_dup_lines (such lines equal to
    an earlier one), n_stop_words (as written or with a capital) and n_repeat_words: words inside 5-word windows that
    occur twice or more, the first occurrence included. Windows are compared by a 64-bit hash of their five words.
    """
    listed = sorted({form for group in (stop_words or STOP_WORDS).values() for w in group for form in (w, w.capitalize())})
    safe = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        lines = F.filter(F.split(safe, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
        line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        return let(line_counts, lambda line: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(safe, f"[^{SYMBOLS}]+", "")).cast("bigint").alias("n_symbols"),
            line["n"].cast("bigint").alias("n_lines"), line["dup"].cast("bigint").alias("n_dup_lines"),
            F.size(F.filter(w, lambda x: x.isin(listed))).cast("bigint").alias("n_stop_words"),
            _repeated_words(w).alias("n_repeat_words")))

    return let(words(text), of_words)


def _repeated_words(w: Column) -> Column:
    last = F.size(w) - WINDOW
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    # Most texts have no window twice; only the others are sorted.
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h))).cast("bigint")


def _covered(hashes: Column) -> Column:
    """Words under the windows whose hash occurs twice: neighbours after sorting show which, their starts then tell how far they reach."""
    ordered = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = F.filter(s, lambda e, j: F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False))
                        | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)))
        return F.array_sort(F.transform(same, lambda e: e["i"]))

    def reach(starts: Column) -> Column:
        spans = F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(spans, F.lit(0), lambda total, x: total + x)

    return let(let(ordered, twice), reach)


def passes(counts: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Whether a struct of counts satisfies every rule."""
    verdict = F.lit(True)
    for rule in rules:
        top, base = counts[rule.numerator].cast("double"), counts[rule.denominator].cast("double")
        if rule.low is not None:
            verdict = verdict & (top + rule.slack >= base * rule.low)
        if rule.high is not None:
            verdict = verdict & (top <= base * rule.high)
    return verdict


def failed_rules(counts: Column, rules: tuple[Rule, ...] = DEFAULT_RULES) -> Column:
    """Array of the names of the rules that a struct of counts violates."""
    return F.filter(F.array(*[F.when(~passes(counts, (r,)), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())


def base_failed(counts: Column) -> Column:
    """Fewer than ten words, or over a fifth of them in repeated windows."""
    return (counts["n_words"] < 10) | (100 * counts["n_repeat_words"] > 20 * counts["n_words"])


def judge(docs: DataFrame, text: str = "text", out: str = "quality", rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """``docs`` with a struct column ``out``: the counts, ``base_failed``, ``failed`` (rule names) and ``kept``.

    Null and empty texts fail the base. All other columns pass through; ``out`` must be a free name. Repeated rows are
    judged alike and an empty table stays empty.
    """
    if out.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"column {out} exists already")
    verdict = let(measures(F.col(text)), lambda c: F.struct(
        *[c[n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")],
        base_failed(c).alias("base_failed"), failed_rules(c, rules).alias("failed"),
        (~base_failed(c) & passes(c, rules)).alias("kept")))
    return docs.withColumn(out, verdict)
