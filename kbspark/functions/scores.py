"""Score expressions.

Scores are rounded to ``DIGITS`` decimals before anything is ranked on them. Floating-point sums depend on how
rows are spread over tasks; rounding first, and breaking ties by id, makes every ranking the same on any cluster.
"""

from pyspark.sql import Column, functions as F

from kbspark import fixed_values as fv
from kbspark.functions import text as tx

DIGITS = 6


def rounded(score: Column) -> Column:
    return F.round(score.cast("double"), DIGITS)


def _count(flags: Column) -> Column:
    return F.size(F.filter(flags, lambda flag: flag))


def keyword_score(terms: Column, content: Column) -> Column:
    """Share of terms found, plus a bonus per occurrence, at most 1."""
    # A term without a visible character (an ideographic space, say) is never counted.
    hits = F.transform(terms, lambda term: F.when(
        tx.has_text(term), tx.occurrences(F.lower(content), F.lower(term))).otherwise(0))
    return score_of_hits(hits, tx.has_text(content))


def score_of_hits(hits: Column, visible: Column) -> Column:
    """The keyword score from the number of occurrences of each term in a text, and whether the text is visible."""
    found = F.size(F.filter(hits, lambda n: n > 0))
    total = F.aggregate(hits, F.lit(0), lambda acc, n: acc + n)
    score = F.least(
        F.lit(1.0),
        F.try_divide(found, F.size(hits)) + F.least(F.lit(fv.HIT_BONUS_MAX), total * F.lit(fv.HIT_BONUS)))
    return F.when(visible & (F.size(hits) > 0), rounded(score)).otherwise(0.0)


def exact_term_score(terms: Column, content: Column) -> Column:
    """Share of terms found, case ignored."""
    found = _count(F.transform(terms, lambda term: F.contains(F.lower(content), F.lower(term))))
    return (F.when(tx.has_text(content) & (F.size(terms) > 0), rounded(F.try_divide(found, F.size(terms))))
            .otherwise(0.0))


def symbol_score(terms: Column, content: Column) -> Column:
    """Share of symbol-like terms found, case kept; 0 without any such term."""
    symbols = F.filter(terms, tx.is_symbol_like)
    found = _count(F.transform(symbols, lambda term: F.contains(content, term)))
    return (F.when(tx.has_text(content) & (F.size(symbols) > 0),
                   rounded(F.try_divide(found, F.size(symbols))))
            .otherwise(0.0))


def max_normalised(score: Column, best: Column) -> Column:
    """``score / best``; null and non-positive scores give 0, ``best`` defaults to 1."""
    return F.when(score > 0, score / F.coalesce(best, F.lit(1.0))).otherwise(0.0)


def rerank_score(hybrid: Column, exact: Column, symbol: Column) -> Column:
    return rounded(fv.RERANK_HYBRID * hybrid + fv.RERANK_EXACT * exact + fv.RERANK_SYMBOL * symbol)
