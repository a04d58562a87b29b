"""Similarity of words and names, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(c: Column) -> Column:
    """SC-19: distinct three-letter windows of each word, with two blanks before and one after."""
    spaced = F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(spaced, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def set_jaccard(a: Column, b: Column) -> Column:
    """SC-18: 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def is_subset(a: Column, b: Column, least: int = 2) -> Column:
    """SC-18: whether the smaller set, of ``least`` or more, is in the larger."""
    common, small = F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b))
    return (small >= least) & (common == small)


def trigram_similarity(a: Column, b: Column) -> Column:
    """SC-20."""
    return set_jaccard(trigrams(a), trigrams(b))


def word_similarity(query_grams: Column, query_words: Column, text_words: Column) -> Column:
    """SC-21: the largest share of the query's trigrams that a window of as many words of the
    text has; ``query_words`` is their number, ``text_words`` the array of the text's words."""
    last = F.greatest(F.size(text_words) - query_words + 1, F.lit(1))
    shares = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.size(F.array_intersect(query_grams, trigrams(F.array_join(F.slice(text_words, i, F.greatest(query_words, F.lit(1))), " ")))),
    )
    return F.when((F.size(query_grams) > 0) & (F.size(text_words) > 0), F.array_max(shares) / F.size(query_grams)).otherwise(F.lit(0.0))


def ordered_trigrams(c: Column) -> Column:
    """The trigrams of each word, in order and with repeats: an array for each word."""
    spaced = F.transform(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.transform(spaced, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))


def extent_similarity(query_grams: Column, word_grams: Column, *, strict: bool = False, least: float = 0.0) -> Column:
    """SC-21 as databases have it: the greatest Jaccard similarity of a set of trigrams to any run of the ordered trigrams of
    a text (``word_grams``: an array for each word); ``strict``: to any run of whole words. Runs of any length.

    From each trigram (word) on the run grows by one at a time, and its common and distinct trigrams are counted. A run
    whose distinct trigrams alone keep it under ``least`` is not looked at further; a result under
    ``least`` is then a lower bound.
    """
    units = word_grams if strict else F.transform(F.flatten(word_grams), lambda g: F.array(g))
    n, m = F.size(units), F.size(query_grams)
    kind = "struct<seen: array<string>, best: double>"

    def grown(a: Column, unit: Column) -> Column:
        seen = F.array_union(a["seen"], unit)
        common = F.size(F.array_intersect(seen, query_grams))
        both = F.struct(seen.alias("seen"), F.greatest(a["best"], common / (m + F.size(seen) - common)).alias("best")).cast(kind)
        return F.when(F.size(a["seen"]) * least <= m, both).otherwise(a) if least else both

    start = F.struct(F.array().alias("seen"), F.lit(0.0).alias("best")).cast(kind)
    # a best run begins with a trigram of the query, or a word that has one
    begins = lambda i: F.arrays_overlap(F.get(units, i - 1), query_grams)
    best = F.transform(F.filter(F.sequence(F.lit(1), n), begins), lambda i: F.aggregate(F.slice(units, i, n), start, grown)["best"])
    return F.when((m > 0) & (n > 0), F.coalesce(F.array_max(best), F.lit(0.0))).otherwise(F.lit(0.0))


def same_entity(a_name: Column, b_name: Column, a: Column, b: Column) -> Column:
    """SC-24: of two names and their token sets: Jaccard of one half or a subset of two or more;
    equal names where a set is empty."""
    common = F.size(F.array_intersect(a, b))
    half = 2 * common >= F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), a_name == b_name).otherwise(half | is_subset(a, b))
