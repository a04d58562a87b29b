"""Scalar functions on text columns. All are expressions of built-in functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainproof.functions import lexicons as X
from chainproof.functions.nfc import nfc


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def squeezed(c: Column) -> Column:
    """White space as single blanks, without ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize(c: Column) -> Column:
    """SC-1: composes (NFC), deletes marks, folds letter forms, squeezes blanks. Idempotent."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    # vowel signs go first: they neither take part in a composition nor bar one, and are in most texts with marks
    full = lambda x: folded(once(F.regexp_replace(x, X.VOWEL_SIGNS, ""), nfc))
    return once(c, lambda x: F.when(F.rlike(x, F.lit(X.NOT_LATIN)), full(x)).otherwise(squeezed(x)))


def folded(c: Column) -> Column:
    """SC-1 of text that is composed already."""
    return squeezed(F.translate(F.regexp_replace(c, X.MARKS, ""), X.FOLD_FROM, X.FOLD_TO))


def strip_phrases(c: Column, pattern: str = X.HONORIFICS) -> Column:
    """SC-2: without honorific phrases."""
    return squeezed(F.regexp_replace(c, rf"\s*(?:{pattern})\s*", " "))


def digits_to_ascii(c: Column, digits: str = X.EASTERN_DIGITS) -> Column:
    """SC-3."""
    return F.translate(c, digits, "0123456789")


def strip_footnote_refs(c: Column, digits: str = X.EASTERN_DIGITS) -> Column:
    """SC-4: without numbers in parentheses."""
    return squeezed(F.regexp_replace(c, rf"\s*\(\s*[{digits}0-9]+\s*\)\s*", " "))


def words(c: Column) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def short_name(c: Column, fallback: int = 4, son_of: Sequence[str] = X.SON_OF) -> Column:
    """SC-5: three words if the second says whose child, else the first ``fallback``."""
    w = words(F.regexp_replace(c, "[،:]", " "))
    take = F.when((F.size(w) >= 3) & F.element_at(F.concat(w, _strings(["", ""])), 2).isin(*son_of), 3).otherwise(fallback)
    return F.when(F.size(w) == 0, c).otherwise(F.array_join(F.slice(w, F.lit(1), take), " "))


def name_tokens(c: Column, noise: Sequence[str], affixes: Sequence[str]) -> Column:
    """SC-6: distinct words of identity: two letters or more, neither noise nor affix."""
    out = _strings([*noise, *affixes])
    return F.array_distinct(F.filter(words(c), lambda w: (F.length(w) >= 2) & ~F.array_contains(out, w)))


def nullable(c: Column) -> Column:
    """Null for the second null marker too."""
    return F.nullif(c, F.lit("-"))


def parse_years(c: Column) -> Column:
    """SC-7: every number over 0 and under 2000; none gives an empty array."""
    runs = F.regexp_extract_all(F.coalesce(nullable(c), F.lit("")), F.lit(r"([0-9]+)"), F.lit(1))
    years = F.transform(runs, lambda x: F.when(F.length(F.ltrim(x, F.lit("0"))) <= 4, x.cast("int")))
    return F.filter(years, lambda y: (y > 0) & (y < 2000))


def primary_year(c: Column) -> Column:
    """SC-8: struct of the smallest year and whether there are several; null if there is none."""
    y = parse_years(c)
    return F.when(F.size(y) > 0, F.struct(F.array_min(y).alias("year"), (F.size(y) > 1).alias("has_alternatives")))


def rank_label_short(c: Column, ordinals: Sequence[str] = X.ORDINALS, prefix: str = X.ORDINAL_PREFIX) -> Column:
    """SC-9: the ordinal that the text holds, else the text cut to 18 letters if over 20."""
    t = F.trim(nullable(c))
    found = F.regexp_extract(t, "(" + "|".join(ordinals) + ")", 1)
    return F.when(found != "", F.concat(F.lit(prefix), found)).when(F.length(t) > 20, F.concat(F.substring(t, 1, 18), F.lit("…"))).otherwise(t)


def cities(c: Column) -> Column:
    """Array of the places in a separated list, in order, without blanks and repeats."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[،,;]"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "-")))


def city_set(c: Column) -> Column:
    """SC-10: normalised places."""
    return F.array_distinct(F.transform(cities(c), normalize))


def combine_cities(*columns: Column) -> Column:
    """SC-10: one list of several, in order of first appearance; null if all are empty."""
    joined = F.array_join(F.array_distinct(F.concat(*[cities(c) for c in columns])), "، ")
    return F.when(joined != "", joined)


def coalesce_overlay(base: Column, overlay: Column) -> Column:
    """SC-11: the overlay where the base has no value."""
    return F.coalesce(nullable(base), overlay)


def join_overlay(base: Column, overlay: Column) -> Column:
    """SC-11: both, separated, without separators at the ends."""
    return F.btrim(F.concat(F.coalesce(nullable(base), F.lit("")), F.lit("، "), F.coalesce(overlay, F.lit(""))), F.lit("، "))


def is_mention_only(c: Column, verbs: Sequence[str] = X.MENTION_VERBS) -> Column:
    """SC-12: false for null."""
    return F.coalesce(F.trim(c).rlike(r"^(" + "|".join(verbs) + r")\s"), F.lit(False))


def _lookup(c: Column, values: dict, default: object) -> Column:
    m = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(m, F.coalesce(c, F.lit(""))), F.lit(default))


def grade_tier(c: Column, tiers: dict[str, int] = X.GRADE_TIERS) -> Column:
    """SC-13: 3 for unknown buckets and null."""
    return _lookup(c, tiers, 3)


def grade_label(c: Column, labels: dict[str, str] = X.GRADE_LABELS, default: str = X.UNKNOWN_LABEL) -> Column:
    """SC-13."""
    return _lookup(c, labels, default)


def severity_from_text(c: Column, patterns: Sequence[tuple[str, str]] = X.SEVERITY) -> Column:
    """SC-14: the bucket of the first pattern that the text holds, else null."""
    return F.coalesce(*[F.when(c.rlike(p), F.lit(b)) for p, b in patterns])


def tag_reasons(c: Column, patterns: Sequence[tuple[str, str, str]] = X.REASONS) -> Column:
    """SC-15: reasons of all patterns that the text holds, in their order."""
    return F.array_compact(F.array(*[F.when(c.rlike(p), F.lit(r)) for p, r, _ in patterns]))


def formula_strength(c: Column, explicit: Sequence[str] = X.EXPLICIT) -> Column:
    """SC-17."""
    return F.when(c.isNull(), "unknown").when(c.isin(*explicit), "explicit").otherwise("ambiguous")


def cache_key(version: str, c: Column) -> Column:
    """SC-22: hash of the version and the normalised text."""
    return F.sha2(F.concat_ws(":", F.lit(version), normalize(F.coalesce(c, F.lit("")))), 256)


def edge_direction(subject: Column, other: Column, phrase: Column, teacher_phrase: str = X.TEACHER_PHRASE) -> tuple[Column, Column]:
    """SC-23: (student, teacher) of a fact's subject and other party."""
    taught = F.coalesce(F.trim(phrase).startswith(teacher_phrase), F.lit(False))
    return F.when(taught, other).otherwise(subject), F.when(taught, subject).otherwise(other)


def printed_grade(c: Column) -> Column:
    """SC-25: sahih, hasan, daif or other; null stays null."""
    first = [("(?i)sahih", "sahih"), ("(?i)hasan", "hasan"), ("(?i)da'?i?f", "daif"), ("صحيح", "sahih"), ("حسن", "hasan"), ("ضعيف", "daif")]
    return F.when(c.isNotNull(), F.coalesce(*[F.when(c.rlike(p), F.lit(g)) for p, g in first], F.lit("other")))


# Predicates


def is_protected(tabaqat: Column, grade_text: Column, bucket: Column, profile: str = "ascription", profiles: dict = X.PROTECTED) -> Column:
    """PF-2: membership of the protected class by one of the profiles; nulls count as empty."""
    on_tabaqat, on_text, on_bucket = profiles[profile]
    out = F.coalesce(tabaqat, F.lit("")).rlike(on_tabaqat) | F.coalesce(grade_text, F.lit("")).rlike(on_text)
    return out | F.coalesce(bucket == "companion", F.lit(False)) if on_bucket else out


def is_successor(tabaqat: Column, mark: str = X.SUCCESSOR, generations: str = X.SUCCESSOR_GENERATIONS, never: str = X.NOT_SUCCESSOR) -> Column:
    """PF-3."""
    t = F.coalesce(tabaqat, F.lit(""))
    return t.contains(mark) | (t.rlike(generations) & ~t.rlike(never))


def min_length(c: Column, n: int) -> Column:
    """PF-4: false for null."""
    return F.coalesce(F.length(c) >= n, F.lit(False))


def input_status(c: Column, most: int = 4000) -> Column:
    """PF-6: ok, missing (null or blank) or too_long."""
    return F.when(c.isNull() | (F.trim(c) == ""), "missing").when(F.length(c) > most, "too_long").otherwise("ok")
