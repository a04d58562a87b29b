"""Rule classifiers (pure column logic)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chainproof.functions import lexicons as X
from chainproof.functions.text import grade_tier, is_protected, is_successor, normalize, severity_from_text

SOUND = ("prophet", "companion", "reliable")
WEAK = ("weak", "abandoned", "fabricator")


def check_dates(student_years: Column, teacher_years: Column, heard: int = 93, life: int = 100) -> Column:
    """CL-1: unknown, impossible or possible from arrays of years of death."""
    s_min, s_max, t_min, t_max = F.array_min(student_years), F.array_max(student_years), F.array_min(teacher_years), F.array_max(teacher_years)
    none = (F.coalesce(F.size(student_years), F.lit(0)) < 1) | (F.coalesce(F.size(teacher_years), F.lit(0)) < 1)
    return F.when(none, "unknown").when((s_min - t_max > heard) | (t_min - s_max > life), "impossible").otherwise("possible")


def link_status(resolved: Column, dates: Column, denied: Column, edge: Column) -> Column:
    """CL-2: precedence of an unresolved end, dates, a denial, a recorded edge."""
    return F.when(~resolved, "unknown").when(dates == "impossible", "impossible").when(denied, "impossible").when(edge, "attested").otherwise(dates)


def tadlis_concern(tier: Column, strength: Column, verb: Column) -> Column:
    """CL-3: a listed student of tier 3 or more with an ambiguous verb, unless hearing is attested."""
    return F.coalesce((tier >= 3) & (strength == "ambiguous"), F.lit(False)) & ~F.coalesce(verb == "samaa", F.lit(False))


def effective_grade(tabaqat: Column, grade_text: Column, bucket: Column, harshest: Column) -> Column:
    """CL-4: companion for the protected class, else the harsher of bucket and text."""
    base = F.coalesce(harshest, bucket, F.lit("unknown"))
    said = severity_from_text(F.coalesce(grade_text, F.lit("")))
    worse = F.when(said.isNull() | (grade_tier(base) <= grade_tier(said)), base).otherwise(said)
    return F.when(is_protected(tabaqat, grade_text, bucket, "grade"), "companion").otherwise(worse)


def verdict(broken: Column, weak: Column, matched: Column, known: Column, sound: Column) -> Column:
    """CL-5."""
    return F.when(broken, "broken").when(weak, "daif").when(~matched | ~known, "needs_review").when(sound, "sahih_candidate").otherwise("hasan_candidate")


def break_type(breaks: Column, first: Column, last: Column) -> Column:
    """CL-6 on WN-5: the number of impossible links and their first and last positions."""
    run = (breaks > 1) & (last - first + 1 == breaks)
    return F.when(F.coalesce(breaks, F.lit(0)) == 0, "none").when(first == 0, "muallaq").when(run, "mudal").otherwise("munqati")


def is_mursal(raised: Column, tabaqat: Column, grade_text: Column, bucket: Column) -> Column:
    """CL-7, of the last entity that is not the appended source."""
    return raised & F.coalesce(tabaqat, F.lit("")).contains(X.SUCCESSOR) & ~is_protected(F.lit(""), grade_text, bucket, "ascription")


def attribution(text: Column, known: Column, tabaqat: Column, grade_text: Column, bucket: Column, divine: str = X.DIVINE, raised: str = X.RAISED, in_effect: str = X.RAISED_IN_EFFECT) -> Column:
    """CL-8: qudsi, marfu_sarih, marfu_hukman, mawquf, maqtu or unknown."""
    t = normalize(F.coalesce(text, F.lit("")))
    protected = known & is_protected(tabaqat, grade_text, bucket, "ascription")
    return (
        F.when(t.rlike(divine) & t.rlike(raised), "qudsi").when(t.rlike(raised), "marfu_sarih").when(t.rlike(in_effect) & protected, "marfu_hukman")
        .when(~known, "unknown").when(protected, "mawquf").when(is_successor(tabaqat), "maqtu").otherwise("unknown")
    )


def spread_class(least: Column, level: Column, protected: Column) -> Column:
    """CL-9 on AG-6; null where nothing was aligned."""
    return (
        F.when(least.isNull(), "unknown").when(least >= X.MANY, "mutawatir").when(least >= X.SOME, "mashhur").when(least == X.TWO, "aziz")
        .when((level == 0) & F.coalesce(protected, F.lit(False)), "gharib_mutlaq").otherwise("gharib_nisbi")
    )


def corroboration(least: Column, matches: Column) -> Column:
    """Independent ways: the bottleneck, or all matches where nothing was aligned, at most the matches."""
    return F.least(F.coalesce(least, matches), matches)


def refined_rank(verdict_: Column, ways: Column) -> Column:
    """CL-10."""
    return (
        F.when(verdict_ == "sahih_candidate", "sahih_li_dhatih")
        .when(verdict_ == "hasan_candidate", F.when(ways >= 2, "sahih_li_ghayrih").otherwise("hasan_li_dhatih"))
        .when(verdict_ == "daif", F.when(ways >= 3, "hasan_li_ghayrih").otherwise("daif"))
        .when(verdict_ == "broken", "broken").otherwise("needs_review")
    )


def acceptance(rank: Column) -> Column:
    """CL-11."""
    return F.when(rank.isin("sahih_li_dhatih", "sahih_li_ghayrih", "hasan_li_dhatih", "hasan_li_ghayrih"), "maqbul").when(rank.isin("daif", "broken"), "mardud").otherwise("indeterminate")


def popularity(n: Column) -> Column:
    """AG-11's note."""
    return F.when(n == 0, "none").when(n >= 10, "famous").when(n >= 3, "known").otherwise("rare")


def attestation_label(links: Column, attested: Column, heard: Column) -> Column:
    """AG-8's label."""
    return F.when((links > 0) & (heard == links), "all_heard").when(heard > 0, "some_heard").when((links > 0) & (attested == links), "all_attested").when(attested > 0, "some_attested").otherwise("none")
