"""Canonical composition (NFC) as an expression of built-in functions.

The tables come from Python's ``unicodedata``. Most texts need nothing and only meet one pattern. The others are cut
into clusters, a character and those after it that may combine with it; only clusters that hold such are
decomposed, ordered by combining class and composed.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Conjoining letters: first of leads, vowels and tails, and of the syllables; how many vowels and tails. Fixed values.
LEAD, VOWEL, TAIL, SYLLABLE, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7, 0xAC00, 21, 28
LEADS, SYLLABLES = 19, 11172

#: A class of very few ranges of characters that are composed as they are: Latin letters, Arabic ones and their ligatures.
SAFE = r"\x00-\u02FF\u0600-\u060F\u061B-\u064A\u0660-\u066F\uFB50-\uFDFF"

_PAIR, _KEY = "﷐", "﷑"  # no characters, so in no text's tables


def _class(chars: set[int], gap: int = 1) -> str:
    """A character class of code points, as ranges; gaps of less than ``gap`` are filled."""
    out, points = [], sorted(chars)
    start = before = None
    for c in [*points, None]:
        if start is not None and (c is None or c > before + gap):
            out.append(f"\\u{start:04X}" if start == before else f"\\u{start:04X}-\\u{before:04X}")
            start = None
        if start is None:
            start = c
        before = c
    return "".join(out)


@cache
def _tables() -> tuple[str, str, str, str, str]:
    """Decompositions, compositions and combining classes as text for ``str_to_map``; the class of what may combine with
    what is before it; and that of all that may not be composed."""
    bmp = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not SYLLABLE <= c < SYLLABLE + SYLLABLES]
    full = {c: d for c in bmp if (d := unicodedata.normalize("NFD", chr(c))) != chr(c)}
    pairs = {}
    for c in full:
        one = [int(x, 16) for x in unicodedata.decomposition(chr(c)).split() if not x.startswith("<")]
        if len(one) == 2 and unicodedata.normalize("NFC", chr(c)) == chr(c):
            pairs[chr(one[0]) + chr(one[1])] = chr(c)
    classes = {c: n for c in bmp if (n := unicodedata.combining(chr(c)))}
    joins = set(classes) | {ord(p[1]) for p in pairs if len(p) == 2} | set(range(VOWEL, VOWEL + VOWELS)) | set(range(TAIL + 1, TAIL + TAILS))
    joins |= {c for c, d in full.items() if ord(d[0]) in joins}
    odd = joins | {c for c in full if unicodedata.normalize("NFC", chr(c)) != chr(c)}
    as_map = lambda d: _PAIR.join(f"{k}{_KEY}{v}" for k, v in d.items())
    return as_map({chr(c): d for c, d in full.items()}), as_map(pairs), as_map({chr(c): n for c, n in classes.items()}), _class(joins), _class(odd)


@cache
def rough() -> str:
    """A class of fewer ranges that has all that may not be composed."""
    odd = {c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and (unicodedata.combining(chr(c)) or unicodedata.normalize("NFC", chr(c)) != chr(c))}
    odd |= {ord(d) for c in range(0x300, 0xD7A4) for d in unicodedata.normalize("NFD", chr(c))[1:]}
    return _class({c for c in odd if c < 0x700}) + _class({c for c in odd if c >= 0x700}, 0x200)


def _map(text: str) -> Column:
    return F.str_to_map(F.lit(text), F.lit(_PAIR), F.lit(_KEY))


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def nfc(c: Column) -> Column:
    """Canonical composition of the characters of the Basic Multilingual Plane; others stay as they are."""
    decomposed, composed, classes, joins, odd = _tables()
    parts, pairs, rank = _map(decomposed), _map(composed), _map(classes)
    within = lambda x, a, n: (x >= a) & (x < a + n)

    def apart(x: Column) -> Column:
        s = F.ascii(x) - SYLLABLE
        tail = F.when(s % TAILS > 0, _char(TAIL + s % TAILS)).otherwise(F.lit(""))
        syllable = F.concat(_char(LEAD + F.floor(s / (VOWELS * TAILS))), _char(VOWEL + F.floor(s % (VOWELS * TAILS) / TAILS)), tail)
        return F.when(within(F.ascii(x), SYLLABLE, SYLLABLES), syllable).otherwise(F.coalesce(F.try_element_at(parts, x), x))

    def together(a: Column, b: Column) -> Column:
        """Two starters as one, or null."""
        x, y = F.ascii(a), F.ascii(b)
        lead = within(x, LEAD, LEADS) & within(y, VOWEL, VOWELS)
        tail = within(x, SYLLABLE, SYLLABLES) & ((x - SYLLABLE) % TAILS == 0) & within(y, TAIL + 1, TAILS - 1)
        return F.when(lead, _char(SYLLABLE + ((x - LEAD) * VOWELS + y - VOWEL) * TAILS)).when(tail, _char(x + y - TAIL)).otherwise(F.try_element_at(pairs, F.concat(a, b)))

    def step(a: Column, x: Column) -> Column:
        """``done`` is settled; ``base`` may still take marks, ``marks`` are those it has not taken, ``last`` the class of the last."""
        one = together(a["base"], x["ch"])
        joined = one.isNotNull() & (a["base"] != "") & (a["last"] < x["rank"])
        new = ~joined & (x["rank"] == 0)
        return F.struct(
            F.when(new, F.concat(a["done"], a["base"], a["marks"])).otherwise(a["done"]).alias("done"),
            F.when(joined, one).when(new, x["ch"]).otherwise(a["base"]).alias("base"),
            F.when(joined, a["marks"]).when(new, F.lit("")).otherwise(F.concat(a["marks"], x["ch"])).alias("marks"),
            F.when(joined, a["last"]).when(new, F.lit(-1)).otherwise(x["rank"]).alias("last"),
        )

    def cluster(x: Column) -> Column:
        chars = F.split(F.array_join(F.transform(F.split(x, ""), apart), ""), "")
        ranked = F.transform(chars, lambda y: F.struct(y.alias("ch"), F.coalesce(F.try_element_at(rank, y).cast("int"), F.lit(0)).alias("rank")))
        # marks sort within their run, between characters of class 0; the sort is stable by place
        run = F.transform(ranked, lambda y, i: F.struct(F.size(F.filter(F.slice(ranked, F.lit(1), i + 1), lambda z: z["rank"] == 0)).alias("run"), y["rank"].alias("rank"), i.alias("i"), y["ch"].alias("ch")))
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("base"), F.lit("").alias("marks"), F.lit(-1).alias("last"))
        return F.aggregate(F.array_sort(run), start, step, lambda a: F.concat(a["done"], a["base"], a["marks"]))

    # few ranges, as every character is held against them: exact where alphabets are, coarse beyond
    few = rough()
    clusters = F.regexp_extract_all(c, F.lit(rf"(?s)((?:[^{joins}]|^)[{joins}]*)"), F.lit(1))
    return F.when(c.rlike(f"[^{SAFE}]") & c.rlike(f"[{few}]"), F.array_join(F.transform(clusters, lambda x: F.when(x.rlike(f"[{odd}]"), cluster(x)).otherwise(x)), "")).otherwise(c)
