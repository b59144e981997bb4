"""Text functions as Column expressions: all run in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Accented letters of the Latin blocks whose canonical form is one ASCII letter and marks, and those letters."""
    pairs = []
    for code in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code) and plain.isascii():
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _folding()
#: Consonants of each sound class, by script; the order of scripts matters where letters look alike.
SOUNDS = {
    "sinhala": {"K": "කඛගඝ", "C": "චඡජඣ", "T": "ටඨඩඪතථදධ", "P": "පඵබභ", "S": "සශෂ", "N": "මනණඞඤං", "Y": "ය", "R": "ර", "L": "ලළ", "V": "වහ"},
    "tamil": {"K": "க", "N": "ஞஙணநனம", "S": "சஸஶஷ", "C": "ஜ", "T": "டத", "R": "றர", "P": "ப", "Y": "ய", "L": "லளழ", "V": "வஹ"},
    "latin": {"K": "kgqx", "C": "cj", "P": "bp", "T": "dtf", "V": "vwh", "N": "mn", "R": "r", "L": "l", "Y": "y", "S": "sz"},
}


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once for a row, however often ``f`` names it and in whatever branch."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def unaccent(c: Column) -> Column:
    return F.translate(c, _ACCENTED, _PLAIN)


def normalise(c: Column) -> Column:
    """Lower case without accents and ASCII punctuation, single spaces (SC1)."""
    spaced = F.regexp_replace(unaccent(F.lower(c)), r"\p{Punct}+", " ")
    return F.trim(F.regexp_replace(spaced, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of letters and digits in lower case; null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phonetic(c: Column) -> Column:
    """Sound classes of the consonants of Sinhala, Tamil and Latin names, aspirates and repeats dropped (SC3)."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "([dtkpgbcj])h", "$1")
    for classes in SOUNDS.values():
        s = F.translate(s, "".join(classes.values()), "".join(k * len(v) for k, v in classes.items()))
    return F.regexp_replace(F.regexp_replace(s, "[^KCTPSNRLYVH]", ""), r"(.)\1+", "$1")


def phonetic_tokens(c: Column) -> Column:
    return F.array_join(F.transform(F.split(normalise(c), " "), phonetic), " ")


def strip_html(c: Column) -> Column:
    """Text without tags and entities, single spaces (SC6)."""
    bare = F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), "&[a-zA-Z#0-9]+;", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def content_hash(*parts: Column) -> Column:
    """SHA-1 of the parts joined by bars; a null counts as empty (SC7)."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def trigrams(c: Column) -> Column:
    """Distinct three-letter stretches of the lower-case text with a space at either end (SC15)."""
    padded = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3))))


def set_similarity(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sets given as distinct arrays; 0 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def trigram_similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))


def half_up(c: Column, digits: int) -> Column:
    """Rounding with halves towards plus infinity (SC25)."""
    return F.floor(c * 10**digits + 0.5) / float(10**digits)


def slice_text(c: Column, offset: int, most: int) -> Column:
    """``most`` characters from ``offset`` on, counted from 0 (SC10)."""
    return F.substring(c, offset + 1, most)


def plain(c: Column) -> Column:
    """Lower case without accents, pictures and signs: letters and digits of any script, single spaces (SC2)."""
    return F.trim(F.regexp_replace(unaccent(F.lower(c)), r"[^\p{L}\p{N}]+", " "))


def word_trigrams(c: Column) -> Column:
    """Distinct trigrams of each word with two spaces before it and one behind, as databases index them (SC16)."""
    each = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(tokens(c), each)))


def word_similarity(a: Column, b: Column) -> Column:
    """Jaccard coefficient of :func:`word_trigrams`; from 0.3 on a database calls two texts similar (SC16)."""
    return set_similarity(word_trigrams(a), word_trigrams(b))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank: an image's version from its tag, date and number (SC8), or the text for
    reranking from several fields (SC35)."""
    return F.coalesce(*[F.when(F.trim(c.cast("string")) != "", c.cast("string")) for c in columns])


def canonical(c: Column, synonyms: dict[str, str]) -> Column:
    """The word that a synonym stands for, spaces, dashes and case aside; others in that same form (SC27)."""
    squeezed = lambda x: "".join(x.lower().split()).replace("-", "")
    low = F.regexp_replace(F.lower(c), r"[\s-]+", "")
    if not synonyms:
        return low
    known = F.create_map(*[F.lit(x) for k, v in synonyms.items() for x in (squeezed(k), v)])
    return F.coalesce(F.try_element_at(known, low), low)


def listed(c: Column, is_array: bool) -> Column:
    """An array of the value, or the array itself; an empty one for null and blank (SC33)."""
    none = F.array().cast("array<string>")
    return F.coalesce(c, none) if is_array else F.when(F.trim(c) != "", F.array(c)).otherwise(none)


def overlaps(a: Column, b: Column) -> Column:
    """Whether two arrays of texts share one, case aside (SC33)."""
    low = lambda x: F.transform(x, lambda v: F.lower(v))
    return F.coalesce(F.arrays_overlap(low(a), low(b)), F.lit(False))


def known_values(fields: dict[str, bool]) -> Column:
    """The values of the named fields in lower case, without nulls; the flag says which are arrays (SC37)."""
    every = F.flatten(F.array(*[listed(F.col(k), many) for k, many in fields.items()]))
    return F.transform(F.filter(every, lambda v: v.isNotNull()), lambda v: F.lower(v))


def quantity(count: Column, factor: Column) -> Column:
    """A quantity in base units; what is unknown or not positive counts as 1 (SC38)."""
    real = lambda c: F.coalesce(F.when(c > 0, c.cast("double")), F.lit(1.0))
    return real(count) * real(factor)


def bigrams(c: Column) -> Column:
    """Each two words in a row of a text (WN10)."""
    w = tokens(c)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))


def stub_embedding(c: Column, dims: int = 8) -> Column:
    """A vector that follows from the text alone: each word counts in the dimension that its MD5 names (SC32)."""
    if 16 % dims == 0:  # the last of the eight digits decides
        slot = F.transform(tokens(c), lambda w: (F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(w), 8, 1)) - 1) % dims)
    else:
        slot = F.transform(tokens(c), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dims)
    return bound(slot, lambda slots: F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double")))


def image_hash(raw: bytes) -> str:
    """Bernstein's hash of bytes in 32 bits, as a key of what is cached for an image (SC29)."""
    h = 5381
    for byte in raw:
        h = (h * 33 ^ byte) & 0xFFFFFFFF
    return f"{h:08x}"
