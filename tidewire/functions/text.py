"""Text as Spark expressions: normal forms, keys, tokens and similarity."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def fold(text: Column) -> Column:
    """Lower case without the listed accents, white space squeezed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\s+", " "))


def unmarked(text: Column) -> Column:
    """Latin letters without their accents: Spark has no normal form among its functions, so a table made from Unicode's own decompositions maps them."""
    # a rule, not a list: every letter of two Latin blocks that is one ASCII letter and an accent
    pairs = [(c, d[0]) for c in map(chr, range(0xC0, 0x180)) if len(d := unicodedata.normalize("NFD", c)) == 2 and d[0].isascii()]
    return F.regexp_replace(F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs)), r"\p{Mn}+", "")


def plain_words(text: Column) -> Column:
    """Lower-case ASCII letters and digits alone, one space between words."""
    low = F.lower(text)
    ascii_only = F.octet_length(text) == F.char_length(text)  # such texts hold no marks, and the table is slow
    return F.trim(F.regexp_replace(F.when(ascii_only, low).otherwise(unmarked(low)), "[^a-z0-9]+", " "))


def squeezed(text: Column) -> Column:
    """No white space at the ends, one blank elsewhere."""
    return F.trim(F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"\s+", " "))


def normal_title(title: Column) -> Column:
    """Lower case, only letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def tokens(title: Column, stop: tuple[str, ...] = ()) -> Column:
    """Sorted distinct words of a normal title, stop words left out; null and blank titles have none."""
    words = F.filter(F.split(F.coalesce(normal_title(title), F.lit("")), " "), lambda w: w != "")
    words = F.array_sort(F.array_distinct(words))
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 where either side has none."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(fold(text), 256), 1, 16)


def row_uid(link: Column, title: Column) -> Column:
    return F.substring(F.md5(F.concat(F.coalesce(link, F.lit("")), F.coalesce(title, F.lit("")))), 1, 16)


def title_key(title: Column, size: int = 180) -> Column:
    """Lower-cased letters and digits alone, cut."""
    return F.substring(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]", ""), 1, size)


def slug(title: Column, size: int = 60) -> Column:
    """Folded words joined by hyphens, cut at a hyphen."""
    full = F.trim(F.regexp_replace(fold(title), "[^a-z0-9]+", " "))
    full = F.replace(full, F.lit(" "), F.lit("-"))
    cut = F.regexp_replace(F.substring(full, 1, size + 1), "-[^-]*$", "")
    return F.when(F.length(full) <= size, full).otherwise(cut)


def sentences(text: Column, least: int = 35) -> Column:
    """Sentences of at least ``least`` characters, the first of equal keys."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.array_distinct(F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) >= least))


def number_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\b\d+[\d.,]*\b"), F.lit(0))


def hits(text: Column, terms: tuple[str, ...]) -> Column:
    """The listed terms that the text holds, in order."""
    return F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))
