"""Scores, bands and ordered decisions over texts; the word lists are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.operators.classify import clamp, count_hits


def any_of(text: Column, terms: Sequence[str]) -> Column:
    return count_hits(text, tuple(terms)) > 0


def relevance(text: Column, regional: Sequence[str], impact: Sequence[str], service: Sequence[str], strong: Sequence[str], timely: str, poor: Sequence[str]) -> Column:
    """14 for a regional term, 10 for each impact term until 40 is reached, 12 and 10 for service and strong
    sources, 6 for a match of the pattern ``timely``; less 10 under 160 characters and 20 for poor topics; 0 to 100. A null text scores as an empty one.
    """
    text = F.coalesce(text, F.lit(""))
    base = F.when(any_of(text, regional), 14).otherwise(0)
    # terms count only while the score before them is under 40
    room = F.ceil((40 - base) / F.lit(10)).cast("int")
    score = base + 10 * F.least(count_hits(text, tuple(impact)), room)
    score = score + F.when(any_of(text, service), 12).otherwise(0) + F.when(any_of(text, strong), 10).otherwise(0)
    score = score + F.when(text.rlike(timely), 6).otherwise(0) - F.when(F.length(text) < 160, 10).otherwise(0) - F.when(any_of(text, poor), 20).otherwise(0)
    return clamp(score, 0, 100)


def band(score: Column, *steps: tuple[int, str], least: str) -> Column:
    """Name of the first step (in falling order) that the score reaches, else ``least``."""
    out = F.lit(least)
    for low, name in reversed(steps):
        out = F.when(score >= low, name).otherwise(out)
    return out


def opportunity(text: Column, base: Column, strong: Sequence[str], weak: Sequence[str], bonus: Column) -> Column:
    """The base, 12 for each of the first five strong terms that the text holds, less 20 for a weak one, and a bonus; 0 to 100."""
    return clamp(base + 12 * F.least(count_hits(text, tuple(strong)), F.lit(5)) - F.when(any_of(text, weak), 20).otherwise(0) + bonus, 0, 100)


def lexicon_risk(text: Column, lexicons: dict[str, tuple[int, Sequence[str]]]) -> Column:
    """Struct of a score for each lexicon (hits times weight, 100 at most), their greatest as ``risk``, and its band."""
    scores = {name: F.least(count_hits(text, tuple(terms)) * weight, F.lit(100)) for name, (weight, terms) in lexicons.items()}
    most = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return F.struct(*[v.alias(k) for k, v in scores.items()], most.alias("risk"), band(most, (60, "high"), (30, "medium"), least="low").alias("band"))


def checklist(*checks: tuple[str, int, Column]) -> Column:
    """Struct (score, failed): the weights of the checks that hold, and the names of the others in order; null does not hold."""
    score, failed = F.lit(0), []
    for name, weight, holds in checks:
        ok = F.coalesce(holds, F.lit(False))
        score = score + F.when(ok, weight).otherwise(0)
        failed.append(F.when(~ok, F.lit(name)))
    return F.struct(score.alias("score"), F.array_compact(F.array(*failed)).alias("failed"))


def expand_aliases(text: Column, aliases: Sequence[tuple[str, Sequence[str], str | None]]) -> Column:
    """The text with each canonical name appended whose variant, and context term if it asks for one, it holds.

    Aliases apply in order, so an appended name can start a later alias. Each step is a fold over
    an array, so the plan grows with the number of aliases alone.
    """
    steps = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, variants)).alias("variants"), F.lit(context).cast("string").alias("context")) for name, variants, context in aliases])

    def step(said: Column, alias: Column) -> Column:
        found = F.exists(alias["variants"], lambda v: F.contains(said, v))
        fits = found & (alias["context"].isNull() | F.contains(said, F.coalesce(alias["context"], F.lit(""))))
        return F.when(fits & ~F.contains(said, alias["name"]), F.concat(said, F.lit(" "), alias["name"])).otherwise(said)

    return F.aggregate(steps, F.coalesce(text, F.lit("")), step)


def watched(text: Column, groups: Sequence[Sequence[str]], terms: Sequence[str], stop_groups: int = 8, stop: int = 12) -> Column:
    """Distinct names of the groups that the text holds, in order, up to ``stop_groups``; then terms up to ``stop`` in all."""
    names = list(dict.fromkeys(n for g in groups for n in g))
    others = [t for t in dict.fromkeys(terms) if t not in names]
    held = lambda xs: F.filter(F.array(*map(F.lit, xs)), lambda t: F.contains(text, t))
    return F.slice(F.concat(F.slice(held(names), 1, stop_groups), held(others)), 1, stop)


def claims(title: Column) -> Column:
    """Distinct numbers of two characters or more and capitalised words of four letters or more."""
    words = F.split(F.regexp_replace(F.regexp_replace(title, r"[^\p{L}\p{N}.,]+", " "), r"[.,]+( |$)", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: w.rlike(r"^([0-9][0-9.,]+|\p{Lu}\p{L}{3,})$")))


def absent_from(said: Column, body: Column) -> Column:
    """The claims that a body does not hold."""
    low = F.lower(body)
    return F.filter(said, lambda w: ~F.contains(low, F.lower(w)))


def repeated_words(text: Column, words: Sequence[str], least: int = 2) -> Column:
    """The listed words that stand in the lower-cased text as whole words ``least`` times or more."""
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    times = lambda w: (F.length(low) - F.length(F.replace(low, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2)
    return F.filter(F.array(*map(F.lit, words)), lambda w: times(w) >= least)


def banned_terms(text: Column, terms: Sequence[str]) -> Column:
    """The banned terms of a text, longest first: phrases anywhere, single words as whole words."""
    low = F.lower(text)
    spaced = F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    ordered = sorted(terms, key=lambda t: (-len(t), t))
    tests = [F.when(F.contains(low, F.lit(t)) if " " in t else F.contains(spaced, F.lit(f" {t} ")), F.lit(t)) for t in ordered]
    return F.array_compact(F.array(*tests))


def destination(fatal: Column, direct: Column, score: Column) -> Column:
    """Where a story goes: blocked if a fatal fault stands, published if all direct conditions hold at 90, a draft from 35, else blocked."""
    return F.when(F.coalesce(fatal, F.lit(False)), "block").when(F.coalesce(direct, F.lit(False)) & (score >= 90), "publish").when(score >= 35, "draft").otherwise("block")


#: Parts of image addresses and what each is worth.
IMAGE_PARTS = (
    ((".jpg", ".jpeg"), 12), ((".webp",), 10), ((".png",), 8),
    (("foto", "photo", "image", "imagem", "picture", "media", "uploads", "wp-content", "cdn", "featured"), 5),
    (("1200", "1024", "900", "800", "768", "large", "full"), 2),
    (("icon", "logo", "favicon", "banner", "sprite", "pixel", "avatar", "ads", "doubleclick", "tracker", "gif"), -15),
)


def image_url_score(url: Column, parts: Sequence[tuple[Sequence[str], int]] = IMAGE_PARTS) -> Column:
    """How much an address looks like an article's picture: the worth of all parts that it holds; null holds none."""
    low = F.lower(F.coalesce(url, F.lit("")))
    total = F.lit(0)
    for words, worth in parts:
        total = total + worth * F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    return total
