"""Dictionary classifiers, additive scores and ordered gates as expressions."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.session import saved

#: What each maintenance agent's log lines hold, in order.
AGENTS = {
    "redacao": ("redacao", "preview", "materia", "fonte", "contaminada", "fallback", "openai", "score", "bloqueante"),
    "fonte": ("fonte", "extracao", "rss", "v104", "v86", "texto", "fallback html", "403", "429"),
    "imagem": ("imagem", "foto", "og_image", "json_ld_image", "cooldown", "429", "sem imagem"),
    "cms": ("cms", "playwright", "publicar", "rascunho", "form", "future", "syntaxerror"),
    "monitor": ("monitor", "ciclo", "parar", "thread", "google news", "kimi", "source hunter", "429"),
    "ui": ("painel", "fila", "preview", "f5", "selecion", "interface", "botao"),
    "regressao": ("syntaxerror", "nameerror", "attributeerror", "importerror", "fail", "error"),
}


def count_hits(text: Column, terms: tuple[str, ...]) -> Column:
    """How many of the terms the text holds."""
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(text, F.lit(term)).cast("int")
    return total


def by_dictionary(text: Column, dictionary: dict[str, tuple[str, ...]], default: str) -> Column:
    """Struct (n, name) of the class with most of its terms in the text, the first on ties; ``default`` where none has any."""
    counted = [F.struct(count_hits(text, terms).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, terms) in enumerate(dictionary.items())]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("place"), F.lit(default).alias("name"))
    return F.array_max(F.array(none, *counted))


def term_score(text: Column, weights: dict[str, int], cap: int) -> Column:
    """Sum of the weights of the terms that the text holds, up to ``cap``."""
    total = F.lit(0)
    for term, weight in weights.items():
        total = total + F.when(F.contains(text, F.lit(term)), weight).otherwise(0)
    return F.least(total, F.lit(cap))


def gate(*steps: tuple[Column, str], passed: str = "ok") -> Column:
    """The reason of the first step that holds, else ``passed``; a null condition does not hold."""
    return F.coalesce(*[F.when(c, reason) for c, reason in steps], F.lit(passed))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def rounded(value: Column, places: int) -> Column:
    """A double as SQL engines round it: shifted by ``places``, rounded, shifted back. Spark's round goes by the double's shortest decimal, which differs at halves (1.005)."""
    shift = F.lit(10.0**places)
    return F.round(value * shift) / shift


def rounded_means(rows: DataFrame, key: str, value: str, places: int, at: list[str]) -> DataFrame:
    """(key, mean): the mean of each key's doubles, rounded, as if they were added one by one in the order of ``at``; null keys are left out.

    The last bit of a sum of doubles depends on the order of addition, and so does what a mean near a half is rounded to. Partial
    sums in any order decide all other means: two orders differ by less than 2^-50 of the sum of absolute values. Only the rows of
    keys nearer to a half are sorted, and added by a window, row by row.
    """
    rows, scale = rows.where(F.col(key).isNotNull()), F.lit(10.0**places)
    summed = saved(rows.groupBy(key).agg(F.avg(value).alias("_mean"), F.sum(F.abs(value)).alias("_size")))
    apart = F.abs(F.abs(F.col("_mean") * scale) % 1 - 0.5)
    unsure = summed.where((apart <= F.col("_size") * scale * 2.0**-50) | (F.col("_size") == float("inf"))).select(key)
    window = Window.partitionBy(key).orderBy(*at)
    added = rows.join(unsure, key, "left_semi").withColumn("_sum", F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0)))
    exact = added.groupBy(key).agg((F.max_by("_sum", F.struct(*at)) / F.count(value)).alias("_exact"))
    return summed.join(exact, key, "left").select(key, rounded(F.coalesce("_exact", "_mean"), places).alias("mean"))


def top_terms(df: DataFrame, key: str, text: str, n: int, least: int = 4, common: int = 50_000) -> DataFrame:
    """(key, term, weight, rank): the ``n`` terms of greatest TF-IDF weight of each row, terms of ``least`` letters or more.

    Document frequencies are summed before they are shuffled. Those of the ``common`` commonest terms are
    known to every task, all others have a known range, so a row sends on only terms that can be among its
    ``n``; the rest never leave their task. Rows of one key count as one text; where keys repeat, their
    rows are counted in a shuffle first. Null and empty texts have no terms.
    """
    spark, total = df.sparkSession, df.count()
    words = F.filter(F.split(F.lower(F.regexp_replace(text, r"[^\p{L}]+", " ")), " "), lambda w: F.length(w) >= least)
    rows = df.select(F.col(key), words.alias("words"))
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        rows = saved(rows.groupBy(key).agg(F.flatten(F.collect_list("words")).alias("words")))
    frequency = saved(rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    known = {r["term"]: r["df"] for r in frequency.orderBy(F.desc("df"), "term").limit(common).collect()}
    most = min(known.values()) if known else total  # no other term is in more rows
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf("array<struct<term:string,tf:long,df:long>>")
    def possible(lists: pd.Series) -> pd.Series:
        out = []
        for own in lists:
            held = [(t, k, shared.value.get(t)) for t, k in Counter(own if own is not None else ()).items()]
            low = sorted((k * math.log((1 + total) / (1 + (d or most))) for _, k, d in held), reverse=True)
            bound = low[n - 1] - 1e-5 if len(low) >= n else -math.inf  # weights are rounded to six places
            out.append([{"term": t, "tf": k, "df": d} for t, k, d in held if k * math.log((1 + total) / (1 + (d or 1))) >= bound])
        return pd.Series(out, dtype=object)

    found = saved(rows.select(key, F.explode(possible("words")).alias("t")).select(key, "t.term", "t.tf", "t.df"))
    rare = found.where("df is null").drop("df").join(frequency, "term").select(key, "term", "tf", "df")
    weight = F.round(F.col("tf") * F.log((1 + F.lit(total)) / (1 + F.col("df"))), 6)
    weighed = found.where("df is not null").union(rare).select(key, "term", weight.alias("weight"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    return weighed.withColumn("rank", rank).where(F.col("rank") <= n)
