"""Dictionary matching: texts against a table of phrases, with contexts and exceptions, and scores with weights and caps from columns.

Texts are cut into words once, and the distinct runs of as many words as some phrase has, and whose hash cell some phrase takes, are joined with the
phrases, so the work doesn't grow with the number of phrases, and a table of any size is matched
by one equality join (broadcast only where Spark sees that it is small).
"""

from __future__ import annotations

from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import unmarked
from tidewire.operators.classify import clamp


def word_form(text: Column) -> Column:
    """Lower-case letters and digits without accents, one blank between words; null is empty."""
    return F.trim(F.regexp_replace(unmarked(F.lower(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+", " "))


def held_phrases(texts: DataFrame, phrases: DataFrame, id_col: str, text_col: str, cells: int = 1 << 20) -> DataFrame:
    """(id, phrase): the phrases of a table ``phrases`` (column ``phrase``, in word form) that each text holds as whole words.

    Rows that share an id are one text; null ids are one id. Runs of words leave a task only if their hash cell is one of a phrase's; the
    join then compares them whole, so the ``cells`` bound what the driver holds, not what is found.
    """
    told = phrases.where("phrase <> ''")
    lengths = sorted(r[0] for r in told.select(F.size(F.split("phrase", " "))).distinct().collect())  # one row a length
    if not lengths:
        return texts.select(id_col).limit(0).withColumn("phrase", F.lit(""))

    def taken(values: DataFrame) -> bytes:
        mark = bytearray(cells)
        for cell in values.select((F.crc32(F.col("v")) % cells).alias("cell")).distinct().toArrow().column("cell").to_pylist():
            mark[cell] = 1
        return bytes(mark)

    shared = texts.sparkSession.sparkContext.broadcast((taken(told.select(F.col("phrase").alias("v"))), taken(told.select(F.explode(F.split("phrase", " ")).alias("v")))))

    @F.pandas_udf("array<string>")
    def runs(forms: pd.Series) -> pd.Series:
        whole, single = shared.value
        out = []
        for form in forms.tolist():
            words = form.split(" ") if form else []
            may = {w for w in set(words) if single[crc32(w.encode()) % cells]}
            found: set[str] = set()
            for n in lengths:
                if n == 1:
                    found |= may
                else:
                    found |= {" ".join(run) for run in zip(*(words[k:] for k in range(n))) if may.issuperset(run)}
            out.append([r for r in found if whole[crc32(r.encode()) % cells]])
        return pd.Series(out)

    rows = texts.select(id_col, F.explode(runs(word_form(F.col(text_col)))).alias("phrase"))
    return rows.join(phrases.select("phrase").distinct(), "phrase").select(id_col, "phrase").distinct()


def match_terms(texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, part, term, weight): the terms that count for each text, each once a part.

    ``terms`` has term, part and weight, and, where it has these columns, ``context`` and ``unless``: arrays of phrases.
    A term with a context counts only if the text also holds one of its phrases, and one with ``unless`` only if it
    holds none of those. Terms and phrases are compared in word form, as whole words; blank terms and null parts count
    for nothing, null weights are 0, and of equal terms of a part the greatest weight counts.
    """
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(F.transform(F.col(c), word_form), none) if c in terms.columns else none
    own = terms.where("part is not null").select(word_form(F.col("term")).alias("term"), "part", F.coalesce(F.col("weight"), F.lit(0)).alias("weight"), listed("context").alias("context"), listed("unless").alias("unless")).where("term <> ''")
    phrases = own.select(F.explode(F.concat(F.array("term"), "context", "unless")).alias("phrase"))
    held = held_phrases(texts, phrases, id_col, text_col)
    # a text's terms are among its own words: they come together in one row
    by_text = held.join(own.withColumnRenamed("term", "phrase"), "phrase", "left").groupBy(id_col).agg(
        F.collect_set("phrase").alias("held"), F.collect_list(F.struct("phrase", "part", "weight", "context", "unless")).alias("found")
    )
    counts = lambda x: x["part"].isNotNull() & ((F.size(x["context"]) == 0) | F.arrays_overlap("held", x["context"])) & ~F.arrays_overlap("held", x["unless"])
    rows = by_text.select(id_col, F.inline(F.filter("found", counts))).groupBy(id_col, "part", F.col("phrase").alias("term"))
    return rows.agg(F.max("weight").alias("weight"))


def part_scores(hits: DataFrame, parts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, part, hits, points) of ``match_terms``' rows: for each part the sum of its weights, or with mode ``max`` the
    greatest one, at most its cap. ``parts`` has part, cap (null: none) and mode; terms of other parts are left out."""
    summed = hits.groupBy(id_col, "part").agg(F.count("*").alias("hits"), F.sum("weight").alias("sum"), F.max("weight").alias("max"))
    points = F.when(F.col("mode") == "max", F.col("max")).otherwise(F.col("sum"))
    return summed.join(parts.select("part", "cap", "mode"), "part").select(id_col, "part", "hits", F.least(points, F.col("cap")).alias("points"))


def composite_score(scores: DataFrame, parts: list[str], id_col: str = "id", base: int = 0, low: int = 0, high: int = 100, least_hits: int = 2) -> DataFrame:
    """A row for each id with points: a column for each part, ``score`` (base and all points within ``low`` and ``high``) and
    ``reasons``, the parts with ``least_hits`` terms or more, in the order of ``parts``."""
    c = F.col
    columns = [F.coalesce(F.sum(F.when(c("part") == p, c("points"))), F.lit(0)).alias(p) for p in parts]
    strong = F.collect_set(F.when(c("hits") >= least_hits, c("part")))
    rows = scores.groupBy(id_col).agg(*columns, strong.alias("strong"))
    total = sum((c(p) for p in parts), F.lit(base))
    reasons = F.filter(F.array(*map(F.lit, parts)), lambda p: F.array_contains("strong", p))
    return rows.select(id_col, *parts, clamp(total, low, high).alias("score"), reasons.alias("reasons"))
