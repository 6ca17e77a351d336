"""Line dedup: content-defined chunks of lines; chunks that repeat anywhere stay once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Scratch

MASK = (1 << 64) - 1
#: Multiplier of the rolling hash.
BASE = 0x9E3779B97F4A7C15


def line_chunks(text: str, window: int, divisor: int) -> list[tuple[int, int]]:
    """(first line, end line) of each chunk of a text's lines.

    A chunk ends after line i where the rolling hash of the hashes of the ``window`` lines up to i
    is divisible by ``divisor``. It depends on these lines alone, so an insertion before them
    moves no boundary; at the start of a text the hash is of the lines there are.
    """
    lines = text.split("\n")
    out, first, rolled = [], 0, 0
    drop = pow(BASE, window, 1 << 64)
    hashes = [int.from_bytes(hashlib.md5(x.encode("utf-8", "surrogatepass")).digest()[:8], "little") for x in lines]
    for i, h in enumerate(hashes):
        rolled = (rolled * BASE + h - (hashes[i - window] * drop if i >= window else 0)) & MASK
        if (rolled >> 32) % divisor == 0:
            out.append((first, i + 1))
            first = i + 1
    if first < len(lines):
        out.append((first, len(lines)))
    return out


def line_passages(lines: list[str], over: int) -> set[tuple[int, int]]:
    """(first line, end line) of the shortest runs of more than ``over`` words that begin, or that end, at each line with words.

    They depend on their own lines alone. Every run of more than ``over`` words, from a line with
    words to a line with words, is covered by those that lie in it, however short it is: the last
    of the ones that end with it begins no later than one that begins there.
    """
    sizes = [len(x.split()) for x in lines]
    at = [i for i, n in enumerate(sizes) if n]
    out, i, j, held = set(), 0, 0, 0
    for j, b in enumerate(at):  # the shortest that ends here
        held += sizes[b]
        while held - sizes[at[i]] > over:
            held -= sizes[at[i]]
            i += 1
        if held > over:
            out.add((at[i], b + 1))
    j, held = 0, 0
    for a in at:  # the shortest that begins here
        while j < len(at) and held <= over:
            held += sizes[at[j]]
            j += 1
        if held <= over:
            break
        out.add((a, at[j - 1] + 1))
        held -= sizes[a]
    return out


def _digests(lines: list[str]) -> list[bytes]:
    return [hashlib.md5(x.encode("utf-8", "surrogatepass")).digest() for x in lines]


def _of_run(digests: list[bytes], a: int, b: int) -> bytes:
    return hashlib.md5(b"".join(digests[a:b])).digest()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 2, divisor: int = 3, min_lines: int = 2, passage_words: int | None = None) -> DataFrame:
    """The columns of ``docs``, ``text`` without repeated chunks, and n_lines, n_removed_lines.

    Chunks of ``min_lines`` lines or more that say the same stay where the smallest (id, first line)
    is, and go elsewhere, also within one document. With ``passage_words``, so do all runs of whole
    lines of more than that many words, wherever chunks end and however few lines they have, and
    lines without words between two lines that go. Every line that goes stands at a smaller place,
    so no line goes everywhere. Runs are found by hash, and the bytes of all that repeat are
    compared, so equal hashes of different bytes never count as a repeat. Where a text is left
    without lines it is empty. Null text stays null and has no lines; empty texts and texts of one
    line have no chunk. Null ids sort first. A place is (id, digest of the text, first line), so rows that share an id, null
    ids too, are like others; of rows that share id and text, which nothing tells apart, one counts as the first. Columns named like the added ones are replaced. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "line-dedup")
    digest = lambda text: F.unhex(F.md5(text))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", digest(F.col("text")))

    @F.pandas_udf("struct<at:array<int>,n:array<int>,hash:array<binary>>")
    def runs(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts.tolist():
            lines = text.split("\n")
            found = {(a, b) for a, b in line_chunks(text, window, divisor) if b - a >= min_lines} if len(lines) > 1 else set()
            if passage_words is not None:
                found |= line_passages(lines, passage_words)
            digests = _digests(lines) if found else []
            rows.append(([a for a, _ in found], [b - a for a, b in found], [_of_run(digests, a, b) for a, b in found]))
        return pd.DataFrame(rows, columns=["at", "n", "hash"])

    def said(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for text, places in zip(batch["text"].tolist(), batch["places"].tolist(), strict=True):
                lines = text.split("\n")
                digests = _digests(lines)
                for x in places:
                    if _of_run(digests, x["at"], x["at"] + x["n"]) == bytes(x["hash"]):
                        rows.append((bytes(x["hash"]), "\n".join(lines[x["at"] : x["at"] + x["n"]])))
                        held += len(rows[-1][1])
                        if held > 1_000_000:
                            yield pd.DataFrame(rows, columns=["hash", "said"])
                            rows, held = [], 0
        yield pd.DataFrame(rows, columns=["hash", "said"])

    kept = own.where("text is not null" if passage_words is not None else F.instr("text", "\n") > 0)
    found = kept.select("id", "key", runs("text").alias("r")).select("id", "key", F.inline(F.arrays_zip("r.at", "r.n", "r.hash")))
    found = scratch.keep(found.toDF("id", "key", "at", "n", "hash"), "found")
    per_hash = found.groupBy("hash").agg(F.min(F.struct("id", "key", "at")).alias("first"), F.count("*").alias("times"))
    repeated = scratch.keep(per_hash.where("times > 1").select("hash", "first"), "repeated")
    places = scratch.keep(found.join(repeated, "hash"), "places")
    scratch.drop("found", "repeated")
    # byte comparison: a hash of different texts is no repeat
    sought = places.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("at", "n", "hash")).alias("places")).hint("merge")
    texts = kept.join(sought, F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))).select("text", "places").mapInPandas(said, "hash binary, said string").distinct()
    mixed = scratch.keep(texts.groupBy("hash").count().where("count > 1").select("hash"), "mixed")
    repeats = places.join(mixed, "hash", "left_anti").withColumn("stays", F.expr("struct(id, key, at) <=> first"))
    copies = scratch.keep(kept.groupBy("id", "key").count().where("count > 1").select("id", "key"), "copies")
    at_id, at_key, gone, new = (f"_{uuid.uuid4().hex}" for _ in range(4))  # names that no column of docs has

    def by_text(rows: DataFrame) -> DataFrame:
        # it grows with the input: a merge join at every size
        return rows.groupBy(F.col("id").alias(at_id), F.col("key").alias(at_key)).agg(F.collect_set(F.struct("at", "n", "hash")).alias(gone)).hint("merge")

    def with_gone(rows: DataFrame, runs_: DataFrame) -> DataFrame:
        return rows.join(runs_, F.col(id_col).eqNullSafe(F.col(at_id)) & (digest(F.col(text_col)) == F.col(at_key)), "left")

    goes = scratch.keep(repeats.where("not stays").select("id", "key", "at", "n", "hash"), "goes")
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    if copies.isEmpty():
        joined = with_gone(docs.select(*others), by_text(goes))
    else:
        # behind the first row of an id and text all that repeats goes; these rows alone are written with a number each
        sides = copies.select(F.col("id").alias(at_id), F.col("key").alias(at_key))
        own_copy = F.col("id").eqNullSafe(F.col(at_id)) & (F.col("key") == F.col(at_key))
        doc_copy = F.col(id_col).eqNullSafe(F.col(at_id)) & (digest(F.col(text_col)) == F.col(at_key))
        everything = scratch.keep(repeats.join(sides, own_copy, "left_semi").select("id", "key", "at", "n", "hash"), "copied")
        base = docs.select(*others)
        numbered = scratch.keep(base.join(sides, doc_copy, "left_semi").withColumn(new, F.monotonically_increasing_id()), "numbered")
        first = scratch.keep(numbered.groupBy(F.col(id_col), digest(F.col(text_col)).alias(at_key)).agg(F.min(new).alias(gone)).select(gone), "firsts")
        parts = (
            with_gone(base.join(sides, doc_copy, "left_anti"), by_text(goes)),
            with_gone(numbered.join(first, F.col(new) == F.col(gone), "left_semi").drop(new), by_text(goes)),
            with_gone(numbered.join(first, F.col(new) == F.col(gone), "left_anti").drop(new), by_text(everything)),
        )
        joined = parts[0].unionByName(parts[1]).unionByName(parts[2])
    scratch.drop("places")

    @F.pandas_udf("struct<text:string,n_lines:long,n_removed_lines:long>")
    def rebuilt(texts: pd.Series, runs_: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(texts.tolist(), runs_.tolist(), strict=True):
            if text is None:
                rows.append((None, 0, 0))
                continue
            lines = text.split("\n")
            if own is None or not len(own):
                rows.append((text, len(lines), 0))
                continue
            out, digests = bytearray(len(lines)), _digests(lines)
            for x in own:
                a, b = x["at"], x["at"] + x["n"]
                if b <= len(lines) and _of_run(digests, a, b) == bytes(x["hash"]):
                    out[a:b] = b"\1" * (b - a)
            if passage_words is not None:
                worded = [i for i, x in enumerate(lines) if x.strip()]
                for a, b in zip(worded, worded[1:]):
                    if out[a] and out[b]:
                        out[a:b] = b"\1" * (b - a)
            rows.append(("\n".join(x for x, go in zip(lines, out) if not go), len(lines), sum(out)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed_lines"])

    joined = joined.withColumn(new, rebuilt(F.col(text_col), F.col(gone)))
    return joined.select(*[F.col(f"{new}.text").alias(c) if c == text_col else F.col(c) for c in others], f"{new}.n_lines", f"{new}.n_removed_lines")
