"""Plans built from the columns that a table has: aliases, flags, defaults in nested structs, and the rows of a visual queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def first_filled(df: DataFrame, names: Sequence[str], kind: str = "string") -> Column:
    """The first of the columns that ``df`` has, among ``names``, that is neither null nor blank text; null without any."""
    held = [F.col(f"`{n}`").cast(kind) for n in names if n in df.columns]
    if kind == "string":
        held = [F.when(F.trim(c) != "", F.trim(c)) for c in held]
    return F.coalesce(*held) if held else F.lit(None).cast(kind)


def is_active(df: DataFrame, flags: Sequence[str], truthy: Sequence[str], status: str = "status", closed: Sequence[str] = (), needed: Sequence[str] = ()) -> Column:
    """Whether a row is neither closed nor flagged, and has what is needed; built from the columns that ``df`` has. Null flags and statuses don't exclude."""
    tests = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")) != "", F.lit(False)) for c in needed if c in df.columns]
    if status in df.columns and closed:
        tests.append(~F.coalesce(F.lower(F.col(f"`{status}`").cast("string")).isin(*closed), F.lit(False)))
    tests += [~F.coalesce(F.col(f"`{c}`").cast("string").isin(*truthy), F.lit(False)) for c in flags if c in df.columns]
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def completed(value: Column, schema: StructType, defaults: Mapping) -> Column:
    """A struct with exactly the fields of ``defaults``: those of ``value`` (of type ``schema``) where they are not null, else the defaults.

    Nested mappings are completed the same way, also where their struct is null or missing; fields outside the defaults are dropped.
    Lists of values are array defaults. A value of another type is cast to its default's.
    """
    known = {f.name: f.dataType for f in schema.fields}
    out = []
    for name, default in defaults.items():
        if isinstance(default, Mapping):
            inner = known.get(name)
            nested = inner if isinstance(inner, StructType) else StructType([])
            made = completed(value[name] if nested.fields else value, nested, default)
        else:
            plain = F.array(*map(F.lit, default)) if isinstance(default, (list, tuple)) else F.lit(default)
            if default == [] or default == ():
                plain = F.array().cast("array<string>")
            kind = _kind(default)
            made = F.coalesce(value[name].cast(kind) if kind else value[name], plain) if name in known and not isinstance(known[name], StructType) else plain
        out.append(made.alias(name))
    return F.struct(*out)


def _kind(default) -> str | None:
    if isinstance(default, (list, tuple)):
        return f"array<{_kind(default[0]) if default else 'string'}>"
    return {bool: "boolean", int: "long", float: "double", str: "string"}.get(type(default))


def complete_rows(df: DataFrame, defaults: Mapping) -> DataFrame:
    """``df`` with exactly the columns of ``defaults`` (see completed)."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(completed(row, df.schema, defaults).alias("_row")).select("_row.*")


@dataclass(frozen=True)
class QueueRules:
    """Names that columns of a queue go by, in order of preference, and what leaves it."""

    # Aliases, states and flags of the queue's tables.
    link: tuple[str, ...] = ("link_origem", "url", "url_original", "url_final")
    title: tuple[str, ...] = ("titulo_origem", "titulo", "headline")
    text: tuple[str, ...] = ("cleaned_source_text", "texto_fonte", "texto_fonte_v134", "texto_fonte_v105", "raw_source_text", "dossie")
    image: tuple[str, ...] = ("imagem_url", "imagem_url_v134", "imagem", "image", "foto_url", "thumb", "thumbnail", "og_image")
    source: tuple[str, ...] = ("fonte", "fonte_nome", "nome_fonte", "dominio_v136")
    date: tuple[str, ...] = ("data_pub_fonte", "data_fonte", "captada_em", "criado_em", "created_at")
    closed: tuple[str, ...] = ("publicada", "descartada", "rejeitada", "bloqueada", "reprovada")
    flags: tuple[str, ...] = ("oculto", "oculta", "excluido", "excluida", "descartado", "descartada", "bloqueado", "bloqueada", "reprovado", "reprovada")
    truthy: tuple[str, ...] = ("1", "true", "True", "sim", "SIM")
    unnamed: tuple[str, ...] = ("fonte", "geral")
    technical: tuple[str, ...] = ("powershell", "select-string", "set-content", "get-content", "traceback", "syntaxerror", "patch_")
    minor: tuple[str, ...] = ("melhores gols", "melhores defesas", "gol –", "mls:", "spl:", "charge", "frase do dia")
    enough: int = 550


def queue_rows(df: DataFrame, rules: QueueRules | None = None) -> DataFrame:
    """The active rows of a queue's table, whatever its columns are called: its columns, and queue_link, queue_title, queue_source, queue_date, queue_image,
    queue_chars, queue_state (ok, short, pending), queue_score and queue_rank, by which the latest date first breaks ties.

    A missing title, an address, or a long one with slashes is read from the link's last part; a source without a name of its own is
    the link's host. Rows with neither title nor link, and those whose title is a program's, go. No limit: take the top by rank.
    """
    rules = rules or QueueRules()
    link, text, image = (first_filled(df, names) for names in (rules.link, rules.text, rules.image))
    said, source = first_filled(df, rules.title), first_filled(df, rules.source)
    slug = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(link, r"([^/?#]+)/*(?:[?#].*)?$", 1), r"\.[a-z]{2,5}$", ""), r"[-_]+", " "))
    address = F.coalesce(said.startswith("http") | (F.contains(said, F.lit("/")) & (F.length(said) > 120)), F.lit(True))
    title = F.when(address, slug).otherwise(said)
    host = F.regexp_replace(F.lower(F.regexp_extract(link, r"://([^/?#:]+)", 1)), r"^www\.", "")
    named = F.coalesce(~F.lower(source).isin(*rules.unnamed), F.lit(False))
    chars = F.coalesce(F.length(text), F.lit(0))
    pictured = image.isNotNull()
    score = F.when(chars >= rules.enough, F.when(pictured, 100).otherwise(90)).when(chars > 0, F.when(pictured, 80).otherwise(70)).otherwise(F.when(pictured, 60).otherwise(35))
    rows = df.where(is_active(df, rules.flags, rules.truthy, closed=rules.closed, needed=rules.link[:1]))
    rows = rows.withColumns({
        "queue_link": link, "queue_title": title, "queue_source": F.when(named, source).otherwise(host), "queue_date": first_filled(df, rules.date), "queue_image": image,
        "queue_chars": chars, "queue_state": F.when(chars >= rules.enough, "ok").when(chars > 0, "short").otherwise("pending"), "queue_score": score,
    })
    low = F.lower(F.coalesce(said, F.lit("")))
    any_of = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    rows = rows.where((said.isNotNull() | link.isNotNull()) & ~any_of(rules.technical))
    worth = F.when(chars >= rules.enough, 5000).when(chars > 0, 1000).otherwise(0) + F.when(pictured, 1000).otherwise(0)
    less = F.when(any_of(rules.minor), 3000).otherwise(0) + F.when(low.startswith("coleta ") | F.contains(low, F.lit(" pauta(s)")), 8000).otherwise(0)
    return rows.withColumn("queue_rank", worth - less)
