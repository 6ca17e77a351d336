"""Cleaning of source texts: lines and blocks that are no part of an article, and paragraphs cut anew.

All functions are expressions over whole texts, linear in their length; rules are parameters, and the
defaults are those of a Portuguese newsroom. Null texts are read as empty. White space is ASCII white
space; a non-breaking blank is a blank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.arrays import first_of_equal, let
from tidewire.functions.text import plain_words, squeezed

UPPER = "A-ZÁÉÍÓÚÂÊÔÃÕÇ"
LOWER = "a-záéíóúâêôãõç"


@dataclass(frozen=True)
class CleanRules:
    """Word lists and patterns of lines; patterns are matched against lower-cased lines without blanks at the ends."""

    # What lines of menus, notices and calls say.
    phrases: tuple[str, ...] = (
        "política de privacidade", "politica de privacidade", "termos de uso", "fale conosco",
        "quem somos", "catecontando histórias", "catecontando historias", "todos os direitos reservados",
        "copyright", "cookies", "newsletter", "publicidade", "continua após a publicidade",
        "continua apos a publicidade", "leia também", "leia tambem", "compartilhe", "menu",
        "buscar no site", "últimas notícias", "ultimas noticias", "mais lidas", "acesse sua conta",
        "benefício do assinante", "beneficio do assinante", "assine", "login", "entrar",
    )
    headings: tuple[str, ...] = (
        "contexto", "detalhes", "efeitos praticos", "proximos passos", "o que se sabe", "entenda",
        "saiba mais", "orientacoes ao consumidor", "servico",
    )
    fillers: tuple[str, ...] = ("acende o alerta", "vale lembrar que", "cabe ressaltar que", "é importante destacar que", "nesse contexto")
    date: str = r"\b(?:em\s+)?\d{1,2}/\d{1,2}/\d{4}\s*(?:às|as|,)?\s*\d{1,2}:\d{2}(?::\d{2})?\b"
    # Lines of paywalls and tools, and words of picture descriptions.
    lines: tuple[str, ...] = (
        r"^benef[ií]cio do assinante$", r"^voc[eê] tem \d+ acessos por dia", r"^assinantes podem liberar", r"^j[aá] [ée] assinante\??",
        r"^assine( a [a-z]+)?$", r"^assine ou fa[cç]a login$", r"^fa[cç]a seu login$", r"^copiar link$", r"^salvar para ler depois$",
        r"^salvar artigos$", r"^recurso exclusivo para assinantes$", r"^diminuir fonte.*aumentar fonte$", r"^ouvir o texto$",
        r"^compartilhe$", r"^publicidade$", r"^continua ap[oó]s a publicidade$",
    )
    markers: tuple[str, ...] = (
        "benefício do assinante", "beneficio do assinante", "recurso exclusivo para assinantes", "assine a folha",
        "salvar para ler depois", "copiar link", "diminuir fonte aumentar fonte",
    )
    pictures: tuple[str, ...] = ("homem de terno", "mulher de ", "fundo desfocado", "aparece em foto", "camisa azul", "gravata", "fala em microfone", "imagem mostra")
    spans: tuple[str, ...] = (r"(?is)benef[ií]cio do assinante.*?(assine|fa[cç]a login)", r"(?is)copiar link\s+salvar.*?(assine|login)")
    # Lines that a writer's notes leave out.
    noise: tuple[str, ...] = (
        "assine agora", "newsletter", "clique aqui", "saiba mais", "leia também", "veja também", "veja mais",
        "acesse também", "compartilhe", "siga nossas redes", "curta nossa página", "baixe o aplicativo", "publicidade", "anúncio",
        "continua após o anúncio", "continua após publicidade",
    )
    noise_patterns: tuple[str, ...] = (
        r"^publicidade$", r"^\d+\s+min(uto)?s?\s+(de leitura|para ler)$", r"^leia também:?$", r"^veja (também|mais):?$",
        r"^(foto|imagem|galeria):\s*reprodução$", r"^foto:\s*\w", r"^crédito:", r"^legenda:", r"^caption:", r"^©\s*\w", r"^todos os direitos", r"https?://\S+$",
    )
    # How a block of links or calls begins, sections that are never one, and lines by kind.
    opener: str = (
        r"^(?:notícias?\s+relacionadas?|noticias?\s+relacionadas?|leia\s+(?:também|mais|ainda|tambem)|veja\s+(?:também|mais|tambem)|"
        r"acesse\s+(?:também|tambem)|mais\s+(?:notícias|noticias|artigos?)|versão\s+em\s+áudio|versao\s+em\s+audio|ouça\s+esta|ouca\s+esta|"
        r"assista\s+(?:também|tambem)|compartilh[ae]r?|partilhar|siga[- ](?:nos|nossas?|o\s+portal)|receba\s+(?:nossas?|as\s+notícias?)|"
        r"newsletter|inscreva[- ]se|publicidade|advertisement|continua\s+(?:após|depois|after)|baixe\s+o\s+(?:aplicativo|app))"
    )
    opener_lines: tuple[str, ...] = ("assine", "scroll to continue")
    section: str = (
        r"^(?:demandas?\s+do|espaço\s+coletivo|histórico|contexto|antecedentes|declaração|nota\s+(?:oficial|da|do)|posição\s+(?:da|do)|"
        r"entrevista\s+com|depoimento|análise|investigação|repercussão|reação)"
    )
    # How a paragraph begins that only points elsewhere.
    snippets: tuple[str, ...] = (
        r"leia\s+(mais|tamb[ée]m)", r"confira\s+(tamb[ée]m|abaixo)", r"veja\s+(tamb[ée]m|abaixo)", r"saiba\s+mais", "acompanhe", r"fique\s+por\s+dentro",
        r"continue\s+lendo", r"clique\s+aqui", "assine", "inscreva-se", r"receba\s+not[íi]cias", r"not[íi]cias\s+recomendadas", r"voc[êe]\s+pode\s+gostar",
        "publicidade", "an[úu]ncio", "propaganda", r"mais\s+lidas", "trending", "recommended", r"read\s+more", r"see\s+also", r"related\s+articles",
    )
    kinds: tuple[tuple[str, str, int | None], ...] = (  # name, pattern, length that the line must be under
        ("credit", r"^(?:foto[:\s]|crédito[:\s]|credit[:\s]|©\s*\S|image[:\s]|imagem[:\s]|fotógrafo[:\s]|photographer[:\s])", None),
        ("caption", r"^(?:legenda[:\s]|caption[:\s])", None),
        ("url", r"^https?://\S+$", None),
        ("timestamp", r"^(?:publicado\s+em|atualizado\s+em|updated|published|posted)[:\s]", 100),
        ("byline", r"^(?:por[:\s]|by[:\s]|autor[:\s]|author[:\s]|redação[:\s]|reportagem[:\s])", 80),
        ("notice", r"^(?:publicidade|advertisement|anuncio|patrocinado|sponsored|ads?\s+by)", 100),
    )


    @property
    def whole_lines(self) -> str:
        """One pattern of all ``lines``, whose beginning is tried once where all of them have one."""
        if all(p.startswith("^") and "|" not in p for p in self.lines):
            return f"^(?:{'|'.join(p[1:] for p in self.lines)})"
        return "|".join(self.lines)


NEWS = CleanRules()


def any_of(words: tuple[str, ...]) -> str:
    """A pattern of any of the words as they stand."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)


def has(text: Column, pattern: str) -> Column:
    return F.rlike(text, F.lit(pattern))


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in a text; what ``any_of`` finds, but by plain comparison."""
    return let(text, lambda t: reduce(or_, [F.contains(t, F.lit(w)) for w in words]))


def is_snippet(paragraph: Column, rules: CleanRules = NEWS) -> Column:
    """Whether a paragraph begins like one that only points elsewhere; null does not."""
    return F.coalesce(has(F.lower(paragraph), f"^(?:{'|'.join(rules.snippets)})"), F.lit(False))


def lines_of(text: Column) -> Column:
    """The lines of a text, whatever ends them."""
    return F.split(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), r"\r\n|\r", "\n"), "\n")


def joined(lines: Column) -> Column:
    """Lines as a text: at most one blank line at once, single blanks, none at the ends."""
    text = F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return trimmed(text)


def trimmed(text: Column) -> Column:
    """A text without white space at the ends; unlike trim, of any kind."""
    return F.regexp_replace(F.regexp_replace(text, r"\A\s+", ""), r"(?<!\s)\s+\z", "")


def is_junk(line: Column, rules: CleanRules = NEWS) -> Column:
    """Whether a squeezed line is part of a menu, a notice, a call or a list of headlines."""
    names = (F.length(line) < 35) & has(line, rf"^(?:[{UPPER}][{LOWER}]+\s*){{1,4}}$")
    dashes = F.size(F.split(line, " - ")) > 3
    return (F.length(line) <= 2) | has(line, r"^[-–—•|/\\]+$") | names | ((F.length(line) > 120) & dashes) | has_any(F.lower(line), rules.phrases)


def _with_lines(text: Column) -> Column:
    """A text without line ends gets them before dashes and behind sentences."""
    cut = F.regexp_replace(F.regexp_replace(text, r"\s+-\s+", "\n- "), rf"(?<!\d)\.\s+(?=[{UPPER}])", ".\n")
    return F.when(F.contains(text, F.lit("\n")), text).otherwise(cut)


def _from_title(text: Column, title: Column, rules: CleanRules) -> Column:
    """The text from the last place of its title on, if what stands before looks like a menu or is long."""

    def cut(behind: Column) -> Column:
        start = F.length(text) - F.length(behind) - F.length(title)
        before = F.lower(F.substring(text, F.lit(1), start))
        menu = has_any(before, rules.phrases) | (F.size(F.split(before, " - ")) > 2) | (start > 180)
        return F.when((start > 40) & menu, F.substring(text, start + 1, F.length(text))).otherwise(text)

    long = F.length(plain_words(title)) >= 18
    found = F.contains(F.lower(text), F.lower(title))
    return F.when(long & found, let(F.call_function("substring_index", F.lower(text), F.lower(title), F.lit(-1)), cut)).otherwise(text)


def _from_date(text: Column, rules: CleanRules) -> Column:
    """The text from the headline before its first date on, if what stands before that looks like a menu."""

    def cut(before: Column) -> Column:
        start = F.length(before) - F.length(F.substring_index(before, " - ", -1))
        menu = has_any(F.lower(before), rules.phrases) | (F.size(F.split(before, " - ")) > 2)
        return F.when(menu & (start > 0) & F.contains(before, F.lit(" - ")), F.substring(text, start + 1, F.length(text))).otherwise(text)

    head = F.substring(text, 1, 1200)
    return F.when(has(head, f"(?i){rules.date}"), let(F.regexp_extract(head, rf"(?is)\A(.*?){rules.date}", 1), cut)).otherwise(text)


def clean_article(text: Column, title: Column | None = None, rules: CleanRules = NEWS, max_chars: int | None = 16000) -> Column:
    """A source text without what stands before the article, junk lines, calls, and lines that begin like an earlier one.

    A text of one line is first cut into sentences. It begins at the last place of ``title`` (of 18 letters
    or more), if over 40 characters stand before it that look like a menu or are over 180, and at the headline before
    the first date of its first 1,200 characters, if a menu stands before that. Lines that begin with a hyphen, are under 180
    characters and hold no date go. Of lines with the same first 180 plain letters the first stays. A
    longer text than ``max_chars`` is cut at a blank; None cuts nothing. Lines stay lines throughout.
    """
    own = let(F.array_join(lines_of(text), "\n"), _with_lines)
    if title is not None:
        own = let(own, lambda t: F.when(title.isNull(), t).otherwise(_from_title(t, title, rules)))
    own = let(own, lambda t: _from_date(t, rules))

    def kept(lines: Column) -> Column:
        call = lambda x: F.startswith(x, F.lit("-")) & (F.length(x) < 180) & ~has(x, f"(?i){rules.date}")
        stay = F.filter(lines, lambda x: ~call(x) & ~is_junk(x, rules))
        return first_of_equal(F.transform(stay, lambda x, i: F.struct(F.substring(plain_words(x), 1, 180).alias("key"), i.alias("place"), x.alias("value"))))

    cleaned = joined(kept(F.transform(F.split(own, "\n"), lambda x: F.regexp_replace(squeezed(x), r"^[ |•]+|(?<![ |•])[ |•]+$", ""))))
    return cleaned if max_chars is None else let(cleaned, lambda t: cut_at_blank(t, max_chars))


def cut_at_blank(text: Column, size: int) -> Column:
    """A text of at most ``size`` characters, cut at its last blank."""
    return F.when(F.length(text) <= size, text).otherwise(trimmed(F.regexp_replace(F.substring(text, 1, size), " [^ ]*$", "")))


def clean_source(text: Column, rules: CleanRules = NEWS, max_chars: int | None = 16000) -> Column:
    """A cleaned article (see clean_article) without lines of paywalls and tools, picture descriptions, and spans between two of their marks."""
    lines = F.transform(F.split(clean_article(text, None, rules, max_chars), "\n"), lambda x: squeezed(x))

    def stays(line: Column) -> Column:
        junk = lambda low: has(low, rules.whole_lines) | has_any(low, rules.markers) | ((F.length(line) > 80) & has_any(low, rules.pictures))
        return (line != "") & ~let(F.lower(line), junk)

    own = F.array_join(F.filter(lines, stays), "\n")
    for span in rules.spans:
        own = F.regexp_replace(own, span, " ")
    return trimmed(F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def useful_chars(text: Column, rules: CleanRules = NEWS, max_chars: int | None = 16000) -> Column:
    """How many characters of a text are left when it is cleaned and its addresses are out."""
    return without_addresses(clean_source(text, rules, max_chars))


def without_addresses(text: Column) -> Column:
    """How many characters a text has besides addresses."""
    return F.length(trimmed(F.regexp_replace(text, r"https?://\S+", "")))


def clean_body(text: Column, rules: CleanRules = NEWS) -> Column:
    """Blocks of a written text without headings, junk and filling phrases; a heading goes from above its block."""
    own = F.replace(F.replace(F.array_join(lines_of(text), "\n"), F.lit("—"), F.lit(",")), F.lit("–"), F.lit("-"))

    def heading(line: Column) -> Column:
        return plain_words(line).isin(*rules.headings)

    def said(block: Column) -> Column:
        lines = F.filter(F.transform(F.split(block, "\n"), lambda x: squeezed(x)), lambda x: x != "")
        return let(lines, lambda own: F.array_join(F.when((F.size(own) > 1) & heading(F.get(own, 0)), F.slice(own, 2, F.greatest(F.size(own), F.lit(1)))).otherwise(own), " "))

    blocks = F.filter(F.transform(F.split(own, r"\n\s*\n"), said), lambda b: (b != "") & ~heading(b) & ~is_junk(b, rules))
    without = lambda b: squeezed(F.regexp_replace(b, rf"(?i)\b(?:{any_of(rules.fillers)})\b", ""))
    return F.array_join(F.filter(F.transform(blocks, without), lambda b: b != ""), "\n\n")


def clean_notes(text: Column, rules: CleanRules = NEWS) -> Column:
    """The lines of a writer's source without calls, credits, captions, notices and lines that end with an address."""
    own = lambda x: F.lower(trimmed(x))
    return trimmed(F.array_join(F.filter(lines_of(text), lambda x: ~(own(x).isin(*rules.noise) | has(own(x), "|".join(rules.noise_patterns)))), "\n"))


def line_kinds(text: Column, rules: CleanRules = NEWS) -> Column:
    """Array of (line, kind): blank, section, opener, related, text, or the name of a kind of ``rules``.

    An opener begins a block that goes on to the next blank line; what stands in it is related. Each line
    gets a letter, and the state of the block is one pass of a pattern over the letters of all lines.
    """
    names = {"b": "blank", "s": "section", "o": "opener", "r": "related", "x": "text"} | {str(i): name for i, (name, _, _) in enumerate(rules.kinds)}

    def letter(line: Column) -> Column:
        low = F.lower(trimmed(line))
        bare = trimmed(F.regexp_replace(low, ":+$", ""))
        kind = F.when(low == "", "b").when(has(low, rules.section), "s").when(bare.isin(*rules.opener_lines) | has(low, rules.opener), "o")
        for i, (_, pattern, under) in enumerate(rules.kinds):
            kind = kind.when(has(low, pattern) & ((F.length(low) < under) if under else F.lit(True)), str(i))
        return kind.otherwise("x")

    def told(lines: Column) -> Column:
        letters = F.split(F.regexp_replace(F.array_join(F.transform(lines, letter), ""), r"(?:(?<=o)|(?!^)\G)[^bo]", "r"), "")
        return let(letters, lambda own: F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.get(own, i).alias("kind"))))

    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.transform(let(lines_of(text), told), lambda x: F.struct(x["line"].alias("line"), F.try_element_at(known, x["kind"]).alias("kind")))


def split_metadata(text: Column, rules: CleanRules = NEWS) -> Column:
    """struct(body, dropped, related, captions, credits, paragraphs) of a text.

    ``body`` is its lines without single lines of metadata and blocks of links and calls; ``dropped`` is
    the array of (line, kind) that left, ``related``, ``captions`` and ``credits`` are lines of these kinds, and
    ``paragraphs`` counts the body's blocks. A line that opens a block inside one goes on with it. A section's
    title is never taken for an opener, unless a block holds it.
    """

    def parts(rows: Column) -> Column:
        stays = lambda x: x["kind"].isin("blank", "section", "text")
        of = lambda kind: F.transform(F.filter(rows, lambda x: x["kind"] == kind), lambda x: trimmed(x["line"]))
        body = trimmed(F.array_join(F.transform(F.filter(rows, stays), lambda x: x["line"]), "\n"))
        return F.struct(
            body.alias("body"),
            F.transform(F.filter(rows, lambda x: ~stays(x)), lambda x: F.struct(trimmed(x["line"]).alias("line"), x["kind"].alias("kind"))).alias("dropped"),
            of("related").alias("related"),
            of("caption").alias("captions"),
            of("credit").alias("credits"),
            F.size(F.filter(F.split(body, r"\n\n"), lambda b: has(b, r"\S"))).alias("paragraphs"),
        )

    return let(line_kinds(text, rules), parts)


def paragraphs(text: Column, least: int = 260, whole: int = 900) -> Column:
    """The paragraphs of a text: blocks between blank lines; a single block of over ``whole`` characters is cut anew.

    Sentences are then put together until a paragraph has ``least`` characters. One pass of a pattern: a paragraph is the
    shortest text of that length that ends with a sentence, and begins where the last one ended, so the rest is tried once.
    """
    own = trimmed(F.array_join(lines_of(text), "\n"))

    def cut(t: Column) -> Column:
        blocks = F.filter(F.transform(F.split(t, r"\n\s*\n"), trimmed), lambda b: b != "")
        one = F.regexp_replace(t, r"([.!?])\s+", "$1 ")
        again = F.split(F.regexp_replace(one, rf"(?s)\G(\S.{{{least - 2},}}?[.!?]) ", "$1\u0001"), "\u0001")
        return F.when((F.size(blocks) <= 1) & (F.length(t) > whole), again).otherwise(blocks)

    return let(own, cut)


def grouped(sentences: Column, least: int, most: int) -> Column:
    """Neighbouring sentences put together until a group has ``least`` characters or ``most`` sentences; the rest is the last group."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(state: Column, sentence: Column) -> Column:
        longer = F.when(state["n"] == 0, sentence).otherwise(F.concat(state["open"], F.lit(" "), sentence))
        ends = (F.length(longer) >= least) | (state["n"] + 1 >= most)
        return F.struct(
            F.when(ends, F.concat(state["done"], F.array(longer))).otherwise(state["done"]).alias("done"),
            F.when(ends, "").otherwise(longer).alias("open"),
            F.when(ends, 0).otherwise(state["n"] + 1).alias("n"),
        )

    return F.aggregate(sentences, start, step, lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def normal_paragraphs(text: Column, source: Column | None = None, least: int = 260, most: int = 3) -> Column:
    """A body with blank lines between paragraphs, so that a long text is never one block.

    Two paragraphs or more stay. Else tags go, and sentences of over 20 characters are grouped to ``least`` characters or
    ``most`` sentences; fewer than three such sentences stay as they are. If that gives too few groups for the length
    of ``source`` (the text itself if null), four sentences or more become three groups.
    """
    own = F.replace(F.replace(F.array_join(lines_of(text), "\n"), F.lit("—"), F.lit(",")), F.lit("–"), F.lit("-"))
    own = trimmed(F.regexp_replace(trimmed(own), r"(?i)^(body\s*p|conteúdo|conteudo)\s*", ""))

    def from_one(raw: Column) -> Column:
        size = F.length(raw if source is None else F.coalesce(trimmed(source), raw))
        wanted = F.least(F.lit(3), F.when(size >= 4200, 7).when(size >= 2600, 6).when(size >= 1400, 5).when(size >= 800, 4).otherwise(3))

        def groups(s: Column) -> Column:
            third = F.greatest(F.lit(1), F.floor(F.size(s) / 3).cast("int"))
            thirds = F.array(*[F.array_join(x, " ") for x in (F.slice(s, 1, third), F.slice(s, third + 1, third), F.slice(s, 2 * third + 1, F.size(s)))])
            few = lambda g: (F.size(g) < wanted) & (F.size(s) >= 4)
            made = let(grouped(s, least, most), lambda g: F.when(few(g), thirds).otherwise(g))
            return F.when(F.size(s) < 3, raw).otherwise(F.array_join(F.filter(made, lambda b: b != ""), "\n\n"))

        sentences = F.filter(F.transform(F.split(F.regexp_replace(raw, r"([.!?]) ", "$1\u0001"), "\u0001"), trimmed), lambda s: F.length(s) > 20)
        return let(sentences, groups)

    def pick(p: Column) -> Column:
        return F.when(F.size(p) >= 2, F.array_join(p, "\n\n")).otherwise(let(squeezed(F.regexp_replace(own, "<[^>]+>", " ")), from_one))

    return let(paragraphs(own, least), pick)


def repaired_paragraphs(text: Column) -> Column:
    """A generated body with blank lines between paragraphs: where it has none, every line end becomes one; a text of
    one line is cut into pairs of sentences (each alone, if fewer than four)."""
    own = F.regexp_replace(F.array_join(lines_of(text), "\n"), r"\n{3,}", "\n\n")
    sentences = F.split(F.regexp_replace(own, r"([.!?])\s+(?=[A-ZÁÀÃÂÉÊÍÓÔÕÚÜÇ])", "$1\u0001"), "\u0001")
    pairs = let(sentences, lambda s: F.when(F.size(s) < 4, s).otherwise(grouped(s, 1 << 30, 2)))
    return trimmed(F.when(F.contains(own, F.lit("\n\n")), own).when(F.contains(own, F.lit("\n")), F.replace(own, F.lit("\n"), F.lit("\n\n"))).otherwise(F.array_join(pairs, "\n\n")))
