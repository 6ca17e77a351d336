"""JSON in texts and pages: search by key at any depth, linked data by type, embedded state, and salvage of broken objects.

All are expressions over whole texts. Objects are read as maps of names to JSON texts, which keeps the order
of the document (a VARIANT sorts its names), so the first match is the first in the document. JSON that
doesn't parse matches nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.arrays import let

#: A whole string, a mark, a word or number, or a quote that opens a string without an end.
TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[^\s"{}\[\],:]++|"'


def as_map(value: Column) -> Column:
    """The members of a JSON object as a map to JSON texts (strings without their quotes); null for anything else."""
    return F.when(F.rlike(value, F.lit(r"\A\s*\{")), F.from_json(value, "map<string,string>"))


def as_array(value: Column) -> Column:
    """The items of a JSON array as JSON texts; null for anything else."""
    return F.when(F.rlike(value, F.lit(r"\A\s*\[")), F.from_json(value, "array<string>"))


def member(value: Column, *names: str) -> Column:
    """The first non-empty member of an object that one of the names has; JSON null counts as empty."""
    found = F.filter(F.array(*[F.try_element_at(value, F.lit(n)) for n in names]), lambda x: x.isNotNull() & (x != ""))
    return F.get(found, 0)


def first_object(docs: Column, matches: Callable[[Column], Column], depth: int = 8) -> Column:
    """The JSON text of the first object, in document order, whose map satisfies ``matches``, in an array of JSON texts.

    Objects in objects and arrays are looked at down to ``depth`` levels; an object comes before what it holds.
    """
    kind = "array<struct<path:array<int>,node:string>>"
    none = F.array().cast(kind)

    def below(x: Column) -> Column:
        nodes = F.coalesce(F.map_values(as_map(x["node"])), as_array(x["node"]), F.array().cast("array<string>"))
        placed = F.transform(nodes, lambda v, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), v.alias("node")))
        return F.filter(placed, lambda v: F.rlike(v["node"], F.lit(r"\A\s*[\[{]")))

    def search(level: Column, left: int) -> Column:
        found = F.filter(level, lambda x: F.coalesce(let(as_map(x["node"]), matches), F.lit(False)))
        if left == 0:
            return found
        return F.concat(found, let(F.flatten(F.transform(level, below)), lambda next_: F.when(F.size(next_) == 0, none).otherwise(search(next_, left - 1))))

    start = F.transform(F.coalesce(docs, F.array().cast("array<string>")), lambda v, i: F.struct(F.array(i).alias("path"), v.alias("node")))
    return F.array_min(let(start, lambda level: search(level, depth)))["node"]


def typed(*types: str) -> Callable[[Column], Column]:
    """Whether an object's @type is, or lists, one of the types."""

    def matches(value: Column) -> Column:
        own = F.try_element_at(value, F.lit("@type"))
        return F.coalesce(F.arrays_overlap(F.coalesce(as_array(own), F.array(own)), F.array(*map(F.lit, types))), F.lit(False))

    return matches


def has_article(value: Column) -> Column:
    """Whether an object has a headline and a body under one of its names."""
    return F.map_contains_key(value, "headline") & (F.map_contains_key(value, "body") | F.map_contains_key(value, "articleBody") | F.map_contains_key(value, "text"))


def linked_data(html: Column) -> Column:
    """The texts of a page's linked data, in order."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>\s*(.*?)\s*</script>"), F.lit(1))


def embedded_state(html: Column, name: str = "__NEXT_DATA__") -> Column:
    """The objects that a page's scripts assign to ``name``, or hold as the script of that id, in order."""
    scripts = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script[^>]*>.*?</script>"), F.lit(0))
    own = F.filter(scripts, lambda s: F.contains(s, F.lit(name)))
    return F.filter(F.transform(own, lambda s: F.regexp_extract(s, r"(?s)(\{.*\})", 1)), lambda s: s != "")


def article(node: Column) -> Column:
    """struct(title, body, image) of an article's JSON text; paragraphs of over 20 characters, or the whole body without any."""

    def parts(value: Column) -> Column:
        body = member(value, "body", "articleBody", "text")
        lines = F.filter(F.transform(F.split(body, "\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 20)
        image = member(value, "image")
        return F.struct(
            member(value, "headline").alias("title"),
            F.when(F.size(lines) > 0, F.array_join(lines, "\n\n")).otherwise(body).alias("body"),
            F.when(F.rlike(image, F.lit(r"\A\s*\{")), member(as_map(image), "url")).otherwise(F.when(F.rlike(image, F.lit(r"\A\s*\[")), F.get(as_array(image), 0)).otherwise(image)).alias("image"),
        )

    return let(as_map(node), parts)


def salvage(text: Column) -> Column:
    """struct(json, whole) of the first JSON object in a text, such as a model's answer; null where there is none.

    Fences of code go, and so do commas before a closing bracket. The object ends where its brackets do, so what
    stands behind it is no matter. One that is cut off, or broken, is cut behind its last whole value and its open
    brackets are closed; then ``whole`` is false. A word or number counts as whole once something follows it. The text is
    read once, token by token.
    """
    body = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), "```(?:json)?", ""), r"(?s)(\{.*)", 1)
    start = F.struct(F.lit("").alias("open"), F.lit("v").alias("want"), F.lit(0).alias("n"), F.lit(0).alias("good"), F.lit("").alias("held"), F.lit(False).alias("word"))

    def step(s: Column, token: Column) -> Column:
        # want: v value, V value or end of array, k name or end, c colon, e comma or end, x nothing more
        want, open_ = s["want"], s["open"]
        wants_value, inner = want.isin("v", "V"), F.right(open_, F.lit(1))
        string, opens, closes = F.startswith(token, F.lit('"')) & (F.length(token) > 1), token.isin("{", "["), token.isin("}", "]")
        literal = F.rlike(token, F.lit(r"\A(?:true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)\z"))
        fits = closes & want.isin("e", "k", "V") & (inner == F.when(token == "}", "{").otherwise("["))
        less, more = F.left(open_, F.length(open_) - 1), F.concat(open_, token)
        next_ = (
            F.when(want == "x", "x").when(fits, F.when(less == "", "x").otherwise("e")).when(wants_value & opens, F.when(token == "{", "k").otherwise("V")).when(wants_value & (string | literal), "e")
            .when((want == "k") & string, "c").when((want == "c") & (token == ":"), "v").when((want == "e") & (token == ","), F.when(inner == "{", "k").otherwise("V")).otherwise("x")
        )
        moved = F.when(want == "x", open_).when(fits, less).when(wants_value & opens, more).otherwise(open_)
        # a word that the last token ended counts now that something follows
        after_word = s["word"] & (want != "x") & ((token == ",") | fits)
        done = (want != "x") & (fits | (wants_value & (opens | string)))
        return F.struct(
            moved.alias("open"), next_.alias("want"), (s["n"] + 1).alias("n"),
            F.when(done, s["n"] + 1).when(after_word, s["n"]).otherwise(s["good"]).alias("good"),
            F.when(done, moved).when(after_word, open_).otherwise(s["held"]).alias("held"),
            (wants_value & literal & (want != "x")).alias("word"),
        )

    def told(tokens: Column) -> Column:
        def cut(s: Column) -> Column:
            before_end = lambda own: lambda t, i: F.when((t == ",") & F.coalesce(F.get(own, i + 1).isin("}", "]"), F.lit(True)), "").otherwise(t)
            kept = let(F.slice(tokens, 1, s["good"]), lambda own: F.filter(F.transform(own, before_end(own)), lambda t: t != ""))
            return F.struct(F.concat(F.array_join(kept, ""), F.translate(F.reverse(s["held"]), "{[", "}]")).alias("json"), (s["held"] == "").alias("whole"))

        return let(F.aggregate(tokens, start, step), cut)

    return F.when(body != "", let(F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), told))
