"""JSON search and salvage against plain recursive passes."""

import json
import random
import re
import time

from pyspark.sql import functions as F

from tidewire.functions import jsons


def value(rng, depth):
    kind = rng.random()
    if depth and kind < 0.3:
        names = ["headline", "body", "text", "a", "é", "z", "@graph"]
        return {rng.choice(names): value(rng, depth - 1) for _ in range(rng.randint(0, 4))}
    if depth and kind < 0.5:
        return [value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 0, -12, 3.5, 1e20, "", "x y", 'q"{\\', "[1,", "}\n\t", "é日😀", "```"])


def salvaged(text):
    """The longest prefix of an object that holds whole values, by a reader that stops where the text breaks."""
    text = re.sub("```(?:json)?", "", text)
    if "{" not in text:
        return None
    text, at = text[text.index("{") :], 0

    class Broken(Exception):
        pass

    def skip():
        nonlocal at
        while at < len(text) and text[at] in " \n\t\r":
            at += 1
        if at >= len(text):
            raise Broken

    def string():
        nonlocal at
        m = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(text, at)
        if not m:
            raise Broken
        at = m.end()
        return json.loads(m[0], strict=False)

    def read(put):
        nonlocal at
        skip()
        if text[at] in "{[":
            end, own = ("}", {}) if text[at] == "{" else ("]", [])
            at += 1
            put(own)
            while True:
                skip()
                if text[at] == end:
                    at += 1
                    return
                if end == "}":
                    name = string()
                    skip()
                    if text[at] != ":":
                        raise Broken
                    at += 1
                    read(lambda v, own=own, name=name: own.__setitem__(name, v))
                else:
                    read(own.append)
                skip()
                if text[at] == ",":
                    at += 1
                elif text[at] != end:
                    raise Broken
        elif text[at] == '"':
            put(string())
        else:
            m = re.compile(r'[^\s"{}\[\],:]+').match(text, at)
            if not m or not re.fullmatch(r"true|false|null|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", m[0]):
                raise Broken
            at = m.end()
            skip()
            if text[at] not in ",}]":
                raise Broken
            put(json.loads(m[0]))

    out = []
    try:
        read(out.append)
        return out[0], True
    except Broken:
        return out[0], False


def test_salvage_equals_a_plain_reader(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(600):
        own = {"k": value(rng, 4), "l": [value(rng, 3)], "m": rng.choice([1, "s"])}
        text = json.dumps(own, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).replace("```", "")
        if rng.random() < 0.3:
            text = re.sub(r"([}\]])", r",\1", text, count=1) if rng.random() < 0.5 else text.replace(",", ",,", 1)
        if rng.random() < 0.6:
            text = text[: rng.randrange(len(text) + 1)]
        texts.append(rng.choice(["", "Sure: ", "```json\n"]) + text + rng.choice(["", "\n```", " tail {"]))
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(jsons.salvage(F.col("t")).alias("s")).collect()
    for text, r in zip(texts, got):
        want = salvaged(text)
        if want is None:
            assert r["s"] is None
        elif not re.search(r"[{\[]\s*,|,\s*,", re.sub(r'"(?:[^"\\]|\\.)*"', '""', text)):  # what a doubled comma leaves is looked at below
            assert (json.loads(r["s"]["json"], strict=False), r["s"]["whole"]) == want, text
        else:
            json.loads(r["s"]["json"], strict=False)


def test_salvage_edges(spark):
    rows = [None, "", "no object", "{", '{"a":12', '{"a":12,', '{"a" 1}', '{"a":[1}', '{"a":1,,"b":2}', '{"a":1}{"b":2}', '[{"a":"\\"}"}]']
    got = [r[0] and tuple(r[0]) for r in spark.createDataFrame([(t,) for t in rows], "t string").select(jsons.salvage(F.col("t"))).collect()]
    assert got == [None, None, None, ("{}", False), ("{}", False), ('{"a":12}', False), ("{}", False), ('{"a":[]}', False), ('{"a":1}', False), ('{"a":1}', True), ('{"a":"\\"}"}', True)]
    long = json.dumps({"rows": [{"i": i, "t": "word " * 5} for i in range(25_000)]})
    begun = time.perf_counter()
    saved = spark.createDataFrame([(long[:-30],)], "t string").select(jsons.salvage(F.col("t")).alias("s")).first()["s"]
    assert len(json.loads(saved["json"])["rows"]) == 25_000 and not saved["whole"] and time.perf_counter() - begun < 30


def first(doc, matches, depth):
    if depth < 0 or not isinstance(doc, (dict, list)):
        return None
    if isinstance(doc, dict) and matches(doc):
        return doc
    for v in doc.values() if isinstance(doc, dict) else doc:
        if (found := first(v, matches, depth - 1)) is not None:
            return found
    return None


def test_first_object_equals_a_plain_search(spark):
    rng = random.Random(3)
    plain = lambda x: {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else "s" if isinstance(x, str) else x
    docs = [[plain(value(rng, 5)) for _ in range(3)] for _ in range(400)]
    texts = [[json.dumps(x, ensure_ascii=False) for x in own] for own in docs]
    for own in texts[::7]:
        own.insert(0, '{"headline": "broken", "text": ')
    holds = lambda d: "headline" in d and ({"body", "articleBody", "text"} & set(d))
    for depth in (0, 2, 8):
        got = spark.createDataFrame([(t,) for t in texts], "t array<string>").select(jsons.first_object(F.col("t"), jsons.has_article, depth)).collect()
        for own, r in zip(docs, got):
            want = next((f for d in own if (f := first(d, holds, depth)) is not None), None)
            assert (r[0] and json.loads(r[0])) == want


def test_pages(spark):
    html = (
        '<script type="application/ld+json"> {"@type": "Organization"} </script><script type="application/ld+json">oops</script>'
        '<SCRIPT type=application/ld+json>[{"@graph": [{"@type": ["Thing", "Article"], "headline": "h", "articleBody": "a long enough paragraph\\nshort\\nanother long paragraph here", "image": [{"url": "u"}, "v"]}]}]</SCRIPT>'
        '<script>window.__NEXT_DATA__ = {"props": {"x": {"headline": "n", "text": "short", "image": "i"}}}; </script>'
    )
    df = spark.createDataFrame([(html,), (None,), ("",)], "h string")
    got = df.select(
        jsons.article(jsons.first_object(jsons.linked_data(F.col("h")), jsons.typed("Article"))), jsons.article(jsons.first_object(jsons.embedded_state(F.col("h")), jsons.has_article))
    ).collect()
    assert tuple(got[0][0]) == ("h", "a long enough paragraph\n\nanother long paragraph here", '{"url":"u"}') and tuple(got[0][1]) == ("n", "short", "i")
    assert [tuple(x) for r in got[1:] for x in r] == [(None, None, None)] * 4
