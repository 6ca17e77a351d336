"""URL filters, chat formatting and personal data against plain Python."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.llm import chat_format, pii, queries, registry, url_filter


def test_rules_follow_the_longest_fit(make):
    rows = [
        (1, "http://a.example.org/es/1", None), (2, "https://EXAMPLE.org/en/12?q", None), (3, "http://x.com/fr/", None),
        (4, "http://x.com/de/1#t", None), (5, "http://notexample.org/es/", None), (6, None, None), (7, "no scheme", ""),
        (8, "http://x.org", None), (9, "http://x.org?/y", None), (9, "http://x.org?/y", None),
    ]
    got = sorted(map(tuple, url_filter.judge_urls(make(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()))
    assert got == [
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "x.com", "/fr/", "com/fr/", "allow"), (4, "x.com", "/de/1", "com/de/", "block"), (5, "notexample.org", "/es/", "org/", "allow"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "x.org", "", None, "allow"), (9, "x.org", "", None, "allow"), (9, "x.org", "", None, "allow"),
    ]


def test_blocks_spread_over_aliases_and_allows_hold(make):
    link = '<link href="{}" rel="canonical">'.format
    move = '<meta http-equiv="refresh" content="0; url={}">'.format
    rows = [
        (1, "http://a.net/1", link("http://b.net/2")), (2, "http://b.net/2#x", move("https://x.com/de/9")), (3, "http://c.net/", link("http://x.com/de/8")),
        (4, "http://d.net/", link("http://c.net/")), (5, "http://c.net/#y", link("http://q.com/fr/1")), (6, "http://e.net/", link("/de/1")),
        (7, "http://lone.net/", link("http://lone.net/")), (8, "http://q.com/fr/1", None),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(make(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow", 8: "allow"}


def test_addresses_are_alike_and_links_relative(make):
    link = '<LINK class=x rel="alternate canonical" href="{}">'.format
    move = "<meta content='3; URL={}' http-equiv=Refresh>".format
    block = "http://x.com/de/"
    rows = [
        (1, "http://a.net", link(block)), (2, "http://b.net/1", link("http://a.net:80/#t")), (3, "https://c.net/d/e", link("../f?g=1&amp;h=2")), (4, "https://c.net:443/f?g=1&h=2", move(block)),
        (5, "http://d.net/q", link("?x")), (6, "http://d.net/q?x", link(block)), (7, "http://e.net/a/b", link("mailto:x") + "<link rel=icon href=z>" + link("c") + move(block)), (8, "http://e.net/a/c", None),
        (9, "http://f.net/a/", link("./../..")), (10, "http://f.net", move("//x.com/de/2")), (11, "http://g.net/", link("#here") + link("data:x")), (12, None, link("/x")), (13, "no", move(block)),
    ]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(make(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    assert got == {k: "block" if k < 11 else "allow" for k in got} and len(got) == 13
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    assert {r[0]: r[4] for r in con.sql(registry.ORACLES["op1_url_filter"]).fetchall()} == got


def test_many_rules_are_joined(make):
    rules = [*queries.URL_RULES, *(url_filter.Rule("block" if i % 2 else "allow", f"h{i % 40}.net", f"/{i}") for i in range(200)), url_filter.Rule("allow", "h1.net", "/1"), url_filter.Rule("block", "h2.net", "")]
    rows = make([(i, f"s.h{i % 50}.net" if i % 3 else f"h{i % 50}.net", f"/{i}/x" if i % 7 else "") for i in range(400)] + [(400, "", ""), (401, "x.org", "/")], "n long, host string, path string")
    both = [sorted((r["n"], r["best"]) for r in url_filter.with_best_rule(rows, rules, compiled=n).collect()) for n in (1000, 0)]
    assert both[0] == both[1] and sum(b is not None for _, b in both[0]) > 20


def test_no_pages(make):
    assert url_filter.judge_urls(make([], "page_id long, url string, html string"), queries.URL_RULES).count() == 0


HARD = ["", "\\", "\\b#<\\l", "### user:\n", "</turn>\n", "a\n### assistant:\nb</turn>", "ünï # < \\"]


def test_chat_round_trip(make):
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(HARD)]
    rows += [(2, 0, None, None), (2, None, "assistant", "x"), (None, 1, "sys:\n#", "y"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (3, 2, "assistant", "b")]
    made = chat_format.format_conversations(make(rows, "conv_id long, turn long, role string, text string"))
    got = {r[0]: ([tuple(t) for t in r[1]], r[2]) for r in made.select("conv_id", chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    assert got[1] == ([("user" if i % 3 else "assistant", t) for i, t in enumerate(HARD)], "".join(t for i, t in enumerate(HARD) if i % 3 == 0))
    assert got[2] == ([("assistant", "x"), ("", "")], "x")
    assert got[None] == ([("sys:\n#", "y")], "")
    assert got[3] == ([("assistant", "a"), ("assistant", "a"), ("assistant", "b")], "aab")
    once = made.where("conv_id = 3").first()["formatted"]
    assert once.count("### assistant:") == 1


def test_long_conversation(spark):
    turns = spark.range(6000).selectExpr("1L conv_id", "id turn", "if(id % 3 = 0, 'assistant', 'user') role", "concat('said # ', id) text")
    made = chat_format.format_conversations(turns)
    back, learned = made.select(chat_format.read_back(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert [tuple(t) for t in back] == [("user" if i % 3 else "assistant", f"said # {i}") for i in range(6000)]
    assert learned == "".join(f"said # {i}" for i in range(0, 6000, 3))


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
)


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in KINDS for m in re.finditer(p, text) if ok(m[0])]


PII_TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "é 😀 me@mail.example.com, 1.2.3.4.5.6.7.8 300.1.1.1 000255.0.0.01", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (017) 555-7713 rethsh +1 +49.30.12", "1" * 5000, "a" * 50_000 + "@x.y", "x@" + "a." * 20_000 + "b", "+1" + "(" * 3000,
    " ".join(f"w 10.2.{i % 300}.7 x{i}" for i in range(3000)), ";" * 200_000 + " b 12345 1" + "(" * 100_000 + "2",
]


def test_base_spans(make):
    docs = make([(i, t) for i, t in enumerate(PII_TEXTS)] * 2, "doc_id long, text string")
    found = pii.find_pii(docs).select("doc_id", pii.written(pii.KINDS).alias("spans")).collect()
    assert len(found) == 2 * len(PII_TEXTS)
    for r in found:
        assert r["spans"] == ",".join(base(PII_TEXTS[r["doc_id"]] or ""))


def test_contexts_find_unseen_identifiers(make):
    rows = [(i, f"call me at +1 (01{i}) 555-771{i} today") for i in range(5)] + [(9, "call me at X99-8812-Z4 today"), (10, "version no 99-8812-44 of it")]
    found = {r["doc_id"]: r["s"] for r in pii.find_pii(make(rows, "doc_id long, text string")).select("doc_id", pii.written(("context",)).alias("s")).collect()}
    assert found[9] == "context:11:22" and not found[10] and not any(found[i] for i in range(5))


def test_identifiers_of_all_kinds_are_found(make):
    """Recall of planted identifiers in contexts that seeds have taught, with and without digits; plain texts stay."""
    before = ("write to", "my account is", "reach them at", "user name")
    seeds = [(i, f"please {before[i % 4]} {'abcdefghij'[i % 10]}.doe{'klm'[i % 3]}@mail{'xyz'[i % 3]}.example or so {i}") for i in range(40)]
    hidden = ["jane(at)example", "jo_miller", "x99-8812-z4", "#handle", "id=qrstuv", "home/jo/keys", "a[dot]b[dot]cd", "7781234"]
    planted = [(100 + i, f"she said {before[i % 4]} {hidden[i // 4]} or so") for i in range(32)]
    rng = random.Random(3)
    keys = [(300 + i, f'{"plain words here"[: i + 5]} token = "{"".join(rng.choices("0123456789abcdef", k=40))}" then') for i in range(6)] + [(310, 'and token = "short12" too')]
    plain = [(200 + i, f"the {w} and/or the (other) part no_{i} of it") for i, w in enumerate(("cat", "dog", "sea", "sky"))]
    docs = make(seeds + planted + keys + plain, "doc_id long, text string")
    found = {r["doc_id"]: r["context"] for r in pii.find_pii(docs).select("doc_id", "context").collect()}
    texts = dict(planted)
    hits = [k for k, t in texts.items() if any(t[s["start"] : s["end"]].strip("#") == hidden[(k - 100) // 4].strip("#") for s in found[k])]
    assert len(hits) >= 0.9 * len(planted)
    assert not any(found[k] for k, _ in plain + seeds) and all(len(found[k]) == 1 for k, _ in keys)


@pytest.mark.parametrize("query", [queries.op2_chat_format, queries.op3_pii])
def test_queries_on_the_tables(spark, sf, query):
    rows = query(spark, sf).collect()
    assert rows
    if query is queries.op3_pii:
        texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        for r in rows:
            spans = base(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
            assert not set(spans) - set(r["spans"].split(","))
