"""Ranked search against scores of every row worked out one by one."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidewire.llm import ranked_search
from tidewire.llm.common import Scratch

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in own)
    n_terms = sum(sum(c.values()) for _, c in own)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    df = {t: sum(t in c for _, c in own) for ts in asked.values() for t in ts}
    out = []
    for item, ts in asked.items():
        scored = []
        for id_, c in own:
            m = 10 + 90 * sum(c.values()) * n_docs // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, (id_ is not None, id_)))
        out += [(item, rank, id_[1], -score) for rank, (score, id_) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(4)
    words = [f"{rng.choice(['é', 'Word', 'x_', '日本'])}{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    docs = [(i, say(rng.randint(0, 80))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(60)] + [(None, docs[7][1]), (None, None), (3, ""), (3, say(30)), (3, say(30)), (5000, say(20_000))]
    rng.shuffle(docs)
    items = [(i, say(rng.randint(1, 40))) for i in range(25)] + [(90, docs[0][1]), (91, docs[1][1]), (92, next(t for i, t in docs if i == 7))]
    items += [(93, None), (94, "…, !"), (95, "nowhere"), (None, "é1"), (96, items[0][1]), (96, items[0][1]), (97, "word1 x_2"), (97, "WORD1 日本3")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"segment_chars": 3000}, {"segment_docs": 7}, {"segment_docs": 1}])
def test_ranks_equal_all_scores(make, prose, options):
    docs, items = prose
    own, asked = make(docs, "doc_id long, text string", extra=("id", "score", "rank", "term")), make(items, "item_id long, text string", extra=("item", "doc_id"))
    assert ranked(ranked_search.rank_documents(own, asked, **options)) == brute(docs, items)


def test_blocks_text_ids_and_other_k(spark, make, prose):
    docs = [(None if i is None else f"d{i}é", t) for i, t in prose[0]]
    items = [(None if i is None else f"i{i}", t) for i, t in prose[1]]
    scratch = Scratch(spark, "search-test")
    index = ranked_search.build_index(make(docs, "doc_id string, text string"), scratch, segment_chars=4000)
    for k, block_terms in ((3, 50), (70, 10**6)):  # one index, several searches
        found = ranked_search.search(index, make(items, "item_id string, text string"), Scratch(spark, "search-test"), k=k, block_terms=block_terms)
        assert ranked(found) == brute(docs, items, k)


def test_empty_tables(make):
    none, some = make([], "doc_id long, text string"), make([(1, "a b"), (2, None)], "doc_id long, text string")
    items = make([(1, "a c")], "item_id long, text string")
    assert ranked_search.rank_documents(none, items).count() == 0
    assert ranked_search.rank_documents(make([(1, None), (2, "…")], "doc_id long, text string"), items).count() == 0
    assert ranked_search.rank_documents(some, make([], "item_id long, text string")).count() == 0
    assert ranked(ranked_search.rank_documents(some, items)) == brute([(1, "a b"), (2, None)], [(1, "a c")])


def test_range_maxima_take_the_first_of_equals():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 40, 9)
    first = np.r_[0, np.cumsum(sizes)]
    places = np.concatenate([np.sort(rng.choice(50, n, replace=False)) for n in sizes])
    impacts = rng.integers(1, 9, len(places))
    lists = ranked_search.RangeMaxima(50, first, places, impacts)
    for t, n in enumerate(sizes):
        for a in range(n + 1):
            for b in range(a, n + 1):
                got = lists.greatest(np.array([first[t] + a]), np.array([first[t] + b]))[0]
                assert got == (len(places) if a == b else first[t] + a + int(impacts[first[t] + a : first[t] + b].argmax()))


def test_most_intervals_are_never_scored():
    """Copies that tie with the last of the top end the search, however many they are."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    item = " ".join(words[:20])
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(1500)] + [item] * 500
    segment = dict(zip(("ids", "sizes", "n_docs", "n_terms", "terms", "df", "places", "counts"), ranked_search._segment(list(range(2000)), texts)))
    weights = np.ones(20, dtype=np.int64)
    block = ranked_search.Asked([0], item.split(), [(np.arange(20), weights)], segment["n_docs"], segment["n_terms"])
    top = ranked_search.Top(10)
    assert block.search(segment, [top]) < 400
    assert [id_[1] for _, id_ in top.rows] == list(range(1500, 1510))
