"""Quality classifier, packing, benchmark decontamination and the pipeline."""

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidewire.llm import latent_search, packing, quality, queries


def test_quality_on_held_out_labels(spark, sf):
    big = "/root/testdata/sf0.01"
    scored = queries.op5_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.95
    assert np.mean([r["predicted"] for r in scored if r["quality"] == 1]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in scored)


def test_scores_of_the_discriminant(spark, sf="/root/testdata/sf0.01"):
    """Every score of the query against class covariances worked out with numpy."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    x = dict(zip(texts, quality.document_vectors(list(texts.values()))))
    learned = {k: np.array([x[d] for d, q in marks.items() if q == k and d in x and zlib.crc32(str(d).encode()) % 4 != 2]) for k in (0, 1)}
    n = sum(map(len, learned.values()))

    def log_density(rows, v):
        cov = np.cov(rows.T, bias=True)
        cov = 0.9 * cov + 0.1 * np.diag(np.diag(cov)) + 1e-3 * np.eye(len(cov))
        away = v - rows.mean(axis=0)
        return np.log((len(rows) + 1) / (n + 2)) - 0.5 * (np.linalg.slogdet(cov)[1] + away @ np.linalg.solve(cov, away))

    for r in queries.op5_quality(spark, sf).collect():
        want = 1 / (1 + np.exp(np.clip(log_density(learned[0], x[r["doc_id"]]) - log_density(learned[1], x[r["doc_id"]]), -700, 700)))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_quality_edges(make):
    docs = make([(1, "a clean text of words"), (2, None), (3, ""), (3, ""), (None, "!!!! ####"), (5, "w " * 100_000)], "doc_id long, text string")
    for labels in ([], [(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 1), (2, None, 0)], [(1, 1, 0)]):
        model = quality.fit(docs, make(labels, "doc_id long, quality int, toxic int"))
        got = [r[0] for r in docs.select(quality.score(model, F.col("text"))).collect()]
        assert len(got) == 6 and all(0 <= s <= 1 for s in got)
    assert docs.where("false").select(quality.score(model, F.col("text"))).count() == 0


def test_small_classes_keep_their_own_moments(make):
    """One rejected row is enough for a class: its own text gets a low score, and clean texts stay high, at 1 and at 20 rows alike."""
    clean = [(i, f"a clean text, number {i}, of several plain words. it goes on for a while.") for i in range(60)]
    for few in (1, 12, 16, 20):
        junk = [(100 + i, "!!!! #### |||| $$$$ " * (5 + i)) for i in range(few)]
        model = quality.fit(make(clean + junk, "doc_id long, text string"), make([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int"))
        scores = model.scores(quality.document_vectors([clean[3][1], junk[0][1]]))
        assert scores[0] > 0.99 and scores[1] < 0.01, (few, scores)


def pieces(text, encode):
    ids = np.array([*encode(text), 2], dtype="<u4")
    n = len(ids)
    bounds = [0, *range(n % 1024 or 1024, n + 1, 1024)] if n > 1024 else [0, n]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def test_packing(spark, make, sf):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs += [(-1, None), (-2, ""), (-3, "x " * 5000), (-4, "it's  \n\n a\tb 12 …😀 ñ"), (-4, "it's  \n\n a\tb 12 …😀 ñ"), (None, "no id"), (-5, "a" * 3000)]
    docs += [(9007199254740993, "large id beside a null one"), (-6, "a <|endoftext|> b<|endoftext|>\n<|endoftext|"), (-7, "<|endoftext|>" * 1500)]
    packed = packing.pack(packing.tokenize_pieces(make(docs, "doc_id long, text string"))).collect()
    want = sorted((str(k), *p) for k, t in docs for p in pieces(t or "", encode))
    assert sorted((str(r["id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    bins = {}
    for r in sorted(packed, key=lambda r: r["offset"]):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 1024
    assert len(bins) <= 1.02 * sum(r["length"] for r in packed) / 1024 + 1
    assert packing.pack(packing.tokenize_pieces(make([], "doc_id long, text string"))).count() == 0


def test_plan_is_best_fit():
    rng = np.random.default_rng(6)
    lengths = sorted(rng.integers(1, 101, 3000).tolist(), reverse=True)
    free = []
    for x in lengths:  # one by one
        fits = [i for i, f in enumerate(free) if f >= x]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= x
        else:
            free.append(100 - x)
    values, n = np.unique(lengths, return_counts=True)
    plan = packing.plan_best_fit(dict(zip(values.tolist(), n.tolist())), 100)
    filled, placed = {}, {}
    for length, first, number, bin_, each, base in plan:
        placed[length] = placed.get(length, 0) + number
        for i in range(number):
            filled.setdefault(bin_ + i // each, []).append((base + i % each * length, length))
    assert placed == dict(zip(values.tolist(), n.tolist())) and len(filled) == len(free)
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100


def said(text):
    return " ".join(re.sub(r"[^\w]", " ", text.lower()).split())


def test_leaks(spark, make, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    item = next(t for _, t in items if 30 <= len(t.split()) <= 60)
    words = item.split()
    loose = " ".join(w for i, w in enumerate(words) if i % 8 != 3)  # seven of eight words are left
    exact = {(k, i) for k, t in docs for i, q in items if said(q) in said(t)}
    rows = docs + [(-1, f"{docs[2][1]} {loose} {docs[3][1]}"), (-2, None), (-3, ""), (-4, item.upper()), (-4, item.upper())]
    got = [(r["doc_id"], r["item_id"]) for r in latent_search.find_leaks(make(rows, "doc_id long, text string"), make([*items, (900, None), (901, "one two")], "item_id long, text string")).collect()]
    key = next(i for i, t in items if t == item)
    planted = {(-1, key), (-4, key)}
    assert (exact | planted) - set(got) == set() and got.count((-4, key)) == 2
    assert {d for d, _ in got} == {d for d, _ in exact | planted}
    none = make([], "item_id long, text string")
    assert latent_search.find_leaks(make(rows[:3], "doc_id long, text string"), none).count() == 0
    assert latent_search.find_leaks(make([], "doc_id long, text string"), make(items, "item_id long, text string")).count() == 0


def test_leaks_among_words_of_the_benchmark(make):
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 2000, 20))) for i in range(40)] + [(99, "zebra")]
    loose = " ".join(w for i, w in enumerate(items[7][1].split()) if i % 6 != 3)
    around = "zebra " * 40
    docs = [(1, f"{around}{items[3][1]} {around}"), (2, f"{around}{loose} {around}"), (3, around)] + [(i, f"other words {i}") for i in range(10, 60)]
    docs, bench = make(docs, "doc_id long, text string"), make(items, "item_id long, text string")
    found = latent_search.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 3), (2, 7)}
    assert all(0 < r["cosine"] < 0.5 for r in found)  # a test of the whole window would lose them
    assert latent_search.find_leaks(docs, bench, cosine=0.5).count() == 0


def test_recall_of_paraphrases(make):
    """Planted passages with words left out, put in and replaced, held against the longest common subsequence."""
    rng = np.random.default_rng(12)
    words = [f"w{x}" for x in range(3000)]
    say = lambda n: list(rng.choice(words, n))
    items = [(i, say(int(rng.integers(15, 90)))) for i in range(120)]
    docs = []
    for i, item in items:
        told = list(item)
        for at in sorted(rng.choice(len(item), len(item) // 7, replace=False), reverse=True):
            kind = rng.integers(3)
            told[at : at + 1] = [] if kind == 0 else say(1) if kind == 1 else [told[at], *say(1)]
        docs.append((i, " ".join(say(int(rng.integers(0, 300))) + told + say(int(rng.integers(0, 300))))))
    docs += [(1000 + i, " ".join(say(200))) for i in range(100)]
    bench = make([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    for options in ({}, {"block": 30}, {"block_bytes": 20_000}):
        found = {(r["doc_id"], r["item_id"]) for r in latent_search.find_leaks(make(docs, "doc_id long, text string"), bench, **options).collect()}
        assert len(found & {(i, i) for i, _ in items}) >= 0.98 * len(items) and not found - {(i, i) for i, _ in items}


def test_blocks_of_items_give_the_same_leaks(make):
    """Items in many blocks, an item with several texts and repeated rows give what one block gives, and the same rows stay."""
    rng = np.random.default_rng(4)
    items = [(i // 2, " ".join(f"w{x}" for x in rng.integers(0, 500, 15))) for i in range(30)] + [(None, "n1 n2 n3 n4 n5 n6"), (None, None)]
    docs = [(i, f"before {items[i % 31][1]} between {items[(i + 1) % 31][1]} after") for i in range(12)]
    docs += [docs[0], docs[0], (0, docs[3][1]), (None, "n1 n2 n3 n4 n5 n6"), (50, "clean words alone"), (51, None)]
    own, bench = make(docs, "doc_id long, text string"), make(items, "item_id long, text string")
    rows = lambda **o: sorted(((r["doc_id"], r["item_id"], round(r["similarity"], 6)) for r in latent_search.find_leaks(own, bench, **o).collect()), key=str)
    one = rows()
    assert one and one == rows(block=4) and [r for r in one if r[0] is None] == [(None, None, 1.0)]
    for options in ({}, {"block": 4}):
        assert sorted(r["doc_id"] for r in latent_search.without_leaks(own, bench, **options).collect()) == [50, 51]
    assert latent_search.without_leaks(own, bench.limit(0)).count() == len(docs)


def test_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ([bytes([x]) for x in rng.integers(97, 101, rng.integers(1, 30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert latent_search.common_subsequence(masks, len(a), b) == table[-1, -1]


def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(out := str(tmp_path / name))
        docs = spark.read.parquet(out)
        kept[name] = {r["doc_id"] for r in docs.collect()}
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    clean = [d for d, q in labels.items() if q == 1]
    assert len(kept["quality"] & set(clean)) >= 0.97 * len(clean) and len(kept["quality"]) < len(texts)
    assert kept["line_dedup"] == kept["quality"] and len(kept["simhash"]) < len(kept["line_dedup"])
    items = [said(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = spark.read.parquet(str(tmp_path / "decontamination")).collect()
    assert left and not any(q in said(r["text"]) for r in left for q in items)
    assert kept["packing"] == kept["decontamination"]
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
