"""Suffix-array, line, SimHash and embedding dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import embedding_dedup, line_dedup, queries, simhash, suffix_dedup
from tidewire.llm.common import Scratch
from tidewire.llm.components import connected_components


def classes(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)] + [(5, 5)]
    edges = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(Scratch(spark, "t"), edges).collect()}
    want = classes(500, links)
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert connected_components(Scratch(spark, "t"), edges.where("false")).count() == 0


def removed(texts, match):
    seen = collections.Counter(b[i : i + match] for b in texts for i in range(len(b) - match + 1))
    out = []
    for b in texts:
        mark = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if seen[b[i : i + match]] > 1:
                mark[i : i + match] = b"\1" * match
        out.append((len(b), sum(mark), len(re.findall(b"\1+", bytes(mark))), bytes(x for x, m in zip(b, mark) if not m)))
    return out


def told(texts, words):
    """Number of maximal runs of words covered by strings of ``words`` words that another row has; only first places in a text count."""
    split = [re.findall(rb"[^\x20\x09-\x0D]+", b) for b in texts]
    at = collections.defaultdict(set)
    for k, (b, w) in enumerate(zip(texts, split)):
        for i in range(len(w) - words + 1):
            at[tuple(w[i : i + words])].add((k, b))
    out = []
    for b, w in zip(texts, split):
        runs, end, seen = 0, 0, set()
        for i in range(len(w) - words + 1):
            gram = tuple(w[i : i + words])
            if len(at[gram]) > 1 and gram not in seen:
                runs, end = runs + (i >= end), i + words
            seen.add(gram)
        out.append(runs)
    return out


@pytest.mark.parametrize("hot,bits", [(20_000, 64), (2, 64), (20_000, 7), (2, 5)])
def test_repeated_bytes(make, hot, bits):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(30), prose(14), prose(60)]
    texts = [None, "", "short", "ab " * 200, prose(40) + "ab " * 90]
    for i in range(40):
        parts = [prose(rng.randrange(5, 40)) for _ in range(3)]
        parts.insert(1, rng.choice(shared)[rng.randrange(9) :].replace(" ", rng.choice((" ", "\n", "  "))))
        texts.append(rng.choice((" ", "\n")).join(parts))
    texts += [texts[7], texts[7], texts[9][:-1] + "x", texts[11] + texts[11], "one two " * 3, "one two " * 3]
    docs = make([(i if i != 8 else None, t) for i, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    got = suffix_dedup.dedup_bytes(docs, match=60, prefix=20, words=10, words_prefix=3, batches=3, hot=hot, hash_bits=bits).collect()
    raw = [(t or "").encode() for t in [*texts, texts[3]]]
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got) == sorted(removed(raw, 60))
    want = {b: n for b, n in zip(raw, told(raw, 10))}
    assert sum(want.values()) > 20
    names = {i if i != 8 else None: b for i, b in enumerate(raw[:-1])}
    assert {r["doc_id"]: len(r["passages"]) for r in got} == {i: want[b] for i, b in names.items()}
    if bits == 64:
        assert suffix_dedup.dedup_bytes(docs.where("false")).count() == 0


def test_suffix_family_goes_on(spark, tmp_path):
    texts = [(bytes([i]), "".join(random.Random(i // 2).choices("abc ", k=900))) for i in range(10)]
    batch = lambda k: spark.createDataFrame(texts[2 * k : 2 * k + 2], "doc binary, text string")
    family = suffix_dedup.SuffixFamily(spark, str(tmp_path))
    assert family.add(spark.createDataFrame(texts[::2], "doc binary, text string")).count() == 0
    for k in range(1, 4):
        family = suffix_dedup.SuffixFamily(spark, str(tmp_path))  # as a later run finds it
        assert family.add(batch(k).where(F.col("doc") == texts[2 * k + 1][0])).count() > 0
        assert sorted(family.levels) == [i for i in range(3) if (k + 1) >> i & 1]
    for _, level in family.levels.values():
        rows = [(r["head"], r["key"]) for r in level.orderBy("head", "key").collect()]
        assert rows == sorted(rows)


def test_repeats_across_long_texts(spark, make):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(1_200_000))
    cut = (1 << 20) - 200  # a repeat over the place where long texts are cut
    docs = make([(1, long), (2, "x" * 50 + long[cut : cut + 500] + "y")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_bytes(docs).collect()}
    assert got == {1: (500, 1, (long[:cut] + long[cut + 500 :]).encode()), 2: (500, 1, b"x" * 50 + b"y")}


def test_repeated_bytes_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, removed([r["text"].encode() for r in docs], 400))}
    for r in queries.op4_suffix_dedup(spark, sf).collect():
        n, gone, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def lines_kept(rows, window=2, divisor=3):
    chunks = [[(a, b, "\n".join(t.split("\n")[a:b])) for a, b in line_dedup.line_chunks(t, window, divisor)] for _, t in rows]
    first = {}
    for (key, _), own in sorted(zip(rows, chunks), key=lambda x: x[0][0]):
        for k, (a, b, said) in enumerate(own):
            if b - a > 1:
                first[said] = min(first.get(said, (key, k)), (key, k))
    return {key: "\n".join(x for k, (a, b, said) in enumerate(own) if b - a < 2 or first[said] == (key, k) for x in t.split("\n")[a:b]) for (key, t), own in zip(rows, chunks)}


def passages_kept(rows, over, window=2, divisor=3):
    """As lines_kept, with runs of whole lines of more than ``over`` words too; a line goes if a run or chunk over it stands at a smaller place."""
    first, runs = {}, []
    for key, t in rows:
        lines, own = t.split("\n"), set()
        words = [len(x.split()) for x in lines]
        own |= {(a, b) for a, b in line_dedup.line_chunks(t, window, divisor) if b - a > 1}
        for a in (i for i, n in enumerate(words) if n):
            b = next((b for b in range(a + 1, len(lines) + 1) if sum(words[a:b]) > over), None)
            own |= {(a, b)} if b else set()
        for b in (i + 1 for i, n in enumerate(words) if n):
            a = next((a for a in range(b - 1, -1, -1) if sum(words[a:b]) > over), None)
            own |= {(a, b)} if a is not None else set()
        runs.append([(a, b, "\n".join(lines[a:b])) for a, b in own])
        for a, _, said in runs[-1]:
            first[said] = min(first.get(said, (key, a)), (key, a))
    out = {}
    for (key, t), own in zip(rows, runs):
        lines = t.split("\n")
        gone = {i for a, b, said in own if first[said] != (key, a) for i in range(a, b)}
        worded = [i for i, x in enumerate(lines) if x.strip()]
        gone |= {i for a, b in zip(worded, worded[1:]) if a in gone and b in gone for i in range(a, b)}
        out[key] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_lines(spark, make, sf):
    rng = random.Random(3)
    block = [f"line {i} of a passage" for i in range(30)]
    rows = []
    for i in range(20):
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randrange(1, 20))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + block[rng.randrange(5) :] + own[at:])))
    rows += [(30, ""), (31, "one line"), (32, "\n\n\n"), (33, "\n".join(block * 3))]
    done = line_dedup.dedup_lines(make([*rows, (40, None)], "doc_id long, text string", ("n_lines", "hash", "said", "_key", "_goes", "_new")))
    got = {r["doc_id"]: r["text"] for r in done.collect()}
    assert got == lines_kept(rows) | {40: None}
    assert sum(len(t.split("\n")) for t in lines_kept(rows).values()) < 0.6 * sum(t.count("\n") + 1 for _, t in rows)
    assert {"hash", "said"} <= set(done.columns) and done.where("false").count() == 0
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    plain = line_dedup.dedup_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    assert {r["doc_id"]: r["text"] for r in plain.collect()} == lines_kept(docs)
    want = passages_kept(docs, 50)
    for r in queries.op8_line_dedup(spark, sf).collect():
        assert r["kept_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_short_passages_of_many_words_go(spark, make):
    rng = random.Random(9)
    rows, plants = [], []
    for n in range(1, 7):  # passages of 1 to 6 lines, 51 to 66 words
        plants.append([" ".join(f"p{n}w{rng.randrange(10**6)}" for _ in range(51 // n + 1)) for _ in range(n)])
    plants.append([*plants[0][:1], "", " ".join(f"z{i}" for i in range(60))])  # lines without words between
    for i in range(60):
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randrange(2, 9))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + plants[i % 7] + own[at:])))
    rows += [(60, None), (61, plants[0][0]), (None, "x\n" + plants[3][0] + "\ny")]
    short = "fifty words " * 25
    rows += [(62, f"a\n{short}\nb"), (63, f"c\n{short}\nd")]  # one line of just 50 words
    docs = make(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, passage_words=50).collect()}
    assert got[60] is None and got[61] == "" and short in got[63] and got[None] == rows[62][1]
    for i, text in rows[:60]:
        own = [x for x in text.split("\n") if x.startswith("own")]
        assert [x for x in got[i].split("\n") if x.startswith("own")] == own
        if i >= 7:
            assert got[i] == "\n".join(own)
    assert all(x in "\n".join(got[i] for i in range(7)) for p in plants for x in p)
    # the pipeline's stage does so
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    done = {r["doc_id"]: r["text"] for r in stage(spark, docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)}), "").collect()}
    assert done == got


def test_line_passages_cover_every_run():
    rng = random.Random(10)
    for _ in range(300):
        lines = [" ".join("w" * rng.choice((0, 1, 2, 5, 9))) for _ in range(rng.randrange(1, 12))]
        found = line_dedup.line_passages(lines, 8)
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                words = sum(len(x.split()) for x in lines[a:b])
                inside = {i for x, y in found if a <= x and y <= b for i in range(x, y)}
                assert (words > 8) == bool(inside)
                assert words <= 8 or {i for i in range(a, b) if lines[i]} <= inside


def test_boundaries_resist_shifts():
    lines = [f"line {i}" for i in range(200)]
    cut = lambda x: {"\n".join(x[a:b]) for a, b in line_dedup.line_chunks("\n".join(x), 2, 3)}
    assert len(cut(lines) & cut(["new"] + lines)) >= len(cut(lines)) - 2


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, bits=4):
    return classes(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits])


def test_simhash(make, spark, sf):
    texts = [None, "", " \t ", "One two", "one two three four", "One TWO three four five É"] + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    texts += texts[:12]
    fps = [plain_simhash(t or "") for t in texts]
    assert [simhash.simhash(t or "") for t in texts] == fps
    got = simhash.near_duplicates(make(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(linked(fps)))
    assert simhash.near_duplicates(make([], "doc_id long, text string")).count() == 0


def test_near_fingerprints_lose_no_link(spark):
    rng = random.Random(4)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for f in fps[:100]]
    fps += [fps[0] ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]  # one dense class
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    place = {f: i for i, f in enumerate(signed)}
    links = [(place[r["a"]], place[r["b"]]) for r in simhash.near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in links)
    assert classes(len(fps), links) == linked(fps)


def test_line_ids_beside_null_ids(make):
    said = "a b\nc d\ne f\ng h\ni j\nk l\nm n\no p"
    small, large = (line_dedup.dedup_lines(make([(None, "x"), (k, said), (k + 1, said + "\nz")], "doc_id long, text string")).collect() for k in (1, 9007199254740992))
    assert sorted((r["text"], r["n_removed_lines"]) for r in small) == sorted((r["text"], r["n_removed_lines"]) for r in large)
    assert sum(r["n_removed_lines"] for r in large) > 0 and {r["doc_id"] for r in large} == {None, 9007199254740992, 9007199254740993}


def test_lines_of_rows_that_share_an_id(make):
    """Rows of null or repeated ids lose what repeats like rows of ids of their own; one row keeps each line."""
    block = [f"line {i} of a long passage" for i in range(30)]
    said = "\n".join(block)
    own = line_dedup.dedup_lines(make([(i, said) for i in range(40)], "doc_id long, text string")).collect()
    removed = sum(r["n_removed_lines"] for r in own)
    for ids in ([None] * 40, [7] * 40, [None, 7] * 20, [None, 7, 8, 9] * 10):
        done = line_dedup.dedup_lines(make([(i, said) for i in ids], "doc_id long, text string", ("id", "key", "id_", "key_", "n"))).collect()
        assert sum(r["n_removed_lines"] for r in done) == removed and len(done) == 40 and {"id_", "key_"} <= set(done[0].asDict())
        assert sorted(str(r["doc_id"]) for r in done) == sorted(map(str, ids)) and sum(r["text"] == said for r in done) == 1
    # different texts under one id, with and without copies, beside rows of other ids
    rng = random.Random(2)
    texts = ["\n".join(f"own {k} {j}" for j in range(rng.randrange(3, 9))) + "\n" + said for k in range(12)] + ["one line", "", None, "one line", "", None]
    unique = line_dedup.dedup_lines(make(list(enumerate(texts)), "doc_id long, text string"), passage_words=50).collect()
    shared = line_dedup.dedup_lines(make([(None, t) for t in texts], "doc_id long, text string"), passage_words=50).collect()
    assert sum(r["n_removed_lines"] for r in shared) == sum(r["n_removed_lines"] for r in unique) and sum(said in (r["text"] or "") for r in shared) == 1
    assert sorted(str(r["text"]) for r in shared if r["n_lines"] < 2) == sorted(map(str, ["one line", "one line", "", "", None, None]))


def test_one_row_of_a_class_stays_where_ids_repeat(make):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(7, words), (3, words + " end"), (3, "quite another text here"), (9, "quite another text here"), (7, "third text of its own"), (None, words), (None, "alone")]
    docs = make(rows, "doc_id long, text string", ("_stay", "root", "text_key"))
    kept = sorted((str(r["doc_id"]), r["text"]) for r in simhash.drop_near_duplicates(docs).collect())
    assert kept == sorted([("3", words + " end"), ("3", "quite another text here"), ("7", "third text of its own"), ("None", "alone")])


def test_near_copies_of_the_stage(spark, make):
    rng = random.Random(11)
    texts = []
    for i in range(40):  # copies with one to six words changed, and a class of many
        words = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for _ in range(40 if i == 0 else 4):
            own = list(words)
            for at in rng.sample(range(150), rng.randrange(1, 7)):
                own[at] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    words = [f"w{rng.randrange(3000)}" for _ in range(200)]
    for _ in range(60):  # a class whose members are mostly just below the bound
        own = list(words)
        for at in rng.sample(range(200), 6):
            own[at] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    texts += [None, "", " ", "one two", "One  two", "one two three", texts[0].upper()]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else {()} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = set(classes(len(texts), links))
    assert len(linked([plain_simhash(t or "") for t in texts])) and len(want) < len(set(linked([plain_simhash(t or "") for t in texts])))
    docs = make(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    for block in (1024, 7):
        found = {r["id"]: r["root"] for r in simhash.similar_texts(docs, block=block).collect()}
        first = {}
        for i in sorted(found):
            first.setdefault(found[i], i)
        assert [first[found[i]] for i in range(len(texts))] == classes(len(texts), links)
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted(want)
    assert stage(spark, docs.where("false"), "").count() == 0


def test_a_crowd_of_texts_below_the_bound_costs_a_few_rows_a_text(spark, make, monkeypatch):
    kept = {}

    class Counting(Scratch):
        def keep(self, df, name):
            out = super().keep(df, name)
            kept[name] = out.count()
            return out

    monkeypatch.setattr(simhash, "Scratch", Counting)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(3, 6)):
            words[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
        if i % 10 == 0:  # and some with a near copy
            words[rng.randrange(150)] = "x"
            texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert 100 < len(set(classes(len(texts), links))) < len(texts) - 20
    rows = {}
    for n, block in ((len(texts) // 2, 1024), (len(texts), 1024), (len(texts), 40)):
        found = {r["id"]: r["root"] for r in simhash.similar_texts(make(list(enumerate(texts[:n])), "doc_id long, text string"), block=block).collect()}
        first = {}
        for i in sorted(found):
            first.setdefault(found[i], i)
        assert [first[found[i]] for i in range(n)] == classes(n, [(i, j) for i, j in links if i < n])
        rows[n] = kept["shared"]
    small, large = sorted(rows)
    assert rows[large] <= 3 * large and rows[large] <= 2.5 * rows[small]


def test_crowds():
    rng = np.random.default_rng(14)
    marks = rng.integers(0, 1 << 63, (400, 8), dtype=np.uint64)
    marks[100:200] = marks[0] ^ (np.uint64(1) << rng.integers(0, 64, (100, 8), dtype=np.uint64))
    marks[200:300] = marks[:100] ^ np.uint64(1)
    key = np.sort(rng.integers(0, 60, 400))
    key[:120] = 0
    key = np.sort(key)
    near = lambda i, j: np.bitwise_count(marks[i] ^ marks[j]).sum(dtype=int) <= 20
    order = rng.permutation(400)
    marks = marks[order]
    edges = simhash._crowded(key, marks, 20)
    assert all(key[a] == key[b] and near(a, b) for a, b in edges) and len(edges) > 20
    want = [(i, j) for i in range(400) for j in range(i) if key[i] == key[j] and near(i, j)]
    got = classes(400, edges)
    assert {i for e in want for i in e} >= {i for e in edges for i in e}
    assert len({(got[i], got[j]) for i, j in want if got[i] != got[j]}) == 0
    # rows have no company in their own crowd, in short runs and in long ones
    for size, many in ((100, 256), (100, 8)):
        words = np.repeat(marks[:1, :2], size, axis=0) ^ (np.arange(size, dtype=np.uint64)[:, None] % np.uint64(2))
        run, old = np.zeros(size, dtype=np.int64), simhash.MANY
        simhash.MANY = many
        try:
            company = lambda crowd: simhash._company(run, words, 35, np.array(crowd, dtype=np.int64)).tolist()
            assert company([0] * size) == [True] * size and company([-5] * size) == [False] * size
            assert company([-5] * (size - 1) + [0]) == [True] * size and company([-5] * (size - 1) + [-7]) == [True] * size
        finally:
            simhash.MANY = old


def test_candidates_of_the_stage_are_near_fingerprints():
    rng = np.random.default_rng(12)
    draw = lambda n: rng.integers(0, 1 << 63, n, dtype=np.uint64)
    salts = np.random.default_rng(42).integers(0, 1 << 63, 8, dtype=np.uint64).tolist()

    def plain(grams, salt):
        hashes = []
        for x in grams.tolist():
            x ^= salt
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
            x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
            hashes.append(x ^ x >> 31)
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    sets = [draw(n) for n in (1, 4, 5, 255, 256, 700, 511, 9000, 3)]
    assert simhash.set_simhashes(sets, 8).tolist() == [[plain(g, s) for s in salts] for g in sets]
    assert simhash.set_simhashes([], 8).shape == (0, 8)
    # pairs at Jaccard 0.8 meet in one of four rounds
    for common, a, b in ((12, 3, 0), (80, 10, 10), (400, 100, 0)):
        pairs = [(x[: common + a], np.concatenate((x[:common], x[common + a :]))) for x in (draw(common + a + b) for _ in range(300))]
        left, right = (simhash.set_simhashes([p[k] for p in pairs], 8) for k in (0, 1))
        assert (simhash._place(left ^ right, simhash._reach(128, 0.8, 2.6)) < 0).sum() <= 2
    # what differs in one bit of a segment at most, and in few in all, meets; runs are short and long
    words = draw((1200, 2))
    words[300:600] = words[:300] ^ (np.uint64(1) << rng.integers(0, 64, (300, 2), dtype=np.uint64))
    words[600:1000] = words[0] ^ (np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64))
    keys = simhash._deletions(words, 1)
    order = np.argsort(keys, axis=None, kind="stable")
    rows = np.repeat(np.arange(1200), 128)[order]
    met = simhash._company(keys.ravel()[order], words[rows], 35)
    found = set(zip(keys.ravel()[order][met].tolist(), rows[met].tolist()))
    i, j = np.triu_indices(1200, 1)
    near = np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=int) <= 35
    i, j = i[near], j[near]
    segments = (words[i] ^ words[j]).view("<u2")
    place = simhash._place(words[i] ^ words[j], 35)
    assert ((np.bitwise_count(segments) <= 1).any(axis=1) == (place >= 0)).all() and (place >= 0).sum() > 80_000
    for a, b, p in zip(i[place >= 0].tolist(), j[place >= 0].tolist(), place[place >= 0].tolist()):
        assert keys[a, p] == keys[b, p] and {(int(keys[a, p]), a), (int(keys[b, p]), b)} <= found
    alone = {r for _, r in found} - set(i.tolist()) - set(j.tolist())
    assert not alone


def test_vectors(make):
    rng = np.random.default_rng(5)
    seeds = rng.standard_normal((60, 16))
    near = [(s + 0.12 * rng.standard_normal(16) * k).tolist() for s in seeds for k in range(4)]
    dense = (seeds[0] + 0.05 * rng.standard_normal((150, 16))).tolist()
    rows = near + dense + near[:5] + [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16]
    for block in (2048, 40):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(make(list(enumerate(rows)), "vec_id long, embedding array<double>"), block=block, miss=1e-6).collect()}
        x = np.array(rows[:-6])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        close = x @ x.T >= 0.9
        np.fill_diagonal(close, False)
        root = classes(len(x), zip(*np.nonzero(close)))
        assert got == {i: (int(close[i].sum()), root[i]) for i in range(len(x))} | {i: (0, i) for i in range(len(x), len(rows))}
    assert embedding_dedup.near_vectors(make([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_of_several_lengths(make):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (None, [1.0, 0.0]), (7, [0.0]), (8, [-3.0]), (9, [-1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(make(rows, "vec_id long, embedding array<double>", ("node", "width", "unit"))).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (0, 2), 3: (2, 3), 4: (2, 3), 5: (2, 3), None: (2, 0), 7: (0, 7), 8: (1, 8), 9: (1, 8)}


def test_vectors_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = queries.op10_embedding_dedup(spark, sf).agg(F.sum("n_links")).first()[0]
    true = int((x @ x.T >= 0.9).sum()) - len(x)
    assert found <= true and found >= 0.9 * true
