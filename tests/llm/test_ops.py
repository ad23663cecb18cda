"""Each operator against a brute-force version, over nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import heapq
import os
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

os.environ["TOKENIZERS_PARALLELISM"] = "false"

from millrace.llm import bpe, jaccard_join, media, mixing, pii, queries, sharding, token_files, topk, toxicity, url_filter  # noqa: E402
from millrace.llm._common import connected_components, gapless_rank  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id long, n int, token string, size int, block int, digest string, source string"


def docs_of(spark, rows):
    """Documents with other columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 7, 1, "x", 2, 3, "y", s) for i, t, s in rows], DOCS)


def sample_rows(seed=1, n=120):
    rnd = random.Random(seed)
    words = ["the", "and", "Thon", "ereth", "été", "über", "12", "a.b", "don't", "x@y.de", "+1 (555) 555-1234", "10.0.0.1", "...", "\n", "<|endoftext|>", "ΣΑΣ", "😀"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 8, 30]))), f"s{min(rnd.randrange(9), 3)}") for i in range(n)]
    rows += [(n, None, None), (n + 1, "", "s1"), (n + 2, " \n ", "s1"), (None, "null id text here it is", "s2"), (n + 3, "lang " * 30_000, "s0"), (5, rows[5][1], rows[5][2])]
    return rows


ROWS = sample_rows()


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs_of(spark, ROWS[:1]).where("false")


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(queries.tokenizer_path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_bpe(docs, empty, tokenizers):
    path, lib = queries.tokenizer_path("word_bpe_49k.json"), tokenizers["word_bpe_49k.json"]
    trips, digests = by_id(bpe.bpe_round_trip(docs, path)), by_id(bpe.bpe_digests(docs, path))
    for i, t, _ in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        raw, text = np.array(ids, "<u4").tobytes(), lib.decode(ids, skip_special_tokens=False)
        assert all(bytes(r["ids"]) == raw and r["decoded"] == text for r in trips[i])
        want = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want for r in digests[i])
    assert len(digests[5]) == 2 and bpe.bpe_digests(empty, path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_on_odd_texts(tokenizers, name):
    from millrace.llm import _bpe

    rnd = random.Random(4)
    letters = " \n\t'abzAZ019.,<|>é́ß　Σ\x1c\x85\xa0×µ"
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(1500)] + ["", " ", "a<|endoftext|> b", "A" * 500, "\x00 \x00a", "Ā ĀbĀ"]
    coder = _bpe.Encoder(queries.tokenizer_path(name))
    for got, t in zip(coder.encode_all(texts), texts):
        assert np.frombuffer(got, "<u4").tolist() == tokenizers[name].encode(t, add_special_tokens=False).ids, repr(t)


def test_full_tables_start_anew(tokenizers, monkeypatch):
    from millrace.llm import _bpe

    for name, value in (("MAX_CHUNKS", 50), ("MAX_PIECES", 40), ("_AT_ONCE", 200)):
        monkeypatch.setattr(_bpe, name, value)
    coder = _bpe.Encoder(queries.tokenizer_path("byte_bpe_50k.json"))
    rnd = random.Random(2)
    texts = [" ".join("".join(rnd.choices("abcde", k=4)) for _ in range(40)) for _ in range(60)]
    lib = tokenizers["byte_bpe_50k.json"]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode_all(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    """A word over a and b whose signed sums cancel, and its complement."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


CANCELLING = [p + w for n in (16, 1024, 4096) for p in ("", "xxxxxxxx", "same beginning ") for w in thue_morse(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_tells_texts_apart_whose_sums_cancel(tokenizers, name, monkeypatch):
    from millrace.llm import _bpe

    lib = tokenizers[name]
    want = [lib.encode(t, add_special_tokens=False).ids for t in CANCELLING * 2]
    path = queries.tokenizer_path(name)
    assert [np.frombuffer(x, "<u4").tolist() for x in _bpe.Encoder(path).encode_all(CANCELLING * 2)] == want
    one_by_one = _bpe.Encoder(path)
    assert [np.frombuffer(one_by_one.encode(t), "<u4").tolist() for t in CANCELLING * 2] == want
    # Nothing hangs on the hash: with one that is constant, all chunks still get their own ids.
    monkeypatch.setattr(_bpe, "mix", lambda x: x * np.uint64(0))
    texts = ["a bb ccc", "ccc a dd", "a a bb bb-x", *CANCELLING]
    blind = _bpe.Encoder(path)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in blind.encode_all(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_encoder_refuses_other_settings(tmp_path):
    import json

    from millrace.llm import _bpe

    for name, change in (("word_bpe_49k.json", {"normalizer": None}), ("byte_bpe_50k.json", {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}})):
        spec = json.load(open(queries.tokenizer_path(name))) | change
        (tmp_path / name).write_text(json.dumps(spec))
        with pytest.raises(ValueError):
            _bpe.Encoder(str(tmp_path / name))
    with pytest.raises(ValueError):
        _bpe.Encoder(queries.tokenizer_path("byte_bpe_50k.json")).decode(b"\1\0\0\0")


def test_token_files(docs, empty, tokenizers, spark):
    path, lib = queries.tokenizer_path("byte_bpe_50k.json"), tokenizers["byte_bpe_50k.json"]
    got = sorted(token_files.token_files(docs, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i))
    at, text = 0, {i: t for i, t, _ in ROWS}
    for r in got:
        ids = lib.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files(empty, path).count() == 0
    where = token_files.write_token_files(docs, path, 2)
    whole = {r["doc_id"]: bytes(r["ids"]) for r in token_files.read_token_files(spark, where).collect()}
    assert np.frombuffer(whole[0], "<u4").tolist() == lib.encode(ROWS[0][1], add_special_tokens=False).ids + [2]


def test_token_files_stand_alone_in_id_order(spark, tokenizers, tmp_path, monkeypatch):
    """Another session reads the folder; file after file ids ascend; one id may hold most rows."""
    import glob
    import subprocess
    import sys

    import pyarrow.parquet as pq

    path, lib = queries.tokenizer_path("byte_bpe_50k.json"), tokenizers["byte_bpe_50k.json"]
    rnd = random.Random(5)
    rows = [(rnd.choice([rnd.randrange(-500, 500), 77, None]), f"text {i} {'x ' * rnd.randrange(9)}", "s") for i in range(700)]
    rows += [(i, t, "s") for i, t in enumerate(CANCELLING)]
    where = token_files.write_token_files(docs_of(spark, rows).repartition(5), path, 2, path=f"file://{tmp_path}/set")
    blocks = [r for f in sorted(glob.glob(f"{tmp_path}/set/blocks/part-*")) for r in pq.read_table(f).to_pylist()]
    ids = [i for r in blocks for i in r["doc_ids"]]
    assert ids == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    of_77 = collections.Counter(r["segment"] for r in blocks for i in r["doc_ids"] if i == 77)
    assert len(of_77) > 2 and max(of_77.values()) < 150
    script = f"""
import sys, zlib
sys.path[:0] = {sys.path!r}
from pyspark.sql import SparkSession
from millrace.llm import token_files
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for r in token_files.token_file_digests(spark, {where!r}).collect():
    print(r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, check=True).stdout
    got = sorted(tuple(None if x == "None" else int(x) for x in line.split()) for line in out.splitlines())
    assert [g[1] for g in got] == ids and [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    want = [lib.encode(t, add_special_tokens=False).ids + [2] for _, t, _ in rows]
    want = collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _, _), x in zip(rows, want))
    assert collections.Counter(g[1:] for g in got) == want


def test_codes_of_more_ids_than_two_to_the_sixteen():
    n = 70_000
    counts = np.random.default_rng(1).integers(1, 50, n)
    bits = token_files.longest_code(n)
    code = token_files.Code(token_files.code_lengths(counts, bits))
    assert 17 <= bits <= token_files.MOST_BITS and code.bits <= bits and sum(2.0 ** -code.lengths.astype(float)) <= 1
    docs = [np.random.default_rng(i).integers(0, n, 500).astype(np.uint32) for i in range(4)]
    payloads, checks = code.pack(docs)
    got = code.unpack(b"".join(payloads), np.full(4, 500), np.array([len(p) for p in payloads]), np.concatenate(checks))
    assert got.tolist() == np.concatenate(docs).tolist()
    assert token_files.longest_code(50_000) >= 16 and token_files.longest_code(10) == 16


def huffman_cost(counts, limit):
    """Least total bits with codes of at most ``limit`` bits, by trying all length profiles of a few symbols."""
    import itertools

    counts = sorted((c for c in counts if c), reverse=True)
    return min(sum(c * n for c, n in zip(counts, ls)) for ls in itertools.combinations_with_replacement(range(1, limit + 1), len(counts)) if sum(2.0**-n for n in ls) <= 1)


def test_code_lengths_are_best_under_the_limit():
    rnd = random.Random(8)
    for _ in range(60):
        counts = np.array([rnd.choice([0, 1, 2, 5, 40, 300]) for _ in range(7)])
        limit = rnd.choice([3, 4, 5])
        lengths = token_files.code_lengths(counts, limit)
        assert ((lengths > 0) == (counts > 0)).all() and lengths.max(initial=0) <= limit
        if (counts > 0).sum() > 1:
            assert int((counts * lengths).sum()) == huffman_cost(counts.tolist(), limit)
            code = token_files.Code(lengths)
            words = [format(int(code.codes[s]), f"0{lengths[s]}b") for s in np.flatnonzero(lengths)]
            assert not any(a != b and b.startswith(a) for a in words for b in words)
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(9, int), 3)


def brute_components(rows, width, num, den):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


@pytest.mark.parametrize("width,num,small", [(4, 85, False), (5, 80, True)])
def test_jaccard(spark, width, num, small, monkeypatch):
    if small:  # many blocks, and classes on both sides of the bound for large ones
        for name, value in (("BLOCK_MEMBERS", 16), ("BLOCK_SHINGLES", 300), ("HOT_TOKEN", 3)):
            monkeypatch.setattr(jaccard_join, name, value)
    rnd = random.Random(width)
    base = [[f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([2, 4, 7, 9, 15, 60, 200]))] for _ in range(25)]
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(500):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            w[rnd.randrange(len(w))] = f"X{rnd.randrange(50)}"
        rows.append((1000 - i, " ".join(w + (passage if rnd.random() < 0.2 else []))))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "One"), (2004, "oNE"), (2005, "word " * 4000)]
    rows += [(3000 + i, t) for i, t in enumerate(CANCELLING)]
    got = jaccard_join.jaccard_components(docs_of(spark, [(i, t, "s") for i, t in rows]), width=width, num=num)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_components(rows, width, num, 100)


def test_jaccard_edges(docs, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    got = by_id(jaccard_join.jaccard_components(docs))
    assert sum(map(len, got.values())) == len(ROWS) and len(got[5]) == 2 and got[None][0]["component_id"] is None
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1


def test_repeated_ids_with_other_texts(spark):
    w = " ".join(f"w{i}" for i in range(60))
    u, v = " ".join(f"u{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    rows = [(3, w), (5, w + " tail"), (5, u), (8, "solo text of its own"), (5, v), (9, v), (9, v), (9, v + " end"), (9, v + " end"), (None, w), (None, w), (7, None), (7, None), (7, "")]
    d = docs_of(spark, [(i, t, "s") for i, t in rows]).repartition(3)
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_components(d).collect())
    want = [(3, 56, 3), (5, 57, 3), (5, 46, 5), (8, 1, 8), (5, 46, 5), (9, 46, 5), (9, 46, 5), (9, 47, 5), (9, 47, 5), (None, 56, None), (None, 56, None), (7, 0, 7), (7, 0, 7), (7, 0, 7)]
    assert got == collections.Counter(want)
    kept = jaccard_join.keep_one_of_each(d)
    assert kept.columns == d.columns
    want = [(3, w), (5, u), (5, v), (8, "solo text of its own"), (None, w), (None, w), (7, None), (7, None), (7, "")]
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter(want)
    twice = docs_of(spark, [(4, w, "a"), (4, w, "b"), (6, w + " x", "a")]).withColumnRenamed("n", "__gone").withColumnRenamed("size", "__ID")
    kept = jaccard_join.keep_one_of_each(twice)
    assert kept.columns == twice.columns and [(r["doc_id"], r["text"]) for r in kept.collect()] == [(4, w)]
    none = jaccard_join.keep_one_of_each(d.where("false"))
    assert none.columns == d.columns and none.count() == 0


def test_lookup_of_hot_keys(spark):
    from millrace.sources import shared

    rows = spark.createDataFrame([(k, i) for k, n in ((1, 3000), (2, 2), (None, 4), (9, 1)) for i in range(n)] + [(k, 0) for k in range(100, 2000)], "k long, i long")
    table = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, 5, 150)], "tk long, v string")
    for how in ("inner", "left"):
        got = shared.lookup(rows, "k", table, "tk", how)
        want = rows.join(table, F.col("k") == F.col("tk"), how)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_components(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, j) for j in range(101, 140)] + [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(40)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for e in edges for x in e if e[0] != e[1]}


def test_ranks_are_gapless(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((None, 5), ("a", 300), ("b", 1)) for i in range(n)], "k string, i long")
    got = gapless_rank(df, F.col("k"), [F.col("i")], F.xxhash64("i"), 16, "r").groupBy("k").agg(F.sort_array(F.collect_list("r")).alias("r"))
    assert {r["k"]: r["r"] for r in got.collect()} == {None: list(range(5)), "a": list(range(300)), "b": [0]}


@pytest.mark.parametrize("block,queries", [(8192, 2048), (16, 3)])
def test_topk(spark, monkeypatch, block, queries):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", queries)
    rnd = np.random.default_rng(1)
    vecs = [(i, rnd.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(400)]
    vecs += [(i, vecs[7][1]) for i in range(400, 430)]  # ties
    vecs += [(i, [0.0] * 8) for i in range(430, 470)]
    bad = [(500, None), (600, [float("nan")] * 8), (700, [None] + [0.1] * 7), (800, [float("inf")] + [0.0] * 7), (900, [0.1] * 3), (920, []), (940, [0.2] * 3), (None, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vecs + bad], "vec_id long, embedding array<float>, block int, score int").repartition(3)
    got = topk.exact_top_k(df, F.col("vec_id") % 20 == 0, k=10).collect()
    x = np.floor(1024 * np.array([v for _, v in vecs], dtype=np.float32).astype(np.float64)).astype(int)
    want = [(900, 1, 940, 3 * 102 * 204), (940, 1, 900, 3 * 102 * 204)]
    for i in range(0, 470, 20):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -s)) if j != i][:10]
        want += [(i, r, int(j), int(s[j])) for r, j in enumerate(order, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    few = topk.exact_top_k(df.where("vec_id in (20, 40, 900)"), F.col("vec_id") % 20 == 0)
    assert {(r["query_id"], r["vec_id"]) for r in few.collect()} == {(20, 40), (40, 20)}
    assert topk.exact_top_k(df.where("false"), F.lit(True)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.5, 0.25]), (3, [0.25, 0.5])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(twice, F.col("vec_id") == 1, k=3)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2, 2**19), (1, 2, 3, 2**19), (1, 3, 2, 2**18)]


def test_pivots_rule_candidates_and_blocks_out(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    c = np.concatenate([rnd.integers(-50, 50, (500, 4)) + m for m in ([3000, 0, 0, 0], [-3000, 0, 0, 0])])
    pivots = c[[0, 700]].astype(float)
    seen = []
    real = topk._exact_dot
    monkeypatch.setattr(topk, "_exact_dot", lambda a, q: seen.append(len(a)) or real(a, q))
    topk._search(np.arange(1000), c, topk._table(c, pivots), np.array([5000]), c[:1], topk._table(c[:1], pivots), [-np.inf], 5)
    assert sum(seen) < 700
    # Queries of one of two far groups of vectors go to no block of the other.
    monkeypatch.setattr(topk, "BLOCK_ROWS", 50)
    df = spark.createDataFrame([(i, (v / 1024).tolist()) for i, v in enumerate(c)], "vec_id long, embedding array<double>")
    met = []
    monkeypatch.setattr(topk, "_met", lambda vectors, asked, k, real=topk._met: met.append(asked) or real(vectors, asked, k))
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=5).collect()
    assert len(got) == 100 and all((r["vec_id"] < 500) == (r["query_id"] < 500) for r in got)
    assert sum(a.count() for a in met) < 20 * 20 * 0.6


def test_sharding(docs, empty, spark):
    got = sharding.shard_documents(docs, shards=4).collect()
    size = lambda t: len((t or "").encode()) + 1
    text = {i: t for i, t, _ in ROWS}
    assert len(got) == len(ROWS) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert all((r["size"], r["text_crc32"]) == (size(text[r["doc_id"]]), zlib.crc32((text[r["doc_id"]] or "").encode())) for r in got)
    groups, home = collections.Counter(), collections.defaultdict(set)
    for r in got:
        groups[text[r["doc_id"]]] += r["size"]
        home[text[r["doc_id"]]].add(r["shard"])
    assert all(len(h) == 1 for h in home.values())
    heap = [0] * 4
    for s in sorted(groups.values(), reverse=True):
        heapq.heapreplace(heap, heap[0] + s)
    loads = {r["shard"]: r["bytes"] for r in sharding.shard_loads(sharding.shard_documents(docs, shards=4)).collect()}
    assert sorted(loads.values()) == sorted(heap)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty).count() == 0


def test_schedule_equals_heap():
    rnd = random.Random(5)
    for _ in range(400):
        shards = rnd.randint(1, 6)
        sizes = {rnd.randint(1, 200): rnd.randint(1, 60) for _ in range(rnd.randint(1, 8))}
        heap, loads = [0] * shards, [0] * shards
        for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
            heapq.heapreplace(heap, heap[0] + s)
        for size, used, n in sharding.schedule(sorted(sizes.items(), reverse=True), shards):
            assert sum(n) == sizes[size]
            for u, k in zip(used, n):
                loads[u] += size * k
        assert sorted(loads) == sorted(heap)


def ideal_ends(blocks, weights):
    """(start, rate, live) of the stretches between which sources end in the ideal mixture, in blocks by weight and in slots."""
    v, at, out = Fraction(0), Fraction(0), []
    live = {s for s, n in blocks.items() if n}
    while live:
        rate = sum(Fraction(weights[s]) for s in live)
        end = min(Fraction(blocks[s]) / weights[s] for s in live)
        out.append((v, end, at, rate))
        at += (end - v) * rate
        v, live = end, {s for s in live if Fraction(blocks[s]) / weights[s] > end}
    return out


def brute_schedule(blocks, weights):
    """Earliest deadline first over all blocks, slot by slot, each release and deadline from the ideal mixture itself."""
    ends = ideal_ends(blocks, weights)

    def slot_of(v):
        lo, _, at, rate = next(e for e in ends if v <= e[1])
        return at + (v - lo) * rate

    todo = []
    for s in sorted(blocks, key=lambda s: (s is None, s or "")):
        for k in range(blocks[s]):
            begin, end = Fraction(k) / weights[s], Fraction(k + 1) / weights[s]
            lo, _, at, rate = next(e for e in ends if e[0] <= begin < e[1])
            due = slot_of(end)
            todo.append((int(at + (begin - lo) * rate), -(-due.numerator // due.denominator), s, k))
    place = {s: i for i, s in enumerate(sorted(blocks, key=lambda s: (s is None, s or "")))}
    out = []
    for t in range(len(todo)):
        ready = [x for x in todo if x[0] <= t]
        best = min(ready, key=lambda x: (x[1], place[x[2]], x[3]))
        assert best[1] > t
        todo.remove(best)
        out.append((best[2], best[3]))
    return out


def test_mixing(spark, docs, empty):
    for weights in ({"s0": 3, "s1": 1, "s2": 2, "s3": 4, None: 1}, {"s0": 9995, "s1": 5, "s2": Fraction(1, 3), "s3": 7, None: 2}, None):
        got = mixing.mix_sources(docs, weights, block_rows=2).collect()
        assert len(got) == len(ROWS) and len({r["position"] for r in got}) == len(got)
        n = collections.Counter(r["source"] for r in got)
        told = weights or {s: mixing.root_weight(c) for s, c in n.items()}
        want = {x: t for t, x in enumerate(brute_schedule({s: -(-c // 2) for s, c in n.items()}, told))}
        assert {(r["source"], r["block"]): r["slot"] for r in got} == want
        places = collections.defaultdict(set)
        for r in got:
            assert r["position"] // 2 == r["slot"]
            places[r["source"], r["block"]].add(r["position"] % 2)
        assert all(p == set(range(len(p))) for p in places.values())
    assert mixing.mix_sources(empty).count() == 0


def test_mixture_order_of_whole_rows(spark, docs, empty):
    ordered = mixing.in_mixture_order(docs, block_rows=2)
    assert ordered.columns == docs.columns
    key = lambda rows: collections.Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    assert key(ordered.collect()) == key(docs.collect())
    odd = spark.createDataFrame([(None, "a", "x", 1), (None, "b", "x", 2), (None, None, None, 3), (1, "a", None, 4), (1, "c", "x", 5), (1, "c", "x", 5)], "doc_id long, text string, source string, __key int")
    rows = mixing.in_mixture_order(odd, block_rows=1).collect()
    assert sorted(r["__key"] for r in rows) == [1, 2, 3, 4, 5, 5]
    none = mixing.in_mixture_order(empty)
    assert none.columns == docs.columns and none.count() == 0
    even = docs_of(spark, [(i, f"t{i}", "ab"[i % 2]) for i in range(400)])
    told = [r["source"] for r in mixing.in_mixture_order(even, {"a": 1, "b": 1}, block_rows=1).collect()]
    assert all(abs(told[:t].count("a") - t / 2) < 1 for t in range(401))


def test_schedule_equals_earliest_deadline_first():
    rnd = random.Random(12)
    for _ in range(60):
        blocks = {f"s{i}": rnd.randint(1, 25) for i in range(rnd.randint(1, 6))}
        weights = {s: Fraction(rnd.randint(1, 40), rnd.randint(1, 9)) for s in blocks}
        assert [x[:2] for x in mixing.schedule(blocks, weights)] == brute_schedule(blocks, weights)


def test_schedule_keeps_to_exact_weights():
    rnd = random.Random(8)
    cases = [({s: 4000 for s in "abc"}, {s: 1 for s in "abc"}), ({"a": 200_000, "b": 3}, {"a": 1, "b": Fraction(1, 100_000)})]
    cases += [({f"s{i}": rnd.randint(1, 900) for i in range(m)}, None) for m in (1, 2, 7, 40)]
    cases += [({i: rnd.randint(0, 300) for i in "abcdef"}, {i: Fraction(rnd.randint(1, 50), rnd.randint(1, 50)) for i in "abcdef"}) for _ in range(20)]
    cases += [({str(i): 1 + i % 3 for i in range(1500)}, None)]  # more sources than the units there once were
    for blocks, weights in cases:
        weights = weights or {s: mixing.root_weight(n) for s, n in blocks.items()}
        done, served = collections.Counter(), {s: Fraction(0) for s in blocks}
        step = 1 if len(blocks) < 100 else 97
        v, at = Fraction(0), 0
        for t, (s, k, _) in enumerate(mixing.schedule(blocks, weights), 1):
            assert k == done[s]
            done[s] += 1
            if t % step or (t > 2000 and t % 997):
                continue
            while at < t:  # the ideal mixture up to t, from one end of a source to the next
                live = [x for x in blocks if v * weights[x] < blocks[x]]
                rate = sum(weights[x] for x in live)
                to = min(min(blocks[x] / Fraction(weights[x]) for x in live), v + (t - at) / Fraction(rate))
                at, v = at + (to - v) * rate, to
            assert all(abs(done[x] - min(v * weights[x], blocks[x])) < 1 for x in blocks)
        assert done == collections.Counter({s: n for s, n in blocks.items() if n})
    assert [s for s, _, _ in mixing.schedule({"a": 2, "b": 1}, {"a": 0, "b": 5})] == ["b", "a", "a"]


def test_mixing_of_equal_sources_deviates_by_less_than_a_block(spark):
    d = docs_of(spark, [(i, "x", "abc"[i % 3]) for i in range(7500)])
    done = collections.Counter()
    for t, r in enumerate(mixing.mix_sources(d, block_rows=1).orderBy("slot").collect(), 1):
        done[r["source"]] += 1
        assert r["slot"] == t - 1 and all(abs(3 * done[s] - t) < 3 for s in "abc")


def test_mixing_takes_any_number_of_sources(spark, empty):
    d = docs_of(spark, [(i, "x", f"h{i % 1100}" if i % 7 else None) for i in range(4000)])
    got = mixing.mix_sources(d, block_rows=2).collect()
    assert len(got) == 4000 and len({r["position"] for r in got}) == 4000
    slot = {(r["source"], r["block"]): (r["slot"], r["phase"]) for r in got}
    n = collections.Counter(r["source"] for r in got)
    told = mixing.schedule({s: -(-c // 2) for s, c in n.items()}, {s: mixing.root_weight(c) for s, c in n.items()})
    assert slot == {(s, k): (t, phase) for t, (s, k, phase) in enumerate(told)}
    assert mixing.mix_sources(empty).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(d) <= 19 and pii.luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("a1.@-+ ()25%_é:", k=rnd.randint(0, 60))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "x@a@b.c.d@e.f", "1.2.3.4.5.6.7.8", "+1 (555) 555-2485", "256.1.1.1", None, "0001.2.3.4"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t), repr(t)
    zeros = "0" * 5000
    assert pii.base_spans(f"a {zeros}9.1.2.255 b") == [("ip", 2, 5011)] and pii.base_spans(f"{zeros}256.1.2.3") == []


def test_gradient_of_the_tagger():
    rnd = np.random.default_rng(0)
    tagger = pii.Tagger.new()
    x, y, m = pii.training_arrays(pii.written_variants(6))
    _, g = tagger.loss_and_gradient(x, y, m)
    for k in g:
        i = (2, 1) if k == "embed" else tuple(int(rnd.integers(0, s)) for s in g[k].shape)
        keep = tagger.p[k][i]
        loss = []
        for step in (1e-5, -1e-5):
            tagger.p[k][i] = keep + step
            loss.append(tagger.loss_and_gradient(x, y, m)[0])
        tagger.p[k][i] = keep
        assert abs((loss[0] - loss[1]) / 2e-5 - g[k][i]) < 1e-5


@pytest.fixture(scope="module")
def corpus_tagger(spark):
    """A tagger fitted on one half of a table of documents, and the texts of the other half."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r["text"] for r in docs.where("doc_id % 2 = 1 and text is not null").orderBy("doc_id").collect()]
    return pii.fit_tagger(docs.where("doc_id % 2 = 0")), held


def test_what_the_tagger_adds_in_held_out_documents(corpus_tagger):
    """Precision and recall, by kind, of spans that the base patterns miss, set into documents the tagger never saw."""
    tagger, held = corpus_tagger
    r = np.random.default_rng(5)
    texts, planted = [], []
    for t in held:
        for _ in range(3):
            at = t.find(" ", int(r.integers(0, len(t) + 1)))
            if at < 0:
                continue
            kind = pii.KINDS[r.integers(4)]
            item = pii._item(r, kind)
            texts.append(t[: at + 1] + item + t[at:])
            planted.append((kind, at + 1, at + 1 + len(item)))
    hits, wanted, added = (collections.Counter() for _ in range(3))
    for (base, found), span in zip(pii.all_spans(texts, tagger), planted):
        new = [s for s in found if s not in base]
        added.update(k for k, _, _ in new)
        if all(e <= span[1] or span[2] <= s for _, s, e in base):
            wanted[span[0]] += 1
            hits[span[0]] += span in new
    assert min(wanted.values()) > 40 and len(wanted) == 4
    for k in pii.KINDS:
        assert hits[k] >= 0.9 * wanted[k] and hits[k] >= 0.95 * added[k], (k, hits[k], wanted[k], added[k])


def test_spans_depend_on_the_text_alone(corpus_tagger):
    tagger, held = corpus_tagger
    texts = [None, "", "no data at all", *(t for t, _ in pii.written_variants(300, seed=99)), *held[:40]]
    together = tagger.spans(texts)
    assert together[:3] == [[], [], []] and sum(map(len, together)) > 100
    assert [tagger.spans([t])[0] for t in texts] == together
    assert tagger.spans(texts[::-1]) == together[::-1]


def test_spans_in_long_stretches(corpus_tagger):
    """An item is found at any place of a text without a pause between items, however long."""
    tagger, _ = corpus_tagger
    for shift in range(21):
        text = "x" * shift + " call (555) 555-1234 or write to ann (at) example.org, ring" * 400
        found = tagger.spans([text])[0]
        assert [text[a:b] for k, a, b in found if k == "phone"] == ["(555) 555-1234"] * 400
        assert [text[a:b] for k, a, b in found if k == "email"] == ["ann (at) example.org"] * 400


def test_reconciled_spans_have_the_largest_total():
    import itertools

    rnd = random.Random(3)
    for _ in range(200):
        found = {}
        for _ in range(rnd.randint(0, 7)):
            a = rnd.randrange(60)
            found["card", a, a + rnd.randint(1, 20)] = rnd.choice([0.8, 0.9, 1.0])
        got = pii._reconciled(found, [(0, 96)], 96)
        free = lambda c: all(x[2] <= y[1] for x, y in zip(c, c[1:]))
        weight = lambda c: sum(found[s] * (s[2] - s[1]) for s in c)
        every = (c for n in range(len(found) + 1) for c in itertools.combinations(sorted(found, key=lambda s: s[1:]), n))
        assert free(got) and weight(got) == pytest.approx(max(weight(c) for c in every if free(c)))


def test_pii(docs, empty, spark):
    tagger = pii.fit_tagger(docs)
    got = by_id(pii.digests(pii.find_pii(docs, tagger)))
    for i, t, _ in ROWS:
        base = brute_spans(t)
        for r in got[i]:
            n = collections.Counter(k for k, _, _ in base)
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert tuple(r[f"n_{k}"] for k in PATTERNS) == tuple(n[k] for k in PATTERNS)
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert not base or set(joined.split(",")) <= set(r["spans"].split(","))
    assert pii.find_pii(empty, tagger).count() == 0 and pii.mask_pii(empty, tagger).count() == 0
    assert pii.fit_tagger(empty).spans(["call (555) 555-1234 now"]) == [[("phone", 5, 19)]]
    clean = pii.mask_pii(docs.withColumn("n_chars", F.length("text").cast("long")), tagger).collect()
    assert len(clean) == len(ROWS) and all(r["text"] is None or (not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])) for r in clean)
    assert pii.masked("a b@c.de f", [("email", 2, 8)]) == "a [email] f"
    run_on = "call +1 (555) 555-1234 ... 10.0.0.1 or +1 (555) 555-4321 10.0.0.2"
    assert [k for k, _, _ in pii.base_spans(run_on)] == ["ip", "ip"]
    assert pii.mask_all([run_on, None], tagger) == ["call [phone] ... [ip] or [phone] [ip]", None]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rnd = random.Random(1)
    terms = ["idiot", "moron", "scum", "pathetic", "disgusting", "aabbaabbc", "abcab"]
    trie = toxicity.LexiconTrie(terms)
    words = ["".join(rnd.choices("abcdiotmrn", k=rnd.randint(1, 11))) for _ in range(1500)]
    for t in terms:
        for _ in range(150):
            w = list(t)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(["", "a", "z", "io"])
            words.append("".join(w) or "a")
    for w in words:
        near = min(((edits(w, t), t) for t in terms if edits(w, t) <= toxicity.allowed_edits(t)), default=None)
        assert trie.near(w) == (near and (near[1], near[0])), w
        assert (trie.kind(w) is not None) == (near is not None), w


def test_quotes_are_not_abuse():
    s = toxicity.ToxicityModel(terms=["idiot", "moron"]).scorer()
    assert s.score("you idiot, you m0ron") > 0.5 > s.score('she wrote "idiot" on it')
    assert s.score("the id1ot is here") > s.score("the iodine is here") == s.score(None) == s.score("")


def test_quotations_of_any_length():
    s = toxicity.ToxicityModel(terms=["idiot", "moron"]).scorer()
    x = "plain text " * 40
    for a, b in ('""', "“”", "„“", "«»"):
        assert s.score(f"{x}{a}{x}idiot and moron {x.strip()}{b} end") < 0.5
        assert s.score(f"see {a}one idiot\nor moron\nhere{b} end") < 0.5
        assert s.score(f"see {a}{x.strip()}{b} you idiot you moron {a}{x.strip()}{b} end") > 0.5
        assert s.score(f"a stray {a}mark\n\nyou idiot you moron\n\nand {a}more{b}") > 0.5
        assert s.score(f"see {a}{x}\n\n{a}idiot moron{b} end") < 0.5
        assert s.score(f"see {a}idiot {x}\n\n{a}moron{b} end") < 0.5
    assert s.score('a 5" pipe, you idiot, you moron, a 6" pipe') > 0.5 > s.score('a 5" pipe, "idiot" and "moron"')
    assert s.score(f"idiot and moron, she said {x}") < 0.5 < s.score(f"idiot and moron {x} she said")
    assert toxicity.quoted_spans('"a "b" c"') == [(3, 5)] and toxicity.quoted_spans("") == []


def test_toxicity(spark, empty):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        bad = i % 4 == 0
        w = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(40)]
        if bad:
            w[rnd.randrange(40)] = rnd.choice(["grobian", "zwackel", "rüpelhaft"])
        rows.append((i, " ".join(w), int(bad)))
    d = docs_of(spark, [(i, t, "s") for i, t, _ in rows] + [(1000, None, "s"), (None, "", "s")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.fit_toxicity(d, labels, ~held)
    got = by_id(toxicity.score_toxicity(d, model))
    hold = [(got[i][0]["predicted"], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(p == y for p, y in hold) >= 0.95 * len(hold) and len(hold) > 80
    assert got[1000][0]["predicted"] == 0 and got[None][0]["predicted"] == 0
    assert toxicity.keep_clean(d, model).count() == sum(r["predicted"] == 0 for x in got.values() for r in x)
    bare = toxicity.fit_toxicity(d, labels.where("false"), F.lit(True))
    assert toxicity.score_toxicity(d, bare).agg(F.max("predicted")).first()[0] == 0
    assert toxicity.score_toxicity(empty, model).count() == 0


def test_misspellings_inside_a_stem_are_hits(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(600):
        w = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(40)]
        if i % 4 == 0:
            w[rnd.randrange(40)] = ["grobian", "grobians", "grobiann"][i // 4 % 3]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs_of(spark, [(i, t, "s") for i, t, _ in rows]), labels, F.lit(True))
    trie = model.scorer().trie
    assert "grob" in model.stems and trie.kind("grobianus") == "stem"
    assert [trie.kind(w) for w in ("gr0bian", "gobian", "grabian")] == ["misspelled"] * 3


def test_terms_of_any_number_and_length(spark):
    rnd = random.Random(7)
    terms = ["".join(rnd.choices("klmnopqrst", k=8)) for _ in range(1200)] + ["zz", "q" * 60]
    rows = [(i, " ".join(rnd.sample(terms, len(terms)) if i % 2 else ["plain"]), i % 2) for i in range(160)]
    # A spelling near a term that other texts use is harmless, the last of the alphabet too.
    rows += [(1000 + i, "zzzzzzzzy", 0) for i in range(40)] + [(2000 + i, "zzzzzzzzz", 1) for i in range(100)]
    rows = [(i, " ".join([*("".join(rnd.choices("abcdefgh", k=7)) for _ in range(4)), t]), y) for i, t, y in rows]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs_of(spark, [(i, t, "s") for i, t, _ in rows]), labels, F.lit(True))
    assert model.harmless[-1] == "zzzzzzzzy"
    known = set(model.terms)
    assert {"zz", "q" * 60} <= known and len(known & set(terms)) > 1100
    assert toxicity.keep_clean(docs_of(spark, [(1, "zz " + terms[5], "s"), (2, "plain", "s"), (None, None, None)]).where("false"), model).count() == 0


def test_terms_and_weights_against_plain_counting(spark):
    rnd = random.Random(21)
    rows = []
    for i in range(500):
        w = ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(30)]
        w += rnd.choices(["grimmig", "zwackel", "rüpel", "maybe", "often"], [2, 2, 1, 2, 1] if i % 3 == 0 else [0, 0, 0, 2, 1], k=2)
        rows.append((i, " ".join(rnd.sample(w, len(w))), int(i % 3 == 0)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs_of(spark, [(i, t, "s") for i, t, _ in rows]), labels, F.lit(True))
    in_toxic, in_other = collections.Counter(), collections.Counter()
    for _, t, y in rows:
        (in_toxic if y else in_other).update(set(t.split()))
    share = sum(y for _, _, y in rows) / len(rows)
    least = max(toxicity.MIN_TEXTS, int(np.ceil(np.log(toxicity.MAX_CHANCE) / np.log(share))))
    assert set(model.terms) == {w for w, n in in_toxic.items() if n >= least and n >= toxicity.MIN_SHARE * (n + in_other[w])} >= {"grimmig", "zwackel"}
    # The weights are where the penalized likelihood is largest.
    x = np.array([model.scorer().features(t) for _, t, _ in rows])
    y = np.array([y for _, _, y in rows])

    def goal(beta):
        z = beta[0] + x @ beta[1:]
        return float((y * z - np.logaddexp(0, z)).sum() - (((beta - toxicity._PRIOR) / toxicity._PRIOR_SD) ** 2).sum() / 2)

    best = np.array(toxicity.fit_weights(x, y, y.mean()))
    for _ in range(200):
        assert goal(best) >= goal(best + np.random.default_rng(rnd.randrange(10**6)).normal(0, 0.01, len(best))) - 1e-9


def brute_url(u):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_urls(spark):
    rnd = random.Random(2)
    urls = [None, "", "no scheme", "http://", "HTTP://Ä.EXAMPLE.ORG/es/1", "http://org", "http://x.org?a=1", "http://a.com/fr/?x=http://b.org/", "http://example.org/en/12#x", "ftp://q.com/de/\nz", "://org/"]
    for _ in range(300):
        kind = rnd.choice(["a.com/de/", "b.com/fr/", "c.example.org/es/", "d.org/", "e.net/en/", "f.com/es/"])
        urls.append(f"http://{kind}{rnd.randrange(10**6)}?{'k=1&' * rnd.randrange(4)}")
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(urls)], "page_id long, url string, n int, host string")
    model = url_filter.fit_url_model(url_filter.labelled_by_rules(pages))
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, model).collect()}
    bins = pages.select("page_id", *[c.alias(f) for f, c in url_filter.features(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), model.suffix_bin(url_filter.host_of(F.col("url")))).items()])
    bins = {r["page_id"]: r.asDict() for r in bins.collect()}
    assert model.trees
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_url(u)
        r = got[i]
        p = url_filter.probability(url_filter.predict_in_python(model, bins[i]))
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), u
        assert r["verdict"] == (verdict or ("block" if p > 0.5 else "allow")) and abs(r["score"] - p) < 1e-5
    empty = pages.where("false")
    assert url_filter.filter_urls(empty, url_filter.fit_url_model(url_filter.labelled_by_rules(empty))).count() == 0
    plan = url_filter.filter_urls(pages, model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_boost(rows, bias):
    """Boosted trees of (bins, y) in plain Python, row by row: for each tree a function from bins to its value."""
    trees = []

    def margin(bins):
        return bias + sum(t(bins) for t in trees)

    def sums(part):
        return tuple(sum(x[i] for x in part) for i in (1, 2))

    def gain(g, h):
        return (g / 1e6) ** 2 / (h / 1e6 + url_filter.L2)

    def grow(part, depth):
        g, h = sums(part)
        best = None
        if depth < url_filter.DEPTH:
            for f in url_filter.FEATURES:
                for b in sorted({x[0][f] for x in part}):
                    left = [x for x in part if x[0][f] <= b]
                    if min(len(left), len(part) - len(left)) < url_filter.MIN_ROWS:
                        continue
                    lg, lh = sums(left)
                    won = gain(lg, lh) + gain(g - lg, h - lh) - gain(g, h)
                    if won > 1e-6 and (best is None or won > best[0]):
                        best = (won, f, b)
        if best is None:
            value = url_filter.RATE * (g / 1e6) / (h / 1e6 + url_filter.L2)
            return lambda bins: value
        _, f, b = best
        low, high = (grow([x for x in part if (x[0][f] <= b) == side], depth + 1) for side in (True, False))
        return lambda bins: low(bins) if bins[f] <= b else high(bins)

    for _ in range(url_filter.TREES):
        graded = []
        for bins, y in rows:
            p = url_filter.probability(margin(bins))
            graded.append((bins, round((y - p) * 1_000_000), round(p * (1 - p) * 1_000_000)))
        trees.append(grow(graded, 0))
    return margin


def test_trees_equal_boosting_row_by_row(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(500):
        u = f"http://{rnd.choice(['a', 'bb', 'c-c'])}.{rnd.choice(['com', 'org', 'net'])}/{'x/' * rnd.randrange(4)}{rnd.randrange(10 ** rnd.randrange(1, 7))}?{'k=1&' * rnd.randrange(3)}"
        rows.append((i, u, int(("c-c" in u) ^ (u.count("/") > 4) ^ (rnd.random() < 0.1))))
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    model = url_filter.fit_url_model(pages)
    host = url_filter.host_of(F.col("url"))
    found = url_filter.features(F.col("url"), host, url_filter.path_of(F.col("url")), model.suffix_bin(host))
    bins = {r["page_id"]: r.asDict() for r in pages.select("page_id", *[c.alias(f) for f, c in found.items()]).collect()}
    margin = brute_boost([(bins[i], y) for i, _, y in rows], model.bias)
    assert len(model.trees) == url_filter.TREES
    for i, _, _ in rows:
        assert abs(url_filter.predict_in_python(model, bins[i]) - margin(bins[i])) < 1e-9


def test_every_suffix_has_its_statistics(spark, monkeypatch):
    # 400 suffixes of equal size and alike in all else; the label is the suffix's.
    label = {i: random.Random(i).randrange(2) for i in range(100, 500)}
    rows = [(i * 25 + j, f"http://h.q{i}z.com/a", label[i]) for i in label for j in range(25)]
    pages = spark.createDataFrame(rows, "page_id long, url string, label int")
    got = []
    for most in (url_filter.BROADCAST_BYTES if hasattr(url_filter, "BROADCAST_BYTES") else 0, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", most, raising=False)
        model = url_filter.fit_url_model(pages)
        out = url_filter.filter_urls(pages, model, rules=())
        got.append({r["page_id"]: (r["verdict"], r["score"]) for r in out.collect()})
        assert len(got[-1]) == out.count() == len(rows)
        assert all(got[-1][i][0] == ("block" if y else "allow") for i, _, y in rows)
        odd = spark.createDataFrame([(1, None), (2, "http://never.seen"), (None, "http://h.q100z.com/a")], "page_id long, url string")
        assert url_filter.filter_urls(odd, model).count() == 3
    assert got[0] == got[1]


def test_media(docs, empty):
    got = by_id(media.media_table(docs))
    for i, t, _ in ROWS:
        n, payload = media.padded(t)
        for r in got[i]:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            image = media.to_png(payload)
            assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(image), hashlib.sha256(image).hexdigest(), media.feature_of(payload))
            assert (r["width"], r["height"]) == (64, len(payload) // 64)
    assert len(got[5]) == 2 and media.media_table(empty).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_media_shards(docs, spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(media, "BROADCAST_DIGESTS", 0)
    copies = docs.unionByName(docs_of(spark, [(5000 + i, ROWS[i % 3][1], "s") for i in range(200)]).repartition(3))
    rows, where = media.store_media(copies)
    assert rows.count() == copies.count() and where.count() == where.select("digest").distinct().count() == rows.select("digest").distinct().count()
    # The shards hold each payload once, and nothing else.
    names = collections.Counter()
    for r in where.select("shard").distinct().collect():
        store, path = media._store(r["shard"])
        import io
        import tarfile

        with store.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
            names.update(tar.getnames())
    assert names == collections.Counter(f"{r['digest']}.png" for r in where.collect())
    one = where.first()
    image = media.read_member(one["shard"], f"{one['digest']}.png")
    assert len(image) == one["length"] and hashlib.sha256(media.from_png(image)).hexdigest() == one["digest"]
    heads = media.media_metadata(where)
    assert heads.count() == where.count() and heads.where("width <> 64 or bits <> 8").isEmpty()
    with pytest.raises(ValueError):
        media.png_header(image[:19] + b"\1" + image[20:40])
    whole = media.media_table(copies)
    assert whole.where("digest <> payload_sha256").isEmpty() and whole.groupBy("digest").agg(F.countDistinct("shard", "offset", "length").alias("n")).where("n > 1").isEmpty()


def test_metadata_reads_headers_alone(docs, monkeypatch):
    _, where = media.store_media(docs)
    read = []

    class File:
        def read_at(self, n, at):
            read.append((n, at))
            return media.to_png(b"\0" * 64)[:n]

    monkeypatch.setattr(media, "_over_shards", lambda w, made, schema: made(File(), 512, 10_000))
    assert media.media_metadata(where) == (64, 1, 8) and read == [(media.HEADER_BYTES, 512)]


def test_sql_of_top_k(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.execute(queries.ORACLE_SQL["op3_exact_top_k"]).fetchall()
    got = queries.op3_exact_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline(spark, tokenizers):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert docs.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
        if name == "near_duplicates":
            parts = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80, 100)
            assert {r["doc_id"] for r in docs.collect()} == {c for _, c in parts.values()}
        if name in ("personal_data", "mixing"):
            assert docs.count() == before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    lib, text = tokenizers["word_bpe_49k.json"], {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == len(lib.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids) for r in last.collect())
    whole = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in whole} == set(text)


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_on_odd_tables(spark, tmp_path, some):
    """Nulls in any column, empty and long texts, repeated rows and ids, other columns whose names stages use; or no rows at all."""
    import corpus_pipeline

    rows = [r for r in ROWS if len(r[1] or "") < 10_000] + [(7, "another text under a known id, told of here", "s1"), (8, "long " * 5000, None)]
    odd = docs_of(spark, rows).withColumns({"n_chars": F.length("text").cast("long"), "__gone": F.lit(1), "__key": F.lit("k"), "__position": F.lit(2), "label": F.lit(9)})
    odd = odd if some else odd.where("false")
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(0, 1, 1), (1, None, None), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    (labels if some else labels.where("false")).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    ids = lambda df: collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())
    if not some:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = ids(docs), stage(spark, docs, str(tmp_path)).cache()
        after = ids(docs)
        assert docs.columns == columns and not after - before, name
        if name in ("personal_data", "mixing"):
            assert after == before
        if name == "near_duplicates":
            assert after[7] == 2 and after[5] == 1 and after[None] == 1
    assert ids(corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))) == ids(docs)


def test_only_what_the_result_reads_is_left(spark, tmp_path, monkeypatch):
    import pathlib

    from millrace.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    small = docs_of(spark, ROWS[:40])
    left = lambda: sorted(x.name.rsplit("-", 1)[0] for x in pathlib.Path(tmp_path).iterdir())
    got = jaccard_join.jaccard_components(small)
    assert left() == ["jaccard-labels", "jaccard-profiles"] and got.count() == 40
    sharding.shard_documents(small)
    assert left()[2:] == ["shard-rows"]
    toxicity.fit_toxicity(small, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, toxic int"), F.lit(True))
    pii.fit_tagger(small)
    assert len(left()) == 3


def test_clusters_must_name_a_shared_folder(spark):
    from millrace.sources import shared

    class Context:
        master, applicationId = "spark://host:7077", "a"

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(ValueError):
        shared.shared_dir(Session)
