"""Each operator against brute force, a round trip or held-out accuracy, with nulls, empty and long texts, ties and repeats."""

import collections
import gzip
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_model, license_scan, ngram_join, packing, quality, shared, token_counts, topk, toxicity, warc
from tessera.llm.components import components
from tessera.llm.ngram_join import similar_components
from tessera.llm.shared import Words, written

DATA = "/root/testdata/sf0.001"
VOCABULARIES = "/opt/tokenizers"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
needs_vocabulary = pytest.mark.skipif(not os.path.isdir(VOCABULARIES), reason="the vocabulary files are not here")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, tokens string, bin int, n int"


def docs(spark, texts, sources=None, first=0):
    rows = [(first + k, t, "en", (sources or ["s"] * len(texts))[k], len(t or ""), 0.5, "k", "t", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(rb"[^\x20\x09-\x0D]+", low)


def prose(rng, n, stock=200):
    return " ".join(f"w{rng.randrange(stock)}" for _ in range(n))


EDGE = [None, "", " \n\t", "one", "One  TWO", "é É ß x", "x" * 5000]


def test_words():
    texts = EDGE + ["a b\x0bc", "A B", "tail "]
    w = Words(pa.array(texts))
    got = [[w.word(k) for k in range(w.offsets[i], w.offsets[i + 1])] for i in range(len(texts))]
    assert got == [words_of(t) for t in texts]
    assert len(Words(pa.array([], pa.string())).hashes) == 0
    # A text over the block size gives the same hashes as its words alone.
    long = " ".join(f"v{k}" for k in range(500_000))
    assert (Words(pa.array([long])).hashes[-3:] == Words(pa.array(["v499997 v499998 v499999"])).hashes).all()


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 230)]
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    for hubs in (1, 8, 1000):  # no hubs, the star's centre alone, every vertex
        got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), hubs=hubs).collect()}
        assert all(got.get(v, v) == find(v) for v in parent)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def jaccard_brute(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("settings", [{}, {"longest": 2, "work": 3}, {"longest": 3, "rounds": 1, "work": 2}, {"longest": 2, "rounds": 0}])
def test_ngram_join(spark, settings):
    rng = random.Random(4)
    texts = [prose(rng, 40, 5000) for _ in range(15)]
    texts += [texts[0], texts[0].upper(), texts[1], *EDGE, "one two", "ONE two", "", None]
    base = prose(rng, 60, 5000).split()
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(60)] = f"e{rng.randrange(6)}"
        texts.append(" ".join(w))
    frame = docs(spark, texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(frame, **settings).collect()}
    assert got == jaccard_brute(enumerate(texts))
    if not settings:
        twice = similar_components(frame.union(frame)).collect()
        assert len(twice) == 2 * len(texts) and {r.doc_id: (r.n_shingles, r.component_id) for r in twice} == got
        assert similar_components(frame.limit(0)).count() == 0


def test_outlines_keep_every_link():
    rng = np.random.default_rng(5)
    a, b = [], []
    for k in range(600):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 2**63, 3 * n, dtype=np.uint64)
        skip = int(rng.integers(0, 2 * n)) if k % 2 else int(n * rng.uniform(0, 0.12))
        a.append(np.unique(base[:n]))
        b.append(np.unique(base[skip : skip + max(1, int(n * rng.uniform(0.85, 1.15)))]))
    made = lambda sets: ngram_join.outlines(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    na, nb = (np.array([len(x) for x in side]) for side in (a, b))
    linked = ngram_join._linked(np.array([len(np.intersect1d(x, y)) for x, y in zip(a, b)]), na, nb)
    may = ngram_join.may_link(made(a), made(b), na, nb)
    assert linked.any() and not (linked & ~may).any() and (~may).sum() > 0.6 * (~linked).sum()


def watch_written(monkeypatch, tags):
    """Rows of the tables that the join writes, by tag."""
    rows, real = collections.defaultdict(list), ngram_join.written

    def written(df, tag, path=None):
        out = real(df, tag, path)
        if tag in tags:
            rows[tag].append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    return rows


def test_ngram_join_chance_pairs_read_no_whole_sets(spark, monkeypatch):
    # Unrelated texts that share short runs of words meet in the prefix index; only the one link reads whole sets.
    rng = random.Random(8)
    runs = [prose(rng, 6, 10**6) for _ in range(60)]
    texts = [" ".join(x for k in range(4) for x in (prose(rng, 20, 10**6), runs[rng.randrange(60)])) for _ in range(120)]
    texts.append(texts[0] + " tail")
    rows = watch_written(monkeypatch, ("pairs", "whole"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs(spark, texts)).collect()}
    assert got == jaccard_brute(enumerate(texts))
    assert rows["pairs"][0] > 20 and rows["whole"][0] <= 8


@pytest.mark.parametrize("settings", [{"few": 0, "rounds": 2, "work": 3}, {"few": 6, "work": 3}])
def test_ngram_join_rounds_read_their_members(spark, settings, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 50, 9000) for _ in range(25)]
    texts += [t + " more" for t in texts]
    base = prose(rng, 60, 5000).split()
    other = base[:30] + prose(rng, 30, 5000).split()
    for source in (base, other) * 25:
        w = list(source)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(60)] = f"e{rng.randrange(6)}"
        texts.append(" ".join(w))
    rows = watch_written(monkeypatch, ("of-lists", "whole"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_components(docs(spark, texts), longest=3, **settings).collect()}
    assert got == jaccard_brute(enumerate(texts))
    assert rows["of-lists"] and rows["of-lists"][0] < rows["whole"][0] and rows["of-lists"] == sorted(rows["of-lists"], reverse=True)


def best_fit_brute(sizes, sources, clusters, capacity):
    bins, out = [], [-1] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda j: -sizes[j]):
        if not sizes[k]:
            continue
        fits = [(b[0], j) for j, b in enumerate(bins) if b[0] >= sizes[k] and (sources[k] is None or sources[k] not in b[1]) and (clusters[k] is None or clusters[k] not in b[2])]
        j = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[j][0] -= sizes[k]
        bins[j][1].add(sources[k])
        bins[j][2].add(clusters[k])
        out[k] = j
    return out


def test_best_fit_equals_brute_force():
    rng = random.Random(7)
    for _ in range(20):
        n = rng.randrange(60)
        sizes, sources = [rng.choice([0, 3, 5, rng.randrange(40)]) for _ in range(n)], [rng.choice([None, "a", "a", "b", "c", "d"]) for _ in range(n)]
        clusters = [rng.choice([None, *range(20)]) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, 40) == best_fit_brute(sizes, sources, clusters, 40)


def test_packing(spark):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(90)) for _ in range(60)] + ["same text here"] * 5 + [None, "", prose(rng, 1000)]
    frame = docs(spark, texts, [f"s{rng.randrange(9)}" for _ in texts])
    rows = packing.pack(frame, capacity=100, shard_rows=30).collect()
    spans = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.first_word, r.n_words))
        bins[r.shard, r.bin].append(r)
    source = {r.doc_id: r.source for r in frame.collect()}
    for k, t in enumerate(texts):
        at = 0
        for first, n in sorted(spans[k]):
            assert first == at
            at += n
        assert at == len(words_of(t))
    for (_, b), held in bins.items():
        if b >= 0:
            assert sum(r.n_words for r in held) <= 100
            assert len({source[r.doc_id] for r in held}) == len(held)
    assert packing.pack(frame.limit(0)).count() == 0
    assert packing.pack(frame.union(frame), 100, 30).count() == 2 * len(rows)


def test_packing_spreads_hot_rows(spark):
    # A third of the rows are one row, a third have a null id, and one id has many texts.
    items = [(5, "a", 7, 5)] * 2000 + [(None, None, k % 50, k) for k in range(2000)] + [(9, f"s{k % 40}", k % 90, k) for k in range(2000)]
    frame = spark.createDataFrame(items, "doc_id long, source string, n_words long, cluster long")
    rows = packing.pack_documents(frame, 100, 200).collect()
    assert collections.Counter((r.doc_id, r.n_words) for r in rows) == collections.Counter((i, n) for i, _, n, _ in items)
    assert max(collections.Counter(r.shard for r in rows).values()) < 400
    held = collections.Counter((r.shard, r.bin) for r in rows if r.doc_id == 5)
    assert set(held.values()) == {1}  # copies conflict with each other
    assert sorted(map(str, rows)) == sorted(map(str, packing.pack_documents(frame.repartition(7), 100, 200).collect()))


def test_toxicity_learns_words_and_stems():
    rng = random.Random(3)
    toxic = lambda stem: " ".join(stem + rng.choice(["a", "ent", "ix", "or"]) + rng.choice(["", "e", "um"]) if rng.random() < 0.08 else f"w{rng.randrange(300)}" for _ in range(90))
    texts = [toxic("grobu") + " grobux" for _ in range(150)] + [prose(rng, 90, 300) for _ in range(150)]
    labels = np.array([1] * 150 + [0] * 150)
    mixed = np.random.default_rng(0).permutation(300)
    net = toxicity.train(pa.array([texts[k] for k in mixed]), labels[mixed])
    reader = toxicity.Reader(net)
    # Held-out documents from the same source, half of them toxic.
    new = [toxic("grobu") + " grobuorum" for _ in range(60)] + [prose(rng, 80, 300) for _ in range(60)]
    score = toxicity.score_texts(reader, pa.array(new))[0]
    assert (score[:60] >= 0.3).mean() >= 0.95 and (score[60:] >= 0.3).mean() <= 0.05
    fresh = pa.array([new[0], new[-1], None, "", " ".join(["w7"] * 400)])
    score, many, where = toxicity.score_texts(reader, fresh)
    assert (score[2:] < 0.3).all()
    # The fast reader and the network's own pass agree.
    w = Words(fresh)
    row, first, size = toxicity.windows(np.diff(w.offsets), w.offsets)
    _, at, place = np.unique(w.hashes, return_index=True, return_inverse=True)
    slow = net.logits(net.inputs(*net.vocabulary.ids(w, at)), toxicity._ids(place, first, size, toxicity.WINDOW))
    assert np.allclose(reader.windows(w)[2], slow, atol=1e-3)
    assert many.tolist()[2:4] == [0, 0] and where.tolist()[2:4] == [-1, -1] and many[4] == 1 + -(-(400 - 32) // 24)
    assert 0 < toxicity.score_texts(toxicity.Reader(toxicity.train(pa.array(["a b"]), np.array([1]))), pa.array(["a"]))[0][0] < 1


@needs_data
@pytest.mark.parametrize("module,modulus,held", [(quality, 5, 0), (toxicity, 4, 2)])
def test_classifiers_keep_the_contract(spark, module, modulus, held):
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    extra = docs(spark, EDGE, first=10**6).select(frame.columns)
    rows = module.held_out_scores(frame.union(extra), labels).collect()
    assert len(rows) == frame.count() + len(EDGE)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert module.held_out_scores(frame.limit(0), labels).count() == 0


def test_quality_ranks_form():
    rng = random.Random(6)
    good = [prose(rng, 80, 400) + "." for _ in range(200)]
    poor = [" | ".join(prose(rng, 80, 400).split()) for _ in range(50)] + [prose(rng, 40, 400).upper() + "!!! " + "zz " * 60 for _ in range(50)]
    labels = np.array([1] * 200 + [0] * 100)
    mixed = np.random.default_rng(1).permutation(300)
    model = quality.train(pa.array([(good + poor)[k] for k in mixed]), labels[mixed])
    scores = model.scores(pa.array([prose(rng, 80, 400) + ".", " | ".join(prose(rng, 70, 400).split()), "QQ!!! " + "ZZ " * 90, None, ""]))
    assert scores[0] >= 0.3 > max(scores[1], scores[2]) and np.isfinite(scores).all()
    assert quality.train(pa.array(["a"]), np.array([1])).scores(pa.array(["b"]))[0] > 0.3


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Rows of any length and number, dealt to several tasks, few poor ones sent to all; quantiles are those of all rows."""
    rng = random.Random(12)
    texts = [prose(rng, 80, 60) + "." for _ in range(190)] + [" | ".join(prose(rng, 80, 60).split()) for _ in range(9)] + ["zz || " * 8000]
    frame = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k < 190)) for k in range(200)], "doc_id long, quality int")
    met = []
    real = quality.order_statistics
    monkeypatch.setattr(quality, "order_statistics", lambda rows, ranks: met.append((rows.count(), real(rows, ranks))) or met[-1][1])
    model = quality.fit(frame, labels, pairs=2000, task_rows=30)
    dense = quality.measures(pa.array(texts))[0]
    assert met[0][0] == met[1][0] == 200 and (met[0][1] == np.sort(dense, 0)[quality._ranks(200)]).all()
    scores = model.scores(pa.array(texts))
    assert (scores < 0.3).sum() == 10 and (scores[190:] < 0.3).all()
    again = quality.fit(frame, labels, pairs=2000, task_rows=30)
    assert np.allclose(again.weights, model.weights, atol=1e-6)
    values = np.random.default_rng(3).normal(size=(500, 2)).round(1)
    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in values], "dense binary")
    assert (real(rows, np.array([0, 250, 499])) == np.sort(values, 0)[[0, 250, 499]]).all()
    assert quality.fit(frame, labels.filter("quality = 1")).scores(pa.array(["b"]))[0] > 0.3


def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def same(frame, sql):
    want = con().execute(sql)
    order = [frame.columns.index(c[0]) for c in want.description]
    assert len(order) == len(frame.columns)
    return sorted(repr(tuple(r[k] for k in order)) for r in frame.collect()) == sorted(map(repr, want.fetchall()))


@needs_data
def test_oracles(spark):
    read = lambda t: spark.read.parquet(f"{DATA}/{t}.parquet")
    assert same(license_scan.license_scan(read("documents"), license_scan.known_licences(spark)), license_scan.oracle_sql())
    assert same(decontaminate.leaks(read("documents"), read("benchmark")), decontaminate.oracle_sql())
    v = topk.integer_vectors(read("embeddings"))
    assert same(topk.top_products(v.filter("vec_id % 50 = 0"), v), topk.oracle_sql())
    records = warc.round_trip(read("pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert same(records, warc.oracle_sql())


def test_licence_scan_folds(spark):
    full = lambda name: (license_scan.LICENCES / f"{name}.txt").read_text()
    mit, isc, bsd = full("MIT"), full("ISC"), full("BSD-3-Clause")
    unwrapped = " ".join(bsd.split())
    # The word copyright may begin a wrapped line of the terms.
    wrapped = isc.replace("provided that the above\ncopyright notice", "provided that the above\ncopyright notice")
    texts = [
        "Copyright (c) 2020 Somebody\n" + mit.replace("License", "Licence").upper().replace(",", " -"),
        "some prose\nLicenced under the Apache Licence, version 2.0\nmore",
        "licensed under nothing known",
        "MIT License\n\nCopyright (c) 2021 A. Holder\n\n" + mit,
        "ISC License\n\nCopyright 2001 Jane Doe <j@x>\n\n" + wrapped,
        wrapped,
        "code\n// SPDX-License-Identifier: GPL-3.0-or-later\nmore code",
        "BSD 3-Clause License\nCopyright Jane Doe\nAll rights reserved.\n" + unwrapped,
        full("Apache-2.0"),
        full("GPL-3.0-only").split("END OF TERMS")[0].replace("2007 Free", "2007, 2008 Free"),
        "/*\n" + "".join(f" * {line}\n" for line in mit.splitlines()) + " */",
        bsd.replace("1.", "*").replace("2.", "*").replace("3.", "*"),
        full("GPL-2.0-only") + "and more words",
        *EDGE, "Copyright 2020 me", "the " * 500_000, "x" * 2_000_000,
    ]
    want = {(0, "MIT", "document"), (1, "Apache-2.0", "line"), (3, "MIT", "document"), (4, "ISC", "document"), (5, "ISC", "document"), (6, "GPL-3.0-or-later", "line"), (7, "BSD-3-Clause", "document"), (8, "Apache-2.0", "document"), (9, "GPL-3.0-only", "document"), (10, "MIT", "document"), (11, "BSD-3-Clause", "document")}
    frame = docs(spark, texts)
    known = license_scan.known_licences(spark)
    got = {(r.doc_id, r.licence, r.scope) for r in license_scan.license_scan(frame, known).collect()}
    assert {x for x in got if x[2] == "document" or x[0] in (1, 6)} == want
    assert {(r.doc_id, r.licence, r.scope) for r in license_scan.license_scan(frame, known, broadcast_rows=0).collect()} == got
    assert {(r.doc_id, r.licence, r.scope) for r in license_scan.license_scan(frame.union(frame), known).collect()} == got
    assert license_scan.license_scan(frame.limit(0), known).count() == 0
    assert license_scan.license_scan(frame, known.limit(0)).count() == 0


def test_warc_edges(spark):
    page = "<p>" + "text \x1f\x8b\x08 more " * 40
    rows = [(1, "u1", page), (2, None, page), (3, "u\n3", None), (4, "", ""), (5, "u", "x" * 300_000), (6, "u", "other"), (6, "u", "other"), (None, "u", "gone")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload_digest string, refers_to int")
    got = warc.round_trip(pages, split=512).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3, 4, 5, 6, 6]
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[1].payload) == ("revisit", 2, None)
    assert bytes(by[2].payload).decode() == page and by[1].payload_digest == by[2].payload_digest == warc.base32_sha1(page.encode())
    assert (by[3].record_type, by[3].refers_to, by[4].record_type, by[4].payload_bytes) == ("revisit", 4, "response", 0)
    assert {r.record_type for r in warc.round_trip(pages, least_bytes=10**6).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def foreign(kind, block, **more):
    lines = ["WARC/1.0", f"warc-type: {kind}", "WARC-Record-ID: <urn:x>", *(f"{k.replace('_', '-')}: {v}" for k, v in more.items()), f"content-length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [True, False])
def test_warc_reads_other_archives(spark, tmp_path, packed):
    """Records of other makers, some with look-alikes of a record's start in their payloads; the last one is cut off."""
    inner = foreign("response", b"inner")
    blocks = [("warcinfo", b"software: x", {}), ("request", b"GET / HTTP/1.1\r\n\r\n", {"Content_Type": "application/http; msgtype=request"}), ("response", b"HTTP/1.1 200 OK\r\n\r\n<p>" + gzip.compress(inner) + b"WARC/1.0 " + b"x" * 5000, {"Content_Type": "application/http"}), ("revisit", b"", {"WARC_Payload_Digest": "sha1:ABC"}), ("resource", b"", {})]
    records = [foreign(kind, block, **more) for kind, block, more in blocks]
    parts = [gzip.compress(r) if packed else r for r in [*records, foreign("response", b"z" * 400)]]
    blob = b"".join(parts)[:-200 if not packed else -10]
    path = tmp_path / "a.warc"
    path.write_bytes(blob)
    files = spark.createDataFrame([(f"file://{path}", len(blob))], "file string, bytes long")
    for split in (100, 10**6):
        got = sorted(warc.read_warc(spark, files, split).collect(), key=lambda r: r.position)
        assert [r.record_type for r in got] == [k for k, _, _ in blocks]
        assert [None if r.payload is None else bytes(r.payload) for r in got] == [b"software: x", b"", blocks[2][1].partition(b"\r\n\r\n")[2], None, b""]
        assert got[3].payload_digest == "ABC" and {r.page_id for r in got} == {None}


def test_warc_one_payload_of_many_pages(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 4 > 0, "same").otherwise(F.col("id").cast("string")).alias("html"))
    for limit in (10, 0):
        rows = warc.planned_records(pages, broadcast_owners=limit).collect()
        assert len(rows) == 400 and sum(r.refers_to == 399 for r in rows) == 299 and sum(r.refers_to is None for r in rows) == 101


def test_warc_reader_owns_each_record_once():
    fake = b"\x1f\x8b\x08" + bytes(range(200))
    members = [warc.encode_record(k, "u", os.urandom(50 * k) + fake, warc.base32_sha1(b""), 10, None) for k in range(12)]
    blob = members[0] + fake + b"".join(members[1:])
    read = lambda at, n: blob[at : at + n]
    for split in (64, 999, 10**6):
        found = [p for first in range(0, len(blob), split) for p, _ in warc.records_in(read, len(blob), first, min(first + split, len(blob)))]
        assert len(found) == 12 and len(set(found)) == 12


def test_topk_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    lengths = np.exp(rng.normal(0, 1.2, 400))[:, None]
    x = np.floor(rng.normal(0, 200, (400, 24)) * lengths).astype(int)
    x[350:] = x[:50]  # ties
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, x array<long>")
    for sizes in ((40, 8), (64, 1000), (7, 3)):
        got = collections.defaultdict(list)
        for r in topk.top_products(frame.filter("vec_id % 10 = 0"), frame, candidate_rows=sizes[0], query_rows=sizes[1]).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        for q in range(0, 400, 10):
            assert got[q] == [(c, -s) for s, c in sorted((-int(x[q] @ x[c]), c) for c in range(400) if c != q)[:5]]


def test_topk_refuses_what_it_cannot_score(spark):
    frame = spark.createDataFrame([(0, [1e18]), (50, [1e18])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        topk.integer_vectors(frame).collect()


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    vectors = [(k, [float(x) for x in rng.integers(-3, 4, 20) / 4], 0) for k in range(120)]
    vectors += [(k, [1.0] * 20, 0) for k in range(120, 140)] + [(200, None, 0), (201, [None] + [1.0] * 19, 0), (202, [float("nan")] * 20, 0), (203, [float("inf")] * 20, 0), (None, [1.0] * 20, 0), (300, [0.0] * 20, 0)]
    frame = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, label int, rank int, score int")
    x = topk.integer_vectors(frame)
    got = collections.defaultdict(list)
    for r in topk.top_products(x.filter("vec_id % 10 = 0"), x).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    good = {k: np.floor(256 * np.array(v)).astype(int) for k, v, _ in vectors if k is not None and k not in (200, 201, 202, 203)}
    for q in [k for k in good if k % 10 == 0]:
        want = sorted(((-int(good[q] @ good[c]), c) for c in good if c != q))[:5]
        assert got[q] == [(c, -s) for s, c in want]
    assert topk.top_products(x.filter("vec_id = 1"), x.filter("vec_id = 1")).count() == 0
    assert topk.top_products(x.limit(0), x.limit(0)).count() == 0


@needs_vocabulary
def test_token_counts(spark):
    texts = [*EDGE, "hello world", "hello world again " * 50]
    frame = docs(spark, texts)
    encode = token_counts.encoding().encode_ordinary
    lengths = [len(encode(t)) if t else 0 for t in texts]
    assert {r.doc_id: r.n_tokens for r in token_counts.token_lengths(frame).collect()} == dict(enumerate(lengths))
    totals = token_counts.suffix_totals(token_counts.length_histogram(frame), width=4)
    rows = {r.n_tokens: r for r in totals.collect()}
    assert set(rows) == set(lengths)
    for size, r in rows.items():
        assert r.documents == lengths.count(size) and r.docs_from == sum(x >= size for x in lengths)
        assert r.truncated_tokens == sum(min(x, size) for x in lengths) and r.tokens_from == sum(x for x in lengths if x >= size)
    for limit in (0, 1, 3, 10, 10**6):
        assert token_counts.truncated_total(totals, limit).first()[0] == sum(min(x, limit) for x in lengths)
    assert token_counts.quantile_length(totals, 0.5).first()[0] == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    assert token_counts.suffix_totals(token_counts.length_histogram(frame.limit(0))).count() == 0


@needs_vocabulary
def test_token_counts_of_very_long_runs(spark):
    runs = [" " * 2_000_000, "a" * 2_000_000, "word" + "\n" * 1_000_000 + "word", " " * 3000 + "x"]
    frame = docs(spark, [None, "", *runs])
    got = {r.doc_id: r.n_tokens for r in token_counts.token_lengths(frame).collect()}
    encoder = token_counts.encoding()
    # Blanks before a word: all but the last are a piece of their own.
    assert [got[0], got[1], got[2], got[5]] == [0, 0, 2_000_000, len(encoder.encode_ordinary(runs[3]))]
    assert got[3] == len(encoder.encode_ordinary(runs[1])) and sum(r.documents for r in token_counts.suffix_totals(token_counts.length_histogram(frame)).collect()) == 6


def test_token_counts_cut_at_blanks_change_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_RUN", 3)
    monkeypatch.setattr(token_counts, "_BLANKS", re.compile(token_counts._BLANKS.pattern.replace("2000", "3")))
    rng, encoder = random.Random(1), token_counts.encoding()
    for _ in range(3000):
        text = "".join(rng.choice([" ", "  ", "\n", "\t", "\u3000", "\x85", "\x1c", "a", "bc", "1", "!", "é", "\u200b"]) for _ in range(rng.randrange(30)))
        assert token_counts.token_count(text, encoder) == len(encoder.encode_ordinary(text))


@needs_vocabulary
@pytest.mark.parametrize("head", [100_000, 3])
def test_language_model(spark, head):
    rng = random.Random(9)
    texts = [prose(rng, 120, 60) for _ in range(60)] + EDGE + ["rare words once", "rare words once"]
    frame = docs(spark, texts)
    frame = frame.union(frame.filter("doc_id = 3"))
    training = frame.filter("doc_id % 5 != 0")
    rows = language_model.log_probabilities(frame, training, head_words=head).collect()
    tokens = lambda t: [*words_of(t), None]
    counts = collections.Counter(x for r in training.collect() for x in tokens(r.text))
    total, kinds = sum(counts.values()), len(counts)
    assert len(rows) == frame.count()
    for r in rows:
        mine = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(counts[x] > 0 for x in mine), total)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in mine), rel_tol=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert language_model.log_probabilities(frame, frame.limit(0)).count() == len(rows)
    assert language_model.log_probabilities(frame.limit(0), training).count() == 0


@needs_vocabulary
def test_language_model_does_not_depend_on_the_head(spark):
    rng = random.Random(4)
    frame = docs(spark, [prose(rng, 120, 60) for _ in range(20)] + EDGE + ["rare words once", "rare words once", "x" * 1_000_000, " " * 100_000])
    frame = frame.union(frame.filter("doc_id = 3"))
    full, short = ({r.doc_id: (r.score, r.base_score, r.n_known) for r in language_model.log_probabilities(frame, frame, head_words=head, rounds=1).collect()} for head in (100_000, 3))
    assert full.keys() == short.keys() and all(np.allclose(full[k], short[k], rtol=1e-6) for k in full)


@needs_vocabulary
def test_language_model_is_a_distribution():
    rng = random.Random(5)
    texts = pa.array([prose(rng, 200, 3000) for _ in range(20)])
    model = language_model.train(texts, rounds=1)
    ids = np.array([1, 2, 3, 40, 5] * 30, np.int32)
    ids[:60] = language_model.Spelling(VOCABULARIES).ids(Words(texts))[0][:60]
    offsets = np.array([0, 7, 7, 100, 150])
    got = model.log_probabilities(ids, offsets)
    for first, scored, end in zip(*language_model.spans(offsets)):
        before = np.append(50256 if first in offsets[:-1] else ids[first - 1], ids[first : end - 1])
        s = model.forward(model.known[before][None])[0]
        assert np.allclose(np.exp(s).sum(-1), 1, atol=1e-3)  # over all subwords, after every position
        assert np.allclose(got[scored:end], s[np.arange(end - first), ids[first:end]][scored - first :], atol=1e-4)
    # Gradients agree with differences.
    wide = max(model.slices, key=lambda edges: edges[1] - edges[0])
    frequent = np.append(np.flatnonzero(model.known == wide[0]), np.argsort(-np.bincount(ids[:60]))[:3])
    x, target, weight = model.known[frequent][None], frequent[None, ::-1], np.ones((1, 4), np.float32)
    spot, model.p = wide[0], {k: v.astype(np.float64) for k, v in model.p.items()}
    assert wide[1] - wide[0] > 1
    for name, at in (("q", (0, 1)), ("E", (spot, 3)), ("A", (1, 1)), ("P", (0, 0)), ("C", (2, 5)), ("D", (spot, 2)), ("d", spot)):
        grads, _ = model.gradients(x, target, weight)
        kept, step = model.p[name][at], 1e-4
        model.p[name][at] = kept + step
        up = model.gradients(x, target, weight)[1]
        model.p[name][at] = kept - step
        down = model.gradients(x, target, weight)[1]
        model.p[name][at] = kept
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-6


@needs_vocabulary
def test_language_model_score_is_that_of_its_subwords(spark):
    """The score against a plain walk: each subword's probability given all windows' past, one subword after the other."""
    rng = random.Random(6)
    texts = [prose(rng, 50, 30) for _ in range(12)] + [None, "", "Two  Words"]
    frame = docs(spark, texts)
    sent = language_model.fit(frame, rounds=1, task_documents=5)
    again = language_model.fit(frame, rounds=1, task_documents=5)
    assert np.allclose(sent.vector(), again.vector(), atol=1e-5)
    got = {r.doc_id: r.score for r in language_model.log_probabilities(frame, frame, rounds=1, task_documents=5).collect()}
    encode = token_counts.encoding().encode_ordinary
    for k, text in enumerate(texts):
        ids = [i for w in words_of(text) for i in encode(" " + w.decode())] + [50256]
        total = 0.0
        for at, i in enumerate(ids):
            step = language_model.CONTEXT - language_model.OVERLAP
            first = 0 if at < language_model.CONTEXT else (at - language_model.OVERLAP) // step * step
            past = [50256 if j == 0 else ids[j - 1] for j in range(first, at + 1)]
            total += sent.forward(sent.known[past][None])[0, -1, i]
        assert math.isclose(got[k], total / math.log(10), rel_tol=1e-4), k


@needs_vocabulary
def test_language_model_learns_from_every_document(spark):
    """Each document has a subword of its own: all are counted, have a class and are met in training."""
    rng = random.Random(8)
    encode = token_counts.encoding().encode_ordinary
    single = [w for w in (f" {chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)) if len(encode(w)) == 1][:90]
    texts = [prose(rng, 30, 20) + w * 3 for w in single] + ["word " * 5000 + single[0]]
    frame = docs(spark, texts)
    at = [encode(w)[0] for w in single]
    model, fresh = (language_model.fit(frame, least=5, task_documents=10, rounds=n) for n in (4, 0))
    assert (model.known[at] > 0).all() and (model.classes[at] < language_model.CLASSES - 1).all()
    rows = model.known[at]
    assert (np.abs(model.p["E"][rows] - fresh.p["E"][rows]).sum(1) > 0).all()
    # Rounds part a large corpus between them and go over a small one each.
    dealt = spark.range(language_model.DEALT, step=997).withColumnRenamed("id", "dealt")
    for count, least, times in ((10**6, 5, {1}), (4, 5, {3})):
        met = collections.Counter(r.dealt for k in range(3) for r in dealt.filter(language_model.of_round(k, 3, count, least)[0]).collect())
        assert len(met) == dealt.count() and set(met.values()) <= times | {2}


def test_language_model_gradients_are_slopes_whatever_the_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    ids = rng.zipf(1.3, 4000).astype(np.int32) % 600
    counts = np.bincount(ids, minlength=50257)
    top, known = language_model.ranked(counts)
    model = language_model.Model(counts, language_model.neighbours(ids, known, len(top)))
    x, target, weight = model.known[ids[:384].reshape(12, 32)], ids[1:385].reshape(12, 32), (rng.random((12, 32)) > 0.2).astype(np.float32)
    target[0, :3] = 699  # a subword without vectors
    whole, loss = model.gradients(x, target, weight)
    score = model.log_probabilities(ids, np.array([0, 5, 5, 1000, 1020, 4000]))
    for name, p in model.p.items():
        # The slope along the gradient itself, which is large against rounding.
        step = whole[name] / max(1e-12, np.sqrt((whole[name] ** 2).sum())) * 0.05
        ends = []
        for sign in (1, -1):
            model.p[name] = (p + sign * step).astype(np.float32)
            logs = model.forward(x)[np.arange(12)[:, None], np.arange(32), target]
            ends.append(-logs[weight > 0].mean())
        model.p[name] = p
        assert math.isclose((ends[0] - ends[1]) / 0.1, np.sqrt((whole[name] ** 2).sum()), rel_tol=0.05), name
    for name, size in (("NEAR_ROWS", 37), ("NEAR_WINDOWS", 3)):
        monkeypatch.setattr(language_model, name, size)
    parts, again = model.gradients(x, target, weight)
    assert math.isclose(loss, again, rel_tol=1e-5) and all(np.allclose(whole[k], parts[k], atol=1e-6) for k in whole)
    assert np.allclose(score, model.log_probabilities(ids, np.array([0, 5, 5, 1000, 1020, 4000]), batch=7), atol=1e-4)


@needs_vocabulary
def test_language_model_encodes_words_many_at_once():
    """The same subwords as word by word, few calls, also where the memory of words is small."""
    rng = random.Random(12)
    parts = [" ", "  ", "\n", "\t", "\u3000", "\x85", "\x1c", "\xa0", "a", "B", "'s", "'", "'ll", "1", "!", "é", "\u200b", "日本", "\u2003", "\U0001f600", "\x00", "x" * 300, "é" * 200, "\u0301", "Ⅷ", "²", "_", "\ufeff"]
    texts = [prose(rng, 400, 200) for _ in range(20)] + ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)] + EDGE
    encode, calls = token_counts.encoding().encode_ordinary, []
    spelling = language_model.Spelling(VOCABULARIES)
    spelling.encode = lambda text: calls.append(text) or encode(text)
    spelling.ids(Words(pa.array(texts[:20])))
    assert len(calls) == 1
    spelling.LIMIT = 50
    for k in range(0, len(texts), 30):
        words = [w.decode() for t in texts[k : k + 30] for w in words_of(t)]
        split = [[i for j in range(0, len(w), 256) for i in encode(" " * (j == 0) + w[j : j + 256])] for w in words]
        ids, sizes = spelling.ids(Words(pa.array(texts[k : k + 30])))
        assert sizes.tolist() == [len(x) for x in split] and ids.tolist() == [i for x in split for i in x]


@needs_vocabulary
def test_language_model_reads_and_encodes_texts_once_for_learning_and_scoring(spark, tmp_path):
    rng = random.Random(13)
    log = str(tmp_path / "passes")

    def met(batches):
        with open(log, "a") as f:
            for batch in batches:
                f.write("x" * batch.num_rows)
                yield batch

    frame = docs(spark, [prose(rng, 60, 40) for _ in range(40)] + EDGE)
    rows = frame.count()
    seen = frame.select("doc_id", "text").mapInArrow(met, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    learnt = frame.filter(~held).count()
    assert len(language_model.held_out_scores(seen).collect()) == rows
    # Once for the word counts, once for all else.
    assert os.path.getsize(log) <= 2 * rows
    marked, apart = ({r.doc_id: tuple(r) for r in language_model.log_probabilities(frame, t, head_words=20, rounds=0).collect()} for t in (~held, frame.filter(~held)))
    assert learnt < rows and marked.keys() == apart.keys() and all(np.allclose(marked[k], apart[k], rtol=1e-9) for k in marked)


def test_language_model_counts_neighbours_one_by_one():
    rng = np.random.default_rng(2)
    flat = rng.integers(0, 40, 300).astype(np.int32)
    known = np.append(rng.permutation(30) + 1, np.zeros(20, np.int32)).astype(np.int32)
    for n in (0, 1, 2, 12, 13, 300):
        want = np.zeros((31, 60), np.int64)
        for i in range(n):
            for j in (*range(i - 12, i), i + 1):
                if 0 <= j < n and known[flat[i]] and known[flat[j]]:
                    want[known[flat[i]], known[flat[j]] - 1 + 30 * (j != i - 1)] += 1
        assert (language_model.neighbours(flat[:n], known, 30).reshape(31, -1) == want).all()


@needs_data
@needs_vocabulary
def test_language_model_beats_word_counts_on_held_out_texts(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language_model.held_out_scores(frame).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def test_decontamination_finds_changed_slots(spark):
    item = "a train leaves the old station at 12 with 30 passengers on board and then 12 more get on before noon how many ride"
    other = "quite another question about the colours of seven small birds that sing in the morning near the river bank"
    dense = "Compute 12 * 30 + 4 - 6 / 2 + 18 * 5 - 7"
    sold = "Maria buys nine red apples today. Maria then sells four of them. Maria now counts what is left here."
    rows = [(1, item), (2, other), (3, item), (4, None), (5, "short"), (6, dense), (7, sold)]
    bench = spark.createDataFrame([(*r, "x", "y") for r in rows], "item_id long, text string, doc_id string, key string")
    changed = item.replace("12", "17").replace("30", "45")
    mixed = item.replace("at 12", "at 17").replace("then 12", "then 99")
    texts = [
        f"before {item} after", f"Before. {changed.upper()}! After", f"x {mixed} y", "nothing of the sort stands in this text at all, nor in others", *EDGE, other[:60],
        f"So: {dense}!", sold.replace("Maria", "Jonas"), sold.upper(), sold.lower(), sold.replace("sells", "gives").replace("Maria now", "Peter now"), "Short", "a short text", "Compute 11 * 31 + 5 - 7 / 3 + 19 * 6 - 8", "1 2 3 " * 400_000, "word " * 200_000,
    ]
    frame = docs(spark, texts)
    n = 4 + len(EDGE) + 1
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(frame, bench).collect()}
    want = {(0, 1), (0, 3), (1, 1), (1, 3), (n, 6), (n + 1, 7), (n + 2, 7), (n + 3, 7), (n + 5, 5)}
    assert set(got) - {(2, 1), (2, 3), (n + 4, 7)} == want
    assert got[0, 1].changed == 0 and got[1, 1].changed == got[1, 1].slots > 0
    assert got[n + 1, 7].changed == 3 and got[n + 2, 7].changed == 0 and got[n, 6].changed == 0
    leaking = {d for d, _ in got}
    kept = decontaminate.decontaminate(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts))) - leaking
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0 and decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.decontaminate(frame.union(frame), bench).count() == 2 * (len(texts) - len(leaking))
    # Rows without an id are judged by their texts; of one id with two texts only the leaking one goes.
    loose = docs(spark, [item, "clean words only"]).withColumn("doc_id", F.lit(None).cast("long")).union(docs(spark, [other, "other clean words"]).withColumn("doc_id", F.lit(0).cast("long")))
    assert {(r.doc_id, r.text) for r in decontaminate.decontaminate(loose, bench).collect()} == {(None, "clean words only"), (0, "other clean words")}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(loose, bench).collect()} == {(None, 1), (None, 3), (0, 2)}


def test_decontamination_equals_its_sql_on_slots(spark, tmp_path, monkeypatch):
    """Items with numbers, names and units, documents with some of them changed: Spark against the SQL, joined both ways."""
    rng = random.Random(12)
    word = lambda: rng.choice(["the", "of", "a", "red", "sells", "then", "boxes", "Anna", "Bob", "Lea", "12", "3.5", "40", "kg", "km", "days"] + [f"w{chr(97 + rng.randrange(26))}"] * 9)
    items = [" ".join(word() for _ in range(rng.randrange(3, 50))) for _ in range(40)]
    items += [items[0], items[1].replace("12", "13"), items[2]]

    def edit(text):
        out = text.split()
        swaps = {a: rng.choice(["12", "77", "9", "Max", "Eva"]) for a in ("12", "40", "Anna", "Bob")}
        if rng.random() < 0.6:
            out = [swaps.get(w, w) for w in out]
        for _ in range(rng.randrange(3)):
            out[rng.randrange(len(out))] = word()
        return " ".join(out).upper() if rng.random() < 0.1 else " ".join(out)

    texts = [" ".join([*(word() for _ in range(rng.randrange(20))), edit(rng.choice(items)), *(word() for _ in range(rng.randrange(20)))]) for _ in range(150)] + [None, "", "short"]
    frame, bench = docs(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    frame.select("doc_id", "text").write.parquet(str(tmp_path / "documents"))
    bench.write.parquet(str(tmp_path / "benchmark"))
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}/*.parquet'")
    want = sorted(c.execute(decontaminate.oracle_sql()).fetchall())
    for limit in (decontaminate.BROADCAST_WINDOWS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        got = sorted(tuple(r) for r in decontaminate.leaks(frame, bench).collect())
        assert got == want and sum(r[5] > 0 for r in got) > 5 and len(got) > 50


def test_decontamination_holds_each_item_of_a_template(spark):
    item = "the shop on the corner sold 5 red apples and then 5 green pears to the old man who came along"
    other = item.replace("5 green", "6 green")
    bench = spark.createDataFrame([(3, item), (7, other), (9, other)], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.leaks(docs(spark, [item, other]), bench).collect()}
    assert {(0, 3, 0), (1, 7, 0), (1, 9, 0)} <= got


def test_decontamination_counts_each_place_of_an_item_once(spark):
    item = " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(32))
    words = item.split()
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    one, halves = " ".join(words[:8]), " ".join([*words[8:16], "between", *words[20:28]])
    frame = docs(spark, [" so ".join([one] * 5), halves, " ".join(words[2:14]) + " and " + " ".join(words[6:18])])
    got = {(r.doc_id, r.item_id, r.covered) for r in decontaminate.leaks(frame, bench).collect()}
    assert got == {(1, 1, 16), (2, 1, 16)}


def test_decontamination_leaves_out_only_windows_around_odd_slots(spark):
    item = "the shop sold 5 red apples in the morning and then 6 green pears at noon before the owner went home and counted all that was left of the 5 red apples on the long shelf by the door"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    edited, merged = item.replace("the 5 red", "the 7 red"), item.replace("5", "9").replace("6", "9")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs(spark, [edited, merged]), bench).collect()}
    assert set(got) == {(0, 1), (1, 1)}
    assert got[1, 1].covered == got[1, 1].item_words > got[0, 1].covered and got[0, 1].changed == 1


def test_tidying_gives_the_heap_back(spark):
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    assert shared.tidy(spark, 0)
    total = heap.totalMemory()
    assert total < 2 * (total - heap.freeMemory()) + (32 << 20)
    assert not shared._manage(spark, "NoSuchBean", "none")


def test_written_tables_tidy_the_driver(spark, monkeypatch):
    """What finished queries left on the heap is collected when a table is written, once in a while."""
    monkeypatch.setattr(shared, "_tidied", [float("-inf")])
    assert shared.tidy(spark) and not shared.tidy(spark) and shared.tidy(spark, 0)
    met = []
    monkeypatch.setattr(shared, "tidy", met.append)
    assert written(spark.range(10), "few").count() == 10 and met == [spark]


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    now = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in now.select("doc_id").collect()}
        now = stage(spark, now, DATA)
        assert now.columns == frame.columns
        now = written(now, "stage")
        assert {r.doc_id for r in now.select("doc_id").collect()} <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, now, DATA)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in now.collect()}
    twice = docs(spark, ["some clean words of text here"] * 3).select(frame.columns)
    assert corpus_pipeline.one_of_each(spark, twice.union(twice), DATA).count() == 1


@needs_data
def test_pipeline_edges(spark):
    """Stages over null ids and texts, blanks, repeats, a long text and clashing columns; then over no rows at all."""
    import corpus_pipeline

    frame = docs(spark, [*EDGE, "some clean words of text here", "some clean words of text here", "word " * 100_000])
    frame = frame.union(frame.filter("doc_id = 7")).union(frame.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    for stage in (corpus_pipeline.one_of_each, corpus_pipeline.drop_leaks):
        out = stage(spark, frame, DATA)
        assert out.columns == frame.columns and out.filter("doc_id IS NULL").count() == 1
        assert stage(spark, frame.limit(0), DATA).count() == 0
    assert corpus_pipeline.one_of_each(spark, frame, DATA).filter("doc_id IN (7, 8)").count() == 1
    assert corpus_pipeline.pack_windows(spark, frame, DATA).select("doc_id").distinct().count() == len(EDGE) + 4
