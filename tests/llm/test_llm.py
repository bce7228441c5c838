"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import tokenizers
import xxhash
from pyspark.sql import functions as F

from quantloom.llm import base, bm25, bpe, graph, langid, mixing, queries, shards, simhash, substring, vectors, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (4, "one two"), (None, "a b c d e f g h i j k l m n"), (5, "w " * 30_000), (6, "Zürich 漢字 \U0001f600 \x1c x")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumns({"key": F.lit(1), "fp": F.lit(2), "u": F.lit(3), "places": F.lit("x"), "copies": F.lit(9)})


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def near_texts():
    out, w = [], words(200, 1, 10_000)
    for i in range(40):
        c = list(w)
        for j in range(i % 4):
            c[j * 17] = f"x{i}"
        out.append((i + 10, " ".join(c)))
    return out + [(i + 100, " ".join(words(50, i, 10_000))) for i in range(20)]


def plain_fingerprint(text):
    split = (text or "").encode().lower().split()
    grams = [b" ".join(split[i : i + 3]) for i in range(len(split) - 2)] or ([b" ".join(split)] if split else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark):
    rows = near_texts() + ODD
    got = simhash.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((str(r.doc_id), int(r.fingerprint, 16)) for r in got) == sorted((str(i), f) for i, f in fps)
    label = {f: f for _, f in fps}
    for _ in range(len(label)):
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    least = {}
    for i, f in fps:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    for r in got:
        assert r.component_id == least.get(label[int(r.fingerprint, 16)])
    kept = simhash.keep_first(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect() if r.doc_id} == set(least.values())
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_simhash_splits_hot_cells_without_losing_links(spark):
    r = random.Random(3)
    center = r.getrandbits(64)
    fps = {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)}
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    whole = graph.components(simhash.links(df)).groupBy("root").count().collect()
    split = graph.components(simhash.links(df, cell_rows=20)).groupBy("root").count().collect()
    assert sorted(x["count"] for x in whole) == sorted(x["count"] for x in split)


def test_popcount_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    assert (np.bitwise_count(simhash.unary_counts(a) ^ simhash.unary_counts(b)) <= np.bitwise_count(a ^ b)).all()


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (None, 5), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in graph.components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100


def test_rows_without_an_estimate_are_measured(spark):
    rows = docs(spark, [(i, "a" * 1000) for i in range(50)] + [(None, None)])
    assert 50_000 <= base.input_bytes(rows) < 60_000 and base.buckets_for(rows) == 32
    assert base.input_bytes(rows.where("doc_id < 0")) == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert base.input_bytes(table.alias("a").join(table.alias("b"), "doc_id")) <= 2 * base.input_bytes(table)


def test_substring_equals_brute_force(spark):
    shared = words(30, 5)
    rows = [(i, " ".join(words(25, i) + shared[i % 5 :] + words(10, i + 99))) for i in range(12)] + [(20, " ".join(shared[:13])), (21, " ".join(shared[:12])), *[r for r in ODD if r[0] is not None]]
    got = sorted(map(tuple, substring.digest(docs(spark, rows)).collect()))
    assert got == sorted(substring.brute_force(rows)) and any(r[2] for r in got)
    cut = substring.cut(docs(spark, rows))
    assert cut.columns == docs(spark, rows).columns and cut.count() == len(rows)
    assert substring.digest(docs(spark, [(None, "a " * 20), (3, "a " * 20), (3, "b " * 20)])).where("n_removed > 0").count() == 1
    assert substring.digest(docs(spark, [])).count() == 0


def test_cover_reaches_every_difference():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


TEXTS = [t for _, t in ODD if t] + ["a" * 4000, "the cat's  end\n\n <|endoftext|> x", " lead and trail ", "\t\n mix   1234,56!", "", "naïve ĀĂ"]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    got = bpe.token_counts(docs(spark, [*enumerate(TEXTS), (99, None)]), path).orderBy("doc_id").collect()
    for r, t in zip(got, [*TEXTS, ""], strict=True):
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
    assert got[0].over_limit is False and next(r for r in got if r.n_bytes > 50_000).over_limit


def encoding():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_round_trips_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    _, library = encoding()
    rows = docs(spark, [*enumerate(TEXTS), (99, None)])
    for r, t in zip(bpe.round_trips(rows, path).orderBy("doc_id").collect(), [*TEXTS, ""], strict=True):
        ids = library.encode_ordinary(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decoded(bpe.encoded(rows, path), path).orderBy("doc_id").collect()
    assert [r.text for r in back] == [*TEXTS, ""]


def test_prefix_encoder_edits(spark):
    ranks, _ = encoding()
    v, r = bpe.Vocabulary(ranks), random.Random(2)
    for _ in range(60):
        text = "".join(r.choices(["th", "er", "zq", " ", "é"], k=500)).encode()
        e, a = bpe.PrefixEncoder(v, text), r.randrange(len(text))
        b = min(len(text), a + r.randrange(9))
        anew = e.replace(a, b, b"on")
        assert e.tokens() == bpe.PrefixEncoder(v, text[:a] + b"on" + text[b:]).tokens() and anew <= len(text)


def test_language_models(spark):
    df = base.table(spark, SF, "documents")
    got = langid.identify(df).join(df.select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95
    model = langid.train(df)
    rows = langid.predict(docs(spark, [(1, None), (2, "123 ..."), (3, "漢字漢字漢字漢字漢字漢字 дом дом дом дом"), *ODD]), model).collect()
    assert [r.lang_pred for r in rows if r.doc_id in (1, 2)][:2] == ["und", "und"] and all(0 <= r.score <= 1 for r in rows)
    assert next(r for r in rows if r.doc_id == 3).rejected and len(rows) == 3 + len(ODD)
    assert langid.identify(docs(spark, []).withColumn("lang", F.lit(None).cast("string"))).count() == 0
    p = np.exp(model.log_probs(langid._padded(["the"], model.order)[0]))
    assert (p > 0).all() and (p < 1).all()


def test_mixing(spark):
    rows = [(i, "w " * (i % 9), "en", ["b", "a", None, "z"][i % 4], 0) for i in range(400)] + [(None, None, "en", "empty", 0)]
    df = spark.createDataFrame(rows, DOC)
    got = mixing.taken(df).collect()
    assert len(got) == 401 and all(0 <= r.copies <= 2 for r in got)
    total, goal = sum(r["size"] for r in got), {r.source: (r.target, r.source_size) for r in got}
    assert sum(t for t, _ in goal.values()) == pytest.approx(1.5 * total) and all(t <= 2 * s + 1e-9 for t, s in goal.values())
    for s, (t, _) in goal.items():
        assert sum(r["size"] * r.copies for r in got if r.source == s) == pytest.approx(t, rel=0.25, abs=1)
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(df.repartition(7)).collect()))
    mixed = mixing.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.taken(docs(spark, [])).count() == 0


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    rows = [(1, "u", "<a>"), (2, "u\r\nx", "<a>"), (3, None, None), (4, "u", ""), (None, "x", "<a>"), (9, "x", "é\r\n\r\nWARC/1.1\r\nq")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"n": F.lit(1), "payload": F.lit("x")})
    path = str(tmp_path / "w")
    warc.write(warc.with_revisits(pages, "page_id", "html"), path)
    got = {r.page_id: r for r in warc.read_pages(spark, path).collect()}
    assert {k: r.refers_to for k, r in got.items()} == {1: 2, 2: None, 3: 4, 4: None, None: 2, 9: None}
    for i, _, h in rows:
        data = (h or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    heads = warc.read(spark, path, payload=False).where("record_type = 'response'")
    assert heads.count() == 3 and heads.where("payload is not null").count() == 0
    assert warc.read(spark, path).where(F.col("headers")["warc-type"] == "revisit").count() == 3
    more = warc.read(spark, path, payload=False, headers=("X-Payload-Length",))
    for test, n in (("x_payload_length = '3'", 3), ("record_type <> 'revisit'", 3), ("target_uri like 'u%'", 3), ("x_payload_length in ('0', '3') and record_type = 'revisit'", 3)):
        found = more.where(test)
        assert not re.search(r"\bFilter\b", found._jdf.queryExecution().executedPlan().toString()), test
        assert found.count() == n, test
    assert warc.read_pages(spark, path).count() == len(rows)


def test_nearest_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:60] = x[50]
    rows = [(i, x[i].tolist()) for i in range(300)] + [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [1.0, 2.0])]
    got = vectors.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("rank", F.lit(0)), F.col("vec_id") % 20 == 0, 7).collect()
    d = x.astype(np.float64)
    for q in range(0, 300, 20):
        score = d @ d[q]
        want = [j for j in np.lexsort((np.arange(300), -np.round(score, 12))) if j != q][:7]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert {r.query_id for r in got} == set(range(0, 300, 20))


def test_bm25_equals_brute_force(spark):
    texts = {i: " ".join(words(40 + i % 30, i, 150)) for i in range(180)}
    rows = [*texts.items(), (200, None), (201, ""), (None, "w1 w2")]
    got = bm25.search(docs(spark, rows), F.col("doc_id") % 50 == 0, 5).collect()
    tf = {i: {w: t.split().count(w) for w in set(t.split())} for i, t in [*texts.items(), (None, "w1 w2")]}
    n, mean = len(tf), sum(sum(f.values()) for f in tf.values()) / len(tf)
    df = {}
    for f in tf.values():
        for w in f:
            df[w] = df.get(w, 0) + 1
    idf = {w: np.log1p((n - k + 0.5) / (k + 0.5)) for w, k in df.items()}
    for q in (0, 50, 100, 150):
        score = {i: round(sum(c * idf[w] * f[w] * 2.2 / (f[w] + 1.2 * (0.25 + 0.75 * sum(f.values()) / mean)) for w, c in tf[q].items() if w in f), 6) for i, f in tf.items() if i not in (q, None)}
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [(r.doc_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [(i, pytest.approx(s, abs=2e-6)) for i, s in want]


def test_compaction(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1 << 20, smallest_bytes=1 << 10)
    assert store.read().count() == 0
    parts = [docs(spark, [(i * 10 + j, f"t{j}") for j in range(10)]).coalesce(1) for i in range(9)]
    for p in parts:
        store.append(p)
    before = store.manifest()
    assert len(before.shards) == 9 and store.plan(before)
    after = store.compact()
    assert len(after.shards) < 9 and after.version > before.version
    assert store.read().count() == 90 and store.read(before.version).count() == 90
    with pytest.raises(shards.Conflict):
        store.commit(before, before.schema, [])
    assert store.vacuum() == 0 and store.vacuum(lease=0) > 0 and store.read().count() == 90
    store.append(docs(spark, []))
    assert store.read().count() == 90


def test_queries_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 11))
