"""The pipeline, the language models and what each operator must not do, against plain Python."""

from __future__ import annotations

import hashlib
import io
import math
import random
import threading
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm_whole import brute_first

from quantloom.llm import bm25, bpe, jaccard, langid, shards, simhash, substring, vectors, warc
from quantloom.llm.base import WORD

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ter", "san"], "bb": ["zu", "vre", "xo", "qui", "jy"]}


def prose(r, lang, n):
    return [r.choice(SYLLABLES[lang]) + r.choice(SYLLABLES[lang]) + r.choice(SYLLABLES[lang]) for _ in range(n)]


def corpus():
    r, rows = random.Random(7), []
    passage = prose(r, "aa", 40)
    for i in range(120):
        lang = "aa" if i % 3 else "bb"
        words = prose(r, lang, 30 + i % 50)
        if i % 10 == 0:
            words += passage
        rows.append((i, " ".join(words), lang, ["s2", "s1", None, "s3"][i % 4], 0))
        if i % 8 == 1:  # a near copy and an exact one
            near = list(words)
            near[len(near) // 2] = "kalolo"
            rows += [(1000 + i, " ".join(near), lang, "s1", 0), (2000 + i, " ".join(words), None, "s4", 0)]
    odd = [(5000, None, "aa", "s1", 0), (5001, "", "bb", "s1", 0), (5002, "12 ½ ² ①", "aa", "s2", 0), (5003, "漢字仮名交文" * 30, None, "s2", 0)]
    return rows + odd, {5000, 5001, 5002, 5003}


def brute_mix(rows):
    """Copies of each row by water-filling in rising order of cap over weight."""
    count = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += count(t)
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), list(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] < weight[s] * level]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for row in rows:
        rate = target[row[3]] / sizes[row[3]] if sizes[row[3]] else 0
        u = int(hashlib.md5(f"mix:{row[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [row] * (math.floor(rate) + (u < rate - math.floor(rate)))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows, rejected = corpus()
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    rows = [r for r in rows if r[0] not in rejected]
    first = brute_first([(r[0], r[1]) for r in rows])
    assert len(first) < len(rows) - 20
    rows = [r for r in rows if r[0] in first]
    cut = {i: (n, digest) for i, _, n, digest in substring.brute_force([(r[0], r[1]) for r in rows])}
    assert sum(n > 0 for n, _ in cut.values()) > 5
    seen, kept = {}, []
    for i, t, *rest in sorted(rows):
        words = t.split()
        windows = [tuple(words[p : p + 13]) for p in range(len(words) - 12)]
        gone = {q for p, w in enumerate(windows) if seen.get(w, i) < i for q in range(p, p + 13)}
        for w in windows:
            seen.setdefault(w, i)
        text = " ".join(w for q, w in enumerate(words) if q not in gone)
        assert (len(gone), hashlib.sha256(text.encode()).hexdigest()) == cut[i]
        kept.append((i, text, *rest))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = []
    for i, t, *_ in brute_mix(kept):
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, got)) == sorted(want)


def brute_kneser_ney(counts, order, letters):
    """p(c | context) of one language by the recursive definition, over strings with their padding."""
    grams = defaultdict(Counter)
    for run, n in counts.items():
        text = chr(1) * (order - 1) + run + chr(2)
        for at in range(order - 1, len(text)):
            grams[order][text[at - order + 1 : at + 1]] += n
    for k in range(order - 1, 0, -1):
        raw, wider = Counter(), defaultdict(set)
        for run, n in counts.items():
            text = chr(1) * (order - 1) + run + chr(2)
            for at in range(order - 1, len(text)):
                raw[text[at - k + 1 : at + 1]] += n
        for g in grams[k + 1]:
            wider[g[1:]].add(g)
        for g in raw:
            grams[k][g] = raw[g] if k > 1 and g[0] == chr(1) else len(wider[g])

    def discount(k):
        one, two = (sum(n == x for n in grams[k].values()) for x in (1, 2))
        return one / (one + 2 * two) if one and two else 0.75

    def p(context, c):
        k = len(context) + 1
        here = {g: n for g, n in grams[k].items() if g[:-1] == context}
        lower = p(context[1:], c) if k > 1 else 1 / (letters + 1)
        if not here:
            return lower
        d, total = discount(k), sum(here.values())
        return max(here.get(context + c, 0) - d, 0) / total + sum(min(n, d) for n in here.values()) / total * lower

    return p


def test_kneser_ney_equals_its_definition():
    counts = {"aa": {"abab": 3, "abba": 1, "b": 2, "cab": 1}, "bb": {"xyx": 2, "yax": 1, "y": 5}}
    model = langid.fit(counts, 3)
    letters = {c for runs in counts.values() for run in runs for c in run} | {chr(2)}
    for i, lang in enumerate(model.languages):
        p = brute_kneser_ney(counts[lang], 3, len(letters))
        for run in ("abab", "yx", "cq", "b"):
            chars, _, predicted = langid._padded([run], 3)
            text = chr(1) * 2 + run + chr(2)
            want = [math.log(p(text[at - 2 : at], text[at])) for at in range(2, len(text))]
            assert model.log_probs(chars)[predicted][:, i] == pytest.approx(want)
        for context in ("ab", chr(1) + "a", "zz"):
            assert sum(p(context, c) for c in [*letters, "?"]) == pytest.approx(1)


def test_letterless_texts_are_undetermined(spark):
    rows, _ = corpus()
    df = spark.createDataFrame(rows, DOC)
    model = langid.train(df)
    odd = spark.createDataFrame([(1, "½ ²"), (2, "① ② ③"), (3, "Ⅷ"), (4, "_ 12"), (5, "kalomi ½"), (6, None)], "doc_id bigint, text string")
    assert [r.lang_pred for r in langid.predict(odd, model).orderBy("doc_id").collect()] == ["und", "und", "und", "und", "aa", "und"]
    judged = langid.predict(df.where("lang is not null and text is not null and doc_id < 5000"), model)
    assert judged.where("rejected").count() <= langid.REJECT_RATE * judged.count()
    assert langid.identify(df.where("false")).count() == 0


def test_a_language_of_one_text_is_calibrated_on_the_others():
    model = langid.fit({"aa": {"kalo": 2}, "bb": {"zuvre": 1}})
    langid.calibrate(model, {"aa": [(1.0, 50), (1.2, 50)]})
    assert np.isfinite(model.usual).all()


def test_repeated_vector_ids_are_rows_each(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [2.0, 1.0])]
    got = vectors.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [(20, 1, 3, 1.0), (20, 1, 3, 2.0), (20, 2, 20, 0.0), (20, 2, 20, 0.0)]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    assert vectors.search(empty, F.col("vec_id") % 20 == 0).count() == 0


def test_search_skips_blocks_and_breaks_ties(spark):
    r = random.Random(1)
    texts = [Counter(f"w{min(int(r.expovariate(0.05)), 200)}".encode() for _ in range(60)) for _ in range(1500)]
    for t in texts[:12]:
        t.update({b"rare%d" % k: 2 for k in range(30)})
    shard = bm25.Shard.of(list(range(1500)), texts)
    shard.prepare(60.0)
    words = sorted(set(texts[0]))
    import pyarrow as pa

    asked = bm25.Queries.of(pa.table({"query_id": pa.array([0], pa.int64()), "terms": pa.array([[w.decode() for w in words]]), "weights": pa.array([[8.0 if w.startswith(b"rare") else 0.1 for w in words]])}))
    best, seen = bm25.Best.of(1, 5), {}
    for _ in range(2):  # the second time the k-th best score is known
        best, old = bm25.Best.of(1, 5) if not seen else best, dict(seen)
        bm25.search_shard(shard, asked, best, seen)
    assert seen["scored"] - old["scored"] < seen["all"] / 4
    same = spark.createDataFrame([(i, "a b c", "en", "s", 0) for i in (50, 7, 7, 3, 9)] + [(None, "a b c", "en", "s", 0), (100, None, "en", "s", 0), (150, "z " * 40_000, "en", "s", 0)], DOC)
    got = bm25.search(same, F.col("doc_id") % 50 == 0, 3).orderBy("rank").collect()
    assert [(x.query_id, x.doc_id) for x in got] == [(50, 3), (50, 7), (50, 7)]
    assert bm25.search(same.where("false"), F.col("doc_id") % 50 == 0).count() == 0


def test_search_passes_over_documents_of_other_words(monkeypatch):
    import pyarrow as pa

    r = random.Random(5)
    texts = [Counter(f"{'ab'[i % 2]}{r.randrange(300)}".encode() for _ in range(120)) for i in range(1024)]
    norm = [bm25.K1 * (1 - bm25.B + bm25.B * t.total() / 120.0) for t in texts]

    def searched():
        shard = bm25.Shard.of(list(range(1024)), texts)
        shard.prepare(120.0)
        asked = bm25.Queries.of(pa.table({"query_id": pa.array(range(0, 40), pa.int64()), "terms": [[w.decode() for w in t] for t in texts[:40]], "weights": [[float(n) for n in t.values()] for t in texts[:40]]}))
        best, seen = bm25.Best.of(40, 5), {}
        bm25.search_shard(shard, asked, best, seen)
        again = dict(seen)
        bm25.search_shard(shard, asked, bm25.Best(best.score.copy(), best.doc.copy()), seen)
        return best, (seen["scored"] - again["scored"]) / (seen["all"] - again["all"])

    best, share = searched()
    assert share < 0.6  # words of the one and the other kind come in turn, so an order of arrival has both in every block
    for q in range(40):
        score = [(-round(sum(n * t[w] * (bm25.K1 + 1) / (t[w] + norm[d]) for w, n in texts[q].items() if w in t), 6), d) for d, t in enumerate(texts) if d != q]
        assert [d for _, d in sorted(score)[:5]] == best.doc[q].tolist()
    monkeypatch.setattr(bm25, "_hashes", lambda words: np.zeros(len(words), np.uint64))
    same, _ = searched()
    assert (same.doc == best.doc).all() and (same.score == best.score).all()


def test_hot_cell_work_is_bounded():
    r = np.random.default_rng(3)
    fps = np.unique(r.integers(0, 1 << 62, 3000).astype(np.uint64))
    whole, part = [], []
    simhash._search(fps, fps[:0], 3, whole)
    parts = 10
    for k in range(parts):
        own = fps[k::parts]
        for j in range(parts):
            simhash._search(own, fps[j::parts], 3, part)
    assert sum(part) <= 2.5 * 2 * sum(whole)


def test_a_group_dealt_to_several_tasks_keeps_its_links(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(40):
        words = list(base)
        for _ in range(i % 4):
            words[r.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    few = docs.mapInArrow(jaccard._band_batches, "doc_id bigint, node bigint, size bigint, fp bigint, bands array<bigint>")
    first = few.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.min("fp").alias("fp"), F.first("bands").alias("bands"))
    from quantloom.llm.graph import components

    groups = [sorted(x["count"] for x in components(jaccard.links(first, docs, n)).groupBy("root").count().collect()) for n in (1 << 20, 8000)]
    assert groups[0] == groups[1] and groups[0]


def test_unwanted_payloads_are_not_read():
    class Counting(io.BytesIO):
        total = 0

        def read(self, n=-1):
            self.total += n
            return super().read(n)

    body = b"x" * 100_000
    data = b"".join(b"WARC/1.1\r\nWARC-Type: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (kind, len(body), body) for kind in (b"revisit", b"response", b"revisit"))
    stream = Counting(data)
    found = list(warc.records(stream, lambda h: h["warc-type"] == "response", True))
    assert len(found) == 1 and found[0][1] == body and stream.total == len(body)


def test_one_of_two_writers_commits(spark, tmp_path, monkeypatch):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))
    now, won, lost = store.manifest(), [], []

    def write(k):
        try:
            won.append(shards.ShardStore(spark, f"file://{tmp_path}/s").commit(now, now.schema, [shards.Shard(f"f{k}", 1)]))
        except shards.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and len(lost) == 5 and store.manifest() == won[0]
    with pytest.raises(ValueError, match="differ"):
        store.append(spark.createDataFrame([(1, 2)], "doc_id bigint, text bigint"))
    monkeypatch.setattr(shards, "SAFE_SYSTEMS", ("hdfs",))
    with pytest.raises(ValueError, match="refuses"):
        shards.ShardStore(spark, f"file://{tmp_path}/s")


def test_compacted_contents(spark, tmp_path):
    rows = [(1, "a"), (1, "a"), (None, "b"), (3, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"n_bytes": F.lit(0), "shard": F.lit("x")})
    got = shards.contents(shards.compacted(docs, f"file://{tmp_path}/c")).collect()
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, None if t is None else len(t), digest(t))) for i, t in rows)
    assert shards.contents(shards.compacted(docs.where("false"), f"file://{tmp_path}/e")).count() == 0


def test_tokens_of_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert bpe.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert bpe.round_trips(none, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0
    assert WORD
