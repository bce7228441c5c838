"""What the operators once left out: each test fails on the cut that it names."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from quantloom.llm import base, langid

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def near_texts():
    """Chains of texts whose neighbours differ in a few words, short and empty texts, exact copies."""
    out = []
    for g in range(8):
        w = [f"g{g}w{i}" for i in range(120 + 30 * g)]
        for j in range(12):
            w[(j * 37 + g) % len(w)] = f"n{g}x{j}"
            out.append((g * 100 + j, " ".join(w)))
    return out + [(5000, "one two"), (5001, "One  two"), (5002, ""), (5003, None), (5004, out[0][1])]


def brute_first(rows):
    """Ids that stay: union-find over all pairs of a five-word Jaccard similarity of 0.8 or more."""
    sets, root = {}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in root if find(i) == i}


def test_pipeline_near_dedup_reaches_0_8(spark):
    rows = near_texts()
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC), SF)
    assert {r.doc_id for r in got.collect()} == brute_first(rows)
    table = base.table(spark, SF, "documents")
    real = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, table, SF).collect()} == brute_first(real)
    assert corpus_pipeline.near_dedup(spark, table.where(F.lit(False)), SF).count() == 0


def test_langid_learns_every_label(spark, monkeypatch):
    """A long text, first in hash order or not, takes no other text of its label from the sample."""
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 8000)
    rows = [(i, f"{'la le li lo ' * 30}", "aa") for i in range(40)] + [(i, "zu zo zi za " * 30, "bb") for i in range(101, 104)]
    rows += [(i, "ky ke ko ka " * 5000, "cc") for i in range(200, 204)] + [(300, "mum mim " * 9000, "dd")]
    model = langid.train(spark.createDataFrame(rows + [(i, "la le li lo " * 5000, "aa") for i in range(40, 60)], "doc_id bigint, text string, lang string"))
    assert list(model.languages) == ["aa", "bb", "cc", "dd"]
    assert all(e < float("inf") for e in list(model.usual)[:3])
