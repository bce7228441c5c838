"""Language identification by interpolated Kneser-Ney character models.

One model per language over the characters of letter runs, lower-cased, with word boundaries; contexts don't cross
words. The tables of all languages are one set of sorted 64-bit hash arrays, one for each order, with a column for
each language; a gram is found by binary search. The language of the lowest cross-entropy per character wins. A text
whose lowest cross-entropy lies too far above what held-back training texts of that language show is rejected.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from quantloom.llm.base import forget, prepare

ORDER = 4
#: Bounds of the training sample: documents of one language, and characters of all languages together.
SAMPLE_DOCS = 600
SAMPLE_CHARS = 16_000_000
#: Groups by hash that the sample's smallest hashes are first taken from, so that no task gets a whole language.
SAMPLE_GROUPS = 64
#: The most of a language's own texts that may be rejected. Whatever the distribution, no more than this share lies
#: sqrt(1 / rate - 1) spreads above the mean (Cantelli's bound), and rejected texts lie above REJECT_FACTOR as well.
REJECT_RATE = 1 / 65
REJECT_SPREADS = math.sqrt(1 / REJECT_RATE - 1)
REJECT_FACTOR = 2.0
UNDETERMINED = "und"
#: Units (words with what clings to them) whose scores a task keeps; the table is emptied when full.
KEPT_UNITS = 200_000
#: Letter runs that are scored at once.
_RUNS = 10_000

_ASCII_RUN = re.compile(r"[A-Za-z]+")
#: Letters and the marks on them; numbers that Python calls alphanumeric, such as fractions, are none.
_RUN = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_START, _END = 1, 2
_PRIME = np.uint64(0x100000001B3)


def letter_runs(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return (_ASCII_RUN if text.isascii() else _RUN).findall(text.lower())


def _hashes(chars: np.ndarray, order: int) -> list[np.ndarray]:
    """For each position the hashes of the 1- to ``order``-grams that end there."""
    out, n = [], len(chars)
    for k in range(1, order + 1):
        h = np.full(n, 0xCBF29CE484222325 + k, np.uint64)
        for back in range(k - 1, -1, -1):
            c = np.zeros(n, np.uint64)
            c[back:] = chars[: n - back] if back else chars
            h = (h ^ c) * _PRIME
            h ^= h >> np.uint64(29)
        out.append(h)
    return out


def _padded(runs: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters with boundaries, run number, whether predicted) of lower-cased letter runs, one after the other."""
    pad = chr(_START) * (order - 1)
    text = "".join([f"{pad}{r}{chr(_END)}" for r in runs])
    chars = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    length = np.fromiter((len(r) + order for r in runs), np.int64, len(runs))
    return chars, np.repeat(np.arange(len(runs)), length), chars != _START


@dataclass
class Model:
    """For each order: sorted gram hashes; per gram and language its discounted share, and the mass that it, as a
    context, leaves to the next lower order. The last row stands for grams that are not stored."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    share: list[np.ndarray]
    left: list[np.ndarray]
    floor: float
    usual: np.ndarray
    spread: np.ndarray

    def log_probs(self, chars: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each character after those before it, for each language."""
        hashes = _hashes(chars, self.order)
        rows = []
        for known, h in zip(self.grams, hashes, strict=True):
            i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            rows.append(np.where(known[i] == h, i, len(known)) if len(known) else np.zeros(len(h), np.int64))
        p = np.full((len(chars), len(self.languages)), self.floor)
        for k in range(self.order):
            if k:
                context = np.r_[len(self.grams[k - 1]), rows[k - 1][:-1]]
                p *= self.left[k - 1][context]
            else:
                p *= self.left[-1][0]
            p += self.share[k][rows[k]]
        return np.log(p)

    def runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities per run and language, predicted characters per run)."""
        chars, who, predicted = _padded(runs, self.order)
        logs = self.log_probs(chars)[predicted]
        who = who[predicted]
        total = np.stack([np.bincount(who, logs[:, i], len(runs)) for i in range(len(self.languages))], axis=1)
        return total, np.bincount(who, minlength=len(runs))


def _weights(counts: np.ndarray) -> float:
    """Kneser-Ney's absolute discount from the numbers of grams seen once and twice."""
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.75


def fit(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """A model from the counts of lower-cased letter runs of each language. No language at all is an error."""
    languages = sorted(counts, key=lambda x: x.encode())
    if not languages:
        raise ValueError("no labelled training texts")
    tables: list[dict[str, tuple]] = [{} for _ in range(order)]
    letters: set[int] = set()
    for lang in languages:
        runs = list(counts[lang])
        chars, who, predicted = _padded(runs, order)
        weight = np.fromiter(counts[lang].values(), np.float64, len(runs))[who] if runs else np.empty(0)
        hashes = _hashes(chars, order)
        letters.update(np.unique(chars).tolist())
        above = None
        for k in range(order, 0, -1):
            h = hashes[k - 1]
            gram, at, inverse = np.unique(h[predicted], return_index=True, return_inverse=True)
            place = np.flatnonzero(predicted)[at]
            c = np.bincount(inverse, weight[predicted], len(gram))
            if k < order:
                # Lower orders count the different characters before a gram, except at a word's start, where there are none.
                wider = np.bincount(np.searchsorted(gram, h[above]), minlength=len(gram)).astype(float)
                begins = np.zeros(len(gram), bool) if k == 1 else chars[place - k + 1] == _START
                c = np.where(begins, c, wider)
            above = place
            context = hashes[k - 2][place - 1] if k > 1 else np.zeros(len(place), np.uint64)
            known, of = np.unique(context, return_inverse=True)
            total = np.bincount(of, c, len(known))
            d = _weights(c)
            share = np.maximum(c - d, 0) / total[of] if len(gram) else c
            mass = np.bincount(of, np.minimum(c, d), len(known)) / total if len(gram) else total
            tables[k - 1][lang] = (gram, share, known, mass)
    grams, shares, lefts = [], [], []
    top = np.ones((1, len(languages)))
    for k in range(order):
        contexts = [tables[k + 1][x][2] for x in languages] if k + 1 < order else []
        known = np.unique(np.concatenate([tables[k][x][0] for x in languages] + contexts))
        share = np.zeros((len(known) + 1, len(languages)))
        left = np.ones((len(known) + 1, len(languages)))
        for i, lang in enumerate(languages):
            gram, p, _, _ = tables[k][lang]
            share[np.searchsorted(known, gram), i] = p
            if contexts:
                left[np.searchsorted(known, tables[k + 1][lang][2]), i] = tables[k + 1][lang][3]
        grams.append(known)
        shares.append(share)
        lefts.append(left)
    for i, lang in enumerate(languages):
        mass = tables[0][lang][3]
        top[0, i] = mass[0] if len(mass) else 1.0
    lefts[-1] = top
    letters.discard(_START)  # it is never predicted; what is, are the letters, the end, and one unseen character
    none = np.zeros(len(languages))
    return Model(languages, order, grams, shares, lefts, 1.0 / (len(letters) + 1), none, none)


def calibrate(model: Model, scores: dict[str, list[tuple[float, int]]]) -> Model:
    """The usual cross-entropy of each language and its spread over texts, from held-back texts (cross-entropy, characters).

    A language without such texts has those of all languages together; without any at all nothing is rejected."""
    usual, spread = [], []
    every = [x for found in scores.values() for x in found]
    for lang in model.languages:
        found = np.array(scores.get(lang) or every or [(np.inf, 1)])
        mean = float(np.average(found[:, 0], weights=found[:, 1]))
        usual.append(mean)
        spread.append(max(0.5, float(np.sqrt(np.mean((found[:, 0] - mean) ** 2 * found[:, 1])))) if np.isfinite(mean) else 1.0)
    model.usual, model.spread = np.array(usual), np.array(spread)
    return model


class Scorer:
    """Scores of whole texts, unit by unit (what stands between white space), with a bounded memory of units."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.total = np.zeros((1024, len(self.model.languages)))
        self.chars = np.zeros(1024, np.int64)

    def _learn(self, units: list[str]) -> None:
        runs, who = [], []
        for i, unit in enumerate(units):
            for run in letter_runs(unit):
                runs.append(run)
                who.append(i)
        total, chars = np.zeros((len(units), len(self.model.languages))), np.zeros(len(units), np.int64)
        for at in range(0, len(runs), _RUNS):
            t, c = self.model.runs(runs[at : at + _RUNS])
            np.add.at(total, who[at : at + _RUNS], t)
            np.add.at(chars, who[at : at + _RUNS], c)
        start = len(self.at)
        self.at.update(zip(units, range(start, start + len(units)), strict=True))
        while len(self.chars) < len(self.at):
            self.total = np.concatenate([self.total, np.zeros_like(self.total)])
            self.chars = np.concatenate([self.chars, np.zeros_like(self.chars)])
        self.total[start : len(self.at)] = total
        self.chars[start : len(self.at)] = chars

    def score(self, text: str) -> tuple[np.ndarray, int]:
        """(sum of log probabilities of each language, predicted characters) of one text."""
        units = text.split()
        new = list(dict.fromkeys(u for u in units if u not in self.at))
        if new:
            if len(self.at) + len(new) > KEPT_UNITS:
                self._clear()
                new = list(dict.fromkeys(units))
            self._learn(new)
        at = np.fromiter(map(self.at.__getitem__, units), np.int64, len(units))
        return self.total[at].sum(axis=0), int(self.chars[at].sum())

    def judge(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """(language, confidence, cross-entropy, rejected) of one text."""
        total, n = self.score(text) if text else (None, 0)
        if not n:
            return UNDETERMINED, 0.0, None, True
        entropy = -total / n
        i = int(np.argmin(entropy))
        e = float(entropy[i])
        confidence = float(1 / np.exp(np.clip(e - entropy, -700, 0)).sum())
        far = (e - self.model.usual[i]) * np.sqrt(n) / self.model.spread[i] if np.isfinite(self.model.usual[i]) else 0.0
        rejected = bool(far > REJECT_SPREADS and e > REJECT_FACTOR * self.model.usual[i])
        return self.model.languages[i], confidence, e, rejected


def held_out(id_col) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _count_batches(batches):
    """(lang, half, run, n) of each batch; a document is in the half that fits or in the half that calibrates."""
    for batch in batches:
        seen: dict[tuple, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run in letter_runs(text):
                seen[lang, run] = seen.get((lang, run), 0) + 1
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([k[0] for k in seen], pa.string()),
            "run": pa.array([k[1] for k in seen], pa.string()),
            "n": pa.array(list(seen.values()), pa.int64()),
        })


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> Model:
    """A calibrated model from a bounded sample of the labelled documents that are not held out.

    The sample has, for each language, the documents with the smallest hash of their id: at most SAMPLE_DOCS, and in
    all at most SAMPLE_CHARS characters shared equally by the languages. A text gives its start, up to a quarter of its
    language's share and to what is left of it. Three quarters fit the model and one quarter calibrates the rejection;
    of two or three texts the last calibrates, and a single text fits, so that its language is calibrated on the others'.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.length(text_col).alias("n"), F.xxhash64(F.col(id_col).cast("string")).alias("h"))
    may = rows.where(F.col("lang").isNotNull() & (F.coalesce("n", F.lit(0)) > 0) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    by = W.Window.partitionBy("lang").orderBy("h", "n", "id")
    group = W.Window.partitionBy("lang", F.pmod("h", F.lit(SAMPLE_GROUPS))).orderBy("h", "n", "id")
    may = may.withColumn("r", F.row_number().over(group)).where(F.col("r") <= SAMPLE_DOCS).drop("r")
    first = may.withColumn("r", F.row_number().over(by)).where(F.col("r") <= SAMPLE_DOCS).checkpoint()
    share = SAMPLE_CHARS // max(1, first.select("lang").distinct().count())
    taken = first.withColumn("take", F.least(F.col("n"), F.lit(max(1, share // 4)))).withColumn("most", F.max("r").over(W.Window.partitionBy("lang")))
    before = F.coalesce(F.sum("take").over(by.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    used = taken.withColumn("take", F.least(F.col("take"), F.lit(max(4, share)) - before)).where("take > 0")
    calibrates = (F.col("r") % 4 == 0) | (F.col("most").between(2, 3) & (F.col("r") == F.col("most")))
    picked = used.select(F.col("id").alias("pid"), F.col("lang").alias("plang"), "take", calibrates.alias("calibrates")).groupBy("pid", "plang", "calibrates").agg(F.max("take").cast("int").alias("take"))
    texts = docs.join(F.broadcast(picked), (F.col(id_col) == F.col("pid")) & (F.col(lang_col).cast("string") == F.col("plang")))  # at most SAMPLE_DOCS a language
    texts = texts.select(F.col("plang").alias("lang"), F.substring(F.col(text_col), F.lit(1), F.col("take")).alias("text"), "calibrates").where("text is not null").checkpoint()
    counted = texts.where(~F.col("calibrates")).select("lang", "text").mapInArrow(_count_batches, "lang string, run string, n bigint")
    counts: dict[str, dict[str, int]] = {}
    for lang, run, n in counted.groupBy("lang", "run").agg(F.sum("n")).toLocalIterator():  # at most SAMPLE_CHARS rows
        counts.setdefault(lang, {})[run] = n
    if not counts:
        raise ValueError("no labelled training texts")
    model = fit(counts, order)
    shared = spark.sparkContext.broadcast(model)

    def own(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            out = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang in shared.value.languages:
                    total, n = scorer.score(text)
                    if n:
                        out.append((lang, float(-total[shared.value.languages.index(lang)] / n), n))
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in out], pa.string()), "e": pa.array([x[1] for x in out], pa.float64()), "n": pa.array([x[2] for x in out], pa.int64())})

    scores: dict[str, list] = {}
    for lang, e, n in texts.where("calibrates").select("lang", "text").mapInArrow(own, "lang string, e double, n bigint").toLocalIterator():
        scores.setdefault(lang, []).append((e, n))
    return calibrate(model, scores)


def _judged(batches, model: Model, at: int):
    forget()
    scorer = Scorer(model)
    for batch in batches:
        found = [scorer.judge(t) for t in batch.column(at).to_pylist()]
        yield batch, [
            pa.array([x[0] for x in found], pa.string()),
            pa.array([x[1] for x in found], pa.float64()),
            pa.array([x[2] for x in found], pa.float64()),
            pa.array([x[3] for x in found], pa.bool_()),
        ]


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, rejected) for each row; only the text is looked at to predict.

    A null text, or one without letters, is ``und`` with score 0 and rejected. Equal cross-entropies go to the language
    first by code point. Whole texts are scored in one pass without a shuffle. No model: every text is ``und``.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*[f for f in rows.schema if f.name != "text"], *map(lambda x: T.StructField(*x), (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType())))])
    if model is None:
        und = (F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
        return rows.select("doc_id", "held_out", *und)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch, found in _judged(batches, shared.value, 2):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on ``docs`` and predict all of it. Without one labelled text that may be learned from, all is ``und``."""
    try:
        model = train(docs, id_col, text_col, lang_col)
    except ValueError:
        model = None
    return predict(docs, model, id_col, text_col)


def accepted(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rejected rows, all columns and other values as they are. Without a model only texts that
    are null or have no letter go."""
    try:
        model = train(docs, id_col, text_col, lang_col)
    except ValueError:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, found in _judged(batches, shared.value, at):
            yield batch.filter(pa.compute.invert(found[3]))

    return docs.mapInArrow(run, docs.schema)
