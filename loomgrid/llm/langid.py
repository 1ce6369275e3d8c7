"""Language identification by error-correcting output codes.

Every language gets a codeword. For each bit, a linear classifier over hashed character n-grams (1 to 3 code points, with word
edges) is fitted by logistic regression to predict that bit. A text's bit margins are decoded with the logistic loss, weighted
by each bit's training accuracy, and the codeword with the least loss wins; ``ambiguous`` marks a small lead over the next.

Fitting uses at most ``per_language`` labelled texts of each language (the least by hash of id and text), whole; prediction runs
in Arrow batches over whole texts and keeps nothing between rows.

Defined results: null text and text without a letter give ``und`` with score 0; rows with null lang aren't learned from; with
one learned language it is always the answer; with none everything is ``und``; repeated rows are predicted alike.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, table, tidy, trim

UNKNOWN = "und"
BUCKETS = 1 << 13
#: Languages that are told apart at most: their code, weights and counts are sent to every task.
LANGUAGES = 2000
ORDERS = (1, 2, 3)
#: Texts are counted in slices of this many code points (overlapping by the longest n-gram), to bound memory.
SLICE = 1 << 18
_ODD = np.uint32(0x9E3779B1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a text, with everything that isn't a letter taken as a word edge."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(len(text), 1), SLICE):
        c = _codes(text[at : at + SLICE + max(ORDERS) - 1])
        c = np.where((c < 0x41) | ((c > 0x5A) & (c < 0x61)) | ((c > 0x7A) & (c < 0xAA)) | ((c >= 0x2000) & (c < 0x2070)), np.uint32(0x20), c)
        h, grams = np.zeros(len(c), dtype=np.uint32), []
        for n in ORDERS:
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] ^ c[n - 1 :] ^ np.uint32(n << 24)) * _ODD
            grams.append((h ^ (h >> np.uint32(15))) >> np.uint32(3) & np.uint32(BUCKETS - 1))
        if grams:
            total += np.bincount(np.concatenate(grams), minlength=BUCKETS)
    return total


def features(text: str) -> np.ndarray:
    x = np.sqrt(counts(text))
    norm = np.linalg.norm(x)
    return (x / norm if norm else x).astype(np.float32)


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1, pairwise far apart: every split for up to five languages, else random columns with the best least distance."""
    if n <= 5:
        rows = [[1 if i == 0 else (1 if bits >> (i - 1) & 1 else -1) for bits in range(2 ** (n - 1) - 1)] for i in range(n)]
        return np.array(rows, dtype=np.int8).reshape(n, -1)
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, int(np.ceil(10 * np.log2(n)))))
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2)) if n <= 300 else 0
        if apart > far:
            best, far = code, apart
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = features(text) @ self.weights + self.bias
        loss = np.log1p(np.exp(-np.clip(self.code * margins, -30, 30))) @ self.trust
        p = np.exp(-(loss - loss.min()))
        p /= p.sum()
        best = int(np.argmin(loss))
        return self.languages[best], float(min(1.0, p[best])), bool(p[best] < 0.6)


def fit(x: np.ndarray, langs: list[str], steps: int = 150) -> Model:
    """Model of rows of ``features`` and their languages."""
    languages = sorted(set(langs))
    code = codewords(len(languages)) if len(languages) > 1 else np.zeros((len(languages), 0), dtype=np.int8)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    row = np.array([languages.index(lang) for lang in langs])
    y = code[row].astype(np.float32)
    each = 1.0 / np.bincount(row, minlength=len(languages))[row]  # languages weigh alike
    each = (each / each.sum()).astype(np.float32)[:, None]
    w, b = np.zeros((BUCKETS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = each * y / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        speed_w = 0.9 * speed_w + (x.T @ pull - 1e-6 * w)
        speed_b = 0.9 * speed_b + pull.sum(0)
        w += 8.0 * speed_w
        b += 2.0 * speed_b
    right = (each * ((x @ w + b) * y > 0)).sum(0)
    return Model(languages, code, w, b, np.maximum(right - 0.5, 0.01) * 2)


def sampled(labelled: DataFrame, quota: int) -> DataFrame:
    """Of the rows (_lang, _at, ...) of each language, those whose hash ``_at`` (32 bits) is least: about twice ``quota`` of them, one for each hash, or
    all. Rows are counted by language before a shuffle, and only those that stay are shuffled."""
    share = (2.0 * quota + 200) / F.col("n")
    last = labelled.groupBy("_lang").agg(F.count("*").alias("n")).select("_lang", (share * (1 << 32)).alias("_last"))
    return labelled.join(F.broadcast(last), "_lang").where(F.col("_at") <= F.col("_last")).drop("_last").dropDuplicates(["_lang", "_at"])


def fit_on(docs: DataFrame, per_language: int = 600, most: int = 6000, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model of the labelled rows of ``docs``: at most ``per_language`` of each language (the least by hash of id and text) and ``most`` in
    all (or one of each language), of which only the n-gram weights reach the driver. Refuses tables with more than ``LANGUAGES`` languages."""
    at = F.crc32(F.concat_ws(" ", F.col(id).cast("string"), F.crc32(F.col(text).cast("binary")).cast("string")))
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("_lang"), at.alias("_at"), F.col(text).alias("_text"))
    languages = labelled.agg(F.countDistinct("_lang")).first()[0]
    if languages > LANGUAGES:
        raise ValueError(f"{languages} languages, of {LANGUAGES} at most")
    if not languages:
        return fit(np.zeros((0, BUCKETS), np.float32), [])
    quota = max(1, min(per_language, most // languages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for g, a, text in zip(batch.column("_lang").to_pylist(), batch.column("_at").to_pylist(), batch.column("_text"), strict=True):
                t = text.as_py()
                if any(map(str.isalpha, t)):
                    x = features(t)
                    at = np.flatnonzero(x)
                    found.append((g, a, at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["_lang", "_at", "grams", "x"])

    few = sampled(labelled, quota).select("_lang", "_at", "_text").mapInArrow(tidy(run), "_lang string, _at long, grams binary, x binary")
    nth = F.row_number().over(Window.partitionBy("_lang").orderBy("_at"))  # of about twice the quota
    with batches(docs.sparkSession):
        rows = few.withColumn("_n", nth).where(F.col("_n") <= quota).orderBy("_lang", "_at").collect()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.grams, "<u2")] = np.frombuffer(r.x, "<f4")
    model = fit(x, [r["_lang"] for r in rows])
    del x, rows
    trim()
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred, score and ambiguous; columns of those names are replaced."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    kept = [c for c in docs.columns if keep is None or c in keep]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema if f.name in kept)}, lang_pred string, score double, ambiguous boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(text)]
            extra = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *extra], names=[*kept, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(tidy(run), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit_on(docs.where(~held))
    return identify(docs.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


QUERIES = {"op4_language_id": op4_language_id}
ORACLES: dict[str, str] = {}
