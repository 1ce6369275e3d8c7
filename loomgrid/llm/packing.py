"""Mixture-controlled packing: deficit round-robin over source queues.

Documents queue by source, whole where they have at most ``QUANTUM`` tokens, longer ones as runs of ``QUANTUM`` tokens. The queue
that is furthest behind its share (largest deficit) is served next: a unit that starts at place b of a queue of weight w is due at b / w, and
units are put in a row by due time. So after any window every queue is within one unit of its target share, deficits carry across
windows and partitions, and the row is cut into windows (sequences) of ``width`` tokens, which are all full but the last.
Due times follow from the tokens of each queue before a partition, so tasks cut their own part of the row without seeing
another's: the row is dealt into spans of due time, whose token counts give each span's place.

Weights: ``targets`` names them by source; sources without one share what is left after the last named queue ends. Else a
queue weighs its tokens to the ``power``: 1 keeps the corpus's own shares, so that all queues end together, less raises small sources. A queue that
ends leaves its part to the others in proportion. Queues are as many as there are sources.

Defined results: null text is empty (a document of the end id alone); null source is a queue; rows that share a doc_id are
documents of their own; a null doc_id stays null; an empty table gives no pieces; negative and zero targets count as none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, table, tidy, written
from .tokens import tokens

WIDTH, QUANTUM = 4096, 2048
_TOKEN_SCHEMA = "doc_id long, queue string, part int, begin long, start long, n long, doc_tokens long, ids binary"
_PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, path: str, end_id: int = 2, quantum: int = QUANTUM) -> DataFrame:
    """One row a unit: its queue, its partition, its place in that partition's share of the queue, its start in the document, and its ids."""
    queue = F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("n:"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, begun = tokens(path), TaskContext.get().partitionId(), {}
        kind = "<u4" if tok.whole.get_vocab_size() > 1 << 16 else "<u2"
        for batch in batches:
            ids_of, size, at = batch.column("doc_id").to_pylist(), batch.num_rows, 0
            texts, queues = batch.column("text"), batch.column("queue").to_pylist()
            while at < size:
                some, chars, first = [], 0, at
                while at < size and chars < 2_000_000 and len(some) < 1024:
                    some.append(texts[at].as_py() or "")
                    chars += len(some[-1])
                    at += 1
                out: list[list] = [[] for _ in range(8)]
                for i, q, x in zip(ids_of[first:at], queues[first:at], tok.encode(some), strict=True):
                    x = np.append(x, np.uint32(end_id))
                    for start in range(0, len(x), quantum):
                        run_ = x[start : start + quantum]
                        for col, v in zip(out, (i, q, part, begun.get(q, 0), start, len(run_), len(x), run_.astype(kind).tobytes()), strict=True):
                            col.append(v)
                        begun[q] = begun.get(q, 0) + len(run_)
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in _TOKEN_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", queue.alias("queue")).mapInArrow(tidy(run), _TOKEN_SCHEMA)


def shares(totals: DataFrame, targets: dict[str | None, float] | None, power: float) -> DataFrame:
    """(queue, weight, after): a unit at place b of the queue is due at after + b / weight."""
    n = F.col("tokens").cast("double")
    if targets is None:
        return totals.select("queue", (n if power == 1 else F.pow(n, F.lit(power))).alias("weight"), F.lit(0.0).alias("after"))
    spark = totals.sparkSession
    named = spark.createDataFrame([("n:" if q is None else f"s:{q}", float(w)) for q, w in targets.items() if w > 0], "queue string, target double")
    both = totals.join(named, "queue", "left")
    last = both.where("target IS NOT NULL").agg(F.max(n / F.col("target"))).first()[0] or 0.0
    return both.select("queue", F.coalesce("target", n).alias("weight"), F.when(F.col("target").isNull(), last).otherwise(0.0).alias("after"))


def _cuts(due: DataFrame, most: int) -> list[float]:
    """At most ``most`` due times that split the units into spans of about as many; they move work, not results."""
    found = due.agg(F.percentile_approx("due", [i / most for i in range(1, most)], 20 * most)).first()[0] if most > 1 else None
    return sorted(set(found or []))


def pack(docs: DataFrame, path: str | None = None, targets: dict[str | None, float] | None = None, width: int = WIDTH, end_id: int = 2, power: float = 1.0, quantum: int = QUANTUM) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text, source): see the module's text."""
    spark = docs.sparkSession
    rows = written(spark, tokenize(docs, path or public_tokenizer(), end_id, quantum), "tokens")
    parts = written(spark, rows.groupBy("queue", "part").agg(F.sum("n").alias("n")), "token-counts")
    of = shares(parts.groupBy("queue").agg(F.sum("n").alias("tokens")), targets, power)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(spark, parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(of, "queue"), "token-bases")
    place: Column = F.col("base") + F.col("begin")
    placed = rows.join(bases, ["queue", "part"]).withColumn("due", F.col("after") + place / F.col("weight")).withColumn("place", place).drop("begin", "base", "weight", "after", "part")
    n = partitions(spark)
    cuts = np.array(_cuts(placed.select("due"), 4 * n))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("span", pa.array(np.searchsorted(cuts, batch.column("due").to_numpy(), side="right").astype(np.int32)))

    narrow = placed.select("due", "n")
    sums = narrow.mapInArrow(tidy(deal), "due double, n long, span int").groupBy("span").agg(F.sum("n").alias("n"))
    starts, at = {}, 0
    for span, size in sorted(map(tuple, sums.collect())):  # 4 x partitions rows at most
        starts[span], at = at, at + size
    wide = placed.mapInArrow(tidy(deal), placed.schema.simpleString()[7:-1].replace(":", " ") + ", span int")
    row = wide.repartition(n, "span").sortWithinPartitions("span", "due", "queue", "place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, at = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            spans, size = batch.column("span").to_numpy(), batch.column("n").to_numpy()
            total = np.r_[0, np.cumsum(size)]
            fresh = np.flatnonzero(np.r_[spans[0] != span, spans[1:] != spans[:-1]])
            base = np.full(len(size), at, dtype=np.int64)
            for i in fresh.tolist():
                base[i:] = starts[int(spans[i])] - total[i]
            begin = base + total[:-1]
            span, at = spans[-1], int(begin[-1] + size[-1])
            first, last = begin // width, (begin + size - 1) // width
            count = last - first + 1
            unit = np.repeat(np.arange(len(size)), count)
            window = first[unit] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            lo, hi = np.maximum(begin[unit], window * width), np.minimum((begin + size)[unit], (window + 1) * width)
            ids, sums = batch.column("ids"), np.empty(len(unit), dtype=np.int64)
            raw, held = b"", -1
            for k, (u, a, z) in enumerate(zip(unit.tolist(), (4 * (lo - begin[unit])).tolist(), (4 * (hi - begin[unit])).tolist(), strict=True)):
                if u != held:
                    blob, held = ids[u].as_buffer(), u
                    raw = np.frombuffer(blob, dtype="<u4" if len(blob) == 4 * size[u] else "<u2").astype("<u4").tobytes()
                sums[k] = zlib.crc32(raw[a:z])
            start = batch.column("start").to_numpy()[unit] + lo - begin[unit]
            fixed = (start, hi - lo, sums, batch.column("doc_tokens").to_numpy()[unit], window, lo - window * width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(unit)), *[pa.array(x.astype(np.int64)) for x in fixed]], names=[c.split()[0] for c in _PIECE_SCHEMA.split(", ")])

    return row.select("doc_id", "start", "n", "doc_tokens", "ids", "span").mapInArrow(tidy(cut), _PIECE_SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, small sources raised: a source weighs its tokens to the power 0.7."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), power=0.7)


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
