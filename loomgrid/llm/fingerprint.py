r"""Document fingerprints by Order MinHash (DataFrame functions only).

A text is cut into tokens (every code point from the first non-space on lies in one; leading space is a token): a word, or the end of a run
without spaces, of up to ``WORD`` code points is one with the space after it; longer runs are cut after each code point of ``CUT`` (some letters and
digits, marks, and all letters of scripts written without spaces), so that an edit changes the tokens near it alone. Runs of three tokens are
the k-mers, numbered by occurrence. Each numbered k-mer gets a hash on a ring of
``2 * half`` equal arcs. Sketch j takes the ``length`` k-mers that follow the start of arc j clockwise: the minimal ones under
the j-th rotation of the order, so one sort serves all sketches. They are put back into text order and their tuple is hashed.
The share of equal sketches falls with edit distance, as order and repetition count, not only the set.

Defined results: null text is empty; a text of fewer than three tokens is a single k-mer; empty texts are all alike;
rows that share a doc_id are ordered by a hash of their text; null ids come first; other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hex_sha256, let, partitions, table

WORD = 12
CUT = r"aeiouAEIOU048/+=_.,;:&?#%\-\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
TOKEN = rf"^\s+|\S{{1,{WORD}}}(?:\s+|\z)|[^\s{CUT}]*+[{CUT}]\s*+|\S+\s*"
SKETCHES = 32
TUPLE = 2
KMER = 3
#: Bits of a packed entry that hold the k-mer's place; the bits above hold its hash.
PLACE = 31


def _kmers(tokens: Column) -> Column:
    """64-bit hashes of the k-mers in text order."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - KMER, F.lit(0)))
    item = lambda i, k: F.get(tokens, i + k)
    return F.transform(starts, lambda i: F.xxhash64(*[item(i, k) for k in range(KMER)]))


def _numbered(h: Column) -> Column:
    """Hashes that differ for each occurrence of the same k-mer."""

    def number(s: Column) -> Column:
        # s: sorted (hash, place); equal hashes are neighbours, so a run's entries are numbered from its first index on
        marks = F.transform(s, lambda x, i: F.when((i > 0) & (F.get(s, i - 1)["h"] == x["h"]), F.lit(None).cast("int")).otherwise(i))
        firsts = F.filter(marks, lambda m: m.isNotNull())

        def occurrence(f: Column) -> Column:
            runs = F.flatten(F.transform(f, lambda a, r: F.sequence(F.lit(0), F.coalesce(F.get(f, r + 1), F.size(s)) - a - 1)))
            return let(runs, lambda n: F.transform(F.sort_array(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), F.when(n[i] == 0, x["h"]).otherwise(F.xxhash64(x["h"], n[i])).alias("h")))), lambda y: y["h"]))

        return let(firsts, occurrence)

    return F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), number))


def sketch(text: Column) -> Column:
    """Array of ``SKETCHES`` 64-bit sketches of a text."""
    arcs = F.sequence(F.lit(-(SKETCHES // 2)), F.lit(SKETCHES // 2 - 1))
    arc = lambda e: F.shiftright(e, 64 - (SKETCHES.bit_length() - 1)).cast("int")

    def pick(kmers: Column) -> Column:
        def choose(s: Column) -> Column:
            # the first TUPLE entries of each arc are all that any rotation can need before it moves to the next arc
            few = F.filter(s, lambda e, i: F.when(i >= TUPLE, arc(F.get(s, i - TUPLE)) != arc(e)).otherwise(True))

            def turn(f: Column) -> Column:
                ring, at = F.concat(f, f), F.transform(f, arc)
                first = lambda a, j: F.aggregate(a, F.lit(0), lambda n, x: F.when(x < j, n + 1).otherwise(n))
                chosen = lambda r, n: F.slice(r, n + 1, F.least(F.lit(TUPLE), F.size(f)))
                place = lambda e: e.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
                by_text = lambda c: F.transform(F.sort_array(F.transform(c, place)), lambda p: F.get(kmers, p))
                digest = lambda c: F.aggregate(c, F.lit(1).cast("long"), lambda a, x: F.xxhash64(a, x))
                return let(F.struct(ring.alias("r"), at.alias("a")), lambda x: F.transform(arcs, lambda j: digest(by_text(chosen(x["r"], first(x["a"], j))))))

            return let(few, turn)

        packed = F.transform(_numbered(kmers), lambda h, i: h.bitwiseAND(F.lit(-1 << PLACE)).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), choose)

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    return let(tokens, lambda t: let(_kmers(t), pick))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal sketches."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / SKETCHES


def shown(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, order: str, text: str, carried: list[str], buckets: int) -> DataFrame:
    """``docs`` with ``next_<c>`` for each carried column from the row that follows in ``order``, equal ids by a hash of ``text`` (the last row's next is the first).

    Rows are dealt by ranges of id and hash; each range also gets the first row of the following range, so no task sees more than its range."""
    key = F.struct(F.col(order).isNotNull().alias("s"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("i"), F.xxhash64(text).alias("h"))
    keyed = docs.select("*", key.alias("_k"))
    listed = lambda keys: F.from_json(F.lit(json.dumps([dict(zip("sih", k, strict=True)) for k in keys])), "array<struct<s: boolean, i: bigint, h: bigint>>")
    some = keyed.select("_k").orderBy(F.xxhash64("_k"), "_k").limit(16 * buckets).collect()  # a sample by hash: cuts move work, not results
    cuts = sorted({tuple(r["_k"]) for r in some})[16::16]
    bounds = listed(cuts)
    coarse = F.filter(bounds, lambda _, i: i % 64 == 63)  # every 64th cut first, then those between
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("_k")))
    dealt = keyed.withColumn("_b", let(below(coarse) * 64, lambda at: at + below(F.slice(bounds, at + 1, F.lit(64)))))
    heads = dict(sorted((r["_b"], tuple(r["k"])) for r in dealt.groupBy("_b").agg(F.min("_k").alias("k")).collect()))  # one row a range
    if not heads:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    # the head of each range is also sent to the range with rows before it; of equal rows, one
    used = list(heads)
    before = F.array(*[F.lit(used[used.index(b) - 1] if b in heads else None).cast("int") for b in range(used[-1] + 1)])
    first = listed([heads.get(b, heads[used[0]]) for b in range(used[-1] + 1)])
    sent = dealt.where(F.col("_k") == F.get(first, F.col("_b"))).dropDuplicates(["_k"])
    sent = sent.withColumn("_g", F.when(F.col("_b") == used[0], 2).otherwise(1)).withColumn("_b", F.get(before, F.col("_b")))
    rows = dealt.withColumn("_g", F.lit(0)).unionByName(sent)
    w = Window.partitionBy("_b").orderBy("_g", "_k", *[c for c in carried if c != order])
    return rows.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).where("_g = 0").drop("_b", "_k", "_g")


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, sketch) of each row."""
    return docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), sketch(F.col(text)).alias("sketch"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    near = with_next(fingerprints(docs), "doc_id", "text", ["text", "sketch"], partitions(spark))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    both = near.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    more = both.select("doc_id", "n_chars", "sketch", "next_sketch", hex_sha256(F.col("edited")).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return more.select("doc_id", "n_chars", "edited_sha256", shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"),
                       likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


QUERIES = {"op6_order_minhash": op6_order_minhash}
ORACLES = {}
