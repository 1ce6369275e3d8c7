r"""Merkle fixity audit of WARC archives.

Records are rendered as WARC/1.1 and laid out in files; a manifest gives each record's file, place, offset, length and SHA-256. Per replica
a tree is built over ordered offset ranges: a node hashes its children's places, ranges and digests, ``FAN`` neighbours at a time, first inside
each file, then over the files. Levels are written once, the two lowest in folders by branch (a node two steps below the root). Replicas are compared
from the root down: of those two only the folders of branches that differ are read, and only children of nodes that differ are compared.

Files hold the pages of ``PER_FILE`` consecutive ids; a file of more than ``VOLUME`` records (repeated ids) is split into volumes by digest, and
null ids are dealt over ``LOOSE`` files by digest, so no task sees more than one volume's manifest.

Defined results: null url or html is empty; repeated ids are ordered by digest; a range missing from the replica is ``missing``, one that
only the replica has is ``extra``, other bytes in a place are ``corrupt``, the same bytes at another range are ``moved``; two empty
archives differ in nothing; of manifest rows that share a place (file, volume, seq) the least digest counts; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, partitions, sized, table, written

FAN = 16
PER_FILE, VOLUME, LOOSE = 1024, 4096, 1 << 16
_PLACE = ["file_id", "volume", "seq"]


def record(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC resource record as text (its bytes are the UTF-8 form)."""
    text = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"))


def manifest(records: DataFrame) -> DataFrame:
    """(file_id, volume, seq, offset, length, digest, page_id) of records (page_id, record); further columns pass through."""
    spark, rest = records.sparkSession, [c for c in records.columns if c not in ("page_id", "record")]
    narrow = records.select("page_id", F.octet_length("record").cast("long").alias("length"), F.sha2(F.encode("record", "UTF-8"), 256).alias("digest"), *rest)
    loose = F.lit(1 << 54) + F.pmod(F.xxhash64("digest"), F.lit(LOOSE))  # above every id's file
    rows = written(spark, narrow.withColumn("file_id", F.coalesce(F.shiftright("page_id", PER_FILE.bit_length() - 1), loose)), "records")
    large = rows.groupBy("file_id").count().where(F.col("count") > VOLUME).select("file_id", F.ceil(F.col("count") / VOLUME).alias("_volumes"))
    rows = rows.join(large, "file_id", "left").withColumn("volume", F.when(F.col("_volumes").isNull(), 0).otherwise(F.pmod(F.xxhash64("digest", "page_id"), F.col("_volumes"))).cast("long"))
    w = Window.partitionBy("file_id", "volume").orderBy("page_id", "digest")
    rows = rows.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("offset", F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    return rows.select(*_PLACE, "offset", "length", "digest", "page_id", *rest)


def _levels(n: int) -> int:
    k = 0
    while FAN**k < n:
        k += 1
    return k


def tree(leaves: DataFrame, depth: tuple[int, int], name: str) -> list[DataFrame]:
    """Written levels from leaves (number, seq, lo, hi, digest) to the root; ``depth``: how many inside a file and over files. Over
    files, ``number`` is the group of files and seq is 0. ``branch`` is the node two levels below the root that a node lies under."""
    spark, out = leaves.sparkSession, []
    for level in range(sum(depth) + 1):
        if level:
            inside = level <= depth[0]
            up = [F.col("number"), F.shiftright("seq", 4).alias("seq")] if inside else [F.shiftright("number", 4).alias("number"), F.col("seq")]
            kids = F.sort_array(F.collect_list(F.struct(F.col("seq" if inside else "number").alias("k"), "lo", "hi", "digest")))  # FAN at most
            text = F.array_join(F.transform(kids, lambda x: F.concat_ws(":", x["k"], x["lo"], x["hi"], x["digest"])), ",")
            leaves = out[-1].groupBy(*up).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))
        above = 4 * max(depth[1] - 2 - max(level - depth[0], 0), 0)
        leaves = leaves.select("number", "seq", "lo", "hi", "digest", F.shiftright("number", above).alias("branch"))
        out.append(written(spark, leaves, f"{name}-{level}", by="branch" if level < 2 else None))  # the levels above are small
    return out


def audit(primary: DataFrame, replica: DataFrame, read: list | None = None) -> DataFrame:
    """(file_id, volume, seq, status) of the records that differ; manifests give (file_id, volume, seq, offset, length, digest). What
    is read of levels is added to ``read``."""
    spark = primary.sparkSession
    sides = [m.groupBy(*_PLACE).agg(F.min_by(F.struct("offset", "length", "digest"), "digest").alias("r")).select(*_PLACE, "r.*") for m in (primary, replica)]
    # files are numbered in order over both replicas: a few numbers a file
    files = sides[0].select("file_id", "volume").unionByName(sides[1].select("file_id", "volume")).distinct()
    order = ["file_id", "volume"]
    ranged = written(spark, files.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "files")
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, ranged.groupBy(part.alias("p")).count().collect()))  # one row a partition
    n, base = 0, {}
    for p, size in sizes:
        base[p], n = n, n + size
    if not n:
        return files.select(*order, F.lit(0).cast("long").alias("seq"), F.lit("").alias("status")).where("false")
    offsets = F.create_map(*[F.lit(x) for kv in base.items() for x in kv])
    numbers = ranged.select(*order, (offsets[part] + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("number"))
    sides = [s.join(numbers, order).select("number", "seq", F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), "digest") for s in sides]
    most = max((s.agg(F.max("seq")).first()[0] or 0) for s in sides)
    depth = (_levels(most + 1), _levels(n))
    a, b = (tree(s, depth, f"tree-{x}") for s, x in zip(sides, "ab", strict=True))
    bad, done, top = None, [], depth[0] + max(depth[1] - 2, 0)  # from level ``top`` down, branches stay what they are
    for level in range(len(a) - 1, -1, -1):
        x, y = a[level], b[level]
        if bad is not None:
            if level <= top:
                inside = [r[0] for r in bad.select("branch").distinct().collect()]  # FAN * FAN at most
                inside = inside if level < top else [FAN * k + i for k in inside for i in range(FAN)]
                x, y = (t.where(F.col("branch").isin(inside)) for t in (x, y))  # other folders aren't read
                if read is not None:
                    read.append((level, x, y))
            up = [F.col("number"), F.shiftright("seq", 4)] if level < depth[0] else [F.shiftright("number", 4), F.col("seq")]
            keys = sized(bad.select(F.col("number").alias("_n"), F.col("seq").alias("_s")))
            x, y = (t.join(keys, (up[0] == F.col("_n")) & (up[1] == F.col("_s")), "left_semi") for t in (x, y))
        y = y.select("number", "seq", *[F.col(c).alias(f"_{c}") for c in ("lo", "hi", "digest", "branch")])
        same = (F.col("digest") == F.col("_digest")) & (F.col("lo") == F.col("_lo")) & (F.col("hi") == F.col("_hi"))
        status = F.when(F.col("_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("digest") != F.col("_digest"), "corrupt").otherwise("moved")
        found = x.join(y, ["number", "seq"], "full").where(~F.coalesce(same, F.lit(False))).select("number", "seq", F.coalesce("branch", "_branch").alias("branch"), status.alias("status"))
        bad = written(spark, found, f"differs-{level}")
        done.append(bad)
        if not bad.limit(1).count():
            if level < len(a) - 1:
                raise RuntimeError("a node differs, but none of its children does")
            break
    drop(*done[:-1])
    return bad.join(numbers, "number").select(*order, "seq", "status")


def damaged(html: Column, page_id: Column) -> Column:
    """A replica's payload with planted damage: its first character overwritten where page_id % 97 = 13; null (lost) where page_id % 389 = 7."""
    text = F.coalesce(html, F.lit(""))
    return F.when(page_id % 97 == 13, F.concat(F.lit("\x00"), F.substr(text, F.lit(2)))).when(page_id % 389 == 7, F.lit(None)).otherwise(text)


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record of the primary and of a damaged replica, with what the audit says of it. The replica's records lie at the primary's
    offsets, but for files whose number is 5 more than a multiple of 8: 64 bytes precede them there. It also holds a
    record after the last one of every file whose number is a multiple of 16."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    bad = damaged(F.col("html"), F.col("page_id"))
    own, there = record(F.col("page_id"), F.col("url"), F.col("html")), record(F.col("page_id"), F.col("url"), bad)
    both = written(spark, manifest(pages.select("page_id", own.alias("record"), F.sha2(F.encode(there, "UTF-8"), 256).alias("now"), F.octet_length(there).cast("long").alias("size"), bad.isNull().alias("lost"))), "manifests")
    first = both.select(*_PLACE, "offset", "length", "digest")
    ahead = F.when(F.pmod("file_id", F.lit(8)) == 5, 64).otherwise(0)
    second = both.where("NOT lost").select(*_PLACE, (F.col("offset") + ahead).alias("offset"), F.col("size").alias("length"), F.col("now").alias("digest"))
    ends = both.where("file_id % 16 = 0").groupBy("file_id", "volume").agg((F.max("seq") + 1).alias("seq"), F.max(F.col("offset") + F.col("length")).alias("offset"))
    added = ends.select(*_PLACE, "offset", F.lit(5).cast("long").alias("length"), F.sha2(F.lit("added").cast("binary"), 256).alias("digest"))
    found = audit(first, second.unionByName(added))
    named = both.select(*_PLACE, "page_id", "offset", "length", "digest").join(found, _PLACE, "full")
    return named.select("page_id", "file_id", "volume", "seq", "offset", "length", "digest", F.coalesce("status", F.lit("ok")).alias("status"))


SQL = r"""
WITH t AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, CASE WHEN page_id % 97 = 13 THEN chr(1) || substr(html, 2) ELSE html END AS bad FROM t),
r AS (SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head,
  chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, bad FROM q),
m AS (SELECT page_id, page_id // 1024 AS file_id, head || strlen(html) || gap || html || gap AS record, head || strlen(bad) || gap || bad || gap <> head || strlen(html) || gap || html || gap AS other FROM r),
d AS (SELECT page_id, file_id, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS digest, other FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY page_id, digest) - 1 AS seq,
             CAST(sum(length) OVER (PARTITION BY file_id ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) - length AS BIGINT) AS "offset" FROM d)
SELECT page_id, file_id, CAST(0 AS BIGINT) AS volume, seq, "offset", length, digest,
       CASE WHEN other THEN 'corrupt' WHEN page_id % 389 = 7 THEN 'missing' WHEN file_id % 8 = 5 THEN 'moved' ELSE 'ok' END AS status FROM o
UNION ALL SELECT NULL, file_id, 0, max(seq) + 1, NULL, NULL, NULL, 'extra' FROM o WHERE file_id % 16 = 0 GROUP BY file_id
"""
QUERIES = {"op8_warc_fixity": op8_warc_fixity}
ORACLES = {"op8_warc_fixity": SQL}
