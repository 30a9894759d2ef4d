"""Exact dedup with an extendible-hash index in shared files; DataFrame functions only.

Two texts are equal when they are identical after each run of ASCII white space became one space; null
counts as empty. A text's key is a 64-bit hash. The index has three parts, all of them Parquet in the shared folder:

* keys: every key and the number of rows that have it;
* directory: a pointer from each value of the first `depth` bits of a key to its bucket. A bucket that holds more than
  `capacity` distinct keys splits by its next bit, and the directory doubles until none is overfull (or 62 bits
  are used up);
* buckets: for each document its bucket, key, SHA-256 and the document that stays. Owner tasks make them: each is sent
  a range of buckets, chains the rows of a key and compares their texts byte by byte.

The directory is broadcast. It has some 2**19 pointers at most, as `capacity` grows with the keys beyond 2**16 buckets. A key
with more than `HOT` rows, or more than 2**-16 of all, isn't sent to an owner row by row: its rows collapse to one
for each text and input task, compared byte by byte as well, and are joined with what came out of that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from posmv.llm.common import ASCII_SPACE, materialize

#: Rows of a key from which on it may be hot, and bytes of the hot keys' texts that may be broadcast.
HOT, HOT_BYTES = 1024, 32 << 20
_BITS = 62


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


def directory(keys: DataFrame, total: int, capacity: int) -> tuple[DataFrame, int]:
    """keys: distinct keys h. Return pointers and the number of their bits: prefix, slot (where its bucket begins) and
    depth (bits of the bucket)."""
    bits = min(_BITS, max(1, (max(1, total // capacity) - 1).bit_length() + 2))
    while True:
        counts = materialize(keys.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("prefix")).agg(F.count("*").alias("n")), "exact-directory")
        if bits == _BITS or counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] <= capacity:
            break
        bits = min(_BITS, bits + 2)
    # Every bucket that each pointer had before the directory's doublings; it keeps the first that is not overfull.
    levels = counts.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("part", F.expr(f"shiftrightunsigned(prefix, {bits} - depth)"))
    fits = levels.groupBy("depth", "part").agg(F.sum("n").alias("held")).filter((F.col("held") <= capacity) | (F.col("depth") == bits))
    found = levels.join(fits, ["depth", "part"]).groupBy("prefix").agg(F.min("depth").alias("depth"))
    slot = F.expr(f"shiftleft(shiftrightunsigned(prefix, {bits} - depth), {bits} - depth)")
    return materialize(found.select("prefix", slot.alias("slot"), "depth"), "exact-directory"), bits


def _placed(docs: DataFrame, doc_id: str, text: str, capacity: int, carried: Column, within: bool) -> tuple[DataFrame, DataFrame | None]:
    """`carried` (with the text in it, if `within`) as d, id, norm, keep (the id that stays), group_size, first, slot, depth and h of every row: of the rows
    that owners chain, and of those with hot keys, if there are any."""
    rows = docs.select(carried.alias("d"), F.col(doc_id).alias("id"), normalised(F.col(text)).alias("norm")).withColumn("h", F.xxhash64("norm"))
    keys = materialize(rows.groupBy("h").agg(F.count("*").alias("n")), "exact-keys")
    total, count = keys.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    pointers, bits = directory(keys, total, max(capacity, total >> 16))
    if bits <= 19:
        pointers = F.broadcast(pointers)
    hot = keys.filter(F.col("n") > max(HOT, count >> 16)).select("h")  # at most 2**16 keys
    placed = rows.withColumn("prefix", F.shiftrightunsigned("h", 64 - bits)).join(pointers, "prefix").drop("prefix")

    each = Window.partitionBy("slot", "h", "norm").orderBy(F.col("id").asc_nulls_last())
    whole = each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owned = placed.join(F.broadcast(hot), "h", "left_anti")
    if within:  # one text is sent, not two
        owned = owned.drop("norm").repartitionByRange("slot").withColumn("norm", normalised(F.col("d").getField(text)))
    else:
        owned = owned.repartitionByRange("slot")
    chained = owned.select("d", "id", "norm", "h", "slot", "depth", F.first("id").over(whole).alias("keep"), F.count("*").over(whole).alias("group_size"), (F.row_number().over(each) == 1).alias("first"))
    if hot.isEmpty():
        return chained, None

    many = materialize(placed.join(F.broadcast(hot), "h", "left_semi").withColumn("uid", F.monotonically_increasing_id()), "exact-hot")
    texts = many.groupBy("slot", "h", "norm").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "uid")).alias("least"), F.count("*").alias("group_size"))
    texts = materialize(texts, "exact-hot-texts")
    if (texts.agg(F.sum(F.octet_length("norm"))).first()[0] or 0) <= HOT_BYTES:
        texts = F.broadcast(texts)
    joined = many.join(texts, ["slot", "h", "norm"]).select(*many.columns, "least", "group_size")
    return chained, joined.withColumn("keep", F.col("least.id")).withColumn("first", F.col("uid") == F.col("least.uid")).select(chained.columns)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096) -> DataFrame:
    """Return one row per document: doc_id, keep_id, group_size, kept, text_sha256, bucket, depth.

    Of equal texts the row with the smallest doc_id stays; a null doc_id comes after all others, and of
    rows that repeat both id and text exactly one is kept. Ids may be of any type that has an order. Null text is empty
    text; an empty table gives no rows. Other columns of docs are not read, whatever their names.
    """
    index = []
    for part in _placed(docs, doc_id, text, capacity, F.lit(True), False):
        if part is not None:
            found = part.select(F.col("id").alias("doc_id"), F.col("keep").alias("keep_id"), "group_size", F.col("first").alias("kept"), F.sha2("norm", 256).alias("text_sha256"), F.col("slot").alias("bucket"), "depth", "h")
            index.append(materialize(found, "exact-buckets").drop("h"))
    return index[0] if len(index) == 1 else index[0].unionByName(index[1])


def drop_exact_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 4096) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup keeps."""
    kept = [p.filter("first").select("d.*") for p in _placed(docs, doc_id, text, capacity, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), True) if p is not None]
    return kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
