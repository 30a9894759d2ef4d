"""Mixing sources to target weights by Pfair scheduling; DataFrame functions only.

Each source is cut into blocks of `block_size` rows, and one block is handed out per time slot. A source's target weight
is a whole number n of parts; with N parts in all its share is n / N exactly. Its block j has the release time
floor(j N / n) and the deadline ceil((j + 1) N / n); earliest deadline first over the released blocks meets
every deadline, so at any time a source has had its share of the slots with less than one block of
deviation. All sources are even again after N slots, so the schedule of one period is all that has to be worked
out; block j of a source follows from it by division, without any pass over the rows in order. When a source
ends, its slots stay empty and the others go on in proportion.

Sources of equal weight have the same windows and take turns, so a slot is decided among the distinct weights, not
among the sources. A period has at most PERIOD slots, or one for each source if those are more.

Rows of a source are numbered in the order of md5(seed:doc_id), over ranges of that hash: counts of ranges
are summed first, then each range numbers its own rows. A source with any share of the rows is spread over
all tasks.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a period at most; without weights, roots of row counts are divided by a whole unit until they fit.
PERIOD = 1 << 20


def whole_parts(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the same proportions, exactly those of the weights as they are written in decimals; zero
    stays zero."""
    exact = {k: Fraction(str(v)) for k, v in weights.items()}
    if any(v < 0 for v in exact.values()):
        raise ValueError("a weight is below zero")
    scale = lcm(*(v.denominator for v in exact.values()))
    parts = {k: int(v * scale) for k, v in exact.items()}
    common = gcd(*parts.values()) or 1
    parts = {k: v // common for k, v in parts.items()}
    if sum(parts.values()) > PERIOD:
        raise ValueError(f"these weights are even only after {sum(parts.values())} slots, of {PERIOD} at most: give rounder ones")
    return parts


def shares(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """src, rows, n, late: the parts of each source, and whether it has no weight and comes after the others."""
    if weights is None:
        unit = counts.agg(F.greatest(F.lit(1.0), F.ceil(F.sum(F.sqrt("rows")) / PERIOD)).alias("unit"))
        n = F.greatest(F.lit(1), F.floor(F.sqrt("rows") / F.col("unit"))).cast("long")
        return counts.join(F.broadcast(unit)).select("src", "rows", n.alias("n"), F.lit(False).alias("late"))
    given = counts.sparkSession.createDataFrame([(f"s{k}", v) for k, v in whole_parts(weights).items()], "src string, n long")
    weighed = counts.join(given, "src", "left").withColumn("late", F.coalesce(F.col("n") == 0, F.lit(True)))
    return weighed.select("src", "rows", F.when(F.col("late"), F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"), "late")


def schedule(parted: DataFrame) -> DataFrame:
    """One period for each value of late: late, src, period, turn (0 to n - 1), at (the slot of that turn in the period).

    Each slot goes to the weight whose next block is released and has the least deadline, the lesser weight where
    deadlines are equal; within a weight the sources take turns by name. Slots are worked out by parts of the root of the
    period, so that no step copies more than a part."""
    groups = parted.groupBy("late", "n").agg(F.sort_array(F.collect_list("src")).alias("srcs"))
    one = groups.groupBy("late").agg(F.sort_array(F.collect_list(F.struct("n", "srcs"))).alias("all"), F.sum(F.col("n") * F.size("srcs")).alias("period"))
    slots = one.selectExpr("late", "all", "period", "transform(all, x -> named_struct('n', x.n, 'm', cast(size(x.srcs) as bigint))) AS g", "cast(ceil(sqrt(period)) as bigint) AS part").selectExpr("late", "all", "period", """
        flatten(aggregate(sequence(0L, (period - 1) div part),
          named_struct('had', transform(g, x -> 0L), 'out', cast(array() as array<array<bigint>>)),
          (done, b) -> transform(array(
            aggregate(sequence(b * part, least(period, (b + 1) * part) - 1),
              named_struct('had', done.had, 'out', cast(array() as array<bigint>)),
              (acc, t) -> transform(array(
                  array_min(transform(g, (x, i) ->
                    if(((acc.had[i] div x.m) * period) div x.n <= t,
                       ((((acc.had[i] div x.m) + 1) * period + x.n - 1) div x.n) * size(g) + i, 9223372036854775807L))) % size(g)),
                p -> named_struct('had', transform(acc.had, (k, i) -> if(i = p, k + 1, k)),
                                  'out', concat(acc.out, array(acc.had[cast(p as int)] * size(g) + p))))[0])),
            held -> named_struct('had', held.had, 'out', concat(done.out, array(held.out))))[0],
          done -> done.out)) as slots""")
    turns = slots.select("late", "all", "period", F.posexplode("slots").alias("at", "code"))
    turns = turns.selectExpr("late", "period", "cast(at as bigint) AS at", "all[cast(code % size(all) as int)].srcs AS srcs", "code div size(all) AS had")
    return turns.selectExpr("late", "srcs[cast(had % size(srcs) as int)] AS src", "period", "had div size(srcs) AS turn", "at")


def mix_sources(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", weights: dict[str, float] | None = None, block_size: int = 16, seed: int = 0) -> DataFrame:
    """Return docs with src_parts, period, block, slot and place: read in the order of (slot, place), the rows
    are mixed to the target weights.

    weights: by source name, in any unit; rows of sources without a weight, or with weight zero, come after all
    others, in equal shares. Without weights a source has as many parts as the root of its number of rows, rounded down. A
    null source is a source of its own. Rows that repeat a doc_id (or have none) get places of their own, in any order
    among them; an empty table gives no rows. No row is dropped. Columns of docs named like the five new ones are
    replaced.
    """
    new = ("src_parts", "period", "block", "slot", "place")
    own = [c for c in docs.columns if c not in new]
    # Rows without an id are spread by what else is in them.
    other = F.xxhash64(*[F.col(f.name) for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant"))])
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null"), other.cast("string")))).cast("binary"))
    src = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    tagged = docs.select(*own, src.alias("__src"), key.alias("__key"))

    counts = docs.groupBy(src.alias("src")).agg(F.count("*").alias("rows"))
    ranges = counts.agg(F.greatest(F.lit(256), F.expr("cast(ceil(sum(rows) / 4000) as int)")).cast("long").alias("__ranges"))
    ranged = tagged.join(F.broadcast(ranges)).withColumn("__range", F.expr("(cast(conv(substring(__key, 1, 8), 16, 10) as bigint) * __ranges) div 4294967296L")).drop("__ranges")

    parted = shares(counts, weights)
    held = ranged.groupBy("__src", "__range").agg(F.count("*").alias("held"))
    before = held.select("__src", "__range", (F.sum("held").over(Window.partitionBy("__src").orderBy("__range")) - F.col("held")).alias("__before"))
    before = before.join(parted.select(F.col("src").alias("__src"), F.col("n").alias("src_parts")), "__src")
    numbered = ranged.join(before, ["__src", "__range"]).withColumn("__no", F.col("__before") + F.row_number().over(Window.partitionBy("__src", "__range").orderBy("__key", doc_id)) - 1)

    plan = schedule(parted)
    if weights is not None:
        # What has no weight begins where the last period of the others ends.
        ends = plan.filter("NOT late").groupBy().agg(F.max("period").alias("p")).join(
            parted.filter("NOT late").groupBy().agg(F.max(F.expr(f"(rows + {block_size} * n - 1) div ({block_size} * n)")).alias("r")))
        plan = plan.join(F.broadcast(ends)).withColumn("at", F.col("at") + F.when(F.col("late"), F.coalesce(F.col("p") * F.col("r"), F.lit(0))).otherwise(0))
    plan = plan.select(F.col("src").alias("__src"), F.col("period").alias("__period"), F.col("turn").alias("__turn"), F.col("at").alias("__at"))
    blocked = numbered.withColumn("block", F.expr(f"__no div {block_size}L")).withColumn("__turn", F.expr("block % src_parts"))
    timed = blocked.join(plan, ["__src", "__turn"])
    slot = F.expr("(block div src_parts) * __period + __at").alias("slot")
    return timed.select(*own, "src_parts", F.col("__period").alias("period"), "block", slot, F.expr(f"__no % {block_size}L").alias("place"))


def in_mixed_order(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs, with its columns alone, in partitions that follow the mixed order."""
    named = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    apart = docs.select(*[F.col(c).alias(n) for c, n in named.items()])
    mixed = mix_sources(apart, source=named["source"], doc_id=named["doc_id"], **kw)
    mixed = mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return mixed.select(*[F.col(n).alias(c) for c, n in named.items()])


#: The same in SQL, with recursion over the slots of a period.
ORACLE = """
WITH RECURSIVE counts AS (SELECT coalesce('s' || source, 'n') AS src, count(*) AS rows FROM documents GROUP BY 1),
shares AS (SELECT src, rows, greatest(1, floor(sqrt(rows) / greatest(1, ceil(sum(sqrt(rows)) OVER () / 1048576))))::BIGINT AS n FROM counts),
packed AS (SELECT list(src ORDER BY n, src) AS srcs, list(n ORDER BY n, src) AS ns, sum(n)::BIGINT AS period FROM shares),
slots AS (
  SELECT -1::BIGINT AS tick, NULL::BIGINT AS pick, list_transform(ns, lambda x: 0::BIGINT) AS had FROM packed
  UNION ALL
  SELECT tick + 1, pick, list_transform(range(1, len(ns) + 1), lambda i: CASE WHEN i = pick THEN had[i] + 1 ELSE had[i] END)
  FROM (SELECT s.tick, s.had, p.ns, list_min(list_transform(range(1, len(p.ns) + 1), lambda i:
          CASE WHEN (s.had[i] * p.period) // p.ns[i] <= s.tick + 1
               THEN (((s.had[i] + 1) * p.period + p.ns[i] - 1) // p.ns[i]) * len(p.ns) + (i - 1) ELSE 9223372036854775807 END)) % len(p.ns) + 1 AS pick
        FROM slots s, packed p WHERE s.tick + 1 < p.period) q),
plan AS (SELECT p.srcs[pick] AS src, p.period, tick, row_number() OVER (PARTITION BY pick ORDER BY tick) - 1 AS turn FROM slots, packed p WHERE tick >= 0),
numbered AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS src,
               row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) - 1 AS no FROM documents)
SELECT d.doc_id, d.source, s.n AS src_parts, p.period, d.no // 16 AS block, (d.no // 16) // s.n * p.period + p.tick AS slot, d.no % 16 AS place
FROM numbered d JOIN shares s USING (src) JOIN plan p ON p.src = d.src AND p.turn = (d.no // 16) % s.n
"""
