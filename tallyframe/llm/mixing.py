"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words. Sources get weights, and the budget is shared by weight; a source's
target stops at `cap` times its size, and what is over is shared again among the rest (`targets`). Within a source,
documents are taken whole `floor(target / size)` times, and the rest of the target is met by a threshold on a hash of
the id: sizes are summed by source and hash bucket, the bucket that holds the boundary is found from the running
sums, and only that bucket's documents are looked at again, with a finer bucket, until a bucket is one hash value.
Thresholds are nested: a larger budget of the same source takes a superset of the documents. No rows are sorted but the
sums, of which a source has at most BUCKETS at a level.

Defined cases: a null or empty text has size 0 and is taken 0 times. A null source is a source of its own, ranked
last. Rows that share an id share its hash and are taken or left together; a null id hashes as the empty string.
An empty table gives an empty result. Columns beyond id, text and source are not read, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import WORD, lookup, nested, quoted, saved, scratch, table, unnested

#: Hash bits, and the bits by which each level refines.
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of(ident: Column) -> Column:
    """The first 60 bits of the MD5 of the id as text; a null id is hashed as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h), one row for each of docs."""
    return docs.select(
        quoted(id_col).alias("doc_id"),
        quoted(source_col).alias("source"),
        F.coalesce(F.regexp_count(quoted(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        hash_of(quoted(id_col)).alias("h"),
    )


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their rank from 0 in the order, which must tell any two apart: rows are dealt out by range, ranked there, and the parts' sizes added up."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = saved(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "mix-ranges")
    before, counts = 0, {}
    for r in dealt.groupBy("__part").count().orderBy("__part").collect():  # at most `parts` rows
        counts[r["__part"]], before = before, before + r["count"]
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    start = F.element_at(F.create_map(*[F.lit(x) for pair in counts.items() for x in pair]), F.col("__part")) if counts else F.lit(0)
    return dealt.withColumn("rank", inside.cast("long") + start).drop("__part")


def targets(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Adds weight and target to (source, source_size), one row a source.

    The level to which targets rise is found by sharing the excess of capped sources again until none is above its
    cap; each round is one aggregate over the sources and brings three numbers to the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int"))
    weighted = ranked(sources, F.col("source").isNull(), F.col("source")).withColumn("weight", weight).drop("rank")
    weighted = saved(weighted.withColumn("cap", F.col("source_size") * F.lit(cap)), "mix-sources")
    whole = weighted.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    budget, weights, level, capped = share * (whole["size"] or 0), whole["weight"] or 0.0, 0.0, -1
    while weights:
        over = weighted.filter(F.col("cap") < level * F.col("weight")).agg(F.count(F.lit(1)).alias("n"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        if over["n"] == capped or weights == (over["weight"] or 0.0):
            break
        capped, level = over["n"], (budget - (over["cap"] or 0.0)) / (weights - (over["weight"] or 0.0))
    return weighted.select("source", "source_size", "weight", F.least("cap", F.col("weight") * level).alias("target"))


def _running(cells: DataFrame) -> DataFrame:
    """Adds to cells (source, cell, size, base, part) the sums before and after each cell."""
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("after", F.col("base") + F.sum("size").over(upto)).withColumn("before", F.col("after") - F.col("size"))


def thresholds(meta: DataFrame, plan: DataFrame, hist: DataFrame) -> DataFrame:
    """(source, threshold): documents whose hash is below it are taken once more than `copies` times.

    meta is sizes(), hist its sums by source and first bucket, plan has (source, copies, part): part is the share of
    the target that whole copies leave.
    """
    shift = HASH_BITS - LEVEL_BITS
    cells = _running(lookup(hist, plan.select("source", "part"), ["source"], "inner").withColumn("base", F.lit(0).cast("long")))
    found = [cells.filter("after <= part").select("source", F.shiftleft(F.col("cell") + 1, shift).alias("t"))]
    edge = cells.filter("before < part and part < after").select("source", F.col("cell").alias("edge"), F.col("before").alias("base"), "part")
    rows = lookup(meta.select("source", "h", "size"), edge, ["source"], "inner").filter(F.shiftright("h", shift) == F.col("edge"))
    rows = saved(rows.drop("edge"), "mix-edge")
    while shift > 0:
        shift -= LEVEL_BITS
        cells = _running(rows.groupBy("source", F.shiftright("h", shift).alias("cell"), "base", "part").agg(F.sum("size").alias("size")))
        full = F.col("after") <= F.col("part") if shift else F.col("before") + F.col("after") < 2 * F.col("part")
        found.append(cells.filter(full).select("source", F.shiftleft(F.col("cell") + 1, shift).alias("t")))
        if shift:
            edge = cells.filter("before < part and part < after").select("source", F.col("cell").alias("edge"), F.col("before").alias("base"), "part")
            joined = rows.drop("base", "part").alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright("r.h", shift) == F.col("e.edge")))
            rows = joined.select("r.source", "r.h", "r.size", "e.base", "e.part")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("source").agg(F.max("t").alias("threshold"))


def rules(meta: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, weight, target, copies, part, threshold), one row a source, for the sizes() of a table."""
    cell = F.shiftright("h", HASH_BITS - LEVEL_BITS).alias("cell")
    hist = saved(meta.groupBy("source", cell).agg(F.sum("size").alias("size")), "mix-histogram")
    plan = targets(hist.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("copies", whole).withColumn("part", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = saved(plan, "mix-plan")
    marks = thresholds(meta, plan, hist).select(F.col("source").alias("of"), "threshold")
    return saved(plan.join(marks, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-rules")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), one row for each of docs.

    Options are those of targets(): cycle, weights of the sources in their order, repeating; share, all targets over
    all sizes; cap, the most that a target may be of its source's size. copies: how often the mix takes the document;
    taken: copies times size.
    """
    with scratch(docs.sparkSession) as keep:
        meta = saved(sizes(docs, id_col, text_col, source_col), "mix-sizes")
        out = lookup(meta, rules(meta, **options).drop("weight", "part"), ["source"])
        copies = F.col("copies") + F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)).cast("long")
        return keep(out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it (a row of size 0 like others of its hash), columns unchanged.

    How often follows from a row's source and hash, so the texts are not shuffled unless there are more sources than
    may be broadcast.
    """
    with scratch(docs.sparkSession) as keep:
        meta = saved(sizes(docs, id_col, text_col, source_col), "mix-sizes")
        rule = rules(meta, **options).select("source", "copies", "threshold")
        marked = docs.select(nested(docs).alias("row"), quoted(source_col).alias("source"), hash_of(quoted(id_col)).alias("h"))
        marked = lookup(marked, rule, ["source"])
        times = F.col("copies") + F.coalesce(F.col("h") < F.col("threshold"), F.lit(False)).cast("long")
        return keep(unnested(marked.withColumn("copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))), docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS r
  FROM d GROUP BY source),
w AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, ([5, 2, 1])[((r - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, r) AS k,
         (budget - (sum(cap) OVER (ORDER BY cap / weight, r) - cap)) /
         (sum(weight) OVER () - (sum(weight) OVER (ORDER BY cap / weight, r) - weight)) AS lam FROM w),
f AS (SELECT *, min(k) FILTER (WHERE lam * weight <= cap) OVER () AS first_free FROM o),
t AS (
  SELECT source, source_size,
         CASE WHEN k < first_free THEN cap ELSE least(cap, weight * max(CASE WHEN k = first_free THEN lam END) OVER ()) END AS target
  FROM f),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (
  SELECT source, h, sum(size) AS size, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS after FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.copies + CASE WHEN 2 * c.after - c.size < 2 * (p.target - p.copies * p.source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.h = c.h
"""
