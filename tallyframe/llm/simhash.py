"""Near-duplicate documents by SimHash fingerprints, linked through Pigeonring filtering.

A fingerprint has 64 bits: a bit is 1 if it is set in over half of the XXH64 values (seed 42) of a text's shingles.
Fingerprints link at `max_bits` or fewer differing bits, and a component is what links reach.

Linking works on distinct fingerprints. Their bits form a ring of SEGMENTS equal segments. If two fingerprints differ
in T bits or fewer, some segment starts a chain along which the differences in the first l segments never exceed
l * T / SEGMENTS, for every l. While l * T / SEGMENTS is below 1 that budget is zero: the segments are equal, and their
bits are the key under which candidates meet, one key for each start. Each candidate pair is then tested against the
budgets of the longer chains, and only what passes gets the full Hamming check.

A key that over CROWD fingerprints share makes no pairs. Its fingerprints get longer keys: of the rest of the bits, in as
many parts as differing bits may fill and one more, some part is equal too. With 28 and 12 bits that serves some 10 ** 13 distinct
fingerprints. A longer key that is crowded again has its fingerprints linked exactly by their neighbourhoods: each is dealt to its own value and to all values that differ in one bit (for T = 2), and those that meet at a value
are linked to the smallest of them. Any two that meet are within 2 bits, any two within 2 bits meet, and at most 65
can meet at one value, so the work grows with the fingerprints and not with their pairs.

Components come from alternating large-star and small-star rounds over tables in the shared scratch folder.

Defined cases: a null or empty text, or one without words, has fingerprint 0, which links like any other. Rows that
repeat an id are each returned. A null id is never a component's id unless the component has no other. Where one row of
a component stays, rows of the same id and text count as one. An empty table gives an empty result. Columns beyond id
and text are not read, and kept whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import discard_read, free_shuffles, hot_split_join, map_arrow, nested, quoted, saved, scratch, table, unnested

BITS, SEGMENTS, SEED = 64, 16, 42

#: Fingerprints that may share a key before they are linked by neighbourhoods instead of pairs.
CROWD = 24

#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15


def shingle_hashes(text: str | None, width: int) -> Iterator[int]:
    """The hashes of a whole text's shingles, in order; of fewer words, that of the whole sequence."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return iter(())
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else iter([b" ".join(words)])
    return (xxhash.xxh64_intdigest(x, SEED) for x in shingles)


def majority(hashes: Iterator[int]) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number; 0 for none."""
    ones, n = np.zeros(BITS, np.int64), 0
    hashes = iter(hashes)
    while len(block := np.fromiter(itertools.islice(hashes, BLOCK), "<u8")):
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a whole text, as an unsigned number."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, th, fp): th is a hash of the text as it is, fp the fingerprint, as signed 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], ["doc_id", "th", "fp"])

    rows = docs.select(quoted(id_col).alias("doc_id"), F.xxhash64(quoted(text_col)).alias("th"), quoted(text_col).alias("text"))
    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, fp long")


def _ring(fp: Column, start: int) -> Column:
    """fp with the segment `start` turned to the top."""
    step = BITS // SEGMENTS * start
    return F.shiftleft(fp, step).bitwiseOR(F.shiftrightunsigned(fp, BITS - step)) if step else fp


def zero_run(max_bits: int) -> int:
    """How many segments a chain has while its budget stays below one bit."""
    return (SEGMENTS - 1) // max_bits if max_bits else SEGMENTS


def chain_viable(diff: Column, max_bits: int) -> Column:
    """Whether the chain that starts at the top segment keeps its budgets; diff: the differing bits, turned."""
    kept = F.bit_count(diff) <= max_bits
    size = BITS // SEGMENTS
    for length in range(SEGMENTS - 1, zero_run(max_bits), -1):
        kept = (F.bit_count(F.shiftrightunsigned(diff, BITS - size * length)) <= length * max_bits // SEGMENTS) & kept
    return kept


def links(fps: DataFrame, max_bits: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b) with a < b: pairs of distinct fingerprints whose links have the components of all links.

    fps: one column fp, distinct. max_bits may be 1 or 2.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    shift = BITS - BITS // SEGMENTS * zero_run(max_bits)
    key = lambda start: F.struct(F.lit(start).alias("start"), F.shiftrightunsigned(_ring(F.col("fp"), start), shift).alias("run"), _ring(F.col("fp"), start).alias("turned"))
    keyed = fps.select("fp", F.explode(F.array(*[key(i) for i in range(SEGMENTS)])).alias("k")).select("fp", "k.*")
    total = fps.count() * SEGMENTS
    pairs, crowded = _met(keyed, ["start", "run"], total, max_bits, crowd)
    crowded = saved(crowded, "simhash-crowded")
    if crowded.isEmpty():
        return pairs
    size = -(-shift // (max_bits + 1))
    part = lambda i: F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("turned", size * i).bitwiseAND(F.lit((1 << min(size, shift - size * i)) - 1)).alias("rest"))
    longer = crowded.select("*", F.explode(F.array(*[part(i) for i in range(max_bits + 1)])).alias("p")).select("fp", "start", "run", "turned", "p.*")
    more, crowded = _met(longer, ["start", "run", "part", "rest"], total * (max_bits + 1), max_bits, crowd)
    return pairs.unionByName(more).unionByName(_stars(crowded.select("fp").distinct(), max_bits)).distinct()


def _met(keyed: DataFrame, keys: list[str], total: int, max_bits: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), the pairs of fingerprints that keys of up to `crowd` of them bring together and that pass the chains, and the rows of larger keys."""
    met = saved(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-keys")
    near = saved(hot_split_join(keyed, met.filter(F.col("n") <= crowd), keys, "n", total).drop("n"), "simhash-candidates")
    a, b = near.alias("a"), near.alias("b")
    diff = F.col("a.turned").bitwiseXOR(F.col("b.turned"))
    same = F.col("a.fp") < F.col("b.fp")
    for k in keys:
        same = (F.col(f"a.{k}") == F.col(f"b.{k}")) & same
    pairs = a.join(b, same).filter(chain_viable(diff, max_bits)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()
    return pairs, hot_split_join(keyed, met.filter(F.col("n") > crowd), keys, "n", total).drop("n")


def _stars(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of each fingerprint to the smallest one that it meets, at a value within one bit of both."""
    flip = [F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(BITS)]]
    at = fps.select("fp", F.explode(F.transform(F.array(*flip), lambda x: F.col("fp").bitwiseXOR(x))).alias("at"))
    groups = at.groupBy("at").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    if max_bits == 1:  # those that meet at a value may be two bits apart; the value itself is one bit from each
        groups = groups.filter(F.array_contains("fps", F.col("at")))
        pairs = groups.select(F.col("at").alias("x"), F.explode("fps").alias("y"))
    else:
        pairs = groups.select(F.array_min("fps").alias("x"), F.explode("fps").alias("y"))
    return pairs.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that node reaches over edges (a, b); nodes without edges are left out.

    Alternates large-star (larger neighbours of a node move to its smallest neighbour) and small-star (a node and its
    smaller neighbours move to the smallest of these) until each node has one link, to a node that has none.
    """
    links = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        free_shuffles(links.sparkSession)
        total, nodes = links.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
        if total == nodes and links.join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")).withColumnRenamed("u", "v")
        large = hot_split_join(links, least, ["v"], "n", total).select("u", F.col("m").alias("v")).filter("u != v").distinct()
        large, before = saved(large, "links-large"), links
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        moved = hot_split_join(large, least, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        links = saved(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard_read(before)
        discard_read(large)


def _grouped(docs: DataFrame, id_col: str, text_col: str, width: int, max_bits: int) -> DataFrame:
    """(doc_id, th, fp, least): least is the struct (null, doc_id, th) of the first document of the component."""
    marked = saved(fingerprints(docs, id_col, text_col, width), "simhash")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "th")
    classes = saved(marked.groupBy("fp").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    reach = components(links(classes.select("fp"), max_bits))
    # a root has no row in reach for itself; a class that is nobody's node or root is a component of its own
    named = saved(classes.join(reach, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "simhash-named")
    first = named.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("classes"))
    whole = saved(hot_split_join(named.drop("least"), first, ["root"], "classes", named.count()).select("fp", "n", "least"), "simhash-components")
    return hot_split_join(marked, whole, ["fp"], "n", marked.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id), one row for each of docs."""
    with scratch(docs.sparkSession) as keep:
        return keep(_grouped(docs, id_col, text_col, width, max_bits).select("doc_id", "fp", F.col("least.doc_id").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of docs that stand for their component: of each, one row of the smallest id stays."""
    with scratch(docs.sparkSession) as keep:
        return keep(standing(docs, id_col, text_col, _grouped(docs, id_col, text_col, width, max_bits)))


def standing(docs: DataFrame, id_col: str, text_col: str, marked: DataFrame) -> DataFrame:
    """The rows of docs whose id and text hash are the first of their component, once each. marked: (doc_id, th, least)."""
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("th") == F.col("least.th"))
    keys = ["key", "null", "th"]  # equal without nulls, so that rows meet and repeat under one partitioning
    keyed = lambda ident: [F.coalesce(ident.cast("string"), F.lit("")).alias("key"), ident.isNull().alias("null")]
    gone = marked.filter(~stays).select(*keyed(F.col("doc_id")), "th").distinct()
    rows = docs.select(nested(docs).alias("row"), *keyed(quoted(id_col)), F.xxhash64(quoted(text_col)).alias("th"))
    return unnested(rows.join(gone, keys, "left_anti").dropDuplicates(keys), docs.columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
