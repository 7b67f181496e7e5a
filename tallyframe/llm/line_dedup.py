"""Removal of boilerplate lines that many sites share, by the spread of each line over distinct sites.

A line's sites are counted with HyperLogLog sketches: one sketch a line hash, built per task and merged by the
aggregation. Lines whose estimate is clearly above `min_sites` are boilerplate and lines clearly below are not; those
within `band` of it get an exact distinct count. A boilerplate line stays at its first place (smallest id, then
position) and goes everywhere else, so its text is not lost to the corpus.

Only DataFrame functions are used. A line's key is a 64-bit and a 32-bit hash of its exact text. Lines of fewer than
`min_words` words are never boilerplate, as they recur by chance, unless they have `min_chars` characters, as a sentence
has in a script without spaces. Finding that out, and taking lines out of a text, takes time in proportion to the text.

Defined cases: a null text stays null and has 0 lines; an empty text has one empty line. A text whose lines all go
becomes the empty string and its row stays. A null source is a site of its own. A null id sorts first. Rows that
repeat an id and text keep and lose the same lines. An empty table gives an empty result. Other columns of the
documents are kept as they are, whatever their names; n_lines and n_removed are replaced where these counts are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import hot_split_join, nested, of_row, quoted, saved, scratch, table, unnested

#: log2 of the registers of a sketch: a relative standard error of 1.04 / sqrt(1024), 3.3 %.
LG_K = 10

KEYS = ["k1", "k2"]


def _long_enough(line: Column, min_words: int, min_chars: int) -> Column:
    words = line.rlike(r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){" + str(min_words - 1) + r"}[^\x20\x09-\x0D]")
    return words | ((F.length(line) >= min_chars) & line.rlike(r"[^\x20\x09-\x0D]"))


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int, min_chars: int) -> DataFrame:
    """(doc, th, site, pos, k1, k2): the lines that are long enough. th: a hash of the whole text."""
    site = F.coalesce(F.concat(F.lit("s"), quoted(site_col).cast("string")), F.lit("n"))
    split = docs.select(quoted(id_col).alias("doc"), F.xxhash64(quoted(text_col)).alias("th"), site.alias("site"), F.posexplode(F.split(quoted(text_col), "\n")).alias("pos", "line"))
    return split.filter(_long_enough(F.col("line"), min_words, min_chars)).select("doc", "th", "site", "pos", F.xxhash64("line").alias("k1"), F.hash("line").alias("k2"))


def without(text: Column, gone: Column) -> Column:
    """A text without the lines at the positions `gone`, which are in order: the stretches between them, joined."""

    def stretch(held: Column, i: Column) -> Column:
        first = F.coalesce(F.get(held["gone"], i - 1), F.lit(-1)) + 1
        return F.slice(held["lines"], first + 1, F.coalesce(F.get(held["gone"], i), F.size(held["lines"])) - first)

    # a struct in an array of one: the lines are cut once, not for each stretch
    held = F.array(F.struct(F.split(text, "\n").alias("lines"), gone.alias("gone")))
    kept = F.transform(held, lambda h: F.flatten(F.transform(F.sequence(F.lit(0), F.size(h["gone"])), lambda i: stretch(h, i))))
    return F.array_join(F.get(kept, 0), "\n")


def boilerplate(lines: DataFrame, total: int, min_sites: int, band: float) -> DataFrame:
    """(k1, k2, n, first): the lines on min_sites sites or more, their number of places and the first of them."""
    place = F.struct("doc", "pos")
    spread = lines.groupBy(*KEYS).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    spread = spread.select(*KEYS, "n", "first", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - band))
    spread = saved(spread, "line-spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + band)).drop("sites")
    near = spread.filter(F.col("sites") <= min_sites * (1 + band)).drop("sites")
    exact = hot_split_join(lines.select(*KEYS, "site"), near.select(*KEYS, "n"), KEYS, "n", total).groupBy(*KEYS).agg(F.count_distinct("site").alias("exact"))
    exact = exact.filter(F.col("exact") >= min_sites).select(*KEYS)
    return saved(sure.unionByName(near.join(exact, KEYS)), "line-boilerplate")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, min_words: int = 3, min_chars: int = 16, band: float = 0.2, counts: bool = True) -> DataFrame:
    """docs with boilerplate lines removed from their text, and with counts the columns n_lines and n_removed.

    band: share of min_sites by which an estimate may be off before an exact count decides, six standard errors.
    """
    with scratch(docs.sparkSession) as keep:
        lines = saved(lines_of(docs, id_col, text_col, site_col, min_words, min_chars), "lines")
        total = lines.count()
        drops = hot_split_join(lines.drop("site"), boilerplate(lines, total, min_sites, band), KEYS, "n", total)
        drops = drops.filter(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
        drops = saved(drops.groupBy("doc", "th").agg(F.array_sort(F.collect_set("pos")).alias("gone")), "line-drops")
        text = of_row(text_col)
        joined = docs.select(nested(docs).alias("row")).join(drops, of_row(id_col).eqNullSafe(F.col("doc")) & (F.xxhash64(text) == F.col("th")), "left")
        n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
        n_removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
        changed = {text_col: F.when(F.col("gone").isNull(), text).otherwise(without(text, F.col("gone")))}
        added = {"n_lines": n_lines, "n_removed": n_removed} if counts else {}
        return keep(unnested(joined, [*[c for c in docs.columns if c not in added], *added], changed | added))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, text, source, string_split(text, chr(10)) AS lines FROM documents),
x AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
b AS (
  SELECT line FROM x WHERE regexp_matches(line, '(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2}[^\x20\x09-\x0D]')
     OR length(line) >= 16 AND regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT site) >= 5),
m AS (
  SELECT x.*, b.line IS NOT NULL AS common, row_number() OVER (PARTITION BY x.line ORDER BY doc_id, pos) AS place
  FROM x LEFT JOIN b ON x.line = b.line),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE common AND place > 1) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT (common AND place > 1)), '') AS text
  FROM m GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE g.text END AS text,
       coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed
FROM l LEFT JOIN g USING (doc_id)
"""
