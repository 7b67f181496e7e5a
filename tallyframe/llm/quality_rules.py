"""Quality rules whose thresholds come from mergeable quantile sketches per language and source.

Each document gets its base counts, and from them METRICS, whole numbers. A sketch is a histogram that keeps three
significant digits of a value (an HDR histogram): its cells are counts, so sketches merge by addition, in any order, to
the same sketch, and a quantile is off by under 1 %. There is one sketch a metric for each (language, source), for each
language and for all documents, the coarser ones merged from the finer.

A group's fence comes from its own quantiles, alike for all metrics. It starts `spread` times the distance from the
median to the upper quartile above that quartile; where that distance is below what the metric can resolve, one event in a
document of the group's lower quartile of length, the resolution stands for it. From there it climbs RUNGS, the higher
quantiles: one that lies within the fence so far belongs to the same tail and moves the fence to `spread` times its own
distance from the median above it; one beyond the fence, after a gap, ends the climb. A small share of documents of
another kind so leaves a group's fence where the others put it, and a long but unbroken tail passes. Metrics with a lower
fence have it by the mirrored rule.

A group of fewer than `min_docs` documents takes the fences of its language, and a language of fewer takes those of all
documents, as their high quantiles would be single documents. Only documents that pass the base rules are sketched.
Thresholds are joined to the documents by language and source, and a document is kept if it is inside all fences.

Defined cases: a null or empty text has no words and fails the base rules. A null language or source is a group of its
own. Rows that repeat count as often as they occur. An empty table gives an empty result. Columns beyond id, text,
language and source are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import lookup, map_arrow, quoted, saved, scratch, table

#: Metric: (numerator, denominator, scale, sides). Values are scale * numerator / denominator, rounded down.
METRICS = {
    "symbols": ("n_symbols", "n_words", 1000, "upper"),
    "shouting": ("n_upper", "word_chars", 1000, "upper"),
    "marks": ("n_marks", "n_words", 1000, "upper"),
    "repeats": ("n_repeat_words", "n_words", 1000, "upper"),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, "upper"),
    "word_length": ("word_chars", "n_words", 100, "both"),
}

#: The denominators, whose sketches tell what a metric can resolve.
SIZES = tuple(dict.fromkeys(x[1] for x in METRICS.values()))

#: Quantiles in thousandths that a fence climbs beyond the quartile, and those mirrored for lower fences.
RUNGS = (800, 850, 900, 920, 940, 950, 960, 970, 980, 985, 990, 995)

#: Documents below which a group takes a coarser group's fences, and how many of its distances a tail may reach on.
MIN_DOCS, SPREAD = 400, 3

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]

_SYMBOL = re.compile(r"[#*$%&|<>]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_MARK = re.compile(r"[!?;:\"'()\[\]{}=+/\\@^~_`-]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


def repeated(words: list[bytes], width: int = 3) -> int:
    """How many words lie in a window of `width` words that occurs twice or more."""
    if len(words) <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter([known.setdefault(w, len(known)) for w in words], np.int64, len(words))
    code = ids[: len(ids) - width + 1]
    for i in range(1, width):
        code = np.unique(code * len(known) + ids[i : len(ids) - width + 1 + i], return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    edges = np.zeros(len(ids) + 1, np.int64)
    edges[: len(twice)] += twice
    edges[width:] -= twice
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text. n_lines: lines with a word; n_upper and n_marks: Latin capitals and ASCII marks that are no symbols, end marks of sentences left out but for ! and ?."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return (0,) * len(COUNTS)
    span = lambda find: sum([len(x) for x in find(text)])
    lines = [x for x in text.split("\n") if x.strip("\x20\x09\x0A\x0B\x0C\x0D")]
    return (len(words), len(text) - span(_SPACE.findall), span(_SYMBOL.findall), len(lines) - len(set(lines)), repeated(words), len(lines), span(_UPPER.findall), span(_MARK.findall))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, *COUNTS), one row for each of docs."""
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(lang_col).alias("lang"), quoted(source_col).alias("source"), quoted(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([counts(x.as_py()) for x in batch.column(3)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c) for c in found.T]], ["doc_id", "lang", "source", *COUNTS])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("doc_id", "lang", "source")]
    return map_arrow(rows, run, ", ".join([*kinds, *[f"{c} long" for c in COUNTS]]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metric(name: str) -> Column:
    over, under, scale, _ = METRICS[name]
    return F.when(F.col(under) > 0, F.floor(F.lit(scale) * F.col(over) / F.col(under))).otherwise(F.lit(0)).cast("long")


def cell(value: Column) -> Column:
    """The lower end of the sketch's cell: the value's first three digits."""
    unit = F.pow(F.lit(10.0), F.greatest(F.length(value.cast("string")) - 3, F.lit(0))).cast("long")
    return value - value % unit


def sketches(measures: DataFrame) -> DataFrame:
    """(lang, source, metric, cell, n): the sketches of METRICS and SIZES of each language and source."""
    values = {**{m: metric(m) for m in METRICS}, **{c: F.col(c) for c in SIZES}}
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), cell(v).alias("cell")) for m, v in values.items()]))
    return measures.select("lang", "source", pairs.alias("m")).groupBy("lang", "source", "m.metric", "m.cell").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: dict[int, int], thousandths: Iterable[int]) -> list[int]:
    """The least cell up to which at least so many thousandths of a sketch's values lie."""
    cells = np.array(sorted(sketch), np.int64)
    upto = np.cumsum([sketch[c] for c in cells.tolist()])
    return cells[np.searchsorted(1000 * upto, np.array(list(thousandths)) * upto[-1])].tolist()


def fence(sketch: dict[int, int], unit: int, spread: int, sides: str) -> tuple[int, int]:
    """The upper and the lower fence of a metric; a metric without a lower one has -1."""

    def climbed(median: int, quartile: int, rungs: list[int]) -> int:
        at = quartile + spread * max(quartile - median, unit)
        for rung in rungs:
            if rung <= at:
                at = max(at, rung + spread * (rung - median))
        return at

    median, quartile, *rungs = quantiles(sketch, (500, 750, *RUNGS))
    upper = climbed(median, quartile, rungs)
    if sides == "upper":
        return upper, -1
    quartile, *rungs = quantiles(sketch, (250, *[1000 - r for r in RUNGS]))
    return upper, -climbed(-median, -quartile, [-r for r in rungs])


def group_fences(sketches: dict[str, dict[int, int]], spread: int) -> tuple[int, ...]:
    """The documents of a group, and upper and lower fence of each metric; nothing but nulls for a group of none."""
    if not sketches:
        return (0, *[None] * (2 * len(METRICS)))
    found = [sum(sketches[SIZES[0]].values())]
    for m, (_, under, scale, sides) in METRICS.items():
        found += fence(sketches[m], -(-scale // max(1, *quantiles(sketches[under], (250,)))), spread, sides)
    return tuple(found)


FENCES = [f"{m}_{side}" for m in METRICS for side in ("upper", "lower")]


def fences(cells: DataFrame, by: list[str], spread: int) -> DataFrame:
    """(*by, docs, *FENCES) from sketches, merged to the groups `by`.

    A group's sketches come together in one row: a few hundred cells a decade and metric, however many documents it has.
    """
    merged = cells.groupBy(*by, "metric", "cell").agg(F.sum("n").alias("n"))
    rows = merged.groupBy(*by).agg(F.collect_list(F.struct("metric", "cell", "n")).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for cells in batch.column(len(by)):
                held: dict[str, dict[int, int]] = {}
                for x in cells.as_py():
                    held.setdefault(x["metric"], {})[x["cell"]] = x["n"]
                found.append(group_fences(held, spread))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *[pa.array(c, pa.int64()) for c in zip(*found)]], [*by, "docs", *FENCES])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in by]
    return map_arrow(rows, run, ", ".join([*kinds, *[f"{c} long" for c in ("docs", *FENCES)]]))


def thresholds(cells: DataFrame, min_docs: int, spread: int) -> DataFrame:
    """(lang, source, level, *FENCES), one row for each language and source of the sketches."""
    cells = saved(cells, "quality-sketches")
    fine, mid = fences(cells, ["lang", "source"], spread), fences(cells, ["lang"], spread)
    mid = saved(mid.select("lang", *[F.col(c).alias(f"{c}_lang") for c in ("docs", *FENCES)]), "quality-languages")
    whole = fences(cells, [], spread).first().asDict()  # one row of numbers
    joined = lookup(fine, mid, ["lang"])
    pick = lambda own, lang, every: F.when(F.col("docs") >= min_docs, own).when(F.col("docs_lang") >= min_docs, lang).otherwise(every)
    marks = [pick(F.col(c), F.col(f"{c}_lang"), F.lit(whole[c]).cast("long")).alias(c) for c in FENCES]
    return joined.select("lang", "source", pick(F.lit("source"), F.lit("lang"), F.lit("all")).alias("level"), *marks)


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, spread: int = SPREAD, **columns: str) -> DataFrame:
    """(doc_id, lang, source, *COUNTS, base_failed, level, failed, kept): failed lists the metrics outside their fences."""
    with scratch(docs.sparkSession) as keep:
        rows = saved(measured(docs, **columns).withColumn("base_failed", base_failed()), "quality-counts")
        marks = saved(thresholds(sketches(rows.filter("not base_failed")), min_docs, spread), "quality-thresholds")
        joined = lookup(rows, marks, ["lang", "source"])
        outside = lambda m: (metric(m) > F.col(f"{m}_upper")) | (metric(m) < F.col(f"{m}_lower"))
        failed = F.filter(F.array(*[F.when(outside(m), F.lit(m)) for m in METRICS]), lambda x: x.isNotNull())
        failed = F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(failed)
        out = joined.select("doc_id", "lang", "source", *COUNTS, "base_failed", "level", failed.alias("failed"))
        return keep(out.withColumn("kept", F.size("failed") == 0))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    value = lambda m: f"CASE WHEN {METRICS[m][1]} > 0 THEN ({METRICS[m][2]} * {METRICS[m][0]}) // {METRICS[m][1]} ELSE 0 END"
    under = "CASE metric " + " ".join(f"WHEN '{m}' THEN '{x[1]}'" for m, x in METRICS.items()) + " END"
    scale = "CASE metric " + " ".join(f"WHEN '{m}' THEN {x[2]}" for m, x in METRICS.items()) + " END"
    both = ", ".join(f"'{m}'" for m, x in METRICS.items() if x[3] == "both")
    points = sorted({250, 500, 750, *RUNGS, *[1000 - r for r in RUNGS]})

    def fence(name: str, by: str) -> str:
        key = f"{by}, " if by else ""
        same = " AND ".join([*[f"q.{k} IS NOT DISTINCT FROM z.{k}" for k in by.split(", ") if k], f"z.metric = {under.replace('metric', 'q.metric')}"])
        up = f"(SELECT *, q750 + {SPREAD} * greatest(q750 - q500, unit) AS u, q250 - {SPREAD} * greatest(q500 - q250, unit) AS l FROM {name}_u)"
        for r in RUNGS:
            low = f"q{1000 - r}"
            up = f"(SELECT * REPLACE (CASE WHEN q{r} <= u THEN greatest(u, q{r} + {SPREAD} * (q{r} - q500)) ELSE u END AS u, CASE WHEN {low} >= l THEN least(l, {low} - {SPREAD} * (q500 - {low})) ELSE l END AS l) FROM {up})"
        return f"""
{name}_r AS (
  SELECT {key}metric, cell, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY {key}metric ORDER BY cell) AS upto,
         sum(sum(n)) OVER (PARTITION BY {key}metric) AS docs FROM cells GROUP BY {key}metric, cell),
{name}_q AS (
  SELECT {key}metric, max(docs) AS docs, {", ".join(f"min(cell) FILTER (WHERE 1000 * upto >= {p} * docs) AS q{p}" for p in points)}
  FROM {name}_r GROUP BY {key}metric),
{name}_u AS (
  SELECT q.*, ({scale.replace('metric', 'q.metric')} + greatest(z.q250, 1) - 1) // greatest(z.q250, 1) AS unit
  FROM {name}_q q JOIN {name}_q z ON {same}),
{name} AS (
  SELECT {key}metric, docs, u AS upper, CASE WHEN metric IN ({both}) THEN l ELSE -1 END AS lower FROM {up})"""

    return (
        r"""
WITH w AS (
  SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a FROM documents)),
g AS (
  SELECT doc_id, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, b, c) > 1 AS twice FROM g WHERE c IS NOT NULL),
r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS k) WHERE twice GROUP BY doc_id),
l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^!?;:"''()\[\]{}=+/\\@^~_`-]+', '', 'g')) AS n_marks FROM documents),
d AS (
  SELECT s.doc_id, lang, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         CASE WHEN coalesce(n_words, 0) = 0 THEN 0 ELSE n_symbols END::BIGINT AS n_symbols, n_upper, n_marks,
         coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_words, 0) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * coalesce(n_words, 0) AS base_failed
  FROM s LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
v AS ("""
        + " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS metric, ({value(m)})::BIGINT AS v FROM d" for m in METRICS)
        + " UNION ALL "
        + " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{c}' AS metric, {c} AS v FROM d" for c in SIZES)
        + r"""),
cells AS (
  SELECT lang, source, metric, v - v % (10 ** greatest(length(v::VARCHAR) - 3, 0))::BIGINT AS cell, count(*) AS n
  FROM v WHERE NOT base_failed GROUP BY ALL),"""
        + ",".join([fence("fine", "lang, source"), fence("mid", "lang"), fence("whole", "")])
        + f""",
bad AS (
  SELECT v.doc_id, bool_or(
    v.v > CASE WHEN fine.docs >= {MIN_DOCS} THEN fine.upper WHEN mid.docs >= {MIN_DOCS} THEN mid.upper ELSE whole.upper END OR
    v.v < CASE WHEN fine.docs >= {MIN_DOCS} THEN fine.lower WHEN mid.docs >= {MIN_DOCS} THEN mid.lower ELSE whole.lower END) AS bad
  FROM v JOIN fine ON v.metric = fine.metric AND v.lang IS NOT DISTINCT FROM fine.lang AND v.source IS NOT DISTINCT FROM fine.source
  JOIN mid ON v.metric = mid.metric AND v.lang IS NOT DISTINCT FROM mid.lang JOIN whole ON v.metric = whole.metric
  GROUP BY v.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM d LEFT JOIN bad USING (doc_id)
"""
    )


OP5_SQL = _sql()
