"""Language identification by prediction by partial matching over bytes.

Each language has a byte context tree of orders 0 to ORDER, learned once and then frozen. A byte that its context has
seen n times among N, with d distinct bytes, has probability n / (N + d); the escape has d / (N + d), and is shared
among the bytes that the context has not seen, in proportion to the next shorter context (method C with exclusion,
ending at equal shares for all 256 bytes). Every context's probabilities add up to 1, so the sum of -log2 is the exact
length in bits of coding a text with that tree. The language with the shortest code is the prediction.

As the statistics are frozen, a byte's cost follows from it and the ORDER bytes before it. A tree is flattened to a
table of costs, one row a context that was seen, and an index from any ORDER bytes to the row of their longest seen
suffix; whole texts are scored by two look-ups a byte and language. Texts are read in lower case with each run of
characters that are no letters as one space. Bytes that a language's training text lacks share one symbol of its tree.

Training texts are a sample: texts are cut into pieces of up to PIECE characters, and a language's pieces are all taken, or,
of a language with more than `sample_bytes` bytes, those whose hash falls below the share that gives about so many; a piece
that occurs again counts once. Nothing else is sampled: each text is scored whole. Trees are learned by the executors,
one language a task, and shared MODEL_BYTES at a time: with more languages than that holds, the documents are scored in
several passes, whose results are merged.

Besides the score, the share of 2 ** -bits that the best language has among all, there is the gain: how much shorter the code is
than that by the best language's frequencies of single bytes. A text that gains nothing isn't in any language learned,
whatever its score.

Defined cases: null or empty texts and texts without a letter are `und` with score 0, as is all if there is nothing to
learn from. Of equal code lengths the first language by name wins. Rows that repeat get equal predictions; an empty
table gives an empty result; a null id is never held out. Columns beyond id, text and language are not read, and kept
whatever their names; those named as a result are replaced, or, where only kept rows are asked for, left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.common import held_out, lookup, map_arrow, nested, quoted, saved, scratch, table, unnested

ORDER = 3

UNKNOWN = "und"

#: Characters of a piece of training text, and bytes of trees that the driver and each worker hold at a time.
PIECE, MODEL_BYTES = 4096, 128 << 20

_GAP = re.compile(r"[\W\d_]+")


def readable(text: str | None) -> bytes:
    """A text as the trees read it; empty if it has no letter."""
    out = _GAP.sub(" ", (text or "").lower()).strip(" ")
    return b" " + out.encode("utf-8", "replace") + b" " if out else b""


def alphabet(texts: list[bytes]) -> np.ndarray:
    """The symbol of each byte: 0 for bytes that no text has, then one for each."""
    seen = np.zeros(256, bool)
    for t in texts:
        seen[np.frombuffer(t, np.uint8)] = True
    return np.where(seen, np.cumsum(seen), 0).astype(np.int32)


class ContextTree:
    """A frozen tree: the symbol of each byte, costs[row, symbol] in bits, and the row of each context of ORDER symbols."""

    def __init__(self, texts: list[bytes]):
        self.symbols = symbols = alphabet(texts)
        symbols[32] = symbols[32] or symbols.max() + 1
        self.size = a = int(symbols.max()) + 1
        start = int(symbols[32])
        pad = np.full(ORDER, start, np.int32)
        stream = np.concatenate([np.concatenate([pad, symbols[np.frombuffer(t, np.uint8)]]) for t in texts] or [pad]).astype(np.int64)
        real = np.concatenate([np.arange(len(t) + ORDER) >= ORDER for t in texts] or [np.zeros(ORDER, bool)])
        at = np.flatnonzero(real)
        others = 256 - np.count_nonzero(symbols)
        share = np.full(a, 1 / 256)
        share[0] = others / 256
        rows, index, parts, held = share[None, :], np.zeros(1, np.int64), [], 0
        for order in range(ORDER + 1):
            context = np.zeros(len(at), np.int64)
            for back in range(order, 0, -1):
                context = context * a + stream[at - back]
            seen, where = np.unique(context, return_inverse=True)
            n = np.bincount(where * a + stream[at], minlength=len(seen) * a).reshape(-1, a).astype(np.float64)
            rest = np.where(n > 0, 0.0, rows[index[seen % a ** max(order - 1, 0)]])
            left, total, kinds = rest.sum(1, keepdims=True), n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
            escape = np.where(left > 0, kinds, 0)  # a context that has seen every symbol has no escape
            parts.append((n + escape * rest / np.where(left > 0, left, 1)) / (total + escape) if len(seen) or order else share[None, :])
            if order:  # contexts that were not seen go where their suffix goes
                index = np.tile(index, a)
                index[seen] = held + np.arange(len(seen))
            held += len(parts[-1])
            rows = np.concatenate(parts)
        bits = -np.log2(np.maximum(rows, 1e-30))
        bits[:, 0] += np.log2(max(others, 1))
        self.costs, self.index = bits.astype(np.float32).ravel(), index.astype(np.int32)


    def parts(self) -> tuple[bytes, bytes, bytes]:
        """The tree as bytes, for a table."""
        return self.symbols.tobytes(), self.costs.tobytes(), self.index.tobytes()

    @classmethod
    def restored(cls, symbols: bytes, costs: bytes, index: bytes) -> ContextTree:
        tree = cls.__new__(cls)
        tree.symbols, tree.costs, tree.index = np.frombuffer(symbols, np.int32), np.frombuffer(costs, np.float32), np.frombuffer(index, np.int32)
        tree.size = int(tree.symbols.max()) + 1
        return tree

    def bits(self, stream: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The code lengths of texts. stream: all texts' bytes, ORDER spaces before each; inside: which bytes after the first of these are a text's."""
        symbols = self.symbols[stream]
        context = np.zeros(len(stream) - ORDER, np.int32)
        for back in range(ORDER):
            context *= np.int32(self.size)
            context += symbols[back : len(stream) - ORDER + back]
        cost = self.costs[self.index[context] * np.int64(self.size) + symbols[ORDER:]]
        cost[~inside] = 0
        return np.add.reduceat(cost, starts, dtype=np.float64)

    def single(self) -> np.ndarray:
        """The cost of each byte without a context."""
        return self.costs[: self.size][self.symbols].astype(np.float64)


class LanguageModel:
    """A tree for each of some languages, in the order of their names."""

    def __init__(self, trees: dict[str, ContextTree]):
        self.names = sorted(trees)
        self.trees = [trees[n] for n in self.names]

    @classmethod
    def of_texts(cls, samples: dict[str, list[bytes]]) -> LanguageModel:
        return cls({name: ContextTree(texts) for name, texts in samples.items()})

    def bits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths by the trees and by single bytes, a row for each text and a column for each language."""
        out, single = np.zeros((len(texts), len(self.names))), np.zeros((len(texts), len(self.names)))
        full = [i for i, t in enumerate(texts) if t]
        if not full or not self.names:
            return out, single
        gap = b" " * ORDER
        stream = np.frombuffer(gap + gap.join([texts[i] for i in full]), np.uint8)
        starts = np.cumsum([0] + [len(texts[i]) + ORDER for i in full[:-1]])
        inside = np.ones(len(stream) - ORDER, bool)
        for back in range(1, ORDER + 1):
            inside[starts[1:] - back] = False
        for k, tree in enumerate(self.trees):
            out[full, k] = tree.bits(stream, starts, inside)
        of = np.repeat(np.arange(len(full)) << 8, [len(texts[i]) for i in full])
        counts = np.bincount(of + np.frombuffer(b"".join([texts[i] for i in full]), np.uint8), minlength=len(full) << 8).reshape(-1, 256)
        single[full] = counts @ np.stack([tree.single() for tree in self.trees], axis=1)
        return out, single

    def judge(self, texts: list[bytes], before: list[tuple] | None = None) -> list[tuple]:
        """(name, bits, total, gain) of each text: the best language, its code length, the sum of 2 ** -bits in units of the best's, and the gain; better than what was found before, by languages of earlier names."""
        bits, single = self.bits(texts)
        found = []
        for i, text in enumerate(texts):
            name, least, total, gain = before[i] if before else (UNKNOWN, math.inf, 0.0, 0.0)
            if text and self.names:
                k = int(bits[i].argmin())
                best = min(least, bits[i, k])
                total = total * 2.0 ** max(best - least, -1000) + float(np.exp2(np.maximum(best - bits[i], -1000)).sum())
                if bits[i, k] < least:
                    name, least, gain = self.names[k], float(bits[i, k]), 1 - float(bits[i, k] / single[i, k])
            found.append((name, least, total, gain))
        return found


def pieces(texts: DataFrame) -> DataFrame:
    """(lang, piece) of (lang, text)."""
    whole = F.octet_length("text") <= PIECE
    cut = F.when(whole, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    return texts.select("lang", F.explode(cut).alias("piece"))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 1 << 20) -> DataFrame:
    """(lang, symbols, costs, index, size), a saved tree for each language in docs, learned from about sample_bytes bytes of text."""
    rows = docs.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).alias("text")).filter("lang is not null and text is not null")
    with scratch(docs.sparkSession) as keep:
        sizes = saved(rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("total")), "langid-sizes")
        steps = 1 << 30
        below = F.least(F.lit(steps), F.floor(F.lit(float(steps) * sample_bytes) / F.greatest(F.col("total"), F.lit(1))) + 1)
        marks = saved(sizes.select("lang", below.cast("long").alias("below")), "langid-shares")
        chosen = lookup(pieces(rows), marks, ["lang"]).filter(F.pmod(F.xxhash64("piece"), F.lit(steps)) < F.col("below")).select("lang", "piece").distinct()

        def run(group: pa.Table) -> pa.Table:
            texts = sorted(group["piece"].to_pylist())
            tree = ContextTree([t for t in map(readable, texts) if t])
            symbols, costs, index = tree.parts()
            size = len(symbols) + len(costs) + len(index)
            return pa.table([pa.array([x], t) for x, t in zip((group["lang"][0].as_py(), symbols, costs, index, size), (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["lang", "symbols", "costs", "index", "size"])

        return keep(saved(chosen.groupBy("lang").applyInArrow(run, "lang string, symbols binary, costs binary, index binary, size long"), "langid-trees"))


def parts_of(trees: DataFrame, most: int = MODEL_BYTES) -> Iterator[dict[str, ContextTree]]:
    """The trees of a table in the order of their names, at most `most` bytes at a time, or one. The driver holds all names and sizes."""
    sizes = sorted((r["lang"], r["size"]) for r in trees.select("lang", "size").collect())
    while sizes:
        taken, held = [], 0
        while sizes and (not taken or held + sizes[0][1] <= most):
            name, size = sizes.pop(0)
            taken.append(name)
            held += size
        rows = trees.filter(F.col("lang").between(taken[0], taken[-1])).select("lang", "symbols", "costs", "index").collect()
        yield {r["lang"]: ContextTree.restored(bytes(r["symbols"]), bytes(r["costs"]), bytes(r["index"])) for r in rows}


_STATE = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("total", T.DoubleType()), T.StructField("gain", T.DoubleType())])


def judged(docs: DataFrame, trees: DataFrame, text_col: str = "text", most: int = MODEL_BYTES) -> DataFrame:
    """(row, state): the rows of docs as structs, and their best language, its code length, the sum of all and the gain."""
    rows = docs.select(nested(docs).alias("row"), quoted(text_col).alias("text"), F.lit(None).cast(_STATE).alias("state"))
    schema = T.StructType([rows.schema["row"], rows.schema["text"], T.StructField("state", _STATE)])

    def passed(rows: DataFrame, part: dict[str, ContextTree]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast({name: tree.parts() for name, tree in part.items()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = LanguageModel({name: ContextTree.restored(*parts) for name, parts in shared.value.items()})
            for batch in batches:
                found, texts, before, held = [], [], [], 0
                for text, state in zip(batch.column(1), batch.column(2).to_pylist()):
                    texts.append(readable(text.as_py()))
                    before.append(tuple(state.values()) if state else (UNKNOWN, math.inf, 0.0, 0.0))
                    held += len(texts[-1])
                    if held > 1 << 20:
                        found += model.judge(texts, before)
                        texts, before, held = [], [], 0
                found += model.judge(texts, before)
                states = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.float64(), pa.float64(), pa.float64()))], ["lang_pred", "bits", "total", "gain"])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), states], ["row", "text", "state"])

        return map_arrow(rows, run, schema)

    part = None
    for following in parts_of(trees, most):
        if part is not None:  # not the last pass
            rows = saved(passed(rows, part), "langid-pass")
        part = following
    return passed(rows, part or {}).drop("text")


def identify(docs: DataFrame, trees: DataFrame, text_col: str = "text", most: int = MODEL_BYTES) -> DataFrame:
    """docs with the columns lang_pred, score and gain."""
    state = F.col("state")
    known = state["lang_pred"] != UNKNOWN
    added = {"lang_pred": state["lang_pred"], "score": F.when(known, 1 / state["total"]).otherwise(F.lit(0.0)), "gain": state["gain"]}
    return unnested(judged(docs, trees, text_col, most), [*[c for c in docs.columns if c not in added], *added], added)


def identified(docs: DataFrame, trees: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, that are in a language learned: of a score of `least` or more, and a code that gains by contexts."""
    state = F.col("state")
    kept = (state["lang_pred"] != UNKNOWN) & (1 / state["total"] >= least) & (state["gain"] > 0)
    return unnested(judged(docs, trees, text_col).filter(kept), docs.columns)


def trained(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The trees of the documents that are not held out: remainder 1 of 3 is held out."""
    return learn(docs.filter(~held_out(quoted(id_col), 3, 1)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), trained(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
