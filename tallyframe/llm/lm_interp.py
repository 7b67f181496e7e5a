"""Language-model scores by deleted interpolation of trigrams.

A token's probability after its two predecessors mixes the maximum-likelihood trigram, bigram and unigram and equal shares
for all words, with weights by how often the context occurs: by the power of two of the pair's count, or, of a pair that
doesn't occur, of the last word's. The weights are learned by expectation-maximisation on a part of the training documents
whose counts are left out of the estimates meanwhile (one in FOLDS); the scores use the counts of all training documents.

All counts are over all training documents, in 64 bits, and the whole work is in blocks of documents, so that it stands
words of any frequency and needs no row a token:

1. `blocks`: each task turns its documents into blocks of about `block_tokens` tokens. A block keeps its tokens as
   numbers into the block's own word list, and the 64-bit hashes of these words. Blocks are a table in the scratch folder.
2. `asks`: a block asks for counts with the hashes of its distinct words, pairs and triples, sorted, cut into slices of the
   hash range and packed, with its own counts. `answers`: each slice adds up the counts of all blocks, and answers each
   block in the order that it asked in. There is a slice for SLICE_TOKENS tokens, so that what a task holds doesn't grow.
   Triples are asked for when words and pairs have been answered.
3. `weights` and `scores`: a block meets its answers, and has all it needs.

What is dealt by slice or block is even whatever the text: a block asks once for a word, however often it has it, and never
in more rows than it has distinct words, pairs and triples. Where blocks and slices are so many that rows get short, larger
blocks (`block_tokens`, as memory allows) make them long again.

Defined cases: a null or empty text has one token, the end. The end is also what precedes a text's first token, twice. Rows
that repeat count and are scored as often as they occur; a null id trains. With no training documents all counts are
0 and all words have equal shares. An empty table gives an empty result. Columns beyond id and text are not read. A
task holds a block, or its longest document, in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import free_shuffles, held_out, map_arrow, quoted, saved, scratch, table

#: Training documents whose tokens the weights are learned on: one in so many, by remainder.
FOLDS = 11

#: Part of a document: counted, counted and used to learn the weights, or only scored. A block is COUNTED or FOLD.
COUNTED, FOLD, SCORED = 0, 1, 2

#: The end of a text, as the word of no bytes.
END = b""

#: Cells an octave in which probabilities are gathered to learn the weights, and the least weight of equal shares.
FINE, LEAST = 2, 1e-4

#: Buckets of the counts of a pair, and of those of a word after them.
BUCKETS = 65

#: Tokens of the input for which there is a slice of the hash range, for each kind of count.
SLICE_TOKENS = 4 << 20

#: What is counted, and the bits of its hashes. Sorted and packed, a hash takes these bits less the logarithm of how many there are.
KINDS = {"word": 64, "pair": 56, "triple": 56}


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), 3)


def unpack(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).ravel()


def pack_sorted(hashes: np.ndarray) -> bytes:
    return pack(np.diff(hashes, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64)


def joint_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two 64-bit hashes, by multiplications and shifts."""
    x = (first * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(0xD1B54A32D192ED03) + (first >> np.uint64(7)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def slice_of(hashes: np.ndarray, slices: int, bits: int) -> np.ndarray:
    """The slice of each hash, of slices of equal size in order."""
    return ((hashes >> np.uint64(bits - 32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def _shifted(values: np.ndarray, sizes: np.ndarray, first: int) -> np.ndarray:
    """The value before each; of a text's first, `first`."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[np.cumsum(sizes) - sizes] = first
    return before


class _Block:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {END: 0}
        self.tokens: list[np.ndarray] = []
        self.ids: list = []
        self.counted: list[bool] = []
        self.size = 0

    def add(self, ident, text: str | None, counted: bool) -> None:
        known = self.words
        words = (text or "").encode("utf-8", "replace").lower().split()
        words.append(END)
        self.tokens.append(np.fromiter([known.setdefault(w, len(known)) for w in words], np.uint32, len(words)))
        self.ids.append(ident)
        self.counted.append(counted)
        self.size += len(words)

    def row(self, block: int, part: int) -> tuple:
        """(block, part, size, ids, tokens, rest): rest is the hashes of the words, the documents' sizes, and which of them are counted."""
        sizes = np.fromiter(map(len, self.tokens), "<i8", len(self.tokens))
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), "<u8", len(self.words))
        return block, part, self.size, self.ids, pack(np.concatenate(self.tokens).astype("<u4")), words.tobytes() + sizes.tobytes() + bytes(self.counted)


class _Tokens:
    """What a block's row holds."""

    def __init__(self, documents: int, tokens: bytes, rest: bytes):
        end = len(rest) - 9 * documents
        self.tokens, self.words = unpack(tokens, "<u4"), np.frombuffer(rest, "<u8", end // 8)
        self.sizes = np.frombuffer(rest, "<i8", documents, end)
        self.counted = np.frombuffer(rest, np.bool_, documents, end + 8 * documents)
        self.before = _shifted(self.tokens, self.sizes, 0)

    def hashes(self, kind: str) -> np.ndarray:
        """The hash of the pair or triple that each token ends."""
        before = self.words[self.before]
        if kind == "triple":
            before = joint_hash(self.words[_shifted(self.before, self.sizes, 0)], before)
        return joint_hash(before, self.words[self.tokens]) >> np.uint64(64 - KINDS[kind])

    def asks(self, block: int, part: int, kind: str, slices: int) -> Iterator[tuple]:
        """The rows (block, part, kind, slice, hashes, counts) by which the block asks for the counts of all."""
        counted = np.repeat(self.counted, self.sizes)
        if kind == "word":
            order = np.argsort(self.words)
            asked, counts = self.words[order], np.bincount(self.tokens[counted], minlength=len(self.words))[order]
        elif counted.all():
            asked, counts = np.unique(self.hashes(kind), return_counts=True)
        else:
            hashes = self.hashes(kind)
            order = np.argsort(hashes)
            hashes, counted = hashes[order], counted[order]
            starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            asked, counts = hashes[starts], np.add.reduceat(counted.astype(np.int64), starts)
        edges = np.searchsorted(slice_of(asked, slices, KINDS[kind]), np.arange(slices + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[k], edges[k + 1]
            yield block, part, kind, k, pack_sorted(asked[a:b]), pack(counts[a:b].astype("<i8"))


def part_of(doc_id: Column) -> Column:
    """SCORED for remainder 2 of 7; of the others one in FOLDS is FOLD."""
    fold = F.coalesce(F.floor(F.crc32(doc_id.cast("string")) / 7) % FOLDS == 3, F.lit(False))
    return F.when(held_out(doc_id, 7, 2), F.lit(SCORED)).when(fold, F.lit(FOLD)).otherwise(F.lit(COUNTED))


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for row in rows:  # one at a time: some are large
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, schema.types)], schema=schema)


def blocks(docs: DataFrame, block_tokens: int) -> DataFrame:
    """Rows (block, part, size, ids, tokens, rest) of docs (doc_id, part, text); a block is of the fold or has none of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n, open_blocks, schema = TaskContext.get().partitionId(), 0, {}, None
        for batch in batches:
            schema = schema or pa.schema([("block", pa.int64()), ("part", pa.int32()), ("size", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("tokens", pa.binary()), ("rest", pa.binary())])
            for ident, part, text in zip(*batch.columns):
                counted = part.as_py() != SCORED
                part = FOLD if part.as_py() == FOLD else COUNTED
                block = open_blocks.setdefault(part, _Block())
                block.add(ident.as_py(), text.as_py(), counted)
                if block.size >= block_tokens:
                    yield from _batches([open_blocks.pop(part).row(task << 24 | n, part)], schema)
                    n += 1
        for part in list(open_blocks):
            yield from _batches([open_blocks.pop(part).row(task << 24 | n, part)], schema)
            n += 1

    return map_arrow(docs, run, f"block long, part int, size long, ids array<{docs.schema['doc_id'].dataType.simpleString()}>, tokens binary, rest binary")


def asks(made: DataFrame, kinds: tuple[str, ...], slices: int) -> DataFrame:
    """(block, part, kind, slice, hashes, counts): what the blocks ask for."""
    schema = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("slice", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, n, tokens, rest in zip(*(c.to_pylist() for c in batch.columns[:3]), *batch.columns[3:]):
                held = _Tokens(n, tokens.as_py(), rest.as_py())
                for kind in kinds:
                    yield from _batches(held.asks(block, part, kind, slices), schema)

    return map_arrow(made.select("block", "part", F.size("ids").alias("n"), "tokens", "rest"), run, "block long, part int, kind string, slice int, hashes binary, counts binary")


def answers(asked: DataFrame) -> DataFrame:
    """(block, kind, slice, payload, rest): the counts of what each block asks; rest, for blocks of the fold, those without the fold.

    Block -1 has, for each kind and slice, the numbers of distinct hashes and of all, without the fold and with it.
    """

    def run(group: pa.Table) -> pa.Table:
        kind, k = group["kind"][0].as_py(), group["slice"][0].as_py()
        hashes = [unpack_sorted(x.as_py()) for x in group["hashes"]]
        starts = np.cumsum([0] + [len(h) for h in hashes])
        known, at = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        sums = np.zeros((2, len(known)), np.int64)
        for start, end, part, own in zip(starts, starts[1:], group["part"].to_pylist(), group["counts"]):
            sums[part][at[start:end]] += unpack(own.as_py(), "<i8")  # a block's hashes are distinct
        whole = sums.sum(0)
        stat = np.array([np.count_nonzero(sums[0]), sums[0].sum(), np.count_nonzero(whole), whole.sum()], "<i8").tobytes()
        rows = [(-1, kind, k, stat, None)]
        for block, part, start, end in zip(group["block"].to_pylist(), group["part"].to_pylist(), starts, starts[1:]):
            places = at[start:end]
            rows.append((block, kind, k, pack(whole[places]), pack(sums[0][places]) if part == FOLD else None))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "kind", "slice", "payload", "rest"])

    return asked.groupBy("kind", "slice").applyInArrow(run, "block long, kind string, slice int, payload binary, rest binary")


class _Counts(_Tokens):
    """A block with the counts of its words, pairs and triples, from its row and the column `of` of its answers.

    pair, triple: of what each token ends; context: of the two tokens before it.
    """

    def __init__(self, group: pa.Table, of: str):
        parts: dict[str, dict[int, np.ndarray]] = {kind: {} for kind in KINDS}
        for i, (kind, k) in enumerate(zip(group["kind"].to_pylist(), group["slice"].to_pylist())):
            if kind == "block":
                self.ids = group["ids"][i]
                super().__init__(len(self.ids), group["payload"][i].as_py(), group["rest"][i].as_py())
            else:
                parts[kind][k] = unpack(group[of][i].as_py(), "<i8")
        put = lambda kind: np.concatenate([parts[kind].pop(k) for k in sorted(parts[kind])])
        self.word = np.empty(len(self.words), np.int64)
        self.word[np.argsort(self.words)] = put("word")
        self.pair, self.triple = (put(kind)[np.unique(self.hashes(kind), return_inverse=True)[1]] for kind in ("pair", "triple"))
        self.context = _shifted(self.pair, self.sizes, self.word[0])  # a text's first token follows the end of another

    def parts(self, most: int = 1 << 18) -> Iterator[tuple[slice, slice]]:
        """Documents and their tokens, about `most` tokens at a time."""
        ends, first = np.cumsum(self.sizes), 0
        while first < len(ends):
            start = ends[first] - self.sizes[first]
            last = max(first + 1, int(np.searchsorted(ends, start + most, "right")))
            yield slice(first, last), slice(start, ends[last - 1])
            first = last

    def shares(self, tokens: slice, total: int) -> tuple[np.ndarray, ...]:
        """The bucket of each token's context, and the maximum-likelihood trigram, bigram and unigram."""
        context, before, word = self.context[tokens], self.word[self.before[tokens]], self.word[self.tokens[tokens]]
        return bucket(context, before), self.triple[tokens] / np.maximum(context, 1), self.pair[tokens] / np.maximum(before, 1), word / max(total, 1)


def bucket(context: np.ndarray, before: np.ndarray) -> np.ndarray:
    """By the count of two words: one more than the whole part of its base-2 logarithm; if that is 0, by the last word's, beyond BUCKETS."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], BUCKETS + np.frexp(before.astype(np.float64))[1])


def weights(met: DataFrame, distinct: int, total: int, rounds: int = 100) -> np.ndarray:
    """The weights of trigram, bigram, unigram and equal shares for each bucket, from the blocks of the fold and their answers."""

    def run(group: pa.Table) -> pa.Table:
        c, found = _Counts(group, "rest"), []
        fine = lambda p: np.where(p > 0, np.rint(np.log2(np.where(p > 0, p, 1)) * FINE), 1).astype(np.int64)
        for _, tokens in c.parts():
            at, *shares = c.shares(tokens, total)
            cells, n = np.unique(np.stack([at, *map(fine, shares)]), axis=1, return_counts=True)
            found.append([*cells, n])
        return pa.table([np.concatenate(x).astype(np.int64) for x in zip(*found)], names=["bucket", "triple", "pair", "word", "n"])

    def learned(group: pa.Table) -> pa.Table:
        at, *logs, n = (c.to_numpy() for c in group.columns)
        order = np.lexsort(logs)  # the same in each run
        p = np.stack([*(np.where(x <= 0, np.exp2(x / FINE), 0.0) for x in logs), np.full(len(n), 1 / (distinct + 1))], axis=1)[order]
        held, mix = n[order].astype(np.float64), np.full(4, 1 / 4)
        for _ in range(rounds):
            part = p * mix
            part /= part.sum(1, keepdims=True)
            mix, last = (held[:, None] * part).sum(0) / held.sum(), mix
            if np.abs(mix - last).max() < 1e-9:
                break
        mix[3] = max(mix[3], LEAST)
        return pa.table([pa.array([int(at[0])]), pa.array([(mix / mix.sum()).tolist()])], names=["bucket", "mix"])

    cells = met.groupBy("block").applyInArrow(run, "bucket long, triple long, pair long, word long, n long").groupBy("bucket", "triple", "pair", "word").agg(F.sum("n").alias("n"))
    out = np.tile(np.array([0.4, 0.3, 0.2, 0.1]), (2 * BUCKETS, 1))
    out[BUCKETS:] = [0.0, 0.5, 0.4, 0.1]
    out[BUCKETS] = [0.0, 0.0, 0.8, 0.2]
    for r in cells.groupBy("bucket").applyInArrow(learned, "bucket long, mix array<double>").collect():  # a row a bucket
        out[r["bucket"]] = r["mix"]
    return out


def scores(met: DataFrame, kind: str, mix: np.ndarray, distinct: int, total: int) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) from all blocks and their answers."""

    def run(group: pa.Table) -> pa.Table:
        c, found = _Counts(group, "payload"), []
        for docs, tokens in c.parts():
            word = c.word[c.tokens[tokens]]
            at, *shares = c.shares(tokens, total)
            p = sum(w * s for w, s in zip(mix[at].T, [*shares, 1 / (distinct + 1)]))
            starts = np.cumsum(c.sizes[docs]) - c.sizes[docs]
            found.append([np.add.reduceat(x, starts) for x in ((word > 0).astype(np.int64), np.log10((word + 1.0) / (total + distinct + 1)), np.log10(p))])
        return pa.table([c.ids.values, c.sizes, *[np.concatenate(x) for x in zip(*found)]], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return met.groupBy("block").applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: Column | None = None, block_tokens: int = 2_000_000) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), one row for each of docs.

    part: the part of each document, by default part_of() its id.
    """
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).alias("doc_id"), (part_of(quoted(id_col)) if part is None else part).cast("int").alias("part"), quoted(text_col).alias("text"))
    with scratch(spark) as keep:
        made = saved(blocks(rows, block_tokens), "lm-blocks")
        slices = max(8, (made.agg(F.sum("size")).first()[0] or 0) // SLICE_TOKENS)
        found = []
        for kinds in (("word", "pair"), ("triple",)):
            found.append(saved(answers(asks(made, kinds, slices)), "lm-answers"))
            free_shuffles(spark)  # what was asked is answered, and is the most that this moves
        stats = [np.frombuffer(r["payload"], "<i8") for r in found[0].filter("block = -1 and kind = 'word'").select("payload").toLocalIterator()]
        rest_distinct, rest_total, distinct, total = (int(x) for x in (np.sum(stats, axis=0) if stats else np.zeros(4)))
        kind = rows.schema["doc_id"].dataType.simpleString()
        given = found[0].unionByName(found[1]).filter("block >= 0").select("block", "kind", "slice", F.lit(None).cast(f"array<{kind}>").alias("ids"), "payload", "rest")
        met = made.select("block", F.lit("block").alias("kind"), F.lit(0).alias("slice"), "ids", F.col("tokens").alias("payload"), "rest", "part")
        fold, met = met.filter(F.col("part") == FOLD).drop("part"), met.drop("part")
        mix = weights(fold.unionByName(given.filter("rest is not null").drop("payload").withColumn("payload", F.lit(None).cast("binary"))), rest_distinct, rest_total)
        if not total:
            mix = np.tile(np.array([0.0, 0.0, 0.0, 1.0]), (len(mix), 1))
        out = scores(met.unionByName(given.drop("rest").withColumn("rest", F.lit(None).cast("binary"))), kind, mix, distinct, total)
        return keep(out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
