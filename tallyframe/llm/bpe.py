"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The rank file of a byte-level vocabulary is turned into a tokenizers model: each byte becomes a printable character
(`byte_chars`), each token of the file a string of those, and every split of a token into two tokens becomes a merge at
the token's rank, so that the model merges what the lowest rank says wherever it arises. A text is cut by PATTERN,
each match is encoded on its own, and short matches that have been met are taken from a table of bounded bytes.

Each token has its offsets in bytes and in characters of the text. A token may end inside a character: its character
offsets then take in the whole character, as those of its neighbour do, and `decode_text` puts the bytes of split
characters together before it reads them as UTF-8. Decoding goes from ids to strings of the model and back through the
table to bytes, and gives back the exact bytes of the text.

Defined cases: a null text encodes as an empty one, to no ids. Very long texts are encoded whole. Repeated rows give
equal rows; an empty table gives an empty result; columns beyond id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import map_arrow, quoted, table

#: Bytes of matches and their ids that a worker remembers, beyond which it starts afresh, and characters of the longest such match.
REMEMBERED, SHORT = 64 << 20, 64

#: What Python needs for an entry besides its characters and ids.
ENTRY = 220


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable bytes for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def _spelled(points: list[int]) -> str:
    """Code points as ranges of a character class."""
    found: list[list[int]] = []
    for c in points:
        if found and found[-1][1] == c - 1:
            found[-1][1] = c
        else:
            found.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found)


@lru_cache(maxsize=2)
def newer_characters(classes: tuple[str, ...] = (r"\p{L}", r"\p{N}")) -> str:
    """Ranges of characters that this Python's `regex` puts into the classes and tiktoken's older tables do not.

    tiktoken is asked for the matches of each class among all characters, with single bytes as its tokens.
    """
    import tiktoken

    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    odd: set[str] = set()
    for kind in classes:
        theirs = bytes(tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(everything)).decode()
        odd |= set(regex.findall(kind, everything)) - set(theirs)
    return _spelled(sorted(map(ord, odd)))


class ByteBPE:
    """A byte-level BPE vocabulary, given as ranks of byte strings.

    newer: ranges of characters that count as neither letters nor numbers, though `regex` knows them as such.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: str = ""):
        from tokenizers import Tokenizer, models, pre_tokenizers

        chars = byte_chars()
        text = lambda token: "".join([chars[b] for b in token])
        merges = []
        for token, rank in ranks.items():
            splits = ((token[:i], token[i:]) for i in range(1, len(token)))
            merges += [(rank, ranks[a], ranks[b], text(a), text(b)) for a, b in splits if a in ranks and b in ranks]
        merges.sort()
        self.chars = dict(enumerate(chars))
        self.model = Tokenizer(models.BPE(vocab={text(t): r for t, r in ranks.items()}, merges=[m[3:] for m in merges], ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")  # no byte's character is a line feed
        bytes_of = {c: b for b, c in enumerate(chars)}
        self.table = {r: bytes([bytes_of[c] for c in self.model.id_to_token(r)]) for r in ranks.values()}
        top = max(self.table, default=-1) + 1
        pieces = [self.table.get(r, b"") for r in range(top)]
        self.lengths = np.fromiter(map(len, pieces), np.int64, top)
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.plain = regex.compile(pattern).findall
        apart = {r"\p{L}": rf"[\p{{L}}--[{newer}]]", r"\p{N}": rf"[\p{{N}}--[{newer}]]"}
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{newer}]]") if newer else pattern
        for kind, less in apart.items() if newer else ():
            strict = regex.sub(rf"(?<!\^\\s){regex.escape(kind)}(?=\+)", lambda m, less=less: less, strict)
        self.strict = regex.compile("(?V1)" + strict).findall
        self.odd = re.compile(f"[{newer}]").search if newer else lambda x: None
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def from_file(cls, path: str, pattern: str, newer: str = "") -> ByteBPE:
        with open(path, "rb") as f:
            return cls(read_ranks(f.read()), pattern, newer)

    def cut(self, text: str) -> list[str]:
        """The matches of the pattern, in order."""
        return self.plain(text) if text.isascii() or not self.odd(text) else self.strict(text)

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Encodes the matches that aren't known yet; the long ones, which are not remembered, are returned."""
        if self.held > REMEMBERED:
            self.known, self.held = {}, 0
        new, long = [p for p in pieces if p not in self.known], {}
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            found = self.model.encode("\n".join([p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.chars) for p in part]), add_special_tokens=False)
            ends = np.searchsorted(np.array(found.word_ids), np.arange(1, len(part) + 1)).tolist()
            at, blob = 0, np.array(found.ids, "<i4").tobytes()
            for piece, end in zip(part, ends):
                if len(piece) > SHORT:
                    long[piece] = blob[4 * at : 4 * end]
                else:
                    self.known[piece] = blob[4 * at : 4 * end]
                    self.held += 4 * (end - at) + len(piece) + ENTRY
                at = end
        return long

    def gather(self, pieces: list[str], long: dict[str, bytes]) -> np.ndarray:
        """The ids of matches that are known, or among the long ones."""
        ids = [self.known[p] if len(p) <= SHORT else long[p] for p in pieces] if long else map(self.known.__getitem__, pieces)
        return np.frombuffer(b"".join(ids), "<i4")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.cut(t) for t in texts]
        long = self.learn(set().union(*cut))
        return [self.gather(pieces, long) for pieces in cut]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids) -> bytes:
        """The bytes of ids, by the table from the model's characters back to bytes."""
        ids = np.asarray(ids, np.int64)
        if len(ids) < 8:
            return b"".join([self.table[i] for i in ids.tolist()])
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode_text(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no whole character, as at the ends of a cut, become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """First byte, end byte, first character and end character of each token of a text that PATTERN covers."""
        sizes = self.lengths[np.asarray(ids, np.int64)]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if text.isascii():
            return starts, ends, starts, ends
        # how many characters have begun up to a byte, itself included
        begun = np.cumsum(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0 != 0x80)
        return starts, ends, begun[starts] - 1, begun[ends - 1]


def _loaded(*key: str) -> ByteBPE:
    """The vocabulary of a path, pattern and newer characters, read once in a worker process.

    Functions come to workers by value, with each task anew, so what outlives a task is kept in a module of its own.
    """
    kept = sys.modules.setdefault("_tallyframe_vocabularies", types.ModuleType("_tallyframe_vocabularies"))
    if getattr(kept, "key", None) != key:
        kept.key, kept.bpe = key, ByteBPE.from_file(*key)
    return kept.bpe


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


#: The offsets of tokens: arrays as long as ids.
OFFSETS = ("byte_start", "byte_end", "char_start", "char_end")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded, *OFFSETS): the ids of each whole text, the bytes that they decode to, and where each token lies.

    path: a rank file that every executor has, as part of its installed libraries.
    """
    rows = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    newer = newer_characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path, pattern, newer)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = bpe.encode_all(texts)
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                places = zip(*[bpe.offsets(t, i) for t, i in zip(texts, ids)])
                arrays = [pa.ListArray.from_arrays(ends, np.concatenate(x).astype(np.int32)) for x in (ids, *places)]
                columns = [part.column(0), arrays[0], pa.array([bpe.decode(i) for i in ids], pa.binary()), *arrays[1:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded", *OFFSETS])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary, "
    return map_arrow(rows, run, schema + ", ".join(f"{c} array<int>" for c in OFFSETS))


def slices(batch: pa.RecordBatch, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes each, one row at least; no row is cut."""
    size = max(1, batch.num_rows * most // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode() gives, in short."""
    found = encode(docs, path, pattern, id_col, text_col)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), *default_vocabulary())
