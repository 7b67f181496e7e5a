import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def pair():
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    own = bpe.ByteBPE(ranks, PATTERN, bpe.newer_characters())
    return own, tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_table_of_bytes():
    chars = bpe.byte_chars()
    assert len(set(chars)) == 256 and all(len(c) == 1 and c.isprintable() and c != " " for c in chars)
    assert chars[ord("A")] == "A" and chars[32] == "Ġ"


def test_bundled_tables_agree():
    """The table of bytes and the ids are those of the same vocabulary in the library's own format."""
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = bpe.ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), PATTERN)
    for text in ("Hello world, it's 2024!", "  tabs\tand\n\nlines ", "naïve café – 漢字 😀"):
        assert own.encode(text) == theirs.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(pair, text):
    own, theirs = pair
    ids = own.encode(text)
    assert ids == theirs.encode_ordinary(text)
    assert own.decode(ids) == text.encode() and own.decode_text(ids) == text


def test_runs_spaces_and_scripts(pair):
    own, theirs = pair
    rng, pool = random.Random(7), "aab--== \n\t\r éß漢😀'sST0٣½\xa0　!?."
    for _ in range(3000):
        text = "".join(rng.choice(pool) * rng.choice([1, 1, 2, 5, 17]) for _ in range(rng.randrange(25)))
        assert own.encode(text) == theirs.encode_ordinary(text)


def test_documents(pair, spark, sf_dir):
    own, theirs = pair
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        assert own.encode(r["text"]) == theirs.encode_ordinary(r["text"])


def test_offsets(pair):
    own, _ = pair
    text = "añb 漢😀!"
    ids = own.encode(text)
    data, at = text.encode(), 0
    for (a, b, first, last), i in zip(zip(*own.offsets(text, ids)), ids):
        assert a == at and data[a:b] == own.table[i]
        assert data[a:b] in text[first:last].encode()
        at = b
    assert at == len(data)
    single = [i for i in ids if len(own.table[i]) < 3]
    assert own.decode(single) == b"".join(own.table[i] for i in single)


def test_characters_cut_in_two(pair):
    own, _ = pair
    ids = own.encode("𘥄")
    assert len(ids) > 1 and own.decode_text(ids) == "𘥄"
    assert "�" in own.decode_text(ids[:-1])
    assert len({o[2:] for o in zip(*own.offsets("𘥄", ids))}) == 1


def test_memory_of_matches_is_bounded(pair, monkeypatch):
    own, theirs = pair
    monkeypatch.setattr(bpe, "REMEMBERED", 20_000)
    for k in range(20):
        text = " ".join(f"word{k}x{i}" for i in range(50)) + " " + "y" * 300_000
        assert own.encode(text) == theirs.encode_ordinary(text)
        assert own.held <= 20_000 + 200 * (bpe.ENTRY + 40)
    assert max(map(len, own.known)) <= bpe.SHORT


def test_operator(spark, pair):
    _, theirs = pair
    rows = [(1, "Hello\nworld", 5), (2, None, 5), (3, "", 5), (3, "", 5), (4, "é" * 200_000, 5), (None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    for got, (i, text, _) in zip(sorted(bpe.digests(docs, PATH, PATTERN).collect(), key=lambda r: (r["doc_id"] or 99)), sorted(rows, key=lambda r: r[0] or 99)):
        ids = theirs.encode_ordinary(text or "")
        assert (got["doc_id"], got["n_tokens"]) == (i, len(ids))
        assert got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    full = {r["doc_id"]: r for r in bpe.encode(docs.filter("doc_id < 4"), PATH, PATTERN).collect()}
    assert full[1]["ids"] == theirs.encode_ordinary("Hello\nworld") and bytes(full[1]["decoded"]) == b"Hello\nworld"
    assert full[1]["byte_start"][0] == 0 and full[1]["byte_end"][-1] == full[1]["char_end"][-1] == 11 and full[2]["ids"] == full[2]["byte_start"] == []
    odd = bpe.encode(spark.createDataFrame([(9, "ñ漢😀 é")], "doc_id long, text string"), PATH, PATTERN).first()
    assert (odd["byte_end"][-1], odd["char_end"][-1]) == (12, 5) and all(len(odd[c]) == len(odd["ids"]) for c in bpe.OFFSETS)
    assert bpe.digests(docs.limit(0), PATH, PATTERN).count() == 0
