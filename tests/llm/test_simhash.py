import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import simhash


def by_definition(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=2):
    root = dict(enumerate(range(len(fps))))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbB \t\n\x0b\x1c\x85é漢", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == by_definition(text)


def test_fingerprint_of_awkward_texts():
    for text in (None, "", " \n", "One", "one two", "a b c d " * 30_000):
        assert simhash.fingerprint(text) == by_definition(text)


def test_chain_filter_passes_every_pair_within_the_bound(spark):
    """Over random pairs: those within 2 bits share a key from which the chain is viable, at some start."""
    from pyspark.sql import functions as F

    rng, rows = random.Random(1), []
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for k in rng.sample(range(64), rng.randrange(5)):
            b ^= 1 << k
        rows.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    pairs = spark.createDataFrame(rows, "a long, b long")
    for bits in (1, 2):
        shift = 64 - 4 * simhash.zero_run(bits)
        passes = F.lit(False)
        for s in range(simhash.SEGMENTS):
            d = simhash._ring(F.col("a"), s).bitwiseXOR(simhash._ring(F.col("b"), s))
            passes = passes | ((F.shiftrightunsigned(d, shift) == 0) & simhash.chain_viable(d, bits))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
        assert pairs.filter(near != passes).count() == 0


@pytest.mark.parametrize("crowd", [1, 4, 24])
def test_links_reach_what_all_pairs_reach(spark, crowd):
    rng, fps = random.Random(2), []
    for _ in range(12):
        chain = [rng.getrandbits(64)]
        for _ in range(rng.randrange(25)):
            x = rng.choice(chain)
            for k in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << k
            chain.append(x)
        fps += chain
    fps = sorted(set(fps))
    expected = components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), crowd=crowd)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    groups = {}
    for f, e in zip(signed, expected):
        groups.setdefault(e, set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def documents(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(40):
        text = rng.choices(words, k=rng.choice([1, 2, 3, 30, 400]))
        for _ in range(rng.randrange(1, 6)):
            rows.append(" ".join(text))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
    rows += [None, "", "  ", "Same Text here", "same text HERE", "long " * 50_000]
    data = [(i * 3 % 1009, t, "x", 1) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, fp string, n long")


def test_near_duplicates_equal_brute_force(spark):
    docs = documents(spark)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    fps = [by_definition(t) for _, t in rows]
    expected = {rows[i][0]: (fps[i], rows[c][0]) for i, c in enumerate(components(fps))}
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == expected
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in expected.values()})


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q r s t u")], "doc_id long, text string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == 4 and sorted(r["component_id"] for r in found if r["component_id"] is not None) == [1, 1, 1]
    assert sorted((r["doc_id"] is None, r["text"]) for r in simhash.keep_one(docs).collect()) == [(False, "a b c d"), (True, "q r s t u")]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_bits_other_than_one_or_two_are_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), max_bits=3)
