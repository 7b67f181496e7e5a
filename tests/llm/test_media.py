import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import media_matroska as mkv


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**56 - 2))
def test_integers(value):
    data = mkv.vint(value)
    assert mkv.read_vint(data, 0) == (value, len(data))
    assert mkv.read_vint(mkv.vint(value, 8), 0) == (value, 8)


@pytest.mark.parametrize("size", [64, 128, 1024, 1088, 2048, 2112, 8192, 8256, 131_072, 131_136, 500_032])
def test_round_trip(size):
    payload = bytes(i * 7 % 251 for i in range(size))
    data = mkv.mux(payload)
    media = mkv.parse(data)
    assert media.payload(data, 1) == payload
    assert media.tracks == {1: ("A_PCM/INT/LIT", 8000.0, 1, 8)}
    assert media.duration * media.scale / 1e6 == size / 8
    assert [p[1] for p in media.packets] == [128 * i for i in range(len(media.packets))]
    assert [at for _, _, at in media.cues] == [c - 4 - _head(data, c) for c in media.clusters]


def _head(data, cluster):
    """Bytes of a cluster's size: from its id to its data."""
    segment = data.index(mkv.SEGMENT.to_bytes(4, "big")) + 4
    start = segment + (9 - data[segment].bit_length()) + cluster
    return next(w for w in range(1, 9) if data[start - w - 4 : start - w] == mkv.CLUSTER.to_bytes(4, "big"))


def block(frames):
    lacing, body = mkv.laced(frames)
    return mkv.vint(1) + b"\0\5" + bytes([0x80 | lacing << 1]) + body


def cluster(time, body, known):
    data = mkv.number(mkv.TIMESTAMP, time) + body
    return mkv.element(mkv.CLUSTER, data) if known else mkv.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + data


@pytest.mark.parametrize("known", [True, False])
def test_lacing_groups_and_unknown_sizes(known):
    frames = [[b"a" * 600, b"b" * 3, b"c" * 70_000, b"d" * 5], [b"z" * 510, b"y"], [b"q" * 9] * 3, [b"one"]]
    body = mkv.element(0xEC, b"void") + b"".join(mkv.element(mkv.SIMPLE_BLOCK, block(f)) for f in frames)
    group = mkv.element(mkv.BLOCK_GROUP, mkv.element(mkv.BLOCK, block([b"grouped"])))
    inside = cluster(7, body, known) + cluster(9, group, known) + mkv.element(mkv.CUES, b"")
    for head in (mkv.SEGMENT.to_bytes(4, "big") + b"\xff" + inside, mkv.element(mkv.SEGMENT, inside)):
        data = mkv.element(mkv.EBML, mkv.element(mkv.DOC_TYPE, b"matroska")) + head
        media = mkv.parse(data)
        assert [data[p[2] : p[2] + p[3]] for p in media.packets] == [x for f in [*frames, [b"grouped"]] for x in f]
        assert [p[5] for p in media.packets] == [3] * 4 + [1] * 2 + [2] * 3 + [0, 0]
        assert {p[1] for p in media.packets} == {12, 14}


@pytest.mark.parametrize("data", [b"", b"\0", b"\x1a\x45\xdf\xa3", mkv.mux(b"x" * 64)[:-40], b"not a film at all"])
def test_broken_files(data):
    with pytest.raises(ValueError):
        mkv.parse(data)


def test_operator(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "long " * 40_000, "same", "same"]
    docs = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r["doc_id"]: r for r in mkv.digests(docs).collect()}
    stored = {r["doc_id"]: bytes(r["media"]) for r in mkv.store(docs).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[i]), hashlib.sha256(stored[i]).hexdigest())
    assert rows[7]["feature"] == rows[8]["feature"] and rows[0]["feature"] == rows[1]["feature"]
    assert mkv.digests(docs.limit(0)).count() == 0


def test_packet_table(spark):
    files = [(1, mkv.mux(b"k" * 6080), "x"), (2, b"broken", "x"), (3, None, "x")]
    found = mkv.packets(spark.createDataFrame(files, "doc_id long, media binary, track string")).collect()
    good = [r for r in found if r["doc_id"] == 1]
    assert sum(r["size"] for r in good) == 6080 and all(r["error"] is None and r["codec"] == "A_PCM/INT/LIT" for r in good)
    assert all(files[0][1][r["first_byte"] : r["first_byte"] + r["size"]] == b"k" * r["size"] for r in good)
    assert sorted(r["doc_id"] for r in found if r["error"]) == [2, 3]
