import hashlib
import zlib
import random

import pytest

from motifgrid.llm import matroska as m


@pytest.mark.parametrize("lacing", [m.NO_LACING, m.XIPH, m.FIXED, m.EBML_LACING])
def test_payload_round_trip(lacing):
    draw = random.Random(1)
    for n in (1, 7, 8, 9, 300):
        payload = draw.randbytes(576 * n)
        blob = m.write_pcm(payload, lacing=lacing)
        media = m.read_media(blob)
        assert m.payload_of(blob, media) == payload and len(media.packets) == n
        assert [p.timestamp_ns for p in media.packets] == [72_000_000 * k for k in range(n)]
        for time, track, place in media.cues:
            assert blob[place : place + 4] == m.CLUSTER.to_bytes(4, "big") and track == 1
            assert m.seek(media, time) == place


@pytest.mark.parametrize("lacing", [m.XIPH, m.FIXED, m.EBML_LACING])
def test_laces_of_all_sizes(lacing):
    draw = random.Random(2)
    for _ in range(300):
        frames = [draw.randbytes(draw.choice([0, 1, 5, 254, 255, 256, 600, 70_000])) for _ in range(draw.randint(2, 9))]
        if lacing == m.FIXED:
            frames = [f[:1].ljust(50, b"a") for f in frames]
        body = m.block(1, -5, frames, lacing)
        track, relative, _, found = m._frames(memoryview(body), 0, len(body))
        assert (track, relative) == (1, -5) and [body[a : a + n] for a, n in found] == frames


def test_unknown_sizes_groups_and_foreign_elements():
    block = m.block(1, 3, [b"abc"], m.NO_LACING)
    cluster = m._uint(m.TIMESTAMP, 10) + m._element(m.BLOCK_GROUP, m._element(m.BLOCK, block)) + m._element(0xEC, b"\0\0")
    open_cluster = m.CLUSTER.to_bytes(4, "big") + b"\xff" + cluster
    body = m._element(m.INFO, m._uint(m.TIMESTAMP_SCALE, 1000)) + open_cluster + open_cluster
    blob = m._element(m.EBML, b"") + m.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body
    media = m.read_media(blob)
    assert [(p.timestamp_ns, p.cluster, blob[p.offset : p.offset + p.length]) for p in media.packets] == [(13_000, 0, b"abc"), (13_000, 1, b"abc")]


def test_columns(spark):
    texts = [None, "", "é" * 1000, "x" * 576, "y" * 30_000, "y" * 30_000]
    frame = spark.createDataFrame([(i if i else None, t, b"z") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    media = m.text_media(frame)
    found = sorted(m.media_digests(media).collect(), key=lambda r: r["doc_id"] or 0)
    assert [r["n_bytes"] for r in found] == [0, 0, 2000, 576, 30_000, 30_000]
    assert [r["payload_bytes"] for r in found] == [576, 576, 2304, 576, 30_528, 30_528]
    assert found[0]["media_sha256"] == found[1]["media_sha256"] and found[4]["feature"] == found[5]["feature"]
    damaged = spark.createDataFrame([(1, b"\x1aE"), (2, None), (3, m.write_pcm(b"a" * 576)[:-40])], "doc_id long, media binary")
    packets = m.packet_table(media).collect() + m.packet_table(damaged).collect()
    assert sum(r["length"] or 0 for r in packets) == sum(r["payload_bytes"] for r in found)
    assert sorted(r["doc_id"] for r in packets if r["error"]) == [1, 2, 3]
    assert m.media_digests(m.text_media(frame.limit(0))).count() == 0


def test_damaged_bytes_never_crash_the_reader():
    draw, blob = random.Random(3), bytearray(m.write_pcm(bytes(576 * 20)))
    for _ in range(500):
        bad = bytearray(blob)
        for _ in range(draw.randint(1, 4)):
            bad[draw.randrange(200)] = draw.randrange(256)
        try:
            m.read_media(bytes(bad))
        except (m.MatroskaError, IndexError, m.struct.error):
            pass


def test_fields_beyond_a_table_are_errors(spark):
    """Track numbers and times of any size come as they are or as an error row, never as a crash."""

    def media(track, time):
        cluster = m._element(m.CLUSTER, m._uint(m.TIMESTAMP, time) + m._element(m.SIMPLE_BLOCK, m.block(track, 0, [b"abc"], m.NO_LACING)))
        return m._element(m.EBML, m._element(m.DOC_TYPE, b"matroska")) + m._element(m.SEGMENT, cluster)

    rows = [(1, media(1 << 40, 5)), (2, media(1, 1 << 62)), (3, media(1, 7)), (4, media((1 << 56) - 2, 0))]
    found = {r["doc_id"]: r for r in m.packet_table(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert found[1]["track"] == 1 << 40 and found[1]["timestamp_ns"] == 5_000_000
    assert found[2]["track"] is None and "64 bits" in found[2]["error"]
    assert found[3]["length"] == 3 and found[4]["track"] == (1 << 56) - 2
    assert m.features(m.read_media(media(5, 0)), b"").startswith("codec=;packets=1")


def test_digests_against_plain_bytes(spark):
    """What the query says of a text, from the padded bytes alone."""
    texts = ["", "a", "x" * 576, "é£" * 400, "".join(chr(32 + i % 90) for i in range(20_000))]
    found = {r["doc_id"]: r for r in m.media_digests(m.text_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, text in enumerate(texts):
        raw = text.encode()
        whole = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        said = dict(x.split("=") for x in r["feature"].split(";"))
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(whole, whole[1:]))
        assert (int(said["sum"]), int(said["squares"]), int(said["crossings"])) == (sum(whole), sum(b * b for b in whole), crossings)
        assert int(said["packets"]) == len(whole) // 576 and int(said["clusters"]) == int(said["cues"]) == -(-len(whole) // (576 * 256))
