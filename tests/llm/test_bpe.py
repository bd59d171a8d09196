import hashlib
import random

import public_tokenizers
import pytest

from motifgrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "'re", "'s", "'", "é", "12", "!", "…", "日本", "x" * 30, " " * 30, "'r", "\t"]


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBPE.load(PATH, public_tokenizers.PATTERN)


def test_stitched_chunks_encode_as_the_whole(coder):
    draw = random.Random(2)
    for _ in range(5000):
        text = "".join(draw.choices(PARTS, k=draw.randint(0, 120)))
        chunk, overlap = draw.choice([(8, 3), (16, 6), (40, 20), (10, 5)])
        read = [bpe.stitchable(coder.boundaries(text[a:b], b == len(text)), text[a:b], a, overlap) for a, b in bpe.windows(len(text), chunk, overlap)]
        cuts = coder.stitches(read)
        ids = coder.encode(text, cuts)
        assert ids == coder.library.encode_ordinary(text)
        places = bpe.windows(len(text), chunk, overlap)
        own = bpe.pieces(cuts, [end for _, end in places])
        assert len(own) == len(places) and "".join(text[a:b] for a, b, _ in own) == text
        assert all(begin <= a <= b <= end for (a, b, _), (begin, end) in zip(own, places))
        assert [whole for *_, whole in own] == [True] * (len(cuts) - 1) + [len(cuts) == len(own)] + [False] * (len(own) - len(cuts))
        assert coder.decode(ids) == text.encode()


def test_documents(spark, coder):
    draw = random.Random(3)
    texts = [None, "", "short", "x" * 500, " " * 300 + "a", "".join(draw.choices(PARTS, k=400)), "".join(draw.choices(PARTS[:6], k=900))]
    texts += texts[-2:]
    rows = [(i if i != 2 else None, t, 7, "z") for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, begin int, row string")
    found = bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN, bpe.tokens, bpe.TOKENS, chunk=64, overlap=16).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    for doc, text, *_ in rows:
        ids = coder.library.encode_ordinary(text or "")
        assert by_id[doc]["token_ids"] == ids and by_id[doc]["n_tokens"] == len(ids)
        assert by_id[doc]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert by_id[doc]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.encode_documents(frame.limit(0), PATH, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST).count() == 0


def test_a_very_long_text_is_encoded_in_many_pieces(spark, coder):
    """At the production chunk; in the second text a run of blanks longer than an overlap lets no stitch through."""
    draw = random.Random(5)
    plain = " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(1, 9))) for _ in range(60_000))
    texts = [plain, plain[:100_000] + " " * 40_000 + plain[100_000:], "y" * 50_000]
    places = bpe.windows(len(plain), bpe.CHUNK, bpe.OVERLAP)
    read = [bpe.stitchable(coder.boundaries(plain[a:b], b == len(plain)), plain[a:b], a, bpe.OVERLAP) for a, b in places]
    assert len(places) > 15 and len(coder.stitches(read)) == len(places)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["token_ids"] for r in bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN, bpe.tokens, bpe.TOKENS).collect()}
    assert found == {k: coder.library.encode_ordinary(t) for k, t in enumerate(texts)}


def test_kept_columns_of_any_name(spark):
    names = ["row", "begin", "window", "ids", "keep1"]
    frame = spark.createDataFrame([(1, "ab " * 100, *"abcde"), (2, "x", *"fghij"), (3, None, *[None] * 5)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST, chunk=50, overlap=8, keep=tuple(names)).collect()
    assert {r["doc_id"]: tuple(r[n] for n in names) for r in found} == {1: tuple("abcde"), 2: tuple("fghij"), 3: (None,) * 5}


def test_repeated_rows_of_long_texts_stay(spark):
    frame = spark.createDataFrame([(1, "ab " * 100)] * 3, "doc_id long, text string")
    assert bpe.encode_documents(frame, PATH, public_tokenizers.PATTERN, bpe.digest, bpe.DIGEST, chunk=50, overlap=8).count() == 3
