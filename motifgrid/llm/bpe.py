"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks that overlap. Each chunk is pre-tokenised on its
own, in parallel, from wherever its window begins; neighbours are stitched at the
first place in their overlap where both have a pre-token boundary, because from a
common boundary on the pattern reads the same text the same way. Only boundaries
travel to be stitched. Each chunk then encodes the piece between its two stitches,
again in parallel, and a text's ids are joined in the order of its pieces. Where an
overlap holds no common boundary (one very long word, or run of blanks), what follows
the stitch before it is one piece, encoded by one task. Decoding joins the raw bytes
of the ids.

Texts of one chunk are encoded where they are read; only longer ones are dealt out
by chunk.

Defined results: a null or empty text has no ids. Repeated rows are encoded each.
A null doc_id stays null. An empty table has no rows. Columns in `keep` are carried
along under any name that the result has not itself, others are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import materialise, small_batches, table

#: Code points that a chunk owns, and how many it reads beyond on either side.
CHUNK, OVERLAP = 16_384, 256
#: A boundary this close to the end of a chunk's window may depend on what follows; the longest contraction has three characters.
MARGIN = 4
BLANKS = " \t\n\r"

_loaded: dict[tuple[str, str], "ByteBPE"] = {}


class ByteBPE:
    """A rank file and a pre-token pattern, without special tokens."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.library = tiktoken.Encoding("byte-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.decimals = [str(rank) for rank in range(max(ranks.values(), default=-1) + 1)]

    @classmethod
    def load(cls, path: str, pattern: str) -> "ByteBPE":
        """One for each process: workers are used again."""
        if (path, pattern) not in _loaded:
            _loaded[path, pattern] = cls(path, pattern)
        return _loaded[path, pattern]

    def boundaries(self, window: str, last: bool) -> list[int]:
        """Pre-token ends in a window, read from its begin, that don't depend on what follows it. last: nothing does."""
        found = [0, *(m.end() for m in self.pattern.finditer(window))]
        return found if last else found[: bisect_left(found, len(window) - MARGIN)]

    def stitches(self, read: list[list[int]]) -> list[int]:
        """True boundaries of a text: its begin, and one between each chunk and the next until a pair has none in common. read: what stitchable() kept of each window."""
        cuts = [0]
        for before, after in zip(read, read[1:]):
            known = set(after)
            common = next((x for x in before if x > cuts[-1] and x in known), None)
            if common is None:
                break
            cuts.append(common)
        return cuts

    def encode(self, text: str, cuts: list[int] = [0]) -> list[int]:
        """Ids of the text, cut at true boundaries."""
        ids: list[int] = []
        for a, b in zip(cuts, [*cuts[1:], len(text)]):
            ids += self.library.encode_ordinary(text[a:b])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def windows(n: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """What each chunk of a text of n code points reads."""
    return [(max(0, a - overlap), min(n, a + chunk + overlap)) for a in range(0, max(n, 1), chunk)]


def stitchable(found: list[int], window: str, begin: int, overlap: int) -> list[int]:
    """Of a window's boundaries those in its overlaps where a blank follows something else, as places in the text.

    Elsewhere the lookahead for blanks, cut off by a stitch, would read the piece
    before it in another way.
    """
    n = len(window)
    return [begin + x for x in found if (x <= 2 * overlap or x >= n - 2 * overlap) and 0 < x < n and window[x] in BLANKS and not window[x - 1].isspace()]


def pieces(cuts: list[int], ends: list[int]) -> list[tuple[int, int, bool]]:
    """What each window, of these ends, has to give: from, to, and whether that is a piece of its own or only a part of the last one."""
    last = len(cuts) - 1
    own = [(a, b, True) for a, b in zip(cuts, cuts[1:])] + [(cuts[-1], ends[last], last == len(ends) - 1)]
    return own + [(a, b, False) for a, b in zip(ends[last:], ends[last + 1 :])]


def encode_documents(docs: DataFrame, tokenizer_path: str, pattern: str, finish: Callable, schema: str, chunk: int = CHUNK, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """finish(bpe, doc_id, ids), a row of schema, for each row of docs(doc_id, text, keep...), and the columns in keep."""
    small_batches(docs.sparkSession, 256)
    kept = [f"keep{i}" for i in range(len(keep))]
    out = StructType([*StructType.fromDDL(schema).fields, *(docs.schema[c] for c in keep)])
    fields = [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(schema).fields]

    def batch_of(rows: list[tuple], beside: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)), *beside], names=[*(n for n, _ in fields), *keep])

    def short(batches):
        bpe = ByteBPE.load(tokenizer_path, pattern)
        for batch in batches:
            yield batch_of([finish(bpe, doc, bpe.encode(text or "")) for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist())], [batch[c] for c in kept])

    def pre_tokenise(batches):
        bpe = ByteBPE.load(tokenizer_path, pattern)
        for batch in batches:
            found = [stitchable(bpe.boundaries(w, end == n), w, begin, overlap) for w, begin, end, n in zip(*(batch[c].to_pylist() for c in ("window", "begin", "end", "n")))]
            yield batch.append_column("found", pa.array(found, pa.list_(pa.int32()))).drop_columns(["n"])

    def stitch(key: tuple[pa.Scalar, ...], read: pa.Table) -> pa.Table:
        read = read.sort_by("begin")
        bpe = ByteBPE.load(tokenizer_path, pattern)
        own = pieces(bpe.stitches(read["found"].to_pylist()), read["end"].to_pylist())
        return pa.table([read["row"], read["begin"], *(pa.array([x[i] for x in own], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_())))], names=["row", "begin", "start", "stop", "whole"])

    def encode(batches):
        bpe = ByteBPE.load(tokenizer_path, pattern)
        for batch in batches:
            ids, part = [], []
            for window, begin, start, stop, whole in zip(*(batch[c].to_pylist() for c in ("window", "begin", "start", "stop", "whole"))):
                text = window[start - begin : stop - begin]
                ids.append(bpe.encode(text) if whole else None)
                part.append(None if whole else text)
            batch = batch.select(["row", "doc_id", *kept, "begin"])
            yield batch.append_column("ids", pa.array(ids, pa.list_(pa.int32()))).append_column("part", pa.array(part, pa.string()))

    def join(key: tuple[pa.Scalar, ...], found: pa.Table) -> pa.Table:
        bpe = ByteBPE.load(tokenizer_path, pattern)
        found = found.sort_by("begin")
        ids = [i for piece in found["ids"].to_pylist() for i in piece or ()]
        ids += bpe.encode("".join(x or "" for x in found["part"].to_pylist()))
        return pa.Table.from_batches([batch_of([finish(bpe, found["doc_id"][0].as_py(), ids)], [found[c].slice(0, 1).combine_chunks() for c in kept])])

    rows = docs.select("doc_id", *(F.col(c).alias(k) for c, k in zip(keep, kept)), "text", F.coalesce(F.char_length("text"), F.lit(0)).alias("n"))
    begins = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk)), lambda a: F.struct(F.greatest(a - overlap, F.lit(0)).alias("begin"), F.least(a + chunk + overlap, F.col("n")).alias("end")))
    # Whatever the document's id, a text is one row of the scan; the row's number keeps repeated rows apart.
    cut = rows.where(F.col("n") > chunk).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", *kept, "n", "text", F.explode(begins).alias("w"))
    cut = cut.select("row", "doc_id", *kept, "n", F.col("w.begin").alias("begin"), F.col("w.end").alias("end"), F.expr("substring(text, w.begin + 1, w.end - w.begin)").alias("window"))
    # Written, since a second scan might number the rows in another way.
    read = materialise(cut.mapInArrow(pre_tokenise, StructType([f for f in cut.schema.fields if f.name != "n"]).add("found", ArrayType(IntegerType()))), "windows")
    own = read.select("row", "begin", "end", "found").groupBy("row").applyInArrow(stitch, "row long, begin int, start int, stop int, whole boolean")
    dealt = read.drop("end", "found").join(own, ["row", "begin"])
    encoded = dealt.mapInArrow(encode, StructType([read.schema["row"], read.schema["doc_id"], *(read.schema[k] for k in kept), read.schema["begin"]]).add("ids", ArrayType(IntegerType())).add("part", "string"))
    long = encoded.groupBy("row").applyInArrow(join, out)
    return rows.where(F.col("n") <= chunk).select("doc_id", *kept, "text").mapInArrow(short, out).unionByName(long)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest(bpe: ByteBPE, doc: int | None, ids: list[int]) -> tuple:
    names = bpe.decimals
    return doc, len(ids), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


TOKENS = f"{DIGEST}, token_ids array<int>"


def tokens(bpe: ByteBPE, doc: int | None, ids: list[int]) -> tuple:
    return *digest(bpe, doc, ids), ids


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded, as digests."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digest, DIGEST)
