"""Fuzzy line dedup: SimHash, pigeonhole blocks, edit similarity, connected groups.

Every line of every document is normalised: lower case, digits as one digit,
punctuation and blanks as single blanks, characters of scripts without blanks as
words. Lines of at least `min_words` words with the same normal form are one class.
Two classes are linked if their normal forms are similar: 1 - edit distance / greater
length >= `similarity`. Of each connected group of lines only the first occurrence
stays, by doc_id, text and line number.

Candidates: each line has `blocks` blocks, of the two word pairs that come first in the
block's own order, and a 64-bit SimHash over its distinct words. An edit touches few
blocks, so similar lines share one (the pigeonhole: unless all are touched); of those
that do, the edit similarity decides, and it is asked for pairs whose hashes differ in
at most `bits` places, which nearly all similar lines do. Blocks of the SimHash's own
bits can't do this: lines with a tenth of their words changed differ in some ten of 64
places, and no pigeonhole over so many is selective.

Buckets of any size: first every class is compared with one pivot of each of its
buckets, which joins a large group in as many comparisons as it has members, and the
first few members with each other, which is all that small buckets hold. Then what
different components have in common in the larger ones is compared in blocks of a bucket, each
pair in the first bucket that it shares, and not once a link has joined them.

Defined results: a null text stays null, and an empty one empty. Lines without words
are never removed. A row with a null doc_id is left as it is. Rows with the same doc_id
and text are one document; other texts under one doc_id are documents of their own. An
empty table gives an empty one. Columns other than doc_id, text and n_chars are kept as
they are, but for n_lines, n_removed and n_left, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bloom, discard, in_blocks, large_batches, lean, materialise, sieve, small_batches, sorted_groups, table
from .components import connected_components
from .shingles import mix, powers_of_base, sorted_distinct


@dataclass(frozen=True)
class LineSpec:
    min_words: int = 1
    similarity: float = 0.75
    blocks: int = 6
    #: Word pairs that a block is made of.
    pairs: int = 2
    #: Places in which the SimHashes of a candidate pair may differ.
    bits: int = 14
    #: First members of a bucket, besides the pivot, that are all compared with each other.
    window: int = 7
    #: Classes of a bucket that meet as many others at a time.
    block: int = 1024

    def comparable(self, a: np.ndarray, b: np.ndarray, chars_a: np.ndarray, chars_b: np.ndarray) -> np.ndarray:
        """Whether lines of these hashes and lengths are candidates."""
        longest = np.maximum(chars_a, chars_b)
        return (np.bitwise_count(a ^ b) <= self.bits) & (np.abs(chars_a - chars_b) <= (1 - self.similarity) * longest + 1e-9)


_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[48:58] = 48
_FOLD[65:91] += 32
_FOLD[10] = 10
_FOLD_BYTES = _FOLD.tobytes()
_SOLID = (_FOLD != 32) & (_FOLD != 10)
_TERMS = _FOLD.astype(np.uint64) + np.uint64(1)


#: Lead bytes of the characters (in UTF-8) that are words of their own: kana and Han.
_LEAD = np.zeros(256, bool)
_LEAD[0xE3:0xEA] = True
_ALONE = re.compile(rb"(?=[\xe3-\xe9])")
#: A byte's bits, each in a byte of its own.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).view(np.uint64).ravel()


def split_lines(text: str) -> list[str]:
    return text.split("\n")


def normal_form(line: str) -> str:
    folded = line.lower().encode("utf-8", "surrogatepass").translate(_FOLD_BYTES)
    return b" ".join((folded if folded.isascii() else _ALONE.sub(b" ", folded)).split()).decode("utf-8", "surrogatepass")


#: What is or becomes a letter or digit of a normal form.
_WORDY = re.compile("[0-9A-Za-z\x80-\U0010ffff]")


def simhash(features: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits for each run of features: those that more than half of them have."""
    count = np.diff(np.append(starts, len(features)))
    pieces = -(-count // 255)  # so many that a byte can count each
    owner = np.repeat(np.arange(len(starts)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lanes = _LANES[mix(features).view(np.uint8).reshape(-1, 8)]
    ones = np.add.reduceat(lanes, starts[owner] + 255 * within, axis=0).view(np.uint8).reshape(-1, 64)
    if len(ones) > len(starts):
        ones = np.add.reduceat(ones, np.cumsum(pieces) - pieces, axis=0, dtype=np.int32)
    return np.packbits(2 * ones.astype(np.int32) > count[:, None], axis=1).view(np.uint64).ravel()


def draw_blocks(features: np.ndarray, starts: np.ndarray, spec: LineSpec) -> np.ndarray:
    """Block keys, a row for each run of features: of each block's own orders the least features."""
    low = (features >> np.uint64(32)).astype(np.uint32) ^ features.astype(np.uint32)
    out = np.empty((len(starts), spec.blocks), np.uint64)
    for k in range(spec.blocks):
        key = np.full(len(starts), k, np.uint64)
        for j in range(spec.pairs):
            salt = int(mix(np.array([k * spec.pairs + j + 1], np.uint64))[0])
            order = (low ^ np.uint32(salt >> 32)) * np.uint32((salt | 1) & 0xFFFFFFFF)
            order ^= order >> np.uint32(15)
            order *= np.uint32(0x2C1B3C6D)
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + np.minimum.reduceat(order, starts))
        out[:, k] = key
    return out


class LineTable:
    """Words of all lines of a run of texts: for each line its text's number, its own, its words, the normal form's length, SimHash, blocks and 128-bit print.

    wanted, given the prints, tells of which lines SimHash and blocks are asked for; the others have zeros.
    """

    def __init__(self, texts: list[str | None], spec: LineSpec, wanted: Callable[[np.ndarray], np.ndarray] | None = None):
        texts = [t or "" for t in texts]
        # ASCII is folded below.
        raw = np.frombuffer("\n".join([t if t.isascii() else t.lower() for t in texts]).encode("utf-8", "surrogatepass") + b"\n", np.uint8)
        data = _FOLD[raw]
        plain = not (raw > 127).any()
        ends = np.flatnonzero(data == 10)
        counts = np.array([t.count("\n") + 1 for t in texts])
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        solid = _SOLID[raw]
        if plain or not (lead := _LEAD[data]).any():
            change = np.flatnonzero(solid[1:] != solid[:-1]) + 1  # data ends with a line feed
            change = np.concatenate([[0], change]) if solid[0] else change
            starts, stops = change[::2], change[1::2]
        else:
            before = np.concatenate([[False], solid[:-1]])
            after = np.concatenate([solid[1:] & ~lead[1:], [False]])
            starts, stops = np.flatnonzero(solid & (~before | lead)), np.flatnonzero(solid & ~after) + 1
        power, inverse = powers_of_base(len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        terms = _TERMS[raw]
        terms *= power[: len(data)]
        np.cumsum(terms, out=total[1:])
        long = stops - starts
        words = mix((total[stops] - total[starts]) * inverse[starts] + long.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        first = np.searchsorted(starts, np.concatenate([[0], ends[:-1] + 1]))
        n = np.append(first[1:], len(starts)) - first
        keep = np.flatnonzero(n >= max(1, spec.min_words))
        self.owner, self.number, self.words, first, n = owner[keep], number[keep], n[keep], first[keep], n[keep]
        self.chars, self.print = np.zeros(len(keep), np.int64), np.zeros((len(keep), 2), np.uint64)
        self.hash, self.blocks = np.zeros(len(keep), np.uint64), np.zeros((len(keep), spec.blocks), np.uint64)
        self.wanted = np.ones(len(keep), bool)
        if len(keep):
            begin = np.cumsum(n) - n
            own = words
            if n.sum() < len(words):
                place = np.repeat(first - begin, n) + np.arange(n.sum())
                own, long = words[place], long[place]
            self.chars = np.add.reduceat(long, begin) + n - 1
            if not plain:  # characters, not their further bytes, which are all parts of words
                further = np.flatnonzero((data & 0xC0) == 0x80)
                self.chars -= np.searchsorted(further, ends[keep]) - np.searchsorted(further, np.concatenate([[0], ends[:-1]])[keep])
            at = np.arange(len(own)) - np.repeat(begin, n)
            self.print = np.column_stack([np.add.reduceat(mix(own ^ (at.astype(np.uint64) * np.uint64(c))), begin) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)])
            if wanted is not None:
                self.wanted = wanted(self.print)
                own, n = own[np.repeat(self.wanted, n)], n[self.wanted]
        if len(n):
            begin = np.cumsum(n) - n
            # Distinct words: how often `the` occurs says little about a line.
            distinct = sorted_distinct(np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(40), n) | own >> np.uint64(24))
            self.hash[self.wanted] = simhash(distinct & np.uint64((1 << 40) - 1), np.searchsorted(distinct, np.arange(len(n), dtype=np.uint64) << np.uint64(40)))
            # Word pairs, or the only word; the last word of a line begins none.
            pair = mix(own * np.uint64(0x9FB21C651E98DF25) + np.append(own[1:], np.uint64(0)))
            alone = begin[n == 1]
            pair[alone] = own[alone]
            used = np.ones(len(own), bool)
            used[(begin + n - 1)[n > 1]] = False
            m = np.maximum(n - 1, 1)
            self.blocks[self.wanted] = draw_blocks(pair[used], np.cumsum(m) - m, spec)

    def prints(self) -> list[bytes]:
        return self.print_array().to_pylist()

    def print_array(self) -> pa.Array:
        offsets = np.arange(len(self.print) + 1, dtype=np.int32) * 16
        return pa.Array.from_buffers(pa.binary(), len(self.print), [None, pa.py_buffer(offsets), pa.py_buffer(self.print.astype(">u8").tobytes())])


def _runs(texts: list[str | None], limit: int = 1 << 17) -> Iterator[tuple[int, int, list[str | None]]]:
    """(first text, its first line, texts) of about `limit` characters; a longer text comes in pieces of whole lines."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        if i > a and size + len(t or "") > limit:
            yield a, 0, texts[a:i]
            a, size = i, 0
        if len(t or "") > 2 * limit:
            line, at = 0, 0
            while at <= len(t):
                end = t.find("\n", at + limit)
                end = len(t) if end < 0 else end
                yield i, line, [t[at:end]]
                line, at = line + t.count("\n", at, end) + 1, end + 1
            a, size = i + 1, 0
        else:
            size += len(t or "")
    if a < len(texts):
        yield a, 0, texts[a:]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text) of the rows that take part."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return rows.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


class _Seen:
    """Which prints come for the first time, among some hundred thousand at least that came last."""

    def __init__(self, most: int = 1 << 18):
        self.most, self.now, self.before = most, set(), set()

    def __call__(self, prints: np.ndarray) -> np.ndarray:
        new = np.ones(len(prints), bool)
        for k, p in enumerate(prints.view("V16").ravel().tolist()):
            if p in self.now or p in self.before:
                new[k] = False
            else:
                self.now.add(p)
        if len(self.now) > self.most:
            self.now, self.before = set(), self.now
        return new


def line_table(docs: DataFrame, spec: LineSpec) -> DataFrame:
    """(doc_id, text_key, line, print, hash, chars, blocks) of every line of enough words of docs(doc_id, text).

    The last three are null if the task has lately told them of the same print, so a
    frequent line costs little more than its places.
    """
    small_batches(docs.sparkSession, 256)

    def run(batches):
        seen = _Seen()
        for batch in batches:
            ids, keys = batch["doc_id"].to_numpy(), batch["text_key"].to_numpy()
            for a, line, texts in _runs(batch["text"].to_pylist()):
                found = LineTable(texts, spec, seen)
                n, told = len(found.hash), ~found.wanted
                # A line of one pair has one block: the others would only say the same.
                width = np.where(told, 0, np.where(found.words <= 2, 1, spec.blocks))
                offsets = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
                held = found.blocks.view(np.int64)[np.arange(spec.blocks) < width[:, None]] if n else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[a + found.owner]), pa.array(keys[a + found.owner]), pa.array(found.number + line, pa.int32()), found.print_array(),
                    pa.array(found.hash.view(np.int64), mask=told), pa.array(found.chars, pa.int32(), mask=told), pa.ListArray.from_arrays(offsets, pa.array(held), mask=pa.array(told)),
                ], names=["doc_id", "text_key", "line", "print", "hash", "chars", "blocks"])

    return _keyed(docs).mapInArrow(lean(run), "doc_id long, text_key long, line int, print binary, hash long, chars int, blocks array<long>")


def shared_buckets(classes: DataFrame, spec: LineSpec) -> DataFrame:
    """Members of buckets that hold more than one class, for classes(print, hash, chars, blocks), which may name a class repeatedly.

    (bucket, print, hash, chars, pivot, near, rank): pivot is the bucket's first member,
    if that is a candidate for this one; rank tells how many members precede this one; near
    are the candidates among the pivot and, up to rank `window`, all members before. Without
    candidates a member is left out if its bucket is known to hold no more than `window` + 1.

    The rows of a bucket stream past, so its size costs no memory.
    """

    def run(batches):
        # Of the bucket that the last batch ended in: its pivot and last members, how many there were, and the first one's rank.
        held, count = None, 0
        for batch in batches:
            old = held.num_rows if held is not None else 0
            rows = pa.Table.from_batches([*(held.to_batches() if old else []), batch]).combine_chunks()
            key = rows["bucket"].to_numpy()
            again = (key[1:] == key[:-1]) & pc.equal(rows["print"][1:], rows["print"][:-1]).to_numpy().astype(bool)
            again[: max(old - 1, 0)] = False
            if again.any():
                rows = rows.filter(pa.array(np.append(True, ~again))).combine_chunks()
                key = rows["bucket"].to_numpy()
            change = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(change, len(key)))
            # Places of the rows of shared buckets, each with the place of its pivot, its rank, and whether its bucket may be large.
            at = np.flatnonzero(np.repeat(size > 1, size))
            pivot, rank = np.repeat(change, size)[at], (np.arange(len(key)) - np.repeat(change, size))[at]
            beyond = count - old  # members of the first bucket that are no longer here
            rank = rank + np.where((pivot == 0) & (at >= old), beyond, 0)
            large = size > spec.window + 1
            large[0] |= old > 0
            large[-1] = True
            large = np.repeat(large, size)[at]
            hashes, chars = rows["hash"].to_numpy().view(np.uint64), rows["chars"].to_numpy()
            fresh = at >= old
            of, to = [], []
            for d in range(spec.window + 1):
                other = pivot if d == 0 else at - d
                k = np.flatnonzero(fresh & ((other > pivot) & (rank <= spec.window) if d else at > pivot))
                k = k[spec.comparable(hashes[at[k]], hashes[other[k]], chars[at[k]], chars[other[k]])]
                of.append(k)
                to.append(other[k])
            by_pivot = np.zeros(len(at), bool)
            by_pivot[of[0]] = True
            order = np.argsort(np.concatenate(of), kind="stable")
            to, near = np.concatenate(to)[order], np.bincount(np.concatenate(of), minlength=len(at))
            out = (near > 0) | large
            out &= fresh | ((at == 0) & (count == 1))
            # What the next batch may go on with.
            last = int(change[-1])
            kept = np.arange(max(last + 1, len(key) - spec.window), len(key))
            count = len(key) - last + (beyond if last == 0 else 0)
            held = rows.take(pa.array(np.append(last, kept)))
            if out.any():
                names, where = rows["print"].combine_chunks(), pa.array(at[out])
                near_to = names.take(pa.array(to))  # rows without candidates have none there
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(near[out])]), pa.int32()), near_to)
                named = names.take(pa.array(np.where(by_pivot, pivot, 0)[out], mask=~by_pivot[out]))
                yield pa.RecordBatch.from_arrays([rows[c].combine_chunks().take(where) for c in ("bucket", "print", "hash", "chars")] + [named, lists, pa.array(rank[out], pa.int64())], names=["bucket", "print", "hash", "chars", "pivot", "near", "rank"])

    rows = classes.select(F.explode("blocks").alias("bucket"), "print", "hash", "chars")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "print").mapInArrow(lean(run), "bucket long, print binary, hash long, chars int, pivot binary, near array<binary>, rank long")


def _sides(rows: pa.Table, key: tuple) -> tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, hashes, lengths, roots as small numbers, and the places of the rows of either block."""
    roots, side = rows["root"].to_pylist(), rows["block"].to_numpy()
    code = {r: k for k, r in enumerate(dict.fromkeys(roots))}
    return rows["class"].to_pylist(), rows["hash"].to_numpy().view(np.uint64), rows["chars"].to_numpy(), np.array([code[r] for r in roots]), np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2])


def _mixed(shared: DataFrame) -> DataFrame:
    """Rows of shared(bucket, root, ...) in buckets of more than one root, with the bucket's size."""
    sizes = shared.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where(F.col("low") != F.col("high"))
    return shared.join(sizes.select("bucket", "size"), "bucket")


def open_classes(shared: DataFrame, spec: LineSpec) -> DataFrame:
    """(class) of every member of a bucket that has a candidate there with another root, for shared(bucket, size, class, hash, chars, root)."""

    def run(batches):
        for key, rows in sorted_groups(batches, ["bucket", "i", "j"]):
            names, hashes, chars, root, first, second = _sides(rows, key)
            hit = np.zeros(len(names), bool)
            for x in first:
                others = second[root[second] != root[x]]
                others = others[spec.comparable(hashes[others], hashes[x], chars[others], chars[x])]
                hit[others] = True
                hit[x] |= bool(len(others))
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in np.flatnonzero(hit).tolist()], pa.binary())], names=["class"])

    return in_blocks(shared, "bucket", spec.block).mapInArrow(lean(run), "class binary").distinct()


def linking_pairs(shared: DataFrame, spec: LineSpec) -> DataFrame:
    """Links (a, b) of different roots that join all that the links of a bucket join, for shared(bucket, size, class, hash, chars, root, buckets, form); buckets are all that the class is in."""

    def run(batches):
        found = Joiner(spec.similarity)
        for key, rows in sorted_groups(batches, ["bucket", "i", "j"]):
            _, hashes, chars, label, first, second = _sides(rows, key)
            forms, own, roots = rows["form"].to_pylist(), [set(b) for b in rows["buckets"].to_pylist()], rows["root"].to_pylist()
            for x in first.tolist():
                others = second[label[second] != label[x]]
                for y in others[spec.comparable(hashes[others], hashes[x], chars[others], chars[x])].tolist():
                    if found.apart(roots[x], roots[y]) and min(own[x] & own[y]) == key[0]:
                        found.offer(roots[x], roots[y], forms[x], forms[y])
            if found.links:
                yield found.taken()
        found.settle()
        yield found.taken()

    return in_blocks(shared, "bucket", spec.block).mapInArrow(lean(run), "a binary, b binary")


def edit_distance(a: str | list[str], b: str | list[str], most: int) -> int:
    """Levenshtein's distance of letters, or of words, or most + 1 if it is greater; one pass with the columns' differences as bits of a whole number."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lead = 0
    for x, y in zip(a, b):
        if x != y:
            break
        lead += 1
    a, b = a[lead:], b[lead:]
    trail = 0
    for x, y in zip(reversed(a), reversed(b)):
        if x != y:
            break
        trail += 1
    a, b = a[: len(a) - trail], b[: len(b) - trail]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for k, c in enumerate(b):
        match = where.get(c, 0)
        across = (((match & up) + up) ^ up) | match | down
        plus, minus = (down | ~(across | up)) & full, up & across
        score += bool(plus & last) - bool(minus & last)
        if score - (len(b) - k - 1) > most:
            return most + 1
        plus, minus = (plus << 1 | 1) & full, (minus << 1) & full
        up, down = (minus | ~((match | down) | plus)) & full, plus & (match | down)
    return score


def cost_at_most(x: list[str], y: list[str], most: int) -> bool:
    """Whether an alignment that takes the next equal words as they come costs at most `most` letters; a quick yes, while no says nothing.

    Words between those that are aligned, each with a blank, cost the longer side's letters.
    """
    i, j, n, m = 0, 0, len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            k = 8 if x[i : i + 8] == y[j : j + 8] else 1
            i, j = min(i + k, n), min(j + k, m)
            continue
        for p, q in _STEPS:
            if i + p < n and j + q < m and x[i + p] == y[j + q]:
                break
        else:
            p = q = 1
        most -= max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if most < 0:
            return False
        i, j = i + p, j + q
    return max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j) <= most


#: Words to pass on either side to the next equal ones, the fewest first.
_STEPS = sorted(((p, q) for p in range(7) for q in range(7) if p + q), key=lambda s: (max(s), s[0] + s[1]))


def allowed(a: str, b: str, similarity: float) -> int:
    """The greatest edit distance of lines that are similar enough."""
    return int((1 - similarity) * max(len(a), len(b)) + 1e-9)


def similar(a: str, b: str, similarity: float) -> bool:
    """Whether 1 - edit distance / greater length is at least `similarity`.

    Lines that differ in few words are known by them.
    """
    most = allowed(a, b, similarity)
    return abs(len(a) - len(b)) <= most and (cost_at_most(a.split(" "), b.split(" "), most) or edit_distance(a, b, most) <= most)


#: Bits of the whole numbers in which many edit distances are counted at once.
LANES = 1 << 15


def edit_distances(pairs: list[tuple[str, str]]) -> list[int]:
    """Levenshtein's distance of each pair: one pass as in edit_distance, where pairs have their bits in lanes of the same numbers, those with the longest texts lowest."""
    found = [0] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: max(map(len, pairs[k])))
    while order:
        lanes, masks, width, full, low = [], [], 0, 0, 0
        while order and width < LANES:
            k = order.pop()
            a, b = sorted(pairs[k], key=len)
            lanes.append((k, width, len(a), len(b)))
            own = len(a) // 8 + 1  # bytes, with a bit for the carry at least
            where: dict[str, int] = {}
            for i, c in enumerate(a):
                where[c] = where.get(c, 0) | 1 << i
            bits, none = {c: m.to_bytes(own, "little") for c, m in where.items()}, bytes(own)
            masks.append([bits.get(c, none) for c in b])
            full |= ((1 << len(a)) - 1) << width
            low |= 1 << width if a else 0
            width += 8 * own
        up, down = full, 0

        def finish(step):
            nonlocal up, down, full, low
            while lanes and lanes[-1][3] == step:
                k, at, m, n = lanes.pop()
                found[k] = n + (up >> at).bit_count() - (down >> at).bit_count()
                rest = (1 << at) - 1
                up, down, full, low = up & rest, down & rest, full & rest, low & rest

        finish(0)
        for step, column in enumerate(zip_longest(*masks, fillvalue=b""), 1):
            match = int.from_bytes(b"".join(column), "little")
            either = match | down
            across = (((match & up) + up) ^ up) | either
            plus, minus = down | full ^ (full & (across | up)), up & across
            plus, minus = (plus << 1 | low) & full, (minus << 1) & full
            up, down = minus | full ^ (full & (either | plus)), plus & either
            if lanes[-1][3] == step:
                finish(step)
    return found


class Joiner:
    """Links among pairs of forms, taken in as they come, that join all that similar pairs join.

    Pairs that are quickly known as similar link at once; the others wait until there
    are enough of them, and those that have not been joined meanwhile are compared.
    """

    def __init__(self, similarity: float, patience: int = 1024):
        self.similarity, self.patience, self.joined, self.open, self.links = similarity, patience, {}, [], []

    def root(self, p):
        while (q := self.joined.get(p, p)) != p:
            self.joined[p] = self.joined.get(q, q)
            p = q
        return p

    def apart(self, a, b) -> bool:
        return self.root(a) != self.root(b)

    def link(self, a, b) -> None:
        self.joined[self.root(b)] = self.root(a)
        self.links.append((a, b))

    def offer(self, a, b, x: str, y: str) -> None:
        """A pair of names, and their forms."""
        most = allowed(x, y, self.similarity)
        if abs(len(x) - len(y)) > most or not self.apart(a, b):
            return
        if cost_at_most(x.split(" "), y.split(" "), most):
            self.link(a, b)
        else:
            self.open.append((a, b, x, y, most))
            if len(self.open) >= self.patience:
                self.settle()

    def settle(self) -> None:
        """Compares the pairs that wait, some at a time, for each link spares others."""
        waiting, self.open = self.open, []
        step = max(1, self.patience // 8)
        for k in range(0, len(waiting), step):
            some = [w for w in waiting[k : k + step] if self.apart(w[0], w[1])]
            for (a, b, *_, most), d in zip(some, edit_distances([(x, y) for _, _, x, y, _ in some])):
                if d <= most and self.apart(a, b):
                    self.link(a, b)

    def taken(self) -> pa.RecordBatch:
        """The links since the last call."""
        links, self.links = self.links, []
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in links], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _place(text_key, doc_id, line):
    """A number of a line's place, the same from columns and from numpy's arrays."""
    if isinstance(text_key, np.ndarray):
        return text_key ^ (doc_id << 24) ^ line
    return text_key.bitwiseXOR(F.shiftleft(doc_id, 24)).bitwiseXOR(line.cast("long"))


def forms_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Written (print, form) of wanted(print, doc_id, text_key, line), read again from whole texts, of which only the lines travel."""
    known = bloom(wanted.select(_place(F.col("text_key"), F.col("doc_id"), F.col("line")).alias("place")), "place")
    small_batches(docs.sparkSession, 256)

    def read(batches):
        for batch in batches:
            counts = pc.count_substring(batch["text"], "\n").to_numpy().astype(np.int64) + 1
            owner = np.repeat(np.arange(len(counts)), counts)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            ids, keys = batch["doc_id"].to_numpy()[owner], batch["text_key"].to_numpy()[owner]
            hit = np.flatnonzero(known.has(_place(keys, ids, number)))
            split, last, forms = [], -1, []
            for k, n in zip(owner[hit].tolist(), number[hit].tolist()):
                if k != last:
                    split, last = split_lines(batch["text"][k].as_py()), k
                forms.append(normal_form(split[n]))
            if forms:
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(keys[hit]), pa.array(number[hit], pa.int32()), pa.array(forms, pa.string())], names=["doc_id", "text_key", "line", "form"])

    found = _keyed(docs).mapInArrow(lean(read), "doc_id long, text_key long, line int, form string")
    forms = found.join(wanted, ["doc_id", "text_key", "line"]).groupBy("print").agg(F.min("form").alias("form"))
    return materialise(forms, "forms")


def similar_pairs(pairs: DataFrame, forms: DataFrame, spec: LineSpec) -> DataFrame:
    """Links among pairs(a, b) whose normal forms are similar enough, which join all that such pairs join."""
    both = pairs.join(forms.select(F.col("print").alias("a"), F.col("form").alias("x")), "a").join(forms.select(F.col("print").alias("b"), F.col("form").alias("y")), "b")

    def compare(batches):
        found = Joiner(spec.similarity)
        for batch in batches:
            for pair in zip(*(batch[c].to_pylist() for c in ("a", "b", "x", "y"))):
                found.offer(*pair)
            yield found.taken()
        found.settle()
        yield found.taken()

    return both.select("a", "b", "x", "y").mapInArrow(lean(compare), "a binary, b binary")


def repeated_lines(docs: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """(doc_id, text_key, lines): the numbers of the lines of each document that repeat an earlier one."""
    lines = materialise(line_table(docs, spec), "lines")
    told = lines.where(F.col("blocks").isNotNull())
    with large_batches(docs.sparkSession):
        shared = materialise(shared_buckets(told, spec).drop("pivot"), "shared")
    most = shared.count()
    pairs = shared.select("print", F.explode("near").alias("near")).select(F.least("print", "near").alias("a"), F.greatest("print", "near").alias("b"))
    pairs = materialise(pairs.distinct(), "pairs")
    large = shared.where(F.col("rank") > spec.window).select("bucket").distinct()
    large = materialise(shared.join(large, "bucket", "left_semi").select("bucket", F.col("print").alias("class"), "hash", "chars"), "large")
    discard(shared)
    # Classes with several lines, or with a candidate; all others stay as they are.
    named = pairs.select(F.explode(F.array("a", "b")).alias("print")).unionByName(large.select(F.col("class").alias("print"))).distinct().withColumn("linked", F.lit(True))
    several = lines.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print", F.lit(False).alias("linked"))
    named = materialise(named.unionByName(several).groupBy("print").agg(F.max("linked").alias("linked")), "named")
    with large_batches(docs.sparkSession):
        places = materialise(sieve(lines, named, "print", ["doc_id", "text_key", "line"]).join(named, "print"), "places")
    classes = places.groupBy("print").agg(F.min(F.struct("doc_id", "text_key", "line")).alias("first"), F.max("linked").alias("linked"))
    classes = materialise(classes, "classes")
    discard(named)
    # Read once, for both rounds.
    forms = forms_of(classes.where("linked").select("print", "first.*"), docs)
    links = materialise(similar_pairs(pairs, forms, spec), "links")
    roots = connected_components(links, most)
    discard(pairs, links)
    roots = materialise(roots, "roots")
    known = large.join(roots.withColumnRenamed("node", "class"), "class", "left").select("bucket", "class", "hash", "chars", F.coalesce("root", "class").alias("root"))
    mixed = materialise(_mixed(known), "mixed")
    still = open_classes(mixed, spec)
    buckets = mixed.join(still, "class").groupBy("class").agg(F.collect_set("bucket").alias("buckets"))
    detail = buckets.join(forms.withColumnRenamed("print", "class"), "class")
    detail = materialise(mixed.join(detail, "class"), "detail")
    more = connected_components(linking_pairs(detail, spec), most)
    more = more.select(F.col("node").alias("own"), F.col("root").alias("joined"))
    linked = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("own", F.coalesce("root", "print"))
    linked = materialise(linked.join(more, "own", "left").select("print", F.coalesce("joined", "own").alias("root"), "first"), "linked")
    kept = linked.groupBy("root").agg(F.min("first").alias("kept"))
    kept = linked.join(kept, "root").select("print", "kept")
    gone = places.join(kept, "print").where(F.struct("doc_id", "text_key", "line") != F.col("kept"))
    found = materialise(gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("lines")), "repeated")
    discard(lines, large, places, classes, forms, roots, mixed, detail, linked)
    return found


def drop_repeated_lines(docs: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """docs without repeated lines, all rows and columns, n_chars counted anew if there is such a column.

    Besides: n_lines, n_removed, and n_left, the lines with words that stay in a
    document that lost some (else null). Texts without repeats aren't shuffled.
    """
    docs = docs.drop("n_lines", "n_removed", "n_left")
    repeated = repeated_lines(docs, spec)
    known = bloom(repeated, "text_key")
    small_batches(docs.sparkSession, 256)
    schema = StructType([*docs.schema.fields, StructField("n_lines", LongType()), StructField("n_removed", LongType()), StructField("n_left", LongType())])
    names = [f"c{i}" for i in range(len(docs.columns))]
    id_at, texts, chars = docs.columns.index("doc_id"), docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    rows = docs.toDF(*names).withColumn("text_key", F.when(F.col(f"c{id_at}").isNotNull() & F.col(f"c{texts}").isNotNull(), F.xxhash64(f"c{texts}")))

    def emit(batch: pa.RecordBatch, lines: list) -> pa.RecordBatch:
        out, removed, total, left = [], [], [], []
        for text, gone in zip(batch[f"c{texts}"].to_pylist(), lines):
            if not gone:
                out.append(text)
                total.append(0 if text is None else text.count("\n") + 1)
                removed.append(0)
                left.append(None)
                continue
            split, own = split_lines(text), set(gone)
            stays = [x for i, x in enumerate(split) if i not in own]
            out.append("\n".join(stays))
            total.append(len(split))
            removed.append(len(own))
            left.append(sum(_WORDY.search(x) is not None for x in stays))
        columns = [batch[c] for c in names]
        columns[texts] = pa.array(out, pa.string())
        if chars is not None:
            columns[chars] = pa.array([n if not r else len(t) for n, r, t in zip(columns[chars].to_pylist(), removed, out)], columns[chars].type)
        return pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.int64())], names=schema.names)

    def as_they_are(batches):
        for batch in known.outside(batches, "text_key"):
            text = batch[f"c{texts}"]
            total = pc.fill_null(pc.add(pc.count_substring(text, "\n").cast(pa.int64()), 1), 0)
            columns = [*(batch[c] for c in names), total, pa.array(np.zeros(len(text), np.int64)), pa.nulls(len(text), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    def shortened(batches):
        for batch in batches:
            yield emit(batch, batch["lines"].to_pylist())

    apart = rows.mapInArrow(known.inside("text_key"), rows.schema).withColumn("id", F.col(f"c{id_at}").cast("long"))
    lines = repeated.select(F.col("doc_id").alias("id"), "text_key", "lines")
    return rows.mapInArrow(lean(as_they_are), schema).unionByName(apart.join(lines, ["id", "text_key"], "left").mapInArrow(lean(shortened), schema))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document after line dedup: its lines, how many are repeats, and a digest of what stays."""
    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
