import os
import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifgrid.llm import lines
from motifgrid.llm.lines import LineSpec, LineTable, drop_repeated_lines, edit_distance, normal_form, repeated_lines, similar

from . import brute


def test_edit_distance():
    draw = random.Random(1)
    for _ in range(3000):
        a = "".join(draw.choices("abc", k=draw.randint(0, 14)))
        b = "".join(draw.choices("abc", k=draw.randint(0, 14))) if draw.random() < 0.5 else "".join(brute.variant(draw, list(a), 0.2, "abc"))
        d = brute.distance(a, b)
        assert edit_distance(a, b, 99) == d
        most = draw.randint(0, 6)
        assert min(edit_distance(a, b, most), most + 1) == min(d, most + 1)


def test_similar_lines():
    draw = random.Random(9)
    vocabulary = ["".join(draw.choices("abcde", k=draw.randint(1, 6))) for _ in range(60)]
    yes = 0
    for _ in range(800):
        a = draw.choices(vocabulary, k=draw.randint(1, 12))
        b = brute.variant(draw, a, draw.choice([0.1, 0.3, 0.6]), vocabulary)
        x, y = " ".join(a), " ".join(b)
        want = brute.distance(x, y) <= int(0.25 * max(len(x), len(y)) + 1e-9)
        assert similar(x, y, 0.75) == want
        yes += want
    assert 150 < yes < 750


def test_normal_forms():
    assert normal_form("  Page 12, of\t34!! Ünïted ") == normal_form("PAGE 99 of 00: ünïted") == "page 00 of 00 ünïted"


def hashes(texts, spec):
    found = LineTable(texts, spec)
    return {(int(o), int(n)): (p, int(h), int(c), tuple(b.tolist()[: 1 if w <= 2 else None])) for o, n, p, h, c, b, w in zip(found.owner, found.number, found.prints(), found.hash, found.chars, found.blocks, found.words)}


def test_line_tables_find_the_same_lines_in_any_run():
    draw = random.Random(2)
    texts = ["\n".join(" ".join(draw.choices(["Ab", "c1", "d-e", "É", "", "x\ty"], k=draw.randint(0, 9))) for _ in range(draw.randint(1, 5))) for _ in range(60)] + [None, "", "\n"]
    whole = hashes(texts, LineSpec())
    for k, text in enumerate(texts):
        alone = hashes([text], LineSpec())
        assert {(k, n): v for (_, n), v in alone.items()} == {key: v for key, v in whole.items() if key[0] == k}
        for n, line in enumerate((text or "").split("\n")):
            assert ((k, n) in whole) == bool(normal_form(line))
    prints = {}
    for (k, n), found in whole.items():
        form = normal_form(texts[k].split("\n")[n])
        assert prints.setdefault(form, found) == found and found[2] == len(form)
    assert len({p for p, *_ in prints.values()}) == len(prints)
    assert len(hashes(texts, LineSpec(min_words=5))) == sum(len(normal_form(x).split()) >= 5 for t in texts for x in (t or "").split("\n"))


def test_simhash_counts_runs_of_any_length():
    draw = np.random.default_rng(3)
    for sizes in ([1], [3, 1, 700, 2, 255, 256, 1], [510]):
        features = draw.integers(0, 1 << 40, sum(sizes)).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        bits = np.unpackbits(lines.mix(features).view(np.uint8).reshape(-1, 8), axis=1)
        want = [np.packbits(2 * bits[a : a + n].sum(axis=0) > n).view(np.uint64)[0] for a, n in zip(starts, sizes)]
        assert lines.simhash(features, starts).tolist() == want


def test_scripts_without_blanks():
    assert normal_form("東京 tokyo。大阪") == "東 京 tokyo。 大 阪" or normal_form("東京") == "東 京"
    a, b = "東京都は日本の首都であり世界最大級の都市である", "東京都は日本の首都であり世界最大級の街である"
    found = LineTable([a, b], LineSpec())
    assert found.words.tolist() == [len(a), len(b)] and similar(normal_form(a), normal_form(b), 0.75)
    assert (found.blocks[0] == found.blocks[1]).any()


def test_long_texts_come_in_pieces_of_whole_lines():
    draw = random.Random(6)
    texts = [None, "a", "\n".join("x" * draw.randint(0, 30) for _ in range(200)), "", "b\nc", "y" * 500, "z\n" * 60]
    for limit in (1, 10, 50, 10_000):
        found = {}
        for first, line, run in lines._runs(texts, limit):
            for k, t in enumerate(run):
                for n, x in enumerate((t or "").split("\n")):
                    assert found.setdefault((first + k, line + n if k == 0 else n), x) == x
        assert found == {(k, n): x for k, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))}


def expected(rows, spec):
    """doc_id: numbers of the lines that go."""
    own = {}
    texts = [t for _, t in rows]
    for (k, n), (_, h, _, blocks) in hashes(texts, spec).items():
        own[rows[k][0], texts[k], n] = (normal_form(texts[k].split("\n")[n]), h, blocks)
    forms = sorted(set(own.values()))
    links = [(a, b) for i, (a, x, p) in enumerate(forms) for b, y, q in forms[i + 1 :] if (x ^ y).bit_count() <= spec.bits and set(p) & set(q) and similar(a, b, spec.similarity)]
    root = brute.components([f for f, *_ in forms], links)
    first, gone = {}, {}
    for place in sorted(own):
        if first.setdefault(root[own[place][0]], place) != place:
            gone.setdefault(place[0], []).append(place[2])
    return gone


def corpus(draw):
    vocabulary = ["".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 9))) for _ in range(500)]
    bases = [[draw.choice(vocabulary) for _ in range(draw.choice([3, 5, 12, 60, 90]))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(draw.randint(0, 6)):
            line = brute.variant(draw, draw.choice(bases), draw.choice([0, 0, 0.01, 0.03]), vocabulary)
            text.append(draw.choice([" ".join, "  ".join])(line).upper() if draw.random() < 0.1 else " ".join(line))
        rows.append((i, "\n".join(text)))
    return rows


@pytest.mark.parametrize("block", [1024, 3])
def test_against_brute_force(spark, block):
    draw, spec = random.Random(4), LineSpec(block=block)
    rows = corpus(draw)
    gone = expected(rows, spec)
    assert sum(map(len, gone.values())) > 90
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["lines"] for r in repeated_lines(frame, spec).collect()} == gone


def test_nearly_all_similar_lines_are_candidates():
    """Against the edit similarity alone: lines of 5 to 90 words, up to a fifth of the words changed."""
    draw, spec = random.Random(7), LineSpec()
    vocabulary = ["".join(draw.choices(string.ascii_lowercase, k=draw.randint(2, 9))) for _ in range(3000)]
    similar_, found = 0, 0
    for _ in range(1500):
        base = draw.choices(vocabulary, k=draw.choice([5, 8, 12, 25, 60, 90]))
        a, b = " ".join(base), " ".join(brute.variant(draw, base, draw.choice([0.02, 0.05, 0.1, 0.2]), vocabulary))
        if b and similar(a, b, spec.similarity):
            t = LineTable([a, b], spec)
            similar_ += 1
            found += bool((t.blocks[0] == t.blocks[1]).any() and spec.comparable(t.hash[:1], t.hash[1:], t.chars[:1], t.chars[1:])[0])
    assert similar_ > 1000 and found / similar_ > 0.93


def test_a_large_group_of_lines_one_word_apart(spark):
    """8,000 lines share nearly all blocks; each is compared with a pivot, not with all others."""
    draw = random.Random(8)
    base = ["".join(draw.choices(string.ascii_lowercase, k=6)) for _ in range(40)]
    words = ["".join(draw.choices(string.ascii_lowercase, k=6)) for _ in range(8000)]
    rows = [(i, " ".join([*base[: i % 40], w, *base[i % 40 + 1 :]])) for i, w in enumerate(words)]
    found = drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found.where("n_removed = 0").count() == 1


def test_texts_under_one_id_are_documents_of_their_own(spark):
    same, rare = "the quick brown fox jumps over", "a totally different unique line of text here"
    rows = [(1, f"{same}\nline two of the first text"), (2, f"{same}\nmore that is only found here"), (2, f"{rare}\nsomething else entirely")]
    texts = {r["text"] for r in drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert texts == {rows[0][1], "more that is only found here", rows[2][1]}


def test_texts_and_columns(spark):
    same = "the quick brown fox jumps over"
    rows = [(2, f"{same}\nshort two\nand another line that stays here", "a", 9), (1, f"intro line number one two\n{same.upper()}!", "b", 9), (3, same, "c", 9), (None, same, "d", 9), (4, None, "e", None), (5, "", "f", 0), (6, f"short one\n{same}\n{same}", "g", 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, line string, n_chars long")
    found = {r["line"]: r for r in drop_repeated_lines(frame).collect()}
    assert len(found) == 7
    assert found["a"]["text"] == "short two\nand another line that stays here" and found["a"]["n_left"] == 2
    assert found["b"]["text"] == rows[1][1] and found["b"]["n_removed"] == 0 and found["b"]["n_left"] is None
    assert (found["c"]["text"], found["c"]["n_left"], found["c"]["n_chars"]) == ("", 0, 0)
    assert found["d"]["text"] == same and found["e"]["text"] is None and found["e"]["n_chars"] is None and found["f"]["text"] == ""
    assert found["g"]["text"] == "short one" and found["g"]["n_removed"] == 2 and found["g"]["n_left"] == 1
    twice = spark.createDataFrame([(1, same), (1, same), (2, same)], "doc_id long, text string")
    assert sorted(r["text"] for r in drop_repeated_lines(twice).collect()) == ["", same, same]
    assert drop_repeated_lines(frame.limit(0)).count() == 0


def test_columns_of_any_name_stay(spark):
    frame = spark.createDataFrame([(1, "one two three four five", "k", 1), (2, "one two three four five", "l", 2)], "doc_id long, text string, text_key string, c0 int")
    found = drop_repeated_lines(frame.withColumn("lines", F.lit("x")).withColumn("id", F.lit(3)))
    assert found.columns == ["doc_id", "text", "text_key", "c0", "lines", "id", "n_lines", "n_removed", "n_left"]
    assert sorted(map(tuple, found.collect())) == [(1, "one two three four five", "k", 1, "x", 3, 1, 0, None), (2, "", "l", 2, "x", 3, 1, 1, 0)]


def test_buckets_larger_than_a_batch(spark):
    """Members of a bucket meet its pivot across batches."""
    spec = LineSpec()
    rows = [(k.to_bytes(4, "big"), 5 if k % 3 else 2**63 - 1, 10, [7, 100 + k]) for k in range(50)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = lines.shared_buckets(spark.createDataFrame(rows, "print binary, hash long, chars int, blocks array<long>"), spec).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == 50 and {r["bucket"] for r in found} == {7}
    assert {bytes(r["print"]) for r in found if r["pivot"] is not None} == {k.to_bytes(4, "big") for k in range(1, 50) if k % 3 == 0}


def test_distances_counted_together():
    draw = random.Random(12)
    pairs = [("".join(draw.choices("abü", k=draw.choice([0, 1, 7, 8, 9, 30, 64]))), "".join(draw.choices("abü", k=draw.choice([0, 1, 8, 15, 63, 70])))) for _ in range(700)]
    assert lines.edit_distances(pairs) == [brute.distance(a, b) for a, b in pairs]
    assert lines.edit_distances([]) == []


def test_links_join_all_that_similar_pairs_join():
    draw = random.Random(13)
    vocabulary = ["".join(draw.choices("abcdef", k=draw.randint(1, 6))) for _ in range(40)]
    bases = [draw.choices(vocabulary, k=draw.randint(4, 14)) for _ in range(12)]
    forms = [" ".join(brute.variant(draw, draw.choice(bases), draw.choice([0.05, 0.15, 0.3]), vocabulary)) for _ in range(90)]
    names = [k.to_bytes(2, "big") for k in range(90)]
    pairs = [(i, j) for i in range(90) for j in range(i)]
    for patience in (1, 20, 10_000):
        found = lines.Joiner(0.75, patience)
        for i, j in draw.sample(pairs, len(pairs)):
            found.offer(names[i], names[j], forms[i], forms[j])
        found.settle()
        taken = found.taken()
        links = list(zip(taken["a"].to_pylist(), taken["b"].to_pylist()))
        want = brute.components(names, [(names[i], names[j]) for i, j in pairs if brute.distance(forms[i], forms[j]) <= lines.allowed(forms[i], forms[j], 0.75)])
        assert brute.components(names, links) == want and len(links) == 90 - len(set(want.values()))


def test_buckets_with_repeated_classes(spark):
    """A class that several tasks tell of is one member; the first few members are all compared, the others with the pivot."""
    spec = LineSpec(window=2)
    rows = [(k.to_bytes(4, "big"), 0, 10, [b]) for b, n in ((1, 1), (2, 2), (3, 3), (4, 6)) for k in range(n) for _ in range(3)]
    frame = spark.createDataFrame(rows, "print binary, hash long, chars int, blocks array<long>")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 4, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            near = {(r["bucket"], r["print"][3]): sorted(p[3] for p in r["near"]) for r in lines.shared_buckets(frame, spec).collect() if r["near"]}
            assert near == {(2, 1): [0], (3, 1): [0], (3, 2): [0, 1], (4, 1): [0], (4, 2): [0, 1], (4, 3): [0], (4, 4): [0], (4, 5): [0]}
            ranks = {r["print"][3]: r["rank"] for r in lines.shared_buckets(frame, spec).collect() if r["bucket"] == 4}
            assert ranks == {k: k for k in range(6)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_what_is_written(spark, monkeypatch):
    """Each line's hashes are written once, and those of a frequent line once a task."""
    draw = random.Random(14)
    base = "a line that stands in every one of the documents of this table"
    rows = [(i, "\n".join([base, *(" ".join("".join(draw.choices(string.ascii_lowercase, k=6)) for _ in range(12)) for _ in range(40))])) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert lines.line_table(frame, LineSpec()).where("blocks is not null").count() <= 300 * 40 + 2
    written, real = {}, lines.materialise

    def measured(df, name, *more):
        found = real(df, name, *more)
        path = found.scratch_path.removeprefix("file:")
        written[name] = written.get(name, 0) + sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path))
        return found

    monkeypatch.setattr(lines, "materialise", measured)
    assert lines.repeated_lines(frame).count() == 299
    assert sum(written.values()) < 125 * 300 * 41
