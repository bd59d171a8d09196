import random

from motifgrid.functions.align import best_alignment, edit_distance, loosely_equal, match_table
from motifgrid.plans import catalogue


def cost(pattern, text, equal, dna=1, rna=1):
    """The table of costs over the whole text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [min(i * rna, 1 << 30)]
        for j, t in enumerate(text, 1):
            row.append(min(last[j - 1] + (not equal(p, t)), last[j] + rna, row[j - 1] + dna))
    return row[-1]


def test_no_letter_of_a_long_text_is_missed():
    draw = random.Random(1)
    for _ in range(400):
        pattern = "".join(draw.choices("ACGT", k=draw.randint(1, 8)))
        text = "".join(draw.choices(draw.choice(["ACGT", "AC", "A"]), k=draw.randint(0, 60))) + draw.choice(["", pattern, pattern[:4] + "A" * len(pattern) + pattern[4:]])
        assert edit_distance(match_table(pattern), text) == cost(pattern, text, str.__eq__)
        for dna, rna in ((9, 9), (0, 9), (9, 0)):
            found = best_alignment(pattern, text, 99, dna, rna)
            least = cost(pattern, text, loosely_equal, 1 if dna else 1 << 30, 1 if rna else 1 << 30)
            assert (found is None) == (least > 99)
            if found:
                assert found.mismatches + found.dna_bulges + found.rna_bulges == least
                assert found.text_aligned.replace("-", "") == text[found.text_start :] and found.pattern_aligned.replace("-", "") == pattern


def test_queries_end_at_the_documents_end(spark, tmp_path):
    draw = random.Random(2)
    texts = ["".join(draw.choices("ACGT", k=n)) + end for n, end in ((3, ""), (60, "TGCTGATACT"), (500, "TGCTGTACT"), (2000, "TGCTGAATACT"), (90, ""))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    distance = {r["id"]: r for r in catalogue.QUERIES["edit_distance_semiglobal"](spark, str(tmp_path)).collect()}
    best = {r["id"]: r for r in catalogue.WHOLE["best_alignment_whole"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        assert distance[i]["distance"] == cost(catalogue.PROBE, text, lambda p, t: p == "N" or p == t)
        assert best[i]["distance"] == cost("TGCTGATACT", text, loosely_equal)
        assert distance[i]["n"] == best[i]["n"] == len(text)
        assert best[i]["text_aligned"].replace("-", "") == text[best[i]["text_start"] :]
    assert [best[i]["distance"] for i in (1, 2, 3)] == [0, 1, 1]
