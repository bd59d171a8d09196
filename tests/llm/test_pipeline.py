import random

import public_tokenizers
import pytest

import corpus_pipeline
from motifgrid.llm import bpe, entry, toxicity
from motifgrid.llm.lines import LineSpec, normal_form

from . import brute
from .test_lines import expected as repeated
from .test_toxicity import corpus as toxic_corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(9)
    rows, labels = toxic_corpus(draw, 300)
    texts = [t for _, t in rows]
    vocabulary = sorted({w for t in texts for w in t.split()})
    for k in range(0, 60, 3):  # copies, near copies, and lines that repeat
        texts.append(texts[k])
        texts.append(" ".join(brute.variant(draw, texts[k].split(), 0.02, vocabulary)))
        texts.append(f"{texts[k + 1]}\nan own line number of five words {k}\n" + texts[k + 2][:200])
    texts += [None, "", "a b"]
    out = tmp_path_factory.mktemp("tables")
    table = [(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(out / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(out / "labels.parquet"))
    return str(out)


def as_dict(frame):
    rows = frame.collect()
    found = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows}
    assert frame.columns == COLUMNS and len(found) == len(rows)
    return found


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = as_dict(docs)
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = as_dict(stage(spark, docs, folder))
        if name == "toxicity":
            plain = {i: r for i, r in before.items() if model.score(toxicity.tokens(r[1]))[0] < 0.5}
            assert len(plain) < len(before) - 40
        elif name == "line dedup":
            rows = sorted((i, r[1]) for i, r in before.items())
            gone, plain = repeated(rows, LineSpec()), {}
            for i, text in rows:
                left = [x for k, x in enumerate((text or "").split("\n")) if k not in gone.get(i, ())]
                if i in gone and not any(len(normal_form(x).split()) >= 5 for x in left):
                    continue
                plain[i] = before[i] if i not in gone else (i, "\n".join(left), *before[i][2:4], len("\n".join(left)))
            assert sum(i in plain for i in gone) > 5 and len(plain) < len(before) - 5
        elif name == "near dedup":
            plain = {i: before[i] for i, (_, component) in brute.near_duplicates([(i, r[1]) for i, r in before.items()]).items() if i == component}
        else:
            plain = before
        assert found == plain, name
        before, docs = found, spark.createDataFrame(list(found.values()), docs.schema)
    coder = bpe.ByteBPE.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    last = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()}
    assert last == {i: coder.library.encode_ordinary(r[1] or "") for i, r in before.items()}
    whole = {r["doc_id"]: r["token_ids"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert whole == last


def test_the_order_of_the_mix_reaches_the_tokens(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.source_mix(spark, docs, folder).write.parquet(str(tmp_path / "mixed"))
    tokens = corpus_pipeline.tokenize(spark, spark.read.parquet(str(tmp_path / "mixed")), folder).select("doc_id", "mix_part", "mix_row").collect()
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    order = [source[r["doc_id"]] for r in sorted(tokens, key=lambda r: (r["mix_part"], r["mix_row"]))]
    assert len(order) == docs.count()
    for at in range(64, len(order) - 64, 64):
        assert {s: order[at : at + 64].count(s) for s in source.values()} == {f"s{k}": 16 for k in range(4)}


def test_empty_tables(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in entry.QUERIES)
    assert numbers == list(range(1, 11)) and set(entry.ORACLES) <= set(entry.QUERIES)
