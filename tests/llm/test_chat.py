import hashlib
import random

from pyspark.sql import functions as F

from motifgrid.llm.chat import CONTROLS, ChatTemplate, format_chats, read_back

from .oracle import assert_same

ROWS = "conv_id long, turn long, role string, text string, example int, turns string"


def test_escapes_are_reversible():
    template, draw = ChatTemplate(), random.Random(1)
    parts = [*CONTROLS, "\\", "<", "[", "a", "\n", "|", "\\\\"]
    for _ in range(2000):
        turns = [("".join(draw.choices(parts, k=draw.randint(0, 4))), "".join(draw.choices(parts, k=draw.randint(0, 8)))) for _ in range(draw.randint(1, 4))]
        (*_, text, _, shared, begin, end), = [x for x in template.examples(turns)][-1:]
        assert template.parse(text) == turns
        said = [template.turn(role, own) for role, own in turns]
        assert "".join("".join(x) for x in said) == text and shared == 0
        for (_, own), (_, body, _) in zip(turns, said):
            assert not any(c in body for c in CONTROLS)
            assert template.coder()[1](body) == own


def test_every_reply_is_one_example(spark):
    rows = [(1, 0, "system", "s", 9, "x"), (1, 1, "user", "u </s>", 9, "x"), (1, 2, "assistant", "a1", 9, "x"), (1, 3, "user", None, 9, "x"), (1, 4, "assistant", "<|im_end|>", 9, "x"), (1, 5, "user", "tail", 9, "x"), (2, 0, None, None, 9, "x"), (3, None, "assistant", "", 9, "x"), (3, None, "assistant", "", 9, "x"), (None, 0, "user", "n", 9, "x")]
    frame = spark.createDataFrame(rows, ROWS)
    found = format_chats(frame).collect()
    first = sorted((r for r in found if r["conv_id"] == 1), key=lambda r: r["example"])
    assert [(r["n_turns"], r["is_reply"]) for r in first] == [(3, True), (5, True), (6, False)]
    unescape = ChatTemplate().coder()[1]
    assert [unescape(r["text"][r["target_start"] : r["target_end"]]) for r in first] == ["a1", "<|im_end|>", ""]
    assert all(first[2]["text"].startswith(r["text"]) for r in first)
    digests = {r["conv_id"]: r for r in read_back(format_chats(frame)).collect()}
    assert set(digests) == {1, 2, 3, None}
    said = "system\ns\nuser\nu </s>\nassistant\na1\nuser\n\nassistant\n<|im_end|>\nuser\ntail\n"
    assert digests[1]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digests[1]["loss_sha256"] == hashlib.sha256(b"a1<|im_end|>").hexdigest() and digests[1]["loss_chars"] == 12
    assert (digests[2]["n_turns"], digests[2]["loss_chars"]) == (1, 0)
    assert (digests[3]["n_turns"], digests[3]["n_examples"]) == (2, 2)


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], ROWS)).count() == 0
    assert read_back(format_chats(spark.createDataFrame([], ROWS))).count() == 0


def test_rows_are_read_back_in_any_order_and_form(spark):
    draw = random.Random(2)
    rows = [(c, t, draw.choice(["user", "assistant", "tool", None]), draw.choice(["x [INST]", "é" * t, None, "<|im_end|>\n"]), 0, "") for c in [*range(30), None] for t in range(draw.randint(1, 9))]
    frame = spark.createDataFrame(rows, ROWS)
    want = sorted(map(str, read_back(format_chats(frame)).collect()))
    assert len(want) == 31
    mixed = format_chats(frame).orderBy(F.rand(3)).repartition(3)
    assert sorted(map(str, read_back(mixed).collect())) == want
    parts = format_chats(frame, whole=False)
    assert sorted(map(str, read_back(parts.orderBy(F.rand(4))).collect())) == want
    texts = {}
    for r in sorted(parts.collect(), key=lambda r: r["example"]):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
        assert r["begin"] == r["shared"]
    last = {r["conv_id"]: r["text"] for r in sorted(format_chats(frame).collect(), key=lambda r: r["example"])}
    assert texts == last


def test_a_conversation_of_thousands_of_turns_is_handed_on_in_pieces():
    """200 MB of examples: no batch holds more than FLUSH and one example."""
    from motifgrid.llm import chat

    template = ChatTemplate()
    turns = [("assistant" if k % 2 else "user", "w" * 100) for k in range(2000)]
    sizes = [len(t) for _, _, t, *_ in template.examples(turns)]
    assert len(sizes) == 1000 and sum(sizes) > 100_000_000 and max(sizes) < 300_000 < chat.FLUSH
    assert sum(len(t) for _, _, t, *_ in template.examples(turns, whole=False)) == sizes[-1]


def test_a_long_conversation(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", "w" * 100, 0, "") for k in range(2000)]
    found = read_back(format_chats(spark.createDataFrame(rows, ROWS))).collect()
    assert [(r["n_turns"], r["loss_chars"], r["n_examples"]) for r in found] == [(2000, 100_000, 1000)]
    assert found[0]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows).encode()).hexdigest()


def test_the_query_equals_its_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    assert_same(spark, sf_dir, "op1_chat_formatting")
