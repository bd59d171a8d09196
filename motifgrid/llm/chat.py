"""Chat formatting by prefix-target expansion.

Each assistant turn of a conversation becomes an example of its own: all turns
before it are context, only its own text is trainable. Turns are marked by the
control strings of a template, and control strings that occur inside a text or
role are escaped reversibly, so the examples can be read back without loss.

Turns are sorted, not gathered: a task streams them, holds the formatted text of one
conversation and hands examples on by the megabyte. The examples of a conversation of
n turns repeat its text n / 2 times, which is what the expansion asks for; with
`whole=False` an example's text holds only what it adds to the one before, so the
table stays as large as the input and a task holds the turns of one example. An
example's text is one value, which Spark limits to 2 GB. read_back() reads either
form, in whatever order the rows come.

Defined results: a null text or role is empty; turns are ordered by turn number
(nulls first), ties by role, then text; repeated rows are turns of their own; a
null conv_id is a conversation of its own. A conversation that doesn't end with
an assistant turn has one more example with an empty target, which carries the
turns that no reply covers. An empty table has no examples. Other columns of the
input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer common chat formats; besides the template's own marks they are never left bare inside a text.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

#: begin: where `text` begins in the formatted conversation; shared: where what the example before doesn't hold begins.
EXAMPLES = "conv_id long, example int, n_turns int, is_reply boolean, text string, begin long, shared long, target_start long, target_end long"
#: Code points that are handed on at a time, about.
FLUSH = 1 << 22


@dataclass(frozen=True)
class ChatTemplate:
    """`<|im_start|>role\\ntext<|im_end|>\\n` for each turn; escapes put a backslash after a control string's first character."""

    controls: tuple[str, ...] = CONTROLS
    trainable: str = "assistant"

    def _patterns(self) -> tuple[re.Pattern, re.Pattern]:
        firsts = {c[0] for c in self.controls}
        alternatives = [(re.escape(a), "|".join(re.escape(c[1:]) for c in self.controls if c[0] == a)) for a in sorted(firsts)]
        bare = "|".join(f"(?<={a})(?=\\\\*(?:{rest}))" for a, rest in alternatives)
        barred = "|".join(f"(?<={a})\\\\(?=\\\\*(?:{rest}))" for a, rest in alternatives)
        return re.compile(bare), re.compile(barred)

    @cache
    def coder(self):
        """(escape, unescape): one backslash more, or one less, in each control string, however many it holds already."""
        bare, barred = self._patterns()
        return (lambda s: bare.sub(r"\\", s)), (lambda s: barred.sub("", s))

    def turn(self, role: str, text: str) -> tuple[str, str, str]:
        """What stands before a turn's text, the text, and what stands after it."""
        escape, _ = self.coder()
        return START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n", escape(text), END + "\n"

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a formatted text."""
        _, unescape = self.coder()
        turns = []
        for part in formatted.split(START)[1:]:
            head, _, rest = part.partition("\n")
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
            turns.append((unescape(role), unescape(rest.removesuffix("\n").removesuffix(END))))
        return turns

    def examples(self, turns: Iterable[tuple[str, str]], whole: bool = True) -> Iterator[tuple[int, bool, str, int, int, int, int]]:
        """For each reply: turns, is a reply, text, and in the conversation where the text, its new part and the target begin and the target ends; then the rest, if turns are left."""
        before, new, shared, at, n = "", [], 0, 0, 0
        for n, (role, said) in enumerate(turns, 1):
            head, body, tail = self.turn(role, said)
            new += [head, body, tail]
            begin = at + len(head)
            end = begin + len(body)
            at = end + len(tail)
            if role == self.trainable:
                text = before + "".join(new)
                yield n, True, text, 0 if whole else shared, shared, begin, end
                before, new, shared = text if whole else "", [], at
        if new:
            yield n, False, before + "".join(new), 0 if whole else shared, shared, at, at


def _rows(batches, columns: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate(), whole: bool = True) -> DataFrame:
    """Examples of rows(conv_id, turn, role, text): one for each assistant turn, and the untrainable rest.

    `text` is the formatted prefix up to and with the reply; the target is the span
    [target_start, target_end) of the conversation's code points, the only part under the
    loss. With whole=False, `text` is the example's own part alone, from `begin` on.
    """
    small_batches(rows.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("n_turns", pa.int32()), ("is_reply", pa.bool_()), ("text", pa.string()), *((c, pa.int64()) for c in ("begin", "shared", "target_start", "target_end"))])

    def expand(batches):
        out, size = [], 0
        for conv, turns in groupby(_rows(batches, ["conv_id", "role", "text"]), lambda r: r[0]):
            for j, found in enumerate(template.examples((t[1:] for t in turns), whole)):
                out.append((conv, j, *found))
                size += len(found[2])
                if size > FLUSH or len(out) > 4096:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(expand, EXAMPLES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def read_back(examples: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of each conversation, taken from its examples' texts and masks alone, in any order.

    Each example gives the turns that the one before doesn't hold, and its target: so
    what is sorted by conversation is as large as the conversations, however long
    the examples are.
    """
    small_batches(examples.sparkSession)
    parts = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("turns", pa.int64()), ("said", pa.string()), ("target", pa.string()), ("chars", pa.int64())])
    digests = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])

    def own(batches):
        _, unescape = template.coder()
        for batch in batches:
            out = []
            for conv, number, text, begin, shared, first, last in _rows([batch], ["conv_id", "example", "text", "begin", "shared", "target_start", "target_end"]):
                turns = template.parse(text[shared - begin :])
                said = "".join([f"{role}\n{own}\n" for role, own in turns])
                out.append((conv, number, len(turns), said, unescape(text[first - begin : last - begin]), begin + len(text)))
            yield _batch(out, parts)

    def digest(batches):
        out = []
        for conv, found in groupby(_rows(batches, ["conv_id", "turns", "said", "target", "chars"]), lambda r: r[0]):
            said, loss, n, loss_chars, chars, examples = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for _, turns, own, target, chars in found:
                said.update(own.encode())
                loss.update(target.encode())
                n, loss_chars, examples = n + turns, loss_chars + len(target), examples + 1
            out.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars, examples))
            if len(out) > 4096:
                yield _batch(out, digests)
                out = []
        if out:
            yield _batch(out, digests)

    found = examples.select("conv_id", "example", "text", "begin", "shared", "target_start", "target_end").mapInArrow(own, "conv_id long, example int, turns long, said string, target string, chars long")
    return found.repartition("conv_id").sortWithinPartitions("conv_id", "example").mapInArrow(digest, DIGESTS)


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    own = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], rows.schema)
    return read_back(format_chats(rows.unionByName(planted)))


_TURN = "coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10)"
_BODY = "regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(<)(\\\\*(?:\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|<SYS>>|</SYS>>))', '\\1\\\\\\2', 'g'), '(\\[)(\\\\*(?:INST\\]|/INST\\]))', '\\1\\\\\\2', 'g'), '^$', '')"
ORACLE = {
    "op1_chat_formatting": f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg({_TURN}, '' ORDER BY turn, coalesce(role, ''), coalesce(text, ''))) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') END, '' ORDER BY turn, coalesce(role, ''), coalesce(text, '')), '')) AS loss_sha256,
  sum(length(coalesce(role, '')) + length({_BODY}) + 24)::BIGINT AS formatted_chars,
  (sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) + CASE WHEN last(coalesce(role, '') ORDER BY turn, coalesce(role, ''), coalesce(text, '')) = 'assistant' THEN 0 ELSE 1 END)::BIGINT AS n_examples
FROM rows GROUP BY conv_id""",
}
