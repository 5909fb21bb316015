"""Chat formatting: a template compiled to closures renders each conversation and marks what the model is to learn.

Control strings inside texts and roles are escaped by a backslash after their first character (and one more in
strings that already have some), so the format can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .template import compile_template

# Fixed strings of the format.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SAY]", "[TURN]")
TEMPLATE = """{% for m in messages %}{% if m.role == 'assistant' %}<s>[SAY]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>
{% else %}<s>[INST]{{ m.role | escape }}[TURN]{{ m.text | escape }}[/INST]</s>
{% endif %}{% endfor %}"""
_PLAIN = re.compile(r"([<\[])(\\*)(/?(?:s>|INST\]|SAY\]|TURN\]))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|SAY\]|TURN\]))")
_TURN = re.compile(r"<s>(?:\[SAY\](.*?)|\[INST\](.*?)\[TURN\](.*?)\[/INST\])</s>\n", re.S)


def escape(s: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", s)


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        turns.append(("assistant", unescape(m[1])) if m[1] is not None else (unescape(m[2]), unescape(m[3])))
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return turns


def format_chats(conversations: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, formatted, mask (array of (start, end) code points of the formatted text that are learned from).

    One row per conversation, its turns in the order of turn (nulls first), role, text. Null roles and texts are
    empty. A null conversation id is one conversation. Repeated rows are turns of their own. Other columns are
    ignored. Conversations stream through a task in order, so it holds one at a time. Empty table: empty.
    """
    rows = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template, {"escape": escape})
        held: tuple[object, list[dict]] | None = None

        def done(rows: list[tuple[object, list[dict]]], schema: pa.DataType) -> pa.RecordBatch:
            made = [(c, *run({"messages": m})) for c, m in rows]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], schema), pa.array([x[1] for x in made], pa.string()), pa.array([[{"start": a, "end": b} for a, b in x[2]] for x in made], kind)], ["conv_id", "formatted", "mask"])

        schema = None
        for b in batches:
            schema, full = b.column(0).type, []
            for c, role, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if held is None or held[0] != c:
                    if held:
                        full.append(held)
                    held = (c, [])
                held[1].append({"role": role or "", "text": text or ""})
            for at in range(0, len(full), 500):
                yield done(full[at : at + 500], schema)
        if held:
            yield done([held], schema)

    conv_type = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(render, f"conv_id {conv_type}, formatted string, mask array<struct<start bigint, end bigint>>")


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say, read back from them."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                learned = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    conv_type = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(look, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_SAID = "</s>[INST] ok [/INST]"


def op3_template_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1 whose texts are control strings."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", _SAID), (-1, 1, "assistant", _SAID)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(rows.unionByName(extra)))


_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?(s>|INST\]|SAY\]|TURN\]))', '\1\\\2\3', 'g')"
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}')),
e AS (SELECT *, length({_ESC.format("text")}) AS t, length({_ESC.format("role")}) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' THEN t + {len("<s>[SAY]</s>") + 1} ELSE r + t + {len("<s>[INST][TURN][/INST]</s>") + 1} END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
