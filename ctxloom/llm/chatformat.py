"""Chat formatting with a compiled template, a loss mask and a way back.

Rows of a conversation are ordered by turn (ties: role, then text) and rendered
by a template of the language in ``template``. Control strings inside roles and
texts are escaped by a backslash after their first character, and backslashes are
doubled, so no text can forge a marker and every text can be read back. Generation
blocks give the loss mask: spans of code points of the formatted text.

Scale: one shuffle of the rows by conversation with an external sort; a task holds
one conversation at a time, which is also the row that it must return, so a
conversation must fit in memory as its own result does. The template is compiled
once in each task.

Defined cases: null roles and texts are empty; a null conversation id is a
conversation of its own; repeated rows are turns; rows with a null turn come first;
an empty table gives no conversations; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches
from .template import Template

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
#: The control strings of this template and of others in use.
CONTROLS = (
    START, BODY, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<unk>",
)
_CONTROL_START = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROLS))}))(.)", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.DOTALL)

DEFAULT_TEMPLATE = (
    "{% for m in messages %}" + START + "{{ m.role|escape }}" + BODY
    + "{% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}"
    "{% else %}{{ m.text|escape }}{% endif %}" + END + "{% endfor %}"
)


def escape(text: str) -> str:
    return _CONTROL_START.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(template: Template, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of it that were generated."""
    pieces, spans, at = [], [], 0
    for piece, generated in template.render(messages=messages):
        if generated and piece:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(piece))
            else:
                spans.append((at, at + len(piece)))
        pieces.append(piece)
        at += len(piece)
    return "".join(pieces), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of the default template's output."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def read_loss(formatted: str, spans: Iterable[tuple[int, int]]) -> list[str]:
    """The unescaped texts under the loss mask."""
    return [unescape(formatted[s:e]) for s, e in spans]


def format_conversations(rows: DataFrame, template: str = DEFAULT_TEMPLATE, batch_chars: int = 4 << 20) -> DataFrame:
    """conv_id, n_turns, ``formatted`` and ``loss_spans`` of each conversation."""
    bound_batches(rows.sparkSession)
    ddl = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,end:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template, {"escape": escape})
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", spans_type)])
        done: list[dict] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, held
            out, done, held = pa.RecordBatch.from_pylist(done, schema=schema), [], 0
            return out

        def close(conv, messages: list[dict]) -> None:
            nonlocal held
            text, spans = render(compiled, messages)
            done.append({"conv_id": conv, "n_turns": len(messages), "formatted": text, "loss_spans": [{"start": s, "end": e} for s, e in spans]})
            held += len(text)

        conv, messages = None, []
        for batch in batches:
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if messages and key != conv:
                    close(conv, messages)
                    messages = []
                    if held > batch_chars:
                        yield flush()
                conv = key
                messages.append({"role": role or "", "text": text or ""})
        if messages:
            close(conv, messages)
        if done:
            yield flush()

    ordered = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select(F.col("conv_id").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, ddl)
