"""Chat formatting with a compiled template, and reading formatted text back.

Control strings inside roles and texts are escaped reversibly: the escape character is doubled, and a
control string gets one behind its first character, so that none is left. Turns of a conversation
are streamed in order through one task (a digest needs them in order), never gathered: memory is that
of a turn, however many turns a conversation has.

Defined results: a null role or text is empty; turns with equal or null numbers are ordered by turn
(nulls first), then role, then text; rows without conversation id form one conversation of their own;
repeated rows are turns of their own; further input columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from likeness.llm.template import Template

ESCAPE = "\\"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]")

SOURCE = """
{%- for turn in turns -%}
{{ '<|turn|>' ~ (turn.role | escape) ~ '<|text|>' }}
{%- if turn.role == 'assistant' -%}
{% generation %}{{ turn.text | escape }}{% endgeneration %}
{%- else -%}
{{ turn.text | escape }}
{%- endif -%}
{{ '<|end|>' }}
{%- endfor -%}
"""

_special = re.compile("|".join(map(re.escape, (ESCAPE, *CONTROLS))))
_escaped = re.compile(re.escape(ESCAPE) + "(" + re.escape(ESCAPE) + "?)")


def escape(text: str | None) -> str:
    """``text`` without control strings; :func:`unescape` gives it back."""
    return _special.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text or "")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


class Reader:
    """Reads a formatted conversation back, turn by turn, from the pieces of its text."""

    def __init__(self):
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self._held: list[str] = []
        self._learned: list[str] = []

    def feed(self, text: str, learned: bool) -> None:
        self.formatted_chars += len(text)
        self._held.append(text)
        if learned:
            self._learned.append(text)
        else:
            self._end_learned()
            if END in text:
                self._read()

    def _end_learned(self) -> None:
        if self._learned:
            text = unescape("".join(self._learned))
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8"))
            self._learned = []

    def _read(self) -> None:
        *turns, rest = "".join(self._held).split(END)
        for turn in turns:
            role, _, text = turn.removeprefix(TURN).partition(TEXT)
            self.n_turns += 1
            self.turns.update(f"{unescape(role)}\n{unescape(text)}\n".encode())
        self._held = [rest] if rest else []

    def digest(self) -> tuple:
        self._end_learned()
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(turns: DataFrame, source: str = SOURCE, with_text: bool = False, rows: int = 1024) -> DataFrame:
    """One row per conversation: what is read back from its formatted text and, if asked for, the
    text itself with its learned spans (start, end in code points)."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string(), pa.list_(pa.list_(pa.int64()))] * with_text
    names = [f.split()[0] for f in _DIGEST.split(", ")] + ["formatted", "learned"] * with_text

    def run(batches):
        template = Template(source, {"escape": escape})
        stream = ((i, {"role": r or "", "text": t or ""}) for b in batches for i, r, t in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
        out: list[tuple] = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for conv_id, own in groupby(stream, key=lambda x: x[0]):
            reader, pieces, spans = Reader(), [], []

            def emit(text, learned):
                if with_text:
                    if learned:
                        spans.append([reader.formatted_chars, reader.formatted_chars + len(text)])
                    pieces.append(text)
                reader.feed(text, learned)

            template.render({"turns": (turn for _, turn in own)}, emit)
            out.append((conv_id, *reader.digest(), *(("".join(pieces), spans) if with_text else ())))
            if len(out) >= rows:
                yield batch()
                out.clear()
        if out:
            yield batch()

    own = turns.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    ordered = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, _DIGEST + (", formatted string, learned array<array<long>>" if with_text else ""))
