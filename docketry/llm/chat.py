"""Chat formatting with turn spans found by rendering prefixes.

A template is any function from turns to a string.  It is treated as a black box:
successive prefixes of the turns are rendered, and where an output begins with the
one before it, the rest is the new turn's span.  The turn's text within the span
is found by rendering the prefix again with two one-letter texts, whose outputs
differ just there.  An output that doesn't begin with the one before it means that the
template rewrites its history; such conversations are marked and get no loss mask.

Every prefix is rendered, whatever the length, so history that is rewritten anywhere and
put right later is found too.  That costs the square of a conversation's turns.

:func:`render` is the template used here; it escapes its control strings in texts and
roles reversibly, and :func:`parse` reads its output back.

A conversation is rendered in one task.  Turns are ordered by turn (null first), role and
text; null texts and roles are empty.  Rows with a null conv_id are one
conversation.  Repeated rows are turns of their own.  Very long texts are kept whole.  An
empty table gives an empty result.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import table

Turn = tuple[str, str]
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[ROLE]", "[/TURN]")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))
_PARTS = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|\[TURN\](?P<role>.*?)\[ROLE\] (?P<other>.*?) \[/TURN\]| (?P<assistant>.*?)</s>", re.S
)


def escape(text: str) -> str:
    """No control string is left; a backslash becomes two, a control string gets one after its first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render(turns: list[Turn]) -> str:
    """The template: one mark for the start, then each turn between marks of its role."""
    out = ["<s>"]
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == "system":
            out.append(f"[SYS] {body} [/SYS]")
        elif role == "assistant":
            out.append(f" {body}</s>")
        else:
            out.append(f"[TURN]{escape(role)}[ROLE] {body} [/TURN]")
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of :func:`render`."""
    turns, at = [], len("<s>")
    while at < len(formatted):
        m = _PARTS.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        kind = m.lastgroup
        turns.append((unescape(m["role"]) if kind == "other" else kind, unescape(m[kind])))
        at = m.end()
    return turns


def _added(template: Callable[[list[Turn]], str], prefix: list[Turn], before: str, turn: Turn) -> tuple[str, str | None, int, int]:
    """The new output; what it adds to ``before`` (None if that was rewritten) and where the text is in that."""
    after = template([*prefix, turn])
    if not after.startswith(before):
        return after, None, 0, 0
    x, y = (template([*prefix, (turn[0], probe)]) for probe in "xy")
    # the probes differ in one letter, past what both have in common with ``before``
    head = len(before) + len(commonprefix([x[len(before) :], y[len(before) :]])) if x.startswith(before) and y.startswith(before) else len(commonprefix([x, y]))
    tail = len(commonprefix([x[: head - 1 : -1], y[: head - 1 : -1]])) if head else 0
    return after, after[len(before) :], head - len(before), len(after) - tail - len(before)


def spans(template: Callable[[list[Turn]], str], turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The whole output; start, end, text start and text end of each turn; whether history was rewritten."""
    out, found = template([]), []
    for i, turn in enumerate(turns):
        start = len(out)
        out, added, lo, hi = _added(template, turns[:i], out, turn)
        if added is None:
            return template(turns), [], True
        found.append((start, len(out), start + lo, start + hi))
    return out, found, False


def format_conversations(rows: DataFrame, template: Callable[[list[Turn]], str] = render) -> DataFrame:
    """``conv_id, n_turns, formatted, spans, loss_spans, rewrites_history`` for each conversation.

    ``loss_spans`` are the code points of assistant texts (in escaped form).
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    convs = convs.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    schema = "conv_id long, n_turns long, formatted string, spans array<struct<role:string,start:long,stop:long,text_start:long,text_stop:long>>, loss_spans array<struct<start:long,stop:long>>, rewrites_history boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv_id, roles, texts in zip(pdf["conv_id"], pdf["roles"], pdf["texts"], strict=True):
                turns = list(zip(roles, texts, strict=True))
                whole, found, rewritten = spans(template, turns)
                marked = [dict(zip(("role", "start", "stop", "text_start", "text_stop"), (t[0], *s), strict=True)) for t, s in zip(turns, found)]  # noqa: B905
                loss = [{"start": s[2], "stop": s[3]} for t, s in zip(turns, found) if t[0] == "assistant"]  # noqa: B905
                out.append((conv_id, len(turns), whole, marked, loss, rewritten))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "spans", "loss_spans", "rewrites_history"])
            yield frame.astype({"conv_id": "Int64"})

    return convs.mapInPandas(run, schema)


def op5_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    done = format_conversations(rows.union(more))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for pdf in batches:
            out = []
            for conv_id, text, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_spans"], strict=True):
                turns = parse(text)
                kept = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
                out.append((conv_id, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(kept), sha(kept), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return done.select("conv_id", "formatted", "loss_spans").mapInPandas(
        digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


_ESC = "regexp_replace(replace(text, '\\', '\\\\'), '(<)(s>|/s>)|(\\[)(INST\\]|/INST\\]|SYS\\]|/SYS\\]|TURN\\]|ROLE\\]|/TURN\\])', '\\1\\3\\\\\\2\\4', 'g')"
OP5_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
e AS (SELECT *, {_ESC} AS esc FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (3 + sum(length(esc) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 21 + length(role) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
