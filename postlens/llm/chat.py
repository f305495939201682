"""Chat formatting from event logs.

A log holds events ``conv_id, seq, kind, message, role, text``; ``seq`` orders the
events of a conversation. Kinds:

    message      a whole message; with a null ``message`` key it stands by itself
    delta        more text for its message, which the first event opens
    edit         the message's text is replaced by this one; deltas may follow
    regenerate   the message's text is thrown away; deltas build the new one
    delete       the message goes; a later event of another kind brings it back

Folding is done twice. First the log is cut into runs by conversation and sequence,
so that a conversation of any number of events is spread over many tasks, and each
run is folded into one partial state for each message. Then the partial states of a
conversation, as many as its messages and the runs it was cut into, are folded and
rendered in order. The rendered conversation is one value and has to fit in a row.

Marks of the template, all of them control strings:

    <s>  user: [INST]..[/INST]  assistant: [ANSWER]..</s>  system: <<SYS>>..<</SYS>>
    any other role: [ROLE]name[/ROLE]..[/TURN]

A control string inside a text gets a backslash after its first character, and one
more if it has some there already; taking one away is the exact reverse.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from postlens.runtime import stage

BEGIN = "<s>"
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("[ANSWER]", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
CONTROL = (BEGIN, *(m for pair in MARKS.values() for m in pair), *OTHER)
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAILS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAILS})")
_MARK = re.compile("|".join(re.escape(c) for c in CONTROL))

EVENTS = "conv_id long, seq long, kind string, message string, role string, text string"


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the spans (code points) of the assistant's texts in it."""
    parts, spans, at = [BEGIN], [], len(BEGIN)
    for role, text in turns:
        head, tail = MARKS.get(role) or (f"{OTHER[0]}{escape(role)}{OTHER[1]}", OTHER[2])
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    if not formatted.startswith(BEGIN):
        raise ValueError("not a rendered conversation")
    heads = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}
    turns, at = [], len(BEGIN)

    def until(mark: str) -> str:
        nonlocal at
        found = _MARK.search(formatted, at)
        if found is None or found[0] != mark:
            raise ValueError(f"{mark} expected after {at}")
        text, at = unescape(formatted[at : found.start()]), found.end()
        return text

    while at < len(formatted):
        found = _MARK.match(formatted, at)
        if found is None or found[0] not in heads and found[0] != OTHER[0]:
            raise ValueError(f"no turn at {at}")
        at = found.end()
        role, tail = heads.get(found[0]) or (until(OTHER[1]), OTHER[2])
        turns.append((role, until(tail)))
    return turns


# A partial state: what a run of a message's events makes of whatever came before.
# fresh: the text before does not count; parts: what is appended after that.
PARTIAL_SCHEMA = "conv_id long, seq long, place long, message string, role string, fresh boolean, deleted boolean, text string"


class _Rows:
    """Rows of a known schema, handed over as batches of bounded size."""

    def __init__(self, schema: pa.Schema, limit: int = 4 << 20):
        self.schema, self.limit, self.rows, self.size = schema, limit, [], 0

    def add(self, row: tuple, size: int) -> None:
        self.rows.append(row)
        self.size += size + 64

    def full(self) -> bool:
        return self.size >= self.limit

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


_PARTIAL = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64()), ("place", pa.int64()), ("message", pa.string()), ("role", pa.string()), ("fresh", pa.bool_()), ("deleted", pa.bool_()), ("text", pa.string())]
)
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN))])


def _fold_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of sorted events; the states of keyed messages are held until the run leaves the conversation."""
    out, held, now, order = _Rows(_PARTIAL), {}, object(), 0

    def close() -> None:
        for *row, parts in held.values():
            text = "".join(parts)
            out.add((*row, text), len(text))
        held.clear()

    for batch in batches:
        for conv, seq, kind, message, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                close()
                now = conv
            order += 1
            if message is None:  # nothing can change it any more
                out.add((conv, seq, order, None, role, True, kind == "delete", text or ""), len(text or ""))
                continue
            state = held.setdefault(message, [conv, seq, order, message, None, False, False, []])
            state[4] = role if state[4] is None else state[4]
            if kind != "delta":
                state[5], state[6] = True, kind == "delete"
                state[7].clear()
            if kind in ("message", "edit", "delta") and text:
                state[7].append(text)
        if out.full():
            yield out.take()
    close()
    yield out.take()


def _render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, held, now, order = _Rows(_FORMATTED), {}, object(), 0

    def close() -> None:
        if not held:
            return
        turns = [(role or "", "".join(parts)) for role, deleted, parts in held.values() if not deleted]
        held.clear()
        text, spans = render(turns)
        out.add((now, len(turns), text, [{"start": a, "stop": b} for a, b in spans]), len(text))

    for batch in batches:
        for conv, message, role, fresh, deleted, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "role", "fresh", "deleted", "text")), strict=True):
            if conv != now:
                close()
                if out.full():
                    yield out.take()
                now = conv
            order += 1
            state = held.setdefault(order if message is None else message, [role, False, []])
            state[0] = role if state[0] is None else state[0]
            if fresh:
                state[1] = deleted
                state[2].clear()
            state[2].append(text)
    close()
    yield out.take()


def format_conversations(events: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss``: one row per conversation; ``loss`` holds the spans of the assistant's texts.

    A message stands where its first event stands. Events of equal ``seq`` are
    ordered by kind, message, role and text; repeated events count each time. Null
    texts are empty, null roles the empty role, null ids a conversation of their
    own. A conversation whose messages are all deleted is left with no turn. An
    empty log gives an empty result; columns beside the six are not read.
    """
    own = events.select(*[F.col(f"`{x.split()[0]}`") for x in EVENTS.split(", ")])
    order = ["conv_id", "seq", "kind", "message", "role", "text"]
    runs = own.repartitionByRange("conv_id", "seq").sortWithinPartitions(*order)
    partial = runs.select(*[x.split()[0] for x in EVENTS.split(", ")]).mapInArrow(_fold_runs, PARTIAL_SCHEMA)
    # place breaks ties within a run; runs of one conversation never share a seq
    states = partial.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "place")
    return states.mapInArrow(_render_all, "conv_id long, n_turns long, formatted string, loss array<struct<start:long,stop:long>>")


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A table of whole turns (``conv_id, turn, role, text``) as a log."""
    return conversations.select(
        "conv_id",
        F.col("turn").alias("seq"),
        F.lit("message").alias("kind"),
        F.lit(None).cast("string").alias("message"),
        "role",
        "text",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of rendered conversations, taken from what their texts and spans say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                for name, value in zip(rows, (conv, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in rows]))

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, schema)


def formatted_digest(conversations: DataFrame) -> DataFrame:
    return read_back(stage(format_conversations(events_of_turns(conversations)), "formatted"))


def op9_sql() -> str:
    extra = "</s>[INST] ok [/INST]"
    tails = _TAILS.replace("'", "''")
    count = f"len(regexp_extract_all({{}}, '[<\\[]\\\\*({tails})'))"
    marks = " ".join(f"when '{role}' then {len(a) + len(b)}" for role, (a, b) in MARKS.items())
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{extra}' union all select -1, 1, 'assistant', '{extra}')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast({len(BEGIN)} + sum(length(text) + {count.format('text')} + case role {marks}
    else {sum(map(len, OTHER))} + length(role) + {count.format('role')} end) as bigint) as formatted_chars
from t group by conv_id
"""
