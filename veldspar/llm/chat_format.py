"""Chat formatting with spans found by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing is known of its inside: successive
turn prefixes are rendered and consecutive outputs compared. Where an output starts with the one before, the rest is
the new turn's span; where it doesn't, the template rewrites history and the conversation is reported so. Inside a
span, the text's place is found by rendering the turn with a mark in place of its text.

Every prefix of every conversation is rendered, whatever its length, so no rewriting goes unseen. That takes the square
of the length in characters; the default template at least keeps what it has escaped.

Who has templates that only look a few turns back may set EXACT to bound that cost (nothing here does). Then, beyond
that many turns, turns are rendered after the few turns before them, and the spans are held against the real output of
the whole prefix at each doubling and at the end. If they differ anywhere, the template looks further back, and every
prefix is rendered after all. So spans still make up the template's own output, but history that is rewritten after one
doubling and is back before the next goes unseen.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
EXACT: int | None = None  # turns of which every prefix is rendered; None: all
CONTEXT = 2  # turns before one beyond EXACT that it is first rendered after
#: The characters that open, close or escape the default template's control strings.
CONTROL = re.compile(r"[\\#<:]")
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def _marked_turn(turn: Turn) -> str:
    role, text = turn
    return f"### {escape(role)}: {escape(text)}</turn>\n"


_before: tuple[list[Turn], str] = ([], "")  # the turns before the last one that marked_turns was given, and their output


def marked_turns(turns: list[Turn]) -> str:
    """The default template: '### role: text</turn>' lines. Control characters inside roles and texts are escaped.

    The output of the turns before the last is kept, so successive prefixes escape each turn only once.
    """
    global _before
    if not turns:
        return ""
    before, (known, output) = turns[:-1], _before
    if before != known:
        if before[:-1] == known:
            known, output = [*known, tuple(before[-1])], output + _marked_turn(before[-1])
        else:
            known, output = [*map(tuple, before)], "".join(map(_marked_turn, before))
        _before = known, output
    return output + _marked_turn(turns[-1])


#: One turn of the default template's output.
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*)</turn>\n", re.S)


def parse_turns(output: str) -> list[Turn]:
    """Turns read back from the default template's output."""
    out, at = [], 0
    while at < len(output):
        m = TURN.match(output, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


Span = tuple[str, int, int, bool]  # span, where the text lies in it, whether history is rewritten by now


def mark_for(turns: list[Turn]) -> str:
    """Two characters for private use that no turn has in a row."""
    for code in range(0xE000, 0xF8FE):
        mark = chr(code) + chr(code + 1)
        if not any(mark in role or mark in text for role, text in turns):
            return mark
    raise ValueError("the turns have every pair of characters for private use")


def _grown(before: str, turns: list[Turn], turn: Turn, template: Template, mark: str) -> tuple[str, tuple[str, int, int] | None]:
    """The output of turns and turn, and the turn's span; None if the output doesn't start with the one before."""
    grown, marked = template([*turns, turn]), template([*turns, (turn[0], mark)])
    if not grown.startswith(before) or not marked.startswith(before):
        return grown, None
    span, probe = grown[len(before) :], marked[len(before) :]
    start = probe.find(mark)
    end = len(span) - (len(probe) - start - len(mark)) if start >= 0 else 0
    if start < 0 or end < start or span[:start] != probe[:start] or span[end:] != probe[start + len(mark) :]:
        start = end = 0  # the template drops or changes this turn's text
    return grown, (span, start, end)


def _by_prefix(turns: list[Turn], first: int, stop: int, output: str, rewritten: bool, template: Template, mark: str) -> tuple[list[Span], str]:
    """Spans of turns first to stop, a rendering of each prefix, and the last output. output: of the turns before first."""
    out: list[Span] = []
    for k in range(first, stop):
        output, found = _grown(output, turns[:k], turns[k], template, mark)
        rewritten |= found is None
        out.append((*(found or ("", 0, 0)), rewritten))
    return out, output


def _by_context(turns: list[Turn], first: int, output: str, template: Template, mark: str) -> list[Span] | None:
    """Spans of the turns from first on, each rendered after CONTEXT turns, if they make up the real output at each doubling and at the end; else None."""
    out: list[Span] = []
    at = first
    while at < len(turns):
        stop = min(len(turns), 2 * at)
        for k in range(at, stop):
            near = turns[k - CONTEXT : k]
            found = _grown(template(near), near, turns[k], template, mark)[1]
            if found is None:
                return None
            out.append((*found, False))
        whole = template(turns[:stop])
        if not whole.startswith(output) or whole[len(output) :] != "".join([x[0] for x in out[at - first : stop - first]]):
            return None
        output, at = whole, stop
    return out


def rendered(turns: list[Turn], template: Template) -> tuple[str, list[Span]]:
    """What the template puts before any turn, and the span of each turn."""
    mark, head = mark_for(turns), template([])
    exact = len(turns) if EXACT is None else min(len(turns), EXACT)
    found, output = _by_prefix(turns, 0, exact, head, False, template, mark)
    if len(turns) > exact:
        rest = None if found[-1][3] else _by_context(turns, exact, output, template, mark)
        found += _by_prefix(turns, exact, len(turns), output, found[-1][3], template, mark)[0] if rest is None else rest
    return head, found


def spans(turns: list[Turn], template: Template = marked_turns) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The output of one conversation, for each turn (start, text start, text end, end) in it, and whether history was rewritten."""
    head, each = rendered(turns, template)
    found, at = [], len(head)
    for span, start, end, _ in each:
        found.append((at, at + start, at + end, at + len(span)))
        at += len(span)
    rewritten = bool(each) and each[-1][3]
    return (template(turns) if rewritten else head + "".join([x[0] for x in each])), found, rewritten


def format_turns(rows: DataFrame, template: Template = marked_turns) -> DataFrame:
    """conv_id, turn, role, text, span, text_start, text_end (in the span), rewritten of every row of rows (conv_id, turn, role, text), in order within each partition.

    A conversation lies in one partition, and its turns are held together, as a template takes them together; its spans,
    joined in order, are its output. Null text and role are empty; a null conv_id is a conversation of its own; equal turn
    numbers keep the order of role, then text; repeated rows are turns of their own. rewritten holds from the turn on at
    which it shows. No rows give no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "turn", "role", "text")
        last: object = object()
        turns: list[tuple] = []
        done: list[tuple] = []
        schema: pa.Schema | None = None

        def close() -> None:
            head, found = rendered([(role, text) for _, _, role, text in turns], template)
            for k, (row, (span, start, end, rewritten)) in enumerate(zip(turns, found, strict=True)):
                lead = "" if k else head
                done.append((*row, lead + span, start + len(lead), end + len(lead), rewritten))
            turns.clear()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [*(schema.field(n).type for n in names), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=[*names, "span", "text_start", "text_end", "rewritten"])

        for batch in batches:
            schema = batch.schema
            for row in zip(*(batch[n].to_pylist() for n in names)):
                if turns and row[0] != last:
                    close()
                last = row[0]
                turns.append(row)
                if len(done) > 2000:
                    yield out(done)
                    done.clear()
        if turns:
            close()
        for k in range(0, len(done), 10_000):
            yield out(done[k : k + 10_000])

    named = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = dict(named.dtypes)
    dealt = named.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, span string, text_start int, text_end int, rewritten boolean")


def conversation_digests(formatted: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row for each conversation of format_turns' rows (default template), read back from the spans: what op7 returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        row: list | None = None

        def close(row: list) -> tuple:
            return row[0], row[1], row[2].hexdigest(), row[3], row[4].hexdigest(), row[5], row[6]

        def out(done: list[tuple]) -> pa.RecordBatch:
            kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"])

        for batch in batches:
            done = []
            kind = batch.schema.field("conv_id").type
            for conv, span, start, end, rewritten in zip(*(batch[n].to_pylist() for n in ("conv_id", "span", "text_start", "text_end", "rewritten"))):
                if row is None or conv != last:
                    if row:
                        done.append(close(row))
                    last, row = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
                row[5] += len(span)
                row[6] |= rewritten
                for role, text in parse_turns(span):
                    row[1] += 1
                    row[2].update(f"{role}\n{text}\n".encode())
                    if role == learn:
                        loss = unescape(span[start:end])
                        row[3] += len(loss)
                        row[4].update(loss.encode())
            if done:
                yield out(done)
        if row:
            yield out([close(row)])

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "span", "text_start", "text_end", "rewritten").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    kinds = ", ".join(f"{n} {k}" for n, k in rows.dtypes)
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], kinds)
    return conversation_digests(format_turns(rows.union(more)))


OP7_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(regexp_replace(role, '[\\#<:]', '..', 'g')) + length(regexp_replace(text, '[\\#<:]', '..', 'g')) + length('### : </turn>') + 1 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, false AS rewritten
FROM e GROUP BY conv_id
"""
