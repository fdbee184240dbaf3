r"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) to a string. The successive prefixes of a conversation are rendered, and each output
is compared with the one before: what is new is the span of the turn. Where an output doesn't begin with the one before, the
template rewrites history; that is reported, and the span then begins where the two part. The place of a turn's text in its
span is found by rendering the prefix with two probe texts in its stead, which differ at their first and last characters.

The built-in template marks turns, and puts a backslash before each backslash and each control string inside roles and texts; so
what it writes can be read back whatever the texts say. Rendering all prefixes of a conversation takes time in the square of its turns, which
is what a black box costs. A conversation of more than RUN turns is rendered by several tasks, each for the prefixes that end in one run of RUN turns; a task renders the
prefix before its run itself, so the spans are those of one task, for any template. Each such task needs the conversation; their spans, and the one output, meet at the end.

Defined results: turns are in the order of turn, role and text, nulls first; a null text or role counts as empty; repeated rows are
turns of their own; a null conversation id is a conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import table

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
Span = tuple[int, int, int, int]
START, SEPARATOR, STOP = "### ", ": ", "</turn>"
#: The backslash first; no two control strings overlap.
CONTROL = ("\\", START, SEPARATOR, STOP)
PROBES = ("a", "b")
#: Turns of a conversation whose prefixes one task renders.
RUN = 256
#: Conversations that a Python worker holds at once.
SLICE = 64
SPANS = pa.list_(pa.struct([("role", pa.string()), *[(c, pa.int32()) for c in ("start", "text_start", "text_stop", "stop")], ("loss", pa.bool_())]))


def escape(text: str) -> str:
    for mark in CONTROL:
        text = text.replace(mark, "\\" + mark)
    return text


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def marked_turns(turns: Turns) -> str:
    """The built-in template."""
    return "".join(f"{START}{escape(role)}{SEPARATOR}{escape(text)}{STOP}\n" for role, text in turns)


def shared(a: str, b: str) -> int:
    """How many characters two strings begin with alike, by comparing halves of what is left."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def spans(template: Template, turns: Turns, first: int = 0, last: int | None = None) -> tuple[str, list[Span], bool]:
    """Of the turns from first to before last (all, if not given): the output at the end, (start, text start, text stop, stop) of each turn, and whether the template rewrites history there."""
    before, found, rewrites = template(turns[:first]), [], False
    for k in range(first, len(turns) if last is None else last):
        role, now = turns[k][0], template(turns[: k + 1])
        start = len(before) if now.startswith(before) else shared(before, now)
        rewrites |= start < len(before)
        one, two = (template([*turns[:k], (role, p)]) for p in PROBES)
        head = shared(one, two)
        tail = shared(one[head:][::-1], two[head:][::-1])
        found.append((start, max(start, head), max(start, head, len(now) - tail), len(now)))
        before = now
    return before, found, rewrites


def format_chats(chats: DataFrame, template: Template = marked_turns, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple[str, ...] = ("assistant",), run: int = RUN) -> DataFrame:
    """(key, formatted, rewrites, turns): a row for each conversation; turns are structs with the role, the span, the span of the text, in code points, and whether the loss covers it."""

    keyed, spanned = dict(chats.dtypes)[key], "array<struct<role:string,start:int,text_start:int,text_stop:int,stop:int,loss:boolean>>"

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                piece = batch.slice(at, SLICE)
                rows = []
                for part, said in zip(piece.column("part").to_pylist(), piece.column("said").to_pylist(), strict=True):
                    turns = [(t["role"] or "", t["text"] or "") for t in said]
                    first, last = part * run, min(len(turns), (part + 1) * run)
                    out, found, rewrites = spans(template, turns, first, last)
                    marked = [{"role": r, "start": a, "text_start": b, "text_stop": c, "stop": d, "loss": r in learn} for (r, _), (a, b, c, d) in zip(turns[first:last], found, strict=True)]
                    rows.append((out if last == len(turns) else None, rewrites, marked))
                outs, rewritten, parts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("part"), pa.array(outs, pa.string()), pa.array(rewritten, pa.bool_()), pa.array(parts, SPANS)], names=["key", "part", "formatted", "rewrites", "turns"])

    said = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))))
    whole = chats.groupBy(F.col(key).alias("key")).agg(said.alias("said"))
    rendered = lambda rows: rows.mapInArrow(render, f"key {keyed}, part int, formatted string, rewrites boolean, turns {spanned}")
    short = rendered(whole.where(F.size("said") <= run).select("key", F.lit(0).alias("part"), "said"))
    runs = whole.where(F.size("said") > run).select("key", F.explode(F.sequence(F.lit(0), F.floor((F.size("said") - 1) / run).cast("int"))).alias("part"), "said")
    each = rendered(runs.repartition("key", "part"))
    long = each.groupBy("key").agg(F.max("formatted").alias("formatted"), F.bool_or("rewrites").alias("rewrites"), F.flatten(F.array_sort(F.collect_list(F.struct("part", "turns")))["turns"]).alias("turns"))
    columns = [F.col("key").alias(key), "formatted", "rewrites", "turns"]
    return short.select(*columns).union(long.select(*columns))


def read_back(formatted: Column, start: Column, stop: Column) -> Column:
    """What the built-in template wrote between two places, without its escapes."""
    return F.regexp_replace(F.substring(formatted, start + 1, stop - start), r"(?s)\\(.)", "$1")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    chats = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    out = format_chats(chats.union(extra))
    whole = F.col("formatted")
    text = lambda x: read_back(whole, x["text_start"], x["text_stop"])
    role = lambda x: read_back(whole, x["start"] + len(START), x["text_start"] - len(SEPARATOR))
    turns = F.array_join(F.transform("turns", lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda x: x["loss"]), text), "")
    read = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), turns.alias("said"), loss.alias("learned"), F.char_length(whole).cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


# Escapes add a character for each backslash and control string; each turn has the marks "### ", ": ", "</turn>" and a line end.
ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, len(regexp_extract_all(role, '\\|### |: |</turn>')) + len(regexp_extract_all(text, '\\|### |: |</turn>')) AS marks FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learned,
             sum(length(role) + length(text) + marks + 14) AS formatted_chars FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
