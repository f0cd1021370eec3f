"""Chat formatting in budgeted windows.

Conversations become texts of marked turns, each within a token budget. Prefix
sums of turn tokens choose the spans: a conversation's turns fall into
stretches of equal token length, and a turn that crosses into a stretch joins
it if both fit, or stands alone. Every window opens with the system turn and a
limited history of the turns before it; only turns that are new to the window
and the assistant's are under the loss mask, so each target counts once.

Control strings inside texts and roles are escaped reversibly: a backslash is
doubled, and the first character of a control string becomes a backslash and
a letter. No text can then open, close or fake a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from patronage.session import materialize

BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1024, 256, 2
#: Tokens are counted as words and single other characters, and so many for the marks of a turn.
TOKEN, MARK_TOKENS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]", 4

OPEN, CLOSE, END = "<|", "|>", "<|end|>"
#: First characters of control strings, of this template and of common others, where what follows makes them one.
CONTROL = {
    "l": r"<(?=\||/?s>|<|/SYS>|/?(?:bos|eos|pad|unk)>)",
    "b": r"\[(?=/?INST\])",
    "p": r"\|(?=>)",
}
PLAIN = {"l": "<", "b": "[", "p": "|", "\\": "\\"}

_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(CLOSE) + "(.*?)" + re.escape(END), re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    """What stands in the output for a text or role."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for letter, pattern in CONTROL.items():
        out = F.regexp_replace(out, pattern, r"\\" + letter)
    return out


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: PLAIN[m[1]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of the turns of a formatted window."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _placed(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Escaped turns with their number and the tokens before them in the conversation.

    Rows are dealt by ranges of conversation and turn, written, and numbered
    and summed range by range, so no conversation has to fit in one task.
    """
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), escape(c(role)).alias("role"), escape(c(text)).alias("text"),
        (F.regexp_count(c(text), F.lit(TOKEN)) + MARK_TOKENS).cast("long").alias("tokens"),
    )
    order = ["conv", "turn", "role", "tie"]
    ranged = rows.withColumn("tie", F.md5(F.col("text").cast("binary"))).repartitionByRange(*order).sortWithinPartitions(*order)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place, inside = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            tokens = batch.column(4).to_numpy()
            ends = inside + np.cumsum(tokens)
            added = [np.full(len(tokens), here), place + np.arange(len(tokens)), ends - tokens]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in added)], names=names)
            place, inside = place + len(tokens), int(ends[-1]) if len(ends) else inside

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    names = [*rows.columns, "range", "place", "inside"]
    numbers = ", ".join([*columns, "range long", "place long", "inside long"])
    rows = materialize(ranged.drop("tie").mapInArrow(numbered, numbers), "turns")
    sizes = rows.groupBy("range").agg(F.count("*").alias("n"), F.sum("tokens").alias("s"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    sizes = sizes.select("range", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}0") for x in ("n", "s")])
    rows = rows.join(sizes, "range").withColumns({"place": F.col("n0") + F.col("place"), "sum": F.col("s0") + F.col("inside")})
    first = rows.groupBy(F.col("conv").alias("c")).agg(
        F.min("place").alias("p0"), F.min("sum").alias("q0"), F.min_by(F.struct("role", "tokens"), "place").alias("f")
    )
    system = F.col("f.role") == "system"
    rows = rows.join(first, F.col("conv").eqNullSafe(F.col("c")))
    return materialize(rows.select(
        "conv", "role", "text", "tokens", (F.col("place") - F.col("p0")).alias("idx"), (F.col("sum") - F.col("q0")).alias("at"),
        system.alias("has_system"), F.when(system, F.col("f.tokens")).otherwise(0).alias("system_tokens"),
    ), "turns")


def windows(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS,
) -> DataFrame:
    """One row per window: ``conv``, ``first_turn``, ``n_context``, ``n_turns``, ``tokens``, ``formatted``, ``loss``.

    ``first_turn`` is the number, from 0, of the first new turn;
    ``n_context`` repeated turns (system turn, history) stand before the
    ``n_turns`` new ones. ``loss`` lists the [start, end) code points of the
    new assistant texts in ``formatted``. A window is within ``budget``
    unless the system turn or one turn alone exceeds it; no turn is cut or
    dropped. Null roles and texts count as empty, null conversation numbers
    as one conversation, rows of one turn number all stand, ordered by role
    and text. Other columns are ignored; an empty table gives no window.
    """
    rows = _placed(turns, conv, turn, role, text)
    own_system = F.col("has_system") & (F.col("idx") == 0)
    room = F.greatest(F.lit(budget - history_tokens) - F.col("system_tokens"), F.lit(max(1, budget // 4)))
    start = F.when(own_system, 0).otherwise(F.col("at") - F.col("system_tokens"))
    last = F.when(own_system, 0).otherwise(F.col("at") - F.col("system_tokens") + F.col("tokens") - 1)
    new = rows.withColumns({"stretch": F.floor(last / room), "crosses": F.floor(start / room) < F.floor(last / room), "room": room})
    # A stretch has at most as many turns as tokens.
    held = F.sum(F.when(own_system, 0).otherwise(F.col("tokens"))).over(Window.partitionBy("conv", "stretch"))
    new = new.withColumn("part", F.when(F.col("crosses") & (held > F.col("room")), 0).otherwise(1))

    firsts = new.groupBy("conv", "stretch", "part").agg(F.min("idx").alias("first"), F.first("has_system").alias("has_system"))
    low = F.greatest(F.col("first") - history_turns, F.col("has_system").cast("long"))
    back = F.when(F.col("first") > low, F.sequence(low, F.col("first") - 1)).otherwise(F.array().cast("array<long>"))
    system = F.when(F.col("has_system") & (F.col("first") > 0), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    asked = firsts.select(F.col("conv").alias("c"), "stretch", "part", F.explode(F.concat(system, back)).alias("i"))
    context = rows.join(asked, F.col("conv").eqNullSafe(F.col("c")) & (F.col("idx") == F.col("i")))
    turn_of = F.struct("idx", "role", "text", "tokens")
    both = new.select("conv", "stretch", "part", "has_system", turn_of.alias("t"), F.lit(True).alias("new")).union(
        context.select("conv", "stretch", "part", "has_system", turn_of.alias("t"), F.lit(False).alias("new"))
    )
    w = both.groupBy("conv", "stretch", "part").agg(
        F.sort_array(F.collect_list(F.when(F.col("new"), F.col("t")))).alias("own"),
        F.sort_array(F.collect_list(F.when(~F.col("new"), F.col("t")))).alias("context"), F.first("has_system").alias("has_system"),
    )
    is_system = lambda t: F.col("has_system") & (t["idx"] == 0)
    # From the latest back, history stays while it fits.
    tail = lambda t: F.aggregate(
        F.filter(F.col("context"), lambda x: ~is_system(x) & (x["idx"] >= t["idx"])), F.lit(0).cast("long"), lambda s, x: s + x["tokens"]
    )
    w = w.withColumn("context", F.filter("context", lambda t: is_system(t) | (tail(t) <= history_tokens)))
    w = w.withColumn("turns", F.concat("context", "own")).withColumn("n_context", F.size("context"))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(CLOSE))
    w = w.withColumn("pieces", F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END))))
    w = w.withColumn("starts", F.aggregate(
        F.transform("pieces", lambda p: F.length(p).cast("long")), F.array(F.lit(0).cast("long")),
        lambda s, n: F.array_append(s, F.element_at(s, -1) + n),
    ))
    spans = F.transform("turns", lambda t, i: F.when(
        (i >= F.col("n_context")) & (t["role"] == "assistant"),
        F.struct((F.get("starts", i) + F.length(head(t))).alias("start"), (F.get("starts", i + 1) - len(END)).alias("end")),
    ))
    return w.select(
        F.col("conv").alias(conv), F.col("own")[0]["idx"].alias("first_turn"), "n_context", F.size("own").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["tokens"]).alias("tokens"),
        F.array_join("pieces", "").alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation, from its windows alone: counts and digests of turns and of the text under the loss mask.

    Digests run over a conversation's windows in order, one window in memory
    at a time.
    """
    kind = formatted.schema[conv].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        current, state = None, None

        def row(state) -> list:
            return [state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5], state[6]]

        for batch in batches:
            done = []
            for i in range(batch.num_rows):
                c, skip, text, loss = (batch.column(k)[i].as_py() for k in range(4))
                if state is None or c != current:
                    if state is not None:
                        done.append(row(state))
                    current, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text)[skip:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
                state[6] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in done], types[k] or batch.schema.field(0).type) for k in range(7)], names=names
            )
        if state is not None:
            last = row(state)
            yield pa.RecordBatch.from_arrays([pa.array([last[k]], types[k] or batch.schema.field(0).type) for k in range(7)], names=names)

    ordered = formatted.select(F.col(conv).alias("conv"), "n_context", "formatted", "loss", "first_turn")
    ordered = ordered.repartition("conv").sortWithinPartitions("conv", "first_turn")
    out = ordered.mapInArrow(
        digest, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
    )
    return out.withColumnRenamed("conv", conv)
