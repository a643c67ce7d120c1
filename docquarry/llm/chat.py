"""Chat formatting: a hidden Markov model recovers the roles of a transcript's lines.

A transcript is cut into lines. The states are roles. A line shows a speaker
marker or none, a size and how it ends; the model's shares are counted from
lines whose role is known. Viterbi runs over all lines of a conversation, and
lines of one role that follow each other become one canonical turn. The table is sorted over ranges, so a
conversation may span many tasks: each task first reduces its part of the
conversations at its two edges to a matrix of best scores from state to state,
the driver chains these (two a task), and each task then decodes its own part
between the states found at its edges. The path is that of one long Viterbi run.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm import shared

ROLES = ("system", "user", "assistant")
#: Words that name a speaker at the start of a line.
MARKERS = {"system": "system", "user": "user|human|customer|q", "assistant": "assistant|ai|bot|agent|a"}
#: Names that transcribed() gives to speakers; one turn in MARK_EVERY has none.
NAMES = {"system": ("System",), "user": ("User", "Human", "Q"), "assistant": ("Assistant", "AI", "A")}
MARK_EVERY = 4
SIZES = (80, 160, 320, 640)
#: Share of conversations, of 16, from which the model is counted.
TRAIN_SIXTEENTHS = 8
_MARK = re.compile(r"^\s*[\[<*#]*(?:" + "|".join(f"(?P<{r}>{w})" for r, w in MARKERS.items()) + r")[\]>*]*\s*[:>]\s*", re.I)


def marker_role(text: Column) -> Column:
    """The role whose marker starts the line, or an empty string."""
    out = F.lit("")
    for role, words in MARKERS.items():
        out = F.when(text.rlike(rf"(?i)^\s*[\[<*#]*(?:{words})[\]>*]*\s*[:>]"), role).otherwise(out)
    return out


def observation(text: Column) -> Column:
    """What a line shows: marker, size class, one line or more (of a text that is not cut), and whether it asks."""
    text = F.coalesce(text, F.lit(""))
    size = sum((F.length(text) > n).cast("int") for n in SIZES)
    return F.concat_ws("|", marker_role(text), size.cast("string"), text.contains("\n").cast("string"), text.rlike(r"\?\s*$").cast("string"))


def cut_lines(text: Column) -> Column:
    """Array of the lines that are not blank; of a blank or null text one empty line."""
    lines = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))


def lines_of(transcripts: DataFrame) -> DataFrame:
    """(conv_id, turn, line, role, text): the lines of (conv_id, text), all as one turn of unknown role."""
    lines = transcripts.select("conv_id", F.posexplode(cut_lines(F.col("text"))).alias("line", "text"))
    return lines.select("conv_id", F.lit(0).cast("long").alias("turn"), "line", F.lit(None).cast("string").alias("role"), "text")


def transcribed(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, line, role, text): the lines of a plain transcript of (conv_id, turn, role, text).

    As people write them down: a hash of conversation and turn leaves about one
    turn in MARK_EVERY without its speaker's name, and takes a name at random
    from those of NAMES otherwise; the name stands on the first line only. The
    lines of a conversation are rows and never one string, as one conversation
    may hold any share of the table. ``role`` is what there is to recover.
    """
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    chance = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(1 << 20))
    names = F.array(F.lit(""))
    for role, words in NAMES.items():
        names = F.when(F.col("role") == role, F.array(*map(F.lit, words))).otherwise(names)
    name = F.when(chance % MARK_EVERY == 0, F.lit("")).otherwise(F.get(names, (chance % F.size(names)).cast("int")))
    lines = own.select("conv_id", "turn", "role", name.alias("name"), F.posexplode(cut_lines(F.col("text"))).alias("line", "text"))
    marked = F.when((F.col("line") == 0) & (F.col("name") != ""), F.concat("name", F.lit(": "), "text")).otherwise(F.col("text"))
    return lines.select("conv_id", "turn", "line", "role", marked.alias("text"))


def with_lines(rows: DataFrame) -> DataFrame:
    """conv_id, turn, line (0 where there is no such column), role and text."""
    line = F.col("line").cast("int") if "line" in rows.columns else F.lit(0)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), line.alias("line"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def in_training(conv: Column) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(16)) < TRAIN_SIXTEENTHS


def count_model(rows: DataFrame) -> dict:
    """Log shares of first roles, of a role after another and of what lines of a role show, with one added everywhere.

    From lines of known role in TRAIN_SIXTEENTHS/16 of the conversations; lines
    of one turn follow each other in one role. The result has at most
    |roles|^2 + |roles| * |what a line may show| numbers.
    """
    known = with_lines(rows).where(F.col("role").isin(*ROLES) & in_training(F.col("conv_id")))
    known = known.select("conv_id", "turn", "line", "role", observation(F.col("text")).alias("seen"))
    turns = known.where("line = 0")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("was")).groupBy("conv_id", "turn").agg(F.max("was").alias("was"))
    moves = turns.join(before, ["conv_id", "turn"], "left").groupBy("was", "role").count().collect()
    shown = known.groupBy("role", "seen").agg(F.count("*").alias("count"), F.sum((F.col("line") > 0).cast("int")).alias("inner")).collect()
    move: Counter = Counter({(r["was"] or "", r["role"]): r["count"] for r in moves})
    move.update(Counter({r: sum(x["inner"] for x in shown if x["role"] == r[1]) for r in zip(ROLES, ROLES)}))
    show = {(r["role"], r["seen"]): r["count"] for r in shown}
    seen = sorted({s for _, s in show})
    rows_after = {was: sum(move[was, r] + 1 for r in ROLES) for was in ("", *ROLES)}
    totals = {r: sum(show.get((r, s), 0) + 1 for s in seen) + 1 for r in ROLES}
    return {
        "first": [math.log((move["", r] + 1) / rows_after[""]) for r in ROLES],
        "move": [[math.log((move[was, r] + 1) / rows_after[was]) for r in ROLES] for was in ROLES],
        "show": {s: [math.log((show.get((r, s), 0) + 1) / totals[r]) for r in ROLES] for s in seen},
        "unseen": [math.log(1 / totals[r]) for r in ROLES],
    }


def emission(model: dict, seen: str) -> list[float]:
    """Log shares of what a line shows, by role; a marker that was never seen in training counts as strong evidence."""
    if seen in model["show"]:
        return model["show"][seen]
    mark = seen.split("|", 1)[0]
    return [math.log(0.98) if r == mark else math.log(0.01) for r in ROLES] if mark else model["unseen"]


def advance(scores: list[float], model: dict, shown: list[float]) -> tuple[list[float], list[int]]:
    """Best scores one line on, and from which state each comes (the first of equal ones)."""
    best, back = [], []
    for r in range(len(ROLES)):
        options = [scores[s] + model["move"][s][r] for s in range(len(ROLES))]
        k = options.index(max(options))
        best.append(options[k] + shown[r])
        back.append(k)
    return best, back


def start(model: dict, shown: list[float]) -> list[float]:
    return [f + s for f, s in zip(model["first"], shown)]


def trace(scores: list[float], backs: list[list[int]], end: int | None) -> list[int]:
    """States from the first line to the last, given the state of the last, if known."""
    state = scores.index(max(scores)) if end is None else end
    path = [state]
    for back in reversed(backs):
        state = back[state]
        path.append(state)
    return path[::-1]


def viterbi(model: dict, seen: list[str], before: int | None = None, end: int | None = None) -> list[int]:
    """The best states of lines, after a state ``before`` them (None: they start the conversation) and ending in ``end`` if given."""
    if before is None:
        scores = start(model, emission(model, seen[0]))
    else:
        scores = [m + s for m, s in zip(model["move"][before], emission(model, seen[0]))]
    backs = []
    for s in seen[1:]:
        scores, back = advance(scores, model, emission(model, s))
        backs.append(back)
    return trace(scores, backs, end)


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[object, list[tuple]]]:
    """Conversations of a sorted task, with their rows."""
    key, rows = object(), []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(columns))):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def _edges(model: dict):
    arrow = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("conv_id", pa.int64()), ("whole", pa.bool_()), ("fresh", pa.list_(pa.float64())), ("matrix", pa.list_(pa.list_(pa.float64())))])

    def reduce_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the first and the last conversation of a task: best scores at its end, from a fresh start and from each state before."""
        part, held = TaskContext.get().partitionId(), []
        key, at, fresh, matrix = None, -1, None, None
        for batch in batches:
            for conv, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shown = emission(model, seen)
                if at < 0 or conv != key:
                    if at >= 0:
                        held = [*held[:1], (part, at, key, False, fresh, matrix)]
                    key, at = conv, at + 1
                    fresh, matrix = start(model, shown), [[m + s for m, s in zip(model["move"][was], shown)] for was in range(len(ROLES))]
                else:
                    fresh, matrix = advance(fresh, model, shown)[0], [advance(row, model, shown)[0] for row in matrix]
        if at >= 0:
            held = [*held[:1], (part, at, key, at == 0, fresh, matrix)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

    return reduce_edges


def chain(edges: list, model: dict) -> dict[tuple[int, int], tuple[int | None, int | None, bool]]:
    """By (task, conversation of the task): the state before it, at its end, and whether it ends there, for conversations that go on over tasks."""
    runs: list[list] = []
    for e in sorted(edges, key=lambda r: (r["part"], r["at"])):
        last = runs[-1][-1] if runs else None
        if last is not None and last["part"] < e["part"] and e["at"] == 0 and last["conv_id"] == e["conv_id"]:
            runs[-1].append(e)
        else:
            runs.append([e])
    out = {}
    for run in (r for r in runs if len(r) > 1):
        scores, backs = list(run[0]["fresh"]), []
        for e in run[1:]:
            options = [[scores[s] + e["matrix"][s][r] for s in range(len(ROLES))] for r in range(len(ROLES))]
            backs.append([o.index(max(o)) for o in options])
            scores = [max(o) for o in options]
        path = trace(scores, backs, None)
        for k, e in enumerate(run):
            out[e["part"], e["at"]] = (path[k - 1] if k else None, path[k], k == len(run) - 1)
    return out


def recover_roles(rows: DataFrame, model: dict | None = None) -> DataFrame:
    """conv_id, turn, line, role, found_role, held_out, starts_turn and rendered for each line of (conv_id, turn, line, role, text).

    ``rendered`` is the line's piece of the canonical transcript: a tag opens
    where the role found is another than on the line before, and closes the turn
    before; joined in order the pieces are the whole transcript. Lines go by
    turn, line, then by a hash of role and text. Without a column ``line`` each
    row is one line. Null turns come first; rows with a null conv_id make one
    conversation; null text counts as empty; repeated rows are lines of their
    own. ``role`` is only for training, outside held_out conversations, and for
    comparison. Other columns are ignored. Whole texts count, however long, and
    long conversations span tasks; an empty table gives no rows.
    """
    model = model or count_model(rows)
    own = with_lines(rows).withColumns({"seen": observation(F.col("text")), "tie": F.xxhash64("role", "text")})
    order = ["conv_id", "turn", "line", "tie"]
    ranged = shared.cut_lineage(own.repartitionByRange(*order).sortWithinPartitions(*order))
    edges = ranged.select("conv_id", "seen").mapInArrow(_edges(model), "part int, at int, conv_id long, whole boolean, fresh array<double>, matrix array<array<double>>").collect()  # two rows a task
    between = chain(edges, model)
    fields = [("conv_id", "long", pa.int64()), ("turn", "long", pa.int64()), ("line", "int", pa.int32()), ("role", "string", pa.string()), ("found_role", "string", pa.string()), ("starts_turn", "boolean", pa.bool_()), ("rendered", "string", pa.string())]
    arrow = pa.schema([(n, t) for n, _, t in fields])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        for at, (conv, lines) in enumerate(_runs(batches, 6)):
            was, end, ends = between.get((part, at), (None, None, True))
            states = viterbi(model, [r[5] for r in lines], was, end)
            for k, ((_, turn, line, role, text, _), state) in enumerate(zip(lines, states)):
                piece = rendered(text, ROLES[state], None if was is None else ROLES[was], ends and k == len(lines) - 1)
                out.append((conv, turn, line, role, ROLES[state], state != was, piece))
                was = state
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    found = ranged.select("conv_id", "turn", "line", "role", "text", "seen").mapInArrow(decode, ", ".join(f"{n} {t}" for n, t, _ in fields))
    return found.select("conv_id", "turn", "line", "role", "found_role", (~in_training(F.col("conv_id"))).alias("held_out"), "starts_turn", "rendered")


def rendered(text: str, role: str, was: str | None, last: bool) -> str:
    """A line's piece of the canonical transcript: without its speaker marker, tags in it taken apart."""
    opened = f"<|{role}|>\n" if was is None else f"<|end|>\n<|{role}|>\n" if role != was else "\n"
    return opened + _MARK.sub("", text, count=1).strip().replace("<|", "< |") + ("<|end|>" if last else "")
