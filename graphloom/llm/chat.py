"""Chat transcripts: roles by a hidden Markov model, decoded by Viterbi, then turns in one canonical form.

A transcript comes as numbered parts of raw lines. Each line is seen through its speaker marker and a few line
features (question, length, code, list, politeness); the states are the roles. A marker names a role almost for certain, a
line without one mostly goes on with the role before it. Transitions, marker errors and features are estimated from a bounded
sample of conversations whose roles are known. The best path is found in parallel: each part becomes a
matrix (best log-probability from each role before it to each role after it), parts compose to segments in max-plus
algebra, and the segments of a conversation that has several compose in the same way, level by level; the roles at the
seams then let every segment, and every part in it, be decoded on its own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, small_side, written

ROLES = ("system", "user", "assistant")
SEGMENT = 256  # parts in a segment, or segments in one of the next level
TEXT = 1 << 20  # characters in a segment of several parts
TOGETHER = 65_536  # parts of a conversation that one task sorts
# Speaker names by role, and the forms that a marker takes at the start of a line.
NAMES = {"system": "system|instruction|instructions|context", "user": "user|human|customer|question|q|me|prompter", "assistant": "assistant|ai|bot|gpt|model|agent|answer|a|response"}
_NAME = "|".join(f"(?P<{r}>{n})" for r, n in NAMES.items())
_MARKER = re.compile(rf"\s*(?:<\|(?:im_start\|>)?|\[|###\s*|\*\*|<)?(?:{_NAME})(?:\|>|\]|\*\*:?|>)?\s*(?P<sign>[:>\])-]|$)(?:\*\*)?\s*", re.I)
_END = ("<|im_end|>", "<|end|>", "</s>")
# What a line is looked at for.
FEATURES = [re.compile(r"\?\s*$"), re.compile(r"^(?:    |\t|```)|[{};]\s*$"), re.compile(r"^\s*(?:[-*•]|\d+[.)])\s"), re.compile(r"\b(?:please|can you|could you|how do|i need|help me|thanks)\b", re.I), re.compile(r"\b(?:you are|you must|always|never|respond in|follow)\b", re.I)]
SAMPLE = 20_000  # turns that a model is estimated from, at most: those of the conversations with the smallest hash
SAMPLE_TEXT = 10_000  # characters of a turn in that sample, at most; longer ones take no part in it


@dataclass(frozen=True)
class Model:
    """Log-probabilities by role: start; stay, turn and next, of a role after another within a part, with a marker and into a
    new part without one; named, of the role that a marker names; yes and no, of each feature of a line."""

    start: np.ndarray
    stay: np.ndarray
    turn: np.ndarray
    next: np.ndarray
    named: np.ndarray
    yes: np.ndarray
    no: np.ndarray


def _prior() -> Model:
    """What holds before any conversation is seen."""
    stay, turn = np.log([[0.90, 0.08, 0.02], [0.01, 0.93, 0.06], [0.01, 0.05, 0.94]]), np.log([[0.04, 0.90, 0.06], [0.02, 0.18, 0.80], [0.02, 0.80, 0.18]])
    named = np.where(np.eye(3), 3 * np.log(0.97), 3 * np.log(0.015))
    likely = np.array([(0.05, 0.40, 0.15), (0.02, 0.06, 0.15), (0.10, 0.05, 0.25), (0.02, 0.20, 0.08), (0.40, 0.05, 0.05)])
    return Model(np.log([0.15, 0.75, 0.10]), stay, turn, np.log(0.15 * np.exp(stay) + 0.85 * np.exp(turn)), named, np.log(likely), np.log(1 - likely))


PRIOR = _prior()
START = PRIOR.start


def marker(line: str) -> tuple[str | None, str]:
    """The role that the line's speaker marker names, if it has one, and the line without it."""
    m = _MARKER.match(line)
    if not m:
        return None, line
    role = next(r for r in ROLES if m[r])
    if len(m[role]) == 1 and m["sign"] not in ":":
        return None, line
    return (role, line[m.end() :]) if m["sign"] or not line[m.end() :].strip() else (None, line)


def without_end(line: str) -> str:
    """The line without the mark of a turn's end, if it has one, and the white space around that."""
    bare = line.rstrip()
    return next((bare[: -len(m)].rstrip() for m in _END if bare.endswith(m)), line)


def emissions(line: str, role: str | None, model: Model = PRIOR) -> np.ndarray:
    out = np.zeros(len(ROLES))
    for pattern, yes, no in zip(FEATURES, model.yes, model.no, strict=True):
        out += yes if pattern.search(line) else no
    if role:
        out += model.named[:, ROLES.index(role)]
    return out


def _steps(text: str, model: Model):
    """(role named or None, line, transition, emission) of each line that isn't blank."""
    new = True
    for line in (text or "").split("\n"):
        role, rest = marker(line)
        rest = without_end(rest)
        if role or rest.strip():
            yield role, rest, model.turn if role else model.next if new else model.stay, emissions(rest, role, model)
            new = False


def part_matrix(text: str, model: Model = PRIOR) -> np.ndarray:
    """Best log-probability from each role before the part to each role at its end; the identity for a blank part."""
    best = np.full((len(ROLES),) * 2, -np.inf)
    np.fill_diagonal(best, 0.0)
    for _, _, move, seen in _steps(text, model):
        best = (best[:, :, None] + move[None]).max(1) + seen
    return best


def decode_part(text: str, before: int, after: int, model: Model = PRIOR) -> list[tuple[int, str]]:
    """(role, line) along the best path from one role to another; before is -1 at the start of a conversation."""
    steps = list(_steps(text, model))
    score, back = np.full(len(ROLES), -np.inf), []
    if before < 0:
        score = model.start.copy()
    else:
        score[before] = 0.0
    for _, _, move, seen in steps:
        both = score[:, None] + move
        back.append(both.argmax(0))
        score = both.max(0) + seen
    path, role = [], after
    for b in reversed(back):
        path.append(role)
        role = int(b[role])
    return [(r, s[1]) for r, s in zip(reversed(path), steps, strict=True)]


def _seams(matrices: np.ndarray, enter: np.ndarray, last: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(scores before each matrix, role after each): the best path over matrices from the scores enter to the role last (None: the best one)."""
    scores, back = [enter], []
    for m in matrices:
        both = scores[-1][:, None] + m
        back.append(both.argmax(0))
        scores.append(both.max(0))
    role = int(scores[-1].argmax()) if last is None else last
    after = np.zeros(len(back), np.int64)
    for k in range(len(back) - 1, -1, -1):
        after[k] = role
        role = int(back[k][role])
    return np.array(scores[:-1]), after


def _compose(matrices: list[np.ndarray]) -> np.ndarray:
    best = matrices[0]
    for m in matrices[1:]:
        best = (best[:, :, None] + m[None]).max(1)
    return best


_ITEM = pa.struct([("part", pa.int64()), ("order", pa.int64()), ("row", pa.int64()), ("text", pa.string()), ("m", pa.list_(pa.float64()))])
_SEGMENTS = pa.schema([("seg", pa.int64()), ("conv_id", pa.int64()), ("m", pa.list_(pa.float64())), ("items", pa.list_(_ITEM))])


def _segments(items: DataFrame, together: int, model: Model) -> DataFrame:
    """(seg, conv_id, m, items): runs of a conversation's items (conv_id, part, order, row, text, m) with the matrix of each run.

    Conversations of at most together items are sorted in one task each; with a longer one among them the items are
    dealt by ranges of the whole order, so that it spreads over tasks. In both cases seg grows along a conversation.
    """
    most = items.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    keys = ["conv_id", "part", "order", "row"]
    ordered = (items.repartition("conv_id") if most <= together else items.repartitionByRange(*keys)).sortWithinPartitions(*keys)

    def cut(batches):
        seg, conv, held, size = TaskContext.get().partitionId() << 33, None, [], 0

        def full():
            return {"seg": seg, "conv_id": conv, "m": _compose([np.reshape(x["m"], (len(ROLES),) * 2) for x in held]).ravel(), "items": held}

        for batch in pieces(batches, "text"):
            out = []
            for item in batch.to_pylist():
                own, length = item.pop("conv_id"), len(item["text"] or "")
                if held and (own != conv or len(held) == SEGMENT or size + length > TEXT):
                    out.append(full())
                    seg, held, size = seg + 1, [], 0
                if item["m"] is None:
                    item["m"] = part_matrix(item["text"], model).ravel()
                conv, size = own, size + length
                held.append(item)
            yield pa.RecordBatch.from_pylist(out, _SEGMENTS)
        yield pa.RecordBatch.from_pylist([full()] if held else [], _SEGMENTS)

    return ordered.mapInArrow(cut, "seg long, conv_id long, m array<double>, items array<struct<part:long,order:long,row:long,text:string,m:array<double>>>")


def _between(segments: DataFrame, together: int, model: Model) -> DataFrame | None:
    """(seg, before, after) of the segments of conversations that have several; None if there is no such conversation."""
    several = written(segments.groupBy(F.col("conv_id").alias("c")).count().where("count > 1").select("c"))
    if several.isEmpty():
        return None
    none = F.lit(None).cast("long")
    chosen = segments.join(small_side(several, several.count()), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    items = written(chosen.select("conv_id", none.alias("part"), none.alias("order"), F.col("seg").alias("row"), F.lit(None).cast("string").alias("text"), "m"))

    def state(_, held, before, after):
        return [{"seg": x["row"], "before": b, "after": a} for x, b, a in zip(held, before, after, strict=True)]

    return written(_along(items, state, pa.schema([("seg", pa.int64()), ("before", pa.int64()), ("after", pa.int64())]), "seg long, before long, after long", together, model))


def _along(items: DataFrame, use, fields: pa.Schema, schema: str, together: int, model: Model) -> DataFrame:
    """The rows that use(conv_id, items, roles before, roles after) gives for each segment, along the best path of its conversation."""
    segments = written(_segments(items, together, model))
    seams = _between(segments, together, model)
    if seams is None:
        placed = segments.withColumn("before", F.lit(-1)).withColumn("after", F.lit(None).cast("long"))
    else:
        placed = segments.join(small_side(seams, seams.count()), "seg", "left").withColumn("before", F.coalesce("before", F.lit(-1)))

    def walk(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                enter = model.start
                if row["before"] >= 0:
                    enter = np.full(len(ROLES), -np.inf)
                    enter[row["before"]] = 0.0
                _, after = _seams(np.array([x["m"] for x in row["items"]]).reshape(-1, len(ROLES), len(ROLES)), enter, row["after"])
                after = after.tolist()
                yield pa.RecordBatch.from_pylist(use(row["conv_id"], row["items"], [row["before"], *after[:-1]], after), fields)

    return placed.select("conv_id", "items", "before", "after").mapInArrow(walk, schema)


def _decoded(parts: DataFrame, first: str, second: str, shape, together: int, model: Model) -> DataFrame:
    """(conv_id, part, order, first, second, continues): for each part the two lists that shape makes of its (role, line) pairs; whether it goes on with the role before it."""
    none = F.lit(None)
    items = parts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("part").cast("long").alias("part"), F.xxhash64("text").alias("order"), none.cast("long").alias("row"), "text", none.cast("array<double>").alias("m"))
    lists = pa.list_(pa.string())

    def decode(conv, held, before, after):
        out = []
        for x, b, a in zip(held, before, after, strict=True):
            path = decode_part(x["text"], b, a, model)
            roles, told = shape(path)
            out.append({"conv_id": conv, "part": x["part"], "order": x["order"], first: roles, second: told, "continues": bool(path) and path[0][0] == b})
        return out

    fields = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("order", pa.int64()), (first, lists), (second, lists), ("continues", pa.bool_())])
    return _along(items, decode, fields, f"conv_id long, part long, order long, {first} array<string>, {second} array<string>, continues boolean", together, model)


def parsed(parts: DataFrame, together: int = TOGETHER, model: Model = PRIOR) -> DataFrame:
    """(conv_id, part, order, roles, lines) with the decoded role of each line that isn't blank; from parts (conv_id, part, text).

    Parts are taken in order of part (null first) and text. A null text counts as empty; rows without a conv_id are one
    conversation; repeated rows are returned each. Other columns are ignored.
    """
    return _decoded(parts, "roles", "lines", lambda path: ([ROLES[r] for r, _ in path], [x for _, x in path]), together, model).drop("continues")


def turns(path: list[tuple[int, str]]) -> tuple[list[str], list[str]]:
    """Roles and contents of the turns: neighbouring lines of one role, joined and trimmed."""
    found = [(ROLES[role], "\n".join(line for _, line in lines).strip(" \n\t\r")) for role, lines in groupby(path, lambda x: x[0])]
    return [r for r, _ in found], [c for _, c in found]


def rendered(parts: DataFrame, together: int = TOGETHER, model: Model = PRIOR) -> DataFrame:
    """Canonical turns, one row each: conv_id, part, order, turn (in the part), role, content, continues, text.

    Neighbouring lines of one role in a part are one turn; content is the lines joined, trimmed; text is
    <|role|>, a line feed, the content and <|end|>. A part whose first turn goes on with the role before it keeps a turn
    of its own, which continues tells; a part without lines has none.
    """
    found = _decoded(parts, "roles", "contents", turns, together, model)
    out = found.select("conv_id", "part", "order", "continues", F.posexplode(F.arrays_zip("roles", "contents")).alias("turn", "t")).select("conv_id", "part", "order", "turn", F.col("t.roles").alias("role"), F.col("t.contents").alias("content"), (F.col("continues") & (F.col("turn") == 0)).alias("continues"))
    return out.withColumn("text", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "content", F.lit("<|end|>")))


def raw_transcripts(conversations: DataFrame) -> DataFrame:
    """Parts (conv_id, part, role, text) as raw transcripts have them: each turn of conversations with a marker in its conversation's style.

    Six styles by hash of conv_id; one turn in eight, not the first, has no marker.
    """
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    role = F.coalesce(F.col("role"), F.lit("user"))
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")
    upper = F.initcap(role)
    mark = F.when(style == 0, F.concat(upper, F.lit(": "))).when(style == 1, F.concat(F.lit("### "), upper, F.lit(":\n"))).when(style == 2, F.concat(F.lit("["), role, F.lit("] "))).when(style == 3, F.concat(human, F.lit(": "))).when(style == 4, F.concat(F.lit("**"), human, F.lit(":** "))).otherwise(F.concat(F.lit("<|im_start|>"), role, F.lit("\n")))
    bare = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(8)) == 0) & (F.col("turn") > 0)
    return conversations.select("conv_id", F.col("turn").alias("part"), F.col("role").alias("role"), F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce("text", F.lit(""))).alias("text"))


def fitted(parts: DataFrame, sample: int = SAMPLE) -> Model:
    """A model estimated from labelled parts (conv_id, part, text, role): counts of a bounded sample, on top of the prior as a few lines' worth of it.

    Transitions and marker errors are counted between parts in order, features over their lines. Rows without one of the columns or
    with another role take no part. Without any, the prior comes back.
    """
    usable = parts.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull() & F.col("part").isNotNull() & (F.length("text") <= SAMPLE_TEXT))
    by_hash = [F.xxhash64("conv_id"), F.col("conv_id"), F.col("part")]
    rows = usable.select("conv_id", "part", "role", "text").orderBy(*by_hash, "text").limit(sample).collect()
    rows.sort(key=lambda r: (r["conv_id"], r["part"], r["text"]))
    worth = 10.0
    start, stay, turn, following, named = (worth * np.exp(x) for x in (PRIOR.start, PRIOR.stay, PRIOR.turn, PRIOR.next, PRIOR.named))
    yes, no = worth * np.exp(PRIOR.yes), worth * np.exp(PRIOR.no)
    last, own = None, None
    for r in rows:
        k = ROLES.index(r["role"])
        lines = [line for line in r["text"].split("\n") if line.strip()]
        told, _ = marker(lines[0]) if lines else (None, "")
        if own != r["conv_id"]:
            start[k] += 1
        else:
            (turn if told else following)[last, k] += 1
        if told:
            named[k, ROLES.index(told)] += 1
        stay[k, k] += max(0, len(lines) - 1)
        for line in lines:
            rest = without_end(marker(line)[1])
            if rest.strip():
                hit = np.array([bool(f.search(rest)) for f in FEATURES])
                yes[hit, k] += 1
                no[~hit, k] += 1
        last, own = k, r["conv_id"]
    share = lambda x: np.log(x / x.sum(-1, keepdims=True))
    return Model(share(start), share(stay), share(turn), share(following), share(named), np.log(yes / (yes + no)), np.log(no / (yes + no)))
