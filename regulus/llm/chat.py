"""Chat records of many layouts, as turns of one template.

A record is JSON. The paths of its fields, without list positions, are its
schema fingerprint; a table of declarative mappings, keyed by the fields that a
mapping needs, says which fields are turns, and the mapping chosen for a
fingerprint is looked up once for all records that share it. Turns are rows
from then on, however long a conversation is: each is rendered, masked and read
back by itself, and digests over a conversation are carried from turn to turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regulus.llm.common import few

#: Turns that a layout may leave out; the field of earlier turns, pairs of a user's and an assistant's.
OPTIONAL, HISTORY = frozenset(["input", "system"]), "history"
#: Fields that never hold what was said.
ASIDE = frozenset("type id source lang language model timestamp".split())
SIGNS = re.compile(r"[\\.\[\]=]")
START, STOP = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Mapping:
    """``needs``: the paths a layout must have. ``turns``: (role, path) in order, the role with @ a path itself; below ``each``, if given, for every element of that list."""

    name: str
    needs: frozenset[str]
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    roles: tuple[tuple[str, str], ...] = ()


def mapping(name: str, needs: str, turns: Sequence[tuple[str, str]], each: str = "", **roles: str) -> Mapping:
    return Mapping(name, frozenset(needs.split()), tuple(turns), each, tuple(roles.items()))


#: The first mapping whose needs a layout meets is its own; those that need more come first.
MAPPINGS = (
    mapping("messages", "messages[].role messages[].content", [("@role", "content")], each="messages"),
    mapping("conversation", "conversations[].from conversations[].value", [("@from", "value")], each="conversations", human="user", gpt="assistant"),
    mapping("dialog", "dialog[].speaker dialog[].text", [("@speaker", "text")], each="dialog", bot="assistant", human="user"),
    mapping("instruction_input", "instruction input output", [("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")]),
    mapping("instruction_response", "instruction response", [("system", "system"), ("user", "instruction"), ("assistant", "response")]),
    mapping("instruction", "instruction output", [("system", "system"), ("user", "instruction"), ("assistant", "output")]),
    mapping("system_prompt", "system prompt response", [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    mapping("prompt_response", "prompt response", [("user", "prompt"), ("assistant", "response")]),
    mapping("prompt_completion", "prompt completion", [("system", "system"), ("user", "prompt"), ("assistant", "completion")]),
    mapping("question", "question answer", [("system", "system"), ("user", "question"), ("assistant", "answer")]),
    mapping("nested_question", "data.question data.answer", [("user", "data.question"), ("assistant", "data.answer")]),
    mapping("turn", "role text", [("@role", "text")]),
    mapping("turn_content", "role content", [("@role", "content")]),
    mapping("turn_without_text", "role", [("@role", "text")]),
    mapping("turn_without_role", "text", [("@role", "text")]),
)


def paths(record) -> set[str]:
    """The paths of all fields, whether they hold a text, null or more fields; ``[]`` stands for the elements of a list, ``=[]`` for an empty one.

    Dots and brackets in a field's own name are escaped, so no name looks like a path.
    """
    found: set[str] = set()
    open_ = [(record, "")]
    while open_:
        value, at = open_.pop()
        if at:
            found.add(at)
        if isinstance(value, dict):
            open_ += [(v, f"{at}.{SIGNS.sub(r'\\\g<0>', k)}" if at else SIGNS.sub(r"\\\g<0>", k)) for k, v in value.items()]
        elif isinstance(value, list):
            open_ += [(v, at + "[]") for v in value]
            if not value:
                found.add(at + "=[]")
    return found


def texts(record) -> Counter[str]:
    """The texts that a record holds, but for fields that never hold what was said."""
    found: Counter[str] = Counter()
    open_ = [record]
    while open_:
        value = open_.pop()
        if isinstance(value, dict):
            open_ += [v for k, v in value.items() if k not in ASIDE]
        elif isinstance(value, list):
            open_ += value
        elif isinstance(value, str) and value:
            found[value] += 1
    return found


def fingerprint(fields: frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(fields)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def get(value, path: str):
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def valid(text: str) -> str:
    """The text with the replacement sign for each half of a pair that stands alone."""
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def text_of(value) -> str:
    """A text; the texts of a list of parts one after the other; anything else as JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return valid(value)
    if isinstance(value, list):
        parts = [x.get("text") if isinstance(x, dict) else x for x in value]
        if all(isinstance(x, str) for x in parts):
            return valid("".join(parts))
    return valid(json.dumps(value, ensure_ascii=False))


def element(part, how: Mapping, mappings: Sequence[Mapping]) -> Mapping:
    """The mapping for an element of a list: its own, unless it has none of that one's texts and all fields of another."""
    if isinstance(part, dict) and not any(path in part for _, path in how.turns):
        named = lambda m: [path for role, path in m.turns] + [role[1:] for role, _ in m.turns]
        return next((m for m in mappings if m.each and all(f in part for f in named(m))), how)
    return how


def turns(record: dict, how: Mapping, mappings: Sequence[Mapping] = ()) -> Iterator[tuple[str, str]]:
    for pair in record.get(HISTORY) or [] if not how.each and isinstance(record.get(HISTORY), list) else []:
        if isinstance(pair, list) and len(pair) == 2:
            yield from zip(("user", "assistant"), map(text_of, pair))
    parts = get(record, how.each) if how.each else [record]
    for part in parts if isinstance(parts, list) else []:
        mine = element(part, how, mappings) if how.each else how
        roles = dict(mine.roles)
        for role, path in mine.turns:
            said = text_of(get(part, path))
            if role.startswith("@"):
                role = text_of(get(part, role[1:]))
            elif not said and path in OPTIONAL:
                continue  # an instruction without input is one turn
            yield roles.get(role, role), said


def read(raw: str | None) -> dict | None:
    """The record, if the text is a JSON object that can be held."""
    try:
        record = json.loads(raw or "null")
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


def left_out(record: dict, made: Sequence[tuple[str, str]], mappings: Sequence[Mapping]) -> int:
    """How many texts of a record are in none of its turns, neither whole nor as a part of one."""
    rest = texts(record)
    if not rest:
        return 0
    names = {k: v for m in mappings for k, v in m.roles}
    for role, said in made:
        for used in (said, role, *(k for k, v in names.items() if v == role)):
            if rest.get(used):
                rest[used] -= 1
    whole = [said for _, said in made]
    return sum(n for t, n in rest.items() if n and not any(valid(t) in said for said in whole))


def canonical(records: DataFrame, payload: str, keep: Sequence[str], mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """``keep``, ``layout``, ``fingerprint``, ``part``, ``role``, ``text`` and ``left_out``: a row for each turn of each JSON record.

    The mapping depends on the fingerprint alone, so the order of records does
    not matter. An element of a list that is laid out as those of another list
    mapping is read by that one. Texts of a record that no turn holds are
    counted in ``left_out`` of its first row.

    A record that is no JSON object, or whose layout no mapping fits, gives one
    row with null layout, part, role and text, so that nothing is lost unseen;
    one that is nested too deeply to be read counts as no object. A record
    without turns, as an empty list of messages, gives one row with its layout.
    A null or missing text or role in a turn counts as empty, a list of parts
    as their texts together; halves of surrogate pairs become the replacement
    sign. Texts of any length are read whole. Other columns are not looked at.
    """
    keep, mappings = list(keep), tuple(mappings)

    def each(batches):
        chosen: dict[str, Mapping | None] = {}
        for b in few(batches):
            at: list[int] = []
            rows: list[tuple] = []
            for i, raw in enumerate(b.column(len(keep))):
                record = read(raw.as_py())
                fields = frozenset(paths(record)) if record is not None else frozenset()
                print_ = fingerprint(fields)
                if print_ not in chosen:
                    if len(chosen) >= 10_000:
                        chosen.clear()
                    chosen[print_] = next((m for m in mappings if m.needs <= fields), None) or next((m for m in mappings if m.each and f"{m.each}=[]" in fields), None)
                how = chosen[print_]
                try:
                    made = list(turns(record, how, mappings)) if how else []
                except RecursionError:
                    made, how = [], None
                rest = left_out(record, made, mappings) if record is not None else 0
                for k, (role, said) in enumerate(made):
                    at.append(i)
                    rows.append((how.name, print_, k, role, said, 0 if k else rest))
                if not made:
                    at.append(i)
                    rows.append((how.name if how else None, print_, None, None, None, rest))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))], *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*keep, "layout", "fingerprint", "part", "role", "text", "left_out"])

    rows = records.select(*[F.col(c) for c in keep], F.col(payload).alias("_payload"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_payload")
    return rows.mapInArrow(each, f"{schema}, layout string, fingerprint string, part int, role string, text string, left_out int")


def escaped(text: Column) -> Column:
    """The text so that no control string stands in it; :func:`plain` undoes it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(turn_rows: DataFrame) -> DataFrame:
    """Adds ``formatted``, the turn in the template, and ``loss_start`` and ``loss_end``, the code points of it that are learned: an assistant's text."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    head, said = F.concat(F.lit(START), role, F.lit("\n")), escaped(F.col("text"))
    learned = F.col("role") == "assistant"
    out = turn_rows.withColumn("formatted", F.concat(head, said, F.lit(STOP + "\n")))
    return out.withColumns({"loss_start": F.when(learned, F.length(head)), "loss_end": F.when(learned, F.length(head) + F.length(said))})


def read_back(formatted: DataFrame) -> DataFrame:
    """``role``, ``text`` and ``learned``, what stands under the loss mask, from the formatted turns alone."""
    f = F.col("formatted")
    pattern = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*)<\|im_end\|>\n$"
    under = F.when(F.col("loss_end").isNotNull(), plain(F.substring(f, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    return formatted.withColumns({"role": plain(F.regexp_extract(f, pattern, 1)), "text": plain(F.regexp_extract(f, pattern, 2)), "learned": under})


def conversations(records: DataFrame, conv_id: str = "conv_id", turn: str = "turn", payload: str = "payload") -> DataFrame:
    """Formats records of conversations and returns for each what its formatted form says.

    Turns are in the order of ``turn`` (null first); of equal ones, in that of
    role and text. Null roles and texts count as empty; rows without a
    conversation id are one conversation; rows that repeat are turns each. A
    record without turns adds none, and neither does one that no mapping fits,
    which is counted in ``n_unread``; a conversation of such records alone has
    no turns. Texts of its records that no turn holds are in ``n_left_out``. Conversations and texts may be of any length: a task holds one
    turn at a time. Other columns are not looked at. An empty table gives an
    empty result.
    """
    named = records.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(payload).alias("payload"))
    turn_rows = canonical(named, "payload", ["conv_id", "turn"])
    back = read_back(rendered(turn_rows).select("conv_id", "turn", "part", F.col("layout").isNull().alias("unread"), "left_out", "formatted", "loss_start", "loss_end"))
    rows = back.select("conv_id", "turn", "part", "role", "text", "learned", F.length("formatted").cast("long").alias("n"), "unread", "left_out")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text", "part")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_unread", "n_left_out"]
    kinds = (rows.schema["conv_id"].dataType.simpleString(), "long", "string", "long", "string", "long", "long", "long")

    def each(batches):
        state = None

        def done() -> list[tuple]:
            return [(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), *state[5:])] if state else []

        def batch(out: list[tuple], kind) -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=names)

        kind = pa.int64()
        for b in batches:
            out: list[tuple] = []
            kind = b.column(0).type
            for conv, role, said, learned, n, unread, rest in zip(*[b.column(k).to_pylist() for k in (0, 3, 4, 5, 6, 7, 8)]):
                if state is None or state[0] != conv:
                    out += done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[7] += rest
                if n is None:
                    state[6] += unread
                    continue
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                state[3] += len(learned or "")
                state[4].update((learned or "").encode())
                state[5] += n
            yield batch(out, kind)
        if state:
            yield batch(done(), kind)

    return ordered.mapInArrow(each, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def of_rows(rows: DataFrame, role: str = "role", text: str = "text", keep: Sequence[str] = ("conv_id", "turn")) -> DataFrame:
    """Rows of a table of turns as records of one turn each, in one of eight layouts drawn by a hash of ``keep``, some with empty fields of others beside them.

    Roles that a layout has other names for are written by these; a role that
    is such a name itself is written in a layout that leaves it as it is.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.col(text)
    foreign = r.isin("human", "gpt", "bot")
    called = lambda user, assistant: F.when(r == "user", user).when(r == "assistant", assistant).otherwise(r)
    json_of = lambda c: F.to_json(c, {"ignoreNullFields": "false"})
    layouts = [
        json_of(F.struct(r.alias("role"), t.alias("text"))),
        json_of(F.struct(F.array(F.struct(r.alias("role"), t.alias("content"))).alias("messages"))),
        json_of(F.struct(F.array(F.struct(called("human", "gpt").alias("from"), t.alias("value"))).alias("conversations"))),
        json_of(F.struct(F.array(F.struct(called("human", "bot").alias("speaker"), t.alias("text"))).alias("dialog"))),
        json_of(F.struct(F.array(F.struct(r.alias("role"), F.array(F.struct(F.lit("text").alias("type"), F.coalesce(t, F.lit("")).alias("text"))).alias("content"))).alias("messages"))),
        json_of(F.struct(F.array().cast("array<string>").alias("messages"), r.alias("role"), t.alias("text"))),
        json_of(F.struct(F.lit(None).cast("string").alias("messages"), t.alias("text"), r.alias("role"))),
        json_of(F.struct(F.lit("").alias("data.question"), F.lit("").alias("data.answer"), r.alias("role"), t.alias("content"))),
    ]
    drawn = F.when(foreign, F.lit(0)).otherwise(F.pmod(F.xxhash64(*keep), F.lit(len(layouts))).cast("int"))
    payload = F.when(drawn == 0, layouts[0])
    for k, layout in enumerate(layouts[1:], 1):
        payload = payload.when(drawn == k, layout)
    return rows.select(*keep, payload.alias("payload"))
