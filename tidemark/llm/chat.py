"""Chat formatting: records of any known layout, told apart by a fingerprint of their field paths, become turns of one template."""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.shipping import ship_package
from tidemark.llm.columns import table

START, END = "<|im_start|>", "<|im_end|>"
#: The role whose text the model learns.
LEARNED = "assistant"

FORMATTED = "conv_id bigint, fingerprint string, formatted string, loss array<struct<start: int, end: int>>"


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; a list adds [] and the paths of all its items."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in {f"{at}.{k}" if at else k} | paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {f"{at}[]"}.union(*[paths(v, f"{at}[]") for v in value])
    return set()


def fingerprint(found: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(found)).encode(), digest_size=8).hexdigest()


#: Layouts as data: either a list of turns with the fields of role and text (and names of roles), or one field a turn.
LAYOUTS = (
    {"turns": "messages", "role": "role", "text": "content"},
    {"turns": "conversations", "role": "from", "text": "value", "roles": {"human": "user", "gpt": "assistant"}},
    {"fields": (("user", "prompt"), ("assistant", "response"))},
    {"fields": (("user", "prompt"), ("assistant", "completion"))},
    {"fields": (("user", "instruction"), ("assistant", "output"))},
    {"fields": (("user", "instruction"), ("user", "input"), ("assistant", "output"))},
    {"fields": (("system", "system"), ("user", "instruction"), ("assistant", "output"))},
)


def _shapes(layout: dict) -> list[set[str]]:
    if "turns" in layout:
        t = layout["turns"]
        return [{t, f"{t}[]", f"{t}[].{layout['role']}", f"{t}[].{layout['text']}"}, {t, f"{t}[]"}]
    return [{f for _, f in layout["fields"]}]


#: Fingerprint -> layout.
MAPPINGS = {fingerprint(s): m for m in LAYOUTS for s in _shapes(m)}


def turns_of(record: dict, layout: dict) -> list[tuple[str, str]]:
    """(role, text) a turn; null texts and roles are empty."""
    if "turns" in layout:
        names = layout.get("roles", {})
        return [(names.get(t.get(layout["role"]) or "", t.get(layout["role"]) or ""), t.get(layout["text"]) or "") for t in record[layout["turns"]]]
    return [(role, record[field] or "") for role, field in layout["fields"]]


_OPEN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    """No <| stays: every run < \\...\\ | gets one more backslash, which unescape takes away."""
    return _OPEN.sub(r"<\1\\|", text) if "<" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text) if "<" in text else text


def escape_role(role: str) -> str:
    """A role ends at the first line end, so its own line ends are written out."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans, in code points, of what is learned."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render was given."""
    out, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, record) with record a JSON object -> (conv_id, fingerprint, formatted, loss).

    The record's fingerprint selects its mapping; a record of no known layout, or no object, keeps its fingerprint and gets null formatted
    and loss. One pass without a shuffle; a record is handled by itself."""

    def run(batches):
        for b in batches:
            rows = []
            for r in b.column("record").to_pylist():
                try:
                    value = json.loads(r) if r is not None else None
                except ValueError:
                    value = None
                mark = fingerprint(paths(value))
                layout = MAPPINGS.get(mark)
                rows.append((mark, *(render(turns_of(value, layout)) if layout else (None, None))))
            loss = pa.array([None if x[2] is None else [{"start": s, "end": e} for s, e in x[2]] for x in rows], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([x[0] for x in rows], pa.string()), pa.array([x[1] for x in rows], pa.string()), loss], names=["conv_id", "fingerprint", "formatted", "loss"])

    ship_package(records.sparkSession)
    return records.select(F.col("conv_id").cast("bigint").alias("conv_id"), "record").mapInArrow(run, FORMATTED)


def records_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, record) of rows (conv_id, turn, role, text), in the layout that a conversation's roles allow: prompt and response, system with
    instruction and output, or messages. Turns that tie are in the order of role and text; a null role or text is empty. One
    conversation is one record, so its rows meet in one task."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    t = F.col("t")
    roles = F.transform(t, lambda x: x.role)

    def text(i: int) -> Column:
        return F.get(t, i).content

    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    triple = F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output")))
    messages = F.to_json(F.struct(F.transform(t, lambda x: F.struct(x.role.alias("role"), x.content.alias("content"))).alias("messages")))
    record = F.when(roles == F.array(F.lit("user"), F.lit("assistant")), pair).when(roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")), triple).otherwise(messages)
    return conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t")).select("conv_id", record.alias("record"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The digest columns of op8, from the formatted text and its loss spans alone."""
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, fingerprint string"

    def run(batches):
        for b in batches:
            rows = []
            for text, loss, mark in zip(*(b.column(c).to_pylist() for c in ("formatted", "loss", "fingerprint")), strict=True):
                turns = parse(text)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                whole = "".join(f"{r}\n{x}\n" for r, x in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text), mark))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[f.split()[0] for f in schema.split(", ")])

    ship_package(formatted.sparkSession)
    return formatted.where(F.col("formatted").isNotNull()).mapInArrow(run, schema)


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    said = f"{END}{START}assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_records(records_of(rows.unionByName(extra))))
