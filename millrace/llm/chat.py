"""Chat formatting into a prefix tree.

Conversations that begin with the same turns share the nodes of these turns.
Nodes stand depth first in one stream of tokens, each once; a node has its
place in the stream, the position ids its tokens have in every conversation
through it, and the intervals of the stream that its tokens may attend to
besides their own node. Tokens are code points of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import Scratch, chosen, table

#: The role whose texts are learned.
LEARNED = "assistant"
#: The template: a turn is OPEN, role, CLOSE, text, END. Texts and roles escape
#: the characters that control strings need, so none can occur in them.
OPEN, CLOSE, END = "<turn:", ">", "</turn>\n"
ESCAPED = re.compile(r"[\\<>]")
TURN = re.compile(r"<turn:((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.DOTALL)
#: Conversations that a task has as Python objects at a time.
ROWS = 100


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's formatted text and the span of it under the loss mask."""
    head = OPEN + escape(role) + CLOSE
    body = escape(text)
    learned = len(body) if role == LEARNED else 0
    return head + body + END, len(head), len(head) + learned


def chains(turns: list[dict]) -> list[dict]:
    """The nodes along a conversation: ids that hash all turns so far."""
    at, before, out = 0, b"", []
    for turn in turns:
        role, text = turn["role"] or "", turn["text"] or ""
        made, loss_from, loss_to = format_turn(role, text)
        before = xxhash.xxh3_128_digest(before + len(role).to_bytes(8, "big") + role.encode() + text.encode())
        out.append({"id": before.hex(), "position": at, "content": made, "loss_from": loss_from, "loss_to": loss_to})
        at += len(made)
    return out


NODE = "struct<id:string,position:bigint,content:string,loss_from:bigint,loss_to:bigint>"
NODE_ARROW = pa.list_(pa.struct([("id", pa.string()), ("position", pa.int64()), ("content", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64())]))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS).to_pylist()


def chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in rows_of(batches):
        yield pa.RecordBatch.from_arrays([pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([chains(r["turns"]) for r in rows], NODE_ARROW)], names=["conv_id", "nodes"])


def attended(path: list[dict], owner: int) -> Iterator[tuple[int, list[dict]]]:
    """(start, intervals) of the nodes of a path that its conversation emits.
    Neighbouring intervals of ancestors are one."""
    spans: list[list[int]] = []
    for node in path:
        if node["owner"] == owner:
            yield node["start"], [{"start": a, "end": b} for a, b in spans]
        if spans and spans[-1][1] == node["start"]:
            spans[-1][1] = node["end"]
        else:
            spans.append([node["start"], node["end"]])


def attend_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for rows in rows_of(batches):
        got = [x for r in rows for x in attended(r["path"], r["rank"])]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in got], pa.int64()), pa.array([b for _, b in got], kind)], names=["at", "attends"])


def pack(conversations: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """The packed tree: nodes (start, end, tree, position, content, loss_from,
    loss_to, attends) and conversations (conv_id, rank: their order in the stream, path: their
    nodes' starts).

    start and end are places in the stream, tree is the place where the node's
    tree starts, position the first token's position id; the loss mask covers
    loss_from to loss_to of content. A conversation's turns stand by turn, then
    role, then text; nulls first. A null role or text is empty; a row without
    conv_id is a conversation of one turn. Repeated rows are repeated turns, very long
    texts are whole, and other columns don't matter. An empty table gives two empty ones.

    One task has the turns of one conversation at once, never those of a tree:
    trees are cut across tasks where their rows fall.
    """
    scratch = scratch or Scratch(conversations.sparkSession)
    rows = chosen(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    grouped = grouped.unionByName(rows.where("conv_id is null").select("conv_id", F.array("turn").alias("turns")))
    convs = scratch.keep(grouped.mapInArrow(chain_rows, f"conv_id long, nodes array<{NODE}>").withColumn("key", F.monotonically_increasing_id()))
    # Depth first: conversations by their paths, and each node where it first occurs.
    ordered = convs.select("conv_id", "key", F.col("nodes.id").alias("ids")).sort("ids", "conv_id", "key")
    ranked = scratch.keep(ordered.select("conv_id", "key", "ids", F.monotonically_increasing_id().alias("rank")))
    steps = ranked.select("rank", F.posexplode("ids").alias("depth", "id"))
    owners = steps.groupBy("id").agg(F.min("rank").alias("owner"), F.first("depth").alias("depth"))
    emitted = convs.join(ranked.select("key", "rank"), "key").select("rank", F.explode("nodes").alias("n")).select("rank", "n.*")
    emitted = emitted.join(owners, (emitted["id"] == owners["id"]) & (emitted["rank"] == owners["owner"]), "inner").drop(owners["id"]).drop("rank")
    stream = emitted.sort("owner", "depth").withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    stream = scratch.keep(stream.withColumn("n_tokens", F.char_length("content").cast("long")))
    totals = stream.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select(F.col("part").alias("p"), (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) + F.col("before")
    placed = stream.join(before, stream["part"] == before["p"]).withColumn("end", within).withColumn("start", F.col("end") - F.col("n_tokens"))
    placed = scratch.keep(placed.select("id", "owner", "start", "end", "position", "content", "loss_from", "loss_to"))
    on_path = steps.join(placed.select("id", "owner", "start", "end"), "id")
    paths = scratch.keep(on_path.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "start", "end", "owner"))).alias("path")))
    attends = paths.mapInArrow(attend_rows, "at long, attends array<struct<start:bigint,end:bigint>>")
    nodes = placed.join(attends, placed["start"] == attends["at"]).select("start", "end", F.when(F.size("attends") > 0, F.element_at("attends", 1)["start"]).otherwise(F.col("start")).alias("tree"), "position", "content", "loss_from", "loss_to", "attends")
    return nodes, paths.join(ranked.select("rank", "conv_id"), "rank").select("conv_id", "rank", F.col("path.start").alias("path"))


def read_turns(content: str, masks: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns that a formatted conversation holds, and its learned texts."""
    return [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(content)], [unescape(content[a:b]) for a, b in masks]


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "positions_sha256", "attended_tokens"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for rows in rows_of(batches):
        out = []
        for r in rows:
            content = "".join(n["content"] for n in r["nodes"])
            turns, learned = read_turns(content, [(n["position"] + n["loss_from"], n["position"] + n["loss_to"]) for n in r["nodes"]])
            every, loss = hashlib.sha256(), "".join(learned)
            for role, text in turns:
                every.update(f"{role}\n{text}\n".encode())
            positions = ",".join(str(n["position"]) for n in r["nodes"])
            attended = sum(i["end"] - i["start"] for n in r["nodes"] for i in n["attends"])
            out.append((r["conv_id"], len(turns), every.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(content), hashlib.sha256(positions.encode()).hexdigest(), attended))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=names)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, positions_sha256 string, attended_tokens long"


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(conv_id, nodes along its path: position, content, loss_from, loss_to, attends)."""
    steps = paths.select("conv_id", "rank", F.explode("path").alias("start"))
    node = ("position", "content", "loss_from", "loss_to", "attends")
    found = steps.join(nodes.select("start", *node), "start").groupBy("rank", "conv_id")
    return found.agg(F.sort_array(F.collect_list(F.struct(*node))).alias("nodes")).select("conv_id", "nodes")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), said.alias("text"))
    nodes, paths = pack(rows.unionByName(extra))
    return read_back(nodes, paths).mapInArrow(digest_rows, DIGEST)


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), escaped AS (
  SELECT *, length('<turn:' || regexp_replace(role, '[\\<>]', '\\\0', 'g') || '>' || regexp_replace(text, '[\\<>]', '\\\0', 'g') || '</turn>') + 1 AS chars FROM turns
), placed AS (
  SELECT *, CAST(sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - chars AS BIGINT) AS position FROM escaped
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  sha256(string_agg(CAST(position AS VARCHAR), ',' ORDER BY position)) AS positions_sha256,
  CAST(sum(position) AS BIGINT) AS attended_tokens
FROM placed GROUP BY conv_id
"""
