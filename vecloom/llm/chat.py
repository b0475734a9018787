"""Chat formatting over a prefix tree: shared turns are written once.

Conversations that begin with the same turns share the nodes of a tree; a node
is a turn after its ancestors.  Each tree block is one text: its nodes depth
first, every shared turn once.  A node carries where it lies in the block
(``begin``, ``end``), the position id of its first character (what its
ancestors hold before it, so a conversation's positions run on as if it stood
alone), and the attention intervals of its ancestors in the block.  Reading the
intervals of a leaf and then the leaf gives its conversation back.

Template: ``<s>`` opens a conversation (at the root's first node), every turn
is ``[role]`` + role + ``[/role]`` + text + ``</s>``.  Inside roles and texts
the characters that control strings begin with, and the escape itself, are
written as a backslash and a letter (``<`` as ``\\l``, ``[`` as ``\\b``, the
backslash as ``\\e``), so no text can hold a control string and the way back is
exact.  The loss mask covers the texts of assistant turns, without
control strings; ``loss`` lists its intervals per node.

Blocks: conversations of one first turn lie together.  Where more than
``block_conversations`` share it, the block is split by a hash of the whole
conversation, and each part writes the shared turns once more, so no task holds
an unbounded first turn; equal conversations stay in one part up to that bound,
beyond it they are split by id.

Defined results: null text is an empty text, null role the empty role; turns
are ordered by turn number (null first), then role, then text, and repeated
rows are turns of their own.  A conversation is a non-null conv_id; rows with a
null conv_id form one conversation of their own, which like any other is held
whole by the task that formats it.  A very long turn is written whole.  An empty
table gives no rows.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, parallelism, read, whole_groups

OPEN, ROLE, TEXT, CLOSE = "<s>", "[role]", "[/role]", "</s>"
LETTERS = {"\\": "e", "<": "l", "[": "b"}
ESCAPED, UNESCAPED = re.compile(r"[\\<\[]"), re.compile(r"\\([elb])")
BACK = {v: k for k, v in LETTERS.items()}
BLOCK = 512


def escape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\\" + LETTERS[m.group()], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(lambda m: BACK[m.group(1)], text)


def turn_text(role: str, text: str, first: bool) -> tuple[str, tuple[int, int]]:
    """A turn in the template, and where in it the text lies."""
    head = (OPEN if first else "") + ROLE + escape(role) + TEXT
    body = escape(text)
    return head + body + CLOSE, (len(head), len(head) + len(body))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; the inverse of the template."""
    if not formatted.startswith(OPEN):
        raise ValueError("a conversation begins with " + OPEN)
    out, at = [], len(OPEN)
    while at < len(formatted):
        middle, end = formatted.index(TEXT, at), formatted.index(CLOSE, at)
        if not formatted.startswith(ROLE, at):
            raise ValueError("a turn begins with " + ROLE)
        out.append((unescape(formatted[at + len(ROLE) : middle]), unescape(formatted[middle + len(TEXT) : end])))
        at = end + len(CLOSE)
    return out


class Node:
    __slots__ = ("begin", "children", "conversations", "depth", "end", "intervals", "loss", "number", "position", "role", "text")

    def __init__(self, role: str, text: str, depth: int):
        self.role, self.text, self.depth = role, text, depth
        self.children: dict[tuple[str, str], Node] = {}
        self.conversations: list = []


def grow(conversations: Iterable[tuple[object, list[tuple[str, str]]]]) -> dict[tuple[str, str], Node]:
    roots: dict[tuple[str, str], Node] = {}
    for conv, turns in conversations:
        level, node = roots, None
        for depth, (role, text) in enumerate(turns):
            node = level.get((role, text))
            if node is None:
                node = level[role, text] = Node(role, text, depth)
            level = node.children
        if node is not None:
            node.conversations.append(conv)
    return roots


def emit(roots: dict[tuple[str, str], Node]) -> tuple[str, list[Node]]:
    """The block's text, and its nodes depth first with places, positions and ancestor intervals."""
    parts, nodes, at = [], [], 0
    stack = [(node, None) for node in reversed(roots.values())]
    while stack:
        node, parent = stack.pop()
        text, (start, stop) = turn_text(node.role, node.text, node.depth == 0)
        node.number, node.begin, node.end = len(nodes), at, at + len(text)
        node.position = parent.position + parent.end - parent.begin if parent else 0
        # A first child follows its parent at once: their intervals are one.
        inherited = parent.intervals if parent else []
        own = (parent.begin, parent.end) if parent else None
        if own and inherited and inherited[-1][1] == own[0]:
            node.intervals = [*inherited[:-1], (inherited[-1][0], own[1])]
        else:
            node.intervals = [*inherited, own] if own else []
        node.loss = [(at + start, at + stop)] if node.role == "assistant" and stop > start else []
        parts.append(text)
        nodes.append(node)
        at = node.end
        stack += [(child, node) for child in reversed(node.children.values())]
    return "".join(parts), nodes


CONVERSATIONS = "conv_id long, turns array<struct<role:string,text:string>>"
BLOCKS = "block string, text string, node long, leaf boolean, conv_id long, position long, begin long, end long, ancestors array<struct<begin:long,end:long>>, loss array<struct<begin:long,end:long>>"


def gather(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) in order, from (conv_id, turn, role, text); a conversation is bounded by its own turns."""
    turns = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turns)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def blocks(conversations: DataFrame, scratch: Scratch, size: int = BLOCK) -> DataFrame:
    """(block, conv_id, turns): which tree block each conversation goes to."""
    hashed = conversations.withColumn("first", F.sha2(F.to_json(F.col("turns")[0]), 256)).withColumn("whole", F.xxhash64("turns"))
    hashed = scratch.put(hashed, "hashed")
    # Most blocks hold many first turns; a first turn of its own size is split.
    counts = hashed.groupBy("first").agg(F.count("*").alias("n"))
    hot = scratch.put(counts.where(F.col("n") > size).select("first", F.ceil(F.col("n") / size).alias("ways")), "hot")
    n_hot, total = hot.count(), hashed.count()
    groups = max(1, -(-total // size))
    split = hashed.join(F.broadcast(hot) if n_hot <= 100_000 else hot.hint("merge"), "first", "left") if n_hot else hashed.withColumn("ways", F.lit(None).cast("long"))
    same = scratch.put(split.where("ways is not null").groupBy("first", "whole").agg(F.count("*").alias("n")).where(F.col("n") > size), "same")
    n_same = same.count()
    by_whole, by_id = F.pmod("whole", "ways"), F.pmod(F.xxhash64("conv_id"), "ways")
    if n_same:
        many = same.select("first", "whole", F.lit(True).alias("many"))
        split = split.join(F.broadcast(many) if n_same <= 100_000 else many.hint("merge"), ["first", "whole"], "left")
        by_whole = F.when(F.col("many"), by_id).otherwise(by_whole)
    cold = F.concat(F.lit("g"), F.pmod(F.xxhash64("first"), F.lit(groups)).cast("string"))
    block = F.when(F.col("ways").isNull(), cold).otherwise(F.concat(F.col("first"), F.lit("/"), by_whole.cast("string")))
    return split.select(block.alias("block"), "conv_id", "turns")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[Node]]]:
    for table, bounds in whole_groups(batches, "block"):
        ids, turns, names = table.column("conv_id").to_pylist(), table.column("turns").to_pylist(), table.column("block").to_pylist()
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            text, nodes = emit(grow((ids[i], [(t["role"], t["text"]) for t in turns[i]]) for i in range(a, b)))
            yield names[a], text, nodes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each node, and one for each further conversation that ends at it; the text with the first."""
    interval = lambda pairs: [{"begin": b, "end": e} for b, e in pairs]
    for block, text, nodes in _trees(batches):
        rows = []
        for node in nodes:
            for k, conv in enumerate(node.conversations or [None]):
                rows.append({
                    "block": block, "text": text if not node.number and not k else None, "node": node.number, "leaf": bool(node.conversations), "conv_id": conv, "position": node.position,
                    "begin": node.begin, "end": node.end, "ancestors": interval(node.intervals), "loss": interval(node.loss),
                })
        yield pa.RecordBatch.from_pylist(rows, schema=ROWS)


_INTERVALS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
ROWS = pa.schema([("block", pa.string()), ("text", pa.string()), ("node", pa.int64()), ("leaf", pa.bool_()), *((c, pa.int64()) for c in ("conv_id", "position", "begin", "end")), ("ancestors", _INTERVALS), ("loss", _INTERVALS)])


def _laid(conversations: DataFrame, size: int) -> DataFrame:
    spark = conversations.sparkSession
    bound_batches(spark, "4m")
    scratch = Scratch(spark, "chat")
    dealt = blocks(gather(conversations), scratch, size)
    return dealt.repartition(parallelism(spark), "block").sortWithinPartitions("block", "conv_id")


def format_trees(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """The tree blocks of ``conversations`` (conv_id, turn, role, text), one row a node; see BLOCKS."""
    return _laid(conversations, size).mapInArrow(_rows, BLOCKS)


def read_back(text: str, ancestors: list[tuple[int, int]], begin: int, end: int) -> str:
    return "".join(text[b:e] for b, e in [*ancestors, (begin, end)])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _rows(batches):
        frame: list[dict] = rows.to_pylist()
        text = frame[0]["text"]
        losses = {r["begin"]: (r["loss"][0]["begin"], r["loss"][0]["end"]) for r in frame if r["loss"]}
        starts = {r["begin"] for r in frame}
        ends = {r["begin"]: r["end"] for r in frame}
        out = {"conv_id": [], "n_turns": [], "turns_sha256": [], "loss_chars": [], "loss_sha256": [], "formatted_chars": []}
        for r in frame:
            if not r["leaf"]:
                continue
            spans = [(a["begin"], a["end"]) for a in r["ancestors"]] + [(r["begin"], r["end"])]
            formatted = read_back(text, spans[:-1], *spans[-1])
            turns = parse(formatted)
            # The mask: the loss intervals of the nodes that the conversation attends to.
            loss, at = [], None
            for b, e in spans:
                at = b
                while at < e:
                    if at in losses:
                        loss.append(unescape(text[slice(*losses[at])]))
                    at = ends[at] if at in starts else e
            masked = "".join(loss)
            for k, v in zip(out, (r["conv_id"], len(turns), _sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(masked), _sha(masked), len(formatted)), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=DIGEST)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
DIGEST_COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """What each conversation reads as, back from its tree block."""
    return _laid(conversations, size).mapInArrow(_digest, DIGEST_COLUMNS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return digests(own.unionByName(probe))


#: The template's lengths: 3 for the opening, 17 a turn, and one more for each escaped character.
ORACLE = r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(17 + length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g')) + length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM own GROUP BY conv_id
"""
