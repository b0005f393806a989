"""The prefix trie of conversations by partition refinement.

A class holds the conversations that agree so far.  All start in one class; an
active class is split by its members' next turn; a class of one sequence retires
and emits its tail as a chain of single nodes; at the end leaves and saved tokens
are folded back from the deepest nodes.  Equal conversations are one sequence with
a count, so copies never meet in one class.

Classes of more than ``held`` turns are split in Spark, ``steps`` turns a round
(the first round one turn, for all): class ids are digests of the parent's id and
the turn, sizes are summed before the shuffle, and only sequences of still large
classes go on.  Every other class goes whole to one task, which refines it to the
end.  Its top node carries the totals of its subtree, and the few large classes
fold them up round by round.

Turns are equal when the MD5 of their role and text are; a conversation's turns
are held by one task at a time.  The ids of equal conversations are hashed by one
task for each such group, in a stream of 40 bytes a member: SHA-256 is sequential.

Defined cases: null roles and texts count as empty; turns that tie are ordered by
role, then text (a null turn first); repeated rows are turns of their own; rows
without a conv_id belong to no conversation and make no node; an empty table has no
conversation and so no root; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import checkpointed, text_rows

#: Turns that a class may have to be refined by one task.
HELD_TURNS = 1 << 15
#: Turns that a round in Spark splits large classes by.
STEPS = 8
ROOT = "root"
EMPTY = hashlib.sha256(b"").hexdigest()
#: A conversation takes the first turns of the one whose id is the next lower multiple of FAMILY, fewer than MOST_SHARED + 1.
FAMILY, MOST_SHARED = 5, 8

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top string"
_FIELDS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("top", pa.string())])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, n, key, bytes): every turn's place in its conversation, its digest and its text's length."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    mine = Window.partitionBy("conv_id")
    placed = rows.withColumn("pos", F.row_number().over(mine.orderBy(F.col("turn").asc_nulls_first(), "role", "text")) - 1).withColumn("n", F.count("*").over(mine))
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return placed.select("conv_id", "pos", "n", key.alias("key"), F.octet_length("text").cast("long").alias("bytes"))


def shared_heads(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, bytes): every conversation with its first h turns taken from the head of its family.

    h is crc32 of the id as text, modulo 9; a shorter or absent head gives what it has.
    """
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).alias("h")
    members = turns.where("pos = 0").select("conv_id", family.alias("family"), h)
    is_head = F.col("conv_id") % FAMILY == 0
    heads = turns.where(is_head & (F.col("pos") < MOST_SHARED)).select(F.col("conv_id").alias("family"), "pos", "key", "bytes")
    lengths = turns.where(is_head & (F.col("pos") == 0)).select(F.col("conv_id").alias("family"), F.col("n").alias("head_n"))
    taken = members.join(heads, "family").where("pos < h").select("conv_id", "pos", "key", "bytes")
    own = turns.select("conv_id", "pos", "key", "bytes", family.alias("family"), h).where("pos >= h").join(lengths, "family", "left")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("head_n", F.lit(0)))).cast("int").alias("pos"), "key", "bytes")
    lists = taken.unionByName(own).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "key", "bytes"))).alias("turns"))
    none = F.array().cast("array<struct<pos:int,key:string,bytes:bigint>>")
    whole = members.select("conv_id").join(lists, "conv_id", "left").withColumn("turns", F.coalesce("turns", none))
    return whole.select("conv_id", F.col("turns.key").alias("keys"), F.col("turns.bytes").alias("bytes"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(smallest id, members, SHA-256 of their ids) of every run of equal sequences in rows sorted by sequence and id."""
    now, first, count, digest = None, 0, 0, None
    for batch in batches:
        done = []
        for same, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if same != now:
                if now is not None:
                    done.append((first, count, digest.hexdigest()))
                now, first, count, digest = same, conv, 0, hashlib.sha256()
            digest.update(b"%s%d" % (b"," if count else b"", conv))
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "w", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([count]), pa.array([digest.hexdigest()])], names=["conv_id", "w", "ends"])


def sequences(whole: DataFrame) -> DataFrame:
    """Every distinct sequence once: (conv_id, keys, bytes, w, ends) with its smallest id, its members and the digest of their ids."""
    whole = checkpointed(whole)
    same = whole.select(F.md5(F.concat_ws("", "keys").cast("binary")).alias("same"), "conv_id")
    groups = same.repartition("same").sortWithinPartitions("same", "conv_id").mapInArrow(_ends, "conv_id long, w long, ends string")
    return whole.join(groups, "conv_id")


def refine(members: list[tuple], depth: int, top: str, out: list[list]) -> None:
    """Appends the nodes of one class to the columns ``out``.

    ``members`` are (conv_id, w, ends, keys, bytes) of distinct sequences from the
    class's own turn on, which lies at ``depth``; ``top`` names the class above.
    """
    conv, level, parent, convs, children, leaves, saved, ends = ([] for _ in range(8))
    active = [(members, 1, -1)]
    for mine, d, up in active:  # grows while it is walked
        if len(mine) == 1:
            c, w, end, keys, sizes = mine[0]
            tail = np.asarray(sizes[d - 1 :], np.int64)[::-1]
            n = len(tail)
            out[0].append(np.full(n, c))
            out[1].append(np.arange(depth + d - 1, depth + d - 1 + n))
            out[2].append([None if up < 0 else conv[up]] + [c] * (n - 1))
            out[3].append(np.full(n, w))
            out[4].append(np.append(np.ones(n - 1, np.int64), 0))
            out[5].append(np.ones(n, np.int64))
            out[6].append(np.cumsum(tail * (w - 1))[::-1])
            out[7].append([EMPTY] * (n - 1) + [end])
            out[8].append([top if up < 0 else None] + [None] * (n - 1))
            if up >= 0:
                leaves[up] += 1
                saved[up] += int(out[6][-1][0])
            continue
        i = len(conv)
        conv.append(min(m[0] for m in mine))
        level.append(depth + d - 1)
        parent.append(up)
        convs.append(sum(m[1] for m in mine))
        leaves.append(0)
        saved.append((convs[i] - 1) * mine[0][4][d - 1])
        ends.append(next((m[2] for m in mine if len(m[3]) == d), EMPTY))
        parts: dict[str, list] = {}
        for m in mine:
            if len(m[3]) > d:
                parts.setdefault(m[3][d], []).append(m)
        children.append(len(parts))
        active.extend((part, d + 1, i) for part in parts.values())
    for i in range(len(conv) - 1, 0, -1):  # fold back: children stand after their parents
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    if conv:
        for column, values in zip(out, (conv, level, [conv[p] if p >= 0 else None for p in parent], convs, children, leaves, saved, ends, [top if p < 0 else None for p in parent])):
            column.append(values)


def _refine_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of all classes of a partition sorted by class."""

    def flush(out: list[list]) -> pa.RecordBatch:
        columns = [pa.concat_arrays([pa.array(part, f.type) for part in column]) if column else pa.array([], f.type) for column, f in zip(out, _FIELDS)]
        return pa.RecordBatch.from_arrays(columns, schema=_FIELDS)

    now, members, out = None, [], [[] for _ in _FIELDS]
    for batch in batches:
        for cls, above, depth, *member in zip(*(c.to_pylist() for c in batch.columns)):
            if now is not None and cls != now[0]:
                refine(members, now[2], now[1], out)
                members = []
            now = (cls, above, depth)
            members.append(tuple(member))
            if len(out[0]) > 4096:
                yield flush(out)
                out = [[] for _ in _FIELDS]
    if members:
        refine(members, now[2], now[1], out)
    yield flush(out)


def _levels(active: DataFrame, steps: int) -> tuple[DataFrame, list[Column]]:
    """``active`` with c0..c<steps>, the classes of the next turns (null after the last one)."""
    for j in range(1, steps + 1):
        turn = F.col("depth") + j - 1
        active = active.withColumn(f"c{j}", F.when(F.size("keys") > turn, F.md5(F.concat(f"c{j - 1}", F.get("keys", turn)).cast("binary"))))
    return active, [F.col(f"c{j}") for j in range(steps + 1)]


def _split(active: DataFrame, steps: int, held: int) -> tuple[DataFrame, DataFrame]:
    """One round: (large classes met, the sequences with ``deep``, how many of the next classes are large)."""
    chained, c = _levels(active, steps)
    each = F.explode(F.array(*[F.struct(c[j].alias("cls"), (F.col("depth") + j).alias("at"), F.get("bytes", F.col("depth") + j - 1).alias("last"), F.array(*c[: j + 1]).alias("up")) for j in range(1, steps + 1)]))
    levels = chained.select("conv_id", "w", "ends", F.size("keys").alias("n"), each.alias("x")).select("conv_id", "w", "ends", "n", "x.*").where("cls is not null")
    sums = levels.groupBy("cls").agg(
        F.min("up").alias("up"), F.min("at").cast("long").alias("depth"), F.min("last").alias("last"), F.count("*").alias("sequences"), F.sum(F.col("n") - F.col("at") + 1).alias("turns"),
        F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.max(F.when(F.col("n") == F.col("at"), F.col("ends"))).alias("ends"),
    )
    large = checkpointed(sums.where((F.col("sequences") > 1) & (F.col("turns") > held)))
    deep = levels.select("conv_id", "cls").join(large.select("cls"), "cls").groupBy("conv_id").agg(F.count("*").cast("int").alias("deep"))
    return large, checkpointed(chained.join(deep, "conv_id", "left").withColumn("deep", F.coalesce("deep", F.lit(0))))


def _of_tasks(placed: DataFrame, steps: int) -> DataFrame:
    """The sequences whose next class one task can refine: (class, class above, depth, member)."""
    c = F.array(*[f"c{j}" for j in range(steps + 1)])
    at = F.col("depth") + F.col("deep")
    small = placed.where((F.col("deep") < steps) & (F.size("keys") > at))
    tail = lambda name: F.slice(name, at + 1, F.size(name) - at)
    return small.select(F.get(c, F.col("deep") + 1).alias("cls"), F.get(c, F.col("deep")).alias("above"), (at + 1).cast("long").alias("depth"), "conv_id", "w", "ends", tail("keys").alias("keys"), tail("bytes").alias("bytes"))


def trie(whole: DataFrame, held: int = HELD_TURNS, steps: int = STEPS) -> DataFrame:
    """The nodes of the trie over (conv_id, keys, bytes); see the module's text."""
    seqs = checkpointed(sequences(whole))
    active = seqs.withColumn("c0", F.lit(ROOT)).withColumn("depth", F.lit(0))
    rounds: list[DataFrame] = []
    parts: list[DataFrame] = []
    width = 1
    while True:
        large, placed = _split(active, width, held)
        parts.append(_of_tasks(placed, width))
        if large.isEmpty():
            break
        rounds.append(large)
        going = placed.where(F.col("deep") == width)
        active = going.select("conv_id", "keys", "bytes", "w", "ends", F.col(f"c{width}").alias("c0"), (F.col("depth") + width).alias("depth"))
        width = steps
    tasks = parts[0]
    for part in parts[1:]:
        tasks = tasks.unionByName(part)
    nodes = checkpointed(text_rows(tasks).repartition("cls").sortWithinPartitions("cls", "conv_id").mapInArrow(_refine_classes, _NODE))

    carried = nodes.where("top is not null").groupBy(F.col("top").alias("cls")).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    upper: list[DataFrame] = []
    for large in reversed(rounds):
        own = large.join(carried, "cls", "left").withColumn("saved", F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("last"))
        above = own.select(F.posexplode("up").alias("step", "cls"), F.coalesce("leaves", F.lit(0)).alias("leaves"), "saved", F.size("up").alias("length"))
        sums = checkpointed(above.groupBy("cls", (F.col("step") == 0).alias("start")).agg(F.sum(F.when(F.col("step") == F.col("length") - 2, 1).otherwise(0)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        inside = sums.where("not start").select("cls", F.col("children").alias("inner_children"), "leaves", "saved")
        done = large.join(carried.select("cls", "children"), "cls", "left").join(inside, "cls")
        upper.append(done.select("cls", F.get("up", F.size("up") - 2).alias("top"), "conv_id", "depth", "n_convs", (F.coalesce("children", F.lit(0)) + F.col("inner_children")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256")))
        carried = carried.unionByName(sums.where("start").drop("start")).groupBy("cls").agg(F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    root = seqs.agg(F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.max(F.when(F.size("keys") == 0, F.col("ends"))).alias("ends")).where("conv_id is not null").withColumn("cls", F.lit(ROOT))
    root = root.join(carried, "cls", "left").select(
        "cls", F.lit(None).cast("string").alias("top"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    for part in upper:
        root = root.unionByName(part)
    classes = checkpointed(root)
    names = classes.select(F.col("cls").alias("top"), F.col("conv_id").alias("top_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    high = classes.join(names, "top", "left").withColumn("parent_conv_id", F.col("top_conv"))
    tops = nodes.where("top is not null").join(names, "top", "left").withColumn("parent_conv_id", F.col("top_conv"))
    return nodes.where("top is null").select(columns).unionByName(tops.select(columns)).unionByName(high.select(columns))


def conversation_trie(conversations: DataFrame, held: int = HELD_TURNS, steps: int = STEPS) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256); a node is named by its depth and its smallest member.
    """
    return trie(shared_heads(checkpointed(numbered_turns(conversations))), held, steps)
