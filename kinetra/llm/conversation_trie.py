"""Prefix trie of conversations by prefix doubling: no task walks a conversation or a trie level by level.

Turns are named densely (0, 1, ...) by content. Two neighbouring blocks of 2**j turns that start at a multiple of 2**(j+1) give a
pair of names, and distinct pairs are named densely again, so after j rounds every aligned block of 2**j turns has a name that
equal blocks share. A prefix of d turns is the concatenation of aligned blocks, one for each bit of d from the highest
down; its name is the dense name of (name of the prefix without the last block, name of that block). Rounds are twice the
binary logarithm of the longest conversation. Rows with the same prefix name are the members of a trie node.

Sums over subtrees need no walk either. A node counts for its smallest member, and the nodes of which c is the smallest
member are the deepest ones on c's path. So the sum over a subtree is the sum of the totals of all its members less what the
subtree's own smallest member holds above its top: one grouping and a running sum in the order (conversation, depth).

Defined results: rows without conv_id belong to no conversation; null role or text is empty; turns are ordered by turn, null first,
ties by role and then text in code-point order, and rows that repeat are turns of their own; a conversation that is rebuilt without
turns is a member of the root only; an empty table gives no nodes; other columns are not read; texts are compared whole, by SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetra.llm.common import numbered, summed_before, text_or_empty, written

WORD_CHARS = r"[^\x20\x09-\x0D]+"
#: Ids that share all but their last 12 bits make one text piece of a node's members (4,096 at most); pieces are joined in order, so no list of all members is built.
PIECE_BITS = 12


def _named(rows: DataFrame, keys: list[str], name: str, first: int) -> tuple[DataFrame, int]:
    """rows with a dense name for each distinct value of keys instead of them, from `first`, and the next free name."""
    distinct, _ = written(rows.select(*keys).distinct().withColumn("_m", F.monotonically_increasing_id()), "turn-names")
    names, after = numbered(rows.sparkSession, distinct, name, first)
    out, _ = written(rows.join(names, keys).drop(*keys), "turn-blocks")
    return out, after


def rebuilt_turns(conversations: DataFrame, spread: int = 20, branches: int = 4) -> tuple[DataFrame, DataFrame]:
    """(c, p, digest, words), the turns of each rebuilt conversation from place 0, and (c, size), a row for each conversation.

    Conversation c opens with the first h turns of c - c % spread, h = CRC-32 of c in decimal modulo branches, and goes on with its own after its first h.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    src = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), text.alias("text"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    dealt = src.repartitionByRange(*order).sortWithinPartitions(*order)
    parts, _ = written(dealt.select("c", digest.alias("digest"), F.size(F.regexp_extract_all("text", F.lit(WORD_CHARS), F.lit(0))).cast("long").alias("words"), F.monotonically_increasing_id().alias("_m")), "turns")
    turns, _ = numbered(conversations.sparkSession, parts, "g")
    convs, _ = written(turns.groupBy("c").agg(F.min("g").alias("start"), F.count(F.lit(1)).alias("n")), "conversations")
    opens = convs.withColumn("b", F.col("c") - F.col("c") % spread).withColumn("h", F.crc32(F.col("c").cast("string")) % branches)
    bases = convs.select(F.col("c").alias("b"), F.col("n").alias("base_n"))
    plan, _ = written(opens.join(bases, "b", "left").withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0)))).withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversation-plans")
    placed = turns.join(plan.select("c", "start", "h", "k"), "c").withColumn("p", F.col("g") - F.col("start"))
    heads = placed.where((F.col("c") % spread == 0) & (F.col("p") < branches)).select(F.col("c").alias("b"), "p", "digest", "words")
    opened = plan.where("k > 0").select("c", "b", "k").join(heads, "b").where("p < k").select("c", "p", "digest", "words")
    own = placed.where("p >= h").select("c", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "digest", "words")
    return written(opened.unionByName(own), "rebuilt-turns")[0], plan.select("c", "size")


def prefix_nodes(turns: DataFrame) -> DataFrame:
    """(c, d, node): the dense number, from 1, of each prefix of d > 0 turns of (c, p, digest); equal prefixes share it."""
    longest = turns.agg(F.max("p")).first()[0]
    if longest is None:
        return turns.select("c", F.col("p").alias("d"), F.col("p").alias("node"))
    levels = []
    blocks, _ = _named(turns.select("c", F.col("p").alias("q"), "digest"), ["digest"], "name", 0)
    for _ in range((longest + 1).bit_length()):
        levels.append(blocks)
        halves = blocks.groupBy("c", F.shiftright("q", 1).alias("half")).agg(F.max(F.when(F.col("q") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("q") % 2 == 1, F.col("name"))).alias("b"))
        if len(levels) < (longest + 1).bit_length():
            blocks, _ = _named(halves.where("b IS NOT NULL").withColumnRenamed("half", "q"), ["a", "b"], "name", 0)
    found, free = None, 1
    for j in reversed(range(len(levels))):
        ends = levels[j].where("q % 2 = 0").select("c", F.shiftleft("q", j).alias("e"), F.shiftleft(F.col("q") + 1, j).alias("d"), "name")
        if found is None:
            before = ends.withColumn("left", F.lit(0).cast("long"))
        else:
            before = ends.join(found.select("c", F.col("d").alias("e"), F.col("node").alias("left")), ["c", "e"], "left").withColumn("left", F.coalesce("left", F.lit(0)))
        named, free = _named(before.select("c", "d", "left", "name"), ["left", "name"], "node", free)
        found = named if found is None else found.unionByName(named)
    return found


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, c). Pieces of ids come in order and are hashed as they come, whatever their number."""
    pieces = ends.groupBy("node", F.shiftright("c", PIECE_BITS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n == node:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], ["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(run, "node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, spread: int = 20, branches: int = 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, root included."""
    spark = conversations.sparkSession
    turns, convs = rebuilt_turns(conversations, spread, branches)
    paths, _ = written(prefix_nodes(turns).unionByName(convs.select("c", F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("node"))), "trie-paths")
    grouped = paths.groupBy("node").agg(F.min("c").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("d").alias("depth"))
    last = turns.select(F.col("c").alias("rep"), (F.col("p") + 1).alias("depth"), "words")
    up = paths.select(F.col("c").alias("rep"), (F.col("d") + 1).alias("depth"), F.col("node").alias("parent"))
    order = [F.col("rep"), F.col("depth")]
    valued = grouped.join(last, ["rep", "depth"], "left").join(up, ["rep", "depth"], "left").withColumn("v", (F.col("n") - 1) * F.coalesce("words", F.lit(0)))
    parts, _ = written(valued.select("node", "rep", "depth", "n", "parent", "v").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "trie-nodes")
    nodes = summed_before(spark, parts, "v", "before")
    children = parts.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    held, _ = written(nodes.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-children")
    per_conv = held.groupBy(F.col("rep").alias("c")).agg(F.sum("v").alias("total"), F.min("before").alias("start"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    totals, _ = written(convs.join(per_conv, "c", "left").na.fill(0, ["total", "leaf"]), "trie-totals")
    members = paths.join(totals, "c")
    sums = members.groupBy("node").agg(F.sum("total").alias("subtree"), F.sum("leaf").alias("n_leaves"))
    ends = _end_digests(members.where("d = size").select("node", "c"))
    reps = held.select(F.col("node").alias("parent"), F.col("rep").alias("parent_conv_id"))
    out = held.join(sums, "node").join(totals.select(F.col("c").alias("rep"), "start"), "rep").join(reps, "parent", "left").join(ends, "node", "left")
    return out.select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        "n_leaves",
        (F.col("subtree") - (F.col("before") - F.col("start"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
