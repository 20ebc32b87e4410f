"""The trie of conversations that begin alike, by partition refinement.

All conversations begin as one class, named by its smallest member. A round splits the classes that still have several
members by their next turns, a block of turns at a time (blocks double, so rounds follow the logarithm of the shared
depth until a block has MOST_BLOCK turns): within a block a class is told by the class before the block and a digest of
the turns since, and named by its smallest member. A class of one is retired where it comes to be, and its tail comes
out of the table of turns as a chain of single nodes, with no further rounds. What a subtree sums to is folded back
over the shared nodes only, in strides that double: a node adds what the nodes 2^k below it had gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.queues import numbered
from .common import stage, unstage

FIRST_BLOCK, MOST_BLOCK = 4, 128
#: Ids of ended members are joined in pieces of at most 2**PIECE before they are digested.
PIECE = 10
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, symbol, words) with i from 0 within a conversation, ordered by turn, null first, then by symbol.

    symbol is the digest of role and text, null ones empty; words counts `[^\\x20\\x09-\\x0D]+` in the text. Places are
    counted over ranges of all turns, so a conversation of any length is spread over as many tasks as it fills. Turns of
    null conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    symbol = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", symbol.alias("symbol"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")
    )
    turns = numbered(turns, "conv_id", "turn", "symbol", "row")  # the row only tells repeats apart, which are alike
    first = turns.groupBy("conv_id").agg(F.min("_n").alias("first"))
    return stage(turns.join(first, "conv_id").select("conv_id", (F.col("_n") - F.col("first")).cast("int").alias("i"), "symbol", "words"))


def with_shared_openings(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Each conversation c with the first h turns of conversation c - c % group before its own turns from the h-th on.

    h = crc32(decimal c) % most. Returns (conv_id, d, symbol, words), d from 1, and (conv_id, length); turnless ones have
    length 0. An absent conversation lends nothing, a short one all it has.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("own"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    convs = convs.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("lender"))
    has = convs.where("conv_id = lender").select("lender", F.col("own").alias("lends"))
    lent = F.least("h", F.coalesce("lends", F.lit(0)))
    convs = stage(convs.join(has, "lender", "left").select("conv_id", "lender", "h", lent.alias("lent"), (lent + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")))
    opening = turns.where((F.col("conv_id") % group == 0) & (F.col("i") < most - 1)).withColumnRenamed("conv_id", "lender")
    taken = convs.select("conv_id", "lender", "h").join(opening, "lender").where("i < h").select("conv_id", (F.col("i") + 1).alias("d"), "symbol", "words")
    rest = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("i >= h").select("conv_id", (F.col("lent") + F.col("i") - F.col("h") + 1).alias("d"), "symbol", "words")
    rebuilt = stage(taken.unionByName(rest))
    lengths = stage(convs.select("conv_id", "length"))
    unstage(convs)
    return rebuilt, lengths


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined by commas, as they stream past in order."""
    now, sha = None, None
    for batch in batches:
        told = []
        for cls, depth, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if now == (cls, depth):
                sha.update(b"," + piece.encode())
                continue
            if now is not None:
                told.append((*now, sha.hexdigest()))
            now, sha = (cls, depth), hashlib.sha256(piece.encode())
        if told:
            yield _rows(told)
    if now is not None:
        yield _rows([(*now, sha.hexdigest())])


def _rows(told: list) -> pa.RecordBatch:
    cls, depth, sha = zip(*told)
    return pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(depth, pa.int32()), pa.array(sha, pa.string())], names=["cls", "depth", "ends"])


def _refined(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared nodes (cls, depth, n, words, parent), where members end in them (cls, depth, conv_id), and the retired (conv_id, length, depth, parent)."""
    top, n = lengths.agg(F.min("conv_id"), F.count("*")).first()
    root = [(top, 0, n, 0, None)] if n else []
    nodes, retired = [lengths.sparkSession.createDataFrame(root, "cls long, depth int, n long, words long, parent long")], []
    active = stage(lengths.withColumn("cls", F.lit(top).cast("long")))
    ends = [stage(active.where("length = 0").select("cls", F.lit(0).alias("depth"), "conv_id"))]
    done, block = 0, FIRST_BLOCK
    while active.limit(1).count():
        row = F.struct("d", "symbol", "words")
        # at most `block` turns of one conversation
        lists = turns.where(F.col("d").between(done + 1, done + block)).join(active, "conv_id").groupBy("conv_id", "cls", "length").agg(F.array_sort(F.collect_list(row)).alias("turns"))
        since = lambda i: F.md5(F.array_join(F.transform(F.slice("turns", 1, i), lambda t: t["symbol"]), ""))
        told = F.transform("turns", lambda t, i: F.struct(t["d"].alias("depth"), since(i + 1).alias("key"), F.when(i > 0, since(i)).alias("before"), t["words"].alias("words")))
        rows = stage(lists.select("conv_id", "cls", "length", F.explode(told).alias("t")).select("conv_id", "cls", "length", "t.*"))
        # `of` is the class before the block; a class is counted within tasks before the shuffle
        split = rows.groupBy(F.col("cls").alias("of"), "depth", "key", "before").agg(F.count("*").alias("n"), F.min("conv_id").alias("cls"), F.min("length").alias("length"), F.min("words").alias("words"))
        split = stage(split)
        above = split.select("of", (F.col("depth") + 1).alias("depth"), F.col("key").alias("before"), F.col("cls").alias("up"), F.col("n").alias("up_n"))
        tree = split.join(above, ["of", "depth", "before"], "left").withColumn("parent", F.coalesce("up", "of"))
        nodes.append(stage(tree.where("n > 1").select("cls", "depth", "n", "words", "parent")))
        retired.append(stage(tree.where("n = 1 and coalesce(up_n, 2) > 1").select(F.col("cls").alias("conv_id"), "length", "depth", "parent")))
        last = (F.col("depth") == F.col("length")) | (F.col("depth") == done + block)
        shared = split.where("n > 1").select(F.col("of").alias("cls"), "depth", "key", F.col("cls").alias("to"))
        stays = stage(rows.where(last).join(shared, ["cls", "depth", "key"]).select("conv_id", "length", "depth", F.col("to").alias("cls")))
        ends.append(stays.where("depth = length").select("cls", "depth", "conv_id"))
        unstage(rows, split, active)
        active = stays.where(f"depth = {done + block} and length > depth").select("conv_id", "length", "cls")
        done, block = done + block, min(2 * block, MOST_BLOCK)

    def union(parts, schema=None):
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    if not retired:
        retired = [lengths.where("false").select("conv_id", "length", F.col("length").alias("depth"), F.col("conv_id").alias("parent"))]
    return union(nodes), union(ends), union(retired)


def _folded(nodes: DataFrame) -> DataFrame:
    """nodes(cls, depth, parent, leaves, saved) with leaves and saved summed over subtrees."""
    now, stride = stage(nodes.withColumnRenamed("parent", "up")), 1
    while now.where("up is not null").limit(1).count():
        gathered = now.where("up is not null").groupBy(F.col("up").alias("cls"), (F.col("depth") - stride).alias("depth")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = now.select(F.col("cls").alias("up"), (F.col("depth") + stride).alias("depth"), F.col("up").alias("far"))
        new = now.join(gathered, ["cls", "depth"], "left").join(further, ["up", "depth"], "left")
        new = stage(new.select("cls", "depth", (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"), F.col("far").alias("up")))
        unstage(now)
        now, stride = new, 2 * stride
    return now.drop("up")


def trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of turns(conv_id, d, symbol, words), d gapless from 1, and lengths(conv_id, length).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is named by its
    smallest member; saved_tokens sums (members - 1) * words of the last turn over its subtree; ends_sha256 digests the
    ids of members that end in it. The root has depth 0 and no parent, and is there if there is any conversation. The
    ids of members that end in one node are digested in one stream, in joined pieces, as SHA-256 asks.
    """
    nodes, ends, retired = _refined(turns, lengths)
    below = nodes.where("parent is not null").select(F.col("parent").alias("cls"), (F.col("depth") - 1).alias("depth"), F.lit(0).alias("single"))
    below = below.unionByName(retired.select(F.col("parent").alias("cls"), (F.col("depth") - 1).alias("depth"), F.lit(1).alias("single")))
    below = below.groupBy("cls", "depth").agg(F.count("*").alias("children"), F.sum("single").alias("singles"))
    nodes = nodes.join(below, ["cls", "depth"], "left").withColumns({"children": F.coalesce("children", F.lit(0)), "singles": F.coalesce("singles", F.lit(0))})
    nodes = stage(nodes.withColumn("leaves", F.when(F.col("children") == 0, 1).otherwise(F.col("singles")).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("words")))
    sums = _folded(nodes.select("cls", "depth", "parent", "leaves", "saved"))
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("cls", "depth", F.shiftright("conv_id", PIECE).alias("at")).agg(piece.alias("piece"))  # at most 2**PIECE ids
    digests = pieces.repartition("cls", "depth").sortWithinPartitions("cls", "depth", "at").select("cls", "depth", "piece").mapInArrow(_digests, "cls long, depth int, ends string")
    sums = sums.join(digests, ["cls", "depth"], "left")
    shared = nodes.drop("leaves", "saved").join(sums, ["cls", "depth"]).select(
        F.col("cls").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"),
    )
    tails = turns.select("conv_id", "d").join(retired, "conv_id").where("d >= depth")
    last = F.col("d") == F.col("length")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    single = tails.select(
        "conv_id", F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("depth"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
    out = stage(shared.unionByName(single))
    unstage(nodes)
    return out


def conversation_trie(conversations: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """The prefix trie of conversations(conv_id, turn, role, text) once each has its shared opening (with_shared_openings).

    Null roles and texts are empty, null turns come first, equal turns are ordered by the digest of role and text, and
    repeated rows are turns of their own. Rows without a conv_id belong to no conversation; without any other row the
    result is empty. Other columns are ignored.
    """
    turns = turns_in_order(conversations)
    rebuilt, lengths = with_shared_openings(turns, group, most)
    out = trie(rebuilt, lengths)
    unstage(turns, rebuilt, lengths)
    return out
