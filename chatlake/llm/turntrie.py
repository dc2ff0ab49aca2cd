"""Trie of conversation prefixes, by collapsing whole sequences.

Every conversation is rebuilt: the first turns of the conversation that opens its block
of ``block`` ids, then its own turns after as many. Rebuilt conversations with the same
turns are one weighted sequence with the list of conversations that end there, so copies
cost one sequence from then on. A sequence that is a proper prefix of another is found by
an anti-join and is no leaf. Each remaining sequence gives one row per prefix, and rows
of equal prefixes are added up to the nodes of the trie.

A turn is a pair of 64-bit hashes of its place, role and text; a prefix is the exclusive
or of its turns and its depth, so it is summed, not chained: fingerprints of long
conversations come from cells of ``CELL`` turns whose totals are added, and no task has
to hold a conversation. Every node is owned by the smallest leaf below it. A leaf owns
the lower end of its own path, so the characters of distinct turns below a node are,
summed over the leaves below it, the characters that each owns from there on: rows stay
in proportion to the turns, not to pairs of nodes.

Results by case: NULL roles and texts are empty ones; NULL turns come first, equal turns
are ordered by role and text; rows without conv_id take no part; a conversation whose
rebuilt form has no turn ends at the root; repeated rows are turns of their own; an
empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from chatlake.llm.common import settled

BLOCK = 100
HEADS = 6
# Turns whose totals are carried as one.
CELL_BITS = 12
# Ids of an end list that are joined before they meet the rest of it.
PART_BITS = 13
_NODE = ["depth", "u", "v"]


def shared_head(conv_id: Column) -> Column:
    """How many turns a conversation takes over: the checksum of its decimal id, 0 to HEADS - 1."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def _cell(column: str) -> Column:
    return F.coalesce(F.shiftright(F.col(column).cast("bigint"), CELL_BITS), F.lit(-1 << 62))


def _carried(df: DataFrame, keys: list[str], order: list[Column], cell: Column, added: dict[str, Column],
             mixed: dict[str, Column] | None = None) -> DataFrame:
    """Add running sums (``added``) and running exclusive ors (``mixed``), the row's own value included.

    ``cell`` never decreases along ``order``. Cells are summed apart and the totals
    of earlier ones added, so the unit of work is a cell.
    """
    values = {n: (F.sum, c) for n, c in added.items()} | {n: (F.bit_xor, c) for n, c in (mixed or {}).items()}
    marked = df.withColumn("_cell", cell)
    places = [*keys, "_cell"]
    totals = marked.groupBy(*places).agg(*[fold(c).alias(n) for n, (fold, c) in values.items()])
    earlier = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*places, *[
        F.coalesce(fold(n).over(earlier), F.lit(0)).alias(f"_{n}") for n, (fold, _) in values.items()])
    within = Window.partitionBy(*places).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = marked.select("*", *[fold(c).over(within).alias(f"_own_{n}") for n, (fold, c) in values.items()])
    # The window has dealt the rows by these keys already; only the totals move.
    joined = running.join(before, places)
    total = {n: F.col(f"_own_{n}") + F.col(f"_{n}") if n in added else F.col(f"_own_{n}").bitwiseXOR(F.col(f"_{n}"))
             for n in values}
    return joined.select(*df.columns, *[c.alias(n) for n, c in total.items()])


def _places(turns: DataFrame) -> DataFrame:
    """Turns in order: conv_id, pos (from 0), a, b (hashes of role and text), chars."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = _carried(turns, ["conv_id"], order, _cell("turn"), {"pos": F.lit(1)})
    return placed.select(
        "conv_id", (F.col("pos") - 1).alias("pos"), F.xxhash64(F.lit(1), "role", "text").alias("a"),
        F.xxhash64(F.lit(2), "role", "text").alias("b"), F.char_length("text").cast("bigint").alias("chars"))


def rebuilt_turns(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Turns of rebuilt conversations (conv_id, pos, u, v, chars) and the ids of all conversations."""
    placed = settled(_places(turns), "turns")
    base = F.col("conv_id") - F.col("conv_id") % block
    heads = placed.where((base == F.col("conv_id")) & (F.col("pos") < HEADS - 1))
    lengths = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count(F.lit(1)).alias("held"))
    ids = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    known = ids.select("conv_id", base.alias("base"), shared_head(F.col("conv_id")).alias("head")).join(lengths, "base", "left")
    known = settled(known.withColumn("taken", F.least("head", F.coalesce("held", F.lit(0)))), "conversations")
    # At most HEADS - 1 turns for each of at most ``block`` conversations of a block.
    taken = known.where("taken > 0").select("conv_id", "base", "taken").join(
        heads.select(F.col("conv_id").alias("base"), "pos", "a", "b", "chars"), "base").where(F.col("pos") < F.col("taken"))
    own = placed.join(known.select("conv_id", "head", "taken"), "conv_id").where(F.col("pos") >= F.col("head"))
    shifted = own.withColumn("pos", F.col("pos") - F.col("head") + F.col("taken"))
    columns = ["conv_id", "pos", "a", "b", "chars"]
    rows = taken.select(*columns).unionByName(shifted.select(*columns))
    return rows.select("conv_id", "pos", F.xxhash64(F.lit(3), "pos", "a", "b").alias("u"),
                       F.xxhash64(F.lit(4), "pos", "a", "b").alias("v"), "chars"), known.select("conv_id")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per run of rows with the same node; a list of any length is read part by part."""
    node, state, done = None, hashlib.sha256(), []

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], [*_NODE, "ends_sha256"])
        done.clear()
        return batch

    for batch in batches:
        for *own, ids in zip(*(batch.column(c).to_pylist() for c in [*_NODE, "ids"])):
            if own != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(done) > 10_000:
            yield out()
    if node is not None:
        done.append((*node, state.hexdigest()))
        yield out()


def end_lists(ended: DataFrame) -> DataFrame:
    """Digest of the ascending ids that end at each node (depth, u, v, conv_id in, one row per node out)."""
    part = F.shiftright("conv_id", PART_BITS).alias("part")
    parts = ended.groupBy(*_NODE, part).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    strings = parts.select(*_NODE, "part", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    ordered = strings.repartition(*_NODE).sortWithinPartitions(*_NODE, "part")
    return ordered.mapInArrow(_digests, "depth bigint, u bigint, v bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows, ids = rebuilt_turns(turns.where("conv_id IS NOT NULL"), block)
    rows = settled(rows, "rebuilt")
    whole = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("depth"), F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"),
                                        F.sum("chars").alias("total"))
    whole = ids.join(whole, "conv_id", "left").na.fill(0, [*_NODE, "total"])
    whole = settled(whole, "sequences_of_conversations")

    # Equal conversations collapse into one sequence, named after the smallest of them.
    sequences = settled(whole.groupBy(*_NODE).agg(
        F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight"), F.min("total").alias("total")), "sequences")
    ends = end_lists(whole.select(*_NODE, "conv_id"))

    # Prefixes of distinct sequences only.
    kept = sequences.select("seq", "weight", "total", F.col("depth").alias("length"))
    named = rows.select(F.col("conv_id").alias("seq"), "pos", F.col("u").alias("own_u"), F.col("v").alias("own_v"), "chars")
    running = _carried(named.join(kept, "seq"), ["seq"], [F.col("pos")], _cell("pos"),
                       {"upto": F.col("chars")}, {"u": F.col("own_u"), "v": F.col("own_v")})
    prefixes = running.select(
        "seq", "weight", "length", (F.col("pos") + 1).alias("depth"), "u", "v", F.col("u").bitwiseXOR(F.col("own_u")).alias("pu"),
        F.col("v").bitwiseXOR(F.col("own_v")).alias("pv"), "chars", (F.col("total") - F.col("upto") + F.col("chars")).alias("below"))
    zero = F.lit(0).cast("bigint")
    roots = sequences.select(
        "seq", "weight", F.col("depth").alias("length"), *[zero.alias(c) for c in ("depth", "u", "v")],
        *[F.lit(None).cast("bigint").alias(c) for c in ("pu", "pv")], zero.alias("chars"), F.col("total").alias("below"))
    prefixes = settled(prefixes.unionByName(roots), "prefixes")

    inner = prefixes.where("depth < length").select(*_NODE).distinct()
    leaves = sequences.join(inner, _NODE, "left_anti").select(F.col("seq").alias("leaf"))
    marked = settled(prefixes.join(leaves, F.col("seq") == F.col("leaf"), "left").drop("length"), "marked_prefixes")
    nodes = settled(marked.groupBy(*_NODE).agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.min("leaf").alias("owner"), F.min("chars").alias("chars"), F.min("pu").alias("pu"), F.min("pv").alias("pv"),
        F.sum(F.col("weight") * F.col("below")).alias("all_chars")), "nodes")

    owned = nodes.groupBy(F.col("owner").alias("leaf")).agg(F.min("depth").alias("top"), F.sum("chars").alias("owned"))
    share = F.when(F.col("depth") >= F.col("top"), F.col("below")).otherwise(F.col("owned"))
    once = marked.where("leaf IS NOT NULL").join(owned, "leaf").groupBy(*_NODE).agg(F.sum(share).alias("once"))
    parents = nodes.select(F.col("depth").alias("pd"), F.col("u").alias("pu"), F.col("v").alias("pv"),
                           F.col("conv_id").alias("parent_conv_id"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pu").alias("u"), F.col("pv").alias("v")).agg(
        F.count(F.lit(1)).alias("n_children"))
    told = nodes.join(once, _NODE).join(children, _NODE, "left").join(ends, _NODE, "left")
    # Many nodes share a parent, so this join is last and AQE may split it.
    told = told.withColumn("pd", F.col("depth") - 1).join(parents, ["pd", "pu", "pv"], "left")
    return told.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
        "n_leaves", (F.col("all_chars") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
