"""Operator 11, conversation prefix trie with totals by chains of nodes.

Every distinct sequence of first turns is a node.  A node's key is made of
sums over its turns of hashes of (place, role, text), 128 bits in four
lanes; sums run over blocks of places, so a conversation of any length is
split among tasks.  Parents need no lookup: a parent's lanes are its
child's less the last turn's.

Totals over subtrees come from the turns' paths, by a fixed number of jobs
whatever the tree's shape.  Nodes of one smallest member c are a chain: they
are the last nodes of c's path, since members only get fewer on the way
down.  A conversation that goes through a node has its chain wholly below
that node, but for the node's own chain, of which the upper part stands
above.  So a node's total is the sum of the chains of all conversations
through it, less what its own chain has above it.  ``contract`` has totals of
trees that come without paths, by rounds.

Hot keys: conversations are ranked in range partitions of (conversation,
turn), prefix sums run in blocks of ``BLOCK`` places, node facts and
children are pre-aggregated; the ids of a node at which very many
conversations end are joined into strings of up to ``CHUNK`` characters in
range partitions, and one task only hashes these strings in order.

Defined cases: a null turn stands before all others; equal turns are
ordered by role, then by the text's first 64 characters and its MD5;
repeated rows are turns each; null roles and texts are empty; rows without
a conversation id are left out; other columns are ignored; an empty table
gives no rows (it has no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import cut

LANES = 4
BLOCK = 4096
CHUNK = 1 << 16

WORD = r"[^\x20\x09-\x0D]+"


def _lanes(*cols: Column) -> list[Column]:
    """Four 32-bit numbers from two 64-bit hashes of the columns."""
    both = [F.xxhash64(F.lit(seed), *cols) for seed in (1, 2)]
    return [x for h in both for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))]


def _key(depth: Column, lanes: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(":", depth, *lanes)))


def ranked_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv_id, pos from 1, what: the turn's 128-bit hash, words); ranks over range partitions."""
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.substring(text, 1, 64).alias("head"),
        F.md5(text).alias("hash"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text)).alias("what"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))  # tells repeated rows apart; written, so it stays
    order = [F.col("turn").asc_nulls_first(), "role", "head", "hash", "row"]
    spread = cut(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()).select("conv_id", "part", "turn", "role", "head", "hash", "row", "what", "words"))
    inside = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range partition
    start = spread.groupBy("conv_id", "part").agg(F.count("*").alias("n")).select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return (spread.withColumn("inside", inside).join(start, ["conv_id", "part"])
            .select("conv_id", (F.col("start") + F.col("inside")).alias("pos"), "what", "words"))


def rebuild(turns: DataFrame, head: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations made anew: the first ``head`` (at most ``most``) turns of conversation ``base``, then the own turns after the first ``head``.

    ``turns`` as from ``ranked_turns``; ``head`` and ``base`` are columns over
    conv_id.  Returns the turns (same columns) and (conv_id, n_turns).
    """
    none = F.expr("cast(array() as array<struct<pos: bigint, what: string, words: bigint>>)")
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("n_own")).withColumns({"head": head.cast("long"), "base": base.cast("long")})
    # a base lends its few first turns, gathered in one row
    lent = turns.where(F.col("pos") <= most).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "what", "words"))).alias("lent"))
    convs = cut(convs.join(lent, "base", "left").withColumn("lent", F.slice(F.coalesce("lent", none), 1, F.col("head").cast("int"))))
    n_lent = F.size("lent").cast("long")
    taken = convs.select("conv_id", F.explode("lent").alias("t")).select("conv_id", "t.pos", "t.what", "t.words")
    block = F.floor((F.col("pos") - 1) / BLOCK)
    by_block = convs.select("conv_id", "head", n_lent.alias("n_lent"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_own") - 1) / BLOCK))).alias("block"))
    own = (turns.withColumn("block", block).join(by_block, ["conv_id", "block"]).where("pos > head")
           .select("conv_id", (F.col("pos") - F.col("head") + F.col("n_lent")).alias("pos"), "what", "words"))
    return taken.unionByName(own), convs.select("conv_id", (n_lent + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))).alias("n_turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, node, parent, words): each turn's node and that before it."""
    lanes = [f"l{i}" for i in range(LANES)]
    hashed = turns.select("conv_id", "pos", "words", *[c.alias(n) for c, n in zip(_lanes(F.col("pos"), F.col("what")), lanes)]).withColumn("block", F.floor((F.col("pos") - 1) / BLOCK))
    upto = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sums = hashed.groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in lanes])
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"b{n}") for n in lanes])
    full = hashed.select("*", *[F.sum(n).over(upto).alias(f"u{n}") for n in lanes]).join(sums, ["conv_id", "block"])
    here = [F.col(f"u{n}") + F.col(f"b{n}") for n in lanes]
    return full.select("conv_id", F.col("pos").alias("depth"), _key(F.col("pos"), here).alias("node"),
                       _key(F.col("pos") - 1, [h - F.col(n) for h, n in zip(here, lanes)]).alias("parent"), "words")


def root_key() -> Column:
    return _key(F.lit(0), [F.lit(0)] * LANES)


def contract(tree: DataFrame, weights: list[str]) -> DataFrame:
    """Subtree totals of ``weights`` (longs) for every node of ``tree`` (node, parent: null at roots, kids: number of children).

    Returns (node, weights...).  ``up`` weights are those of nodes spliced out
    between a node and its present parent.  Both sides of each join shrink
    from round to round; a shuffle for all of them keeps them off the driver.
    """
    up, add = ({w: f"{p}_{w}" for w in weights} for p in ("up", "add"))
    # the round's number is a column: rounds then share their generated code
    active, left = _counted(tree.select("node", "parent", F.col("kids").cast("long").alias("kids"), F.lit(0).cast("long").alias("turn"), *weights, *[F.lit(0).cast("long").alias(u) for u in up.values()]))
    raked, spliced = [active.limit(0).select("node", *weights)], []
    while left:
        leaf = F.col("kids") == 0
        met = active.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(leaf, F.col(w) + F.col(up[w])).otherwise(0)).alias(f"got_{w}") for w in weights],
            F.count_if(~leaf).alias("left"), F.min(F.when(~leaf, F.col("node"))).alias("child"))
        raked.append(active.where(leaf).select("node", *weights))
        rank = [F.xxhash64("turn", c) for c in ("node", "parent", "child")]
        peak = (F.col("left") == 1) & F.col("parent").isNotNull() & (rank[0] > rank[1]) & (rank[0] > rank[2])
        rest = active.where(~leaf).join(met.hint("merge"), "node").select(
            "node", "parent", F.col("left").alias("kids"), (F.col("turn") + 1).alias("turn"), *[(F.col(w) + F.col(f"got_{w}")).alias(w) for w in weights], *up.values(), F.when(peak, F.col("child")).alias("into"))
        moved = rest.where("into is not null").select(F.col("into").alias("node"), F.col("node").alias("gone"), F.col("parent").alias("to"),
                                                      *[F.col(w).alias(add[w]) for w in weights], *[F.col(up[w]).alias(f"up_{add[w]}") for w in weights])
        after, left = _counted(rest.where("into is null").drop("into").join(moved.hint("merge"), "node", "left"))
        spliced.append(after.where("gone is not null").select("gone", F.col("node").alias("into"), *[(F.col(add[w]) + F.col(up[w])).alias(add[w]) for w in weights]))
        active = after.select("node", F.coalesce("to", "parent").alias("parent"), "kids", "turn", *weights, *[
            (F.col(up[w]) + F.coalesce(add[w], F.lit(0)) + F.coalesce(f"up_{add[w]}", F.lit(0))).alias(up[w]) for w in weights])
    settled = reduce(DataFrame.unionByName, raked)
    if not spliced:
        return settled
    # a spliced node's total is that of the node it went into, plus what was noted; that one may itself have been spliced
    # in a later round, so these links are doubled until all lead to raked nodes
    links = cut(reduce(DataFrame.unionByName, spliced))
    for _ in range((len(spliced) - 1).bit_length()):
        onward = links.select(F.col("gone").alias("into"), F.col("into").alias("to"), *[F.col(add[w]).alias(w) for w in weights])
        links = cut(links.join(onward.hint("merge"), "into", "left").select("gone", F.coalesce("to", "into").alias("into"), *[(F.col(add[w]) + F.coalesce(w, F.lit(0))).alias(add[w]) for w in weights]))
    ends = settled.withColumnRenamed("node", "into")
    return settled.unionByName(links.join(ends.hint("merge"), "into").select(F.col("gone").alias("node"), *[(F.col(w) + F.col(add[w])).alias(w) for w in weights]))


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written to the checkpoint folder, and its rows, counted on the way."""
    seen = Observation()
    df = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return df, seen.get["n"]


def chain_totals(nodes: DataFrame, path: DataFrame, weights: list[str]) -> DataFrame:
    """Subtree totals (node, weights...) of ``nodes`` (node, conv_id: smallest member, depth, weights: longs) of a trie; ``path``: (conv_id, depth, node) of every turn.

    Chains and paths are split into blocks of depths, so none is one task's.
    """
    block = F.floor(F.col("depth") / BLOCK).alias("block")
    chains = nodes.select("*", block)
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sums = chains.groupBy("conv_id", "block").agg(*[F.sum(w).alias(w) for w in weights])
    sums = sums.select("conv_id", "block", *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"b_{w}") for w in weights])
    above = chains.select("node", "conv_id", "block", *[F.coalesce(F.sum(w).over(upto), F.lit(0)).alias(f"u_{w}") for w in weights]).join(sums, ["conv_id", "block"]) \
        .select("node", *[(F.col(f"u_{w}") + F.col(f"b_{w}")).alias(f"above_{w}") for w in weights])
    # a chain ends with its conversation, whose every block of turns gets the chain's sums
    whole = nodes.groupBy("conv_id").agg(*[F.sum(w).alias(w) for w in weights], F.max("depth").alias("last"))
    by_block = whole.select("conv_id", *weights, F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / BLOCK))).alias("block"))
    through = path.select("conv_id", "node", block).join(by_block, ["conv_id", "block"]).groupBy("node").agg(*[F.sum(w).alias(w) for w in weights])
    root = whole.agg(*[F.sum(w).alias(w) for w in weights]).select(root_key().alias("node"), *weights)
    return above.join(through.unionByName(root), "node").select("node", *[(F.col(w) - F.col(f"above_{w}")).alias(w) for w in weights])


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, conv_id) to (node, SHA-256 of its ids in numeric order, comma-joined); strings are joined in range partitions."""
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0
        out: list[dict] = []

        def flush() -> None:
            if ids:
                out.append({"node": node, "first": ids[0], "ids": ",".join(map(str, ids))})
        for batch in batches:
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != node or size > CHUNK:
                    flush()
                    node, ids, size = key, [], 0
                ids.append(i)
                size += 20
            if len(out) >= 64:
                yield pa.RecordBatch.from_pylist(out, made)
                out = []
        flush()
        if out:
            yield pa.RecordBatch.from_pylist(out, made)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != node:
                    if sha:
                        out.append((node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(ids.encode())
            yield pa.RecordBatch.from_pylist([{"node": k, "sha": s} for k, s in out], found)
            out = []
        if sha:
            yield pa.RecordBatch.from_pylist([{"node": node, "sha": sha.hexdigest()}], found)

    made = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    found = pa.schema([("node", pa.binary()), ("sha", pa.string())])
    joined = ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(chunks, "node binary, first long, ids string")
    return joined.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(digest, "node binary, sha string")


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The trie's nodes with their facts; ``turns`` (conv_id, pos, what, words) and ``sizes`` (conv_id, n_turns: zero ones count too)."""
    spark = turns.sparkSession
    path = cut(prefixes(turns))
    below = path.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words"), F.count("*").alias("n_convs"))
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        root_key().alias("node"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("words"), "n_convs")
    nodes = cut(below.unionByName(root))
    salt = F.pmod(F.xxhash64("node"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    child = nodes.where("parent is not null").select("node", "parent", salt.alias("salt"))
    # a parent's row goes to each salt that has children of it, so that a parent of very many isn't one task's
    by_salt = child.groupBy("parent", "salt").agg(F.count("*").alias("n"))
    known = by_salt.join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent").drop("n")
    parents = child.join(known, ["parent", "salt"]).select("node", "parent_conv_id")
    kids = by_salt.groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("kids"))
    tree = cut(nodes.join(kids, "node", "left").join(parents, "node", "left").select(
        "*", F.coalesce("kids", F.lit(0)).alias("n_children")).drop("kids"))
    totals = chain_totals(tree.select("node", "conv_id", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                                      ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), path, ["n_leaves", "saved_tokens"])
    ends = path.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")).unionByName(sizes.where("n_turns = 0").select("conv_id", root_key().alias("node")))
    shas = id_digests(cut(ends))
    return tree.join(totals, "node").join(shas, "node", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, head: Column | None = None, base: Column | None = None, most: int = 0, **columns: str) -> DataFrame:
    """The trie of ``conversations``, as they are or rebuilt (see ``rebuild``); see the module text."""
    turns = cut(ranked_turns(conversations, **columns))
    if head is None:
        return trie(turns, turns.groupBy("conv_id").agg(F.max("pos").alias("n_turns")))
    return trie(*rebuild(turns, head, base, most))


#: DuckDB has no CRC-32: one step for each byte (exclusive or) and eight for its bits.
_CRC = ("xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(c::varchar) + 1), "
        "lambda i: [ascii(substr(c::varchar, i::int, 1))::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), "
        "lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, 3988292384 * (a & 1)) end))")

ORACLE = f"""
with t as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), substr(coalesce(text, ''), 1, 64), md5(coalesce(text, ''))) as pos,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) as h,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null),
ids as (select distinct c from t), cs as (select c, {_CRC} % 4 as head, c - c % 20 as base from ids),
r as (select cs.c, t.pos, t.h, t.words from cs join t on t.c = cs.base where t.pos <= cs.head
      union all select cs.c, t.pos - cs.head + least(cs.head, (select count(*) from t as b where b.c = cs.base)), t.h, t.words from cs join t on t.c = cs.c where t.pos > cs.head),
p as (select c, pos as depth, words, md5(string_agg(h, ',') over (partition by c order by pos)) as k from r
      union all select c, 0, 0, '' from cs),
n as (select k, depth, min(c) as c, count(*) as n_convs, any_value(words) as words from p group by k, depth),
up as (select n.k, n.depth, n.c, n.n_convs, n.words, q.k as above from n left join p as q on q.c = n.c and q.depth = n.depth - 1),
kids as (select above as k, count(*) as n_children from up where above is not null group by above),
f as (select up.*, coalesce(kids.n_children, 0) as n_children from up left join kids on kids.k = up.k),
sub as (select a.k, sum((f.n_children = 0)::int)::bigint as n_leaves, sum((f.n_convs - 1) * f.words)::bigint as saved_tokens
        from f join p as a on a.c = f.c and a.depth <= f.depth group by a.k),
ends as (select k, sha256(string_agg(c::varchar, ',' order by c)) as sha from (select c, max_by(k, depth) as k from p group by c) group by k)
select f.c as conv_id, f.depth::bigint as depth, m.c as parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens, coalesce(ends.sha, sha256('')) as ends_sha256
from f join sub on sub.k = f.k left join n as m on m.k = f.above left join ends on ends.k = f.k
"""
