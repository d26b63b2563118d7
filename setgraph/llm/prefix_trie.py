"""Prefix trie of conversations by preorder intervals.

A conversation is the sequence of its turns; each distinct beginning is a node. Turns are digests of role and text, so
the conversations that are the same are one sequence, and the sequences sorted by their digests are the leaves and inner
ends of the trie from left to right. A sequence's turns are numbered on from the sequence before it (a distributed prefix
sum of lengths), and a node takes the number of its turn in the first sequence that has it: that is a preorder, and a
subtree is all nodes from its top's number to the number of the last turn of the last sequence below it. Leaves and
savings of a subtree are then the difference of a distributed prefix sum at the two ends of the interval.

Shared beginnings never meet as pairs: a node is a group of sequences (partially aggregated), a conversation that many
rows repeat is one sequence. What a task holds of one conversation is 32 bytes a turn. A node's ids are sorted by
range over all tasks and joined into stretches; one task reads the stretches of a node to hash them, and holds one.

Null roles and texts count as empty, turns are ordered with null first, then by role and text; repeated rows are turns
of their own. Rows without conv_id are left out. An empty table gives an empty result (no root).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import join_counted, table, text_of

#: Children of a base share its turns: conversation c begins as c - c % FAMILY, for crc32(c) % HEAD turns.
FAMILY, HEAD = 5, 9
#: Bytes of a turn in a sequence: a digest and the text's size.
DIGEST, RECORD = 24, 32
#: Numbers of a block of the prefix sums.
BLOCK = 50_000
#: Ids of a stretch.
STRETCH = 2000


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, record) for each turn, k from 1: the record is what sequences are made of."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text")).filter("conv_id IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    size = F.octet_length("text")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    record = F.unhex(F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(size.cast("long")), 2 * (RECORD - DIGEST), "0")))
    return rows.select("conv_id", place.cast("long").alias("k"), record.alias("record"))


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """(conv_id, k, record) of every conversation rebuilt from its base's head and its own tail, and of k = 0 for each."""
    conv = F.col("conv_id")
    head = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(HEAD))
    sizes = turns.groupBy("conv_id").agg(F.max("k").alias("size"))
    base = sizes.select(conv.alias("base"), F.col("size").alias("base_size")).filter(F.col("base") % FAMILY == 0)
    convs = sizes.select("conv_id", (conv - conv % FAMILY).alias("base"), head.alias("h")).join(base, "base", "left")
    shared = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = cut_lineage(convs.select("conv_id", "base", "h", shared.alias("shared")))
    # A base has FAMILY conversations at most, and HEAD - 1 turns of it are read.
    heads = turns.filter((conv % FAMILY == 0) & (F.col("k") < HEAD)).withColumnRenamed("conv_id", "base")
    begun = convs.filter("shared > 0").join(heads, "base").filter("k <= shared").select("conv_id", "k", "record")
    tails = turns.join(convs, "conv_id").filter("k > h").select("conv_id", (F.col("k") - F.col("h") + F.col("shared")).alias("k"), "record")
    every = convs.select("conv_id", F.lit(0).cast("long").alias("k"), F.lit(b"").alias("record"))
    return every.unionByName(begun).unionByName(tails)


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, seq): the records of each conversation in order, joined."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", F.hex("record").alias("r")))), lambda t: t["r"])
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("seq"))


def _node(seq: Column) -> Column:
    """The name of the node that a whole sequence ends in."""
    return F.unhex(F.sha2(seq, 256))


NODE = "node binary, parent binary, depth long, first long, last long, members long, conv_id long, bytes long, ends long"


def _beginnings(offsets: dict[int, int]):
    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row for each beginning of each sequence: the node, the numbers of its turn and of the sequence's last one."""
        at, partition = 0, None
        for batch in batches:
            out: list[tuple] = []
            for seq, members, conv_id, part in zip(batch["seq"], batch["members"], batch["conv_id"], batch["part"], strict=True):
                if part != partition:
                    partition, at = part, offsets[part]
                running, n = hashlib.sha256(), len(seq) // RECORD
                parent, name = None, running.digest()
                out.append((name, None, 0, at, at + n, members, conv_id, 0, int(n == 0)))
                for d in range(1, n + 1):
                    record = seq[(d - 1) * RECORD : d * RECORD]
                    running.update(record)
                    parent, name = name, running.digest()
                    out.append((name, parent, d, at + d, at + n, members, conv_id, int.from_bytes(record[DIGEST:], "big"), int(d == n)))
                    if len(out) >= 20_000:
                        yield pd.DataFrame(out, columns=_NODE_COLUMNS)
                        out = []
                at += n + 1
            if out:
                yield pd.DataFrame(out, columns=_NODE_COLUMNS)

    return nodes


_NODE_COLUMNS = [c.split()[0] for c in NODE.split(", ")]


def trie_nodes(convs: DataFrame) -> DataFrame:
    """(node, parent, depth, first, last, members, conv_id, bytes, ends) for each distinct beginning of (conv_id, seq).

    first numbers the nodes in preorder, last is the number up to which those of the subtree go; members begin so, ends of
    them (as distinct sequences, 0 or 1) end there.
    """
    distinct = cut_lineage(convs.groupBy("seq").agg(F.count("*").alias("members"), F.min("conv_id").alias("conv_id")))
    ordered = cut_lineage(distinct.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("part", F.spark_partition_id()))
    # One row for each partition: where its numbers begin.
    sizes = ordered.groupBy("part").agg(F.sum(F.floor(F.length("seq") / RECORD) + 1)).collect()
    parts, counts = zip(*sorted(map(tuple, sizes)), strict=True) if sizes else ((), ())
    offsets = dict(zip(parts, (np.cumsum(counts) - counts).tolist() if counts else (), strict=True))
    begun = ordered.mapInPandas(_beginnings(offsets), NODE)
    return begun.groupBy("node").agg(
        F.first("parent").alias("parent"),
        F.first("depth").alias("depth"),
        F.min("first").alias("first"),
        F.max("last").alias("last"),
        F.sum("members").alias("members"),
        F.min("conv_id").alias("conv_id"),
        F.first("bytes").alias("bytes"),
        F.max("ends").alias("ends"),
    )


def prefix_sums(rows: DataFrame, at: str, *values: str) -> DataFrame:
    """rows with, for each value v, upto_v: its sum over all rows whose number `at` (distinct) is at most this one's.

    Sums within blocks of numbers are windows; the sums of whole blocks, one row for each BLOCK numbers, are added up.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(at) / BLOCK).cast("long"))
    totals = blocked.groupBy("_block").agg(*(F.sum(v).alias(v) for v in values))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_block", *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_before_{v}") for v in values))
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked.select("*", *(F.sum(v).over(inside).alias(f"_inside_{v}") for v in values)).join(totals, "_block")
    return out.select(*rows.columns, *((F.col(f"_inside_{v}") + F.col(f"_before_{v}")).alias(f"upto_{v}") for v in values))


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows (node, conv_id) as stretches of ids of one node."""
    node, ids = None, []
    for batch in batches:
        out = []
        for name, conv_id in zip(batch["node"], batch["conv_id"].tolist(), strict=True):
            if ids and (name != node or len(ids) == STRETCH):
                out.append((node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = name
            ids.append(conv_id)
        yield pd.DataFrame(out, columns=["node", "least", "ids"])
    if ids:
        yield pd.DataFrame([(node, ids[0], ",".join(map(str, ids)))], columns=["node", "least", "ids"])


def _hash_stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted stretches as one hash for each node."""
    node, running = None, None
    for batch in batches:
        out = []
        for name, ids in zip(batch["node"], batch["ids"], strict=True):
            if running is None or name != node:
                if running is not None:
                    out.append((node, running.hexdigest()))
                node, running = name, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends_sha256"])
    if running is not None:
        yield pd.DataFrame([(node, running.hexdigest())], columns=["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the SHA-256 of each node's ids in ascending order, joined by commas."""
    sorted_ids = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    stretches = sorted_ids.mapInPandas(_stretches, "node binary, least long, ids string")
    return stretches.repartition("node").sortWithinPartitions("node", "least").mapInPandas(_hash_stretches, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, k, record); each conversation needs a row, of k = 0 where it has no turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), longs and a string: the
    smallest member, its parent's, members, children, childless nodes in the subtree, bytes of last texts in the subtree
    that prefix caching saves, and the digest of the members that end here. (conv_id, depth) is unique.
    """
    convs = cut_lineage(sequences(turns))
    nodes = cut_lineage(trie_nodes(convs))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("members") - 1) * F.col("bytes")
    summed = cut_lineage(prefix_sums(nodes.withColumns({"leaf": leaf, "saved": saved}), "first", "leaf", "saved"))
    # A sequence is the first of those that go through its end, so the end's own number closes the interval.
    ends = cut_lineage(summed.filter("ends = 1").select(F.col("first").alias("last"), F.col("upto_leaf").alias("leaf_end"), F.col("upto_saved").alias("saved_end")))
    placed = summed.join(ends, "last")
    placed = placed.select("node", "parent", "depth", "conv_id", "members", "n_children", (F.col("leaf_end") - F.col("upto_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("saved_end") - F.col("upto_saved") + F.col("saved")).alias("saved_tokens"))
    digests = ends_digests(convs.select(_node(F.col("seq")).alias("node"), "conv_id"))
    parents = cut_lineage(nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")))
    out = join_counted(placed.join(digests, "node", "left"), parents, "parent", nodes.count())
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all conversations, rebuilt from shared heads."""
    return prefix_trie(with_shared_heads(cut_lineage(turns_in_order(table(spark, sf_dir, "conversations")))))


#: The same in DuckDB; crc32 is computed from its table.
ORACLE = f"""
WITH RECURSIVE steps(i, j, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
    SELECT i, j + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE j < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE j = 8),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, max(k) AS n FROM own GROUP BY conv_id),
heads AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % {HEAD} AS h FROM sizes, crc),
convs AS (SELECT h.*, least(h.h, coalesce(s.n, 0)) AS shared FROM heads h LEFT JOIN sizes s ON s.conv_id = h.base),
rebuilt AS (SELECT c.conv_id, o.k AS d, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.base AND o.k <= c.shared
    UNION ALL SELECT c.conv_id, o.k - c.h + c.shared, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.k > c.h),
paths AS (SELECT conv_id, d, text, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt),
member AS (SELECT conv_id, d, path, strlen(text) AS bytes FROM paths UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
above AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY d DESC) = 1 AS final FROM member),
nodes AS (SELECT d, path, any_value(up) AS up, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '') AS ends FROM above GROUP BY d, path),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.up = n.path),
subtree AS (SELECT a.d, a.path, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.n_convs - 1) * f.bytes) AS saved
    FROM (SELECT DISTINCT a.d, a.path, b.path AS below, b.d AS at FROM above a JOIN above b ON a.conv_id = b.conv_id AND b.d >= a.d) a
    JOIN full_nodes f ON f.d = a.at AND f.path = a.below GROUP BY a.d, a.path)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
    s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN subtree s ON s.d = f.d AND s.path = f.path LEFT JOIN full_nodes p ON p.d = f.d - 1 AND p.path = f.up"""
