"""Near-duplicate vectors by cross-polytope hashing.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; the axis nearest to the result,
with its sign, is a hash. A table takes two such hashes, and every vector is put into the four buckets that the two
nearest axes of each hash make (multiprobe on both sides). Buckets hold ids and sketches of 64 signs only. Pairs in a
bucket whose sketches are near enough are candidates; each distinct one meets its two vectors once and is verified by
its cosine in double precision.

Buckets of more than BLOCK vectors are hot. Their vectors are dealt out as pairs of blocks, which emit no pairs but a
count for each vector and the links of a spanning forest; a pair counts in the first hot bucket that it shares, and in
no other place.

Equal vectors of a label are one class with a number of copies. Vectors that are null, empty, zero, or hold null or
non-finite components, and rows without label or vec_id, link with nothing: n_links is 0. Vectors of different lengths
don't link. Rows that share a vec_id each count as a vector, and what they link to is reached through the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..plans.lineage import cut_lineage
from .common import table

COSINE = 0.93
TABLES, HASHES, PROBES = 7, 2, 2
BUCKETS = PROBES**HASHES
#: Vectors of a bucket that isn't hot; vectors of a block of a hot one.
BLOCK, HOT_BLOCK = 256, 2048
#: Candidates' sketches differ in so many of 64 signs at most; at a cosine of 0.93 that is 4.7 deviations above the mean.
MOST_SIGNS = 20


def rotated(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of x after a round of signs and Hadamard transform for each row of signs; the width is a power of two."""
    width = x.shape[1]
    for sign in signs:
        x, half = x * sign, 1
        while half < width:
            pairs = x.reshape(len(x), width // (2 * half), 2, half)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), width)
            half *= 2
    return x


def bucket_codes(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rows x TABLES x BUCKETS codes of the buckets of each vector."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), width))
    padded[:, : x.shape[1]] = x
    random = np.random.default_rng([seed, width])
    out = np.zeros((len(x), TABLES, BUCKETS), np.int64)
    for t in range(TABLES):
        code = np.zeros((len(x), 1), np.int64)
        for _ in range(HASHES):
            y = rotated(padded, random.choice([-1.0, 1.0], (3, width)))
            axis = np.argpartition(-np.abs(y), PROBES - 1, axis=1)[:, :PROBES]
            nearest = axis * 2 + (np.take_along_axis(y, axis, 1) > 0)
            code = (code[:, :, None] * (2 * width) + nearest[:, None, :]).reshape(len(x), -1)
        out[:, t] = code
    return out


def sketches(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """On which side of 64 random planes each row of x is, as a whole number."""
    planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], 64))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64).ravel()


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _hash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, rows in batch.groupby("size", sort=False):
            x = _unit(rows["embedding"])
            yield rows.drop(columns="embedding").assign(sketch=sketches(x), codes=list(bucket_codes(x).reshape(len(rows), -1)))


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs in a bucket with near sketches. Rows come in the order of buckets; a bucket may go on in the next batch."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch])
        bucket, ids, sketch = (rows[c].to_numpy() for c in ("bucket", "class", "sketch"))
        held = rows[bucket == bucket[-1]] if len(rows) else None
        found = []
        for k in range(1, len(rows)):
            same = np.flatnonzero(bucket[k:] == bucket[:-k])
            if not len(same):
                break
            near = same[np.bitwise_count((sketch[same] ^ sketch[same + k]).view(np.uint64)) <= MOST_SIGNS]
            found.append(np.stack([np.minimum(ids[near], ids[near + k]), np.maximum(ids[near], ids[near + k])], 1))
        if found:
            yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs with the cosine that share no hot bucket."""
    for batch in batches:
        for _, rows in batch.groupby("size", sort=False):
            apart = np.array([not set(x) & set(y) for x, y in zip(rows["hot_a"], rows["hot_b"], strict=True)], bool)
            linked = np.einsum("ij,ij->i", _unit(rows["embedding_a"]), _unit(rows["embedding_b"])) >= COSINE - 1e-15
            yield rows[["a", "b"]][apart & linked]


def _forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what those before them leave apart."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while (up := root.get(v, v)) != v:
            root[v] = v = root.get(up, up)
        return v

    out = []
    for u, v in pairs:
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((u, v))
    return out


def _in_hot_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Links within pairs of blocks of a hot bucket: for each class how many vectors it links to, and forest links."""
    counts, links = [], []
    for (bucket, i, j), block in rows.groupby(["bucket", "i", "j"], sort=False):
        ids, copies, own, hot = (block[c].to_numpy() for c in ("class", "copies", "own", "hot"))
        x = _unit(block["embedding"])
        first = [set(h) for h in hot]
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for at in range(0, len(left), 256):
            a, b = np.nonzero(x[left[at : at + 256]] @ x[right].T >= COSINE - 1e-15)
            a, b = left[at : at + 256][a], right[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            once = np.array([min(first[p] & first[q]) == bucket for p, q in zip(a.tolist(), b.tolist(), strict=True)], bool)
            a, b = a[once], b[once]
            counts.append(pd.DataFrame({"src": np.concatenate([ids[a], ids[b]]), "n": np.concatenate([copies[b], copies[a]])}).groupby("src", as_index=False)["n"].sum())
            links += _forest(list(zip(ids[a].tolist(), ids[b].tolist(), strict=True)))
    counted = pd.concat([*counts, pd.DataFrame({"src": [], "n": []})]).groupby("src", as_index=False)["n"].sum().assign(dst=-1, link=False)
    linked = pd.DataFrame(_forest(links), columns=["src", "dst"]).assign(n=0, link=True)
    return pd.concat([counted, linked])[["src", "dst", "n", "link"]].astype({"src": "int64", "dst": "int64", "n": "int64", "link": bool})


def _usable(vector: str, label: str) -> Column:
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hot_links(hot_members: DataFrame, held: DataFrame) -> DataFrame:
    """src, dst, n, link of all hot buckets; hot_members has bucket, n and class, held the classes with their hot buckets."""
    dealt = hot_members.select("bucket", "class", F.ceil(F.col("n") / HOT_BLOCK).cast("long").alias("blocks"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("class"), "blocks")).join(held, "class")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks", "size")
    parts = hot_members.groupBy("bucket").agg(F.ceil(F.first("n") / HOT_BLOCK).alias("k")).agg(F.sum(F.col("k") * (F.col("k") + 1) / 2)).first()[0] or 1
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(int(parts))))
    return dealt.groupBy("part").applyInPandas(lambda part: _in_hot_blocks(part), "src long, dst long, n long, link boolean")


def linked_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    usable = _usable("embedding", "label")
    # Two hashes of 64 bits name a class.
    key = [F.when(usable, h).alias(name) for name, h in (("h1", F.xxhash64("label", "embedding")), ("h2", F.xxhash64(F.lit("second"), "embedding", "label")))]
    keyed = rows.select("vec_id", *key)
    whole = rows.select("vec_id", "label", "embedding", *key).filter("h1 IS NOT NULL")
    classes = whole.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
    classes = cut_lineage(classes.withColumn("class", F.monotonically_increasing_id()))

    hashed = classes.select("class", "label", F.size("embedding").alias("size"), "embedding").mapInPandas(_hash, "class long, label string, size int, sketch long, codes array<long>")
    bucket = F.xxhash64("label", "size", F.floor(F.col("at") / BUCKETS), "code").alias("bucket")
    spread = cut_lineage(hashed).select("class", "label", "size", "sketch", F.posexplode("codes").alias("at", "code")).select(bucket, "class", "sketch")
    hot = cut_lineage(spread.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK))
    some_hot = not hot.isEmpty()
    cool = spread.join(hot, "bucket", "left_anti") if some_hot else spread
    pairs = cool.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_candidates, "a long, b long").distinct()

    none = F.array().cast("array<long>")
    held = classes.select("class", "copies", "embedding", F.size("embedding").alias("size"), none.alias("hot"))
    if some_hot:
        hot_members = cut_lineage(spread.drop("sketch").join(hot, "bucket"))
        of_class = hot_members.groupBy("class").agg(F.collect_set("bucket").alias("hot"))
        held = cut_lineage(held.drop("hot").join(of_class, "class", "left").withColumn("hot", F.coalesce("hot", none)))
    sides = [held.select(F.col("class").alias(x), F.col("embedding").alias(f"embedding_{x}"), F.col("hot").alias(f"hot_{x}"), *(["size"] if x == "a" else [])) for x in "ab"]
    linked = cut_lineage(pairs.join(sides[0], "a").join(sides[1], "b").mapInPandas(_verified, "a long, b long"))

    named = classes.select("class", "rep", "copies")
    both = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.join(named.select(F.col("class").alias("b"), "copies"), "b").select(F.col("a").alias("class"), F.col("copies").alias("n"))
    if some_hot:
        found = cut_lineage(_hot_links(hot_members, held))
        counts = counts.unionByName(found.filter("not link").select(F.col("src").alias("class"), "n"))
        linked = linked.unionByName(found.filter("link").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    counts = counts.groupBy("class").agg(F.sum("n").alias("n"))
    known = classes.select("h1", "h2", "class", "copies", "rep").join(counts, "class", "left")
    known = cut_lineage(known.select("h1", "h2", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    placed = cut_lineage(keyed.join(known, ["h1", "h2"], "left"))

    ends = named.select("class", "rep")
    links = linked.join(ends.select(F.col("class").alias("a"), F.col("rep").alias("src")), "a").join(ends.select(F.col("class").alias("b"), F.col("rep").alias("dst")), "b")
    links = links.select("src", "dst").unionByName(placed.filter("rep <> vec_id").select(F.col("vec_id").alias("src"), F.col("rep").alias("dst")))
    component = connected_components(links).select(F.col("id").alias("vec_id"), "component")
    component_id = F.coalesce("component", "vec_id")
    out = placed.join(component, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("vec_id") == component_id, F.lit(True)).alias("kept"))


def op5_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings of a label."""
    return linked_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
links AS (SELECT a.r AS p, b.r AS q, a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r
    WHERE list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))
        / sqrt(list_sum(list_transform(a.e, lambda z: z * z))) / sqrt(list_sum(list_transform(b.e, lambda z: z * z))) >= {COSINE}),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT x, min(y) AS c FROM reach GROUP BY x),
n AS (SELECT p, count(*) AS n FROM links GROUP BY p)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM v LEFT JOIN n ON n.p = v.r LEFT JOIN least ON least.x = v.vec_id"""
