"""Near-duplicate texts by weighted minhash signatures (BagMinHash).

A text is the multiset of its shingles of five words (lower case, cut at white space; a text of one to four words is
one shingle). Signatures come from Poisson processes on the plane of time and weight, one for each shingle and each
level of a dyadic partition of weights (0,1], (1,2], (2,4], ...: a point is seen by a text if the text holds the
shingle at least that often, each point belongs to one of the signature's registers, and a register keeps the earliest
point that it sees. Two texts agree in a register with a probability of exactly their weighted Jaccard similarity.

Copies (texts with the same words) are one class from the start. Classes that agree in all registers of a band share
a bucket. First each class is verified against the least one and the most similar one of each of its buckets, which
joins most of a group without all of its pairs. In buckets that still hold several components all plausible pairs of
classes of different components are verified, each pair in the first bucket that it shares, in blocks of texts that
emit no more links than join components. Links are pairs whose multisets themselves overlap by at least the threshold.

A bucket sends the classes outside its largest component to all others, in blocks, so a bucket of one large group and
a few strangers is read once. What a class is compared with is dealt out by words, so the many texts that meet one
leader are many groups, each of which gets the leader's text once.

Null and wordless texts, and rows without doc_id, are copies of nothing (rows without doc_id have a null component).
Rows that share a doc_id count as one document that has the links of each of its texts. An empty table gives an empty
result. Of pairs at a similarity of exactly 0.8 about one in 12,000 has no common bucket or signatures too far apart,
far fewer above it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..plans.lineage import cut_lineage
from .common import table, text_of

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Candidates whose signatures agree in fewer registers aren't verified; at the threshold that is 4 deviations away.
PLAUSIBLE = math.ceil(0.657 * REGISTERS)
#: Rows of a bucket that are compared with one another at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 256
#: Words of texts that are compared at once.
BLOCK_WORDS = 500_000
#: A class of more than this part of all rows counts as hot; there are fewer of them than this.
HOT_PART = 2000
#: Rows of buckets that are sent as one group.
GROUP_ROWS = 1000
#: Texts that are signed at once.
SIGNED_AT_ONCE = 250

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingles(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the text, hash and count of each distinct shingle of each text, sorted by text and hash."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.array([w for words in texts for w in words], dtype=object)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64)
    codes, distinct = pd.factorize(flat)
    word = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in distinct), _U, len(distinct))[codes]
    text_at = np.repeat(np.arange(len(texts)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # words from here to the end of the text
    first = np.repeat(sizes, sizes) == left
    with np.errstate(over="ignore"):
        value = np.full(len(flat), _U(WORDS))
        for k in range(WORDS):
            inside = left > k
            shifted = np.zeros(len(flat), _U)
            shifted[: len(flat) - k] = word[k:]
            value = np.where(inside, mix(value * _U(0x9E3779B97F4A7C15) + shifted), value)
    whole = (left >= WORDS) | first
    text_at, value = text_at[whole], value[whole]
    order = np.lexsort((value, text_at))
    text_at, value = text_at[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (text_at[1:] != text_at[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(new)
    return text_at[starts], value[starts], np.diff(np.append(starts, len(value)))


def signatures(n_texts: int, text_at: np.ndarray, shingle: np.ndarray, count: np.ndarray, spare: float = 3.0) -> np.ndarray:
    """n_texts x REGISTERS hashes of the earliest points; rows of texts without shingles are 0.

    Points up to a time by which probably all registers have one are made, level by level; the few texts with an
    empty register go on to a later time.
    """
    total = np.bincount(text_at, weights=count, minlength=n_texts)
    best = np.full(n_texts * REGISTERS, np.inf)
    made = total > 0
    horizon = np.where(made, (np.log(REGISTERS) + spare) / np.maximum(total, 1), 0.0)
    keep = np.ones(len(shingle), bool)
    low = np.zeros(len(shingle))
    high = np.ones(len(shingle))
    level = 0
    while len(shingle := shingle[keep]):
        text_at, count, low, high = text_at[keep], count[keep], low[keep], high[keep]
        _points(text_at, mix(shingle + _U((level * 0x632BE59BD9B4E019 + 0x1234567) & (2**64 - 1))), count, low[0], high[0], horizon, best)
        keep = count > high
        low, high = high, high * 2
        level += 1
    # The points of later rounds depend on what came before, so an unfilled text is made anew with more time.
    out = best.reshape(n_texts, REGISTERS)
    return out


def _points(text_at, seed, count, low, high, horizon, best) -> None:
    """Add the points of one level to best, the earliest time for each text and register."""
    width = high - low
    time = np.zeros(len(seed))
    end = horizon[text_at]
    state = seed
    while len(state):
        with np.errstate(over="ignore"):
            state = mix(state + _U(0x9E3779B97F4A7C15))
            where = mix(state ^ _U(0xD1B54A32D192ED03))
        time = time - np.log1p(-(state >> _U(11)).astype(np.float64) * 2.0**-53) / (REGISTERS * width)
        going = time < end
        state, time, where, text_at, count, end = (x[going] for x in (state, time, where, text_at, count, end))
        seen = low + width * (where >> _U(32)).astype(np.float64) * 2.0**-32 < count
        register = ((where & _U(0xFFFFFFFF)) * _U(REGISTERS)) >> _U(32)
        np.minimum.at(best, text_at[seen] * REGISTERS + register[seen].astype(np.int64), time[seen])


def sign(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Register hashes (texts x REGISTERS), whether a text has a shingle, and total weights."""
    text_at, shingle, count = shingles(texts)
    n = len(texts)
    weight = np.bincount(text_at, weights=count, minlength=n)
    best = signatures(n, text_at, shingle, count)
    spare = 3.0
    while len(short := np.flatnonzero((weight > 0) & np.isinf(best).any(1))):
        spare *= 2
        place = np.full(n, -1)
        place[short] = np.arange(len(short))
        chosen = place[text_at] >= 0
        best[short] = signatures(len(short), place[text_at[chosen]], shingle[chosen], count[chosen], spare)
    return mix(best.view(_U)), weight > 0, weight.astype(np.int64)


def overlap(a: str, b: str, cache: dict[str, Counter]) -> float:
    """Weighted Jaccard similarity of two texts' shingles."""

    def bag(text: str) -> Counter:
        if text not in cache:
            if len(cache) > 64:
                cache.clear()
            w = words_of(text)
            cache[text] = Counter(zip(*(w[k:] for k in range(WORDS)), strict=False)) if len(w) >= WORDS else Counter([tuple(w)] if w else [])
        return cache[text]

    x, y = bag(a), bag(b)
    if len(x) > len(y):
        x, y = y, x
    get = y.get
    common = sum(min(n, get(s, 0)) for s, n in x.items())
    union = x.total() + y.total() - common
    return common / union if union else 0.0


SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("copy", T.BinaryType()),
        T.StructField("weight", T.LongType()),
        T.StructField("bytes", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType())),
    ]
)


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    step = np.arange(BANDS, dtype=_U)
    for batch in batches:
        for at in range(0, len(batch), SIGNED_AT_ONCE):
            part = batch.iloc[at : at + SIGNED_AT_ONCE]
            texts = [words_of(t) for t in part["text"]]
            registers, has, weight = sign(texts)
            band = np.zeros((len(texts), BANDS), _U)
            with np.errstate(over="ignore"):
                for k in range(ROWS):
                    band = mix(band * _U(0x9E3779B97F4A7C15) + registers[:, k * BANDS : (k + 1) * BANDS] + step)
            small = (registers & _U(255)).astype(np.uint8)
            rows = np.flatnonzero(has)
            if not len(rows):
                continue
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"].to_numpy()[rows],
                    "copy": [xxhash.xxh3_128_digest("\n".join(texts[i]).encode("utf-8", "surrogatepass")) for i in rows],
                    "weight": weight[rows],
                    "bytes": [small[i].tobytes() for i in rows],
                    "bands": list(band[rows].view(np.int64)),
                }
            )


def _overlaps(own: np.ndarray, times: np.ndarray, at: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Weighted Jaccard similarities of a text, by its shingles and their counts, with the n texts that have the others."""
    if not len(own):
        return np.zeros(n)
    place = np.minimum(np.searchsorted(own, shingle), len(own) - 1)
    common = np.bincount(at, weights=np.where(own[place] == shingle, np.minimum(count, times[place]), 0), minlength=n)
    union = np.bincount(at, weights=count, minlength=n) + times.sum() - common
    return common / np.maximum(union, 1)


def _verify_groups(threshold: float):
    def verify(batch: pd.DataFrame) -> pd.DataFrame:
        """Links between the leader of each group and its members."""
        out = []
        for (a, _), rows in batch.groupby(["a", "deal"], sort=False):
            members, leaders = rows[~rows["leads"]], rows[rows["leads"]]
            ids = members["doc_id"].to_numpy()
            described = shingles([words_of(t) for t in members["text"]])
            for text in leaders["text"]:
                out += [(a, b) for b in ids[_overlaps(*shingles([words_of(text)])[1:], *described, len(ids)) >= threshold]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return verify


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of rows (a, b, words of b) whose texts overlap by the threshold or more."""
    deals = cut_lineage(pairs.groupBy("a").agg(F.ceil(F.sum("words") / BLOCK_WORDS).cast("long").alias("deals")))
    dealt = pairs.join(deals, "a").select("a", F.pmod(F.xxhash64("b"), "deals").alias("deal"), F.col("b").alias("doc_id"), "words", F.lit(False).alias("leads"))
    leaders = deals.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("a").alias("doc_id"), F.lit(0).cast("long").alias("words"), F.lit(True).alias("leads"))
    dealt = cut_lineage(dealt.unionByName(leaders))
    parts = _groups(pairs.sparkSession, (dealt.agg(F.sum("words")).first()[0] or 0) // BLOCK_WORDS)
    full = dealt.drop("words").join(texts, "doc_id").withColumn("part", F.pmod(F.xxhash64("a", "deal"), F.lit(parts)))
    return full.groupBy("part").applyInPandas(_verify_groups(threshold), "a long, b long").distinct()


def _groups(spark: SparkSession, wanted: int) -> int:
    """A number of groups that leaves no task without one, and none with much more than the others."""
    return max(wanted, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def _agreeing(registers: np.ndarray, signature: np.ndarray) -> np.ndarray:
    """In how many registers (rows) each signature (column) agrees with one; sums of bytes, as there are fewer than 256."""
    return (registers == signature[:, None]).sum(0, dtype=np.uint8)


def _bytes(rows: pd.DataFrame) -> np.ndarray:
    """The signatures, one row for each register."""
    return np.ascontiguousarray(np.frombuffer(b"".join(rows["bytes"]), np.uint8).reshape(len(rows), REGISTERS).T)


def _nearest(batch: pd.DataFrame) -> pd.DataFrame:
    """Plausible pairs of each class with the least and the most similar class of its block of a bucket."""
    found: set[tuple[int, int, int]] = set()
    for _, rows in batch.groupby(["band", "own"], sort=False):
        if len(rows) < 2:
            continue
        rows = rows.sort_values("rep", kind="stable")
        ids, words, small = rows["rep"].to_numpy(), rows["weight"].to_numpy(), _bytes(rows)
        leader = _agreeing(small, small[:, 0])
        for at in range(1, len(ids)):
            if leader[at] >= PLAUSIBLE:
                found.add((ids[0], ids[at], words[at]))
            near = _agreeing(small, small[:, at])
            near[at] = 0
            best = int(near.argmax())
            if near[best] >= PLAUSIBLE:
                a, b = min(at, best), max(at, best)
                found.add((ids[a], ids[b], words[b]))
    return pd.DataFrame(sorted(x for x in found if x[0] != x[1]), columns=["a", "b", "words"], dtype="int64")


class _Forest:
    """Which components have been joined so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(up, up)
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _link_across(threshold: float):
    least = threshold - 1e-9  # no overlap is greater than the smaller total by the larger one

    def link(batch: pd.DataFrame) -> pd.DataFrame:
        """Links between components, found among the plausible pairs of classes of blocks of buckets; a forest of them."""
        out: list[tuple[int, int]] = []
        forest, described = _Forest(), {}

        def bag(rep: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            if rep not in described:
                described[rep] = shingles([words_of(text)])[1:]
            return described[rep]

        for (band, _, _), rows in batch.groupby(["band", "i", "j"], sort=False):
            others, every = rows[rows["other"]], rows[~rows["other"]]
            if others.empty or every.empty:
                continue
            small, weight = _bytes(every), every["weight"].to_numpy()
            ids, component, main = every["rep"].to_numpy(), every["component"].to_numpy(), every["main"].to_numpy()
            bands, texts = np.array(every["bands"].tolist()), every["text"].tolist()
            place = int(np.flatnonzero(bands[0] == band)[0])
            for rep, own, size, signature, mine, text in zip(others["rep"].tolist(), others["component"].tolist(), others["weight"], _bytes(others).T, others["bands"], others["text"], strict=True):
                agreeing = _agreeing(small, signature)
                near = np.flatnonzero((agreeing >= PLAUSIBLE) & (component != own) & (main | (ids > rep)))
                near = near[np.minimum(weight[near], size) >= least * np.maximum(weight[near], size)]
                if place and len(near):  # a pair is compared in the first bucket that it shares
                    near = near[~(bands[near, :place] == np.asarray(mine)[:place]).any(1)]
                for one in near[np.argsort(-agreeing[near].astype(np.int64), kind="stable")].tolist():
                    if forest.root(own) == forest.root(int(component[one])):
                        continue
                    shingle, count = bag(int(ids[one]), texts[one])
                    if _overlaps(*bag(rep, text), np.zeros(len(shingle), np.int64), shingle, count, 1)[0] >= threshold:
                        forest.join(own, int(component[one]))
                        out.append((rep, int(ids[one])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return link


def _across_components(component: DataFrame, shared: DataFrame, classes: DataFrame, named: DataFrame, threshold: float) -> DataFrame:
    """Links between components that share buckets.

    In a bucket of several components the classes outside the one of most words meet all classes, in blocks of so many
    words, and what is plausible is verified there, each pair in the first bucket that it shares.
    """
    spark = classes.sparkSession
    labelled = shared.select("band", "rep", "weight").join(component.withColumnRenamed("id", "rep"), "rep", "left")
    labelled = cut_lineage(labelled.withColumn("component", F.coalesce("component", "rep")))
    held = labelled.groupBy("band", "component").agg(F.sum("weight").alias("k")).groupBy("band")
    held = held.agg(F.count("*").alias("components"), F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("most")).filter("components > 1")
    blocks = lambda n: F.ceil(n / BLOCK_WORDS).cast("long")
    rest = F.col("n") - F.col("most.k")
    # Written first, it is a plain side of a join, of which Spark can split large keys.
    mixed = cut_lineage(held.select("band", F.col("most.component").alias("largest"), blocks(rest).alias("n_i"), blocks(F.col("n")).alias("n_j"), rest.alias("rest"), "n"))
    members = labelled.join(mixed.drop("rest", "n"), "band")
    number = lambda n: F.pmod(F.xxhash64("rep"), n)
    every_block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    main = (F.col("component") == F.col("largest")).alias("main")
    sent = ("band", "rep", "component", main)
    others = members.filter("component <> largest").select(*sent, number("n_i").alias("i"), every_block("n_j").alias("j"), F.lit(True).alias("other"))
    every = members.select(*sent, every_block("n_i").alias("i"), number("n_j").alias("j"), F.lit(False).alias("other"))
    dealt = cut_lineage(others.unionByName(every))
    words = mixed.agg(F.sum(F.col("rest") * F.col("n_j") + F.col("n") * F.col("n_i"))).first()[0] or 0
    # Ids are small beside texts, so the texts that aren't needed stay where they are.
    needed = named.select(F.col("doc_id").alias("rep"), "text").join(dealt.select("rep").distinct(), "rep", "left_semi")
    full = dealt.join(needed, "rep").join(classes.select("rep", "weight", "bytes", "bands"), "rep")
    full = full.withColumn("part", F.pmod(F.xxhash64("band", "i", "j"), F.lit(_groups(spark, words // BLOCK_WORDS))))
    return full.groupBy("part").applyInPandas(_link_across(threshold), "a long, b long")


def _with_class(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id and rep, the least document of its class. The few hot classes are sent to all tasks."""
    rows, many = signed.select("doc_id", "copy"), classes.filter("copies > 1").select("copy", "rep", "copies")
    bound = signed.count() // HOT_PART
    hot = F.broadcast(many.filter(F.col("copies") > bound).drop("copies"))
    rest = rows.join(hot, "copy", "left_anti").join(many.filter(F.col("copies") <= bound).drop("copies"), "copy", "left")
    return rows.join(hot, "copy").unionByName(rest).select("doc_id", F.coalesce("rep", "doc_id").alias("rep"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, component_id, kept) for each distinct doc_id of docs.

    component_id is the least id that links lead to, kept whether it is the document's own. Rows without id have a
    null component and are kept.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    named = rows.filter(F.col("doc_id").isNotNull())
    signed = cut_lineage(named.mapInPandas(_sign, SIGNED))
    # Copies: one class for each sequence of words, named by its least document.
    classes = signed.groupBy("copy").agg(F.min(F.struct("doc_id", "weight", "bytes", "bands")).alias("least"), F.count("*").alias("copies"))
    classes = cut_lineage(classes.select("copy", F.col("least.doc_id").alias("rep"), "least.weight", "least.bytes", "least.bands", "copies"))
    banded = classes.select("rep", "weight", F.explode("bands").alias("band"))
    buckets = cut_lineage(banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).filter("n > 1"))
    shared = cut_lineage(banded.join(buckets, "band"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    # The least class of a bucket is in each of its blocks.
    dealt = shared.withColumn("own", F.explode(F.when(F.col("rep") == F.col("leader"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))))
    dealt = dealt.select("band", "own", "rep").join(classes.select("rep", "weight", "bytes"), "rep")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("band", "own"), F.lit(_groups(spark, shared.count() // GROUP_ROWS))))
    near = cut_lineage(dealt.groupBy("part").applyInPandas(lambda batch: _nearest(batch), "a long, b long, words long").distinct())
    links = cut_lineage(_verified(near, named, threshold))
    within = cut_lineage(connected_components(links, "a", "b"))
    more = _across_components(within, shared, classes, named, threshold)

    # A document is where its class is; an id of several texts joins their classes.
    placed = cut_lineage(_with_class(signed, classes))
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    several = placed.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b"))
    component = connected_components(within.toDF("a", "b").unionByName(more).unionByName(several), "a", "b").withColumnRenamed("id", "rep")
    once = placed.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(component, "rep", "left")
    unsigned = named.select("doc_id").distinct().join(once, "doc_id", "left")
    found = unsigned.select("doc_id", F.coalesce("component", "rep", "doc_id").alias("component_id"))
    found = found.withColumn("kept", F.col("component_id") == F.col("doc_id"))
    lost = rows.filter(F.col("doc_id").isNull()).select("doc_id", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(lost)


def op3_bagminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
