"""Spelling variants grouped by rolling-hash deletions.

Two words are near if they differ by one inserted, deleted or replaced code point. Each word of m code points has m
deletions; their 64-bit polynomial hashes follow from the word's prefix and suffix sums, for many words at a time in
NumPy. Words that differ by a replacement have a deletion at the same place in common, a word is the deletion of those
that differ from it by an insertion. So all keys (m deletions and the word itself, with its length) are dealt out by
their leading bits, sorted within each part, and runs of equal keys tell the candidates; only rows of such runs meet
their strings, on which every run is verified. A key is eight bytes whatever the word's length, and a run holds at most
the words that one letter at one place makes of a string, so no group grows with the corpus.

Words are counted over all texts by partial aggregation. A word's form is its most frequent near word, if that is
FREQUENT times as frequent; roots follow forms by joins, as often as counts can grow by that factor.

Null texts hold no words; a null doc_id counts as an empty text in the hash. Repeated rows count each. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut_lineage
from .common import ascii_lower, table

#: Least length of a word, least number of its occurrences, and how many times as frequent a form is.
LEAST_CHARS, LEAST_COUNT, FREQUENT = 7, 2, 10
#: One in so many (document, run) loses a code point.
LOSES = 31
#: Keys that are sorted at once.
PART_KEYS = 250_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = _U(pow(_BASE, -1, 2**64))


def spelled_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts, with the code points that the contract takes from some."""
    # A run of fewer code points than a word can't become one.
    found = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_chars},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(found).alias("run"))
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.encode(F.concat("doc_id", F.lit(":"), "run"), "UTF-8"))
    lost = (h % F.length("run")).cast("int")
    word = F.when(h % LOSES == 0, F.concat(F.substring(F.col("run"), F.lit(1), lost), F.substring(F.col("run"), lost + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the word, place of the deleted code point (-1: none) and key of each word and each of its deletions.

    With weights B^0, B^1, ... a prefix sum is the hash of what stands before a place; the suffix sum after it, divided by
    B, is that of the rest moved up by one. All is modulo 2^64, where an odd B has an inverse.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    if not len(words) or not sizes.sum():
        return np.arange(len(words)), np.full(len(words), -1), np.zeros(len(words), _U)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
    first = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - first[word]
    with np.errstate(over="ignore"):
        powers = np.full(int(sizes.max()), _U(_BASE))
        powers[0] = 1
        terms = _mixed(points + _U(0x632BE59BD9B4E019)) * np.cumprod(powers)[place]
        upto = np.cumsum(terms)
        before = np.where(first > 0, upto[np.maximum(first, 1) - 1], _U(0)) * (first > 0).astype(_U)
        total = np.where(sizes > 0, upto[np.maximum(first + sizes, 1) - 1], _U(0)) - before
        prefix, suffix = upto - terms - before[word], total[word] - (upto - before[word])
        deleted = _mixed(prefix + suffix * _INVERSE + _mixed((sizes[word] - 1).astype(_U)))
        whole = _mixed(total + _mixed(sizes.astype(_U)))
    return np.concatenate([word, np.arange(len(words))]), np.concatenate([place, np.full(len(words), -1)]), np.concatenate([deleted, whole])


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        words, ids = batch["word"].tolist(), batch["word_id"].to_numpy()
        word, place, key = deletion_keys(words)
        for at in range(0, len(key), PART_KEYS):
            cut = slice(at, at + PART_KEYS)
            yield pd.DataFrame({"key": key[cut].view(np.int64), "place": place[cut].astype(np.int32), "word_id": ids[word[cut]]})


def _same_as_next(*columns: np.ndarray) -> np.ndarray:
    """Whether each row equals the next one; one shorter than the columns."""
    same = np.ones(max(len(columns[0]) - 1, 0), bool)
    for column in columns:
        same &= column[1:] == column[:-1]
    return same


def _colliding(batch: pd.DataFrame) -> pd.DataFrame:
    """The rows that share key and place with another, and those whose key is that of a whole word and of a deletion."""
    key, place, word = batch["key"].to_numpy(), batch["place"].to_numpy(), batch["word_id"].to_numpy()
    order = np.lexsort((place, word, key))
    by_word = _same_as_next(key[order], word[order])
    first = np.ones(len(order), bool)
    first[order[1:]] = ~by_word  # of a word's places that delete the same, one stands for the insertion
    order = np.lexsort((word, place, key))
    key, place, first = key[order], place[order], first[order]
    pair = _same_as_next(key, place)
    replaced = (place >= 0) & (np.append(pair, False) | np.append(False, pair))
    new = np.append(True, ~_same_as_next(key)) if len(key) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    whole = place[starts] < 0  # -1 sorts first
    inserted = whole[run] & (np.diff(np.append(starts, len(key))) > 1)[run] & first
    return batch.iloc[order[replaced | inserted]]


def _cut(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _best(found: dict[str, list], word: str, near: list[tuple[int, str]]) -> None:
    """Add near words, as (-n, word), to what is found of a word: their number and the first of them."""
    held = found.setdefault(word, [0, (0, "")])
    held[0] += len(near)
    held[1] = min(held[1], *near) if held[0] > len(near) else min(near)


def _near_words(batch: pd.DataFrame) -> pd.DataFrame:
    """(word, n_near, best) from runs of equal keys, each verified on the strings that its rows stand for."""
    batch = batch.sort_values("key", kind="stable")
    key = batch["key"].to_numpy()
    bounds = [0, *(np.flatnonzero(~_same_as_next(key)) + 1).tolist(), len(key)]
    words, places, counts = batch["word"].tolist(), batch["place"].tolist(), batch["n"].tolist()
    found: dict[str, list] = {}
    for low, high in zip(bounds[:-1], bounds[1:], strict=True):
        same: dict[str, list[int]] = {}
        for i in range(low, high):
            same.setdefault(_cut(words[i], places[i]), []).append(i)
        for rows in same.values():
            at_place: dict[int, set[tuple[int, str]]] = {}
            for i in rows:
                at_place.setdefault(places[i], set()).add((-counts[i], words[i]))
            longer = set().union(*(near for place, near in at_place.items() if place >= 0))
            for place, near in at_place.items():
                if place < 0:
                    if longer:
                        for own in near:
                            _best(found, own[1], sorted(longer))
                        for own in longer:
                            _best(found, own[1], sorted(near))
                elif len(near) > 1:
                    first, second = sorted(near)[:2]
                    for own in near:
                        held = found.setdefault(own[1], [0, (0, "")])
                        held[1] = min(second if own == first else first, held[1]) if held[0] else (second if own == first else first)
                        held[0] += len(near) - 1
    return pd.DataFrame([(w, n, best[0], best[1]) for w, (n, best) in found.items()], columns=["word", "n_near", "less", "near"])


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n) for each of words (word, n; distinct) that has near words: their number and the most frequent."""
    spark = words.sparkSession
    named = cut_lineage(words.select("word", "n", F.xxhash64("word").alias("word_id")))
    keys = named.select("word", "word_id").mapInPandas(_key_rows, "key long, place int, word_id long")
    n_keys = named.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(n_keys // PART_KEYS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()
    radix = F.shiftrightunsigned("key", 64 - bits)
    same = cut_lineage(keys.groupBy(radix.alias("radix")).applyInPandas(lambda batch: _colliding(batch), "key long, place int, word_id long"))
    # Ids that two words share add rows, which the strings tell apart.
    full = same.join(named, "word_id").select("key", "place", "word", "n", radix.alias("radix"))
    each = full.groupBy("radix").applyInPandas(lambda batch: _near_words(batch), "word string, n_near long, less long, near string")
    best = each.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    return best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def follow_forms(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows (word, form): where following forms ends. Forms must lead to no circle."""
    roots = cut_lineage(forms.select("word", F.col("form").alias("root")))
    step = forms.select(F.col("word").alias("root"), F.col("form").alias("next"))
    done = []
    while True:
        stepped = cut_lineage(roots.join(step, "root", "left"))
        done.append(stepped.filter("next IS NULL").select("word", "root"))
        roots = stepped.filter("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if roots.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def spelling_variants(words: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of words (word, n; distinct)."""
    words = cut_lineage(words.select("word", "n"))
    near = near_words(words)
    known = words.join(near, "word", "left")
    has = F.coalesce(F.col("near_n") >= frequent * F.col("n"), F.lit(False))
    known = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("near")).alias("form"), F.when(has, F.col("near_n")).alias("form_n")))
    roots = follow_forms(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_variants(spelled_words(table(spark, sf_dir, "documents")))


#: The same in DuckDB; crc32 is computed from its table.
ORACLE = f"""
WITH RECURSIVE steps(i, j, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
    SELECT i, j + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE j < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE j = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{LEAST_CHARS},}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
once AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
bytes AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM once),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS h FROM bytes, crc),
lost AS (SELECT CASE WHEN h % {LOSES} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM hashed),
words AS (SELECT word, sum(k)::BIGINT AS n FROM lost WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gone AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM places),
near AS (SELECT a.word, b.word AS near, b.n FROM gone a JOIN gone b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT g.word, w.word, w.n FROM gone g JOIN words w ON g.rest = w.word
    UNION SELECT w.word, g.word, g.n FROM gone g JOIN words w ON g.rest = w.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM near GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FREQUENT} * w.n THEN near END AS form,
    CASE WHEN near_n >= {FREQUENT} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
chain(word, root) AS (SELECT word, word FROM known UNION ALL SELECT c.word, k.form FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL),
final AS (SELECT c.word, c.root FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NULL)
SELECT k.word, k.form, f.root, k.n, k.n_near, k.form_n FROM known k JOIN final f USING (word)"""
