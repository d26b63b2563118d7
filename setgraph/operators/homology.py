"""Simplicial homology mod 2 of the complex that the edges span.

Cells and boundary matrices are tables; elimination works on rows as Python integers (bit i is column i) on the
driver, behind a size guard.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator, Sequence
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import SetGraphError
from ..graph import HGraph
from ..plans.guards import bounded_rows
from ..plans.lineage import forget, written
from .pairs import dense_index

#: The most cells of a dimension for elimination on the driver; the largest image whose elements are listed.
MOST_CELLS, MOST_IMAGE = 20_000, 20
#: 1s of a product or a sum that a task counts.
TASK_CELLS = 2_000_000
#: Cells that are sorted at a time, so that what a shuffle writes stays bounded, and cells that a task makes at a time.
PASS_CELLS, CHUNK_CELLS = 100_000_000, 500_000
#: Rows of a matrix that share the lists of a product, and columns whose 1s are sent together to a sum.
BLOCK = 1024


# -- cells and boundaries as tables -------------------------------------------------------------------------------


def _places(k: int) -> list[str]:
    return [f"_{i}" for i in range(k + 1)]


def _chains(graph: HGraph, k: int) -> DataFrame:
    """The nodes of kchainbasis as columns, which are joined and sorted faster than arrays; a chain comes once for each edge."""
    if k < 0:
        raise SetGraphError("k has to be 0 or more")
    places = _places(k)
    cells = graph.pairs.select("edge", F.col("node").alias(places[0]))
    for last, place in itertools.pairwise(places):
        cells = cells.join(graph.pairs.select("edge", F.col("node").alias(place)), "edge").filter(F.col(place) > F.col(last))
    return cells.select(*places)


def kchainbasis(graph: HGraph, k: int) -> DataFrame:
    """cell: the distinct sorted arrays of k + 1 nodes that an edge holds."""
    return _chains(graph, k).distinct().select(F.array(*_places(k)).alias("cell"))


def indexed_cells(graph: HGraph, k: int) -> DataFrame:
    """cell, idx: places in the sorted order of cells."""
    return dense_index(_chains(graph, k), *_places(k)).select(F.array(*_places(k)).alias("cell"), "idx")


def boundary(lower: DataFrame, upper: DataFrame, k: int | None = None) -> DataFrame:
    """row, col: the 1s of the boundary matrix from indexed cells of dimension k (by default that of a first cell) to those of
    the one below."""
    if k is None:
        first = upper.select(F.size("cell").alias("n")).first()
        k = first["n"] - 1 if first else 1
    if k < 1:
        raise SetGraphError("dimensions have to be 1 or more")
    places = _places(k)[1:]
    at = lambda i: F.col("cell")[i]
    ways = [F.struct(*(at(i).alias(p) for i, p in zip((i for i in range(k + 1) if i != out), places, strict=True))) for out in range(k + 1)]
    faces = upper.select(F.col("idx").alias("col"), F.explode(F.array(*ways)).alias("way")).select("col", "way.*")
    return faces.join(lower.select(F.col("idx").alias("row"), *(at(i).alias(p) for i, p in enumerate(places))), places).select("row", "col")


def _subsets(n: int, m: int, ranks: np.ndarray) -> np.ndarray:
    """The combinations of m of n places with these numbers in sorted order, a row each."""
    out, start, ranks = np.empty((len(ranks), m), np.int64), np.zeros(len(ranks), np.int64), ranks.copy()
    for i in range(m):
        counts = np.array([math.comb(x, m - i) for x in range(n + 1)], np.int64)
        left = counts[n - start] - ranks
        x = np.searchsorted(counts, left)
        out[:, i], start, ranks = n - x, n - x + 1, counts[x] - left
    return out


def _numbers(n: int, subsets: np.ndarray) -> np.ndarray:
    """The numbers of combinations of n places in sorted order: the inverse of _subsets."""
    m, start, out = subsets.shape[1], np.zeros(len(subsets), np.int64), np.zeros(len(subsets), np.int64)
    for i in range(m):
        counts = np.array([math.comb(x, m - i) for x in range(n + 1)], np.int64)
        out, start = out + counts[n - start] - counts[n - subsets[:, i]], subsets[:, i] + 1
    return out


def _faces(n: int, j: int, first: int, last: int) -> np.ndarray:
    """Of cells of dimension j + 1 among n nodes, by number, those of their faces, that without the last node first."""
    cells = _subsets(n, j + 2, np.arange(first, last))
    return np.stack([_numbers(n, np.delete(cells, out, 1)) for out in range(j + 1, -1, -1)])


@cache
def _few_faces(n: int, j: int, total: int) -> np.ndarray:
    return _faces(n, j, 0, total)


def _cofaces(j: int, parts: int, lower: int, low: int, high: int, faces: int, keep: bool):
    """From edges and the numbers of the j-cells that they hold (held, sorted) the first faces of their cells of dimension j + 1,
    those without the last node first, in parts low up to high. keep: with the edge, else without what repeats in a chunk."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, some in batch.groupby(batch["held"].map(len)):
                n = next(x for x in itertools.count(j + 1) if math.comb(x, j + 1) == size)
                held, edges, total = np.stack(some["held"].to_numpy()), some["edge"].to_numpy(), math.comb(n, j + 2)
                step, width = max(1, CHUNK_CELLS // max(1, total)), min(total, CHUNK_CELLS)
                for first, at in itertools.product(range(0, total, max(1, width)), range(0, len(held), step)):
                    last = min(total, first + width)
                    places = _few_faces(n, j, total) if width == total <= 4096 else _faces(n, j, first, last)
                    found = [held[at : at + step, f].ravel() for f in places[:faces]]
                    part = found[0] * parts // lower
                    rows = np.flatnonzero((part >= low) & (part < high))
                    if not keep:
                        order = rows[np.lexsort((found[1][rows], found[0][rows]))]
                        a, b = found[0][order], found[1][order]
                        rows = order[np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]] if len(order) else order
                    if len(rows):
                        made = {"part": (part[rows] - low).astype(np.int32)} | {f"f{i}": x[rows] for i, x in enumerate(found)}
                        yield pd.DataFrame(made | ({"edge": np.repeat(edges[at : at + step], last - first)[rows]} if keep else {}))

    return make


def _places_of(sort: list[str], keep: list[str]):
    """Of sorted rows, which repeat where these columns do, the place of each different one; without keep only the first of each."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, n = None, 0
        for batch in batches:
            if not len(batch):
                continue
            x = batch[sort].to_numpy()
            new = np.r_[before is None or bool((x[0] != before).any()), (x[1:] != x[:-1]).any(1)]
            place = n + np.cumsum(new) - 1
            before, n = x[-1], int(place[-1]) + 1
            yield batch.assign(place=place)[["place", *keep]] if keep else batch.drop(columns="part").assign(place=place)[new]

    return number


def _next_cells(held: DataFrame, j: int, lower: int, whole: bool) -> tuple[DataFrame, int]:
    """Cells of dimension j + 1, numbered in sorted order, and how many there are, from held (edge, held) with `lower` j-cells.

    Sorted by its faces without the last node and without the last but one, a cell is in the order of its nodes. Stretches
    of the first face are sorted by a task each, PASS_CELLS at a time. whole: faces f0, f1, ..., idx of each cell; else edge,
    idx of all cells that an edge holds.
    """
    sizes = held.groupBy(F.size("held").alias("n")).count().collect()
    nodes = {r["n"]: next(x for x in itertools.count(j + 1) if math.comb(x, j + 1) == r["n"]) for r in sizes}
    made = sum(r["count"] * math.comb(nodes[r["n"]], j + 2) for r in sizes)
    passes = max(1, -(-made // PASS_CELLS))
    parts = passes * -(-_tasks(held, 2 * made) // passes)
    kind, faces = held.schema["edge"].dataType.simpleString(), j + 2 if whole else 2
    columns = [f"f{i}" for i in range(faces)]
    given, kept = ", ".join(f"{c} long" for c in columns), "place long" if whole else f"place long, edge {kind}"
    tables = []
    for low in range(0, parts, parts // passes):
        high = low + parts // passes
        rows = held.mapInPandas(_cofaces(j, parts, max(1, lower), low, high, faces, not whole), f"part int, {given}" + ("" if whole else f", edge {kind}"))
        rows = rows.repartitionById(high - low, "part").sortWithinPartitions("f0", "f1")
        rows = rows.mapInPandas(_places_of(["f0", "f1"], [] if whole else ["edge"]), f"{given}, {kept}" if whole else kept)
        tables.append(written(rows.withColumn("part", F.spark_partition_id() + low)))
    found = reduce(DataFrame.unionByName, tables)
    ends = found.groupBy("part").agg((F.max("place") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ends.select("part", before.alias("before"), "n")
    n = ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    placed = found.join(F.broadcast(offsets.select("part", "before")), "part").withColumn("idx", F.col("place") + F.col("before"))
    if whole:
        return placed.select(*columns, "idx"), n
    lists = _held(placed, n)
    forget(held.sparkSession, *tables)
    return lists, n


def _held(cells: DataFrame, n: int) -> DataFrame:
    """edge, held: the sorted numbers of the cells that each edge holds."""
    return written(cells.repartition(_tasks(cells, n), "edge").groupBy("edge").agg(F.array_sort(F.collect_list("idx")).alias("held")))


def boundary_matrix(graph: HGraph, k: int) -> DataFrame:
    """row, col: what boundary gives for the graph's indexed cells of dimensions k - 1 and k.

    A cell's faces are found where its edge is: in sorted order the cells of an edge are the combinations of its nodes, so
    faces have their places by arithmetic. Neither nodes nor faces are joined; the matrix is read from the cells, each of
    which is written once with its faces.
    """
    if k < 1:
        raise SetGraphError("dimensions have to be 1 or more")
    pairs = written(graph.pairs)
    nodes = dense_index(pairs, "node")
    n = nodes.count()
    held = _held(pairs.join(nodes, "node"), pairs.count())
    forget(graph.spark, pairs)
    for j in range(k - 1):
        before = held
        held, n = _next_cells(held, j, n, False)
        forget(graph.spark, before)
    cells, _ = _next_cells(held, k - 1, n, True)
    forget(graph.spark, held)
    return cells.select(F.explode(F.array(*(f"f{i}" for i in range(k + 1)))).alias("row"), F.col("idx").alias("col"))


def chain_complex(graph: HGraph, k: int | Sequence[int] | None = None) -> tuple[dict, dict]:
    """Indexed cells and boundary tables by dimension, for the dimensions of k and one above and below."""
    largest = graph.edge_sizes().agg(F.max("size")).first()[0] or 0
    ks = krange(largest - 1, k)
    cells = {j: indexed_cells(graph, j).persist() for j in range(ks[0] - 1, ks[-1] + 2)}
    return cells, {j: boundary(cells[j - 1], cells[j], j) for j in range(ks[0], ks[-1] + 2)}


def krange(most: int, k: int | Sequence[int] | None = None) -> list[int]:
    """Dimensions from 1 up to `most` that are asked for; a number stands for itself, a pair for a range."""
    if k is None:
        lo, hi = 1, most
    elif isinstance(k, int):
        lo = hi = k
    else:
        lo, hi = min(k), max(k)
    if lo < 1:
        raise SetGraphError("dimensions have to be 1 or more")
    hi = max(min(hi, most), lo)
    return list(range(lo, hi + 1))


def logical_matmul_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, col of the 1s of a product mod 2 of two matrices given by their 1s, which are read more than once.

    At each index the list of b's columns meets those of a's rows, and is sent once to each block of rows. A 1 of the product
    seldom comes twice from one task, so they are counted only where all of a block are together. Tasks grow in
    number with the products; rows with very many of them are dealt by column.
    """
    left, right = a.select(F.col("col").alias("_k"), "row"), b.select(F.col("row").alias("_k"), "col")
    at = left.groupBy("_k").agg(F.count("*").alias("n")).join(right.groupBy("_k").agg(F.count("*").alias("m")), "_k")
    made, longest = at.agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    widest = left.groupBy("row").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    tasks, slices = _tasks(a, made), min(made, longest * widest) // TASK_CELLS + 1
    right = right.select("_k", _short(right, "col"), F.pmod(F.xxhash64("col"), F.lit(slices)).cast("int").alias("_slice"))
    lists = right.repartition(tasks, "_k", "_slice").groupBy("_k", "_slice").agg(F.collect_list("col").alias("cols"))
    left = left.select("_k", _short(left, "row"), F.floor(F.col("row") / BLOCK).alias("_block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    blocks = left.repartition(tasks, "_k", "_slice").groupBy("_k", "_slice", "_block").agg(F.collect_list("row").alias("rows"))
    met = blocks.join(lists, ["_k", "_slice"]).select("_block", "_slice", "rows", "cols").repartition(tasks, "_block", "_slice")
    ones = met.select("_block", "_slice", F.explode("rows").alias("row"), "cols").select("_block", "_slice", "row", F.explode("cols").alias("col"))
    counts = ones.groupBy("_block", "_slice", "row", "col").agg(F.count("*").alias("n"))
    return counts.filter("n % 2 = 1").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


def logical_matadd_table(a: DataFrame, b: DataFrame) -> DataFrame:
    """row, col of the 1s of a sum mod 2. Both are read twice: tasks grow in number with the 1s, which are sent as lists of a
    block of columns and counted where all of it are together. Blocks with very many are dealt by row."""
    both = a.select("row", "col").unionAll(b.select("row", "col"))
    blocks = both.groupBy(F.floor(F.col("col") / BLOCK).alias("_block")).agg(F.count("*").alias("n"))
    made, most = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    dealt = both.select("row", "col", F.pmod(F.xxhash64("row"), F.lit(most // TASK_CELLS + 1)).cast("int").alias("_slice"))
    kind = "int" if _short_ids(both, "row") else "long"
    sent = dealt.mapInPandas(_packed, f"_block long, _slice int, rows array<{kind}>, ats array<short>").repartition(_tasks(a, made), "_block", "_slice")
    ones = sent.select("_block", "_slice", F.explode(F.arrays_zip("rows", "ats")).alias("x"))
    counts = ones.groupBy("_block", "_slice", F.col("x.rows").alias("row"), F.col("x.ats").alias("_at")).agg(F.count("*").alias("n")).filter("n % 2 = 1")
    return counts.select(F.col("row").cast("long").alias("row"), (F.col("_block") * BLOCK + F.col("_at")).alias("col"))


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each batch of 1s (row, col, _slice) the rows, and columns counted from the block's first, by block and slice."""
    for batch in batches:
        if len(batch):
            batch = batch.assign(_block=batch["col"] // BLOCK).sort_values(["_block", "_slice"], kind="stable")
            keys = batch[["_block", "_slice"]].to_numpy()
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
            lists = [np.split(batch[c].to_numpy() % d if d else batch[c].to_numpy(), first[1:]) for c, d in (("row", 0), ("col", BLOCK))]
            yield pd.DataFrame({"_block": keys[first, 0], "_slice": keys[first, 1], "rows": lists[0], "ats": lists[1]})


def _short_ids(rows: DataFrame, column: str) -> bool:
    """Whether all values of the column fit an int."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    return high is None or -(2**31) <= low <= high < 2**31


def _short(rows: DataFrame, column: str) -> Column:
    return F.col(column).cast("int") if _short_ids(rows, column) else F.col(column)


def _tasks(rows: DataFrame, made: int) -> int:
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-made // TASK_CELLS))


# -- small dense matrices mod 2 -----------------------------------------------------------------------------------


def bkMatrix(lower: Sequence[tuple], upper: Sequence[tuple]) -> np.ndarray:  # noqa: N802
    """The boundary matrix between two lists of cells."""
    at = {tuple(c): i for i, c in enumerate(lower)}
    out = np.zeros((len(lower), len(upper)), int)
    for j, cell in enumerate(upper):
        for face in combinations(cell, len(cell) - 1):
            if face in at:
                out[at[face], j] = 1
    return out


def swap_rows(i: int, j: int, *matrices: np.ndarray) -> list[np.ndarray]:
    """Copies with rows i and j exchanged."""
    out = [m.copy() for m in matrices]
    for m in out:
        m[[i, j]] = m[[j, i]]
    return out


def swap_columns(i: int, j: int, *matrices: np.ndarray) -> list[np.ndarray]:
    """Copies with columns i and j exchanged."""
    return [m.T for m in swap_rows(i, j, *(m.T for m in matrices))]


def add_to_row(matrix: np.ndarray, i: int, j: int) -> np.ndarray:
    """A copy with row j added to row i mod 2."""
    out = matrix.copy()
    out[i] = (out[i] + out[j]) % 2
    return out


def add_to_column(matrix: np.ndarray, i: int, j: int) -> np.ndarray:
    """A copy with column j added to column i mod 2."""
    return add_to_row(matrix.T, i, j).T


def logical_dot(a: Sequence[int], b: Sequence[int]) -> int:
    if len(a) != len(b):
        raise SetGraphError("vectors of different lengths")
    return int(np.dot(np.asarray(a, int) % 2, np.asarray(b, int) % 2) % 2)


def logical_matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = np.atleast_2d(a), np.atleast_2d(b)
    if a.shape[1] != b.shape[0]:
        raise SetGraphError(f"shapes {a.shape} and {b.shape} don't fit")
    return (a.astype(int) @ b.astype(int)) % 2


def logical_matadd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if np.shape(a) != np.shape(b):
        raise SetGraphError(f"shapes {np.shape(a)} and {np.shape(b)} don't fit")
    return (np.asarray(a, int) + np.asarray(b, int)) % 2


def matmulreduce(matrices: Sequence[np.ndarray], reverse: bool = False) -> np.ndarray:
    """The product of a sequence of matrices mod 2, in reverse order if wanted."""
    matrices = list(matrices)[::-1] if reverse else list(matrices)
    out = matrices[0]
    for m in matrices[1:]:
        out = logical_matmul(out, m)
    return out


def reduced_row_echelon_form_mod2(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L, S, L inverse with L M = S in reduced row echelon form."""
    s = np.asarray(matrix, int) % 2
    n, m = s.shape
    left, inverse = np.eye(n, dtype=int), np.eye(n, dtype=int)
    s, row = s.copy(), 0
    for col in range(m):
        ones = np.flatnonzero(s[row:, col])
        if not len(ones):
            continue
        pivot = row + ones[0]
        s, left = swap_rows(row, pivot, s, left)
        (inverse,) = swap_columns(row, pivot, inverse)
        others = np.flatnonzero(s[:, col])
        for i in others[others != row]:
            s[i] ^= s[row]
            left[i] ^= left[row]
            inverse[:, row] ^= inverse[:, i]
        row += 1
        if row == n:
            break
    return left, s, inverse


def smith_normal_form_mod2(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """L, R, S, L inverse with L M R = S, whose 1s are the first places of the diagonal."""
    left, s, inverse = reduced_row_echelon_form_mod2(matrix)
    m = s.shape[1]
    right = np.eye(m, dtype=int)
    rank = int((s.any(1)).sum())
    for i in range(rank):
        pivot = int(np.flatnonzero(s[i])[0])
        s, right = swap_columns(i, pivot, s, right)
    for i in range(rank):
        for j in np.flatnonzero(s[i]):
            if j != i:
                s[:, j] ^= s[:, i]
                right[:, j] ^= right[:, i]
    return left, right, s, inverse


def rank_mod2(rows: Iterable[int]) -> int:
    """The rank of rows given as integers, a bit a column."""
    pivots: dict[int, int] = {}
    for row in rows:
        while row:
            top = row.bit_length()
            if top not in pivots:
                pivots[top] = row
                break
            row ^= pivots[top]
    return len(pivots)


def boundary_group(image_basis: Sequence[np.ndarray], most: int = MOST_IMAGE) -> list[np.ndarray]:
    """All sums mod 2 of a basis: 2 to the power of its length."""
    basis = [np.asarray(v, int) for v in image_basis]
    if len(basis) > most:
        raise SetGraphError(f"2**{len(basis)} elements")
    out = [np.zeros_like(basis[0])] if basis else []
    for v in basis:
        out += [(u + v) % 2 for u in out]
    return out


# -- homology -----------------------------------------------------------------------------------------------------


def dense_boundary(table: DataFrame, n_rows: int, n_cols: int, most: int = MOST_CELLS) -> np.ndarray:
    if max(n_rows, n_cols) > most:
        raise SetGraphError(f"{n_rows} x {n_cols} is too large for dense elimination")
    out = np.zeros((n_rows, n_cols), int)
    for r in table.toLocalIterator():
        out[r["row"], r["col"]] = 1
    return out


def _rank(table: DataFrame, most: int) -> int:
    """Elimination of columns; they come to the driver as lists of rows, up to `most`."""
    columns = bounded_rows(table.groupBy("col").agg(F.collect_list("row").alias("rows")), most, "columns of a boundary matrix")
    return rank_mod2(sum(1 << r for r in c["rows"]) for c in columns)


def betti(cells: dict, boundaries: dict, k: int | Sequence[int] | None = None, most: int = MOST_CELLS * 10) -> dict[int, int]:
    """Cells less the ranks of the boundaries from and to a dimension, for the dimensions of a chain complex."""
    wanted = [j for j in boundaries if j + 1 in boundaries and (k is None or j in ([k] if isinstance(k, int) else range(min(k), max(k) + 1)))]
    ranks = {j: _rank(boundaries[j], most) for j in {x for j in wanted for x in (j, j + 1)}}
    return {j: cells[j].count() - ranks[j] - ranks[j + 1] for j in wanted}


def betti_numbers(graph: HGraph, k: int | Sequence[int] | None = None) -> dict[int, int]:
    cells, boundaries = chain_complex(graph, k)
    return betti(cells, boundaries)


def _kernel(matrix: np.ndarray) -> np.ndarray:
    """Rows that span the vectors that the matrix takes to 0."""
    _, right, s, _ = smith_normal_form_mod2(matrix)
    return right[:, int(s.any(1).sum()) :].T


def homology_basis(lower: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cycles (rows) that with the boundaries span all cycles, none of them needless, and a basis of the boundaries.

    lower takes chains of the dimension to the one below, upper to it from the one above.
    """
    image: list[np.ndarray] = []
    pivots: dict[int, int] = {}

    def independent(v: np.ndarray) -> bool:
        row = int("".join(map(str, v)), 2) if len(v) else 0
        while row:
            top = row.bit_length()
            if top not in pivots:
                pivots[top] = row
                return True
            row ^= pivots[top]
        return False

    for v in upper.T:
        if independent(v):
            image.append(v)
    cycles = [v for v in _kernel(lower) if independent(v)]
    width = lower.shape[1]
    return np.array(cycles, int).reshape(-1, width), np.array(image, int).reshape(-1, width)


def hypergraph_homology_basis(graph: HGraph, k: int | Sequence[int] | None = None, shortest: bool = False, interpreted: bool = True) -> dict[int, list]:
    """By dimension a basis of homology as 0/1 vectors, or (interpreted) as lists of cells; shortest replaces each
    cycle by the member of its class with the fewest cells."""
    cells, boundaries = chain_complex(graph, k)
    names = {j: [tuple(r["cell"]) for r in bounded_rows(c.orderBy("idx"), MOST_CELLS, "cells")] for j, c in cells.items()}
    out = {}
    for j in [j for j in boundaries if j + 1 in boundaries]:
        lower = dense_boundary(boundaries[j], len(names[j - 1]), len(names[j]))
        upper = dense_boundary(boundaries[j + 1], len(names[j]), len(names[j + 1]))
        basis, image = homology_basis(lower, upper)
        if shortest and len(image):
            group = boundary_group(image)
            basis = np.array([min(((v + u) % 2 for u in group), key=lambda x: (x.sum(), x.tolist())) for v in basis], int).reshape(-1, len(names[j]))
        out[j] = interpret(names[j], basis) if interpreted else [v.tolist() for v in basis]
    return out


def interpret(cells: Sequence[tuple], vectors: Iterable[Sequence[int]], labels: dict | None = None) -> list[list[tuple]]:
    """The cells that each 0/1 vector has, with their nodes renamed by labels."""
    out = []
    for v in vectors:
        if len(v) != len(cells):
            raise SetGraphError("a vector and the cells have different lengths")
        found = [tuple(c) for c, x in zip(cells, v, strict=True) if x]
        out.append([tuple(labels[n] for n in c) for c in found] if labels else found)
    return out
