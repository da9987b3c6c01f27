"""Problem 6: the most similar vectors for every vector, by additive quantisation.

An index is fitted on a bounded sample: coarse cells, whose number grows with the
vectors (k-means, and a second residual level for more cells than the sample can
fit), then full-dimensional residual codebooks whose words
are added up.  Every vector is encoded by beam search, lies in the cell nearest
to it and queries its nearest cells; there it is scored against all members by
look-up tables of its products with the codewords and the members' stored
norms, and the best are reranked with the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelode.operators.dedupe import distinct_rows
from sitelode.session import broadcast_if_small, materialised

DIM, NEIGHBOURS = 64, 5
#: Rows that the index is fitted on (every row is indexed), and rounds of k-means.
SAMPLE_ROWS, ROUNDS = 50_000, 8
#: Vectors of a cell on average; sample rows that a centre of the first level needs.
CELL_ROWS, CENTRE_ROWS = 256, 8
#: Additive codebooks, codewords in each, partial sums kept by the beam.
BOOKS, WORDS, BEAM = 8, 256, 2
#: Cells that each vector searches (twice as many where cells have two levels); candidates of a cell that are reranked.
PROBES, RERANK = 4, 160
#: Members of a cell that are scored at once; queries of a block in one task.
BLOCK, BLOCK_QUERIES = 2_048, 65_536


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of ``x``; empty ones are put on the rows farthest from theirs."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, cost = _nearest(x, centres)
        order = np.argsort(near, kind="stable")
        there, begin = np.unique(near[order], return_index=True)
        centres[there] = np.add.reduceat(x[order], begin) / np.diff(np.append(begin, len(x)))[:, None].astype(np.float32)
        empty = np.setdiff1d(np.arange(k), there)
        if len(empty):
            centres[empty] = x[np.argsort(cost)[: len(empty)]]
    return centres.astype(np.float32)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and how well it fits (greater is nearer)."""
    best, fits = [], []
    half = 0.5 * (centres**2).sum(1)
    for at in range(0, len(x), 4096):  # bounded memory
        part = x[at : at + 4096]
        score = part @ centres.T - half
        best.append(score.argmax(1))
        fits.append(score[np.arange(len(part)), best[-1]] - 0.5 * (part**2).sum(1))
    return np.concatenate(best), np.concatenate(fits)


@dataclass
class Index:
    """Coarse cells ``first[i] + second[j]`` (number i * len(second) + j) and codebooks."""

    first: np.ndarray
    second: np.ndarray
    books: np.ndarray  # BOOKS x WORDS x dim

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest cells of each row, nearest first."""
        probes = min(probes, len(self.first) * len(self.second))
        one = x @ self.first.T - 0.5 * (self.first**2).sum(1)
        wide = min(len(self.first), max(probes, 8))
        top = np.argpartition(-one, wide - 1, axis=1)[:, :wide]
        two = x @ self.second.T - 0.5 * (self.second**2).sum(1)
        cross = self.first @ self.second.T
        rows = np.arange(len(x))[:, None]
        score = (one[rows, top][:, :, None] + two[:, None, :] - cross[top]).reshape(len(x), -1)
        probes = min(probes, score.shape[1])
        best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
        best = np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)
        k = len(self.second)
        return top[rows, best // k] * k + best % k

    def centre(self, cell: np.ndarray) -> np.ndarray:
        k = len(self.second)
        return self.first[cell // k] + self.second[cell % k]

    def encode(self, x: np.ndarray, cell: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes of each row by beam search, and the squared norm of what they stand for.

        The loss of a partial sum grows, with each added word w, by
        w.w - 2 x.w + 2 (words so far).w: products that are tabulated once.
        """
        books, words, dim = self.books.shape
        flat = self.books.reshape(-1, dim)
        gram = flat @ flat.T
        codes_out, norm_out = [], []
        for at in range(0, len(x), 1024):
            rest = x[at : at + 1024] - self.centre(cell[at : at + 1024])
            n = len(rest)
            rows = np.arange(n)[:, None]
            gain = np.diag(gram) - 2 * (rest @ flat.T)
            loss = np.zeros((n, 1), np.float32)
            codes = np.zeros((n, 1, 0), np.int64)
            for m in range(books):
                own = slice(m * words, (m + 1) * words)
                step = loss[:, :, None] + gain[:, None, own]
                for j in range(m):
                    step = step + 2 * gram[:, own][codes[:, :, j]]
                flatter = step.reshape(n, -1)
                keep = min(beam, flatter.shape[1])
                best = np.argpartition(flatter, keep - 1, axis=1)[:, :keep]
                loss = flatter[rows, best]
                old = best // words
                codes = np.concatenate([codes[rows, old], (best % words + m * words)[:, :, None]], 2)
            mine = codes[np.arange(n), loss.argmin(1)]
            made = self.centre(cell[at : at + 1024]) + flat[mine].sum(1)
            codes_out.append((mine - np.arange(books) * words).astype(np.uint8))
            norm_out.append((made**2).sum(1).astype(np.float32))
        if not codes_out:
            return np.zeros((0, books), np.uint8), np.zeros(0, np.float32)
        return np.concatenate(codes_out), np.concatenate(norm_out)


def fit_index(sample: np.ndarray, rows: int, seed: int = 11) -> Index:
    """An index for ``rows`` vectors from a sample of them."""
    rng = np.random.default_rng(seed)
    cells = max(1, round(rows / CELL_ROWS))
    first = _kmeans(sample, min(cells, max(1, len(sample) // CENTRE_ROWS)), rng)
    rest = sample - first[_nearest(sample, first)[0]]
    second = np.zeros((1, sample.shape[1]), np.float32)
    if cells > len(first) and len(sample) > CENTRE_ROWS:
        second = _kmeans(rest, min(-(-cells // len(first)), len(sample) // CENTRE_ROWS), rng)
        rest = rest - second[_nearest(rest, second)[0]]
    books = []
    for _ in range(BOOKS):
        book = _kmeans(rest, WORDS, rng)
        if len(book) < WORDS:
            book = np.concatenate([book, np.zeros((WORDS - len(book), sample.shape[1]), np.float32)])
        rest = rest - book[_nearest(rest, book)[0]]
        books.append(book)
    return Index(first, second, np.stack(books))


def unit_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int = DIM) -> DataFrame:
    """``(id, same, v)``: the usable vectors as float32 bytes of length 1, one row per id.

    ``vector_col`` is a JSON array of ``dim`` finite numbers, not all zero; other
    rows (null, broken JSON, another length, a null or non-finite element) are
    left out.  ``same`` is the MD5 of the vector.
    """
    own = distinct_rows(df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("json")), "id")
    parsed = own.select("id", F.from_json("json", "array<double>").alias("v")).filter(F.size("v") == dim)

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.array([np.asarray(v, np.float64) for v in batch["v"]]).reshape(-1, dim)
            most = np.abs(x).max(1)
            good = np.isfinite(x).all(1) & (most > 0)
            if not good.any():
                continue
            x = x[good] / most[good][:, None]  # squares of very large or small numbers stay in range
            x = (x / np.sqrt((x**2).sum(1))[:, None]).astype(np.float32)
            raw = [r.tobytes() for r in x]
            yield pd.DataFrame({"id": batch["id"].to_numpy()[good], "v": raw})

    return parsed.mapInPandas(scale, "id long, v binary").select("id", F.md5("v").alias("same"), "v")


def _matrix(column: pd.Series, dtype: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype).reshape(len(column), -1)


def _search(index: Index, k: int, rerank: int):
    """Streams blocks: their members first (kind 0), then their queries, sorted so."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: tuple | None = None
        parts: list[pd.DataFrame] = []
        members: tuple | None = None
        flat = index.books.reshape(-1, index.books.shape[2])
        words = index.books.shape[1]
        for batch in batches:
            for key, rows in batch.groupby(["cell", "block", "salt"], sort=False):
                if key != block:
                    block, parts, members = key, [], None
                own = rows[rows["kind"] == 0]
                if len(own):
                    parts.append(own[["id", "v", "codes", "norm"]])
                    members = None
                asks = rows[rows["kind"] == 1]
                if not len(asks) or not parts:
                    continue
                if members is None:
                    m = pd.concat(parts)
                    members = m["id"].to_numpy(), _matrix(m["v"]), _matrix(m["codes"], np.uint8), m["norm"].to_numpy(np.float32)
                ids, vectors, codes, norms = members
                for at in range(0, len(asks), 1024):
                    some = asks.iloc[at : at + 1024]
                    qid = some["id"].to_numpy()
                    q = _matrix(some["v"], np.int16) * (some["norm"].to_numpy(np.float32)[:, None])
                    table = (q @ flat.T).reshape(len(q), -1, words)
                    score = -0.5 * norms + q @ index.centre(np.array([key[0]])).T
                    for m in range(table.shape[1]):
                        score = score + table[:, m][:, codes[:, m]]
                    r = min(rerank, len(ids))
                    cand = np.argpartition(-score, r - 1, axis=1)[:, :r]
                    exact = np.matmul(vectors[cand], q[:, :, None])[:, :, 0].round(6)
                    exact[ids[cand] == qid[:, None]] = -9
                    order = np.lexsort((ids[cand], -exact), axis=1)[:, :k]
                    near, best = np.take_along_axis(ids[cand], order, 1), np.take_along_axis(exact, order, 1)
                    ok = best > -9
                    yield pd.DataFrame({
                        "id": np.repeat(qid, ok.sum(1)), "near": near[ok], "score": best[ok].astype(np.float32),
                    })

    return run


def nearest_neighbours(
    df: DataFrame,
    id_col: str = "id",
    vector_col: str = "embedding",
    k: int = NEIGHBOURS,
    dim: int = DIM,
    probes: int = PROBES,
    rerank: int = RERANK,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``(id, near, score)``: the ``k`` vectors most similar to each by cosine.

    Ties go to the smaller id.  Equal vectors are searched once: only the least
    id of a class of copies is indexed, and its neighbours are then taken for
    every copy, from at most ``k + 1`` ids a class.  A cell with more than BLOCK
    members, or a block with more than BLOCK_QUERIES queries, is split, so no
    task holds an unbounded group.  Queries travel as 16-bit fixed-point numbers
    (error of a cosine about 2e-6).

    The result is approximate: a neighbour is missed where its cell is not among
    the ``probes`` nearest or its estimate not among the best ``rerank`` of the
    cell.  With both at least the number of vectors it is exact but for the rounding below.

    Unusable vectors (see :func:`unit_vectors`) take no part.  Repeated rows
    count once.  Fewer than ``k`` others: all of them.  Empty table: empty
    result.  Other columns are ignored.
    """
    vectors = materialised(unit_vectors(df, id_col, vector_col, dim))
    by_id = Window.partitionBy("same").orderBy("id")
    first = vectors.select("same", "id").withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    classes = materialised(
        first.groupBy("same").agg(F.sort_array(F.collect_list("id")).alias("ids")).filter(F.size("ids") > 1)
    )
    heads = broadcast_if_small(classes.select("same", F.get("ids", F.lit(0)).alias("head")), 24)
    kept = vectors.join(heads, "same", "left").filter("head is null or head = id").select("id", "v")
    rows = vectors.count()
    # By a threshold of a hash, so that what reaches the driver doesn't grow with the partitions.
    bins = 1 << 30
    drawn = vectors.select("v").filter(F.pmod(F.xxhash64("id"), F.lit(bins)) < min(bins, round(bins * sample_rows / max(rows, 1))))
    sample = drawn.limit(sample_rows).collect()
    if rows and not sample:
        sample = vectors.select("v").limit(sample_rows).collect()
    if not sample:
        return vectors.select("id", F.col("id").alias("near"), F.lit(0.0).cast("float").alias("score")).limit(0)
    index = fit_index(np.stack([np.frombuffer(r["v"], np.float32) for r in sample]), rows)
    probes *= 1 if len(index.second) == 1 else 2

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = _matrix(batch["v"])
            cells = index.cells(x, probes)
            codes, norms = index.encode(x, cells[:, 0])
            step = (np.abs(x).max(1) / 32767).astype(np.float32)
            short = [r.tobytes() for r in np.rint(x / step[:, None]).astype(np.int16)]
            ids = batch["id"].to_numpy()
            many = cells.shape[1]
            yield pd.DataFrame({
                "cell": cells[:, 0], "kind": np.int8(0), "id": ids, "v": batch["v"].to_numpy(),
                "codes": [r.tobytes() for r in codes], "norm": norms,
            })
            yield pd.DataFrame({
                "cell": cells.ravel(), "kind": np.int8(1), "id": np.repeat(ids, many),
                "v": np.repeat(np.array(short, dtype=object), many), "codes": None, "norm": np.repeat(step, many),
            })

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells = index.cells(_matrix(batch["v"]), probes)
                asked, asks = np.unique(cells, return_counts=True)
                own = pd.Series(cells[:, 0]).value_counts().reindex(asked, fill_value=0).to_numpy()
                yield pd.DataFrame({"cell": asked, "own": own, "asks": asks})

    spread = kept.mapInPandas(assign, "cell long, kind byte, id long, v binary, codes binary, norm float")
    sizes = kept.select("v").mapInPandas(count, "cell long, own long, asks long").groupBy("cell").agg(
        F.ceil(F.sum("own") / BLOCK).cast("int").alias("blocks"),
        F.ceil(F.sum("asks") / BLOCK_QUERIES).cast("int").alias("salts"),
    )
    # Only cells that must be split; there is at most one for BLOCK rows.
    large = broadcast_if_small(materialised(sizes.filter("blocks > 1 or salts > 1")), 32)
    own = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    placed = spread.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "salts", F.coalesce("salts", F.lit(1))
    )
    upto = lambda c: F.sequence(F.lit(0), F.greatest(F.col(c), F.lit(1)) - 1)
    is_member = F.col("kind") == 0
    placed = placed.withColumn(
        "block", F.explode(F.when(is_member, F.array((own % F.greatest("blocks", F.lit(1))).cast("int"))).otherwise(upto("blocks")))
    ).withColumn(
        "salt", F.explode(F.when(is_member, upto("salts")).otherwise(F.array((own % F.greatest("salts", F.lit(1))).cast("int"))))
    )
    found = (
        placed.select("cell", "block", "salt", "kind", "id", "v", "codes", "norm")
        .repartition("cell", "block", "salt")
        .sortWithinPartitions("cell", "block", "salt", "kind")
        .mapInPandas(_search(index, k, rerank), "id long, near long, score float")
    )
    best = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    heads_only = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("id", "near", "score")
    return _with_copies(materialised(heads_only), vectors, classes, k)


def _with_copies(found: DataFrame, vectors: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """The neighbours of every vector, copies too, from those of each class's least id."""
    many = broadcast_if_small(classes.select(F.get("ids", F.lit(0)).alias("head"), "ids"), 32 + 8 * k)
    near = found.join(many.withColumnRenamed("head", "near"), "near", "left").select(
        "id", F.explode(F.coalesce("ids", F.array("near"))).alias("near"), "score"
    )
    copies = vectors.join(broadcast_if_small(classes, 32 + 8 * k), "same").select("id", F.get("ids", F.lit(0)).alias("head"), "ids")
    others = copies.join(near.withColumnRenamed("id", "head"), "head").select("id", "near", "score")
    twins = copies.select("id", F.explode("ids").alias("near"), F.lit(1.0).cast("float").alias("score")).filter("id <> near")
    lone = near.join(broadcast_if_small(classes.select(F.get("ids", F.lit(0)).alias("id")), 16), "id", "left_anti")
    best = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    every = lone.unionByName(others).unionByName(twins)
    return every.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("id", "near", "score")


def neighbour_pairs(df: DataFrame, **options) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: pairs of which one is among the nearest of the other."""
    near = nearest_neighbours(df, **options)
    return near.select(F.least("id", "near").alias("id_a"), F.greatest("id", "near").alias("id_b")).distinct()
