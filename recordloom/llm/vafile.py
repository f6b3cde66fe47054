"""Operator 3: exact top-k by inner product with vector-approximation files.

Index. Each component of a vector is kept as a cell number of CELL_BITS bits. Cells, with the ids, are written to files of FILE_ROWS vectors at most, and the exact vectors to files beside them, in the
same order. Of equal vectors the index keeps those of the k + 1 least ids, as no query can have others among its k best.

Search. Queries are dealt in blocks, and the files in bands; each pair of a block and a band is a task that reads files by itself. The first scan looks at cells only: the corners of a cell bound the
score of a query and a vector from both sides, and the k-th best lower bound of all bands is what a vector's upper bound must reach. The second scan keeps those that do, and reads their exact components by ranges
of the file, in the order of the upper bounds, until the next upper bound is below the k-th best score read. So what is shuffled is k bounds and k results for each query and band, and no vector but the queries.
A stated set of queries against all rows, both in blocks of bounded size.

Results. Vectors are compared with queries of the same length. Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id.
Ties go to the smaller id; rows that repeat an id are candidates each, but never of a query with that id; queries that repeat an id and a vector count once. Bounds and scores are exact whatever the components: beyond 2**53
they are computed with Python's integers; a score that no long can hold raises OverflowError. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import open_input, write_bytes
from .shared import shared_folder, shuffle_partitions, written

MAGIC = b"RLVA0001"
#: Queries of a block; vectors and components of a file, and vectors of the part of it that is scanned at a time; bits of a cell number; vectors read exactly at a time for a query; pairs of a query and a vector whose upper bounds a task holds.
BLOCK_QUERIES, FILE_ROWS, FILE_VALUES, SCAN_ROWS, CELL_BITS, READ_ROWS, PAIRS = 1024, 65_536, 1 << 22, 4096, 5, 64, 4_000_000


def cells_of(rows: np.ndarray, bits: int = CELL_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells): component j of a row lies in [low[j] + cell * width[j], that + width[j])."""
    low, high = rows.min(0), rows.max(0)
    width = np.array([max(1, -(-(int(b) - int(a) + 1) // (1 << bits))) for a, b in zip(low, high)], np.int64)
    return low, width, np.stack([(rows[:, j].astype(object) - int(low[j])) // int(width[j]) if width[j] > 1 << 53 else (rows[:, j] - low[j]) // width[j] for j in range(rows.shape[1])], 1).astype(np.uint8 if bits <= 8 else np.uint32)


def _exact(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> type:
    """The kind of numbers in which sums of products are exact."""
    most = lambda x: max((abs(int(v)) for v in (x.min(initial=0), x.max(initial=0))), default=0)
    return np.float64 if queries.shape[1] * max(most(queries), 1) * (max(most(low), most(high)) + 1) < 1 << 53 else object


def bounds(queries: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score of each query with each row."""
    kind = _exact(queries, low, low + (cells.max(0, initial=0).astype(np.int64) + 1) * width)
    q = queries.astype(kind)
    least = q @ (low.astype(kind) + cells.astype(kind) * width.astype(kind)).T
    reach = (width - 1).astype(kind)
    return least + (np.minimum(q, 0) @ reach)[:, None], least + (np.maximum(q, 0) @ reach)[:, None]


class Cells:
    """One file of cells, read whole."""

    def __init__(self, path: str):
        self.path = path
        with open_input(f"{path}.cells") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError("not a file of cells")
        self.dim, self.n, self.size = struct.unpack_from("<III", data, 8)
        at = 20
        self.low, self.width, self.ids = np.frombuffer(data, "<i8", self.dim, at), np.frombuffer(data, "<i8", self.dim, at + 8 * self.dim), np.frombuffer(data, "<i8", self.n, at + 16 * self.dim)
        self.cells = np.frombuffer(data, np.uint8, offset=at + 16 * self.dim + 8 * self.n).reshape(self.n, self.dim)

    def parts(self):
        for a in range(0, self.n, SCAN_ROWS):
            yield a, self.ids[a : a + SCAN_ROWS], self.cells[a : a + SCAN_ROWS]


def exact_rows(path: str, dim: int, size: int, rows: np.ndarray) -> np.ndarray:
    """The exact vectors of sorted row numbers: neighbours are one read."""
    step = dim * size
    cuts = np.flatnonzero(np.diff(rows) != 1) + 1
    with open_input(f"{path}.exact") as f:
        parts = []
        for run in np.split(rows, cuts):
            f.seek(int(run[0]) * step)
            parts.append(f.read(len(run) * step))
    return np.frombuffer(b"".join(parts), f"<i{size}").reshape(-1, dim).astype(np.int64)


def write_index(vectors: DataFrame, folder: str, bits: int = CELL_BITS, file_rows: int = FILE_ROWS) -> DataFrame:
    """Write (vec_id, v, dim) to files and return their manifest: path, dim, n."""

    def run(batches):
        held: dict[int, list] = {}  # of each length: arrays of ids and rows

        def closed(dim: int, ids: np.ndarray, rows: np.ndarray):
            low, width, cells = cells_of(rows, bits)
            size = next(s for s in (1, 2, 4, 8) if -(1 << (8 * s - 1)) <= rows.min() and rows.max() < 1 << (8 * s - 1))
            path = f"{folder}/{uuid.uuid4().hex}"
            write_bytes(f"{path}.exact", [rows.astype(f"<i{size}").tobytes()])
            write_bytes(f"{path}.cells", [MAGIC + struct.pack("<III", dim, len(ids), size), low.astype("<i8").tobytes(), width.astype("<i8").tobytes(), ids.astype("<i8").tobytes(), cells.tobytes()])
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int64())], ["path", "dim", "n"])

        for b in batches:
            ids, lists = b.column(0).to_numpy(), b.column(1)
            values, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            sizes = np.diff(starts)
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                held.setdefault(dim, []).append((ids[own], values[starts[own][:, None] + np.arange(dim)]))
                most = max(1, min(file_rows, FILE_VALUES // dim))
                if sum(len(i) for i, _ in held[dim]) >= most:
                    i, r = (np.concatenate(x) for x in zip(*held[dim]))
                    whole = len(i) // most * most
                    for k in range(0, whole, most):
                        yield closed(dim, i[k : k + most], r[k : k + most])
                    held[dim] = [(i[whole:], r[whole:])]
        for dim, parts in held.items():
            i, r = (np.concatenate(x) for x in zip(*parts))
            if len(i):
                yield closed(dim, i, r)

    return written(vectors.select("vec_id", "v").mapInArrow(run, "path string, dim int, n long"), "manifest")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k greatest of each row, the least of them first; fewer are filled with -inf."""
    if scores.shape[1] < k:
        scores = np.concatenate([np.full((len(scores), k - scores.shape[1]), -np.inf, scores.dtype), scores], 1)
    return np.sort(scores if scores.dtype == object else np.partition(scores, -k, axis=1)[:, -k:], axis=1)[:, -k:]


def scan(queries: np.ndarray, ids: np.ndarray, files: list[str], k: int) -> np.ndarray:
    """The k greatest lower bounds of each query over the files' cells."""
    best = np.full((len(queries), k), -np.inf)
    for path in files:
        own = Cells(path)
        for _, row_ids, cells in own.parts():
            low = bounds(queries, own.low, own.width, cells)[0]
            low[ids[:, None] == row_ids[None, :]] = -np.inf
            best = _best(np.concatenate([best, low], 1), k)
    return best


def search(queries: np.ndarray, ids: np.ndarray, least: np.ndarray, files: list[str], k: int, pairs: int = PAIRS) -> tuple[list[tuple], np.ndarray]:
    """(query index, vec_id, score) of each query's k best in the files, and how many vectors were read exactly for it. ``least`` is what an upper bound must reach; it rises with the scores read.
    The cells of one file are open at a time; what stays of it are the rows whose upper bounds reach ``least``, ``pairs`` of them and those of one part of a file at most."""
    own, least = [], least.copy()  # of each file: path, length of vectors, bytes of a component
    best: list[list[tuple]] = [[] for _ in queries]  # (-score, vec_id)
    read = np.zeros(len(queries), np.int64)

    def settle(held: list[tuple]) -> None:
        """Read the exact vectors of (query, file, row, upper bound, vec_id): in rounds, the next of all open queries, file by file."""
        found, numbers, rows, tops, vec_ids = (np.concatenate(x) for x in zip(*held))
        order = {}
        for q, n, r, t, v in _split(found, numbers, rows, tops, vec_ids):
            by_top = np.argsort(-t, kind="stable")
            order[q] = n[by_top], r[by_top], t[by_top], v[by_top]
        at = dict.fromkeys(order, 0)
        while open_ := [q for q, i in at.items() if i < len(order[q][0]) and not (len(best[q]) == k and order[q][2][i] < -best[q][-1][0])]:
            wanted: dict[int, list] = {}
            for q in open_:
                for n, r, v in _split(*(order[q][k][at[q] : at[q] + READ_ROWS] for k in (0, 1, 3))):
                    wanted.setdefault(n, []).append((q, r, v))
                    read[q] += len(r)
                at[q] += READ_ROWS
            for n, asked in wanted.items():
                rows = np.unique(np.concatenate([r for _, r, _ in asked]))
                exact = exact_rows(*own[n], rows)
                kind = _exact(queries, exact, exact)
                for q, r, v in asked:
                    scores = exact[np.searchsorted(rows, r)].astype(kind) @ queries[q].astype(kind)
                    best[q] += [(-int(s), i) for s, i in zip(scores.tolist(), v.tolist())]
            for q in open_:
                best[q] = sorted(best[q])[:k]
        for q in order:
            if len(best[q]) == k:
                least[q] = max(least[q], -best[q][-1][0])

    held, size = [], 0
    for number, path in enumerate(files):
        f = Cells(path)
        own.append((path, f.dim, f.size))
        for start, row_ids, cells in f.parts():
            high = bounds(queries, f.low, f.width, cells)[1]
            at = np.nonzero((high >= least[:, None]) & (ids[:, None] != row_ids[None, :]))
            held.append((at[0], np.full(len(at[0]), number), at[1] + start, high[at], row_ids[at[1]]))
            size += len(at[0])
            if size >= pairs:
                settle(held)
                held, size = [], 0
    if held:
        settle(held)
    return [(q, i, -s) for q, own_best in enumerate(best) for s, i in own_best], read


def _split(keys: np.ndarray, *values: np.ndarray):
    """(key, values) of each key."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for part in zip(np.split(keys, cuts), *(np.split(v[order], cuts) for v in values)):
            yield int(part[0][0]), *part[1:]


def results(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block_queries: int = BLOCK_QUERIES, file_rows: int = FILE_ROWS, bits: int = CELL_BITS) -> DataFrame:
    """query_id, query, vec_id, score of each band's k best; and a row without vec_id for each query and band: n_read (vectors read exactly) and n_scanned."""
    spark = vectors.sparkSession
    comps = F.transform(F.col("embedding"), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), comps.alias("v"))
    rows = src.groupBy("v", "vec_id").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    rows = rows.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    folder = f"{shared_folder(spark)}/vectors"
    files = write_index(rows, folder, bits, file_rows)
    queries = written(src.where(F.col("vec_id") % every == 0).distinct().select("vec_id", "v", F.size("v").alias("dim"), F.xxhash64("vec_id", "v").alias("query")), "queries")
    tasks = shuffle_partitions(spark)
    n_blocks = max(1, -(-queries.count() // block_queries))
    n_bands = max(1, min(files.count(), -(-4 * tasks // n_blocks)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["block", "band", "dim"]

    def dealt(q: DataFrame):
        left = q.withColumn("block", F.pmod(F.hash("query"), F.lit(n_blocks))).withColumn("band", each(n_bands)).repartition(tasks, *keys)
        right = files.withColumn("band", F.pmod(F.hash("path"), F.lit(n_bands))).withColumn("block", each(n_blocks)).repartition(tasks, *keys)
        return left.groupBy(*keys).cogroup(right.groupBy(*keys))

    def taken(left: pa.Table, right: pa.Table):
        return np.array(left["v"].to_pylist(), np.int64), left["vec_id"].to_numpy(), right["path"].to_pylist()

    def lows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "lows": pa.array([], pa.list_(pa.int64()))})
        best = scan(*taken(left, right), k)
        return pa.table({"query": left["query"], "lows": pa.array([[int(x) for x in row if x > -np.inf] for row in best], pa.list_(pa.int64()))})

    least = dealt(queries).applyInArrow(lows, "query long, lows array<long>").groupBy("query").agg(F.sort_array(F.flatten(F.collect_list("lows")), False).alias("lows"))
    least = written(least.select("query", F.get("lows", F.lit(k - 1)).alias("least")), "least")

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"query_id": pa.int64(), "query": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "n_read": pa.int64(), "n_scanned": pa.int64()}
        if not left.num_rows or not right.num_rows:
            return pa.schema(list(kinds.items())).empty_table()
        q, ids, paths = taken(left, right)
        bound = np.array([-np.inf if x is None else x for x in left["least"].to_pylist()], object if any(abs(x or 0) >= 1 << 53 for x in left["least"].to_pylist()) else np.float64)
        found, done = search(q, ids, bound, paths, k)
        key = left["query"].to_pylist()
        rows = [(int(ids[i]), key[i], vec, score, None, None) for i, vec, score in found] + [(int(ids[i]), key[i], None, None, int(n), sum(right["n"].to_pylist())) for i, n in enumerate(done)]
        return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), zip(*rows))})

    return dealt(queries.join(least, "query", "left")).applyInArrow(exact, "query_id long, query long, vec_id long, score long, n_read long, n_scanned long")


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best; queries are the rows whose id is divisible by ``every``."""
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    best = results(vectors, k, every, scale, **sizes).where("vec_id is not null")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
