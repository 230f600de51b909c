"""Vector columns and blocked similarity search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-12) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def unit(a: Column) -> Column:
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(F.transform(a, lambda x: x.cast("double")))


def mean_vector(vector: str, dim: int) -> Column:
    """Element-wise mean as one aggregate per dimension: map-side combined, nothing exploded or collected."""
    return F.array(*[F.avg(F.col(vector)[i].cast("double")) for i in range(dim)])


def array_mean(vectors: Column) -> Column:
    """Element-wise mean of a short array of vectors."""
    n = F.size(vectors)
    total = F.aggregate(
        F.slice(vectors, 2, n), F.transform(vectors[0], lambda x: x.cast("double")),
        lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / n)


#: Vectors of the left side that a task holds at once, and rows of each side that meet in one matrix product.
LEFT_ROWS, PRODUCT = 16_384, 1_024


def best_matches(left: DataFrame, right: DataFrame, k: int, left_blocks: int = 8, right_blocks: int = 1,
                 skip_same: bool = False) -> DataFrame:
    """Exact top-k groups of `right(group_id, vec)` for every `left(id, vec)`, scored by the best vector of a group.

    Both sides are hashed into blocks, and each pair of blocks is a tile: its left block is held, its right block read sorted by group, as
    a stream, in matrix products of bounded size.  There are as many left blocks as `LEFT_ROWS` ask for, so what a task holds does not
    grow with the tables; it emits at most k rows per left vector, and pairs are never materialised.  Rows without a vector match nothing.
    """
    left, right = left.filter("vec IS NOT NULL"), right.filter("vec IS NOT NULL")
    left_blocks = max(left_blocks, -(-left.count() // LEFT_ROWS))
    id_type, group_type = left.schema["id"].dataType, right.schema["group_id"].dataType
    lefts = left.select(
        F.pmod(F.xxhash64("id"), F.lit(left_blocks)).alias("lb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(right_blocks - 1).cast("long"))).alias("rb"),
        F.lit(0).alias("side"), "id", F.lit(None).cast(group_type).alias("group_id"), "vec")
    rights = right.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(left_blocks - 1).cast("long"))).alias("lb"), F.pmod(F.xxhash64("group_id"), F.lit(right_blocks)).alias("rb"),
        F.lit(1).alias("side"), F.lit(None).cast(id_type).alias("id"), "group_id", "vec")
    schema = T.StructType([T.StructField("id", id_type), T.StructField("group_id", group_type), T.StructField("score", T.DoubleType())])

    def run(batches):
        tile, best = None, None
        for batch in batches:
            key = batch.column(0).to_numpy() * right_blocks + batch.column(1).to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (np.diff(batch.column(2).to_numpy()) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if hi == lo:
                    continue
                rows = batch.slice(lo, hi - lo)
                if key[lo] != tile:
                    if best is not None:
                        yield from best.out()
                    tile, best = key[lo], BestGroups(k, skip_same)
                for at in range(0, rows.num_rows, PRODUCT):
                    part = rows.slice(at, PRODUCT)
                    vecs = part.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    (best.hold if rows.column(2)[0].as_py() == 0 else best.meet)(part.column(3), part.column(4), vecs)
        if best is not None:
            yield from best.out()

    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = lefts.unionByName(rights).repartition(width, "lb", "rb").sortWithinPartitions("lb", "rb", "side", "group_id")
    order = Window.partitionBy("id").orderBy(F.desc("score"), "group_id")
    return tiles.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class BestGroups:
    """The k best groups so far of every left vector of a tile; the group that is being read goes on with the next rows."""

    def __init__(self, k: int, skip_same: bool):
        self.k, self.skip_same = k, skip_same
        self.ids, self.vecs, self.blocks = [], [], None
        self.groups: list = []  # of all groups that stand in a top list, by their number there

    def hold(self, ids: pa.Array, _, vecs: np.ndarray) -> None:
        self.ids.append(ids)
        self.vecs.append(vecs)

    def start(self) -> None:
        n = sum(map(len, self.vecs))
        self.score, self.at = np.full((n, self.k), -np.inf), np.full((n, self.k), -1)
        self.open, self.running = None, np.full(n, -np.inf)
        self.blocks = np.cumsum([0, *map(len, self.vecs)])
        self.rows_of: dict = {}
        if self.skip_same:
            for row, name in enumerate(i for part in self.ids for i in part.to_pylist()):
                self.rows_of.setdefault(name, []).append(row)

    def meet(self, _, groups: pa.Array, vecs: np.ndarray) -> None:
        if not self.vecs:
            return
        if self.blocks is None:
            self.start()
        names = groups.to_pylist()
        first = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
        if self.open is not None and self.groups[self.open] != names[0]:
            self.close()
        self.kind = groups.type
        number = np.arange(len(first)) + len(self.groups)
        if self.open is not None:
            number -= 1
        self.groups += [names[i] for i in first[self.open is not None :]]
        for at, part in enumerate(self.vecs):
            rows = slice(int(self.blocks[at]), int(self.blocks[at + 1]))
            best = np.maximum.reduceat(part @ vecs.T, first, axis=1)
            if self.open is not None:
                best[:, 0] = np.maximum(best[:, 0], self.running[rows])
            self.running[rows] = best[:, -1]
            self.rank(rows, best[:, :-1], number[:-1])
        self.open = int(number[-1])
        if len(self.groups) > 4 * PRODUCT:
            self.forget()

    def close(self) -> None:
        for at in range(len(self.vecs)):
            rows = slice(int(self.blocks[at]), int(self.blocks[at + 1]))
            self.rank(rows, self.running[rows][:, None], np.array([self.open]))
        self.open = None

    def rank(self, rows: slice, best: np.ndarray, number: np.ndarray) -> None:
        """Merge whole groups into the top lists; of equal scores the earlier group stays."""
        if not len(number):
            return
        best = np.round(best, 6)
        best[np.isnan(best)] = -np.inf
        if self.skip_same:
            for column, name in enumerate(self.groups[i] for i in number.tolist()):
                for row in self.rows_of.get(name, ()):
                    if rows.start <= row < rows.stop:
                        best[row - rows.start, column] = -np.inf
        better = np.flatnonzero((best > self.score[rows, -1][:, None]).any(axis=1))
        if not len(better):
            return
        best, rows = best[better], better + rows.start
        score = np.concatenate([self.score[rows], best], axis=1)
        at = np.concatenate([self.at[rows], np.broadcast_to(number, best.shape)], axis=1)
        order = np.argsort(-score, axis=1, kind="stable")[:, : self.k]
        self.score[rows], self.at[rows] = np.take_along_axis(score, order, axis=1), np.take_along_axis(at, order, axis=1)

    def forget(self) -> None:
        """Drop the names of groups that stand in no list."""
        used = np.unique(np.append(self.at[self.at >= 0], self.open))
        self.groups = [self.groups[i] for i in used.tolist()]
        self.at = np.where(self.at >= 0, np.searchsorted(used, self.at), -1)
        self.open = int(np.searchsorted(used, self.open))

    def out(self):
        if self.blocks is None:
            return
        self.close()
        ids = pa.chunked_array(self.ids).combine_chunks()
        for lo in range(0, len(self.at), PRODUCT):
            score, at = self.score[lo : lo + PRODUCT], self.at[lo : lo + PRODUCT]
            keep = np.isfinite(score)
            which = np.nonzero(keep)[0] + lo
            names = pa.array([self.groups[i] for i in at[keep].tolist()], self.kind)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(which)), names, pa.array(score[keep])], names=["id", "group_id", "score"])
