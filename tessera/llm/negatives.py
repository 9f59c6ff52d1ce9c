"""Hard-negative mining by Kronecker-packed products.

Vectors are quantised to integers, floor(scale * x).  Component k of all the candidates of a block, biased to be
non-negative, stands in separate fields of one wide integer.  An anchor multiplies each of these integers once by its own
(biased) component and adds the products: every field of the sum is one candidate's biased inner product, and a
correction by the component sums gives the exact score.  The fields are as wide as the largest sum needs, so no score is
ever rounded, whatever the size of the components.

1. ``blocks``: rows in label order are packed into blocks of candidates; anchors into groups of the same kind.
2. Positives: blocks meet the groups with which they share a label; each anchor keeps its best rows of the same label.
3. Negatives: every block meets every group (a stated query set against all rows, in blocks); each positive keeps the best
   rows of other labels whose score lies in its range.

A task keeps the best rows of an anchor over its blocks, so what leaves it is bounded by anchors x kept rows; the last
choice is a window limited to the kept rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import arrow_rows, drop_staged, release, staged

# Rows of a block of candidates and of a group of anchors: a cell is one block against one group.
BLOCK_ROWS = 2048
GROUP_ROWS = 512
# Cells of a task, so that a task's answer for an anchor covers several blocks.
RUN = 8
_NO_ID = (1 << 63) - 1  # a null id stands after every other


# ------------------------------------------------------------------------------------------------------- packed products

def quantised(rows: list, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors as an integer matrix, missing components 0; Python integers where 64 bits are too few."""
    width = max((len(r) for r in rows), default=0)
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, :len(r)] = r
    x = np.floor(x * scale)
    most = np.abs(x).max(initial=0)
    if most < 2.0 ** 62:
        return x.astype(next(t for t, bits in ((np.int16, 15), (np.int32, 31), (np.int64, 62)) if most < 2.0 ** bits))
    return np.array([[int(v) for v in r] for r in x.tolist()], dtype=object).reshape(x.shape)


class Packed:
    """A block of candidates whose components stand in the fields of wide integers."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        """``anchors`` (rows of all anchors that will be scored) decide the bias and the width of the fields."""
        self.n, self.dims = len(candidates), min(candidates.shape[1], anchors.shape[1])
        c, a = candidates[:, :self.dims], anchors[:, :self.dims]
        ends = lambda m: (min(0, int(m.min())), max(0, int(m.max()))) if m.size else (0, 0)
        (c_low, c_high), (a_low, a_high) = ends(c), ends(a)
        self.c_bias, self.a_bias = -c_low, -a_low
        # No field and no term of the correction passes this sum.
        most = max(1, self.dims * max(1, c_high - c_low) * max(1, a_high - a_low))
        self.native = most < 1 << 60
        self.bytes = next((b for b in (2, 4, 8) if most < 1 << (8 * b)), -(-most.bit_length() // 8))
        c = c.astype(np.int64 if self.native else object)
        self.sums = c.sum(axis=1) if self.dims else np.zeros(self.n, dtype=np.int64)
        self.wide = [self._pack(c[:, k] + self.c_bias) for k in range(self.dims)]

    def _pack(self, column: np.ndarray) -> int:
        if self.native:
            return int.from_bytes(column.astype(f"<u{self.bytes}").tobytes(), "little")
        return int.from_bytes(b"".join(int(v).to_bytes(self.bytes, "little") for v in column.tolist()), "little")

    def score(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of all candidates with one anchor."""
        total, own = 0, 0
        for k, wide in enumerate(self.wide):
            x = int(anchor[k])
            own += x
            total += (x + self.a_bias) * wide
        raw = total.to_bytes(self.n * self.bytes, "little")
        # sum (a + A)(c + B) = sum a c + B sum a + A sum c + dims A B
        shift = self.c_bias * own + self.dims * self.a_bias * self.c_bias
        if self.native:
            return np.frombuffer(raw, dtype=f"<u{self.bytes}").astype(np.int64) - self.a_bias * self.sums - shift
        fields = [int.from_bytes(raw[i:i + self.bytes], "little") for i in range(0, len(raw), self.bytes)]
        return np.array([f - self.a_bias * int(s) - shift for f, s in zip(fields, self.sums)], dtype=object)


def sortable(score: int) -> bytes:
    """Bytes that sort like the integer, of any size."""
    size = (abs(score).bit_length() + 7) // 8
    body = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\x01" + body if score >= 0 else b"\x00" + bytes(255 - x for x in body)


def unsortable(key: bytes) -> int:
    if key[0]:
        return int.from_bytes(key[5:], "big")
    return -int.from_bytes(bytes(255 - x for x in key[5:]), "big")


def _best(scores: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` places of ``at`` with the highest scores; of equal ones the first."""
    if len(at) > n:
        if scores.dtype == object:
            floor = sorted(scores[at].tolist())[-n]
        else:
            floor = np.partition(scores[at], len(at) - n)[len(at) - n]
        at = at[scores[at] >= floor]
    if scores.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: (-scores[i], i))[:n], dtype=np.int64)
    return at[np.argsort(-scores[at], kind="stable")[:n]]


# --------------------------------------------------------------------------------------------------------------- blocks

_BLOCK = "block long, labels array<long>, ids array<long>, rows array<long>, own array<long>, vectors binary"


def _packed_rows(size: int, scale: float):
    """Rows (label, id, row, vector, part) of a task into blocks; the matrix is pickled by numpy, exact for any integer."""
    def run(batches):
        import io

        schema = pa.schema([("block", pa.int64()), ("labels", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())),
                            ("rows", pa.list_(pa.int64())), ("own", pa.list_(pa.int64())), ("vectors", pa.binary())])
        held, seq, part = [], 0, 0

        def block():
            held.sort(key=lambda r: (r[1], r[2]))  # by id: of equal scores the first place wins
            out = io.BytesIO()
            np.save(out, quantised([r[3] for r in held], scale), allow_pickle=True)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(
                [(part << 32) + seq, sorted({r[0] for r in held}), [r[1] for r in held], [r[2] for r in held], [r[0] for r in held], out.getvalue()], schema)], schema=schema)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("label", "id", "row", "vector", "part"))):
                part = row[4]
                held.append(row)
                if len(held) >= size:
                    yield block()
                    held, seq = [], seq + 1
        if held:
            yield block()
    return run


def _blocks(rows: DataFrame, size: int, scale: float, name: str) -> DataFrame:
    """Blocks of rows of like labels.  A range of labels with many rows is split by the row number, so no task holds a label."""
    dealt = rows.repartitionByRange("label", "row").withColumn("part", F.spark_partition_id().cast("long"))
    return staged(dealt.sortWithinPartitions("label", "row").mapInArrow(_packed_rows(size, scale), _BLOCK), name)


def _matrix(raw: bytes) -> np.ndarray:
    import io

    # Own files of this job: the pickled case is that of integers beyond 64 bits.
    return np.load(io.BytesIO(raw), allow_pickle=True)


def _cells(blocks: DataFrame, groups: DataFrame, same: bool) -> DataFrame:
    """(block with its rows, group with its rows): sharing a label, or all but those of one and the same label."""
    b, g = blocks.select("block", "labels"), groups.select(F.col("block").alias("group"), F.col("labels").alias("g_labels"))
    if same:
        pairs = (b.select("block", F.explode("labels").alias("label"))
                 .join(g.select("group", F.explode("g_labels").alias("label")), "label").select("block", "group").distinct())
    else:
        # Ids only: every block once per lot of groups, joined on the lot.
        lots = max(1, min(groups.count(), 1024))
        pairs = (b.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
                 .join(g.withColumn("lot", F.pmod(F.xxhash64("group"), F.lit(lots)).cast("int")), "lot")
                 .filter(~((F.size("labels") == 1) & (F.col("labels") == F.col("g_labels")))).select("block", "group"))
    w = Window.partitionBy("group").orderBy("block")
    pairs = pairs.withColumn("run", F.floor((F.row_number().over(w) - 1) / RUN))
    theirs = groups.select(F.col("block").alias("group"), *[F.col(c).alias(f"g_{c}") for c in groups.columns if c not in ("block", "labels")])
    theirs = pairs.select("group", "run").distinct().join(theirs, "group")
    return pairs.join(blocks.drop("labels"), "block").join(theirs, ["group", "run"]).sortWithinPartitions("group", "run", "block")


_FOUND = T.StructType([T.StructField("row", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("other", T.LongType()),
                       T.StructField("other_id", T.LongType()), T.StructField("score", T.LongType()), T.StructField("key", T.BinaryType())])


def _search(choose, keep: int):
    """Score every cell; per anchor and list the best ``keep`` rows over the cells of a run, as rows of ``_FOUND``.

    ``choose(scores, same label, own row, anchor number, cell)`` gives one array of places per list.
    """
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, now, best, cell = to_arrow_schema(_FOUND), None, {}, None

        def answers():
            columns = [[], [], [], [], [], []]
            for (row, place), found in best.items():
                for score, other_id, other in found:
                    fits = -(1 << 63) <= score < 1 << 63
                    for column, v in zip(columns, (row, place, other, other_id, score if fits else None, sortable(score))):
                        column.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                cell = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                if now not in (None, (cell["group"], cell["run"])):
                    yield answers()
                    best = {}
                now = (cell["group"], cell["run"])
                anchors = _matrix(cell["g_vectors"])
                packed = Packed(_matrix(cell["vectors"]), anchors)
                ids, rows, labels = (np.array(cell[n], dtype=np.int64) for n in ("ids", "rows", "own"))
                for k, (row, label) in enumerate(zip(cell["g_rows"], cell["g_own"])):
                    scores = packed.score(anchors[k])
                    for place, at in choose(scores, labels == label, rows == row, k, cell):
                        if not len(at):
                            continue
                        found = best.get((row, place), []) + [(int(scores[j]), int(ids[j]), int(rows[j])) for j in at.tolist()]
                        found.sort(key=lambda r: (-r[0], r[1], r[2]))
                        best[row, place] = found[:keep]
            pa.default_memory_pool().release_unused()
        if best:
            yield answers()
    return run


def _choose_positives(n: int):
    def choose(scores, same, own, k, cell):
        yield 0, _best(scores, np.flatnonzero(same & ~own), n)
    return choose


def _choose_negatives(n: int, low: int, high: int):
    def choose(scores, same, own, k, cell):
        others = ~same
        for place, key in enumerate(cell["g_keys"][k] or ()):
            positive = unsortable(key)
            # low * p <= 100 * s <= high * p, as bounds of the integer s
            least, most = -(-low * positive // 100), high * positive // 100
            if least > most:
                continue
            if scores.dtype != object and not (-(1 << 62) < least and most < 1 << 62):
                if least >= 1 << 62 or most <= -(1 << 62):
                    continue
                least, most = max(least, -(1 << 62)), min(most, 1 << 62)
            yield place, _best(scores, np.flatnonzero(others & (scores >= least) & (scores <= most)), n)
    return choose


def _top(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("key").desc(), "other_id", "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def mine(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score) of the hard negatives.

    A row's score is the inner product of the quantised vectors, floor(``scale`` * x) as doubles.  An anchor (a row for which
    ``anchors`` is true) has as positives its ``positives`` best other rows of the same label; for each positive the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score are returned
    (none, if there are none).  Ties go to the smaller id, then to the earlier row.

    Rows with a null label, a null vector, a null component or one that is not finite (also after scaling) take no part.  A
    null id comes after all others.  Repeated rows are rows of their own: each of them may be an anchor and a candidate.
    Components that the shorter of two vectors lacks count as 0.  Scores beyond 64 bits rank exactly but are returned as null.
    Other columns are not read.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scaled = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    sound = F.forall(scaled, lambda x: F.coalesce(F.abs(x * F.lit(float(scale))) < F.lit(float("inf")), F.lit(False)))
    rows = staged(vectors.filter(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & sound)
                  .select(F.col(label_col).cast("long").alias("label"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"),
                          F.monotonically_increasing_id().alias("row"), scaled.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor")), "vectors")
    with arrow_rows(spark, 2000):
        blocks = _blocks(rows.drop("anchor"), BLOCK_ROWS, scale, "blocks")
        groups = _blocks(rows.filter("anchor").drop("anchor"), GROUP_ROWS, scale, "groups")
    with arrow_rows(spark, 4):
        cells = _cells(blocks, groups, same=True)
        found = cells.mapInArrow(_search(_choose_positives(positives), positives), _FOUND)
        best = staged(_top(found, ["row"], positives).drop("place"), "positives")
        # The groups again, with the scores of every anchor's positives in their order.
        listed = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key"))), lambda x: x["key"]).alias("keys"))
        scores = (groups.select("block", F.posexplode("rows").alias("k", "row")).join(listed, "row", "left")
                  .groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "keys"))), lambda x: x["keys"]).alias("keys")))
        cells = _cells(blocks, groups.join(scores, "block"), same=False)
        found = cells.mapInArrow(_search(_choose_negatives(negatives, low, high), negatives), _FOUND)
        chosen = staged(_top(found, ["row", "place"], negatives), "negatives")
    drop_staged(blocks), drop_staged(groups)
    release(spark)
    shown = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    theirs = best.select("row", (F.col("rank") - 1).alias("place"), F.col("other_id").alias("_p"), F.col("score").alias("positive_score"))
    names = rows.filter("anchor").select("row", F.col("id").alias("_a"))
    return (chosen.join(theirs, ["row", "place"]).join(names, "row")
            .select(shown("_a").alias("anchor_id"), shown("_p").alias("positive_id"), (F.col("place") + 1).alias("positive_rank"), "rank",
                    shown("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
