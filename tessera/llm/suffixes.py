"""Exact substring dedup: a distributed difference-cover sort of the texts' suffixes, to the depth that decides.

Two suffixes matter to each other only if their first ``LENGTH`` = 50 bytes are equal, so the sort stops at that depth:

1. Texts equal as a whole are one text (the one of the smallest id); the copies of at least 50 bytes go entirely.
2. Sample.  The suffixes at places p with p mod 21 in a perfect difference set are the sample (5 of 21): for any two
   places i and j there is a shift below 21 that takes both into it.  So equal 50-byte strings contain, at the same
   shift, equal 30-byte tuples at sampled places.  All sampled tuples are sorted (dealt by ranges of a hash, in packed
   arrays) and compared with their neighbours; a tuple that occurs once is settled.
3. Recursion on names.  Only the suffixes that a repeated tuple reaches go on.  The name of a suffix is the hash of the
   names of its parts and covers all 50 bytes; that is the full depth, so the recursion ends here.
4. Merge.  The named suffixes of all texts, sampled or not, are sorted together with their document ids, and every
   entry is compared with the head of its run: it is a repetition if a smaller document stands there.

The order within a depth is that of 64-bit hashes, not of bytes; equal strings stand together in either.  The hash range
a name is dealt by comes from a second hash, so a name has 64 bits and those of its range.

Texts are packed into blocks of some megabytes, and a block sends one packed array per range: each name once with its
smallest document, so a passage that a third of all documents hold costs one entry per block.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import append_columns, arrow_rows, drop_staged, release, staged

LENGTH = 50
# A perfect difference set: every remainder modulo 21 but 0 is the difference of exactly one ordered pair.
MODULUS, COVER = 21, (3, 6, 7, 12, 14)
TUPLE = LENGTH - MODULUS + 1
BLOCK_BYTES = 4_000_000
RANGE_BYTES = 12_000_000
# Copies whose ids are broadcast to leave their texts out; more are joined with a shuffle.
BROADCAST_ROWS = 1_000_000
_LAST = (1 << 63) - 1  # stands for a null id: greater than every other
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

_BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.LongType())),
    T.StructField("k1", T.ArrayType(T.LongType())), T.StructField("k2", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType()),
])


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def names(data: bytes, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit name, 32-bit range hash) of the ``length`` bytes at each place; ``data`` ends with 8 spare bytes."""
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    steps = [*range(0, length - 7, 8)] + ([length - 8] if length % 8 else [])
    name, deal = np.empty(len(places), dtype=np.uint64), np.empty(len(places), dtype=np.uint32)
    for lo in range(0, len(places), 250_000):
        at = places[lo:lo + 250_000]
        h, g = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=np.uint64)
        for step, odd in zip(steps, _ODD):
            w = words[at + step]
            h = (h ^ (h >> np.uint64(29)) ^ w) * odd
            g = (g + w) * _ODD[0]
            g ^= g >> np.uint64(31)
        name[lo:lo + 250_000] = _finish(h)
        deal[lo:lo + 250_000] = (_finish(g) >> np.uint64(32)).astype(np.uint32)
    return name, deal


class Block:
    """Texts of ascending ids in one buffer."""

    def __init__(self, ids, sizes, packed):
        import zstandard

        self.ids, self.sizes = np.array(ids, dtype=np.int64), np.array(sizes, dtype=np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.sizes.sum()) + 8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes

    def samples(self) -> np.ndarray:
        """Places of the cover, counted from each text's start, that begin a whole tuple."""
        out = []
        for s, e in zip(self.starts.tolist(), self.ends.tolist()):
            base = np.arange(s, e - TUPLE + 1, MODULUS)
            at = (base[:, None] + np.array(COVER)).ravel()
            out.append(at[at <= e - TUPLE])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def tuples(self, ranges: int):
        """Per range the sorted distinct 32-bit tuple hashes, and for every sample its place there and its count.

        32 bits and the range decide what goes on to the second step; hashes that agree by chance only let more in.
        """
        at = self.samples()
        name, deal = names(self.data, at, TUPLE)
        key = ((deal.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32) << np.uint64(32)) | (name >> np.uint64(32))
        found, place, count = np.unique(key, return_inverse=True, return_counts=True)
        cuts = np.searchsorted(found >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        return at, found.astype(np.uint32), cuts, place, count

    def reach(self, at: np.ndarray) -> np.ndarray:
        """Places whose 50 bytes hold one of the tuples at ``at`` at a shift below the modulus."""
        steps = np.zeros(len(self.data) + 1, dtype=np.int32)
        text = np.searchsorted(self.ends, at, side="right")
        np.add.at(steps, np.maximum(at - MODULUS + 1, self.starts[text]), 1)
        np.add.at(steps, at + 1, -1)
        mask = np.cumsum(steps[:-8 - 1], dtype=np.int32) > 0 if len(self.data) > 8 else np.zeros(0, dtype=bool)
        for s, e in zip(self.starts.tolist(), self.ends.tolist()):
            mask[max(s, e - LENGTH + 1):e] = False
        return mask

    def entries(self, mask: np.ndarray, ranges: int):
        """The block's distinct names with their smallest text, by range, text and name.

        Returns (places, entry of every place, text of every place, entry names, entry texts, range borders).
        """
        at = np.flatnonzero(mask)
        name, deal = names(self.data, at, LENGTH)
        text = np.searchsorted(self.ends, at, side="right")
        part = (deal.astype(np.uint64) * np.uint64(ranges)) >> np.uint64(32)
        order = np.argsort(name, kind="stable")  # within a name: ascending places, so ascending texts
        sorted_name, sorted_part = name[order], part[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = (sorted_name[1:] != sorted_name[:-1]) | (sorted_part[1:] != sorted_part[:-1])
        first = order[head]
        shown = np.lexsort((name[first], text[first], part[first]))
        rank = np.empty(len(first), dtype=np.int64)
        rank[shown] = np.arange(len(first))
        entry = np.empty(len(at), dtype=np.int64)
        entry[order] = rank[np.cumsum(head) - 1]
        first = first[shown]
        cuts = np.searchsorted(part[first], np.arange(ranges + 1, dtype=np.uint64))
        return at, entry, text, name[first], text[first], cuts


def _record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema=schema)


def _as_rows(batches, names_):
    for b in batches:
        columns = [b.column(n) for n in names_]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)
        pa.default_memory_pool().release_unused()  # rows are megabytes: freed memory goes back between batches


def _pack(batches):
    """Texts of a task into blocks; ids of blocks are the task's number and a counter."""
    import zstandard

    from pyspark.sql.pandas.types import to_arrow_schema

    schema, held, size, seq, part = to_arrow_schema(_BLOCK), [], 0, 0, 0
    z = zstandard.ZstdCompressor(level=3)

    def row():
        held.sort(key=lambda r: r[0])
        data = b"".join(r[3] for r in held) + bytes(8)
        return _record(schema, [(part << 32) + seq], [[r[0] for r in held]], [[len(r[3]) for r in held]],
                       [[r[1] for r in held]], [[r[2] for r in held]], [z.compress(data)])

    for batch in batches:
        for i, a, b, text, p in zip(*(batch.column(c).to_pylist() for c in ("id", "k1", "k2", "text", "part"))):
            part = p
            held.append((i, a, b, text))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield row()
                held, size, seq = [], 0, seq + 1
    if held:
        yield row()


def _blocks_of(batches, *more):
    for row in _as_rows(batches, ("block", "ids", "sizes", "packed", *more)):
        yield (row[0], Block(*row[1:4]), *row[4:])


def _tuple_rows(ranges: int):
    def run(batches):
        schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("tuples", pa.binary())])
        for block, b in _blocks_of(batches):
            _, found, cuts, _, _ = b.tuples(ranges)
            full = np.flatnonzero(np.diff(cuts)).tolist()
            yield _record(schema, full, [block] * len(full), [found[cuts[r]:cuts[r + 1]].tobytes() for r in full])
    return run


def _repeated_tuples(batches):
    """Per range: a bit for every block's tuple, set if another block has it too."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())])
    for part, rows in groupby(_as_rows(batches, ("part", "block", "tuples")), key=lambda r: r[0]):
        rows = [(block, np.frombuffer(x, dtype=np.uint32)) for _, block, x in rows]
        every = np.sort(np.concatenate([x for _, x in rows]))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        for lo in range(0, len(rows), 64):
            some = rows[lo:lo + 64]
            bits = []
            for _, x in some:
                at = np.minimum(np.searchsorted(twice, x), max(0, len(twice) - 1))
                bits.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), dtype=bool)).tobytes())
            yield _record(schema, [part] * len(some), [b for b, _ in some], bits)


def _bits(rows, cuts: np.ndarray) -> np.ndarray:
    """One bit per entry from the ranges' answers."""
    out = np.zeros(int(cuts[-1]), dtype=bool)
    for r in rows or ():
        n = int(cuts[r["part"] + 1] - cuts[r["part"]])
        out[cuts[r["part"]]:cuts[r["part"] + 1]] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=n).view(bool)
    return out


def _marked(ranges: int):
    """Add the places that go on, as packed bits."""
    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                block, b, answers = next(_blocks_of([one], "answers"))
                at, _, cuts, place, count = b.tuples(ranges)
                mask = b.reach(at[_bits(answers, cuts)[place] | (count[place] > 1)])
                kept = [one.column(n) for n in ("block", "ids", "sizes", "k1", "k2", "packed")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([z.compress(np.packbits(mask).tobytes())], pa.binary())],
                                                 names=["block", "ids", "sizes", "k1", "k2", "packed", "mask"])
    return run


def _mask_of(b: Block, raw: bytes) -> np.ndarray:
    import zstandard

    n = int(b.sizes.sum())
    packed = zstandard.ZstdDecompressor().decompress(raw, max_output_size=n // 8 + 1)
    return np.unpackbits(np.frombuffer(packed, dtype=np.uint8), count=n).view(bool)


_NAMED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("names", pa.binary()), ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])


def _name_rows(ranges: int):
    def run(batches):
        for block, b, raw in _blocks_of(batches, "mask"):
            _, _, _, name, text, cuts = b.entries(_mask_of(b, raw), ranges)
            full = np.flatnonzero(np.diff(cuts)).tolist()
            columns = [full, [block] * len(full), [], [], []]
            for r in full:
                texts, counts = np.unique(text[cuts[r]:cuts[r + 1]], return_counts=True)
                columns[2].append(name[cuts[r]:cuts[r + 1]].tobytes())
                columns[3].append(b.ids[texts].tolist())
                columns[4].append(counts.tolist())
            yield _record(_NAMED, *columns)
    return run


def _repetitions(batches):
    """Per range: a bit for every block's name, set if a smaller document has it."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("bits", pa.binary())])
    for part, rows in groupby(_as_rows(batches, ("part", "block", "names", "ids", "counts")), key=lambda r: r[0]):
        rows = [(block, np.frombuffer(x, dtype=np.uint64), np.repeat(np.array(i, dtype=np.int64), c)) for _, block, x, i, c in rows]
        name, ids = np.concatenate([x for _, x, _ in rows]), np.concatenate([i for _, _, i in rows])
        order = np.argsort(name)
        heads = np.flatnonzero(np.concatenate([[True], name[order][1:] != name[order][:-1]]))
        least = np.minimum.reduceat(ids[order], heads)
        smaller = np.empty(len(name), dtype=bool)
        smaller[order] = np.repeat(least, np.diff(np.append(heads, len(name)))) < ids[order]
        ends = np.cumsum([len(x) for _, x, _ in rows])
        for lo in range(0, len(rows), 64):
            part_rows = range(lo, min(lo + 64, len(rows)))
            yield _record(schema, [part] * len(part_rows), [rows[k][0] for k in part_rows],
                          [np.packbits(smaller[ends[k] - len(rows[k][1]):ends[k]]).tobytes() for k in part_rows])


_RESULT = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("id", T.LongType()),
    T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def _removed(ranges: int):
    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(_RESULT)
        for _, b, raw, k1, k2, answers in _blocks_of(batches, "mask", "k1", "k2", "answers"):
            at, entry, text, _, entry_text, cuts = b.entries(_mask_of(b, raw), ranges)
            # In the block itself a smaller document holds the name if the entry's text has a smaller id.
            again = _bits(answers, cuts)[entry] | (b.ids[entry_text[entry]] < b.ids[text])
            steps = np.zeros(int(b.sizes.sum()) + 1, dtype=np.int32)
            steps[at[again]] += 1
            steps[at[again] + LENGTH] -= 1
            gone = np.cumsum(steps[:-1], dtype=np.int32) > 0
            data = np.frombuffer(b.data, dtype=np.uint8)
            rows = []
            for k, (s, e) in enumerate(zip(b.starts.tolist(), b.ends.tolist())):
                cut = gone[s:e]
                n = int(cut.sum())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], cut.view(np.int8), [0]]))) if n else np.zeros(0, dtype=np.int64)
                kept = data[s:e][~cut] if n else data[s:e]
                rows.append((k1[k], k2[k], int(b.ids[k]), n, len(edges) // 2, hashlib.sha256(kept.tobytes()).hexdigest(),
                             [{"start": x, "end": y} for x, y in zip(edges[::2].tolist(), edges[1::2].tolist())]))
            for lo in range(0, len(rows), 2000):
                yield _record(schema, *zip(*rows[lo:lo + 2000]))
    return run


def _answers(flags: DataFrame) -> DataFrame:
    """Bits of all ranges, by block: as many as the block has names."""
    return flags.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row of ``docs``.

    A byte goes if a 50-byte string over it also starts in a document of a smaller id; strings are judged on the input.
    ``spans`` are the removed runs in bytes; ``apply_spans`` cuts them out.  A null text is empty; a null id counts as
    greater than every other; rows of equal ids don't judge each other; repeated rows have equal results.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"),
                       F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    keyed = base.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(7), "text")})
    rows = staged(keyed.select("doc", "id", "k1", "k2", F.length("text").cast("long").alias("n_bytes")), "rows")
    classes = rows.filter(F.col("n_bytes") >= LENGTH).groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    copies = staged(rows.join(classes.filter("n > 1"), ["k1", "k2"]).filter("id > least").select("id", "k1", "k2").distinct(), "copies")
    few = copies.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    single = (keyed.filter(F.length("text") >= LENGTH).join(F.broadcast(copies) if few else copies, ["id", "k1", "k2"], "left_anti")
              .select("id", "k1", "k2", "text", F.spark_partition_id().cast("long").alias("part")))
    size = rows.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // RANGE_BYTES)
    blocks = staged(single.mapInArrow(_pack, _BLOCK), "blocks")
    with arrow_rows(spark, 4):
        tuples = blocks.mapInArrow(_tuple_rows(ranges), "part int, block long, tuples binary")
        flags = staged(tuples.repartition(ranges, "part").sortWithinPartitions("part", "block").mapInArrow(_repeated_tuples, "part int, block long, bits binary"), "tuplebits")
        del tuples
        release(spark)
        marked = blocks.join(_answers(flags), "block", "left")
        going = staged(marked.mapInArrow(_marked(ranges), T.StructType([*_BLOCK.fields, T.StructField("mask", T.BinaryType())])), "marked")
        del marked
        drop_staged(blocks), drop_staged(flags)
        release(spark)
        named = going.mapInArrow(_name_rows(ranges), "part int, block long, names binary, ids array<long>, counts array<int>")
        flags = staged(named.repartition(ranges, "part").sortWithinPartitions("part", "block").mapInArrow(_repetitions, "part int, block long, bits binary"), "namebits")
        del named
        release(spark)
        found = staged(going.join(_answers(flags), "block", "left").mapInArrow(_removed(ranges), _RESULT), "removed")
    drop_staged(going), drop_staged(flags)
    release(spark)
    whole = rows.join(found.dropDuplicates(["id", "k1", "k2"]), ["id", "k1", "k2"], "left").join(
        copies.withColumn("copy", F.lit(True)), ["id", "k1", "k2"], "left")
    copy = F.coalesce("copy", F.lit(False))
    short = F.col("n_removed").isNull()
    empty = F.sha2(F.lit("").cast("binary"), 256)
    # Short texts never reach a block: their hash comes from the texts themselves.
    brief = keyed.filter(F.length("text") < LENGTH).select("id", "k1", "k2", F.sha2("text", 256).alias("own_sha")).distinct()
    whole = whole.join(brief, ["id", "k1", "k2"], "left")
    return whole.select(
        F.col("doc").alias(id_col), "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, empty).when(short, F.col("own_sha")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))))
        .otherwise(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>"))).alias("spans"))


def apply_spans(docs: DataFrame, text_col: str = "text", spans_col: str = "spans", out_col: str = "kept") -> DataFrame:
    """Add the bytes that the spans leave, as binary (a cut may fall inside a character)."""
    def make():
        def step(batch: pa.RecordBatch):
            out = []
            for text, spans in zip(batch.column(text_col).cast(pa.binary()).to_pylist(), batch.column(spans_col).to_pylist()):
                at, parts = 0, []
                for s in spans or ():
                    parts.append((text or b"")[at:s["start"]])
                    at = s["end"]
                out.append(b"".join([*parts, (text or b"")[at:]]))
            return [out]
        return step
    return append_columns(docs, make, [T.StructField(out_col, T.BinaryType())])
