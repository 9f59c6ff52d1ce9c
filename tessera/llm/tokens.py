"""Token-id output: documents as zstandard frames over one shared dictionary, in shards with an offset index.

A shard is one self-contained binary image (all integers little-endian):

    8 bytes   magic "TOKSHRD1"
    32 bytes  SHA-256 of the dictionary (all zero bytes: no dictionary)
    8 bytes   number of documents n
    8 bytes   ids of all documents before this shard
    (n + 1) * 8 bytes   offsets of the frames, relative to the first frame; the last one is their total size
    n * 8 bytes         ids of each document
    n * 9 bytes         one byte (1: the id is known) and the document id, 8 bytes signed
    frames    one zstandard frame per document: its ids as unsigned integers of ``width`` bytes

so one document is read by its offsets alone.  Shards are rows of a Parquet table (Spark's commit makes the write
safe against lost executors and works on any store); ``dictionary`` and ``width`` are kept in a table beside them.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import append_columns, arrow_rows, drop_staged, give_back, release, staged

MAGIC = b"TOKSHRD1"
LEVEL = 3
DICTIONARY_BYTES = 64 * 1024
# The dictionary is trained on at most this many documents, of at most so many ids each.
SAMPLE_DOCS, SAMPLE_IDS = 1000, 20_000
SHARD_BYTES = 4_000_000
# Rows of a batch between Spark and Python: of texts, and of shards.
TEXT_ROWS, SHARD_ROWS = 1000, 2
BROADCAST_SHARDS = 500_000


# Pieces of text whose ids a worker remembers between batches and tasks, by tokenizer file; bounds its memory.
MEMORY_PIECES = 400_000
BATCH_BYTES = 2_000_000
# New pieces that a worker encodes at once.
FRESH_PIECES = 20_000
_MEMORY: dict[str, PieceIds] = {}

# Letters beyond ASCII that the direct path takes: Latin-1 and Latin Extended-A, without signs and irregular letters.
_LATIN = "".join(chr(c) for c in range(0xC0, 0x180) if c not in (0xD7, 0xF7, 0x130, 0x138, 0x149, 0x17F))
_PLAIN = re.compile(f"[!-~{_LATIN}]+")
# The pre-tokenisation of the word-end vocabulary (fixed by its file), for lower-case pieces of those letters.
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN.lower()}]+|[0-9]|[^a-z0-9{_LATIN.lower()}]+")
# A letter and the signs after it at the end of a piece; apostrophes stay, as the letters after one may belong to it.
_ENDING = "([a-z\u00df-\u00f6\u00f8-\u00ff])([!-&(-/:-@\\[-`{-~]+) "

# A random number for each byte value at each of 64 places; the hash of a piece is the sum of its bytes' numbers.
_PLACES = 64
_NUMBERS = np.random.default_rng(0).integers(0, 1 << 64, size=_PLACES * 256, dtype=np.uint64)


def _codes(pieces: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string of an array, without a detour over Python strings."""
    if not len(pieces):
        return np.zeros(0, dtype=np.uint64)
    offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    first = offsets[:-1] - offsets[0]
    place = (np.arange(len(data)) - np.repeat(first, size)) & (_PLACES - 1)
    numbers = np.append(_NUMBERS[place * 256 + data], np.uint64(0))
    return np.where(size > 0, np.add.reduceat(numbers, first), np.uint64(0))


class PieceIds:
    """Ids of the pieces between blanks and line feeds, each distinct piece encoded once.

    Right for tokenizers whose pre-tokenisation never joins text across a blank or a line feed and drops both, as the
    word-end vocabulary does; ``plain_encoder`` takes any tokenizer.  Pieces of plain Latin letters go straight to the
    library's model, split and spelled as the file's own steps would; special tokens and all else take the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        spell = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.table = {ord(c): spell(c)[0][0] for c in _LATIN.lower()}
        self.known = pa.array([], pa.string())
        # Hashes of the known pieces in order, and where in ``known`` each stands.
        self.hashes, self.places = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)
        self.first, self.size, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.uint32)

    def ids_of(self, pieces: list[str]) -> list[list[int]]:
        found: list[list[int]] = []
        rest = []
        table, tokenize = self.table, self.tokenizer.model.tokenize
        for k, w in enumerate(pieces):
            if w.isascii() and w.isalpha():  # one part, and no special token
                found.append([t.id for t in tokenize(w.lower())])
            elif _PLAIN.fullmatch(w) and not ("<" in w and any(t in w for t in self.special)):
                ids = []
                for part in _SPLIT.findall(w.lower()):
                    ids += [t.id for t in tokenize(part if part.isascii() else part.translate(table))]
                found.append(ids)
            else:
                found.append([])
                if w:
                    rest.append(k)
        for k in range(0, len(rest), 5000):
            at = rest[k:k + 5000]
            for i, e in zip(at, self.tokenizer.encode_batch_fast([pieces[i] for i in at], add_special_tokens=False)):
                found[i] = e.ids
        return found

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Place of every piece in ``known`` (-1: new), and its hash; only the pieces asked for are hashed.

        Hashes find a piece, its text decides.
        """
        codes = _codes(pieces)
        if not len(self.known):
            return np.full(len(pieces), -1, dtype=np.int64), codes
        order = np.argsort(codes)  # neighbours are looked up one after the other
        near = np.empty(len(codes), dtype=np.int64)
        near[order] = np.minimum(np.searchsorted(self.hashes, codes[order]), len(self.hashes) - 1)
        at = np.where(self.hashes[near] == codes, self.places[near], -1).astype(np.int64)
        hit = np.flatnonzero(at >= 0)
        same = pc.equal(self.known.take(pa.array(at[hit])), pieces.take(pa.array(hit)))
        at[hit[~same.to_numpy(zero_copy_only=False)]] = -1
        return at, codes

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """One id array per text; a null text has no ids."""
        out: list[np.ndarray] = []
        sizes = np.array(pc.fill_null(pc.binary_length(column), 0).to_pylist(), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // BATCH_BYTES)) + 1).tolist(), len(column)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            out += self._encode(pc.fill_null(column.slice(a, b - a), ""))
        return out

    def _encode(self, column: pa.Array) -> list[np.ndarray]:
        if not len(column):
            return []
        blank = pc.replace_substring(column, "\n", " ")
        # The vocabulary is lower case and signs after a letter are a piece of their own, so both cuts leave the ids as
        # they are and there are fewer distinct pieces; texts that spell a special token are left alone.
        if not pc.any(pc.match_substring(column, "<|")).as_py():
            blank = pc.replace_substring_regex(pc.ascii_lower(blank), _ENDING, "\\1 \\2 ")
        lists = pc.split_pattern(blank, " ")
        words = lists.flatten().dictionary_encode()
        number, codes = self._look_up(words.dictionary)
        new = number < 0
        first, size, flat = self.first, self.size, self.flat
        if new.any():
            fresh = words.dictionary.filter(pa.array(new))
            sizes, parts = [size], [flat]
            for k in range(0, len(fresh), FRESH_PIECES):
                found = self.ids_of(fresh.slice(k, FRESH_PIECES).to_pylist())
                sizes.append(np.fromiter(map(len, found), dtype=np.int32, count=len(found)))
                parts.append(np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(sizes[-1].sum())))
            more = np.concatenate(sizes[1:])
            first = np.concatenate([first, len(flat) + np.cumsum(more, dtype=np.int64) - more])
            size, flat = np.concatenate(sizes), np.concatenate(parts)
            base = len(self.known)
            number[new] = np.arange(base, base + len(fresh))
            if base + len(fresh) <= MEMORY_PIECES:  # frequent pieces come early; beyond that a piece is learned for its batch
                self.known = pa.concat_arrays([self.known, fresh])
                self.first, self.size, self.flat = first, size, flat
                order = np.argsort(codes[new])
                put = np.searchsorted(self.hashes, codes[new][order])
                self.hashes = np.insert(self.hashes, put, codes[new][order])
                self.places = np.insert(self.places, put, number[new][order])
        # Ids of the batch's distinct pieces as an Arrow list array, which then follows the order of the text.
        n = size[number]
        ends = np.cumsum(n, dtype=np.int64)
        flat = flat[np.repeat(first[number] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        ids = pa.ListArray.from_arrays(offsets, pa.array(flat)).take(words.indices)
        borders = ids.offsets.to_numpy()[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        values = ids.values.to_numpy()
        return [values[a:b] for a, b in zip(borders[:-1], borders[1:])]


def word_encoder(path: str):
    """The encoder of ``PieceIds``; a worker keeps it between tasks."""
    if path not in _MEMORY:
        _MEMORY[path] = PieceIds(path)
    return _MEMORY[path].encode


def forget() -> None:
    """Drop the encoders that this process keeps: the driver needs one for the dictionary only."""
    _MEMORY.clear()
    give_back()


def plain_encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda column: [np.array(e.ids, dtype=np.uint32) for e in tokenizer.encode_batch_fast(
        [t or "" for t in column.to_pylist()], add_special_tokens=False)]


def packed(ids: np.ndarray, width: int) -> bytes:
    return ids.astype(f"<u{width}").tobytes()


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary over serialized id arrays; empty if the sample is too small to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, [a for a in arrays if len(a) >= 8]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes, level: int = LEVEL):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=level)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def sample_dictionary(docs: DataFrame, encoder, end_id: int, width: int, id_col: str, text_col: str) -> bytes:
    """Train on the documents with the smallest hashes of their ids: a fixed, bounded and repeatable sample.

    The hashes are picked by id alone; the texts of the picked ones (one text to a hash) then come to the driver.
    """
    hashed = docs.select(F.xxhash64(id_col).alias("h"), F.substring(text_col, 1, 4 * SAMPLE_IDS).alias("t"))
    picked = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_DOCS)
    rows = (hashed.join(F.broadcast(picked), "h").filter(F.length("t") > 0)
            .groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect())
    if not rows:
        return b""
    found = encoder()(pa.array([r["t"] for r in rows], pa.string()))
    made = train_dictionary([packed(np.append(x[:SAMPLE_IDS], end_id), width) for x in found])
    del rows, found
    forget()
    return made


def encoded(docs: DataFrame, encoder, dictionary: bytes, end_id: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_tokens, frame) for every row: ids of the whole text and the end id."""
    def make():
        encode, z = encoder(), _compressor(dictionary)

        def step(batch: pa.RecordBatch):
            arrays = [np.append(x, np.uint32(end_id)) for x in encode(batch.column(text_col))]
            made = [[len(x) for x in arrays], [z.compress(packed(x, width)) for x in arrays]]
            pa.default_memory_pool().release_unused()
            return made
        return step

    return append_columns(docs.select(id_col, text_col), make,
                          [T.StructField("n_tokens", T.LongType()), T.StructField("frame", T.BinaryType())], drop=(text_col,))


def shard_image(ids: list, counts: list[int], frames: list[bytes], dictionary_hash: bytes) -> bytes:
    """The image with 0 ids before it; ``placed`` writes the real number when all shards are known."""
    n = len(ids)
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in frames])]).astype("<i8").tobytes()
    names = b"".join(struct.pack("<Bq", i is not None, i or 0) for i in ids)
    return b"".join([MAGIC, dictionary_hash, struct.pack("<qq", n, 0), offsets, np.array(counts, dtype="<i8").tobytes(), names, *frames])


def placed(image: bytes, before: int) -> bytes:
    return image[:48] + struct.pack("<q", before) + image[56:]


def shard_index(image: bytes, dictionary: bytes) -> tuple[list, np.ndarray, np.ndarray, int, int]:
    """(document ids, ids per document, frame offsets, place of the first frame, ids before the shard)."""
    if image[:8] != MAGIC:
        raise ValueError("not a token shard")
    if image[8:40] != dictionary_sha(dictionary):
        raise ValueError("the shard was written with another dictionary")
    n, before = struct.unpack_from("<qq", image, 40)
    offsets = np.frombuffer(image, dtype="<i8", count=n + 1, offset=56)
    counts = np.frombuffer(image, dtype="<i8", count=n, offset=56 + 8 * (n + 1))
    at = 56 + 8 * (n + 1) + 8 * n
    ids = [i if known else None for known, i in struct.iter_unpack("<Bq", image[at:at + 9 * n])]
    return ids, counts, offsets, at + 9 * n, before


def dictionary_sha(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest() if dictionary else bytes(32)


def read_document(image: bytes, k: int, dictionary: bytes, width: int) -> np.ndarray:
    """The ids of the shard's k-th document; only its own frame is decompressed."""
    _, counts, offsets, first, _ = shard_index(image, dictionary)
    frame = image[first + offsets[k]:first + offsets[k + 1]]
    return np.frombuffer(_decompressor(dictionary).decompress(frame, max_output_size=int(counts[k]) * width), dtype=f"<u{width}")


def write_tokens(docs: DataFrame, path: str, encoder, end_id: int, width: int = 4, id_col: str = "doc_id",
                 text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Write ``docs`` as token shards under ``path``, ordered by id (null ids first, equal ids in any fixed order).

    ``encoder()`` runs once per task and returns a function from texts to id arrays; ``width`` is the bytes of an id
    (2 holds vocabularies up to 65,536).  Every document, the empty ones too, gets the end id.  The texts are encoded
    and compressed where they are read; only the frames are shuffled, into ranges of the id.
    """
    spark = docs.sparkSession
    dictionary = sample_dictionary(docs, encoder, end_id, width, id_col, text_col)
    sha = dictionary_sha(dictionary)
    with arrow_rows(spark, TEXT_ROWS):
        frames = staged(encoded(docs, encoder, dictionary, end_id, width, id_col, text_col), "frames")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (frames.select(F.col(id_col).cast("long").alias("id"), "n_tokens", "frame")
               .repartitionByRange(parts, "id", F.xxhash64("frame")).sortWithinPartitions("id", F.xxhash64("frame"), "frame")
               .withColumn("part", F.spark_partition_id()))

    def pack(batches):
        ids, counts, held, size, seq = [], [], [], 0, 0
        part = 0

        def row():
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_ids": [sum(counts)],
                                               "image": [shard_image(ids, counts, held, sha)]},
                                              schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()),
                                                                ("n_ids", pa.int64()), ("image", pa.binary())]))
        for b in batches:
            for i, n, f, p in zip(*(b.column(c).to_pylist() for c in ("id", "n_tokens", "frame", "part"))):
                part = p
                ids.append(i), counts.append(n), held.append(f)
                size += len(f) + 25
                if size >= shard_bytes:
                    yield row()
                    ids, counts, held, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield row()

    shards = staged(ordered.mapInArrow(pack, "part int, seq int, n_docs long, n_ids long, image binary"), "shards")
    # Shards are in the order of (part, seq): one row per shard, so this window is over counts of shards only.
    order = W.orderBy("part", "seq")
    starts = (shards.select("part", "seq", "n_docs", "n_ids")
              .withColumn("shard", F.row_number().over(order) - 1)
              .withColumn("before", F.sum("n_ids").over(order.rowsBetween(W.unboundedPreceding, -1)))
              .withColumn("before", F.coalesce("before", F.lit(0)).cast("long"))
              .select("part", "seq", "shard", "before"))

    def make():
        return lambda b: [[placed(i, n) for i, n in zip(b.column("image").to_pylist(), b.column("before").to_pylist())]]

    del ordered
    drop_staged(frames)
    release(spark)
    # The shards themselves are shuffled for their numbers only if there are too many numbers to broadcast.
    starts = staged(starts, "starts")
    few = starts.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS
    out = append_columns(shards.join(F.broadcast(starts) if few else starts, ["part", "seq"]), make, [T.StructField("image", T.BinaryType())], drop=("part", "seq"))
    with arrow_rows(spark, SHARD_ROWS):
        out.select("shard", "before", "n_docs", "n_ids", "image").write.parquet(f"{path}/shards")
    (spark.createDataFrame([(bytearray(dictionary), width, end_id)], "dictionary binary, width int, end_id long")
     .coalesce(1).write.parquet(f"{path}/meta"))
    drop_staged(shards)
    drop_staged(starts)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of the shards under ``path``."""
    meta = spark.read.parquet(f"{path}/meta").first()
    dictionary, width = bytes(meta["dictionary"]), meta["width"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           T.StructField("ids", T.BinaryType())])
    return spark.read.parquet(f"{path}/shards").select("image").mapInArrow(partial(_unpack, dictionary=dictionary, width=width), schema)


def _unpack(batches, dictionary: bytes, width: int):
    z = _decompressor(dictionary)
    for b in batches:
        for image in b.column("image").to_pylist():
            ids, counts, offsets, first, before = shard_index(image, dictionary)
            for k in range(0, len(ids), 512):
                part = range(k, min(k + 512, len(ids)))
                rows = [np.frombuffer(z.decompress(image[first + offsets[i]:first + offsets[i + 1]],
                                                   max_output_size=int(counts[i]) * width), dtype=f"<u{width}").astype("<u4").tobytes()
                        for i in part]
                starts = before + np.concatenate([[0], np.cumsum(counts)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in part], pa.int64()), pa.array(starts[k:k + len(part)].astype(np.int64)),
                     pa.array([len(r) // 4 for r in rows], pa.int64()), pa.array([zlib.crc32(r) for r in rows], pa.int64()),
                     pa.array(rows, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])
