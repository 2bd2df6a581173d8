"""Token ids in a compact file format: canonical length-limited Huffman codes, decoded block by block.

Documents are put in ascending doc_id order, encoded with the tokenizers library and cut into
segments of whole documents. One code for the whole corpus comes from the counts of all ids
(package-merge, at most MAX_BITS bits a code); only code lengths are stored, the codes are
canonical. A segment is coded in blocks of BLOCK ids whose bit offsets it lists, so that any block
decodes by itself and all blocks of a segment decode side by side through one table.

The tables of segments and code lengths are written to the shared folder and read back; a
document's start is the number of ids in the shards, segments and documents before it.

Defined results: null text is empty and gives the end id alone. Null doc_ids come first; documents
with the same doc_id follow each other by text. An empty table gives no segments and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import ChunkCache, Kept
from .common import kept_by_worker, map_arrow, materialize, small

MAX_BITS, BLOCK, END_ID = 16, 256, 2
#: A segment is closed with the document that fills it.
SEGMENT_IDS = 500_000
#: Characters of a text that count for where its shard begins.
SAMPLED = 256
MAGIC = b"PTK1"

#: A word and signs after it: two pieces of the split pattern.
_WORD = re.compile(r"([^\W\d_]+)([^\w\s']+)")

_BESIDE_LINE_END = re.compile(r"\s\n|\n\s|^\n|\n$")


@kept_by_worker
def tokenizer(path: str) -> ChunkCache:
    """A cache in front of the library, one for each process; special tokens' strings are ordinary text.

    Texts that are plainly one or a few pieces go to the library's model piece by piece, all
    others through its whole way from text to ids.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    by_pieces = own.normalizer is None and isinstance(own.pre_tokenizer, pre_tokenizers.ByteLevel) and not own.pre_tokenizer.add_prefix_space
    # what byte-level vocabularies write for each byte: printable ones as they are, all others from 256 on
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    written = {b: 256 + i for i, b in enumerate(others)}
    tokenize, space = own.model.tokenize, chr(written[ord(" ")])

    def piece(x: str) -> bytes:
        """The ids of a piece."""
        # of ASCII letters and signs only the space in front is written as another character
        spelt = x.replace(" ", space) if x.isascii() else x.encode().decode("latin-1").translate(written)
        return array("I", [t.id for t in tokenize(spelt)]).tobytes()

    def whole(x: str) -> bytes:
        return array("I", own.encode(x, add_special_tokens=False).ids).tobytes()

    line_end, pieces = whole("\n"), Kept(piece, 300_000)

    def encode(x: str) -> bytes:
        if by_pieces and x:
            pieces.trim()
            spaced = x[0] == " "
            word = x[1:] if spaced else x
            if word.isalpha():
                return piece(x) if spaced else pieces.young[x]  # chunks are kept already
            m = _WORD.fullmatch(word)
            if m and (word.isascii() or m[1].isalpha()):
                return (cache.kept.young[m[1]] if spaced else pieces.young[m[1]]) + pieces.young[m[2]]
            if "\n" in word and len(word) > 1 and not _BESIDE_LINE_END.search(x):  # a line end by itself is a piece
                return line_end.join([encode(y) for y in x.split("\n")])
        return whole(x) if x else b""

    cache = ChunkCache(encode, 600_000)
    return cache


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits by package-merge; 0 for symbols that don't occur."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n > 1 << most:
        raise ValueError(f"{n} symbols don't fit in codes of {most} bits")
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    order = symbols[np.argsort(counts[symbols], kind="stable")]
    leaf = counts[order].astype(np.int64)
    items, is_leaf = leaf, [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both, kind = np.concatenate([leaf, pairs]), np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        by = np.argsort(both, kind="stable")
        items = both[by]
        is_leaf.append(kind[by])
    need = 2 * n - 2
    for kind in reversed(is_leaf):
        leaves = int(kind[:need].sum())
        lengths[order[:leaves]] += 1
        need = 2 * (need - leaves)
    return lengths


class Code:
    """The canonical code of given lengths: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        wide = lengths[order].astype(np.int64)
        spans = 1 << (MAX_BITS - wide)
        first = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint32)
        self.codes[order] = first >> (MAX_BITS - wide)
        self.symbol, self.wide = np.zeros(1 << MAX_BITS, np.uint32), np.full(1 << MAX_BITS, MAX_BITS, np.uint8)
        self.symbol[: spans.sum()], self.wide[: spans.sum()] = np.repeat(order, spans), np.repeat(wide, spans)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit offset of each block of BLOCK ids."""
        wide = self.lengths[ids].astype(np.int64)
        at = np.cumsum(wide) - wide
        n = int(wide.sum())
        value = self.codes[ids].astype(np.int64) << (64 - 16 - wide - (at & 31))  # in the 48 bits from the code's word on
        word = at >> 5
        out = np.zeros(n // 32 + 2, np.int64)
        if len(ids):  # codes don't overlap: adding joins them
            first = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[first]] += np.add.reduceat(value >> 16, first)
            out[word[first] + 1] += np.add.reduceat(value & 0xFFFF, first) << 16
        return out.astype(">u4").tobytes()[: n // 8 + 4], at[::BLOCK].astype(np.uint32)

    def decode(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """All blocks side by side, one id of each at a time."""
        raw = np.frombuffer(bits + b"\0\0\0", np.uint8).astype(np.uint32)
        window = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
        at, out = offsets.astype(np.int64), np.zeros((len(offsets), BLOCK), np.uint32)
        left = n - (len(offsets) - 1) * BLOCK if len(offsets) else 0
        for i in range(BLOCK if len(offsets) > 1 else left):
            if i == left:  # the last block has ended
                at = at[:-1]
            v = (window[at >> 3] >> (8 - (at & 7)).astype(np.uint32)) & 0xFFFF
            out[: len(at), i] = self.symbol[v]
            at = at + self.wide[v]
        return out.reshape(-1)[:n]


def segment_bytes(code: Code, ids: np.ndarray) -> bytes:
    bits, offsets = code.encode(ids)
    head = MAGIC + struct.pack("<IIII", BLOCK, len(ids), len(offsets), zlib.crc32(code.lengths.tobytes()))
    return head + offsets.astype("<u4").tobytes() + bits


def segment_ids(code: Code, data: bytes) -> np.ndarray:
    block, n, blocks, crc = struct.unpack_from("<IIII", data, 4)
    if data[:4] != MAGIC or block != BLOCK or crc != zlib.crc32(code.lengths.tobytes()):
        raise ValueError("not a segment of this code")
    return code.decode(data[20 + 4 * blocks :], np.frombuffer(data, "<u4", blocks, 20), n)


def short(ids: np.ndarray) -> bytes:
    """ids in two bytes each where they fit, else in four."""
    return ids.astype("<u2" if ids.max(initial=0) < 1 << 16 else "<u4").tobytes()


def ids_of(data: memoryview | pa.Buffer, n: int) -> np.ndarray:
    """The n ids that short wrote."""
    return np.frombuffer(data, "<u2" if len(memoryview(data)) == 2 * n else "<u4")


def token_segments(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Rows (shard, segment, doc_ids, sizes, ids, counts), in the order of doc_id; ids as binary, see short.

    counts is in a shard's last row: how often each id comes in the shard, as 64-bit integers.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        no, shard, held, size = 0, 0, [], 0
        total, ready = np.zeros(0, np.int64), None

        def flush():
            nonlocal no, held, size, total
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            total = added(total, np.bincount(ids))
            row = {"shard": [shard], "segment": [no], "doc_ids": [[d for d, _ in held]], "sizes": [[len(x) // 4 for _, x in held]], "ids": [short(ids)], "counts": [None]}
            no, held, size = no + 1, [], 0
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                shard = part.column(2)[0].as_py()
                for d, x in zip(part.column(0).to_pylist(), cache.encode([x or "" for x in part.column(1).to_pylist()]), strict=True):
                    held.append((d, x + end))
                    size += len(x) // 4 + 1
                    if size >= SEGMENT_IDS:
                        if ready:
                            yield pa.RecordBatch.from_pydict(ready, schema)
                        ready = flush()
        if held:
            if ready:
                yield pa.RecordBatch.from_pydict(ready, schema)
            ready = flush()
        if ready:
            yield pa.RecordBatch.from_pydict(ready | {"counts": [total.astype("<i8").tobytes()]}, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("doc_ids", pa.list_(to_arrow_type(kind))), ("sizes", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])
    # the sort's order makes tasks consecutive shards; of texts the driver samples beginnings, which are in the texts' order
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, SAMPLED)).sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("shard"))
    return map_arrow(ordered, run, f"shard int, segment int, doc_ids array<{kind.simpleString()}>, sizes array<bigint>, ids binary, counts binary")


def added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sum of counts of different lengths."""
    out = np.zeros(max(len(x), len(y)), np.int64)
    out[: len(x)] += x
    out[: len(y)] += y
    return out


def id_counts(segments: DataFrame) -> DataFrame:
    """Rows (id, n) over all segments; at most as many as the vocabulary has entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total = added(total, np.frombuffer(x.as_buffer(), "<i8"))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return map_arrow(segments.filter("counts is not null").select("counts"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> tuple[DataFrame, np.ndarray]:
    """The table of segments as it reads back (shard, segment, doc_ids, sizes, data), and the code lengths."""
    segments = materialize(token_segments(docs, path, end_id), "ids")
    counted = id_counts(segments).toPandas()
    counts = np.zeros(int(counted["id"].max()) + 1 if len(counted) else 0, np.int64)
    counts[counted["id"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    lengths = code_lengths(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data = segment_bytes(code, ids_of(row.column(4)[0].as_buffer(), sum(row.column(3)[0].as_py())))
                yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([data], pa.binary())], names)

    names = ["shard", "segment", "doc_ids", "sizes", "data"]
    kind = segments.schema["doc_ids"].dataType.simpleString()
    coded = map_arrow(segments.drop("counts"), run, f"shard int, segment int, doc_ids {kind}, sizes array<bigint>, data binary")
    return materialize(coded, "segments"), lengths


def read_token_files(files: DataFrame, lengths: np.ndarray, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32 and, if with_ids, ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, segment, doc_ids, sizes, data = (c[i] for c in batch.columns)
                ids, sizes = segment_ids(code, data.as_py()).astype("<u4"), np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(sizes)
                raw = [ids[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
                cols = [doc_ids.values, pa.array(ends - sizes), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(np.full(len(raw), shard.as_py(), np.int32)), pa.array(np.full(len(raw), segment.as_py(), np.int32))]
                if with_ids:
                    cols.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "at", "n_tokens", "ids_crc32", "shard", "segment", *["ids"] * with_ids]
    kind = files.schema["doc_ids"].dataType.elementType.simpleString()
    rows = map_arrow(files.select("shard", "segment", "doc_ids", "sizes", "data"), run, f"doc_id {kind}, at long, n_tokens long, ids_crc32 long, shard int, segment int" + ", ids binary" * with_ids)
    sizes = files.select("shard", "segment", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "segment", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("in_shard")).join(shards, "shard").select("shard", "segment", (F.col("base") + F.col("in_shard")).alias("base"))
    keep = ["doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids]
    return rows.join(small(starts), ["shard", "segment"]).select(*keep)


def write_and_read(docs: DataFrame, path: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    files, lengths = write_token_files(docs, path or public_tokenizers.path("byte_bpe_50k.json"), end_id)
    return read_token_files(files, lengths, with_ids)
