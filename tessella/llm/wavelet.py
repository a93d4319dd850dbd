"""Token-id shards as wavelet matrices.

A shard is one file: ids are stored plane by plane from the highest bit, each
plane stably partitioned by the one before (zeros first), so that access, rank
(how often an id occurs before a position), count and select (where its k-th
occurrence is) need one step per bit plane. Planes are packed bits, compressed in
blocks that stand alone; a directory of ones before each superblock of 4096 bits
gives rank in constant time. A query on an open file reads the footer-like head
once and then only the blocks that its steps touch. The file also holds its
documents' ids and lengths.

File: ``TWM2``, header length (u32), a JSON header (n, bits, zeros, docs, sections
as [offset from the header's end, stored bytes]), then the sections, each one
Zstandard frame: document ids, which of them are null, token counts, the
directories of all planes, the offsets of all planes' blocks (from the header's
end, one more than blocks); last the blocks, each a Zstandard frame of
``PLANE_BLOCK`` bytes of a plane.

Shards are written in ascending document order: the table is range-partitioned
and sorted by id, each task writes the files of its range into the shared folder
under a name fixed by range and part, whole or not at all, so that a repeated
task writes the same file again.

Defined cases: a null or empty text is the end id alone; rows that repeat follow
each other, ordered by text hash; a null id sorts first; an empty table writes
nothing and gives an empty table; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import io
import json
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import bytesops as B
from tessella.llm.shared import filesystem, fresh_path, materialize, write_once
from tessella.llm.tokens import encoder, tokenizer_path

MAGIC = b"TWM2"
BLOCK = 4096  # bits between two entries of a directory
PLANE_BLOCK = 16 << 10  # bytes of a plane in one frame
STEP = 1 << 15  # positions that are undone together, in the cache
HELD_BLOCKS = 256
SHARD_TOKENS = 8_000_000
END_ID = 2


class StoredPlane:
    """A plane's bytes in an open file; slices read and unpack only the blocks they touch."""

    def __init__(self, shard: Shard, level: int, size: int):
        self.shard, self.level, self.size = shard, level, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> np.ndarray:
        a, b, _ = at.indices(self.size)
        first, last = a // PLANE_BLOCK, max(a, b - 1) // PLANE_BLOCK
        parts = [self.shard.block(self.level, i) for i in range(first, last + 1)] if b > a else [np.zeros(0, np.uint8)]
        whole = parts[0] if len(parts) == 1 else np.concatenate(parts)
        return whole[a - first * PLANE_BLOCK : b - first * PLANE_BLOCK] if b > a else whole


class WaveletMatrix:
    def __init__(self, n: int, planes: list, zeros: list[int], directories: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.directories = n, planes, zeros, directories

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, zeros, directories = [], [], []
        for k in range(bits - 1, -1, -1):
            plane = np.packbits(cur & cur.dtype.type(1 << k) != 0, bitorder="little")
            planes.append(plane)
            whole = np.zeros(-(-len(plane) // (BLOCK // 8)) * (BLOCK // 8), np.uint8)
            whole[: len(plane)] = np.bitwise_count(plane)
            blocks = whole.reshape(-1, BLOCK // 8).sum(1, dtype=np.uint32)
            directories.append(np.concatenate([[0], np.cumsum(blocks)]).astype(np.uint32))
            # A plane is an Arrow bitmap as it is.
            held = pa.Array.from_buffers(pa.from_numpy_dtype(cur.dtype), len(cur), [None, pa.py_buffer(cur)])
            ones = pa.Array.from_buffers(pa.bool_(), len(cur), [None, pa.py_buffer(plane)])
            low = held.filter(pc.invert(ones)).to_numpy()
            zeros.append(len(low))
            cur = np.concatenate([low, held.filter(ones).to_numpy()])
        return cls(len(ids), planes, zeros, directories)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position i."""
        b = i // BLOCK
        part = np.unpackbits(self.planes[level][b * BLOCK // 8 : -(-i // 8)], count=i - b * BLOCK, bitorder="little") if i % BLOCK else ()
        return int(self.directories[level][b]) + int(np.sum(part))

    def _bit(self, level: int, i: int) -> int:
        return int(self.planes[level][i >> 3 : (i >> 3) + 1][0] >> (i & 7) & 1)

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out, i = out << 1 | bit, zeros + ones if bit else i - ones
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the symbol's occurrences before i lie after the last plane."""
        a = 0
        if symbol >> len(self.zeros):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            one = symbol >> (len(self.zeros) - 1 - level) & 1
            x, y = self._ones(level, a), self._ones(level, i)
            a, i = (zeros + x, zeros + y) if one else (a - x, i - y)
        return a, i

    def rank(self, symbol: int, i: int) -> int:
        a, b = self._range(symbol, i)
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The position of the k-th occurrence, k from 0; -1 if there is none."""
        a, b = self._range(symbol, self.n)
        if not 0 <= k < b - a:
            return -1
        i = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            one, zeros = i >= self.zeros[level], self.zeros[level]
            i = self._find(level, i - zeros if one else i, one)
        return i

    def _find(self, level: int, k: int, one: bool) -> int:
        """The position of the k-th one (or zero) of a plane."""
        d = self.directories[level].astype(np.int64)
        before = d if one else np.minimum(np.arange(len(d)) * BLOCK, self.n) - d
        b = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[level][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")[: self.n - b * BLOCK]
        return b * BLOCK + int(np.flatnonzero(bits == one)[k - int(before[b])])

    def to_array(self) -> np.ndarray:
        """All ids, by undoing the planes' partitions from the lowest."""
        kind = np.uint16 if len(self.zeros) <= 16 else np.uint32
        cur = np.zeros(self.n, kind)
        for level in range(len(self.zeros) - 1, -1, -1):
            plane, low, high = self.planes[level][:], 0, self.zeros[level]
            cur[high:] |= kind(1 << (len(self.zeros) - 1 - level))
            out = np.empty(self.n, kind)
            for a in range(0, self.n, STEP):
                bit = np.unpackbits(plane[a // 8 : (a + STEP) // 8], count=min(STEP, self.n - a), bitorder="little").view(bool)
                at = np.concatenate([np.flatnonzero(~bit), np.flatnonzero(bit)])
                n1 = int(np.count_nonzero(bit))
                n0 = len(bit) - n1
                out[a : a + STEP][at] = np.concatenate([cur[low : low + n0], cur[high : high + n1]])
                low, high = low + n0, high + n1
            cur = out
        return cur


def dump(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> list[bytes]:
    import zstandard

    wm, pack = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    null = np.array([x is None for x in doc_ids], bool)
    blocks = [pack(p[a : a + PLANE_BLOCK].tobytes()) for p in wm.planes for a in range(0, len(p), PLANE_BLOCK)]
    directories = np.concatenate(wm.directories).astype("<u4")
    offsets = np.append(0, np.cumsum([len(b) for b in blocks], dtype=np.int64)).astype("<i8")
    head = [np.array([x or 0 for x in doc_ids], "<i8"), np.packbits(null), np.asarray(lengths, "<i8"), directories]
    stored = [pack(x.tobytes()) for x in head]
    # The offsets' own frame comes before what they point at: they are from the first block.
    stored.append(pack(offsets.tobytes()))
    ends = np.cumsum([len(x) for x in stored])
    places = [[int(e - len(x)), len(x)] for e, x in zip(ends, stored)]
    header = json.dumps({"n": wm.n, "bits": len(wm.zeros), "zeros": wm.zeros, "docs": len(doc_ids), "sections": places}).encode()
    return [MAGIC, np.array([len(header)], "<u4").tobytes(), header, *stored, *blocks]


class Shard:
    """An open shard: ``matrix``, ``doc_ids``, ``lengths``; planes stay in the file until asked for."""

    def __init__(self, file):
        import zstandard

        self._file, self._unpack = file, zstandard.ZstdDecompressor().decompress
        if self._at(0, 4) != MAGIC:
            raise ValueError("not a wavelet shard")
        size = int(np.frombuffer(self._at(4, 4), "<u4")[0])
        h, base = json.loads(self._at(8, size)), 8 + size
        part = [self._unpack(self._at(base + a, n)) for a, n in h["sections"]]
        null = np.unpackbits(np.frombuffer(part[1], np.uint8), count=h["docs"]).astype(bool)
        self.doc_ids = [None if x else int(i) for i, x in zip(np.frombuffer(part[0], "<i8"), null)]
        self.lengths = np.frombuffer(part[2], "<i8")
        directories = np.split(np.frombuffer(part[3], "<u4"), h["bits"])
        self._offsets = np.frombuffer(part[4], "<i8") + base + sum(h["sections"][-1])
        self._per_plane = (len(self._offsets) - 1) // h["bits"]
        self._held: OrderedDict[int, np.ndarray] = OrderedDict()
        self.blocks_read = 0
        planes = [StoredPlane(self, k, -(-h["n"] // 8)) for k in range(h["bits"])]
        self.matrix = WaveletMatrix(h["n"], planes, h["zeros"], directories)

    @classmethod
    def open(cls, uri: str) -> Shard:
        fs, path = filesystem(uri)
        return cls(fs.open_input_file(path))

    def _at(self, start: int, n: int) -> bytes:
        self._file.seek(start)
        return self._file.read(n)

    def block(self, level: int, i: int) -> np.ndarray:
        k = level * self._per_plane + i
        if k in self._held:
            self._held.move_to_end(k)
        else:
            a, b = int(self._offsets[k]), int(self._offsets[k + 1])
            self._held[k] = np.frombuffer(self._unpack(self._at(a, b - a)), np.uint8)
            self.blocks_read += 1
            if len(self._held) > HELD_BLOCKS:
                self._held.popitem(last=False)
        return self._held[k]

    def close(self) -> None:
        self._file.close()


def load(raw: bytes) -> tuple[WaveletMatrix, list, np.ndarray]:
    """(matrix, document ids, their token counts) of a file's bytes."""
    shard = Shard(io.BytesIO(raw))
    return shard.matrix, shard.doc_ids, shard.lengths


def write_shards(docs: DataFrame, out: str, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards; the manifest: shard, part, path, n_docs, n_tokens (materialised)."""
    path = path or tokenizer_path()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").withColumn("_rid", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "_rid").sortWithinPartitions("doc_id", "_rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part, names, sizes, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            nonlocal part, names, sizes, held, size
            lengths = np.concatenate(sizes)
            name = f"{out}/shard-{shard:06d}-{part:04d}.twm"
            write_once(name, dump(np.concatenate(held), names, lengths))
            row = pa.record_batch([[shard], [part], [name], [len(names)], [int(lengths.sum())]], ["shard", "part", "path", "n_docs", "n_tokens"])
            part, names, sizes, held, size = part + 1, [], [], [], 0
            B.trim()
            return row

        for batch in batches:
            for a, b, ids, at in encoder(path).column(batch.column(1), END_ID):
                own, i = batch.column(0).slice(a, b - a).to_pylist(), 0
                while i < len(own):  # whole documents up to the one that fills the shard
                    j = min(len(own), max(i + 1, int(np.searchsorted(at, at[i] + shard_tokens - size, "left"))))
                    names += own[i:j]
                    sizes.append(np.diff(at[i : j + 1]))
                    held.append(ids[at[i] : at[j]])
                    size += int(at[j] - at[i])
                    i = j
                    if size >= shard_tokens:
                        yield flush()
        if names:
            yield flush()

    return materialize(rows.mapInArrow(run, "shard long, part long, path string, n_docs long, n_tokens long"), "wavelet-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "base").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard.open(path)
                ids, lengths = shard.doc_ids, shard.lengths
                raw = memoryview(shard.matrix.to_array().astype("<u4")).cast("B")
                shard.close()
                del shard
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch(
                    [pa.array(ids, pa.int64()), pa.array(base + starts), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                del raw
                B.trim()

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs, fresh_path(spark, "wavelet")))
