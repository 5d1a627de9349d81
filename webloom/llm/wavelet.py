"""Token ids as wavelet matrices: bit-planes with rank and select, one compressed file a shard."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from .common import bound_batches, id_column, slices
from .language_id import TOKENIZERS
from .tokens import Words, processor

MAGIC = b"WVM1"
BLOCK = 1 << 15  # bytes of a plane that are compressed together
SUPER = 512  # bits from one entry of the rank directory to the next


def build(ids: np.ndarray, starts: np.ndarray, bits: int, level: int = 1, names: list | None = None) -> bytes:
    """The file of a sequence of ids under 2 ** bits. starts: where each document begins, and the length; names: the documents' ids.

    Layout: magic, length of the header, header (JSON: length, bits, zeros of each plane, sizes of the parts), then document
    starts and ids, rank directories and plane blocks, each compressed alone, so that an access reads only the blocks that it touches.
    """
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    n = len(seq)
    pack = zstandard.ZstdCompressor(level=level)
    parts: list[bytes] = [pack.compress(starts.astype("<i8").tobytes()), pack.compress(json.dumps(names or [], default=str).encode())]
    zeros, sizes = [], []
    for b in range(bits - 1, -1, -1):
        one = (seq & seq.dtype.type(1 << b)) != 0
        plane = np.packbits(one, bitorder="little")
        pad = np.zeros(-len(plane) % (SUPER // 8), np.uint8)
        counts = np.bitwise_count(np.concatenate([plane, pad]).view(np.uint64)).reshape(-1, SUPER // 64).sum(axis=1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(counts)]).astype("<u4")
        raw = plane.tobytes()
        blocks = [pack.compress(raw[i : i + BLOCK]) for i in range(0, len(raw), BLOCK)]
        folded = pack.compress(directory.tobytes())
        sizes.append([len(folded), [len(x) for x in blocks]])
        parts += [folded, *blocks]
        zeros.append(int(n - np.count_nonzero(one)))
        seq = np.concatenate([seq.compress(~one), seq.compress(one)])
    header = json.dumps({"n": n, "bits": bits, "zeros": zeros, "starts": len(parts[0]), "names": len(parts[1]), "sizes": sizes}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *parts])


class WaveletMatrix:
    """Reads such a file. Blocks are decompressed when first touched."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        size = struct.unpack("<I", payload[4:8])[0]
        head = json.loads(payload[8 : 8 + size])
        self.n, self.bits, self.zeros, self.payload = head["n"], head["bits"], head["zeros"], payload
        self.unpack = zstandard.ZstdDecompressor()
        at = 8 + size
        self.starts = np.frombuffer(self.unpack.decompress(payload[at : at + head["starts"]]), "<i8")
        at += head["starts"]
        self.names: list = json.loads(self.unpack.decompress(payload[at : at + head["names"]]))
        at += head["names"]
        self.places, self.directories, self.blocks = [], [], []
        for folded, blocks in head["sizes"]:
            self.directories.append(np.frombuffer(self.unpack.decompress(payload[at : at + folded]), "<u4"))
            edges = at + folded + np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
            self.places.append(edges)
            self.blocks.append({})
            at = int(edges[-1])

    def block(self, plane: int, i: int) -> np.ndarray:
        if i not in self.blocks[plane]:
            a, b = self.places[plane][i : i + 2]
            self.blocks[plane][i] = np.frombuffer(self.unpack.decompress(self.payload[int(a) : int(b)]), np.uint8)
        return self.blocks[plane][i]

    def bit(self, plane: int, i: int) -> int:
        return int(self.block(plane, i // 8 // BLOCK)[i // 8 % BLOCK]) >> (i % 8) & 1

    def rank1(self, plane: int, i: int) -> int:
        """Ones of the plane before place i."""
        count, at = int(self.directories[plane][i // SUPER]), i // SUPER * SUPER
        if at < i:
            first, last = at // 8, i // 8
            part = self.block(plane, first // BLOCK)[first % BLOCK : first % BLOCK + last - first]
            count += int(np.bitwise_count(part).sum())
            if i % 8:
                byte = int(self.block(plane, last // BLOCK)[last % BLOCK])
                count += (byte & ((1 << i % 8) - 1)).bit_count()
        return count

    def select(self, plane: int, k: int, one: bool) -> int:
        """Place of the k-th (from 0) one or zero of the plane."""
        d = self.directories[plane].astype(np.int64)
        if not one:
            d = np.arange(len(d)) * SUPER - d
        s = int(np.searchsorted(d, k, side="right")) - 1
        k -= int(d[s])
        at, end = s * SUPER, min((s + 1) * SUPER, self.n)
        first = at // 8
        part = self.block(plane, first // BLOCK)[first % BLOCK : first % BLOCK + -(-(end - at) // 8)]
        bits = np.unpackbits(part, bitorder="little")[: end - at]
        return at + int(np.flatnonzero(bits == int(one))[k])

    def access(self, i: int) -> int:
        """The token at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            ones = self.rank1(plane, i)
            bit = self.bit(plane, i)
            value = value << 1 | bit
            i = self.zeros[plane] + ones if bit else i - ones
        return value

    def span(self, token: int, start: int, end: int) -> tuple[int, int]:
        """Where the token's occurrences from start to end stand under the last plane."""
        for plane in range(self.bits):
            a, b = self.rank1(plane, start), self.rank1(plane, end)
            if token >> (self.bits - 1 - plane) & 1:
                start, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                start, end = start - a, end - b
        return start, end

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before place end."""
        return self.count(token, 0, end)

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of the token from start to end."""
        if not 0 <= token < 1 << self.bits:
            return 0
        a, b = self.span(token, start, self.n if end is None else end)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of the token."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self.span(token, 0, self.n)[0] + k
        for plane in range(self.bits - 1, -1, -1):
            if token >> (self.bits - 1 - plane) & 1:
                i = self.select(plane, i - self.zeros[plane], True)
            else:
                i = self.select(plane, i, False)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.locate(token, k) for k in range(self.count(token))]

    def document(self, d: int) -> list[int]:
        """The tokens of the d-th document of the shard."""
        return [self.access(i) for i in range(int(self.starts[d]), int(self.starts[d + 1]))]

    def tokens(self) -> np.ndarray:
        """All tokens, plane by plane."""
        value, place = np.zeros(self.n, np.uint32), np.arange(self.n)
        for plane in range(self.bits):
            raw = np.concatenate([self.block(plane, i) for i in range(len(self.places[plane]) - 1)] or [np.zeros(0, np.uint8)])
            bits = np.unpackbits(raw, bitorder="little")[: self.n]
            before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
            one = bits[place].astype(bool)
            value = value << np.uint32(1) | one
            place = np.where(one, self.zeros[plane] + before[place], place - before[place])
        return value


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, shard_tokens: int = 1 << 22, shard_docs: int = 1 << 20, level: int = 1) -> DataFrame:
    """One row for each shard: (shard_id, n_docs, n_tokens, doc_ids, doc_starts, payload); payload is the shard's file.

    A shard holds whole documents of one input partition, in their order, and is closed once it has shard_tokens tokens or shard_docs
    documents (so a document is never cut, and a very long one can make a longer shard). The file holds the documents' ids as well. shard_id is the partition's number and the shard's in
    it, so a task that is run again gives the same shards. Texts are read once, in place: no shuffle; a task holds one shard.

    Null and empty texts are documents of no tokens. Repeated rows are kept each. A null doc_id is null in doc_ids; ids may have any type. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = processor(tokenizers)
        words = Words(model)
        bits = max(1, int(model.get_piece_size() - 1).bit_length())
        number = TaskContext.get().partitionId() << 24
        ids, held, lengths, size, kind = [], [], [], 0, pa.int64()

        def close() -> pa.RecordBatch:
            nonlocal ids, held, lengths, size, number
            starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            whole = np.concatenate([np.zeros(0, np.uint32), *held])
            row = [[number], [len(ids)], [len(whole)], pa.array([ids], pa.list_(kind)), pa.array([starts[:-1].tolist()], pa.list_(pa.int64())), pa.array([build(whole, starts, bits, level, ids)], pa.binary())]
            number += 1
            ids, held, lengths, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in row], schema.names)

        for batch in batches:
            at, kind = 0, batch.column(0).type
            for part in slices(batch.column(1), 1 << 19):
                names = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                tokens, edges = words.encode(part.to_pylist())
                for name, a, b in zip(names, edges[:-1].tolist(), edges[1:].tolist()):
                    ids.append(name)
                    lengths.append(b - a)
                    held.append(tokens[a:b])
                    size += b - a
                    if size >= shard_tokens or len(ids) >= shard_docs:
                        yield close()
        if ids:
            yield close()

    bound_batches(docs.sparkSession)
    src = docs.select(id_column(docs, id_col).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = StructType.fromDDL("shard_id bigint, n_docs bigint, n_tokens bigint")
    schema.add("doc_ids", ArrayType(src.schema["doc_id"].dataType)).add("doc_starts", ArrayType(LongType())).add("payload", BinaryType())
    return src.mapInArrow(run, schema)


def save(found: DataFrame, folder: str) -> DataFrame:
    """Write each payload to folder/shard-<id>.wvm, by way of a temporary name, so that a repeated task does no harm; (shard_id, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            paths = []
            for number, payload in zip(batch.column("shard_id").to_pylist(), batch.column("payload").to_pylist()):
                path = f"{root}/shard-{number:015d}.wvm"
                with target.open_output_stream(f"{path}.{attempt}") as out:
                    out.write(payload)
                target.move(f"{path}.{attempt}", path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([batch.column("shard_id"), pa.array(paths, pa.string())], ["shard_id", "path"])

    return found.select("shard_id", "payload").mapInArrow(run, "shard_id bigint, path string")
