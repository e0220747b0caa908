"""Token ids in a binary format of bit-plane shuffled blocks.

A shard holds documents in ascending id order.  The ids of all its documents, each ended by ``end_id``,
are cut into blocks of BLOCK_IDS; a block is transposed into its four byte planes, and every plane is
compressed with zstandard by itself, so that the almost empty high planes cost next to nothing.

Layout, little-endian: magic ``LTOK0001``, the compressed planes, then the index (zstandard: a table of
block offsets and plane lengths, then the document ids and lengths), its offset and length (two u64).
Null document ids are stored with a flag.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder

MAGIC = b"LTOK0001"
BLOCK_IDS = 1 << 16
PLANES = 4
LEVEL = 3
#: Slots for the ids of pieces that a worker remembers, half of them used; a full table is emptied.  About 100 MB.
SLOTS = 1 << 22
#: Long pieces are remembered by themselves.
LONG, MOST_LONG = 16, 50_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: A text with signs outside Latin, a space before white space or the end, or an empty line goes in whole.
_OTHER = re.compile(rf" (?:\s|\Z)|\n\n|[^ -~\n{_LETTERS}¡-¿]")
_SIGN, _LETTER, _SPACE, _LINE = 0, 1, 2, 3
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123), 0xC3, 0xC4, 0xC5]] = _LETTER
_KIND[32], _KIND[10] = _SPACE, _LINE


def _starts(data: np.ndarray) -> np.ndarray:
    """Where pieces begin in the bytes of plain texts that are joined by line breaks.

    The cuts are ones that the pre-tokenizer makes too: between letters and other signs, before a space,
    around a line break.  An apostrophe stays with what may be a contraction.
    """
    kind = _KIND[data]
    second = np.flatnonzero((data >= 0x80) & (data < 0xC0))
    kind[second] = kind[second - 1]
    for sign in (0x97, 0xB7):  # the two signs among the letters of U+00C0 to U+00FF
        at = second[(data[second] == sign) & (data[second - 1] == 0xC3)]
        kind[at] = kind[at - 1] = _SIGN
    quote = np.flatnonzero(data == 0x27)
    inner = quote[(quote > 0) & (quote < len(data) - 1)]
    kind[inner[(kind[inner - 1] == _LETTER) & (kind[inner + 1] == _LETTER)]] = _LETTER
    cut = np.ones(len(data), bool)
    before, now = kind[:-1], kind[1:]
    cut[1:] = (before != now) & (before != _SPACE) | (now == _LINE) | (before == _LINE)
    glued = quote[quote < len(data) - 1]
    cut[glued[(kind[glued] == _SIGN) & (kind[glued + 1] == _LETTER)] + 1] = False
    return np.flatnonzero(cut)


class WordEncoder:
    """Encodes whole texts with a file of the tokenizers library, remembering the ids of pieces.

    Every piece is encoded by the library, and the cuts between pieces are ones that its pre-tokenizer makes
    as well, so the ids are those of the whole text.  Pieces are compared by all their bytes.  Texts that hold
    the string of an added token are encoded as a whole, and so is every text if the file is no byte-level BPE
    with the pre-tokenizer that the cuts are made for.  ``special_as_text`` is the library's switch by which
    strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str, slots: int = SLOTS, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (t.special and special_as_text)]
        self.whole = _OTHER if not added else re.compile("|".join([_OTHER.pattern, *map(re.escape, added)]))
        kind = json.loads(self.tokenizer.to_str())
        cut = kind.get("pre_tokenizer") or {}
        fits = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        fits = fits and not any(kind.get(k) for k in ("normalizer", "truncation", "padding")) and kind["model"].get("type") == "BPE" and not kind["model"].get("dropout")
        if not fits:
            self.whole = re.compile("")
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.slots = slots
        self.low, self.high = np.zeros(slots, "<u8"), np.zeros(slots, "<u8")
        self.place, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.uint8)
        self.flat, self.filled, self.used = np.zeros(1 << 16, self.width), 0, 0
        self.long: dict[bytes, np.ndarray] = {}
        # between words, a line break is one id by itself: many pieces can then be encoded as one text
        alone = [self._whole([x])[0] for x in ("ab", "\n", " cd", "\n", ".", "\n")]
        self.line = int(alone[1][0]) if np.array_equal(self._whole(["ab\n cd\n.\n"])[0], np.concatenate(alone)) and len(alone[1]) == 1 else None

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has; a piece holds no line break, or is one."""
        if self.line is None:
            ids = self._whole([p.decode() for p in pieces])
            return np.concatenate(ids), np.array([len(i) for i in ids])
        ids = self._whole([b"\n".join(b"" if p == b"\n" else p for p in pieces).decode() + "\n"])[0]
        ends = np.flatnonzero(ids == self.line)
        count = np.diff(ends, prepend=-1) - 1
        lone = count == 0  # the line break itself
        keep = ids != self.line
        keep[ends[lone]] = True
        return ids[keep], np.where(lone, 1, count)

    def _find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, known) for each key: the slot that holds it, or the free one where it would go."""
        mixed = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = (mixed >> np.uint64(40)).astype(np.int64) & (self.slots - 1)
        known = np.zeros(len(low), bool)
        live = np.arange(len(low))
        while len(live):
            s = slot[live]
            taken = self.count[s] > 0
            same = taken & (self.low[s] == low[live]) & (self.high[s] == high[live])
            known[live[same]] = True
            live = live[taken & ~same]
            slot[live] = (slot[live] + 1) & (self.slots - 1)
        return slot, known

    def _learn(self, low: np.ndarray, high: np.ndarray, pieces: list[bytes]) -> None:
        """Put distinct new keys into the table."""
        for at in range(0, len(pieces), 4096):
            ids, count = self._pieces(pieces[at : at + 4096])
            if self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.width)])
            self.flat[self.filled : self.filled + len(ids)] = ids
            place = self.filled + np.cumsum(count) - count
            self.filled += len(ids)
            lo, hi = low[at : at + 4096], high[at : at + 4096]
            rest = np.arange(len(lo))
            while len(rest):
                slot, _ = self._find(lo[rest], hi[rest])
                free, first = np.unique(slot, return_index=True)
                own = rest[first]
                self.low[free], self.high[free], self.place[free], self.count[free] = lo[own], hi[own], place[own], count[own]
                rest = np.delete(rest, first)
        self.used += len(pieces)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        plain = [not self.whole.search(t) for t in texts]
        if not any(plain):
            return [self._whole([t])[0] for t in texts]
        joined = "\n".join(t if p else "" for t, p in zip(texts, plain)).encode() + b"\n"
        data = np.frombuffer(joined + bytes(LONG), np.uint8)
        n = len(joined)
        start = _starts(data[:n])
        length = np.diff(start, append=n)
        # the first 16 bytes of each piece as two integers; plain texts hold no zero bytes
        eight = np.lib.stride_tricks.as_strided(data.view("<u8")[:1] if len(data) % 8 == 0 else np.frombuffer(joined + bytes(LONG), "<u8", 1), (n + 8,), (1,))
        mask = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
        low = eight[start] & mask[np.minimum(length, 8)]
        high = eight[start + 8 * (length > 8)] & mask[np.clip(length - 8, 0, 8)]
        if self.used > self.slots // 2:
            self.count[:] = 0
            self.filled = self.used = 0
        short = length <= LONG
        slot, known = self._find(low, high)
        new = np.flatnonzero(short & ~known)
        if len(new):
            order = np.lexsort((high[new], low[new]))
            new = new[order]
            first = np.concatenate([[True], (low[new][1:] != low[new][:-1]) | (high[new][1:] != high[new][:-1])])
            distinct = new[first]
            self._learn(low[distinct], high[distinct], [joined[a : a + k] for a, k in zip(start[distinct].tolist(), length[distinct].tolist())])
            slot[new], _ = self._find(low[new], high[new])
        place, count = self.place[slot].astype(np.int64), self.count[slot].astype(np.int64)
        flat = self.flat
        far = np.flatnonzero(~short)
        if len(far):
            keys = [joined[a : a + k] for a, k in zip(start[far].tolist(), length[far].tolist())]
            fresh = list({k for k in keys if k not in self.long})
            if len(self.long) + len(fresh) > MOST_LONG:
                self.long, fresh = {}, list(set(keys))
            self.long.update(zip(fresh, self._whole([k.decode() for k in fresh])))
            ids = [self.long[k] for k in keys]
            count[far] = [len(i) for i in ids]
            place[far] = self.filled + np.cumsum(count[far]) - count[far]
            flat = np.concatenate([flat[: self.filled], *ids])
        done = np.cumsum(count)
        all_ids = flat[np.arange(done[-1]) + np.repeat(place - done + count, count)]
        # the piece that ends each text is the line break put behind it
        sizes = np.fromiter((len(t.encode()) if p and not t.isascii() else len(t) if p else 0 for t, p in zip(texts, plain)), np.int64, len(texts))
        break_at = np.searchsorted(start, np.cumsum(sizes + 1) - 1)
        ends = done[break_at] - count[break_at]
        begins = np.concatenate([[0], done[break_at][:-1]])
        return [all_ids[b:e] if p else self._whole([t])[0] for t, p, b, e in zip(texts, plain, begins.tolist(), ends.tolist())]


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Writes one shard; memory is one block and the index."""

    def __init__(self, uri: str):
        self.fs, self.path = _open(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.pending, self.held = [], 0
        self.blocks, self.ids, self.lengths = [], [], []
        self.pack = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS * 4:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data = b"".join(self.pending)
        step = BLOCK_IDS * 4
        end = len(data) if last else len(data) // step * step
        for at in range(0, end, step):
            block = np.frombuffer(data, np.uint8, min(step, end - at), at).reshape(-1, PLANES)
            planes = [self.pack.compress(block[:, p].tobytes()) for p in range(PLANES)]
            self.blocks.append([self.at, len(block), *map(len, planes)])
            for p in planes:
                self.out.write(p)
                self.at += len(p)
        self.pending, self.held = [data[end:]], len(data) - end

    def close(self) -> None:
        self._flush(True)
        none = np.array([i is None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        index = struct.pack("<QQ", len(self.blocks), len(ids)) + np.array(self.blocks, "<u8").tobytes() + ids.tobytes() + none.tobytes() + np.array(self.lengths, "<u8").tobytes()
        packed = self.pack.compress(index)
        self.out.write(packed)
        self.out.write(struct.pack("<QQ", self.at, len(packed)))
        self.out.close()


def read_shard(uri: str) -> Iterator[tuple[int | None, Iterator[bytes], int]]:
    """(document id, its ids in pieces of at most a block, how many) for each document, in order."""
    files, path = _open(uri)
    unpack = zstandard.ZstdDecompressor()
    with files.open_input_file(path) as f:
        size = f.size()
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        f.seek(size - 16)
        at, length = struct.unpack("<QQ", f.read(16))
        f.seek(at)
        index = unpack.decompress(f.read(length))
        n_blocks, n_docs = struct.unpack_from("<QQ", index)
        at = 16
        blocks = np.frombuffer(index, "<u8", n_blocks * (2 + PLANES), at).reshape(-1, 2 + PLANES)
        at += blocks.nbytes
        ids = np.frombuffer(index, "<i8", n_docs, at)
        none = np.frombuffer(index, np.uint8, n_docs, at + ids.nbytes)
        lengths = np.frombuffer(index, "<u8", n_docs, at + ids.nbytes + n_docs)

        def unpacked() -> Iterator[bytes]:
            for offset, n, *sizes in blocks.tolist():
                f.seek(offset)
                planes = np.empty((n, PLANES), np.uint8)
                for p, s in enumerate(sizes):
                    planes[:, p] = np.frombuffer(unpack.decompress(f.read(s)), np.uint8)
                yield planes.tobytes()

        source, held, used = unpacked(), b"", 0

        def pieces(n: int) -> Iterator[bytes]:
            nonlocal held, used
            while n:
                if used == len(held):
                    held, used = next(source), 0
                part = held[used : used + 4 * n]
                used += len(part)
                n -= len(part) // 4
                yield part

        for i, gone, n in zip(ids.tolist(), none.tolist(), lengths.tolist()):
            got = pieces(n)
            yield (None if gone else i), got, n
            for _ in got:  # what the caller left
                pass


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, text: str = "text", id_col: str = "doc_id", special_as_text: bool = False
) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shards in ascending id order.

    Returns (shard, uri, n_docs, n_tokens, start) with the number of ids in all shards before; one row per
    shard.  A null text counts as empty; null ids come first; rows with equal ids are ordered by text.
    An empty table gives no shard.  A file carries the number of its attempt, and only those of attempts that
    came to their end are returned, so tasks may be run again.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, writer, tokens, docs_in = TaskContext.get(), None, 0, 0
        uri = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}.ltok"
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0).to_pylist()
            for at in range(0, len(ids), 1000):
                if writer is None:
                    writer = ShardWriter(uri)
                for i, packed in zip(ids[at : at + 1000], _encoder(tokenizer_path, special_as_text).encode(texts.slice(at, 1000).to_pylist())):
                    writer.add(i, packed.astype("<u4").tobytes() + end)
                    tokens += len(packed) + 1
                    docs_in += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([uri]), pa.array([docs_in]), pa.array([tokens])], names=["shard", "uri", "n_docs", "n_tokens"])

    shards = ordered.mapInArrow(write, "shard bigint, uri string, n_docs bigint, n_tokens bigint")
    # one row per shard: as many as there are partitions
    rows = sorted(map(tuple, shards.collect()))
    starts, total = [], 0
    for r in rows:
        starts.append((*r, total))
        total += r[3]
    return spark.createDataFrame(starts, "shard bigint, uri string, n_docs bigint, n_tokens bigint, start bigint")


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def _encoder(path: str, special_as_text: bool) -> WordEncoder:
    key = (path, special_as_text)
    if key not in _encoders:
        _encoders[key] = WordEncoder(path, special_as_text=special_as_text)
    return _encoders[key]


def read_token_files(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards, read from the files block by block."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                for i, pieces, n in read_shard(uri):
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p, crc)
                    rows.append((i, start, n, crc))
                    start += n
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("uri", "start").repartition(n, "uri").mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
