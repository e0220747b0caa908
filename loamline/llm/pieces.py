"""SentencePiece encoding by suffix-array matching, and decoding.

The new words of a batch are laid out one after the other; a suffix array over them, as deep as the longest
piece, is searched by bisection for every piece of the vocabulary; each range of it gives the occurrences
of a piece.  These edges are sorted by where they end and relaxed from left to right.

The vocabulary at hand is a byte-pair one, whose encoding is not the path of the largest score.  It has a
property that serves as well: exactly one piece ends the encoding of each prefix, namely the one that may
follow the piece before it (undoing the merges of both finds no merge across their border that would have
come first).  So an edge is relaxed if it may follow the piece that ends where it starts, and the ids are
those of the sentencepiece library, which the tests compare.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Words whose ids a worker remembers, twice: a full young memory becomes the old one.
REMEMBERED = 300_000
#: Characters of text that are encoded at once.
BATCH_CHARS = 4_000_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_CACHE_BITS = 21


class PieceModel:
    """A byte-pair SentencePiece model, read through the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        normal = []
        for i, p in enumerate(names):
            if m.is_byte(i):
                self.byte[int(p[3:-1], 16)] = i
                self.bytes_of.append(bytes([int(p[3:-1], 16)]))
            elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.bytes_of.append(p.replace(SPACE, " ").encode())
                normal.append(i)
        # ranks: single characters first, then pieces in the order in which they are merged
        chars = [i for i in normal if len(names[i]) == 1]
        rest = sorted((i for i in normal if len(names[i]) > 1), key=lambda i: (-m.get_score(i), i))
        self.id_of = np.array(chars + rest, np.int32)
        text = [names[i] for i in self.id_of.tolist()]
        rank = {p: r for r, p in enumerate(text)}
        if any(c not in rank for p in text for c in p):
            raise ValueError("every character of a piece must be a piece")
        self.length = np.array([len(p) for p in text], np.int64)
        self.deep = int(self.length.max())
        self.symbol = np.zeros(0x110000, ">u2")
        for r in range(len(chars)):
            self.symbol[ord(text[r])] = r + 1
        # the last merge of each piece; a piece that its own text doesn't encode to is never used
        self.left = np.arange(len(text), dtype=np.int64)
        self.right = np.arange(len(text), dtype=np.int64)
        self.used = np.ones(len(text), bool)
        for r in range(len(chars), len(text)):
            parts = list(text[r])
            while len(parts) > 2:
                best, at = min(((rank.get(parts[k] + parts[k + 1], 1 << 30), k) for k in range(len(parts) - 1)))
                if best == 1 << 30:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                self.left[r], self.right[r] = rank[parts[0]], rank[parts[1]]
            else:
                self.used[r] = False
        merged = np.flatnonzero((self.left != np.arange(len(text))) & self.used)
        keys = self.left[merged] * len(text) + self.right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], merged[order]
        # search bounds of every piece, as fixed-width big-endian strings of symbols
        low = np.zeros((len(text), self.deep), ">u2")
        high = np.full((len(text), self.deep), 0xFFFF, ">u2")
        for r, p in enumerate(text):
            s = self.symbol[[ord(c) for c in p]]
            low[r, : len(p)] = s
            high[r, : len(p)] = s
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{2 * self.deep}").ravel() for x in (low, high))
        # words may be cut between letters and other signs if no piece holds both
        mixed = re.compile(f"[{_LETTERS}][^{_LETTERS}]|[^{_LETTERS}{SPACE}][{_LETTERS}]|[^{SPACE}]{SPACE}")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in text):
            self.cut = None
        elif any(mixed.search(p) for p in text):
            self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.cut = re.compile(f"{SPACE}*[{_LETTERS}]+|{SPACE}*[^{_LETTERS}{SPACE}]+|{SPACE}+")

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether byte-pair merging leaves the pieces a and b (ranks) side by side."""
        n, most = len(self.length), np.int64(1 << 40)
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), most)
        out = np.zeros(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            key = x * n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            merges = (self.pair_keys[at] == key) & (self.pair_rank[at] < top)
            live, x, y = live[~merges], x[~merges], y[~merges]
            lx, ry = self.right[x], self.left[y]  # what is next to the border once a merge is undone
            base_x, base_y = lx == x, ry == y
            # undo the later merge; a single character has none
            first = ((x > y) & ~base_x) | ((x <= y) & base_y)
            ends = base_x & base_y
            out[live[ends]] = True
            a[live] = np.where(first, lx, x)
            b[live] = np.where(first, y, ry)
            limit[live] = np.where(first, x, y + 1)
            live = live[~ends]
        return out


class PieceEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.model = PieceModel(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pair_seen = np.full(1 << _CACHE_BITS, -1, np.int64)
        self.pair_ok = np.zeros(1 << _CACHE_BITS, bool)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``may_follow`` with a direct-mapped memory of pairs."""
        key = a * len(self.model.length) + b
        slot = ((key * np.int64(0x9E3779B97F4A7C1 | 1)) >> np.int64(24)) & np.int64((1 << _CACHE_BITS) - 1)
        ok = self.pair_ok[slot]
        miss = np.flatnonzero(self.pair_seen[slot] != key)
        if len(miss):
            ok[miss] = self.model.may_follow(a[miss], b[miss])
            self.pair_seen[slot[miss]] = key[miss]
            # equal slots of one assignment: the last key and the last answer are both kept
            self.pair_ok[slot[miss]] = ok[miss]
        return ok

    def _edges(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, rank) of every occurrence of every piece in the laid out words."""
        m = self.model
        padded = np.concatenate([symbols, np.zeros(m.deep, ">u2")]).astype(">u2")
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, m.deep)[: len(symbols)])
        keys = windows.view(f"S{2 * m.deep}").ravel()
        suffixes = np.argsort(keys)
        keys = keys[suffixes]
        low, high = np.searchsorted(keys, m.low), np.searchsorted(keys, m.high, "right")
        count = np.where(m.used, high - low, 0)
        rank = np.repeat(np.arange(len(count)), count)
        at = np.arange(len(rank)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return suffixes[at], rank

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, none of which merges with another."""
        m = self.model
        points = np.frombuffer("\0".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        size = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum(size + 1) - size - 1
        symbols = m.symbol[points]
        symbols[first[1:] - 1] = 0
        start, rank = self._edges(symbols)
        # runs of known characters; other characters stand alone between them
        inside = symbols != 0
        index = np.arange(len(symbols))
        fresh = inside & np.concatenate([[True], ~inside[:-1]])
        fresh[first[size > 0]] |= inside[first[size > 0]]
        begin = np.maximum.accumulate(np.where(fresh, index, 0))
        end = start + m.length[rank]
        depth = end - begin[start]
        order = np.lexsort((start, end, depth))
        start, rank, end, depth = start[order], rank[order], end[order], depth[order]
        last = np.full(len(symbols) + 1, -1, np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(depth)) + 1, [len(depth)]]) if len(depth) else np.zeros(1, np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            s, r, e = start[lo:hi], rank[lo:hi], end[lo:hi]
            # longest edges first; an end that is reached needs no other edge
            whole = fresh[s]
            last[e[whole]] = r[whole]
            s, r, e = s[~whole], r[~whole], e[~whole]
            while len(s):
                # a valid edge into a run's whole prefix may still be refused: then others decide
                head = np.concatenate([[True], e[1:] != e[:-1]])
                ok = self._may_follow(last[s[head]], r[head])
                reached = e[head][ok]
                last[reached] = r[head][ok]
                s, r, e = s[~head], r[~head], e[~head]
                if len(reached) and len(s):
                    left = ~np.isin(e, reached, assume_unique=False)
                    s, r, e = s[left], r[left], e[left]
        # back from the end of every word
        at = first + size
        who = np.flatnonzero(size > 0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            p = at[who]
            known = inside[p - 1]
            r = last[p]
            token = np.where(known, m.id_of[np.maximum(r, 0)], -1 - points[p - 1].astype(np.int64))
            found.append((who, token))
            at[who] = p - np.where(known, m.length[np.maximum(r, 0)], 1)
            who = who[at[who] > first[who]]
        word = np.concatenate([w for w, _ in found]) if found else np.empty(0, np.int64)
        token = np.concatenate([t for _, t in found]) if found else np.empty(0, np.int64)
        turn = np.repeat(np.arange(len(found)), [len(w) for w, _ in found])
        order = np.lexsort((-turn, word))
        word, token = word[order], token[order]
        cut = np.searchsorted(word, np.arange(len(words) + 1))
        flat = token.astype("<i4").tobytes()
        other = set(word[token < 0].tolist())
        out = []
        for k, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            if k in other:
                ids: list[int] = []
                for t in token[lo:hi].tolist():
                    ids += [t] if t >= 0 else [m.byte[b] for b in chr(-1 - t).encode("utf-8", "replace")]
                out.append(np.array(ids, "<i4").tobytes())
            else:
                out.append(flat[4 * lo : 4 * hi])
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > self.remembered:
            self.old, self.known = self.known, {}
        cut = self.model.cut
        laid = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        split = [cut.findall(t) if cut else [t] for t in laid]
        seen: set[str] = set()
        for words in split:
            seen.update(words)
        new = []
        for w in [w for w in seen if w not in self.known]:
            if (ids := self.old.get(w)) is None:
                new.append(w)
            else:
                self.known[w] = ids
        for at in range(0, len(new), 100_000):
            part = new[at : at + 100_000]
            self.known.update(zip(part, self._words(part)))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before a text by encoding is taken off."""
        text = b"".join(map(self.model.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_encoders: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) in lists of about BATCH_CHARS characters; null counts as empty."""
    part, chars, at = [], 0, 0
    for k, t in enumerate(texts):
        part.append(t or "")
        chars += len(part[-1])
        if chars >= BATCH_CHARS:
            yield at, part
            part, chars, at = [], 0, k + 1
    if part:
        yield at, part


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (doc_id, if None) and ids, the whole text as array of piece ids.

    Null and empty texts have no ids.  Characters without a piece become byte pieces.  Rows are independent,
    so repeated rows and empty tables need no care.  Memory is that of a few million characters, or of the longest
    unbroken word: about 100 bytes for each of its characters.
    """
    picked = docs.select(*(keep or [F.col("doc_id")]), F.col(text).alias("_text"))
    out = T.StructType([*picked.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(model_path)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo in range(0, b.num_rows, 500):
                for at, part in _parts(texts.slice(lo, 500).to_pylist()):
                    ids = coder.encode(part)
                    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                    col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                    rest = b.slice(lo + at, len(part)).columns[:-1]
                    yield pa.RecordBatch.from_arrays([*rest, col], names=out.names)

    return picked.mapInArrow(run, out)


def encode_and_check(docs: DataFrame, model_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as little-endian 32-bit integers), text_crc32 of the decoded text and same.

    ``same`` tells whether decoding gave the text back; it doesn't if the text holds U+2581, the sign for a space.
    """
    picked = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_encoder(model_path)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                for at, part in _parts(b.column(1).slice(lo, 500).to_pylist()):
                    ids = coder.encode(part)
                    back = [coder.decode(i) for i in ids]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).slice(lo + at, len(part)),
                            pa.array([len(i) for i in ids], pa.int64()),
                            pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()),
                            pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()),
                            pa.array([t == p for t, p in zip(back, part)], pa.bool_()),
                        ],
                        names=["doc_id", "n_pieces", "ids_crc32", "text_crc32", "same"],
                    )

    return picked.mapInArrow(run, "doc_id bigint, n_pieces bigint, ids_crc32 bigint, text_crc32 bigint, same boolean")
