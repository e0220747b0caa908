"""WordPiece ids and ONNX embeddings, as Arrow-batched functions; the model is an optional file."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "ids array<bigint>, mask array<bigint>, type_ids array<bigint>"


def _punctuation(c: str) -> bool:
    return (33 <= ord(c) <= 47) or (58 <= ord(c) <= 64) or (91 <= ord(c) <= 96) or (123 <= ord(c) <= 126) or unicodedata.category(c).startswith("P")


class WordPiece:
    """A vocabulary of one piece per line; [CLS], [SEP] and [UNK] must be among them."""

    def __init__(self, pieces: list[str], max_length: int = 256):
        self.ids = {p.rstrip("\r"): i for i, p in enumerate(pieces) if p}
        missing = [p for p in ("[CLS]", "[SEP]", "[UNK]") if p not in self.ids]
        if missing:
            raise ValueError(f"the vocabulary lacks {', '.join(missing)}")
        self.max_length = max_length

    @classmethod
    def load(cls, path: str, max_length: int = 256) -> WordPiece:
        with open(path, encoding="utf-8") as f:
            return cls(f.read().split("\n"), max_length)

    def words(self, text: str) -> list[str]:
        """Decomposed, without accents and controls, lower case; punctuation stands alone.

        Controls, line breaks and tabs among them, are dropped before white space is looked at.
        """
        out, word = [], ""
        for c in unicodedata.normalize("NFD", text):
            kind = unicodedata.category(c)
            if kind in ("Mn", "Cc"):
                continue
            if c.isspace():
                out, word = out + [word] * bool(word), ""
            elif _punctuation(c):
                out, word = out + [word] * bool(word) + [c], ""
            else:
                word += c.lower()
        return out + [word] * bool(word)

    def pieces(self, word: str) -> list[int]:
        """The longest piece first, again and again; a word without a cover or of over 100 signs is unknown."""
        if len(word) > 100:
            return [self.ids["[UNK]"]]
        out, at = [], 0
        while at < len(word):
            for end in range(len(word), at, -1):
                got = self.ids.get(("##" if at else "") + word[at:end])
                if got is not None:
                    break
            else:
                return [self.ids["[UNK]"]]
            out.append(got)
            at = end
        return out

    def encode(self, text: str | None) -> list[int]:
        ids = [i for w in self.words(text or "") for i in self.pieces(w)][: self.max_length - 2]
        return [self.ids["[CLS]"], *ids, self.ids["[SEP]"]]


def wordpiece_column(text: Column, vocabulary: list[str], max_length: int = 256) -> Column:
    """struct(ids, mask, type_ids) for each text."""
    @F.pandas_udf(SCHEMA)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = WordPiece(vocabulary, max_length)
        for t in texts:
            ids = [coder.encode(x) for x in t]
            yield pd.DataFrame({"ids": ids, "mask": [[1] * len(i) for i in ids], "type_ids": [[0] * len(i) for i in ids]})

    return run(text)


def onnx_column(text: Column, model: str, vocabulary: list[str], dim: int, pooling: str = "mean", max_length: int = 256) -> Column:
    """Unit vectors of an ONNX encoder; one session per worker, one thread each; null where a text fails."""
    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import onnxruntime

        options = onnxruntime.SessionOptions()
        options.intra_op_num_threads = 1
        session = onnxruntime.InferenceSession(model, options)
        names = {i.name for i in session.get_inputs()}
        coder = WordPiece(vocabulary, max_length)

        def one(x: str) -> list[float] | None:
            ids = np.array([coder.encode(x)], np.int64)
            feed = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
            hidden = session.run(None, {k: v for k, v in feed.items() if k in names})[0][0][:, :dim]
            v = hidden.mean(0) if pooling == "mean" else hidden[0]
            size = float(np.linalg.norm(v))
            return (v / size if size else v).astype(float).tolist()

        for t in texts:
            yield pd.Series([one(x or "") for x in t])

    return run(text)
