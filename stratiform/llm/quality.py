"""Quality scores from compressed sizes under two zstandard dictionaries.

A dictionary is built from texts labelled good and another from texts labelled bad. A text is compressed with each in pieces of
`piece` bytes, so that a long text does not become its own dictionary. The difference of the two sizes over the text's own size becomes a score by a logistic
calibration that holds the label shares of the training rows. EVIDENCE bytes are added to the size and the share size / (size + EVIDENCE) is the
calibration's other term: a text of a few bytes compresses alike with both and stays near the label share; from some kilobytes
on that share is 1 and the difference alone tells.

Nulls and empty texts get the calibrated score of an empty text; very long texts are compressed whole, piece by piece. A repeated row
is scored each time, equal texts alike. With no training rows of one label every score is the share of label 1 (0.5 without any label). An
empty table gives an empty result. Other columns, whatever their names, may be kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, fit_logistic, fold, give_back, labelled_sample, logistic, named, unused

PER_LABEL, MAX_CHARS, DICT_BYTES, LEVEL, PIECE, EVIDENCE = 2048, 20_000, 262_144, 3, 512, 300


def build_dictionary(texts: list[str], size: int, piece: int) -> bytes:
    """A trained dictionary, or the texts themselves where there are too few to train on."""
    parts = [b[i : i + piece] for b in (t.encode("utf-8", "surrogatepass") for t in texts) for i in range(0, len(b), piece)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(parts)[:size]


class Sizer:
    """Compressed sizes of a text with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, level: int, piece: int):
        kw = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.good, self.bad = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **kw) if d else zstandard.ZstdCompressor(**kw) for d in (good, bad))
        self.piece = piece

    def features(self, text: str | None) -> tuple[float, float]:
        """The normalised size difference, and the share that the text has of its size and EVIDENCE."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        good, bad = (sum(len(c.compress(x)) for x in pieces) for c in (self.good, self.bad))
        return (bad - good) / (len(raw) + EVIDENCE), len(raw) / (len(raw) + EVIDENCE)


class CompressionClassifier:
    """fit() on (label, text) rows, then scores() on texts."""

    def __init__(self, *, dict_bytes: int = DICT_BYTES, level: int = LEVEL, piece: int = PIECE):
        self.dict_bytes, self.level, self.piece = dict_bytes, level, piece
        self.weights: np.ndarray | None = None
        self.prior = 0.5

    def fit(self, rows: list[tuple[int, str]], share: float | None = None) -> CompressionClassifier:
        """share: label 1 among all training labels, where `rows` is a sample balanced by label.

        Alternate rows build the dictionaries and the calibration, so that neither sees the other's.
        """
        of = {y: [t for z, t in rows if z == y] for y in (0, 1)}
        n = max(1, len(of[0]) + len(of[1]))
        self.prior = share if share is not None else (len(of[1]) / n if rows else 0.5)
        if min(len(of[0]), len(of[1])) < 2:
            return self
        self.good, self.bad = (build_dictionary(of[y][::2], self.dict_bytes, self.piece) for y in (1, 0))
        sizer = Sizer(self.good, self.bad, self.level, self.piece)
        x = np.array([sizer.features(t) for y in (0, 1) for t in of[y][1::2]])
        y = np.repeat([0.0, 1.0], [len(of[0][1::2]), len(of[1][1::2])])
        w = np.where(y == 1, self.prior / max(1, y.sum()), (1 - self.prior) / max(1, (1 - y).sum())) * len(y)
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-9
        self.weights = fit_logistic((x - self.mean) / self.sd, y, w, l2=1e-5)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        sizer = Sizer(self.good, self.bad, self.level, self.piece)
        x = np.array([sizer.features(t) for t in texts]).reshape(len(texts), -1)
        return logistic((x - self.mean) / self.sd @ self.weights[:-1] + self.weights[-1])


def train(documents: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", mod: int = 4, out: int = 2) -> CompressionClassifier:
    """Fits on a bounded sample of the training rows (PER_LABEL a label, MAX_CHARS a text)."""
    rows = labelled_sample(documents, labels, label, key=key, text=text, mod=mod, out=out, per_label=PER_LABEL, max_chars=MAX_CHARS)
    rows = [(y, t) for y, _, t in sorted(rows, key=lambda r: (hash_order(r[1]), r[0]))]
    share = labels.where(fold(F.col(key), mod) != out).where(F.col(label).isin(0, 1)).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return CompressionClassifier().fit(rows, share)


def hash_order(key: str) -> int:
    import zlib

    return zlib.crc32(f"order {key}".encode())


def score_documents(documents: DataFrame, model: CompressionClassifier, *, text: str = "text", keep: list[str], out: str = "score") -> DataFrame:
    """`keep` columns of every row, then the score; whole texts, one pass without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kept = documents.select(*named(*keep))
    at = unused(keep, "_text")

    def run(batches):
        for b in batches:
            s = shared.value.scores(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(s, pa.float64())], names=[*keep, out])
        give_back()

    return documents.select(*named(*keep), F.col(text).alias(at)).mapInArrow(run, ddl(kept, f"`{out}` double"))


def keep_good(documents: DataFrame, model: CompressionClassifier, *, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of documents whose score reaches the threshold, columns as they were."""
    at = unused(documents.columns, "_score")
    scored = score_documents(documents, model, text=text, keep=documents.columns, out=at)
    return scored.where(F.col(at) >= threshold).select(*named(*documents.columns))
