"""Harmonic packing of documents into token sequences.

Lengths fall into classes: class k holds lengths in (C/(k+1), C/k], and a bin of class k takes
k pieces, whatever else it is dealt. Each worker fills its own bins of each class.
Documents are cut so that classes are filled well: first into whole sequences, then the rest
greedily into pieces of exactly floor(C/k) ids (two at most), so that only a short tail has
a length between two reciprocals. What a worker has left of a class, fewer than k pieces, goes to a
second round: for each GROUP of workers the left pieces are packed by falling length, each into the first of the last 256 open
sequences with room (first-fit).

A null or empty text is its end id alone. Repeated rows are packed as rows of their own, pieces of one length in the order of their
rows. An empty table gives no pieces. Very long texts are cut like any other. The key keeps its type and may be null; other columns, whatever their
names, take no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, ddl, give_back, scratch_of, slices

CAPACITY, END_ID, GROUP, CUTS = 2048, 1, 64, 2
COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "worker"]


class Encoder:
    """Ids of byte_bpe_50k.json without special tokens added.

    The byte-pair merges run in tiktoken on the file's own vocabulary and merge order, which gives the same ids at four
    times the speed; a text that holds a special token's string goes through the
    tokenizers library itself, which alone knows that string.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self._ranks(), special_tokens={})

    def _ranks(self) -> dict[bytes, int]:
        to_byte = byte_letters()
        return {bytes(to_byte[c] for c in token): i for token, i in self.slow.get_vocab(with_added_tokens=False).items() if token not in self.special}

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.uint32)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter to byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


def cut(n: int, capacity: int = CAPACITY, cuts: int = CUTS) -> list[int]:
    """Piece lengths of a document of n ids, each in 1 to capacity."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    for _ in range(cuts):
        if rest == 0:
            break
        piece = capacity // -(-capacity // rest)
        out.append(piece)
        rest -= piece
    return [*out, rest] if rest else out


def size_class(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def pack(documents: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, scratch: Scratch | None = None) -> DataFrame:
    """One row for each piece: document, place in it, ids' crc32, sequence and place there.

    `path` names the vocabulary file, or is None for that of public_tokenizers.
    """
    scratch = scratch or scratch_of(documents.sparkSession)

    def run(batches):
        encode, worker = Encoder(path), TaskContext.get().partitionId()
        base, made = worker << 32, 0
        open_bins: dict[int, list[tuple]] = {}
        done: list[tuple] = []

        def flush():
            keys, *cols = zip(*done, strict=True)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", *COLUMNS])

        for b in batches:
            for s in slices(b, "_text", 4 << 20):
                for doc, t in zip(s.column("doc_id").to_pylist(), s.column("_text").to_pylist(), strict=True):
                    ids = np.append(encode(t), np.uint32(END_ID)).astype("<u4")
                    start = 0
                    for n in cut(len(ids), capacity):
                        k = size_class(n, capacity)
                        group = open_bins.setdefault(k, [])
                        group.append((doc, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
                        start += n
                        if len(group) == k:
                            at = 0
                            for p in group:
                                done.append((*p, base + made, at, worker))
                                at += p[2]
                            made += 1
                            group.clear()
                if done:
                    yield flush()
        done.extend((*p, None, None, worker) for k in sorted(open_bins) for p in open_bins[k])
        if done:
            yield flush()
        del encode
        give_back()

    docs = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    key_type = to_arrow_schema(docs.schema).types[0]
    schema = ddl(docs.select("doc_id"), *(f"{c} long" for c in COLUMNS))
    pieces = scratch.put(docs.mapInArrow(run, schema), "pieces")

    def leftovers(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("worker", "ascending")])
        first = min(table["worker"].to_pylist())
        space: list[tuple[int, int]] = []  # free ids and number of the open sequences
        seq, off = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
        made = 0
        for i, n in enumerate(table["length"].to_pylist()):
            at = next((j for j, (free, _) in enumerate(space) if free >= n), None)
            if at is None:
                space.append((capacity, made))
                made += 1
                at = len(space) - 1
            free, b = space[at]
            seq[i], off[i] = (1 << 62) + (first << 32) + b, capacity - free
            space[at] = (free - n, b)
            space = [x for x in space if x[0] > 0][-256:]
        return pa.table([*(table[c] for c in table.column_names[:5]), pa.array(seq), pa.array(off), table["worker"]], names=["doc_id", *COLUMNS])

    # fewer than k pieces of each class and worker, GROUP workers: bounded by the capacity
    second = pieces.where("sequence_id is null").groupBy(F.floor(F.col("worker") / GROUP)).applyInArrow(leftovers, schema)
    return pieces.where("sequence_id is not null").unionByName(second).drop("worker")
