"""Token counts of whole texts; huge texts in overlapping chunks that are spliced at proven stable boundaries.

A place in the text is stable if no piece of the vocabulary holds the two characters around it next to each other: then no
merge can ever reach across it, so tokens on both sides are the same whatever stands beyond. Chunks are encoded with an
overlap; the splice is the first stable place of the overlap, where both encodings must have a token boundary. A chunk
whose overlap has no such place is encoded again with a wider one, up to the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

CHUNK = 1 << 16
OVERLAP = 1 << 9


class Pieces:
    """A sentencepiece model with its adjacent pairs and each piece's bytes."""

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = pb.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("chunks are only spliced for models that keep the text as it is, with one space put before")
        if not proto.trainer_spec.byte_fallback:  # unknown characters in a row would be one token across a splice
            raise ValueError("chunks are only spliced for models with byte fallback")
        words = [p.piece.replace("▁", " ") for p in proto.pieces if p.type in (1, 4)]
        self.pairs = {w[i : i + 2] for w in words for i in range(len(w) - 1)}
        paired = {c for w in self.pairs for c in w}
        self.length = [1 if p.type == 6 else len(p.piece.replace("▁", " ").encode()) for p in proto.pieces]
        #: Stands before a chunk in place of the text; it is next to nothing in any piece, so what follows is encoded as if it stood inside.
        self.guard = next(c for c in map(chr, [*range(1, 32), *range(0xE000, 0xF8FF)]) if c not in paired)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def stable(self, text: str, lo: int, hi: int) -> int:
        """The first stable place in [lo, hi), -1 if there is none."""
        return next((p for p in range(max(lo, 1), min(hi, len(text))) if text[p - 1 : p + 1] not in self.pairs), -1)

    def boundaries(self, text: str) -> dict[int, int]:
        """Tokens before each token boundary of a chunk, by the boundary's byte; the chunk starts at byte 0."""
        at, out = -1 - len(self.guard.encode()), {}
        for n, i in enumerate(self.sp.encode(self.guard + text, num_threads=1)):
            out[at] = n
            at += self.length[i]
        out[at] = n + 1
        return out

    def between(self, text: str, lo: int, hi: int) -> int | None:
        """Tokens of text between two stable places, by the encoding of the text with its overlaps; None if it doesn't align."""
        found = self.boundaries(text)
        a, b = (found.get(len(text[:p].encode())) for p in (lo, hi))
        return None if a is None or b is None else b - a


_loaded: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in _loaded:
        _loaded[model] = Pieces(model)
    return _loaded[model]


def chunk_rows(text: str, chunk: int, overlap: int) -> list[tuple[int, str, int, bool]]:
    """(number, text with overlaps on both sides, characters of the left overlap, whether it is the last)."""
    n = max(1, -(-len(text) // chunk))
    return [(k, text[max(0, k * chunk - overlap) : (k + 1) * chunk + overlap], min(k * chunk, overlap), k == n - 1) for k in range(n)]


def splice_count(p: Pieces, k: int, text: str, left: int, last: bool, chunk: int, overlap: int) -> int | None:
    """Tokens from this chunk's left splice to its right one; None if an overlap has no stable place or doesn't align.

    The neighbour finds the same splice, as it looks at the same characters of the text.
    """
    if k == 0 and last:
        return p.count([text])[0]
    lo = 0 if k == 0 else p.stable(text, max(1, left - overlap + 1), left + overlap)
    hi = len(text) if last else p.stable(text, left + chunk - overlap + 1, left + chunk + overlap)
    if lo < 0 or hi < lo:
        return None
    if k == 0:
        return p.count([text[:hi]])[0]
    return p.between(text, lo, hi)


def _split(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, g, t in zip(*b.columns):
                for k, part, left, last in chunk_rows(t.as_py(), chunk, overlap):
                    yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([g]), pa.array([k], pa.int32()), pa.array([part]), pa.array([left], pa.int32()), pa.array([last])], ["h", "g", "k", "part", "left", "last"])

    return run


def _count_chunks(model: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = pieces(model)
            n = [splice_count(p, k, t, left, last, chunk, overlap) for k, t, left, last in zip(*(b.column(c).to_pylist() for c in ("k", "part", "left", "last")))]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("g"), pa.array(n, pa.int64())], ["h", "g", "n"])

    return run


def _count_whole(model: str, most: int):
    """Counts of texts of at most `most` characters; null for the longer ones, which come back in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, column = pieces(model), b.column(1)
            counts: list[int | None] = []
            for i in range(0, b.num_rows, 64):
                texts = column[i : i + 64].to_pylist()
                done = iter(p.count([t for t in texts if len(t) <= most]))
                counts += [next(done) if len(t) <= most else None for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.compute.binary_length(column).cast(pa.int64()), pa.array(counts, pa.int64()), *b.columns[2:]], ["doc_id", "n_bytes", "n_tokens", "h", "g"])

    return run


def count(docs: DataFrame, model: str, limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs, as the library counts the whole text.

    A null text is empty, a null id stays null, equal rows give equal rows, an empty table gives none, and other columns
    are not looked at. model is a path that every worker can read. Long texts are known by two 64-bit hashes, each worked on once.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).select("*", F.xxhash64("text").alias("h"), F.xxhash64(F.lit(1), "text").alias("g"))
    whole = d.mapInArrow(_count_whole(model, chunk), "doc_id long, n_bytes long, n_tokens long, h long, g long")
    todo = d.filter(F.length("text") > chunk).select("h", "g", "text").dropDuplicates(["h", "g"])
    counted = None
    while True:
        parts = todo.mapInArrow(_split(chunk, overlap), "h long, g long, k int, part string, left int, last boolean").repartition("h", "g", "k")
        each = parts.mapInArrow(_count_chunks(model, chunk, overlap), "h long, g long, n long")
        each = each.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max(F.col("n").isNull()).alias("failed"))
        each = written(each, "tokens")
        good = each.filter("not failed").select("h", "g", "n")
        counted = good if counted is None else counted.unionByName(good)
        if each.filter("failed").isEmpty():
            break
        todo = todo.join(each.filter("failed").select("h", "g"), ["h", "g"], "left_semi")
        chunk, overlap = chunk * 4, overlap * 8
    out = whole.join(counted, ["h", "g"], "left").withColumn("n_tokens", F.coalesce("n_tokens", "n"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
