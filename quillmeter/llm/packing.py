"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmeter.llm.common import cut, prepare

#: Rows that one task ranks at most, in expectation.
GROUP = 50_000


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds: tokens, documents, and attention cost in tiles of a block-sparse kernel.

    A document of n tokens attends to itself alone, in ceil(n / tile) squared tiles. By default a
    sequence costs no more than one document that fills it does, 256 tiles of 128 x 128, and holds
    128 documents: both bind where documents are short.
    """

    tokens: int = 2048
    documents: int = 128
    attention: int = 256
    tile: int = 128

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], float)

    def need(self, length: int) -> np.ndarray:
        return np.array([length, 1, (-(-length // self.tile)) ** 2], float)


def plan_packing(counts: dict[int, int], capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1e-4, 1e-3), score: str = "norm") -> list[tuple[int, int, int, int, int, int]]:
    """How pieces of each length fill sequences: rows (length, first, last, per_bin, bin, offset).

    counts has the number of pieces by length, so it has capacity.tokens entries at most, however
    many pieces there are. Of length, the pieces ranked first..last-1 go to bins from `bin` on,
    per_bin to each, from `offset` on. Lengths go from long to short. Bins with equal residual
    tokens, documents and attention form a class; a length goes to the class that fits it in
    every dimension and has the least weighted norm of what stays free (score "norm") or the
    greatest weighted dot product of need and residual (score "dot"); then to new bins.
    """
    if score not in ("norm", "dot"):
        raise ValueError(score)
    whole, w = capacity.vector(), np.array(weights, float)
    classes: list[list[int]] = []  # first bin, bins
    left = np.empty((0, 3))
    plan, bins = [], 0
    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        need = capacity.need(length)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        rank, last = 0, counts[length]
        while rank < last:
            fits = np.flatnonzero((left >= need).all(1))
            if len(fits):
                free = left[fits]
                points = -(w * ((free - need) / whole) ** 2).sum(1) if score == "norm" else (w * (need / whole) * (free / whole)).sum(1)
                at = int(fits[points.argmax()])
                first, n = classes[at]
            else:
                each = int((whole // need).min())
                first, n = bins, -(-(last - rank) // each)
                bins += n
                classes.append([first, n])
                left = np.vstack([left, whole])
                at = len(classes) - 1
            each = int((left[at] // need).min())
            full = min(n, (last - rank) // each)
            offset = int(capacity.tokens - left[at, 0])
            residual = left[at].copy()
            taken = []
            if full:
                plan.append((length, rank, rank + full * each, each, first, offset))
                rank += full * each
                taken.append((first, full, residual - each * need))
            if full < n and rank < last:
                plan.append((length, rank, last, last - rank, first + full, offset))
                taken.append((first + full, 1, residual - (last - rank) * need))
                rank, full = last, full + 1
            if full < n:
                taken.append((first + full, n - full, residual))
            classes[at], left[at] = list(taken[0][:2]), taken[0][2]
            for begin, size, rest in taken[1:]:
                classes.append([begin, size])
                left = np.vstack([left, rest])
        # bins without a free token never come up again
        open_ = left[:, 0] > 0
        classes, left = [c for c, o in zip(classes, open_, strict=True) if o], left[open_]
    return plan


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), weights: tuple[float, float, float] = (1.0, 1e-4, 1e-3), score: str = "norm", order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset (its place there, gapless from 0).

    Only the number of pieces of each length goes to the driver, at most capacity.tokens figures;
    the plan that comes back has as many rows times a small factor. Pieces are ranked within their
    length in salted groups of about GROUP rows, so that a hot length is shared out. A length of
    null or below 1 takes no room: sequence_id and offset are null. Rows that tie in `order` may
    swap places. Empty input gives no rows.
    """
    spark = prepare(pieces)
    kept = pieces.columns
    real = pieces.where(F.col("length") > 0)
    counts = {int(r["length"]): int(r["n"]) for r in real.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_packing(counts, capacity, weights, score)
    steps = spark.createDataFrame(plan or [], "_length bigint, _first bigint, _last bigint, _each bigint, _bin bigint, _at bigint")
    parts = spark.createDataFrame([(k, -(-n // GROUP)) for k, n in counts.items()], "_length bigint, _parts bigint")
    salted = real.join(F.broadcast(parts), real.length == parts._length).drop("_length")
    salted = salted.withColumn("_part", F.pmod(F.xxhash64(*order), F.col("_parts")))
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1)
    groups = salted.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("length").alias("_length"), F.col("_part").alias("_group"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    ranked = ranked.join(groups, (ranked.length == groups._length) & (ranked._part == groups._group)).drop("_length")
    ranked = ranked.withColumn("_k", F.col("_k") + F.col("_ahead"))
    placed = ranked.join(F.broadcast(steps), (ranked.length == steps._length) & (F.col("_k") >= F.col("_first")) & (F.col("_k") < F.col("_last")))
    turn = F.col("_k") - F.col("_first")
    placed = placed.select(*kept, (F.col("_bin") + F.floor(turn / F.col("_each"))).alias("sequence_id"), (F.col("_at") + turn % F.col("_each") * F.col("length")).alias("offset"))
    rest = pieces.where("length is null or length < 1").select(*kept, F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    return placed.unionByName(rest)


class ByteBpe:
    """Token ids of a byte-level BPE file of `tokenizers`.

    Where the file's vocabulary lies beside it as ranks (.tiktoken), texts of characters up to
    U+024F take that faster library; it gives the same ids for them. All others, and all texts
    where there is no such file, take `tokenizers` itself, and so do texts that hold a special
    token's string: it is that token's id.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.plain = re.compile("[\t\n\r\x20-\x7e\xa0-ɏ]*").fullmatch

    def ids(self, text: str) -> list[int]:
        if self.fast and self.plain(text) and not any(t in text for t in self.special):
            return self.fast.encode_ordinary(text)
        return self.whole.encode(text, add_special_tokens=False).ids


def public_tokenizer() -> ByteBpe:
    import public_tokenizers as public

    return ByteBpe(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def token_pieces(docs: DataFrame, tokenizer=public_tokenizer, most: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids): each text's token ids and `end`, cut into pieces.

    A text of up to `most` ids is one piece; of a longer one all pieces but the first have `most`.
    ids holds them as little-endian unsigned 32-bit integers. A null text counts as empty, and
    an empty one is the single id `end`. tokenizer makes, on an executor, an object with ids(text).
    """
    prepare(docs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer().ids
        for batch in batches:
            out: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], "<u4")
                first = len(ids) % most or most
                bounds = [0, *range(min(first, len(ids)), len(ids) + 1, most)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((key, piece, a, b - a, ids[a:b].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[id_col, "piece", "start", "length", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary")


def pack_documents(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(cut(pieces), order=("doc_id", "piece", "start", "length", "ids_crc32"))
