"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text."""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import cut, prepare

#: Labelled texts that a model is fitted on at most, by class.
FIT_TOXIC, FIT_ORDINARY = 2500, 5000
#: Words of a window of running text, and from one window's start to the next's: windows overlap by half.
WINDOW, STRIDE = 12, 6
#: Bytes of the dictionaries' ordinary and toxic content, and what each round of lost windows may add.
ORDINARY, TOXIC, LOST = 60_000, 20_000, 20_000
#: Rounds in which ordinary windows that the toxic dictionary wins by WON bytes are learned, if there are so many.
ROUNDS, WON, FEWEST = 2, 2, 50
#: A word or pair of words counts as toxic if it is in SEEN toxic texts or more and a log-likelihood ratio tells the classes apart:
#: of n that are tried, this much above 2 log n, where chance alone gives one in 150 fits.
SEEN, SURE = 5, 10.0
#: Bytes won in a window that the features count from on.
STEPS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24)

EDGE = ".,;:!?|\"'()[]{}<>#$%&*@-_/\\"
#: How windows are compressed: as UTF-16, where a word outweighs the fixed cost of a match, without a frame's own fields.
LEVEL = {"window_log": 18, "hash_log": 16, "chain_log": 16, "search_log": 5, "min_match": 6, "target_length": 64, "strategy": zstandard.STRATEGY_BTLAZY2}


def words_of(text: str | None) -> list[str]:
    """A text's words in lower case, without punctuation at their ends."""
    return [w for w in (x.strip(EDGE) for x in (text or "").lower().split()) if w]


def stored(words: list[str]) -> bytes:
    """Words as the bytes that are trained on and compressed."""
    return f" {' '.join(words)} ".encode("utf-16-le", "surrogatepass")


def windows_of(words: list[str], stride: int = STRIDE) -> list[bytes]:
    """All windows of a text's words; a shorter text is one window, an empty one has none."""
    return [stored(words[i : i + WINDOW]) for i in range(0, max(1, len(words) - WINDOW + stride), stride)] if words else []


def units_of(words: list[str]) -> set[str]:
    """The words and pairs of neighbouring words of a text."""
    return {*words, *map(" ".join, zip(words, words[1:], strict=False))}


def toxic_runs(words: list[str], toxic: frozenset[str]) -> list[bytes]:
    """The longest runs of words that toxic units cover."""
    mark = [w in toxic for w in words]
    for i, pair in enumerate(map(" ".join, zip(words, words[1:], strict=False))):
        if pair in toxic:
            mark[i] = mark[i + 1] = True
    runs, run = [], []
    for word, marked in zip([*words, ""], [*mark, False], strict=True):
        if marked:
            run.append(word)
        elif run:
            runs.append(stored(run))
            run = []
    return runs


def trained(samples: list[bytes], size: int, segment: int = 16) -> bytes:
    """A dictionary's content by zstandard's training; samples too few or short for that are taken as they are."""
    total = sum(map(len, samples))
    size = min(size, max(256, total // 2))
    if len(samples) >= 8 and total > 2 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=6).as_bytes()
        except zstandard.ZstdError:  # samples that hold nothing in common
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


class Distance:
    """The bytes that the toxic dictionary saves over the ordinary one, window by window.

    Both dictionaries end in the same ordinary content, so that what is common to all text costs
    the same at the same distance under either; the toxic one has its own content before that.
    """

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = self.compressor(toxic + ordinary), self.compressor(ordinary)

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        params = zstandard.ZstdCompressionParameters(format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False, **LEVEL)
        data = zstandard.ZstdCompressionDict(content.rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(compression_params=params, dict_data=data)

    def of(self, windows: list[bytes]) -> list[int]:
        a, b = self.ordinary.compress, self.toxic.compress
        return [len(a(w)) - len(b(w)) for w in windows]


def dictionaries(windows: list[bytes], runs: list[bytes]) -> tuple[bytes, bytes]:
    """(toxic, ordinary) content, trained on ordinary windows and on toxic runs.

    Then, for some rounds, the ordinary content also learns the ordinary windows that the toxic
    dictionary would win.
    """
    ordinary, toxic = trained(windows, ORDINARY, 32), trained(runs, TOXIC)
    for _ in range(ROUNDS):
        won = [w for w, saved in zip(windows, Distance(toxic, ordinary).of(windows), strict=True) if saved >= WON]
        if len(won) < FEWEST:
            break
        ordinary = trained(won, min(LOST, 20 * len(won))) + ordinary
    return toxic, ordinary


def features(wins: list[int]) -> list[float]:
    """How many windows save at least so many bytes, as logarithms of counts and of shares, the most and the mean saved."""
    a = np.array(wins or [0])
    counts = np.array([(a >= s).sum() for s in STEPS], float)
    return [1.0, *np.log1p(counts).tolist(), *np.log1p(200 * counts / len(a)).tolist(), max(0, int(a.max())) / 4, float(a.mean()), float(np.log1p(len(a))) / 4]


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 40) -> np.ndarray:
    """Weights of a logistic threshold on the features, by Newton's method."""
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + keep * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _toxic_units(texts: DataFrame, toxic: int, ordinary: int) -> frozenset[str]:
    """Units that are in significantly more of the toxic texts(y, text) than of the ordinary ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = Counter((y, u) for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for u in units_of(words_of(t)))
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in found], pa.int32()), pa.array([u.encode("utf-8", "surrogatepass") for _, u in found], pa.binary()), pa.array(found.values(), pa.int64())], names=["y", "unit", "n"])

    n = texts.select("y", "text").mapInArrow(count, "y int, unit binary, n long").groupBy("unit").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    share = toxic / (toxic + ordinary)
    here, there = (F.col("a") + F.col("b")) * share, (F.col("a") + F.col("b")) * (1 - share)
    ratio = 2 * (F.col("a") * F.log(F.col("a") / here) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / there)).otherwise(0.0))
    n = cut(n)
    least = SURE + 2 * math.log(max(1, n.count()))
    rows = n.where((F.col("a") >= SEEN) & (F.col("a") > here)).where(ratio >= least).select("unit").collect()
    return frozenset(bytes(r["unit"]).decode("utf-8", "surrogatepass") for r in rows)


def fit(docs: DataFrame, labels: DataFrame) -> bytes:
    """A model from docs(doc_id, text) and labels(doc_id, toxic): dictionaries and calibrated thresholds.

    The fit takes FIT_TOXIC toxic and FIT_ORDINARY other documents at most, those with the smallest
    hashes of their ids, and the whole text of each; copies count once, as toxic if one is. They are
    chosen from the labels alone, so that only their bounded number of ids meets the documents. Two
    thirds of each class train the dictionaries, the last third, which they haven't seen, calibrates
    the thresholds. The ordinary dictionary is trained on all windows of the ordinary texts; the
    toxic one has that content too, and its own, trained on those runs of the toxic texts that tell
    the classes apart: toxic text is ordinary text for the most part, and dictionaries of all of it
    would differ by chance alone. Texts stay on the executors, one of which trains on the windows;
    the driver gets dictionaries, toxic units and features. With one class only, the score is that
    class's share.
    """
    prepare(docs)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64(F.col("doc_id").cast("string")))
    few = None
    for y, most in ((1, FIT_TOXIC), (0, FIT_ORDINARY)):
        part = known.where(F.col("y") == y).orderBy("h", "doc_id").limit(most)
        few = part if few is None else few.unionByName(part)
    chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(few), "doc_id")
    chosen = cut(chosen.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.max("y").alias("y"), F.min("h").alias("h"), F.first("text").alias("text")))
    data = sorted((r["h"], r["digest"], r["y"]) for r in chosen.select("h", "digest", "y").collect())
    share = sum(y for _, _, y in data) / len(data) if data else 0.0
    if not data or share in (0.0, 1.0):
        return pickle.dumps({"share": share})
    ranks = {y: iter(range(len(data))) for y in (0, 1)}
    unseen = frozenset(digest for _, digest, y in data if next(ranks[y]) % 3 == 2)
    trains = {y: sum(d not in unseen and z == y for _, d, z in data) for y in (0, 1)}
    seen = chosen.where(~F.col("digest").isin(*unseen)) if unseen else chosen
    units = _toxic_units(seen, trains[1], trains[0])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(y, s) for y, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for s in (toxic_runs(words_of(t), units) if y else windows_of(words_of(t), WINDOW))]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in made], pa.int32()), pa.array([s for _, s in made], pa.binary())], names=["y", "sample"])

    def train(table: pa.Table) -> pa.Table:
        # training looks for one segment in each part of its input in turn, so equal samples must not lie together
        samples = sorted(zip(table.column("sample").to_pylist(), table.column("y").to_pylist(), strict=True))
        samples = [samples[i] for i in np.random.default_rng(0).permutation(len(samples))]
        toxic, ordinary = dictionaries([s for s, y in samples if not y], [s for s, y in samples if y])
        return pa.table({"toxic": pa.array([toxic], pa.binary()), "ordinary": pa.array([ordinary], pa.binary())})

    both = seen.select("y", "text").mapInArrow(sample, "y int, sample binary").withColumn("one", F.lit(0)).groupBy("one").applyInArrow(train, "toxic binary, ordinary binary").first()
    toxic, ordinary = (bytes(both["toxic"]), bytes(both["ordinary"])) if both else (b"", b"")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(toxic, ordinary)
        for batch in batches:
            rows = [features(distance.of(windows_of(words_of(t)))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["digest", "y", "x"])

    # without texts to spare, thresholds are calibrated on those that were trained on
    rest = chosen.where(F.col("digest").isin(*unseen)) if unseen else chosen
    found = sorted((r["digest"], r["y"], r["x"]) for r in rest.select("digest", "y", "text").mapInArrow(measure, "digest string, y int, x array<double>").collect())
    weights = calibrate(np.array([x for _, _, x in found]), np.array([y for _, y, _ in found], float))
    return pickle.dumps({"share": share, "toxic": toxic, "ordinary": ordinary, "weights": weights.tolist()})


def toxicity(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows with `score`, 0 to 1: whole texts, every window. Other columns stay as they are.

    A null or empty text has no window and gets the score of that. A column of docs named score
    is replaced.
    """
    prepare(docs)
    kept = docs.drop("score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double"
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(model)
        distance = Distance(m["toxic"], m["ordinary"]) if "weights" in m else None
        for batch in batches:
            if distance is None:
                scores = np.full(batch.num_rows, m["share"])
            else:
                x = [features(distance.of(windows_of(words_of(t)))) for t in batch.column(at).to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(np.array(x).reshape(len(x), -1) @ np.array(m["weights"]), -30, 30))) if x else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, schema)


def learnable(labels: DataFrame) -> DataFrame:
    """labels without the held-out fifth, crc32 of the id modulo 5."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
