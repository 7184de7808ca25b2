"""Removal of passages that occur more than once: confirmed by counts, located by sharded phrase automata."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmeter.llm.common import WordHashes, cut, gram_hashes, mixed, prepare
from quillmeter.llm.neardup import words_of

#: Bytes of text that one shard of documents, and so the passages that its automaton must know, stands for.
SHARD = 16 << 20
#: Kinds of what a shard tells: places by document, windows that stay open, and those of them that recur.
MARKS, WINDOWS, CONFIRMED = 0, 1, 2
#: Bits of a place's number that tell the word; the others tell the document.
SPOT = 24

#: Low bits that hold a place; the others order phrases, in longer texts too.
PLACES = (1 << 24) - 1


def _leftmost(g: np.ndarray, span: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(g, span).argmin(1) + np.arange(len(g) - span + 1)


def anchors(hashes: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's anchor, the leftmost least phrase in it: places of anchors, first and last window of each.

    The anchor depends on a window's words alone, so equal windows have equal anchors at equal
    places. Anchors of successive windows never go back.
    """
    g = gram_hashes(hashes, phrase)
    span = window - phrase + 1
    if len(g) < span:
        none = np.empty(0, np.int64)
        return none, none, none
    if len(g) <= PLACES + 1:
        # places in the low bits break ties to the left; then minima of doubled lengths
        least, size = g & np.uint64(~PLACES & 0xFFFFFFFFFFFFFFFF) | np.arange(len(g), dtype=np.uint64), 1
        while size < span:
            step = min(size, span - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        picked = (least & np.uint64(PLACES)).astype(np.int64)
    else:
        picked = _leftmost(g & np.uint64(~PLACES & 0xFFFFFFFFFFFFFFFF), span)
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]]))
    last = np.concatenate([first[1:], [len(picked)]]) - 1
    return picked[first], first, last


def _dealt(docs: DataFrame, id_col: str, text_col: str, key) -> DataFrame:
    """docs as (own_id, key, doc, text); doc is 40 bits of the key's hash and deals out documents to shards."""
    rows = docs.select(F.col(id_col).alias("own_id"), key.alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("doc", F.shiftrightunsigned(F.xxhash64("key"), SPOT))


def _packed(dealt: DataFrame, shards: int) -> DataFrame:
    """(shard, own_id, key, doc, z): the text as zstandard-compressed UTF-8, a third smaller on its way than Spark's own blocks."""
    kinds = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in ("own_id", "key", "doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            z = [squeeze.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], names=["own_id", "key", "doc", "z"])

    made = dealt.select("own_id", "key", "doc", "text").mapInArrow(run, f"{kinds}, z binary")
    return made.withColumn("shard", (F.col("doc") % shards).cast("int"))


def _all_words(column: pa.ChunkedArray) -> Iterator[list[bytes]]:
    """The words of packed texts, one text after the other."""
    loosen = zstandard.ZstdDecompressor()
    for z in column:
        yield loosen.decompress(z.as_py()).split()


def _scan(dealt: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc, size, anchors, contexts, places): of each text, its bytes, hashes of anchors and of all the words of their windows, anchors' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            own, around, places = [], [], []
            for text in batch.column(1).to_pylist():
                h = hashes.of(words_of(text, lower=False))
                at, first, last = anchors(h, window, phrase)
                places.append(at.astype(np.int32))
                if not len(at):
                    own.append([])
                    around.append([])
                    continue
                # a context is told by its first and last window, its length and the anchor's place in it;
                # windows between them are covered, as the two overlap or touch: last - first < window
                whole = gram_hashes(h, window)
                spread = mixed(whole[first] * np.uint64(3) + mixed(whole[last] + (last - first).astype(np.uint64)) + (at - first).astype(np.uint64))
                own.append(gram_hashes(h, phrase)[at].view(np.int64))
                around.append(spread.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.list_(pa.int64())), pa.array(around, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))], names=["doc", "size", "anchors", "contexts", "places"])

    return dealt.select("doc", "text", F.octet_length("text").cast("long").alias("size")).mapInArrow(run, "doc bigint, size bigint, anchors array<bigint>, contexts array<bigint>, places array<int>")


class Automaton:
    """An Aho-Corasick automaton of passages, runs of words that are joined by one space, each with a value.

    Words become numbers and numbers three letters of 256, the highest first, as a node of the
    automaton searches its branches one by one: a branch a word would make the root as wide as
    the vocabulary.
    """

    def __init__(self, passages: dict[bytes, bool]):
        self.numbers: dict[bytes, int] = {}
        known = [(np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in p.split(b" ")], ">u4"), value) for p, value in passages.items()]
        self.letters = 3 if len(self.numbers) < 1 << 24 else 4
        self.automaton = ahocorasick.Automaton()
        for ids, value in known:
            self.automaton.add_word(self.spelled(ids), value)
        self.automaton.make_automaton()

    def spelled(self, ids: np.ndarray) -> str:
        return ids.view(np.uint8).reshape(-1, 4)[:, 4 - self.letters :].tobytes().decode("latin-1")

    def found(self, words: list[bytes], length: int) -> np.ndarray:
        """By word, the value of the passage of `length` words that starts there, or -1; words that no passage has are number 0."""
        out = np.full(max(1, len(words)), -1, np.int8)
        if self.numbers:
            n = self.letters
            for end, value in self.automaton.iter(self.spelled(np.array([self.numbers.get(w, 0) for w in words], ">u4"))):
                if end % n == n - 1:
                    out[end // n - length + 1] = value
        return out


def repeated_windows(docs: DataFrame, window: int, phrase: int, id_col: str, text_col: str, key) -> tuple[DataFrame, DataFrame]:
    """Documents by shard, and the places of repeated windows by shard: see without_repeats."""
    spark = prepare(docs)
    if not 0 < phrase <= window:
        raise ValueError("a phrase is a part of a window")
    dealt = _dealt(docs, id_col, text_col, key)
    scan = cut(_scan(dealt, window, phrase))
    total = scan.agg(F.sum("size").alias("n")).first()["n"] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // SHARD))
    shard = lambda doc: (doc % shards).cast("int")
    texts = _packed(dealt, shards).repartition("shard")

    # what recurs, by counts that are partial before they travel; the least place stands for all
    rows = scan.select("doc", F.explode(F.arrays_zip("anchors", "contexts", "places")).alias("x")).select("doc", F.col("x.anchors").alias("anchor"), F.col("x.contexts").alias("context"), F.col("x.places").alias("place"))
    spot = F.shiftleft("doc", SPOT).bitwiseOR(F.col("place").cast("long").bitwiseAND(F.lit((1 << SPOT) - 1)))
    counted = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high"), F.min(spot).alias("spot")).where("n > 1")
    counted = counted.select("anchor", (F.col("low") != F.col("high")).alias("several"), "spot")
    sought = counted.select(shard(F.shiftrightunsigned("spot", SPOT)).alias("shard"), "anchor", "several", "spot")

    def quote(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """The words of confirmed passages, from one of the documents that hold them."""
        wanted: dict[int, list[tuple]] = {}
        for anchor, several, at in zip(*(right.column(c).to_pylist() for c in ("anchor", "several", "spot")), strict=True):
            wanted.setdefault(at >> SPOT & (1 << 64 - SPOT) - 1, []).append((anchor, several, at & (1 << SPOT) - 1))
        made, hashes = {}, WordHashes()
        rows = [i for i, doc in enumerate(left.column("doc").to_pylist()) if doc in wanted]
        asked = left.select(["doc", "z"]).take(pa.array(rows, pa.int64()))
        for doc, words in zip(asked.column("doc").to_pylist(), _all_words(asked.column("z")), strict=True):
            for anchor, several, at in wanted[doc]:
                # documents may share the hash's bits, and places a number's low bits: the passage's own hash decides
                for p in range(at, len(words) - phrase + 1, 1 << SPOT):
                    if int(gram_hashes(hashes.of(words[p : p + phrase]), phrase).view(np.int64)[0]) == anchor:
                        made[anchor] = (several, b" ".join(words[p : p + phrase]))
        return pa.table({"anchor": pa.array(made, pa.int64()), "several": pa.array([s for s, _ in made.values()], pa.bool_()), "passage": pa.array([t for _, t in made.values()], pa.binary())})

    quoted = texts.groupBy("shard").cogroup(sought.groupBy("shard")).applyInArrow(quote, "anchor bigint, several boolean, passage binary")
    # the shards whose documents may hold a passage; each pair travels once, so a passage of a third of all documents is a row a shard
    where = rows.select("anchor", shard(F.col("doc")).alias("shard")).distinct()
    passages = where.join(quoted, "anchor").select("shard", "several", "passage")

    def locate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Streams a shard's documents through the automaton of its passages; numbers the windows that stay open."""
        automaton = Automaton(dict(zip(right.column("passage").to_pylist(), right.column("several").to_pylist(), strict=True)))
        hashes, windows, held = WordHashes(), [], 0
        marks: dict[str, tuple] = {}
        for name, words in zip(left.column("key").to_pylist(), _all_words(left.column("z")), strict=True):
            found = automaton.found(words, phrase)
            if (found < 0).all():
                continue
            h = hashes.of(words)
            at, first, last = anchors(h, window, phrase)
            state = found[at]
            runs: list[list[int]] = []
            for a, b in zip(first[state == 0].tolist(), last[state == 0].tolist(), strict=True):
                if runs and runs[-1][1] + 1 == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            several = np.flatnonzero(state == 1)
            spots = np.concatenate([np.arange(first[k], last[k] + 1) for k in several]) if len(several) else np.empty(0, np.int64)
            if len(spots):
                # 128 bits of a window's words, by hashes of words that are independent of each other
                second = mixed(h ^ np.uint64(0xD6E8FEB86659FD93))
                windows.append(np.stack([gram_hashes(h, window)[spots], gram_hashes(second, window)[spots]], axis=1).view(np.int64))
            marks[name] = [np.array(runs, np.int32).tobytes(), spots.astype(np.int32).tobytes(), held, held + len(spots)]
            held += len(spots)
        pairs = np.concatenate([np.empty((0, 2), np.int64), *windows])
        _, seen, numbers, counts = np.unique(pairs, axis=0, return_index=True, return_inverse=True, return_counts=True)
        # in the order in which they come up, numbers are runs and take little room
        order = np.argsort(seen)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        numbers, asked, counts = rank[numbers.reshape(-1)], pairs[seen[order]], counts[order]
        marks = {name: (runs, spots, numbers[a:b].tobytes()) for name, (runs, spots, a, b) in marks.items()}
        told = [zlib.compress(pickle.dumps(x), 1) for x in (marks, (asked[:, 0].tobytes(), asked[:, 1].tobytes(), counts.astype(np.int32).tobytes()))]
        return pa.table({"shard": pa.array([key[0].as_py()] * 2, pa.int32()), "kind": pa.array([MARKS, WINDOWS], pa.int32()), "told": pa.array(told, pa.binary())})

    # what a shard tells is opaque to Spark, so that both its readers share one exchange, and one run of the automata
    located = texts.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(locate, "shard int, kind int, told binary").repartition("shard")

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, kind, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == WINDOWS:
                    low, high, n = (np.frombuffer(x, t) for x, t in zip(pickle.loads(zlib.decompress(told)), (np.int64, np.int64, np.int32), strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number, np.int32)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(low), pa.array(high), pa.array(n)], names=["shard", "number", "low", "high", "n"])

    asked = located.mapInArrow(open_windows, "shard int, number int, low bigint, high bigint, n int")
    twice = asked.groupBy("low", "high").agg(F.sum("n").alias("n")).where("n > 1").select("low", "high")
    good = asked.join(twice, ["low", "high"]).groupBy("shard").agg(F.array_join(F.collect_list("number"), ",").cast("binary").alias("told"))
    return texts, located.unionByName(good.select("shard", F.lit(CONFIRMED).alias("kind"), "told"))


def without_repeats(docs: DataFrame, window: int = 35, phrase: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_text): all documents without the words that repeated windows cover.

    A window is `window` consecutive words; it is repeated if the same words start anywhere else.
    1. Every window names one of its `phrase`-word phrases as its anchor, by its words alone. An
    anchor that occurs once proves its windows unique. Those that recur are passages; the counts
    say for each whether all its occurrences have one context, which confirms all windows it
    stands for, or several. 2. The words of each passage are quoted from one document that holds
    it. 3. Documents are dealt to shards of about SHARD bytes. A shard gets the passages whose
    hashes its documents have, compiles them into one automaton, and streams all its documents
    through it: only an occurrence that the automaton finds marks windows. A shard's automaton is
    so bounded by the shard's text, and a passage of a third of all documents is one row a shard.
    4. Windows of passages with several contexts are counted exactly, by 128 bits of their words,
    first in each shard and then across shards; those found twice join the confirmed ones.

    A passage of one context is told by 64 bits of its words and 64 more of its context: a wrong
    one would need all its occurrences to collide.

    Windows are judged on the input. The kept words are joined by one space. Null texts count as
    empty, texts under `window` words stay whole. Ids are expected to name one row each; rows that
    repeat an id are told apart by their texts, and rows that repeat both get the same result, as
    each is the other's copy. A null id is an id like any other. An empty table gives no rows.
    """
    prepare(docs)
    repeated = docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1))
    key = F.col(id_col).cast("string")
    if not repeated.isEmpty():
        key = F.concat(F.coalesce(key, F.lit("-")), F.lit(":"), F.sha1(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    texts, spans = repeated_windows(docs, window, phrase, id_col, text_col, key)
    kind = docs.schema[id_col].dataType.simpleString()

    def take_out(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        marks, good, most = {}, np.empty(0, np.int64), 0
        for what, told in zip(right.column("kind").to_pylist(), right.column("told").to_pylist(), strict=True):
            if what == MARKS:
                marks = pickle.loads(zlib.decompress(told))
            elif what == WINDOWS:
                most = len(pickle.loads(zlib.decompress(told))[2]) // 4
            else:
                good = np.array(told.split(b","), np.int64)
        confirmed = np.zeros(most, bool)
        confirmed[good] = True
        totals, removed, kept = [], [], []
        for name, words in zip(left.column("key").to_pylist(), _all_words(left.column("z")), strict=True):
            stay = np.ones(len(words), bool)
            if name in marks:
                runs, asked, numbers = (np.frombuffer(x, np.int32) for x in marks[name])
                found = asked[confirmed[numbers]]
                edge = np.zeros(len(words) + 1, np.int32)
                np.add.at(edge, np.concatenate([runs[::2], found]), 1)
                np.add.at(edge, np.concatenate([runs[1::2], found]) + window, -1)
                stay = np.cumsum(edge[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            totals.append(len(stay))
            removed.append(len(stay) - len(words))
            kept.append(b" ".join(words).decode("utf-8", "replace"))
        return pa.table({id_col: left.column("own_id"), "n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return texts.groupBy("shard").cogroup(spans.groupBy("shard")).applyInArrow(take_out, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_text string")
