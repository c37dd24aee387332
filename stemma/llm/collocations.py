"""Phrase collocations by SON partitioning, within each language.

Text is cut at punctuation and line ends into pieces and those into words; a phrase is 1 to ``longest``
words in a row within a piece.  A shard is 20 to 30 MB of the texts of a task.  Every shard is mined
completely, level by level, at the support that its share of all bytes leaves of the global one: a phrase
that is frequent in the whole is so in one shard at least.  What the shards report is united, with the
bound that their reports leave for its count (a shard that doesn't report has less than its support), and
all that may be frequent is counted exactly in a further pass.  Words and pairs go first, so that longer
phrases are mined only where each pair in them may be frequent; that keeps the candidates few even where
shards are so many that their support falls to 1 (from a hundred on), and reports then are exact.

Reports are 64-bit hashes and counts, packed by ranges of hashes, so that a range is added up as arrays, in a task of its own; two
phrases with one hash can only make a candidate too many.  Shards know the
candidates by a blocked Bloom filter of at most 64 MB, whatever their number: what it lets
through by mistake is counted too and falls to the support.  Phrases are counted by their words.

Defined results: a null text is empty and gives nothing; a null language is ``und`` (one with that name too);
texts of any length are taken whole, one longer than a shard ends it (about 60 bytes of
memory a word); repeated rows count each; an empty table gives no rows; columns other than the text and the language are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import prepare, stored

SUPPORT, LONGEST, FIRST = 100, 5, 2000
SHARD_BYTES = 20 << 20
MAX_FILTER_WORDS = 1 << 23
RANGE_BYTES = 8 << 20
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BREAK.copy()
APART[[0x20, 0x09]] = True
REPORT = "range int, payload binary, lang string, n long, lacking long"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of a slice, the row of each, and whether the next one continues its piece."""
    data = _text.LOWER[data]
    solid = ~APART[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    cut = np.zeros(len(data) + 1, np.int32)  # a piece ends at a break or where the next text begins
    cut[:-1] = BREAK[data]
    np.add.at(cut, offsets, 1)
    piece = np.cumsum(cut, dtype=np.int32)[starts]
    spelled = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(stops - starts)])), pa.py_buffer(data[solid])])
    return spelled, np.searchsorted(offsets, starts, "right") - 1, np.append(piece[1:] == piece[:-1], False)[: len(starts)]


class Shard:
    """Lower-cased words of some texts: an exact number, a language, a hash for each, and whether the next one continues its piece."""

    def __init__(self, batches: list[pa.RecordBatch]):
        code: dict[str, int] = {}
        langs, joins, words = [], [], []
        self.bytes = 0
        for b in batches:
            mine = np.array([code.setdefault(v, len(code)) for v in b.column(0).to_pylist()], np.int32)
            for lo, hi, data, offsets in _text.slices(b.column(1), 2 << 20):
                self.bytes += len(data)
                spelled, row, join = _words(data, offsets)
                words.append(spelled)
                langs.append(mine[lo:hi][row])
                joins.append(join)
        self.names = list(code)
        self.lang, self.joins = np.concatenate(langs), np.concatenate(joins)
        encoded = pa.chunked_array(words, pa.large_binary()).dictionary_encode()
        del words
        self.word = np.concatenate([c.indices.to_numpy() for c in encoded.chunks])
        spelling = encoded.chunk(encoded.num_chunks - 1).dictionary
        self.at = np.frombuffer(spelling.buffers()[1], np.int64, len(spelling) + 1, spelling.offset * 8)
        self.raw = np.frombuffer(spelling.buffers()[2], np.uint8) if len(spelling) else np.zeros(0, np.uint8)
        self.word_hash = _text.apart_hashes(self.raw, self.at[:-1], self.at[1:]) if len(spelling) else np.zeros(0, np.uint64)
        self.lang_hash = np.array([int.from_bytes(hashlib.blake2b(v.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for v in self.names], np.uint64)

    def marks(self, places: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the phrases of ``size`` words at ``places``, of their languages too."""
        h = self.lang_hash[self.lang[places]] + np.uint64(size)
        for k in range(size):
            h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + self.word_hash[self.word[places + k]])
        return h

    def spell(self, places: np.ndarray, size: int) -> pa.Array:
        """The phrases of ``size`` words at ``places``."""
        word = self.word[places[:, None] + np.arange(size)].ravel().astype(np.int64)
        length = self.at[word + 1] - self.at[word] + 1
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        raw = np.append(self.raw, np.uint8(0))[np.minimum(np.repeat(self.at[word] - (ends - length), length) + np.arange(total), len(self.raw))]
        raw[ends - 1] = 0x20
        last = np.ones(len(word), bool)
        last[size - 1 :: size] = False
        keep = np.ones(total, bool)
        keep[ends[~last] - 1] = False
        return pa.Array.from_buffers(pa.large_string(), len(places), [None, pa.py_buffer(np.concatenate([[0], (ends - np.arange(len(ends)) // size - 1)[~last]])), pa.py_buffer(raw[keep])]).cast(pa.string())


class Filter:
    """A blocked Bloom filter of marks: three bits of one 64-bit word each."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def bits(marks: np.ndarray) -> np.ndarray:
        one = np.uint64(1)
        six = np.uint64(63)
        return (one << (marks >> np.uint64(46) & six)) | (one << (marks >> np.uint64(52) & six)) | (one << (marks >> np.uint64(58)))

    def has(self, marks: np.ndarray) -> np.ndarray:
        need = self.bits(marks)
        return self.words[(marks & np.uint64(len(self.words) - 1)).astype(np.int64)] & need == need

    @staticmethod
    def of(candidates: DataFrame) -> Filter:
        """The filter of all marks of ``candidates``: 16 bits for each, at most 64 MB, set by a grouped bitwise or."""
        n = candidates.count()
        size = min(MAX_FILTER_WORDS, 1 << max(6, (n // 4).bit_length()))
        one = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("mark", k).bitwiseAND(F.lit(63)).cast("int"))
        value = F.bit_or(one(46).bitwiseOR(one(52)).bitwiseOR(one(58))).alias("bits")
        got = candidates.groupBy(F.col("mark").bitwiseAND(F.lit(size - 1)).alias("word")).agg(value).toArrow()  # at most ``size`` rows
        words = np.zeros(size, np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return Filter(words)


def levels(shard: Shard, longest: int, support: int, known: Filter | None, floor: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places, counts) of the phrases of each size that occur ``support`` times, each with one of its places.

    With ``known``, phrases of up to ``floor`` words (0: of any size) are those it lets through, however rare here.
    A longer phrase is looked for only where both of its longest parts are found.
    """
    places = np.arange(len(shard.word), dtype=np.int32)
    dense = single = None
    width = 1
    for size in range(1, longest + 1):
        exact = known is not None and (size <= floor or floor == 0)
        if size > 1:
            places = places[shard.joins[places + (size - 2)]]
            places = places[(dense[places] >= 0) & (dense[places + 1] >= 0)]
        if exact:
            places = places[_let_through(shard, known, places, size)]
        if size == 1:
            key = shard.word[places].astype(np.int64) * len(shard.names) + shard.lang[places]
        else:
            key = dense[places].astype(np.int64) * width + single[places + (size - 1)]
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.append(at, len(key)))
        del key
        places = places[order]
        del order
        enough = counts >= (1 if exact else support)
        dense = np.full(len(shard.word), -1, np.int32)
        dense[places] = np.repeat(np.where(enough, np.cumsum(enough) - 1, -1).astype(np.int32), counts)
        yield size, places[at[enough]], counts[enough]
        if size == 1:
            single, width = dense, max(1, int(enough.sum()))
        places = np.flatnonzero(dense >= 0).astype(np.int32)


def _let_through(shard: Shard, known: Filter, places: np.ndarray, size: int) -> np.ndarray:
    hit = np.zeros(len(places), bool)
    for lo in range(0, len(places), 1 << 19):
        part = places[lo : lo + (1 << 19)]
        hit[lo : lo + len(part)] = known.has(shard.marks(part, size))
    return hit


def _shards(batches, limit: int) -> Iterator[Shard]:
    """Shards of ``limit`` bytes; what a task has left joins its last one unless it is half as large, for a small shard would report nearly all it has."""
    ready, held, size = [], [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if ready and size >= limit // 2:
            yield Shard(ready)
            ready = []
        if not ready and size >= limit:
            ready, held, size = held, [], 0
    if ready or held:
        yield Shard(ready + held)


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null")


def _packed(marks: np.ndarray, ranges: int, columns: dict[str, pa.Array]) -> Iterator[tuple[int, bytes]]:
    """Rows dealt to ranges by their marks, those of one range as one Arrow stream."""
    at = (marks % np.uint64(ranges)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    table = pa.table(columns).take(pa.array(order))
    ends = np.searchsorted(at[order], np.arange(ranges + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table.slice(int(ends[k]), int(ends[k + 1] - ends[k])))
        yield k, sink.getvalue().to_pybytes()


def _unpacked(column) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(v.as_buffer()).read_all() for v in column])


def _reports(rows: DataFrame, total: int, support: int, longest: int, known: Filter | None, floor: int) -> DataFrame:
    """What the shards have, packed by ranges of marks: without ``floor`` 0 the frequent phrases of more than ``floor`` words, by mark; with it, the counts of all that ``known`` lets through.

    A row without a payload is a shard's language and its words; the ``lacking`` of its first one is what a phrase may
    have that the shard doesn't report.  A report's count is less that much, so that adding all shards' lacking is right for every phrase.
    """
    exact, ranges = known is not None and floor == 0, max(16, total // RANGE_BYTES)

    def run(batches):
        names = [f.split()[0] for f in REPORT.split(", ")]
        for shard in _shards(batches, SHARD_BYTES):
            local = max(1, -(-support * shard.bytes // max(total, 1)))
            lang, k = pa.array(shard.names, pa.string()), len(shard.names)
            words = pa.array(np.bincount(shard.lang, minlength=k).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), lang, words, pa.array([local - 1] + [0] * (k - 1), pa.int64())], names)
            for size, places, counts in levels(shard, longest, local, known, floor):
                if not exact and known is not None and size <= floor or not len(places):
                    continue
                marks = shard.marks(places, size)
                if exact:
                    columns = {"lang": lang.take(pa.array(shard.lang[places])), "phrase": shard.spell(places, size), "n": pa.array(counts.astype(np.int64))}
                else:
                    columns = {"mark": pa.array(marks.view(np.int64)), "n": pa.array((counts - (local - 1)).astype(np.int32))}
                made = list(_packed(marks, ranges, columns))
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in made], pa.int32()), pa.array([v for _, v in made], pa.binary()), *(pa.nulls(len(made), t) for t in (pa.string(), pa.int64(), pa.int64()))], names)

    return rows.mapInArrow(run, REPORT)


def _possible(reports: DataFrame, support: int) -> DataFrame:
    """Marks of the phrases whose count may reach the support: that of all reports, and what the shards without one may lack."""
    least = support - (reports.agg(F.sum("lacking")).first()[0] or 0)

    def run(table):
        sums = _unpacked(table["payload"]).group_by("mark").aggregate([("n", "sum")])
        return sums.filter(pc.greater_equal(sums["n_sum"], least)).select(["mark"])

    return reports.where("payload is not null").groupBy("range").applyInArrow(run, "mark long")


def _counted(reports: DataFrame, support: int) -> DataFrame:
    """lang, phrase, n of all phrases of at least the support."""

    def run(table):
        sums = _unpacked(table["payload"]).group_by(["lang", "phrase"]).aggregate([("n", "sum")])
        return sums.filter(pc.greater_equal(sums["n_sum"], support)).select(["lang", "phrase", "n_sum"]).rename_columns(["lang", "phrase", "n"])

    return reports.where("payload is not null").groupBy("range").applyInArrow(run, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of all phrases that occur ``support`` times in their language, and (lang, words)."""
    rows = _rows(docs, text_col, lang_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks = stored(_possible(stored(_reports(rows, total, support, min(2, longest), None, 0), "phrases_short"), support), "phrases_marks")
    if longest > 2:
        middle = stored(_reports(rows, total, support, longest, Filter.of(marks), 2), "phrases_middle")
        marks = stored(_possible(middle, support).unionByName(marks), "phrases_marks")
    last = stored(_reports(rows, total, support, longest, Filter.of(marks), 0), "phrases_long")
    found = stored(_counted(last, support).withColumn("size", F.size(F.split("phrase", " "))), "phrases")
    return found, last.where("payload is null").groupBy("lang").agg(F.sum("n").alias("words"))


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every phrase of two words or more, by its lowest-scoring cut."""
    spelled = F.split("phrase", " ")
    cuts = found.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), spelled.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("tail"))
    part = lambda name, to: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(to))
    whole = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"]).join(words.withColumnRenamed("words", "n"), "lang")
    # decimals of no places are exact to 38 digits: 1000 a n stays below 10^30 for 10^13 words
    exact = lambda c: f"cast({c} as decimal(19, 0))"
    value = F.expr(f"(cast(1000 as decimal(4, 0)) * ({exact('a')} * cast({exact('n')} as decimal(15, 0)))) div ({exact('l')} * cast({exact('r')} as decimal(18, 0)))")
    least = F.min(F.struct(value.alias("score"), "k", "l", "r", "n"))
    return whole.groupBy("lang", "phrase", "a").agg(least.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.n", "cut.score")


def maximal(candidates: DataFrame, found: DataFrame) -> DataFrame:
    """Drops candidates that lie inside a longer phrase with a count as great.

    Counts never grow with length, so such a phrase has one of a word more between it and the candidate.
    """
    w = F.split("phrase", " ")
    parts = F.array(F.slice(w, F.lit(1), F.col("size") - 1), F.slice(w, F.lit(2), F.col("size") - 1))
    inside = found.where("size > 2").select("lang", F.explode(parts).alias("w"), "n").groupBy("lang", F.array_join("w", " ").alias("phrase")).agg(F.max("n").alias("longer"))
    return candidates.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer")


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """Each language's ``first`` phrases by score, count and spelling: lang, rank, phrase, a, l, r, n, score."""
    found, words = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, support=support, longest=longest)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = maximal(scored(found, words), found).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
