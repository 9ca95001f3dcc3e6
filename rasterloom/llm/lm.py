"""Language-model scores from a log-frequency Bloom filter.

Counts of words are exact: the base score looks frequent words up in a broadcast dictionary of
bounded size and joins the rest by hash.  The model is a bigram over all words of the training fold.
Counts of bigrams, and of words outside the dictionary, are quantised to powers of 2 and held in
a Bloom filter; a count is read back by probing (key, 1), (key, 2), ... until one is absent.

Probabilities are proper: with n the lower edge of a bigram's quantised count, N the upper edge of
its context's and p0 the add-one unigram probability,

    p(w | v) = (n + B p0(w)) / (N (1 + EXCESS) + B + F)

where F is four times the mass that false positives are expected to add over the whole vocabulary,
and B = F + BACKOFF, so unseen bigrams keep their share.  An entry for a rare word takes more probes
than one for a frequent word, and each level one more, which keeps F small although rare words
are many.  An unseen context has p0 alone.

The filter is built in shards of the key space.  It is broadcast up to ``MAX_FILTER_BYTES``; past
that the higher levels are, and tokens that need a lower one meet its shard in a join, so
no count is dropped at any size.

Null text is empty text and has one token, its end.  Repeated rows and ids are scored one by one;
a null id is in no fold and trains; an empty table gives no rows; extra columns are not read.
Texts are cut into groups of whole documents, a longer document is a group of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, table, written
from .textkernels import Words, groups, mix
from .training import in_training

FOLDS, HELD = 7, 2
HOT_WORDS = 1 << 19  # entries of the exact dictionary that is broadcast, 16 bytes each
MAX_FILTER_BYTES = 192 << 20
SHARD_BYTES = 8 << 20  # of text for a shard of the filter
MAX_TASKS = 20_000  # that build the filter
BATCH_BYTES = 4 << 20  # of rows that a Python worker gets at once; Spark's default is 64 MB, and the buffers double as they grow
MERGE_AT = 2_000_000  # keys a task holds before it merges and hands them on
BACKOFF = 8.0
EXCESS = 2.0**-5
END = np.uint64(0x5EED0E4D5EED0E4D)  # the end token's hash
BIGRAM_SALT, WORD_SALT = np.uint64(0xB16A), np.uint64(0x30FD)
CLASSES = 16  # of words, by the logarithm of their count; 1 is every word outside the dictionary
PROBES = np.maximum(6, 16 - np.arange(CLASSES))  # of an entry's first level, by class
OPEN = {"pair": "long", "pair_q": "int", "word": "long", "word_q": "int", "word_c": "long", "context": "long", "context_q": "int", "context_c": "long"}


def in_small_batches(df: DataFrame, label: str) -> DataFrame:
    """:func:`written` with Arrow batches of about ``BATCH_BYTES``; the session's setting is put back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, str(BATCH_BYTES))
    try:
        return written(df, label)
    finally:
        conf.set(key, before)


def _token_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words with one end after each document, and owners, in order."""
    words = Words(data, offsets)
    n = words.n_docs
    h = np.concatenate([words.hashes(), np.full(n, END)])
    doc = np.concatenate([words.doc, np.arange(n)])
    order = np.argsort(doc, kind="stable")
    return h[order], doc[order]


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    key, count = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]).astype(np.int64)
    if not len(key):
        return key, count
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.add.reduceat(count, first)


def _gathered(column_groups: Iterator[tuple[np.ndarray, np.ndarray]], most: int = MERGE_AT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merged (keys, counts) of a task, handed on whenever they are many."""
    held, size = [], 0
    for part in column_groups:
        held.append(part)
        size += len(part[0])
        if size > most:
            held = [_merged(held)]
            size = len(held[0][0])
            if size > most // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield _merged(held)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(h, c)`` over all tokens, ends included; each task adds up its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (np.unique(_token_stream(data, offsets)[0], return_counts=True) for batch in batches for _, _, data, offsets in groups(batch.column(0)))
        for key, count in _gathered(found):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], names=["h", "c"])

    return docs.select(text_col).mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """The most frequent words: sorted hashes and exact counts."""

    keys: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int
    bucket: int  # words of this bucket of counts and above are in it

    @property
    def whole(self) -> float:
        return float(self.total + self.distinct + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[k] == h, k, -1)

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Count of each hash, or -1 outside the dictionary."""
        at = self.find(h)
        return np.where(at >= 0, self.counts[at] if len(self.counts) else 0, -1)

    def false_mass(self) -> float:
        """Mass that false positives are expected to add to a context, summed over the vocabulary."""
        share = 2.0 ** -PROBES.astype(float)
        return float(share[word_class(self.counts)].sum() + (self.distinct - len(self.keys)) * share[1])


def bucket(c: Column) -> Column:
    return F.floor(F.log2(c.cast("double")) * 8).cast("int")


def lexicon(counts: DataFrame) -> Lexicon:
    """At most ``HOT_WORDS`` words, by a histogram of some hundred buckets of counts."""
    sizes = sorted(((r["b"], r["v"], r["n"]) for r in counts.groupBy(bucket(F.col("c")).alias("b")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()), reverse=True)
    least, many = (sizes[0][0] + 1 if sizes else 0), 0
    for b, v, _ in sizes:
        many += v
        if many > HOT_WORDS:
            break
        least = b
    got = counts.where(bucket(F.col("c")) >= least).toArrow()
    h, c = got["h"].to_numpy().view(np.uint64), got["c"].to_numpy()
    order = np.argsort(h)
    return Lexicon(h[order], c[order], sum(n for _, _, n in sizes), sum(v for _, v, _ in sizes), least)


def word_class(exact: np.ndarray) -> np.ndarray:
    """1 for words outside the dictionary (-1), else the bit length of the count."""
    return np.where(exact < 0, 1, np.minimum(_level(exact), CLASSES - 1)).astype(np.int64)


def _level(c: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c), and 0 for 0."""
    return np.frexp(np.maximum(c, 0).astype(np.float64))[1].astype(np.int64)


def _bigrams(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second word of each token's bigram."""
    first = np.concatenate([[END], h[:-1]]) if len(h) else h
    first[np.flatnonzero(doc[1:] != doc[:-1]) + 1] = END
    return first, h


def _key(h: np.ndarray, classes: np.ndarray | int) -> np.ndarray:
    """48 bits: 44 of the hash and the class."""
    return (h >> np.uint64(16)) & np.uint64((1 << 48) - 16) | np.asarray(classes).astype(np.uint64)


def bigram_key(first: np.ndarray, second: np.ndarray, classes: np.ndarray | int) -> np.ndarray:
    """``classes`` are those of the second words."""
    with np.errstate(over="ignore"):
        return _key(mix(mix(first + (BIGRAM_SALT << np.uint64(48))) + second), classes)


def word_key(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _key(mix(h + (WORD_SALT << np.uint64(48))), 1)


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the key space, in order."""
    return ((key >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _hashes(key: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(key ^ mix(np.full(1, level, np.uint64)))
        return h, mix(h + np.uint64(1)) | np.uint64(1)


def _position(h: np.ndarray, g: np.ndarray, j: int, size: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h + np.uint64(j) * g) >> np.uint64(32)) * size >> np.uint64(32)


def _probes(key: np.ndarray, level: int) -> np.ndarray:
    return PROBES[(key & np.uint64(15)).astype(np.int64)] + level - 1


def shard_bitmap(key: np.ndarray, level: int) -> np.ndarray:
    """Bits of one level of a shard, half of them set; its size is the number of probes over ln 2."""
    count = _probes(key, level)
    size = np.uint64(64 * math.ceil(count.sum() / math.log(2) / 64))
    bits = np.zeros(int(size), bool)
    h, g = _hashes(key, level)
    for j in range(int(count.max())):
        on = count > j
        bits[_position(h[on], g[on], j, size)] = True
    return np.packbits(bits, bitorder="little")


class LogBloom:
    """Bloom filter of (key, level), a bitmap for each level and shard; levels from ``cutoff`` up are here."""

    def __init__(self, shards: int, rows: list[tuple[int, int, bytes]], cutoff: int = 1, least: int = 0) -> None:
        self.shards, self.cutoff, self.least = shards, cutoff, least  # shards from ``least`` on
        self.levels = max((level for _, level, _ in rows), default=0)
        span = max((s for s, _, _ in rows), default=least) - least + 1
        self.at = np.zeros((self.levels + 1, span), np.int64)
        self.size = np.zeros((self.levels + 1, span), np.uint64)
        self.data = np.empty(sum(len(b) for _, _, b in rows), np.uint8)
        end = 0
        for s, level, b in rows:
            self.at[level, s - least], self.size[level, s - least] = end, 8 * len(b)
            self.data[end : end + len(b)] = np.frombuffer(b, np.uint8)
            end += len(b)

    def present(self, key: np.ndarray, level: int) -> np.ndarray:
        out = np.zeros(len(key), bool)
        if level > self.levels or not len(key):
            return out
        shard = shard_of(key, self.shards) - self.least
        inside = (shard >= 0) & (shard < self.size.shape[1])
        shard = np.where(inside, shard, 0)
        size = np.where(inside, self.size[level, shard], np.uint64(0))
        at = np.flatnonzero(size > 0)
        key, base, size = key[at], self.at[level, shard[at]], size[at]
        (h, g), left = _hashes(key, level), _probes(key, level)
        j = 0
        while len(at):
            place = _position(h, g, j, size).astype(np.int64)
            ok = (self.data[base + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 == 1
            j += 1
            done = ok & (left <= j)
            out[at[done]] = True
            going = ok & ~done
            if going.sum() < len(at):
                at, h, g, base, size, left = (x[going] for x in (at, h, g, base, size, left))
        return out

    def level(self, key: np.ndarray) -> np.ndarray:
        """Highest consecutive level present, by repeated probes; -1 where levels under the cutoff must tell."""
        out = np.full(len(key), -1 if self.cutoff > 1 else 0, np.int64)
        alive = np.arange(len(key))
        for q in range(self.cutoff, self.levels + 1):
            alive = alive[self.present(key[alive], q)]
            if not len(alive):
                break
            out[alive] = q
        return out


def _packed(shards: int, key: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: keys of 6 bytes and counts of one, larger counts as several entries."""
    times = -(-count // 255)
    key, end = np.repeat(key, times), np.cumsum(times)
    one = np.full(len(key), 255, np.int64)
    one[end - 1] = count - 255 * (times - 1)
    shard = shard_of(key, shards)
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(key) else np.zeros(0, np.int64)
    cuts = np.concatenate([first, [len(key)]]).astype(np.int32)
    keys = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :6])
    arrays = [pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cuts * np.int32(w)), pa.py_buffer(x)]) for w, x in ((6, keys), (1, one.astype(np.uint8)))]
    return pa.RecordBatch.from_arrays([pa.array(shard[first]), *arrays], names=["shard", "keys", "counts"])


def _unpacked(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 6)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :6] = raw
    return _merged([(wide.view(np.uint64).ravel(), np.frombuffer(b"".join(counts), np.uint8))])


def build_filter(docs: DataFrame, counts: DataFrame, lex: Lexicon, text_col: str = "text") -> tuple[int, DataFrame]:
    """``(shards, (shard, level, bits))``: the filter of all bigrams and of all words outside the dictionary, written.

    Partial counts shuffle once, packed by shard; a task merges one shard at a time.  Shards are dealt out
    in turn, so a task reads one as long as there are fewer than ``MAX_TASKS``; a hash gives some tasks several.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    shared = spark.sparkContext.broadcast(lex)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for _, _, data, offsets in groups(batch.column(0)):
                    h, doc = _token_stream(data, offsets)
                    word, at = np.unique(h, return_inverse=True)
                    yield np.unique(bigram_key(*_bigrams(h, doc), word_class(shared.value.exact(word))[at]), return_counts=True)

        for key, count in _gathered(every()):
            yield _packed(shards, key, count)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, c = (np.asarray(batch.column(k)) for k in range(2))
            yield _packed(shards, *_merged([(word_key(h.view(np.uint64)), c)]))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(shard: int) -> Iterator[pa.RecordBatch]:
            key, count = _unpacked(*held)
            q = _level(count)
            bits = [shard_bitmap(key[q >= level], level).tobytes() for level in range(1, int(q.max(initial=0)) + 1)]
            n = len(bits)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(range(1, n + 1), pa.int32()), pa.array(bits, pa.binary())], names=["shard", "level", "bits"])

        last, held = None, ([], [])
        for batch in batches:
            for s, k, c in zip(*(batch.column(x).to_pylist() for x in range(3))):
                if s != last and last is not None:
                    yield from of(last)
                    held = ([], [])
                last = s
                held[0].append(k)
                held[1].append(c)
        if last is not None:
            yield from of(last)

    kind = "shard long, keys binary, counts binary"
    parts = docs.select(text_col).mapInArrow(pairs, kind).unionByName(counts.where(bucket(F.col("c")) < lex.bucket).select("h", "c").mapInArrow(words, kind))
    tasks = min(max(8, shards), MAX_TASKS)
    found = parts.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard").mapInArrow(build, "shard long, level int, bits binary")
    return shards, in_small_batches(found, "log-frequency-filter")


@dataclass
class Model:
    lex: Lexicon
    bloom: LogBloom  # its levels under the cutoff stay a table beside the model

    @property
    def budget(self) -> float:
        """F of the module's formula."""
        return 4 * self.lex.false_mass() + 16

    def word_levels(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts (-1 outside the dictionary) and quantised ones (0 inside)."""
        exact = self.lex.exact(word)
        q = np.zeros(len(word), np.int64)
        rare = np.flatnonzero(exact < 0)
        q[rare] = self.bloom.level(word_key(word[rare]))
        return exact, q

    def log10(self, *known: np.ndarray) -> np.ndarray:
        return token_log10(self.lex.whole, self.budget, *known)


def token_log10(whole: float, budget: float, pair_q: np.ndarray, word_c: np.ndarray, word_q: np.ndarray, context_c: np.ndarray, context_q: np.ndarray) -> np.ndarray:
    """log10 p(w | v) of tokens from their levels and exact counts (-1 outside the dictionary)."""
    low = np.where(word_c >= 0, word_c, _low(word_q))
    p0 = (low + 1.0) / (whole * (1 + 2.0**-10))
    n = np.minimum(_low(pair_q), np.where(word_c >= 0, word_c, _high(word_q)))
    context = np.where(context_c >= 0, context_c, _high(context_q)).astype(float)
    back = budget + BACKOFF
    p = (np.minimum(n, context) + back * p0) / (context * (1 + EXCESS) + back + budget)
    return np.log10(np.where(context > 0, p, p0))


def _low(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 2.0 ** (q - 1.0), 0.0)


def _high(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 2.0**q - 1.0, 0.0)


def train(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, Model, DataFrame | None]:
    """Exact word counts (a written table), the model, and the filter's lower levels if it is too large to broadcast."""
    counts = in_small_batches(word_counts(docs, text_col), "word-counts")
    lex = lexicon(counts)
    shards, bits = build_filter(docs, counts, lex, text_col)
    sizes = sorted(((r["level"], r["n"]) for r in bits.groupBy("level").agg(F.sum(F.octet_length("bits")).alias("n")).collect()), reverse=True)
    cutoff, size = sizes[0][0] + 1 if sizes else 1, 0
    for level, n in sizes:
        size += n
        if size > MAX_FILTER_BYTES:
            break
        cutoff = level
    rows = [(r["shard"], r["level"], bytes(r["bits"])) for r in bits.where(F.col("level") >= cutoff).toLocalIterator()]
    return counts, Model(lex, LogBloom(shards, rows, cutoff)), None if cutoff == 1 else bits.where(F.col("level") < cutoff)


def settled(tokens: DataFrame, name: str, low: DataFrame, shards: int) -> DataFrame:
    """``tokens`` with the levels of key ``name`` that were unknown, from the filter's shards."""
    shard = F.shiftright(F.shiftright(name, 16) * F.lit(shards).cast("long"), 32)
    schema = tokens.schema

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.drop_columns(["shard"]) if "shard" in left.column_names else left
        rows = list(zip(*(right.column(c).to_pylist() for c in ("shard", "level", "bits"))))
        q = LogBloom(shards, rows, 1, rows[0][0]).level(left.column(name).to_numpy().view(np.uint64)) if rows else np.zeros(left.num_rows, np.int64)
        return left.set_column(left.column_names.index(f"{name}_q"), f"{name}_q", pa.array(q.astype(np.int32)))

    known = F.col(f"{name}_q") >= 0
    asked = tokens.where(~known).withColumn("shard", shard)
    return tokens.where(known).unionByName(asked.groupBy("shard").cogroup(low.groupBy("shard")).applyInArrow(probe, schema))


def open_scores(local: DataFrame, low: DataFrame, model: Model) -> DataFrame:
    """``(row, open)``: the score of tokens that need the filter's lower levels."""
    tokens = local.select("row", F.explode("open").alias("t")).select("row", "t.*")
    for name in ("pair", "word", "context"):
        tokens = settled(tokens, name, low, model.bloom.shards)
    whole, budget = model.lex.whole, model.budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = (np.asarray(batch.column(c)) for c in ("pair_q", "word_c", "word_q", "context_c", "context_q"))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(token_log10(whole, budget, *known))], names=["row", "p"])

    return tokens.mapInArrow(run, "row long, p double").groupBy("row").agg(F.sum("p").alias("open"))


def score(docs: DataFrame, counts: DataFrame, model: Model, low: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, n_tokens, n_known, base_score, score)``, one per input row.

    A text's frequent words are scored where it is read; its other words travel as
    (hash, row, occurrences) and meet the exact counts in a join.  With ``low`` levels of the
    filter in a table, so do the tokens that need one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    # rows are numbered by (partition, position) inside the task and written, so the numbers are stable
    whole = model.lex.whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, last, data, offsets in groups(batch.column(1)):
                h, doc = _token_stream(data, offsets)
                n = last - first
                before, _ = _bigrams(h, doc)
                word, at = np.unique(np.concatenate([h, [END]]), return_inverse=True)
                exact, q = model.word_levels(word)
                end, at = at[-1], at[:-1]
                ahead = np.concatenate([[end], at[:-1]])
                ahead[np.flatnonzero(doc[1:] != doc[:-1]) + 1] = end
                pair = bigram_key(before, h, word_class(exact)[at])
                distinct, back = np.unique(pair, return_inverse=True)
                pair_q = model.bloom.level(distinct)[back]

                hot = exact[at] >= 0
                part = np.log10((exact[at[hot]] + 1.0) / whole)
                cold = np.flatnonzero(~hot)
                cold = cold[np.lexsort((at[cold], doc[cold]))]
                new = np.ones(len(cold), bool)
                new[1:] = (at[cold[1:]] != at[cold[:-1]]) | (doc[cold[1:]] != doc[cold[:-1]])
                where = np.flatnonzero(new)
                times = np.diff(np.concatenate([where, [len(cold)]])).astype(np.int32)
                hs = h[cold[where]].view(np.int64)
                cuts = np.searchsorted(doc[cold[where]], np.arange(n + 1)).astype(np.int32)

                sure = (pair_q >= 0) & (q[at] >= 0) & (q[ahead] >= 0)
                logs = model.log10(pair_q[sure], exact[at[sure]], q[at[sure]], exact[ahead[sure]], q[ahead[sure]])
                rest = np.flatnonzero(~sure)
                columns = {
                    "pair": pair[rest].view(np.int64), "pair_q": pair_q[rest], "word": word_key(h[rest]).view(np.int64), "word_q": q[at[rest]], "word_c": exact[at[rest]],
                    "context": word_key(before[rest]).view(np.int64), "context_q": q[ahead[rest]], "context_c": exact[ahead[rest]],
                }
                parts = [pa.array(columns[x].astype(np.int32 if t == "int" else np.int64)) for x, t in OPEN.items()]
                opens = np.searchsorted(doc[rest], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(n)), batch.column(0)[first:last], pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc[hot], minlength=n)),
                        pa.array(np.bincount(doc[hot], part, n).astype(float)), pa.array(np.bincount(doc[sure], logs, n).astype(float)),
                        pa.ListArray.from_arrays(pa.array(cuts), pa.array(hs)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(times)),
                        pa.ListArray.from_arrays(pa.array(opens), pa.StructArray.from_arrays(parts, list(OPEN))),
                    ],
                    names=["row", "id", "n_tokens", "hot_known", "hot_score", "score", "rare", "times", "open"],
                )
                row += n

    schema = f"row long, id {kind}, n_tokens long, hot_known long, hot_score double, score double, rare array<long>, times array<int>, open array<struct<{', '.join(f'{x} {t}' for x, t in OPEN.items())}>>"
    local = in_small_batches(docs.select(id_col, text_col).mapInArrow(run, schema), "local-scores")
    rare = local.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("h"), F.col("w.times").alias("times"))
    joined = rare.join(counts.where(bucket(F.col("c")) < model.lex.bucket), "h", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = joined.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(F.col("times") * F.log10((c + 1.0) / F.lit(whole))).alias("rest")
    )
    out = local.select("row", "id", "n_tokens", "hot_known", "hot_score", "score").join(rest, "row", "left")
    if low is not None:
        out = out.join(open_scores(local, low, model), "row", "left").withColumn("score", F.col("score") + F.coalesce("open", F.lit(0.0)))
    return out.select(
        "row", "id", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"), (F.col("hot_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts, model, low = train(docs.where(in_training("doc_id", FOLDS, HELD) | F.col("doc_id").isNull()))
    found = score(docs, counts, model, low)
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id"), FOLDS, HELD).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.lex.total).cast("long").alias("train_tokens"), "base_score", "score",
    )
