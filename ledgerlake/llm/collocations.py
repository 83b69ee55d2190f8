"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a circle, shard t mod S at
step t. Words are counted from the start. As soon as both subphrases of a longer
phrase (all words but the last, all but the first) have reached the threshold,
at step r the later one, the phrase is counted too: from step r + 1 on, whatever
shard is next, for one full circle of S steps. So lengths overlap, instead of one
whole scan for each, and every phrase that is counted is counted in every shard
once. A phrase that reaches the threshold has subphrases that do, hence none is
missed. Scans end when no phrase has reached it for S steps.

Which phrases have reached the threshold, and when, is kept in an array of
slots, addressed by the phrase's hash, that tasks are sent: one byte holds the
first step at which a phrase of that slot reached it. Slots are never changed
once set, so phrases that share one are merely counted without need, for a full
circle as well. The array has one slot for ``BYTES_PER_SLOT`` bytes of text, at
most 2**``MOST_SLOT_BITS`` (64 MB); when it is crowded the counting only prunes
less. Shards hold a 32-bit code for each word, and counts live in a table keyed
by 64 bits of hash; both can only overstate. The phrases that survive are counted
once more by their words in a last scan of the texts, and those numbers are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import dropped, stored, swept, text_of
from .shingles import SECOND, mixed, raw_bytes, row_of, small, span_hashes, word_spans

LONGEST = 5
SHARDS = 4
THRESHOLD = 100
TOP = 2000
BYTES_PER_SLOT, LEAST_SLOT_BITS, MOST_SLOT_BITS = 256, 16, 26
HELD = 1 << 20  # hashes that a task holds before it sums them up
SALTS = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
# What bytes count as: words are runs without blank, tab and the marks that end a piece; A-Z count as a-z.
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
WORDS = LOWER.astype(np.uint64) + np.uint64(1)
WORDS[ENDS] = 0
WORDS[[0x20, 0x09]] = 0


class Words:
    """The words of a batch of texts: bytes, spans, row, code (32 bits, never 0), and whether the next word is in the same piece."""

    def __init__(self, batch: pa.RecordBatch, seed: int = 0):
        self.data, at = raw_bytes(batch.column("text"))
        firsts, lasts, hashes, counts = [], [], [], []
        lo = 0
        while lo < len(at) - 1:
            hi = min(max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20)))), len(at) - 1)
            part, cuts = self.data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            first, last = word_spans(part, cuts, WORDS)
            hashes.append(span_hashes(part, first, last, WORDS, seed))
            counts.append(np.diff(np.searchsorted(first, cuts)))
            firsts.append(first + at[lo])
            lasts.append(last + at[lo])
            lo = hi
        self.first, self.last = np.concatenate(firsts), np.concatenate(lasts)
        self.offsets = np.cumsum(np.concatenate([[0], *counts]))
        self.rows = row_of(self.offsets)
        self.full = mixed(np.concatenate(hashes) ^ span_codes(batch.column("lang"))[self.rows])
        self.code = np.maximum((self.full >> np.uint64(32)).astype(np.uint32), 1)
        piece = np.cumsum(ENDS[self.data], dtype=np.int32)[self.first]
        self.linked = (self.rows[1:] == self.rows[:-1]) & (piece[1:] == piece[:-1])


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, codes): the codes of each text, a 0 after every piece."""
    for batch in small(batches):
        words = Words(batch)
        ends = np.flatnonzero(~np.append(words.linked, False)) + 1 if len(words.code) else np.empty(0, np.int64)
        codes = np.insert(words.code, ends, 0)
        at = words.offsets + np.searchsorted(ends, words.offsets, side="right")
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(codes.view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("shard"), lists], names=["shard", "codes"])


def span_codes(column: pa.Array) -> np.ndarray:
    """A number for each language name."""
    names = column.to_pylist()
    code = {n: np.uint64(int.from_bytes(n.encode()[-7:], "big")) for n in set(names)}
    mix = {n: mixed(np.array([c], np.uint64))[0] ^ np.uint64(sum(n.encode())) for n, c in code.items()}
    return np.array([mix[n] for n in names], np.uint64).reshape(-1)


def slot_of(h: np.ndarray, bits: int) -> np.ndarray:
    return h >> np.uint64(64 - bits)


def growing(codes: np.ndarray, linked: np.ndarray, slots: np.ndarray, bits: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places, hash, start step) of the phrases whose two subphrases have a slot, for each length k.

    ``codes`` are those of words, 0 where there is none; ``linked`` tells whether the place after is of the same piece.
    """
    at = np.flatnonzero(codes)
    single = mixed(codes.astype(np.uint64))
    acc, start = single[at], np.zeros(len(at), np.uint8)
    for k in range(1, longest + 1):
        h = acc if k == 1 else mixed(acc ^ np.uint64(k))
        yield k, at, h, start
        if k == longest or not len(at):
            return
        reached = np.zeros(len(codes) + 1, np.uint8)
        slot = slots[slot_of(h, bits)]
        reached[at] = np.where(slot > 0, np.maximum(slot, start), 0)  # not before the phrase itself is seen, whoever set its slot
        both = (reached[at] > 0) & (reached[at + 1] > 0)
        if k == 1:
            both &= np.append(linked, False)[at]
        acc, at = acc[both] * _STEP, at[both]
        acc += single[at + k]
        start = np.maximum(reached[at], reached[at + 1])


def _summed(held: list[tuple[np.ndarray, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(h, tag, n) of the hashes that a task holds; tag is start * 8 + k."""
    h = np.concatenate([x[0] for x in held])
    tag = np.concatenate([x[1] for x in held])
    order = np.argsort(h)
    h, tag = h[order], tag[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    n = np.diff(np.append(first, len(h)))
    h, tag = h[first].view(np.int64), tag[first]
    for lo in range(0, len(h), 1 << 17):
        part = slice(lo, lo + (1 << 17))
        yield pa.RecordBatch.from_arrays([pa.array(h[part]), pa.array(tag[part], pa.int32()), pa.array(n[part], pa.int64())], names=["h", "tag", "n"])


def _scan(batches: Iterator[pa.RecordBatch], step: int, shards: int, longest: int, slots: Broadcast) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases that are being counted at this step."""
    array = slots.value
    bits = int(len(array)).bit_length() - 1
    held, size = [], 0
    for batch in batches:
        column = batch.column("codes")
        every, ends = column.flatten().to_numpy().view(np.uint32), np.cumsum(column.value_lengths().to_numpy())
        lo = 0
        while lo < len(ends):  # whole texts, of about a million places
            begin = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, begin + (1 << 20))))
            codes = every[begin : int(ends[min(hi, len(ends)) - 1])]
            lo = hi
            for k, _, h, start in growing(codes, codes[1:] != 0, array, bits, longest):
                now = (start <= step) & (start.astype(np.int32) + shards > step)
                h, start = h[now], start[now]
                if len(h):
                    held.append((h, start.astype(np.int32) * 8 + k))
                    size += len(h)
            if size >= HELD:
                yield from _summed(held)
                held, size = [], 0
    if size:
        yield from _summed(held)


def written(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The strings that begin at these bytes; they may overlap."""
    out = []
    for lo in range(0, len(start), 1 << 16):  # places take eight bytes for each byte
        n = size[lo : lo + (1 << 16)].astype(np.int64)
        ends = np.cumsum(n)
        place = np.arange(ends[-1]) + np.repeat(start[lo : lo + (1 << 16)] - (ends - n), n)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        out.append(pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(data[place])))
    return pa.chunked_array(out, pa.large_string()).combine_chunks()


def grouped(h: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where each distinct pair of hashes begins in it)."""
    order = np.argsort(h)
    x, y = h[order], second[order]
    if ((x[1:] == x[:-1]) & (y[1:] != y[:-1])).any():  # hardly ever
        order = np.lexsort((second, h))
        x, y = h[order], second[order]
    return order, np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))


class Spelling:
    """Phrases of a task with their counts, told apart by two hashes.

    Each batch of texts adds its distinct phrases. When ``HELD`` are there, equal
    ones are summed up, and are handed on if that leaves more than half.
    """

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []  # hash, second hash, count, language, length, phrase
        self.size = 0
        self.langs: dict[str, int] = {}
        self.totals: dict[str, int] = {}

    def add(self, h: np.ndarray, second: np.ndarray, lang: np.ndarray, k: int, spell) -> None:
        order, first = grouped(h, second)
        at = order[first]
        n = np.diff(np.append(first, len(h)))
        self.held.append((h[at], second[at], n, lang[at], np.full(len(at), k, np.int32), spell(at)))
        self.size += len(at)

    def sum_up(self) -> None:
        h, second, n, lang, k = (np.concatenate([x[i] for x in self.held]) for i in range(5))
        order, first = grouped(h, second)
        at = order[first]
        phrase = pa.chunked_array([x[5] for x in self.held]).take(pa.array(at)).combine_chunks()
        self.held = [(h[at], second[at], np.add.reduceat(n[order], first), lang[at], k[at], phrase)]
        self.size = len(at)

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """What is to be handed on now."""
        if self.held and (last or self.size >= HELD):
            self.sum_up()
            if last or self.size > HELD // 2:
                _, _, n, lang, k, phrase = self.held[0]
                names = pa.array(list(self.langs), pa.string())
                for lo in range(0, self.size, 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(lang[part])), pa.array(k[part]), phrase[part].cast(pa.string()), pa.array(n[part], pa.int64())], names=["lang", "k", "phrase", "n"])
                self.held, self.size = [], 0
        if last and self.totals:
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip((list(self.totals), [0] * len(self.totals), [""] * len(self.totals), list(self.totals.values())), kinds, strict=True)],
                names=["lang", "k", "phrase", "n"])


def _spelled(batches: Iterator[pa.RecordBatch], longest: int, slots: Broadcast) -> Iterator[pa.RecordBatch]:
    """(lang, k, phrase, n) of the phrases in the slots, summed up in each task; k = 0 has the number of words of each language."""
    array = slots.value
    bits = int(len(array)).bit_length() - 1
    found = Spelling()
    for batch in small(batches):
        names = batch.column("lang").to_pylist()
        words, twin = Words(batch), Words(batch, SECOND).full
        per_row = np.bincount(words.rows, minlength=batch.num_rows)
        for lang, n in zip(names, per_row.tolist(), strict=True):
            found.totals[lang] = found.totals.get(lang, 0) + n
        langs = np.array([found.langs.setdefault(x, len(found.langs)) for x in names], np.int32)[words.rows]
        size = words.last - words.first
        start = np.cumsum(size + 1) - (size + 1)
        line = np.full(int((size + 1).sum()), 0x20, np.uint8)  # all words, a blank after each
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        line[np.repeat(start, size) + within] = LOWER[words.data[np.repeat(words.first, size) + within]]
        for k, at, h, _ in growing(words.code, words.linked, array, bits, longest):
            kept = array[slot_of(h, bits)] > 0
            at, h = at[kept], h[kept]
            if not len(at):
                continue
            second = twin[at].copy()
            for j in range(1, k):
                second = second * _STEP + twin[at + j]

            def spell(i: np.ndarray, at=at, k=k) -> pa.Array:
                begin, end = at[i], at[i] + (k - 1)
                return written(line, start[begin], start[end] + size[end] - start[begin])

            found.add(h, second, langs[at], k, spell)
        yield from found.batches()
    yield from found.batches(last=True)


def _set_slots(reached: DataFrame, slots: np.ndarray, value: int) -> int:
    """Give every free slot of the hashes in ``reached`` the value; how many were free. The driver gets one bit for each slot."""
    bits = int(len(slots)).bit_length() - 1
    slot = F.shiftrightunsigned("h", 64 - bits) + 1  # positions count from 1, and so do buckets of 2**15 of them
    marks = reached.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    new = 0
    for row in marks.collect():  # at most 2**MOST_SLOT_BITS / 2**15 rows of 4 KB
        on = np.flatnonzero(np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little"))
        at = on + ((row["bucket"] - 1) << 15)
        at = at[slots[at] == 0]
        slots[at] = value
        new += len(at)
    return new


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, shards: int = SHARDS) -> DataFrame:
    """(lang, k, phrase, n): all phrases of 1 to ``longest`` words that occur ``threshold`` times, and k = 0: all words of a language."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    size = Observation()
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    dealt = texts.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
    dealt = dealt.observe(size, F.sum(F.octet_length("text")).alias("bytes"))
    corpus = stored(dealt.mapInArrow(_coded, "shard int, codes array<int>"), "shards", "shard")
    n_bytes = size.get["bytes"] or 0
    bits = min(max((n_bytes // BYTES_PER_SLOT).bit_length(), LEAST_SLOT_BITS), MOST_SLOT_BITS)
    slots = np.zeros(1 << bits, np.uint8)

    state, step, last_reach = None, 0, -1
    while step < shards or step < last_reach + 1 + shards:
        sent = sc.broadcast(slots.copy())
        scan = lambda batches, t=step, b=sent: _scan(batches, t, shards, longest, b)
        shard = corpus.filter(F.col("shard") == step % shards).select("codes")
        counts = shard.mapInArrow(scan, "h long, tag int, n long")
        counts = counts if state is None else counts.unionByName(state)
        summed = counts.groupBy("h").agg(F.min("tag").alias("tag"), F.sum("n").alias("n"))
        in_circle = F.shiftright("tag", 3) + F.lit(shards - 1) > step
        new = stored(summed.filter(in_circle | (F.col("n") >= threshold)), "phrase-counts")
        reached = new.filter((F.col("n") >= threshold) & (F.col("tag").bitwiseAND(7) < longest))
        if _set_slots(reached, slots, step + 1):
            last_reach = step
        if state is not None:
            dropped(spark, state)
        sent.unpersist()
        swept(spark)
        state, step = new, step + 1
        if step >= 250:
            raise RuntimeError("too many shards for the steps that a slot can hold")

    final = np.zeros(1 << bits, np.uint8)
    _set_slots(state.filter(F.col("n") >= threshold), final, 1)
    sent = sc.broadcast(final)
    spelled = texts.mapInArrow(
        lambda batches: _spelled(batches, longest, sent), "lang string, k int, phrase string, n long"
    )
    found = spelled.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    found = stored(found.filter((F.col("k") == 0) | (F.col("n") >= threshold)), "phrases")
    dropped(spark, state, corpus)
    sent.unpersist()
    return found


def collocations(
    docs: DataFrame, threshold: int = THRESHOLD, longest: int = LONGEST, top: int | None = TOP, shards: int = SHARDS,
) -> DataFrame:
    """Phrases of 2 to ``longest`` words by language: lang, rank, phrase, a, l, r, n, score.

    Needs text (null: empty) and lang (null: ``und``); other columns are not
    read. Texts are lower-cased in A-Z and cut into pieces at ``.,;:!?`` and line
    ends; words are runs without blank and tab, and a phrase lies in one piece.
    n is the number of words of the language, a how often the phrase occurs, at
    least ``threshold``, overlaps included. Cut after its first words it leaves
    parts that occur l and r times; score is the least floor(1000 a n / (l r))
    over all cuts, the shortest first part winning ties. A phrase that a longer
    one contains without occurring less is left out. Each language has ``top``
    rows (None: all), by score and a, both descending, then by phrase. Repeated
    rows count as often as they occur; a table without frequent phrases, or
    without rows, gives no row.
    """
    found = frequent_phrases(docs, threshold, longest, shards)
    parts = found.filter("k > 0").select("lang", "phrase", "n")
    candidates = found.filter("k > 1").withColumn("words", F.split("phrase", " "))
    words, k = F.col("words"), F.col("k")

    inner = F.flatten(F.transform(
        F.sequence(F.lit(2), k - 1),
        lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice(words, i, m), " ")),
    ))
    held = candidates.filter("k > 2").select("lang", "n", F.explode(inner).alias("phrase"))
    longer = held.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("n")))

    cuts = kept.select("lang", "phrase", F.col("n").alias("a"), "words", "k", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("left"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("right"),
    )
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    totals = found.filter("k = 0").select("lang", F.col("n").alias("total"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    rated = cuts.join(totals, "lang").withColumn("up", big("a") * big("total")).select(
        "lang", "phrase", "a", "l", "r", F.col("total").alias("n"), "cut",
        F.expr("cast(up * 1000 as decimal(38,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("score"),
    )
    best = rated.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.*")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if top is not None:  # a language's rows are thinned in many tasks before they meet in one
        salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
        best = best.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
        best = best.filter(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    ranked = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
