"""Benchmark decontamination by a prefix-filtered set join.

Every run of ``WINDOW`` item words (a shorter item as a whole) is a window,
taken as the set of its shingles (three words; fewer in shorter windows). The
shingles are ordered by rarity over all documents. A document that contains the
window contains all of its shingles, so one of them, the rarest, is a necessary
prefix: only its places in documents are joined to the window. The place must
leave room for the whole window before and after it (positional and length
bounds), and the words around it must equal the window's words.

Documents are scanned twice: for shingle frequencies and for places. In both a
Bloom filter of the shingles wanted drops the other places before any row is
made; a false positive costs a row and changes nothing. It has ``ROOM`` places
for each shingle (one in two hundred passes by chance), rounded up to a power of
two, and at most 2**``MOST_BITS`` (16 MB): beyond a million shingles it lets more pass.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import content_key, fresh, stored, text_of

WINDOW = 10
SHINGLE = 3
ROOM, LEAST_BITS, MOST_BITS = 16, 17, 24

# Characters between words, once A-Z have been lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words: ASCII letters and digits and all other characters from U+0080; only A-Z change case."""
    # lower() is exact and fast on ASCII words; translate() leaves other capitals alone.
    low = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.array_remove(F.split(text, BETWEEN), ""), low)


def windows_of(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(wtext, len, words) for each distinct window, and (wtext, item_id) for its items."""
    words = items.select("item_id", words_of(text_of("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = words.select("item_id", F.explode_outer(F.transform(starts, lambda i: F.slice("w", i, window))).alias("words"))
    cut = cut.withColumn("wtext", F.array_join("words", " "))
    member = stored(cut.select("wtext", "item_id").distinct(), "window-items")
    wtext = member.select("wtext").distinct()
    words = F.split("wtext", " ")
    return stored(wtext.select("wtext", F.size(words).alias("len"), words.alias("words")), "windows"), member


def _hashed(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles, in order; none if there are fewer words."""
    places = F.sequence(F.lit(0), F.size(words) - k)
    all_ = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, all_).otherwise(F.array().cast("array<bigint>"))


def _slots(h: Column, n: int) -> list[Column]:
    return [F.pmod(F.shiftrightunsigned(h, 21 * i), F.lit(n)) for i in range(3)]


def _filter_of(hashes: DataFrame) -> bytes:
    """A Bloom filter of distinct hashes with one byte for each place; the driver gets a bit for each."""
    bits = min(max((ROOM * hashes.count() - 1).bit_length(), LEAST_BITS), MOST_BITS)
    slot = hashes.select(F.explode(F.array(*[s + 1 for s in _slots(F.col("h"), 1 << bits)])).alias("s"))  # positions count from 1
    marks = slot.groupBy(F.bitmap_bucket_number("s").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("on"))
    table = bytearray(1 << bits)
    for row in marks.collect():
        at = (row["bucket"] - 1) << 15
        for i in range(1 << 15):
            table[at + i] = row["on"][i >> 3] >> (i & 7) & 1
    return bytes(table)


def _wanted(h: Column, table: bytes) -> Column:
    bloom, one = F.lit(table), F.lit(b"\x01")
    hit = [F.substring(bloom, (s + 1).cast("int"), F.lit(1)) == one for s in _slots(h, len(table))]
    return hit[0] & hit[1] & hit[2]


def _wanted_place(table: bytes, place: Column) -> Column:
    return _wanted(place["h"], table)


def _shingles(windows: DataFrame) -> DataFrame:
    """(wtext, len, k, at, h): every shingle of every window."""
    k = F.least(F.col("len"), F.lit(SHINGLE))
    each = [
        windows.filter(k == n).select("wtext", "len", F.lit(n).alias("k"), F.posexplode(_hashed(F.col("words"), n)).alias("at", "h"))
        for n in range(1, SHINGLE + 1)
    ]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _places(docs: DataFrame, keep: list[str], wanted: dict[int, bytes]) -> DataFrame:
    """``docs`` (with words) with, for each k, the wanted places and their hashes as ``p{k}`` and ``h{k}``."""
    out = docs.select(*keep, "words", *[_hashed(F.col("words"), k).alias(f"h{k}") for k in wanted])
    for k, table in wanted.items():
        hs = F.col(f"h{k}")
        placed = F.transform(hs, lambda h, i: F.struct(i.alias("at"), h.alias("h")))
        out = out.withColumn(f"p{k}", F.filter(placed, partial(_wanted_place, table)))
    return out


def _with_words(k: int, window: int, place: Column) -> Column:
    first = F.greatest(place["at"] - (window - k), F.lit(0))
    return F.struct(
        F.lit(k).alias("k"), place["h"].alias("h"), place["at"].alias("at"), first.alias("from"),
        F.slice("words", first + 1, 2 * window - k).alias("near"),
    )


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(key, n_words, text key per row) for all documents, and (key, start, len, wtext) for every window found.

    ``key`` is the digest of the text: documents with the same text share it.
    """
    windows, member = windows_of(items, window)
    shingles = stored(_shingles(windows), "window-shingles")
    split = docs.select("doc_id", content_key().alias("key"), words_of(text_of()).alias("words"))
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())
    # How often each shingle of the benchmark occurs in the documents.
    wanted = {k: _filter_of(shingles.filter(F.col("k") == k).select("h").distinct()) for k in sizes}
    counted = None
    for k in sizes:
        # explode() would add a filter that is pushed below and computes the arrays anew for each element.
        one = _places(split, [], {k: wanted[k]}).select(F.lit(k).alias("k"), F.explode_outer(f"p{k}.h").alias("h"))
        one = one.filter(F.col("h").isNotNull())
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        counted = shingles.select("k", "h")
    often = counted.groupBy("k", "h").agg(F.count("*").alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")
    prefix = stored(
        shingles.join(often, ["k", "h"], "left").groupBy("wtext", "len", "k").agg(F.min(rank).alias("r"))
        .select("k", F.col("r.h").alias("h"), "wtext", "len", F.col("r.at").alias("at")),
        "window-prefixes",
    )
    # The places of those shingles, with as many words around as a window can need.
    wanted = {k: _filter_of(prefix.filter(F.col("k") == k).select("h").distinct()) for k in sizes}
    found = _places(split, ["doc_id", "key"], wanted)
    around = [F.transform(f"p{k}", partial(_with_words, k, window)) for k in sizes]
    none = F.array().cast("array<struct<k:int,h:bigint,at:int,from:int,near:array<string>>>")
    scanned = stored(
        found.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.concat(none, *around).alias("places")),
        "document-places",
    )
    places = scanned.select("key", "n_words", F.explode("places").alias("p")).select("key", "n_words", "p.*")
    pairs = places.withColumnRenamed("at", "place").join(prefix, ["k", "h"])
    start = F.col("place") - F.col("at")
    room = (start >= 0) & (start + F.col("len") <= F.col("n_words"))
    same = F.array_join(F.slice("near", start - F.col("from") + 1, F.col("len")), " ") == F.col("wtext")
    hits = pairs.filter(room).filter(same).select("key", start.alias("start"), "len", "wtext").distinct()
    return scanned.select("doc_id", "key", "n_words"), hits, member


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, key, n_words, n_hit, item_ids (sorted strings).

    Needs doc_id and text of ``docs``, item_id and text of ``items``; other
    columns are not read. Null texts have no words; a null item_id is named
    ``null``; repeated rows each get their row. Empty tables give no hits.
    """
    rows, hits, member = occurrences(docs, items, window)
    hits = stored(hits, "window-hits")
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct(
        (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["upto"]), F.lit(0))).alias("n"),
        F.greatest(a["upto"], s["end"]).alias("upto"),
    ))["n"]
    words = hits.groupBy("key").agg(spans.alias("spans")).select("key", covered.cast("long").alias("n_hit"))
    named = member.select("wtext", F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"))
    found = hits.select("key", "wtext").distinct().join(named, "wtext").groupBy("key").agg(
        F.sort_array(F.collect_set("item")).alias("item_ids")
    )
    hit = stored(words.join(found, "key"), "contaminated")
    return rows.join(hit, "key", "left").select(
        "doc_id", "key", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text contains a window of an item; columns and repeated rows stay."""
    (key,) = fresh(docs, "_key")
    hits = stored(occurrences(docs, items, window)[1].select(F.col("key").alias(key)).distinct(), "contaminated-texts")
    return docs.withColumn(key, content_key()).join(hits, key, "left_anti").drop(key)
