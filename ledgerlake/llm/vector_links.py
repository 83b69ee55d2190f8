"""Near-duplicate vectors by product quantisation over coarse inverted lists.

Equal vectors are one item. Items are unit vectors u; a cosine of ``similar``
is a distance of r = sqrt(2 - 2 similar).

* Index: an item belongs to the list of its nearest coarse centroid c. Its
  residual u - c is cut into subspaces of about eight components, each coded
  by the nearest of 256 code words; q is the vector that c and the code words
  add up to, and e = |u - q| is kept beside the code. Centroids and code words
  are fitted on a sample (``SAMPLE`` items, by a hash); every item is indexed.
* Probes: an item x of list a can only have a partner within r in list c if the
  plane between a and c is no farther than r from x. In a difference of random
  direction the part along one line is r / sqrt(dimensions) in the mean, so
  lists whose plane is farther than ``REACH`` times that are left out, and
  none up to REACH**2 dimensions. A pair counts if either side probes the other's list.
* Search: from each query's table of inner products with all code words, |x - q|
  of every item of a probed list is a sum of one lookup for each subspace. No
  partner has |x - q| > r + e, so the others lose nothing; what is left is
  reranked by the exact cosine in double precision.

The search runs in blocks: bins of whole lists (a longer list is dealt over
several bins), of ``BLOCK`` to 4 * ``BLOCK`` items, meet blocks of about twice
as many queries. Pairs never leave their block: it returns the number of links
of each item and one root for each group that links connect.

An item goes to as many blocks as it has bins to probe, which is many times the
input. So bins take turns: those of one turn are dealt about as many rows as
there are items (``TURN`` at least), and what a turn has shuffled is deleted
before the next one. Components of 32 bits are kept as such.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored, swept
from .jaccard_join import components
from .shingles import mixed

SIMILAR = 0.95
SAMPLE = 1 << 16  # items that the index is fitted on, at most (about)
MOST_LISTS = 1 << 12
WORDS = 256
WIDTH = 8
REACH = 4.0
BLOCK = 8192
TURN = 1 << 19  # rows that a turn may deal, however few items there are
SLICE = 2048  # items that a task deals at once
RARE = 1 << 12  # lists for vectors of lengths that the sample has none of
EPS = 1e-4  # rounding of 32-bit sums


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, dims, vector): a digest of each vector and its bytes, scaled by a power of two where they are far from one; null for vectors without links."""
    for batch in batches:
        column = batch.column("v")
        flat, size = column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        kept = np.float32 if flat.type == pa.float32() else np.float64  # each holds its components exactly
        plain = flat.cast(pa.float64()) if pa.types.is_floating(flat.type) or pa.types.is_integer(flat.type) else pa.array([None if x is None else float(x) for x in flat.to_pylist()], pa.float64())
        values = plain.fill_null(np.nan).to_numpy(zero_copy_only=False) + 0.0  # one zero
        narrow, at = values.astype(kept), np.cumsum(size) - size
        most = np.zeros(len(size))
        if len(values):
            most[size > 0] = np.maximum.reduceat(np.abs(values), at[size > 0])
        raw, keys = [None] * len(size), [None] * len(size)
        for i in np.flatnonzero(np.isfinite(most) & (most > 0)).tolist():
            part = slice(at[i], at[i] + size[i])
            whole = values[part] if 1e-100 < most[i] < 1e100 else np.ldexp(values[part], -int(np.frexp(most[i])[1]))
            raw[i] = (narrow[part] if kept == np.float32 else whole).tobytes()
            keys[i] = hashlib.blake2b(whole.tobytes(), digest_size=16).hexdigest()
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(keys, pa.string()), pa.array([None if k is None else n for k, n in zip(keys, size.tolist(), strict=True)], pa.int32()), pa.array(raw, pa.binary())],
            names=["id", "key", "dims", "vector"],
        )


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a binary column, all of ``dims`` components (of 32 bits each, or of 64), as doubles."""
    raw = b"".join(column.to_pylist())
    kept = np.float32 if len(raw) == 4 * dims * len(column) else np.float64
    return np.frombuffer(raw, kept).reshape(-1, dims).astype(np.float64)


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def means(x: np.ndarray, k: int, rounds: int = 5) -> np.ndarray:
    """k centroids of a sample by Lloyd's rounds from the first k rows; an empty one stays where it is."""
    c = x[:k].copy()
    for _ in range(rounds if k < len(x) else 0):
        near = np.concatenate([_squares(x[lo : lo + 4096], c).argmin(axis=1) for lo in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c[n > 0] = (sums[n > 0] / n[n > 0, None]).astype(x.dtype)
    return c


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c."""
    out = x @ c.T
    out *= -2
    out += np.einsum("ij,ij->i", x, x)[:, None]
    out += np.einsum("ij,ij->i", c, c)[None, :]
    return out


class Index:
    """Coarse centroids and subspace code words for vectors of one length; the first list has number ``base``."""

    def __init__(self, sample: np.ndarray, lists: int, base: int):
        x = units(sample).astype(np.float32)
        self.base, self.dims = base, x.shape[1]
        self.coarse = means(x, max(1, min(lists, len(x) // 8)))
        near = np.concatenate([_squares(x[lo : lo + 4096], self.coarse).argmin(axis=1) for lo in range(0, len(x), 4096)])
        rest = x - self.coarse[near]
        edges = np.linspace(0, self.dims, max(1, self.dims // WIDTH) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]
        self.words = [means(rest[:, p], min(WORDS, len(x))) for p in self.parts]

    def code(self, x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(list, code, |q|**2, e, probed lists) of some unit vectors; lists by their place."""
        x32 = x.astype(np.float32)
        d = _squares(x32, self.coarse)
        near = d.argmin(axis=1)
        rest = x32 - self.coarse[near]
        codes = np.stack([_squares(rest[:, p], w).argmin(axis=1) for p, w in zip(self.parts, self.words, strict=True)], axis=1).astype(np.uint8)
        q = self.coarse[near].astype(np.float64)
        for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            q[:, p] += w[codes[:, m]]
        away = np.sqrt(((x - q) ** 2).sum(axis=1))
        reach = r * min(1.0, REACH / self.dims**0.5)
        far = _squares(self.coarse[near], self.coarse)
        np.sqrt(np.maximum(far, 0, out=far), out=far)
        far *= np.float32(2 * reach)
        far += np.float32(EPS)
        d -= d[np.arange(len(x)), near][:, None]
        near_enough = d <= far
        near_enough[np.arange(len(x)), near] = True
        probes = np.split(np.nonzero(near_enough)[1], np.cumsum(near_enough.sum(axis=1))[:-1])
        return near, codes, (q * q).sum(axis=1), away, probes

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What c and the code words add up to, for items of these lists."""
        q = self.coarse[lists - self.base].copy()
        for m, (p, w) in enumerate(zip(self.parts, self.words, strict=True)):
            q[:, p] += w[codes[:, m]]
        return q


def _coded(batches: Iterator[pa.RecordBatch], sent: Broadcast, r: float) -> Iterator[pa.RecordBatch]:
    """The items with their list, code and probed lists."""
    indexes = sent.value
    for batch in batches:
        dims = batch.column("dims").to_numpy()
        for n in np.unique(dims):
            every = np.flatnonzero(dims == n)
            for lo in range(0, len(every), 1024):
                part = batch.take(pa.array(every[lo : lo + 1024]))
                x = units(rows_of(part.column("vector"), int(n)))
                if n in indexes:
                    ix = indexes[n]
                    near, codes, norm, away, probes = ix.code(x, r)
                    near, probes = near + ix.base, [p + ix.base for p in probes]
                else:
                    near = np.full(len(x), -1 - int(n) % RARE)
                    codes, norm, away, probes = np.empty((len(x), 0), np.uint8), np.zeros(len(x)), np.ones(len(x)), [near[:1]] * len(x)
                at = np.cumsum([0, *[len(p) for p in probes]])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm), pa.array(away),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(probes), pa.int32()))],
                    names=[*part.schema.names, "list", "code", "norm", "away", "probes"],
                )


def bins_of(sizes: dict[int, int], indexes: dict[int, Index], block: int) -> dict[int, tuple[int, int]]:
    """(first bin, number of bins) of every list: lists of near centroids share a bin, long lists have several."""
    order = sorted(n for n in sizes if n < 0)
    for ix in indexes.values():
        top = means(ix.coarse, max(1, int(len(ix.coarse) ** 0.5)))
        order += [ix.base + int(i) for i in np.argsort(_squares(ix.coarse, top).argmin(axis=1), kind="stable") if ix.base + int(i) in sizes]
    out, at, room = {}, -1, 0
    for n in order:
        if sizes[n] > block:
            many = -(-sizes[n] // block)
            out[n], at, room = (at + 1, many), at + many, 0
        else:
            if sizes[n] > room:
                at, room = at + 1, block
            out[n], room = (at, 1), room - sizes[n]
    return out


class Deal:
    """Where items go: bins of every list, and blocks of queries and turn of every bin (arrays)."""

    def __init__(self, bins: dict[int, tuple[int, int]]):
        self.n_bins = max((sum(b) for b in bins.values()), default=0)
        self.first, self.many = np.zeros((2, RARE + 1 + max(bins, default=0)), np.int64)
        for n, (first, many) in bins.items():
            self.first[n + RARE], self.many[n + RARE] = first, many
        self.blocks, self.turns = np.ones((2, self.n_bins), np.int64)

    def own(self, batch: pa.RecordBatch) -> np.ndarray:
        """The bin that each item lies in."""
        n = batch.column("list").to_numpy() + RARE
        return self.first[n] + batch.column("id").to_numpy() % self.many[n]

    def probed(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
        """(row, bin, lists) of each bin that a row probes, with the probed lists that lie in it."""
        probes = batch.column("probes")
        lists = probes.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), probes.value_lengths().to_numpy())
        at = np.where(lists + RARE < len(self.many), lists + RARE, 0)
        n = np.where(lists + RARE < len(self.many), self.many[at], 0)
        to = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(row, n) << 32 | to
        order = np.argsort(pair, kind="stable")
        pair, lists = pair[order], np.repeat(lists, n)[order]
        begin = np.flatnonzero(np.diff(pair, prepend=-1))
        rows = pair[begin] >> 32
        return rows, pair[begin] & 0xFFFFFFFF, pa.ListArray.from_arrays(pa.array(np.append(begin, len(pair)), pa.int32()), pa.array(lists, pa.int32()))

    def settle(self, asked: np.ndarray, held: np.ndarray, block: int, rows: int) -> int:
        """Set blocks and turns for bins that so many items ask for and lie in; how many turns of about ``rows`` rows."""
        self.blocks = np.maximum(1, -(-asked // (2 * block)))
        turn, room = 0, rows
        for i, n in enumerate((asked + held * self.blocks).tolist()):
            if n > room and room < rows:
                turn, room = turn + 1, rows
            self.turns[i], room = turn, room - n
        return turn + 1


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _demand(batches: Iterator[pa.RecordBatch], sent: Broadcast) -> Iterator[pa.RecordBatch]:
    """(bin, asked, held) of a task: how many items probe a bin, and how many lie in it."""
    deal = sent.value
    asked, held = np.zeros((2, deal.n_bins), np.int64)
    for part in _slices(batches):
        asked += np.bincount(deal.probed(part)[1], minlength=deal.n_bins)
        held += np.bincount(deal.own(part), minlength=deal.n_bins)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(deal.n_bins), pa.int32()), pa.array(asked), pa.array(held)], names=["bin", "asked", "held"])


def _parts(batch: pa.RecordBatch, at: np.ndarray, more: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """The rows at ``at`` with more columns, some at a time; a column of the same name is replaced."""
    for lo in range(0, len(at), 2 * SLICE):
        part = batch.take(pa.array(at[lo : lo + 2 * SLICE]))
        columns = {n: part.column(n) for n in part.schema.names} | {n: x.slice(lo, 2 * SLICE) for n, x in more.items()}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _members(batches: Iterator[pa.RecordBatch], sent: Broadcast, turn: int) -> Iterator[pa.RecordBatch]:
    """The items of the bins of a turn, once for each block of queries."""
    deal = sent.value
    for part in _slices(batches):
        own = deal.own(part)
        use = np.flatnonzero(deal.turns[own] == turn)
        n = deal.blocks[own[use]]
        at, block = np.repeat(use, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield from _parts(part, at, {"bin": pa.array(own[at], pa.int32()), "block": pa.array(block, pa.int32())})


def _queries(batches: Iterator[pa.RecordBatch], sent: Broadcast, turn: int) -> Iterator[pa.RecordBatch]:
    """The items that probe bins of a turn, once for each bin, with the lists that they probe there."""
    deal = sent.value
    for part in _slices(batches):
        at, to, lists = deal.probed(part)
        use = np.flatnonzero(deal.turns[to] == turn)
        at, to, lists = at[use], to[use], lists.take(pa.array(use))
        block = mixed(part.column("id").to_numpy().astype(np.uint64))[at] % deal.blocks[to].astype(np.uint64)
        yield from _parts(part, at, {"probes": lists, "bin": pa.array(to, pa.int32()), "block": pa.array(block.astype(np.int32))})


def _candidates(q: np.ndarray, x: np.ndarray, of: dict[int, np.ndarray], need: np.ndarray, members: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, member) pairs that the codes do not rule out; q is what the members' codes stand for, ``of`` and ``members`` are by list.

    A product with q is the sum of the lookups for the centroid and the code words, for many pairs at once.
    """
    for n, queries in of.items():
        for lo in range(0, len(members[n]), 2048):
            some = members[n][lo : lo + 2048]
            right, least = q[some].T, need[some]
            for at in range(0, len(queries), 1024):
                a, b = np.nonzero(x[queries[at : at + 1024]] @ right >= least)
                yield queries[at : at + 1024][a], some[b]


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Add the links (a, b) to ``root``, which leads every place to the least one that links connect it with."""
    while True:
        apart = root[a] != root[b]
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root[:] = root[root]


def _links(left: pa.Table, right: pa.Table, indexes: dict[int, Index], similar: float) -> pa.Table:
    """Links between the members of a bin and a block of queries: (id, links, root) of all that have one."""
    r = (2 - 2 * similar) ** 0.5
    ids, copies, lists = (left.column(n).to_numpy() for n in ("id", "copies", "list"))
    dims = left.column("dims").to_numpy()
    q_ids, q_copies, q_lists, q_dims = (right.column(f"q_{n}").to_numpy() for n in ("id", "copies", "list", "dims"))
    need = (1 + left.column("norm").to_numpy() - (r + left.column("away").to_numpy() + EPS) ** 2) / 2 - EPS
    probes, q_probes = left.column("probes").combine_chunks(), right.column("q_probes").combine_chunks()
    probed = np.repeat(np.arange(len(ids)), probes.value_lengths().to_numpy()).astype(np.int64) << 32 | (probes.flatten().to_numpy().astype(np.int64) + RARE)
    probed = np.sort(probed)
    wanted, wanter = q_probes.flatten().to_numpy(), np.repeat(np.arange(len(q_ids)), q_probes.value_lengths().to_numpy())
    nodes, where = np.unique(np.concatenate([q_ids, ids]), return_inverse=True)
    q_node, node = where[: len(q_ids)], where[len(q_ids) :]
    links, root, linked = np.zeros(len(nodes), np.int64), np.arange(len(nodes)), np.zeros(len(nodes), bool)

    def add(q: np.ndarray, m: np.ndarray) -> None:
        """Links are summed up as they are found: a group of near copies has the square of its size."""
        if not len(q):
            return
        back = (m << 32) | (q_lists[q].astype(np.int64) + RARE)  # the member finds this query by itself
        alone = probed[np.minimum(np.searchsorted(probed, back), len(probed) - 1)] != back
        a, b = q_node[q], node[m]
        np.add.at(links, a, copies[m])
        np.add.at(links, b[alone], q_copies[q[alone]])
        linked[a] = linked[b] = True
        hook(root, a, b)

    for n in np.unique(dims):
        at, q_at = np.flatnonzero(dims == n), np.flatnonzero(q_dims == n)
        if not len(q_at):
            continue
        v, w = rows_of(left.column("vector").take(pa.array(at)), int(n)), rows_of(right.column("q_vector").take(pa.array(q_at)), int(n))
        size, q_size = np.sqrt(np.einsum("ij,ij->i", v, v)), np.sqrt(np.einsum("ij,ij->i", w, w))
        place, q_place = np.zeros(len(ids), np.int64), np.full(len(q_ids), -1)
        place[at], q_place[q_at] = np.arange(len(at)), np.arange(len(q_at))
        order = at[np.argsort(lists[at], kind="stable")]
        cut = np.flatnonzero(np.diff(lists[order])) + 1
        members = {int(lists[g[0]]): place[g] for g in np.split(order, cut)}
        use = (q_place[wanter] >= 0) & np.isin(wanted, list(members))
        ask, who = wanted[use], q_place[wanter[use]]
        by = np.argsort(ask, kind="stable")
        ask, who = ask[by], who[by]
        groups = np.split(who, np.flatnonzero(np.diff(ask)) + 1) if len(ask) else []
        of = {int(k): g for k, g in zip(np.unique(ask), groups, strict=True)}
        if n in indexes:
            codes = np.frombuffer(b"".join(left.column("code").take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
            x = (w / q_size[:, None]).astype(np.float32)
            pairs = _candidates(indexes[n].decoded(lists[at], codes), x, of, need[at].astype(np.float32), members)
        else:
            pairs = ((np.repeat(g[lo : lo + 16], len(members[k])), np.tile(members[k], len(g[lo : lo + 16]))) for k, g in of.items() for lo in range(0, len(g), 16))
        for p, m in pairs:
            for part in range(0, len(p), 1 << 16):
                i, j = p[part : part + (1 << 16)], m[part : part + (1 << 16)]
                cosine = np.einsum("ij,ij->i", w[i], v[j]) / (q_size[i] * size[j])
                good = (cosine >= similar) & (q_ids[q_at[i]] != ids[at[j]])
                add(q_at[i[good]], at[j[good]])

    at = np.flatnonzero(linked)
    return pa.table({"id": pa.array(nodes[at], pa.int64()), "links": pa.array(links[at]), "root": pa.array(nodes[root[at]], pa.int64())})


def linked_vectors(rows: DataFrame, similar: float = SIMILAR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row for each of ``rows``: id_col, n_links, component_id, kept.

    Needs an integer id and an array of numbers. Two rows are linked if the
    cosine of their vectors, of equal length, is at least ``similar``; a vector
    that is null, empty, zero or holds a null or not finite component links with
    nothing. n_links counts the other rows that a row is linked with, copies
    included; component_id is the least id that links lead to, the row's own
    included (nulls come last); kept tells whether that is the row's own id.
    Rows that repeat an id have an answer each. An empty table gives an empty one.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    r = (2 - 2 * similar) ** 0.5
    kind = rows.schema[id_col].dataType.simpleString()
    plain = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("v"))
    keyed = stored(plain.mapInArrow(_keyed, f"id {kind}, key string, dims int, vector binary"), "vectors")
    items = keyed.filter("key is not null").groupBy("key").agg(
        F.first("dims").alias("dims"), F.first("vector").alias("vector"), F.count("*").alias("copies"), F.min("id").alias("least")
    )
    items = stored(items.withColumn("id", F.monotonically_increasing_id()), "vector-items")
    vectors, keyed = keyed, stored(keyed.select("id", "key"), "vector-keys")
    names = stored(items.select("key", "id", "copies", "least"), "vector-names")
    dropped(spark, vectors)
    swept(spark)

    total = items.count()
    share = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE / max(total, 1))))
    sample = items.filter(share).select("dims", "vector").toArrow()
    sample = sample.take(pa.array(np.random.default_rng(1).permutation(sample.num_rows)))
    lists = min(MOST_LISTS, 1 << max(0, round(np.log2(max(4 * total**0.5, 1)))))
    indexes, base = {}, 0
    lengths = sample.column("dims").to_numpy()
    for n, count in zip(*np.unique(lengths, return_counts=True), strict=True):
        x = rows_of(sample.column("vector").filter(pa.array(lengths == n)), int(n))
        indexes[int(n)] = Index(x, max(1, lists * int(count) // len(lengths)), base)
        base += len(indexes[int(n)].coarse)
    sent = sc.broadcast(indexes)

    cells = "list int, code binary, norm double, away double, probes array<int>"
    coded = items.select("id", "dims", "vector", "copies").mapInArrow(lambda b: _coded(b, sent, r), f"id long, dims int, vector binary, copies long, {cells}")
    coded = stored(coded, "vector-codes")
    dropped(spark, items)
    sizes = {x["list"]: x["count"] for x in coded.groupBy("list").count().collect()}  # at most one row a list
    block = min(max(BLOCK, total // 16), 4 * BLOCK)
    deal = Deal(bins_of(sizes, indexes, block))
    sent_bins = sc.broadcast(deal)
    asked, held = np.zeros((2, deal.n_bins), np.int64)
    demand = coded.select("id", "list", "probes").mapInArrow(lambda b: _demand(b, sent_bins), "bin int, asked long, held long")
    for x in demand.groupBy("bin").agg(F.sum("asked").alias("asked"), F.sum("held").alias("held")).collect():  # at most one row a bin
        asked[x["bin"]], held[x["bin"]] = x["asked"], x["held"]
    turns = deal.settle(asked, held, block, max(TURN, total))
    sent_deal = sc.broadcast(deal)

    def block_links(left: pa.Table, right: pa.Table) -> pa.Table:
        return _links(left, right, sent.value, similar)

    found, dealt = [], "bin int, block int"
    asking = coded.select("id", "dims", "vector", "copies", "list", "probes")
    fields = "id long, dims int, vector binary, copies long"
    for turn in range(turns):
        members = coded.mapInArrow(lambda b, t=turn: _members(b, sent_deal, t), f"{fields}, {cells}, {dealt}")
        queries = asking.mapInArrow(lambda b, t=turn: _queries(b, sent_deal, t), f"{fields}, list int, probes array<int>, {dealt}")
        queries = queries.toDF(*[f"q_{n}" for n in queries.columns]).groupBy("q_bin", "q_block")
        both = members.groupBy("bin", "block").cogroup(queries)
        found.append(stored(both.applyInArrow(block_links, "id long, links long, root long"), "vector-links"))
        swept(spark)
    dropped(spark, coded)
    found = spark.read.schema(found[0].schema).parquet(*[x.stored_at for x in found])
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    of = names.join(links, "id", "left").join(groups, "id", "left").withColumn("label", F.coalesce("label", "id"))
    of = stored(of, "vector-groups")
    lowest = of.groupBy("label").agg(F.min("least").alias("component_id"))
    answer = of.join(lowest, "label").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = keyed.select("id", "key").join(answer, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
