"""N-gram Jaccard join: which documents share at least 80 % of their word shingles, and the groups they form.

Method. A document is the set of its 5-word shingles, as sorted 64-bit hashes; equal sets are one class.
Sets are compared only within tiles: they must share a shingle of their prefixes and lie in a size band
that allows the similarity. A prefix is the rarest fifth of a set, by the number of sets a shingle occurs
in, so two sets above the threshold always share a prefix shingle, and at the first one they share, what is left of both sets must suffice
for the overlap. Each set carries a parity bitmap of its
hashes. Differing bits are a lower bound of the symmetric difference, hence an upper bound of the overlap,
and discard most pairs before the sorted arrays are intersected exactly.

Groups. A shingle that many sets share would need all pairs of its holders. Instead every tile first links
its members to one of them (a star). What that leaves apart is completed exactly: pairs of a tile whose
members still lie in different components. Pairs inside a component are never formed, so a group of a
million copies costs a million comparisons, and no link between components is lost.

Cases: null and empty texts and texts without words have the empty set, size 0, and stand alone. With fewer
than five words the whole sequence is the one shingle. Repeated rows and equal texts are one class. A null
id is never the smallest of a group that has another one. Texts are read whole. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitehex.llm.common import WordHash, batch, each_text, free_name, mix, small_batches, staged
from sitehex.llm.components import components

WORDS = 5
PERCENT = 80
#: A shingle in more sets than this is frequent: it comes last in the order and its tiles start with a star.
FREQUENT = 8
#: Frequent shingles known to the tasks; further ones are only ordered less well, their tiles are complete too.
MAX_FREQUENT = 1 << 19
#: Shingles held by a task before it hands on its sorted blocks.
FLUSH = 1_500_000
TILE_FLUSH = 500_000
POWER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, hashes: WordHash, width: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    with np.errstate(over="ignore"):
        if n < width:
            h = np.uint64(n)
            for x in w:
                h = mix(h * POWER + x)
            return np.array([h], np.uint64)
        h = w[: n - width + 1].copy()
        for i in range(1, width):
            h = h * POWER + w[i : n - width + 1 + i]
        return np.unique(mix(h))


def needed_overlap(total: np.ndarray | int) -> np.ndarray | int:
    """Smallest intersection of two sets with ``total`` elements together: 100 * i >= 80 * union."""
    return -(-PERCENT * total // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def parity_bits(h: np.ndarray) -> bytes:
    """Bitmap whose bits are the parities of the hashes that fall on them; about as many bits as hashes."""
    bits = min(4096, max(64, 1 << (len(h) - 1).bit_length())) if len(h) else 64
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference; the longer bitmap is folded to the shorter one's length."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a), len(b)
    while n != m:
        if n > m:
            n //= 2
            x = (x >> (8 * n)) ^ (x & ((1 << (8 * n)) - 1))
        else:
            m //= 2
            y = (y >> (8 * m)) ^ (y & ((1 << (8 * m)) - 1))
    return (x ^ y).bit_count()


def size_band(n: str) -> Column:
    """Bands grow by a quarter, so similar sets lie in the same or in neighbouring bands."""
    return F.floor(F.log(F.col(n).cast("double")) / F.lit(math.log(100 / PERCENT))).cast("int")


def _narrow(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def _ranges(documents: DataFrame) -> int:
    """A power of two, several ranges of hashes for each shuffle partition."""
    return 1 << (4 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


def _set_id(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def frequent_shingles(documents: DataFrame, above: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper halves of the hashes that occur in more than ``above`` sets, ascending, and their counts.

    All shingles of all documents are counted. They are shuffled as sorted blocks of differences, one
    block per range of hashes, which takes about two bytes a shingle.
    """
    ranges = _ranges(documents)
    shift = 32 - (ranges.bit_length() - 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, waiting, held = WordHash(), set(), [], 0

        def flush() -> pa.RecordBatch:
            every = np.sort(np.concatenate(waiting))
            cuts = np.searchsorted(every, np.arange(1, ranges, dtype=np.uint64) << np.uint64(shift))
            rows = [(r, part) for r, part in enumerate(np.split(every, cuts)) if len(part)]
            packed = [np.diff(p, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes() for _, p in rows]
            return batch([("r", pa.array([r for r, _ in rows], pa.int32())), ("block", pa.array(packed, pa.binary()))])

        for text in each_text(batches, 0):
            h = shingles(text, hashes)
            key = _set_id(h)
            if key in seen:
                continue
            seen.add(key)
            waiting.append((h >> np.uint64(32)).astype(np.uint32))
            held += len(h)
            if held >= FLUSH:
                yield flush()
                waiting, held = [], 0
        if held:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            np.cumsum(np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32)
            for b in batches for x in b.column(1).to_pylist()
        ]
        if parts:
            h, n = np.unique(np.concatenate(parts), return_counts=True)
            many = n > above
            yield batch([("h", pa.array(h[many].astype(np.int64))), ("n", pa.array(n[many].astype(np.int64)))])

    dealt = documents.select("text").mapInArrow(blocks, "r int, block binary").repartition("r")
    found = dealt.mapInArrow(count, "h bigint, n bigint").orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = found.column("h").to_numpy().astype(np.uint32), found.column("n").to_numpy().astype(np.int32)
    order = np.argsort(h)
    return h[order], n[order]


SETS = "doc_id bigint, text_hash bigint, n bigint, sid bigint, rare_share double, bits binary, rare binary, frequent array<bigint>"


def shingle_sets(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per document: size and id of its set, bitmap, and its prefix shingles, rare ones and frequent ones."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        known, counts = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                n, sid, share, bits, rare, often = [], [], [], [], [], []
                for text in b.column(1).to_pylist():
                    h = shingles(text, hashes)
                    n.append(len(h))
                    sid.append(_set_id(h))
                    bits.append(parity_bits(h))
                    upper = (h >> np.uint64(32)).astype(np.uint32)
                    place = np.minimum(np.searchsorted(known, upper), max(len(known) - 1, 0))
                    hot = known[place] == upper if len(known) else np.zeros(len(h), bool)
                    p = prefix_length(len(h)) if len(h) else 0
                    few = h[~hot][:p]
                    many, by = h[hot], counts[place[hot]] if len(known) else np.zeros(0)
                    more = many[np.lexsort((many, by))][: p - len(few)]
                    share.append(1 - len(many) / len(h) if len(h) else 1.0)
                    rare.append(few.tobytes())
                    often.append(more.view(np.int64).tolist())
                yield batch([
                    ("doc_id", b.column(0)), ("text_hash", b.column(2)),
                    ("n", pa.array(n, pa.int64())), ("sid", pa.array(sid, pa.int64())),
                    ("rare_share", pa.array(share, pa.float64())), ("bits", pa.array(bits, pa.binary())),
                    ("rare", pa.array(rare, pa.binary())), ("frequent", pa.array(often, pa.list_(pa.int64()))),
                ])

    return _narrow(documents).mapInArrow(run, SETS)


def _rare_tiles(sets: DataFrame) -> DataFrame:
    """Pairs of sets that meet at a rare prefix shingle and allow the similarity by size and by the place they meet at.

    star: the pair holds its tile's first set. Tiles above FREQUENT (of shingles left out of the known list)
    come back as rows of their own, with the shingle in ``key`` and the set in ``a``.
    """
    ranges = _ranges(sets)
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        waiting: list[tuple[np.ndarray, ...]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            keys, sids, sizes, places = (np.concatenate(x) for x in zip(*waiting))
            order = np.argsort(keys)
            keys, sids, sizes, places = keys[order], sids[order], sizes[order], places[order]
            r = (keys >> shift).astype(np.int64)
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            ends = np.append(starts[1:], len(r))
            cut = lambda x: pa.array([x[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary())
            return batch([
                ("r", pa.array(r[starts], pa.int64())), ("keys", cut(keys)), ("sids", cut(sids)), ("sizes", cut(sizes)),
                ("places", cut(places)),
            ])

        for b in batches:
            for sid, n, rare in zip(*(c.to_pylist() for c in b.columns)):
                if sid in seen or not rare:
                    continue
                seen.add(sid)
                keys = np.frombuffer(rare, np.uint64)
                place = np.arange(len(keys), dtype=np.int32)
                waiting.append((keys, np.full(len(keys), sid, np.int64), np.full(len(keys), n, np.int32), place))
                held += len(keys)
                if held >= TILE_FLUSH:
                    yield flush()
                    waiting, held = [], 0
        if held:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [
            [np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.int64, np.int32, np.int32))]
            for b in batches for row in zip(*(c.to_pylist() for c in b.columns[1:]))
        ]
        if not parts:
            return
        keys, sids, sizes, places = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(keys, kind="stable")
        repeated = np.zeros(len(keys), bool)
        same = keys[order][1:] == keys[order][:-1]
        repeated[1:] |= same
        repeated[:-1] |= same
        order = order[repeated]  # shingles of a single set are most of them
        order = order[np.lexsort((sids[order], sizes[order], keys[order]))]
        keys, sids, sizes, places = keys[order], sids[order], sizes[order].astype(np.int64), places[order].astype(np.int64)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])
        keys, sids, sizes, places = keys[new], sids[new], sizes[new], places[new]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
        count = np.diff(np.append(starts, len(keys)))[group] if len(keys) else np.zeros(0, int)
        large = count > FREQUENT
        if large.any():
            yield batch([
                ("star", pa.array(np.zeros(large.sum(), bool))), ("a", pa.array(sids[large])),
                ("b", pa.array(sizes[large])), ("key", pa.array(keys[large].view(np.int64))), ("place", pa.array(places[large])),
            ])
        keys, sids, sizes, places, group = keys[~large], sids[~large], sizes[~large], places[~large], group[~large]
        found, step = [], 1
        while True:
            near = group[step:] == group[:-step]
            if not near.any():
                break
            n, m = sizes[:-step], sizes[step:]
            left = np.minimum(n - places[:-step], m - places[step:])  # elements from here on, this one included
            fit = np.flatnonzero(near & (100 * n >= PERCENT * m) & (left >= needed_overlap(n + m)))
            first = np.ones(len(group), bool)
            first[1:] = group[1:] != group[:-1]
            found.append(pd.DataFrame({
                "a": np.minimum(sids[fit], sids[fit + step]), "b": np.maximum(sids[fit], sids[fit + step]), "star": first[fit],
            }))
            step += 1
        if found:
            every = pd.concat(found).sort_values("star", ascending=False, kind="stable").drop_duplicates(["a", "b"])
            yield batch([
                ("star", pa.array(every["star"].to_numpy())), ("a", pa.array(every["a"].to_numpy())),
                ("b", pa.array(every["b"].to_numpy())), ("key", pa.nulls(len(every), pa.int64())),
                ("place", pa.nulls(len(every), pa.int64())),
            ])

    packed = sets.select("sid", "n", "rare").mapInArrow(blocks, "r bigint, keys binary, sids binary, sizes binary, places binary")
    return packed.repartition("r").mapInArrow(meet, "star boolean, a bigint, b bigint, key bigint, place bigint")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(pairs: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are similar: bitmaps first, then the sorted arrays."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m, x, y = (b.column(i).to_pylist() for i in range(2, 6))
            keep = [
                differing_bits(p, q) <= i + j - 2 * needed_overlap(i + j) for i, j, p, q in zip(n, m, x, y)
            ]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = lambda side, n, bits: classes.select(F.col("sid").alias(side), F.col("n").alias(n), F.col("bits").alias(bits))
    bounded = pairs.join(of("a", "n", "x"), "a").join(of("b", "m", "y"), "b")
    likely = staged(
        bounded.select("a", "b", "n", "m", "x", "y").mapInArrow(possible, "a bigint, b bigint"), "jaccard-likely"
    )
    ids = likely.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    wanted = staged(
        classes.join(ids, "sid").select("text_hash", F.coalesce("rep", F.lit(0)).alias("id")).distinct(), "jaccard-wanted"
    )

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                made = [shingles(t, hashes) for t in b.column(0).slice(at, 1000).to_pylist()]
                yield batch([
                    ("sid", pa.array([_set_id(h) for h in made], pa.int64())),
                    ("h", pa.array([h.tobytes() for h in made], pa.binary())),
                ])

    holders = _narrow(documents).withColumn("id", F.coalesce("doc_id", F.lit(0))).join(wanted, ["text_hash", "id"], "left_semi")
    sorted_sets = staged(holders.select("text").mapInArrow(arrays, "sid bigint, h binary").dropDuplicates(["sid"]), "jaccard-arrays")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, h: sorted_sets.select(F.col("sid").alias(name), F.col("h").alias(h))
    compared = likely.join(side("a", "p"), "a").join(side("b", "q"), "b").select("a", "b", "p", "q")
    return compared.mapInArrow(exact, "a bigint, b bigint")


def _across(holders: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of a frequent shingle's holders that lie in different components and fit by size.

    In each tile the largest component is only ever the other side, so its own members never meet. A
    pair is kept where the elements from the shared shingle on would suffice, which holds at the first
    shingle that two similar sets share.
    """
    named = F.coalesce("component", "sid").alias("c")
    placed = holders.join(members, "sid", "left").select("key", "sid", "n", "place", named)
    shares = placed.groupBy("key", "c").agg(F.count("*").alias("k"))
    largest = shares.groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("parts"))
    open_tiles = largest.where(F.col("parts") > 1).select("key", "top")
    rest = placed.join(open_tiles, "key").where(F.col("c") != F.col("top"))
    left = rest.select("key", F.col("sid").alias("s"), F.col("n").alias("ns"), F.col("place").alias("ps"), F.col("c").alias("cs"))
    remaining = F.least(F.col("n") - F.col("place"), F.col("ns") - F.col("ps"))
    pairs = placed.join(left, "key").where(
        (F.col("c") != F.col("cs"))
        & (100 * F.least("n", "ns") >= PERCENT * F.greatest("n", "ns"))
        & ((100 + PERCENT) * remaining >= PERCENT * (F.col("n") + F.col("ns")))
    )
    return pairs.select(*_ordered(F.col("sid"), F.col("s"))).distinct()


def jaccard_groups(documents: DataFrame, above: int = FREQUENT, most: int = MAX_FREQUENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), text_hash, component of every row of ``documents`` (doc_id, text)."""
    with small_batches(documents.sparkSession):
        return _grouped(documents, above, most)


def _grouped(documents: DataFrame, above: int, most: int) -> DataFrame:
    frequent = frequent_shingles(documents, above, most)
    sets = staged(shingle_sets(documents, frequent), "jaccard-sets")
    filled = sets.where(F.col("n") > 0)
    classes = staged(
        filled.groupBy("sid").agg(
            F.min("doc_id").alias("rep"), F.min_by("text_hash", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("text_hash"),
            F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("rare_share").alias("rare_share"),
        ), "jaccard-classes",
    )
    met = staged(_rare_tiles(filled), "jaccard-tiles")
    holders = staged(
        filled.select("sid", "n", "rare", F.posexplode("frequent").alias("at", "key"))
        .select("sid", "n", "key", (F.octet_length("rare") / 8 + F.col("at")).cast("bigint").alias("place"))
        .union(met.where(F.col("key").isNotNull()).select(F.col("a").alias("sid"), F.col("b").alias("n"), "key", "place"))
        .distinct(), "jaccard-holders",
    )
    # A text that others were edited from has the fewest rare shingles, which makes it the best centre.
    banded = holders.join(classes.select("sid", "rare_share"), "sid").withColumn("band", size_band("n"))
    centres = banded.groupBy("key", "band").agg(F.min(F.struct("rare_share", "sid", "n")).alias("centre"))
    near = [centres.select("key", (F.col("band") + d).alias("band"), "centre") for d in (-1, 0, 1)]
    stars = (
        banded.join(near[0].union(near[1]).union(near[2]), ["key", "band"])
        .where(F.col("sid") != F.col("centre.sid"))
        .where(100 * F.least("n", "centre.n") >= PERCENT * F.greatest("n", "centre.n"))
        .select(*_ordered(F.col("sid"), F.col("centre.sid")))
    )
    rare = met.where(F.col("key").isNull())
    first = staged(rare.where("star").select("a", "b").union(stars).distinct(), "jaccard-stars")
    links = staged(linked(first, classes, documents), "jaccard-links")
    members = staged(_members(links), "jaccard-members")
    apart = _different(rare.where(~F.col("star")).select("a", "b"), members).union(
        _across(holders, members).join(first, ["a", "b"], "left_anti")
    )
    second = staged(apart.distinct().join(first, ["a", "b"], "left_anti"), "jaccard-open")
    if not second.isEmpty():
        links = staged(links.union(linked(second, classes, documents)), "jaccard-links")
        members = staged(_members(links), "jaccard-members")
    owned = classes.select("sid", "rep").join(members, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    smallest = owned.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = owned.where(F.col("component") != F.col("sid")).join(smallest, "component").select("sid", "component_id", "component")
    alone = owned.where(F.col("component") == F.col("sid")).join(smallest, "component").select("sid", "component_id", "component")
    ids = staged(named.union(alone), "jaccard-groups")
    # What follows is read from tables written above; nothing of it runs in Python.
    told = sets.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return told.join(ids, "sid", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "component",
    )


def keep_one_per_group(documents: DataFrame) -> DataFrame:
    """One row of every group of ``documents``, with all its columns; rows without words are linked with nothing and stay.

    It has the smallest id of the group (any id goes before none). Of several texts with that id the one with the
    smallest hash stays, and of rows that repeat id and text one, whatever their number.
    """
    own = lambda: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    id_name, hash_name = free_name(documents, "row_id"), free_name(documents, "row_hash")
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    groups = jaccard_groups(documents).select(own().alias(id_name), F.col("text_hash").alias(hash_name), "component", first.alias("first"))
    counted = staged(groups.groupBy(id_name, hash_name, "component", "first").agg(F.count("*").alias("rows")), "jaccard-counted")
    firsts = counted.where(F.col("first") & F.col("component").isNotNull())
    chosen = firsts.groupBy("component").agg(F.min(hash_name).alias("chosen"))
    others = firsts.join(chosen, "component").where(F.col(hash_name) != F.col("chosen"))
    key = [id_name, hash_name]
    dropped = staged(counted.where(~F.col("first")).select(*key).union(others.select(*key)).distinct(), "jaccard-dropped")
    repeated = staged(firsts.where("rows > 1").select(*key).join(dropped, key, "left_anti"), "jaccard-repeated")
    keyed = documents.withColumns({id_name: own(), hash_name: F.xxhash64("text")})
    kept = keyed.join(dropped.union(repeated), key, "left_anti").select(*documents.columns)
    if repeated.isEmpty():
        return kept
    row = F.struct(*[F.col(c) for c in documents.columns])
    once = keyed.join(repeated, key, "left_semi").groupBy(*key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row"))
    return kept.unionByName(once.select("row.*"))


def _members(links: DataFrame) -> DataFrame:
    return components(links).withColumnRenamed("node", "sid")


def _different(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs whose sides do not lie in one component yet."""
    of = lambda side: members.select(F.col("sid").alias(side), F.col("component").alias(f"c{side}"))
    placed = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return placed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


JACCARD_SQL = r"""
with recursive words as materialized (select row_number() over () as row_id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') as w
    from documents),
shingled as materialized (select row_id, doc_id, case when len(w) = 0 then []
        when len(w) < 5 then [hash(array_to_string(w, ' '))]
        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))) end as s
    from words),
sizes as materialized (select row_id, doc_id, len(s) as n from shingled),
held as materialized (select row_id, unnest(s) as x from shingled),
common as (select a.row_id as a, b.row_id as b, count(*) as k from held a join held b on a.x = b.x group by 1, 2),
links as materialized (select c.a, c.b from common c join sizes p on p.row_id = c.a join sizes q on q.row_id = c.b
    where 100 * c.k >= 80 * (p.n + q.n - c.k)),
reach as (select row_id as a, row_id as b from sizes union select r.a, l.b from reach r join links l on l.a = r.b)
select s.doc_id, s.n as n_shingles, min(o.doc_id) as component_id
from sizes s join reach r on r.a = s.row_id join sizes o on o.row_id = r.b group by s.row_id, s.doc_id, s.n
"""
