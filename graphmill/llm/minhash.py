"""Near-duplicate documents by SuperMinHash, banding, verification on full shingle sets and union-find.

Plan, all of it keyed by row keys and hashes (texts are never shuffled unless the candidates are too
many to broadcast their keys):

1. Each text becomes a set of word shingles; a digest of the set puts exact copies into one class, so a
   group of a million copies is one row from here on.
2. A SuperMinHash signature of each class is cut into bands; classes that share a band are candidates.
3. Per band bucket the member that collides most often overall leads, every other member is compared with
   it on the full sets, and confirmed links are joined up by union-find.
4. Buckets that still hold several components are compared in blocks, all members outside the bucket's largest
   component with all others: no pair is emitted unless it is a link, and pairs inside a component are skipped.

A row is known by its id and two digests of its text: rows that repeat a doc_id, or have none, are documents of
their own where their texts differ.  Rows with null text or without words are linked with nothing and kept.
A component's id is its least doc_id; rows without an id do not count for it and are kept only where the
whole component has none.  Empty tables give empty ones; other columns are ignored.  A very long text is one
set of 8 bytes a shingle in one row, from signature to verification; it is not split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import KEY, counted_join, exclusive, fits_broadcast, hot_keys, keyed_join, map_arrow, materialize, row_key
from graphmill.llm.components import components
from graphmill.llm.wordhash import _STEP, chunks, mix, shingle_sets, text_bytes

#: 24 bands of 4: a pair at a similarity of 0.8 shares no band once in 300,000 times.
BANDS, ROWS = 24, 4
#: Elements whose permutations are held at once.
ELEMENTS = 100_000
#: Shingles of one block in step 4.
BLOCK = 200_000
_HALF, _LOW = np.uint64(32), np.uint64(0xFFFFFFFF)


def superminhash(sets: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """Signatures (documents x m, uint64) of sets given one after the other.

    Round j gives each element the rank j plus a random fraction at the j-th place of its own random
    permutation of the m slots.  As ranks only grow, a document whose slots all hold ranks up to j stops.
    """
    docs = len(ends) - 1
    best = np.full(docs * m, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(docs), np.diff(ends))
    perm = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(sets), m)).copy()
    live = np.arange(len(sets))
    with np.errstate(over="ignore"):
        for j in range(m):
            x = mix(sets[live] + np.uint64(j + 1) * _STEP)
            k = (j + (((x & _LOW) * np.uint64(m - j)) >> _HALF)).astype(np.int64)
            slot = perm[live, k]
            perm[live, k] = perm[live, j]
            np.minimum.at(best, owner[live] * m + slot, (np.uint64(j) << _HALF) | (x >> _HALF))
            done = best.reshape(docs, m).max(axis=1) < (np.uint64(j + 1) << _HALF)
            live = live[~done[owner[live]]]
            if not len(live):
                break
    return best.reshape(docs, m)


def signature(sets: np.ndarray, ends: np.ndarray, m: int) -> np.ndarray:
    """superminhash() of sets of any size: the signature of a large set is the least of its parts' signatures."""
    if len(ends) == 2 and len(sets) > ELEMENTS:
        parts = [sets[a : a + ELEMENTS] for a in range(0, len(sets), ELEMENTS)]
        return np.minimum.reduce([superminhash(p, np.array([0, len(p)]), m) for p in parts])
    return superminhash(sets, ends, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band, the band's number mixed in."""
    with np.errstate(over="ignore"):
        key = mix(np.arange(1, bands + 1, dtype=np.uint64) * _STEP)[None, :].repeat(len(signatures), 0)
        cut = signatures.reshape(len(signatures), bands, rows)
        for r in range(rows):
            key = mix((key ^ mix(cut[:, :, r])) + _STEP)
    return key.view(np.int64)


def _groups(ends: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(ends) - 1:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        exclusive("minhash")
        for batch in batches:
            texts = text_bytes(batch.column(4))
            for a, b in chunks(texts):
                sets, ends = shingle_sets(texts[a:b], k)
                sizes = np.diff(ends)
                digest, keys = np.zeros((b - a, 2), np.int64), np.zeros((b - a, bands), np.int64)
                for lo, hi in _groups(ends, ELEMENTS):
                    if ends[hi] == ends[lo]:
                        continue
                    own = sets[ends[lo] : ends[hi]]
                    full = np.flatnonzero(sizes[lo:hi])  # sums over consecutive starts need non-empty sets
                    at = (ends[lo:hi] - ends[lo])[full]
                    with np.errstate(over="ignore"):
                        digest[lo + full, 0] = np.add.reduceat(mix(own), at).view(np.int64)
                        digest[lo + full, 1] = np.add.reduceat(mix(own ^ _STEP), at).view(np.int64)
                        keys[lo:hi] = band_keys(signature(own, ends[lo : hi + 1] - ends[lo], bands * rows), bands, rows)
                flat = pa.array(keys.ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in range(4)),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(digest[:, 0]),
                        pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat),
                    ],
                    ["doc_id", *KEY, "n_shingles", "d0", "d1", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches):
        exclusive("minhash")
        for batch in batches:
            ids, texts = batch.column(0), text_bytes(batch.column(1))
            for a, b in chunks(texts):
                sets, ends = shingle_sets(texts[a:b], k)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), lists], ["id", "shingles"])

    return run


def _block_links(percent: int):
    """Links of the queries of one block to the targets of another, enough of them to join up what belongs together."""

    def side(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, components, sizes and all shingles one after the other."""
        lists = rows["shingles"].combine_chunks()
        lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
        return rows["id"].to_numpy(), rows["component"].to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()

    def run(group: pa.Table) -> pa.Table:
        target = np.asarray(group["target"].to_numpy(zero_copy_only=False), bool)
        us, vs = [], []
        if target.any() and not target.all():
            ids, comps, sizes, flat = side(group.filter(pa.array(target)))
            own_ids, own_comps, own_sizes, own = side(group.filter(pa.array(~target)))
            elements, inverse = np.unique(flat, return_inverse=True)
            by = np.argsort(inverse, kind="stable")
            posting, start = np.repeat(np.arange(len(ids)), sizes)[by], np.searchsorted(inverse[by], np.arange(len(elements) + 1))
            at = np.minimum(np.searchsorted(elements, own), len(elements) - 1)
            known, ends = elements[at] == own, np.cumsum(own_sizes)
            root = {c: c for c in [*comps.tolist(), *own_comps.tolist()]}

            def find(c: int) -> int:
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            for i, end in enumerate(ends):
                mine = at[end - own_sizes[i] : end][known[end - own_sizes[i] : end]]
                if not len(mine):
                    continue
                common = np.bincount(np.concatenate([posting[start[e] : start[e + 1]] for e in mine]), minlength=len(ids))
                linked = np.flatnonzero((100 * common >= percent * (own_sizes[i] + sizes - common)) & (comps != own_comps[i]))
                for j in linked:
                    a, b = find(int(own_comps[i])), find(int(comps[j]))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        us.append(int(own_ids[i]))
                        vs.append(int(ids[j]))
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _one_each(texts: DataFrame, wanted: DataFrame, members: DataFrame) -> DataFrame:
    """(id, text): a text for each wanted class (KEY, id), of its representative row, which may occur several times."""
    found = texts.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, KEY).select("id", "text")
    twice = materialize(members.filter("leads").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "twice")
    if not twice.limit(1).count():
        return found
    side = F.broadcast(twice) if fits_broadcast(twice) else twice
    return found.join(side, "id", "left_anti").unionByName(found.join(side, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text")))


def grouped(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, rank, t0, t1, n_shingles, grp, component_id) for each row of docs: grp tells components apart, null for a row without words."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(), F.col("text").cast("string").alias("text"))
    sketch = materialize(
        map_arrow(texts, _sketch(k, bands, rows), "doc_id long, rank long, t0 long, t1 long, n_shingles long, d0 long, d1 long, bands array<long>"), "sketch"
    )
    usable = sketch.filter("n_shingles > 0")
    # Numbers of classes are written once; nothing computes them again.
    classes = usable.groupBy("d0", "d1").agg(F.min(F.struct(*KEY)).alias("first"), F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    leads = F.struct(*KEY) == F.col("first")
    members = counted_join(usable, classes.select("d0", "d1", "id", "first", "copies"), ["d0", "d1"], "copies")
    members = materialize(members.select("doc_id", *KEY, "n_shingles", "id", leads.alias("leads"), F.when(leads, F.col("bands")).alias("bands")), "members")
    banded = members.filter("leads").select("id", F.explode("bands").alias("key"))
    crowded = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    buckets = materialize(counted_join(banded, crowded, ["key"], "size").distinct(), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    ranked = materialize(buckets.join(degree, "id").join(classes.select("id", "n"), "id"), "ranked")
    lead = ranked.groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"), "n")).alias("top"), F.count(F.lit(1)).alias("members"))
    pairs = materialize(
        counted_join(ranked, lead, ["key"], "members")
        .select("id", (-F.col("top.minus")).alias("leader"), "n", F.col("top.n").alias("leader_n"))
        .filter(f"id <> leader and 100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)")
        .select("id", "leader")
        .distinct(),
        "pairs",
    )
    wanted = materialize(classes.join(buckets.select("id").distinct(), "id", "left_semi").select("first.*", "id"), "wanted")
    shingled = materialize(map_arrow(_one_each(texts, wanted, members), _sets(k), "id long, shingles array<long>"), "sets")
    led = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("led"))
    of_leader = led.drop("led").join(shingled.select(F.col("id").alias("leader"), F.col("shingles").alias("leader_shingles")), "leader")
    common = F.size(F.array_intersect("shingles", "leader_shingles"))
    links = materialize(
        keyed_join(pairs.join(shingled, "id"), of_leader, ["leader"], hot_keys(led, ["leader"], "led"))
        .filter(100 * common >= percent * (F.size("shingles") + F.size("leader_shingles") - common))
        .select(F.col("id").alias("u"), F.col("leader").alias("v")),
        "links",
    )
    found = components(links)
    # Three members at least: two have been compared with each other already.
    placed = materialize(ranked.filter("size > 2").select("key", "id", "n").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    shares = placed.groupBy("key", "component").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("members"))
    mixed = shares.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("members").alias("members"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max(F.struct("n", "component"))["component"].alias("largest")
    ).filter("parts > 1")
    pick = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), n)
    places = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    met = counted_join(placed.drop("n"), mixed, ["key"], "members").withColumn("here", F.ceil(F.col("n") / BLOCK)).withColumn("there", F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK), F.lit(1).cast("long")))
    asked = met.filter("component <> largest").select("key", "id", "component", F.lit(False).alias("target"), pick(F.col("there"), 1).alias("q"), F.explode(places(F.col("here"))).alias("t"))
    told = met.select("key", "id", "component", F.lit(True).alias("target"), F.explode(places(F.col("there"))).alias("q"), pick(F.col("here"), 2).alias("t"))
    dealt = materialize(asked.unionByName(told), "dealt")
    more = materialize(dealt.join(shingled, "id").groupBy("key", "q", "t").applyInArrow(_block_links(percent), "u long, v long"), "rest")
    if more.limit(1).count():
        found = components(links.union(more))
    of_class = classes.select("id", "least", "copies").join(found, "id", "left").withColumn("grp", F.coalesce("component", "id"))
    least = of_class.groupBy("grp").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = materialize(counted_join(of_class.select("id", "grp", "copies"), least, ["grp"], "classes").select("id", "grp", "component_id", "copies"), "named")
    out = counted_join(members.drop("bands", "leads"), named, ["id"], "copies").select("doc_id", *KEY, "n_shingles", "grp", "component_id")
    alone = sketch.filter("n_shingles = 0").select("doc_id", *KEY, "n_shingles", F.lit(None).cast("long").alias("grp"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text); kept: the row's id is its component's."""
    kept = F.when(F.col("grp").isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return grouped(docs, k, percent, bands, rows).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of docs for each component, with all its columns: the first by id, rows without an id last, then by a digest of the text.

    Rows without words are all kept.  Rows equal in id and text are one document of which one is kept.
    """
    found = materialize(grouped(docs, k, percent, bands, rows).filter("grp is not null").select("grp", *KEY), "groups")
    keys = found.groupBy("grp", *KEY).agg(F.count(F.lit(1)).alias("times"))
    first = found.groupBy("grp").agg(F.min(F.struct(*KEY)).alias("first"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    judged = materialize(counted_join(keys, first, ["grp"], "members").select(*KEY, (F.struct(*KEY) == F.col("first")).alias("is_first"), "times"), "judged")
    marked = docs.withColumns(dict(zip([f"__{c}" for c in KEY], row_key(), strict=True)))
    on = [f"__{c}" for c in KEY]
    side = lambda cond: judged.filter(cond).select(*[F.col(c).alias(f"__{c}") for c in KEY])
    out, gone, twice = marked, side("not is_first or times > 1"), side("is_first and times > 1")
    out = out.join(F.broadcast(gone) if fits_broadcast(gone) else gone, on, "left_anti")
    if twice.limit(1).count():
        again = marked.join(F.broadcast(twice) if fits_broadcast(twice) else twice, on, "left_semi")
        out = out.unionByName(again.dropDuplicates(on))
    return out.drop(*on)
