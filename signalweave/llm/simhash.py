"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at most 4
bits share at least ``8 - 4 = 4`` of them. The index therefore posts a fingerprint
under every choice of 4 positions with their bytes: two fingerprints meet in
C(m, 4) postings when m positional bytes agree, so they meet exactly when their
tally m reaches the guaranteed minimum. Postings are short (32-bit keys), a pair is
tallied only where it can qualify, and then verified bit by bit.

A posting does not emit its pairs. Its task links verified members in a union-find
and emits a spanning forest, so links stay linear in the postings. Long postings are
indexed again by their remaining bits (nibbles, then pairs of bits) before members
are compared. Copies are collapsed to one fingerprint before the index is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions, release, worker_cache

MOST_BITS = 4
#: Members of a posting that are compared directly; longer ones are indexed again.
BLOCK = 2048
#: Least Jaccard similarity of the shingle sets of near copies that the pipeline's stage drops.
SIMILAR = 0.8
#: Bands of MinHash values, and values of a band: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, BAND = 24, 4
#: Nodes that are compared with each other in one go; larger groups are cut into blocks.
GROUP = 2048


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of the word shingles of ``text``, repeats included."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > hashes.size).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- links
class Forest:
    """Union-find over fingerprints; keeps the links that joined two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        ra, rb = self.root(a), self.root(b)
        if ra != rb:
            self.parent[max(ra, rb)] = min(ra, rb)
            self.links.append((a, b))


def _compare(fps: np.ndarray, forest: Forest, most: int) -> None:
    """Link near members by a search that leaves out those already reached."""
    if fps.size == 2:
        a, b = fps.tolist()
        if (a ^ b).bit_count() <= most:
            forest.link(a, b)
        return
    rest = fps
    while rest.size > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and rest.size:
            x = waiting.pop()
            near = np.bitwise_count(rest ^ x) <= most
            if near.any():
                found, rest = rest[near], rest[~near]
                waiting.extend(found)
                for y in found.tolist():
                    forest.link(int(x), y)


def link_posting(fps: np.ndarray, forest: Forest, most: int = MOST_BITS, width: int = 8) -> None:
    """Link all members (distinct uint64) of a posting that differ in ``most`` bits or fewer.

    Beyond ``BLOCK`` members an index over units of half the width narrows the search:
    of the 64 / width units at most ``most`` differ.
    """
    if fps.size <= BLOCK or width == 1:
        return _compare(fps, forest, most)
    half = width // 2
    mask = np.uint64((1 << half) - 1)
    units = [(fps >> np.uint64(half * i)) & mask for i in range(64 // half)]
    varying = [i for i, u in enumerate(units) if (u != u[0]).any()]
    if len(varying) <= most:
        return _compare(fps, forest, most)
    for chosen in combinations(varying, len(varying) - most):
        key = np.zeros(fps.size, np.uint64)
        for i in chosen:
            key = (key << np.uint64(half)) | units[i]
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for part in np.split(order, cuts):
            if part.size > 1:
                link_posting(fps[part], forest, most, half) if part.size < fps.size else _compare(fps[part], forest, most)
    return None


def links(distinct: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``fp``, enough to connect all near ones.

    Each task returns a spanning forest over the postings it holds.
    """
    if not 1 <= most < 8:
        raise ValueError("8 positional bytes guarantee a shared one for 1 to 7 differing bits")
    chosen = list(combinations(range(8), 8 - most))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            octets = [(fps >> np.uint64(8 * i)) & np.uint64(255) for i in range(8)]
            for number, places in enumerate(chosen):
                key = np.zeros(fps.size, np.uint64)
                for i in places:
                    key = (key << np.uint64(8)) | octets[i]
                key = (key << np.uint64(8)) | np.uint64(number)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, last, parts = Forest(), None, []

        def close() -> None:
            held = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            if held.size > 1:
                link_posting(held, forest, most)
            parts.clear()

        for batch in batches:
            key, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not key.size:
                continue
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [key.size]))
            sizes = np.diff(bounds)
            if key[0] != last:
                close()
            parts.append(fps[: sizes[0]])
            if sizes.size > 1:  # a posting that goes on in the next batch stays in parts
                close()
                inner = np.flatnonzero(sizes[1:-1] > 1) + 1
                for at, n in zip(bounds[inner].tolist(), sizes[inner].tolist(), strict=True):
                    link_posting(fps[at : at + n], forest, most)
                parts.append(fps[bounds[-2] :])
            last = key[-1]
        close()
        found = np.array(forest.links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    postings = distinct.select("fp").mapInArrow(post, "key long, fp long")
    dealt = postings.repartition(partitions(distinct), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(gather, "a long, b long")


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of all nodes of ``edges`` (a, b).

    Alternates large-star and small-star contractions until the links are stars: no node
    has two links down, or links both up and down. Each round is written to the shared folder; only
    whether there is such a node reaches the driver. A giant component's centre is a hot key of the join
    with the least neighbours; that side has one row for each node, so adaptive execution can split the other.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "links")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", F.col("m").alias("u")).filter("u <> v").distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        linked = large.join(small, "v").select(F.greatest("u", "m").alias("v"), F.col("m").alias("u"))
        after = materialize(linked.union(small.select("v", F.col("m").alias("u"))).filter("u <> v").distinct(), "links")
        release(now)
        now = after
        ends = now.select(F.col("v").alias("node"), F.lit(1).alias("down")).union(now.select("u", F.lit(0)))
        if ends.groupBy("node").agg(F.sum("down").alias("downs"), F.min("down").alias("least")).filter("downs > 1 OR (downs > 0 AND least = 0)").isEmpty():
            break
    roots = now.select(F.col("u").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)


def near_duplicates(docs: DataFrame, shingle: int = 4, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id.

    component_id is the smallest doc_id reachable over links of ``most_bits`` or fewer
    differing bits. Null and wordless texts have fingerprint zero and link like any
    other. A null doc_id is never a component's smallest unless alone in it. Repeated
    rows are repeated in the result; other columns are not looked at.
    """
    return _near(materialize(fingerprints(docs, shingle), "fingerprints"), most_bits)


def _near(prints: DataFrame, most_bits: int) -> DataFrame:
    """:func:`near_duplicates` of rows with their fingerprints (doc_id, fp)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    stars = components(links(distinct, most_bits))
    named = distinct.join(stars, distinct["fp"] == stars["node"]).select("fp", "first_id", "component")
    lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    grouped = materialize(named.join(lowest, "component").select("fp", "component_id"), "grouped")
    every = distinct.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    # a fingerprint of many copies is a hot key: its few rows are sent to all tasks
    rows = prints.count()
    heavy = prints.groupBy("fp").count().filter(F.col("count") * 1000 > rows).select("fp")
    heavy = materialize(every.join(F.broadcast(heavy), "fp").withColumn("hot", F.lit(True)), "heavy")  # under 1000 rows
    marked = prints.join(F.broadcast(heavy), "fp", "left")
    light = marked.filter(F.col("hot").isNull()).select("doc_id", "fp").join(every, "fp")
    out = light.unionByName(marked.filter("hot").select("doc_id", "fp", "component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- similar shingle sets
def _signature(text: str | None, shingle: int, factors: np.ndarray) -> tuple[int, np.ndarray, bytes] | None:
    """Hash of the set of word shingles, one key for each band of its MinHash values, and the set (32-bit hashes, sorted)."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return None
    k = min(shingle, len(words))
    parts = {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}
    hashes = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts)))
    least = np.full(factors.size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, hashes.size, 4096):
        least = np.minimum(least, (factors[:, None] * hashes[at : at + 4096]).min(axis=1))
    bands = [xxhash.xxh64_intdigest(least[b * BAND : (b + 1) * BAND].tobytes(), b) for b in range(BANDS)]
    return xxhash.xxh64_intdigest(hashes.tobytes()), np.array(bands, np.uint64).view(np.int64), np.unique(hashes.astype(np.uint32)).tobytes()


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, fp, node, bands, shingles of every row; the last three are null where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")  # the stages before may have left much in this worker
        factors = np.random.default_rng(7).integers(0, 1 << 63, BANDS * BAND, np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(1).to_pylist()
                made = [_signature(x, shingle, factors) or (None, None, None) for x in texts]
                fps = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
                nodes = [None if m[0] is None else m[0] - (1 << 64 if m[0] >> 63 else 0) for m in made]
                arrays = [part.column(0), pa.array(fps), pa.array(nodes, pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "node", "bands", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long, node long, bands array<long>, shingles binary")


def _groups(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[list[tuple]]:
    """Rows with the same first ``by`` values, which are next to each other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[:by] != held[0][:by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _link_similar(nodes: list[int], sets: list[np.ndarray], forest: Forest) -> None:
    """Link members whose sets have ``SIMILAR`` in common, by a search that leaves out those already reached."""
    sizes = np.array([s.size for s in sets])
    flat, owner, rest = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), np.arange(len(sets))
    while rest.size > 1:
        waiting, rest = [rest[0]], rest[1:]
        held = np.isin(owner, rest)
        flat, owner = flat[held], owner[held]
        while waiting and rest.size:
            x = waiting.pop()
            common = np.bincount(owner[np.isin(flat, sets[x])], minlength=len(sets))[rest]
            near = common >= SIMILAR * (sizes[x] + sizes[rest] - common)
            if near.any():
                found, rest = rest[near], rest[~near]
                held = np.isin(owner, rest)
                flat, owner = flat[held], owner[held]
                waiting.extend(found)
                for y in found.tolist():
                    forest.link(nodes[x], nodes[y])


def _stars(units: DataFrame) -> DataFrame:
    """key, node, root: members of each unit (key, block) that are linked directly or by others, under one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            forest, nodes = Forest(), [r[2] for r in rows]
            _link_similar(nodes, [np.frombuffer(r[3], np.uint32) for r in rows], forest)
            columns = [pa.array(c, pa.int64()) for c in ([r[0] for r in rows], nodes, [forest.root(x) for x in nodes])]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "root"])

    dealt = units.select("key", "block", "node", "shingles").repartition(partitions(units), "key", "block").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(run, "key long, node long, root long")


def _blocks(members: DataFrame, node: str, seed: int) -> DataFrame:
    """Add ``block``: the members of a key are dealt into blocks of about half ``GROUP`` by a hash."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") * 2 / F.lit(GROUP)).alias("n"))
    return members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64(node, F.lit(seed)), "n")).drop("n")


def _large_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) among the members (key, node) of groups too large for one task.

    Blocks of a group are linked apart. Of each cluster found one member goes on, with those of other blocks, into new blocks, as
    long as that joins clusters; near copies of one text, however many, so end in one cluster. Last, every member outside its
    group's largest cluster is held against all members of other clusters, block by block. No link between clusters is lost.
    """
    mine = materialize(_blocks(members, "node", 0).join(sets, "node"), "members")
    stars = materialize(_stars(mine), "stars")
    found = [stars.select(F.col("node").alias("a"), F.col("root").alias("b"))]
    label = stars
    for level in range(1, 20):
        roots = label.select("key", "root").distinct()
        before = roots.count()
        units = _blocks(roots, "root", level).withColumnRenamed("root", "node").join(sets, "node")
        joined = materialize(_stars(units), "stars").withColumnRenamed("node", "was").withColumnRenamed("root", "now")
        found.append(joined.select(F.col("was").alias("a"), F.col("now").alias("b")))
        after = joined.select("key", "now").distinct().count()
        label = materialize(label.join(joined, (label["key"] == joined["key"]) & (label["root"] == joined["was"])).select(label["key"], "node", F.col("now").alias("root")), "label")
        if after > 0.9 * before:
            break
    sizes = label.groupBy("key", "root").count()
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    rest = label.join(main, "key").filter("root <> main").select("key", "node", "root")
    all_of = mine.select("key", "block", "node", "shingles").join(label, ["key", "node"])
    chunks = _blocks(rest, "node", 99).withColumnRenamed("block", "chunk").join(sets, "node")
    # each chunk of the others meets each block of its group
    pairs = all_of.select("key", "block").distinct().join(chunks.select("key", "chunk").distinct(), "key")
    left = pairs.join(all_of, ["key", "block"]).select("key", "block", "chunk", F.lit(0).alias("side"), "node", "root", "shingles")
    right = pairs.join(chunks, ["key", "chunk"]).select("key", "block", "chunk", F.lit(1), "node", "root", "shingles")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            ours = [r for r in rows if r[3] == 0]
            sides = [np.frombuffer(r[6], np.uint32) for r in ours]
            sizes, roots = np.array([x.size for x in sides]), np.array([r[5] for r in ours])
            flat, owner = np.concatenate(sides) if sides else np.zeros(0, np.uint32), np.repeat(np.arange(len(ours)), sizes)
            forest = Forest()  # over the clusters, so that each is linked once
            for r in rows:
                if r[3] == 1 and ours:
                    other = np.frombuffer(r[6], np.uint32)
                    common = np.bincount(owner[np.isin(flat, other)], minlength=len(ours))
                    for root in np.unique(roots[common >= SIMILAR * (sizes + other.size - common)]).tolist():
                        forest.link(r[5], root)
            found = np.array(forest.links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    dealt = left.union(right).repartition(partitions(members), "key", "block", "chunk").sortWithinPartitions("key", "block", "chunk")
    out = dealt.mapInArrow(across, "a long, b long")
    for part in found:
        out = out.union(part)
    return _thinned(out.filter("a <> b"))


def _thinned(links: DataFrame) -> DataFrame:
    """The links of each task that join two trees: a member of many groups has a link from each, but needs few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                forest.link(a, b)
        found = np.array(forest.links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return links.repartition(partitions(links), "a").mapInArrow(run, "a long, b long")


def similar_links(signatures: DataFrame) -> DataFrame:
    """Links (a, b) among nodes, enough to connect all that share a band and have a Jaccard similarity of ``SIMILAR`` or more.

    Groups of up to ``GROUP`` nodes are compared in a task; larger ones pass through in a stream and are linked block by block.
    """
    import xxhash

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, mark = None, [], 0, 0

        def rows(large: bool, name: int, nodes: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([large] * nodes.size), pa.array(np.full(nodes.size, name, np.int64)), pa.array(nodes)], names=["large", "key", "node"])

        def signed(value: int) -> int:
            return (value & (1 << 64) - 1) - (1 << 64 if value >> 63 & 1 else 0)

        def close() -> Iterator[pa.RecordBatch]:
            if 1 < size <= GROUP:  # bands of the same members make one group
                members = np.sort(np.concatenate(held))
                yield rows(False, signed(xxhash.xxh64_intdigest(members.tobytes())), members)
            elif size > GROUP:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.bool_()), pa.array([key]), pa.array([signed(mark * 31 + size)])], names=["large", "key", "node"])

        for batch in batches:
            keys, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bounds = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [keys.size])) if keys.size else [0]
            for at, end in zip(bounds[:-1], bounds[1:], strict=True):
                if keys[at] != key:
                    yield from close()
                    key, held, size, mark = int(keys[at]), [], 0, 0
                part = nodes[at:end]
                size += part.size
                with np.errstate(over="ignore"):  # a sum of mixed nodes, whatever their order
                    mixed = part.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    mark = (mark + int(((mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).sum())) & (1 << 64) - 1
                if size > GROUP:
                    for x in (*held, part):
                        yield rows(True, key, x)
                    held = []
                else:
                    held.append(part)
        yield from close()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for group in _groups(batches):
            _link_similar([r[1] for r in group], [np.frombuffer(r[2], np.uint32) for r in group], forest)
        found = np.array(forest.links, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    n = partitions(signatures)
    one = signatures.groupBy("node").agg(F.first("bands").alias("bands"))
    postings = one.select(F.explode("bands").alias("key"), "node").repartition(n, "key").sortWithinPartitions("key")
    groups = materialize(postings.mapInArrow(candidates, "large boolean, key long, node long").distinct(), "groups")
    small, large = groups.filter("NOT large").select("key", "node"), groups.filter("large").select("key", "node")
    sets = signatures.join(groups.filter("large IS NOT NULL").select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    dealt = small.join(sets, "node").select("key", "node", "shingles").repartition(n, "key").sortWithinPartitions("key")
    links = dealt.mapInArrow(verify, "a long, b long")
    if large.isEmpty():
        return links
    # of large groups with the same members one stays
    marks = groups.filter("large IS NULL").groupBy(F.col("node").alias("mark")).agg(F.min("key").alias("key")).select("key")
    return links.union(_large_links(large.join(marks, "key", "left_semi"), materialize(sets, "sets")))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` that have the smallest doc_id of their component, with all their columns.

    Components are linked by fingerprints, as in :func:`near_duplicates`, and by sets of shingles with a
    Jaccard similarity of ``SIMILAR`` or more. MinHash bands find the candidates for these, as
    fingerprints of such pairs differ in more bits than positional bytes can guarantee.
    Rows that repeat one doc_id are one document and share its fate; rows with a null doc_id are all kept, as no
    id tells them apart. Null texts and texts without words are copies of each other. Whole texts of any length are read, and an
    empty table gives an empty result.
    """
    made = materialize(_signatures(docs, shingle), "signatures")
    found = materialize(_near(made.select("doc_id", "fp"), most_bits), "near")
    signatures = made.filter("node IS NOT NULL")
    named = found.select(F.col("fingerprint"), F.col("component_id").alias("c")).distinct()
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    places = materialize(signatures.select("node", hexed).distinct().join(named, "fingerprint").select("node", "c").distinct(), "places")
    pairs = similar_links(signatures)
    across = pairs.join(places.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(places.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
    same = places.join(places.groupBy("node").agg(F.min("c").alias("ca")), "node").select("ca", F.col("c").alias("cb"))
    edges = across.select("ca", "cb").union(same).filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    merged = components(edges)
    release(made)
    last = found.join(merged, found["component_id"] == merged["node"], "left").select("doc_id", F.coalesce("component", "component_id").alias("component_id"))
    gone = last.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
