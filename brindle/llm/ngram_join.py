r"""N-gram Jaccard join by T-occurrence search.

A document is its set of distinct word 5-grams, hashed to 64 bits. Two sets with a Jaccard similarity of at least t share at
least ceil(t * n) members of either, so a search asks which sets occur at least T times in the inverted lists of a set's
members. DivideSkip answers it: the longest lists are set aside, the short ones are merged with a heap, and what occurs
often enough there is probed for in the long ones by binary search (``divide_skip``). All links come from it.

What is searched where is found in steps, none of which can lose a link:

1. Equal sets are one class.
2. In one global order (the hash), linked sets share members among their first floor(n/4) + n/8 ones (``least_shared``). Sets
   whose first members are hardly shared with any other class are done. This exchange moves 10 bytes a member, by member.
3. Of the rest, classes that share a minimum of one of four hashes are searched against the most typical class of that group
   (the largest share of shared members: an original rather than its altered copies), in blocks. These links contract large
   groups of near copies into components early.
4. Only members that another component also has can still matter. Sets with fewer than T of them are done. The last ones are
   joined on their rarest members (n - T + 1, members that no other component has included), between components only, and
   each is searched against its candidates, in blocks.
5. A rarest member that more than COMMON of the last sets have is not joined on. The sets that such members connect are a
   family: altered copies of one text that mostly do not link with each other, or documents made of one passage. A family is
   cut by size into levels, so that links are within a level or to the next, and levels into blocks; each set is searched
   against each block, as a stated query set is. What comes out are links that join components, fewer than there are sets
   in the two blocks.

Hot members - of a passage that many documents share - are rare in no document that is not mostly made of them, groups of
near copies are one component by step 3, and families give no candidates, so no step makes all pairs of a group. Joins on a
key that may be hot have two sides that are both exchanged for the join (``apart``), so that adaptive execution splits it.

Words and shingles are named by 64 bits. Classes are told apart by 128-bit digests of their whole sets; those that reach step 3
are numbered, and no number stands for two.

Defined results: a null or empty text has no shingles and links with nothing, and is its own component; fewer words than five
are one shingle; repeated rows and equal texts are linked (if they have a shingle); rows with a null doc_id link like others
but never name a component, unless all of a component are null; an empty table gives an empty result; extra columns are not
looked at by ``join`` and kept by ``keep``.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, apart, documents, durable, packed, session, unpacked
from .components import components
from .flat import ODD, buffer, slices
from .flat import shingles as flat_shingles

N, PERCENT = 5, 75
#: Members that a task of step 2 or 4 gets, about.
PART_MEMBERS = 1_000_000
#: Parts of an exchange, at least: each class has a row in each part where it shares members, so few parts would grow with the input.
LEAST_PARTS = 48
BLOCK, BLOCK_MEMBERS = 256, 1_000_000
COMMON = 32
#: A probe of a long list against a step of the merge, for each doubling of the list.
PROBE_COST = 0.01
#: Members that a task of the first exchange gathers before it deals them out, and digests of classes that it remembers.
FLUSH_MEMBERS, SEEN = 1_000_000, 1 << 16


def sets_of(column: pa.Array, n: int = N) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingles."""
    for a, b in slices(column):
        found, first = flat_shingles(*buffer(column.slice(a, b - a)), n)
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            yield found[i:j]


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """Members that a set of n shares with any set that it links with, at least."""
    return -(-n * percent // 100)


def enough(a: int, b: int, shared: int, percent: int = PERCENT) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def pair_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Least shared members for sizes a and b to be linked."""
    return -(-percent * (a + b) // (100 + percent))


def long_lists(t: int, longest: int) -> int:
    """How many of the longest lists are set aside: more where the threshold is high, fewer where a probe of a long list costs
    much; below t, so that the merge has something to ask for."""
    return min(t - 1, int(t / (PROBE_COST * math.log2(longest + 1) + 1)))


def merge_skip(lists: list[list[int]], t: int) -> Iterator[tuple[int, int]]:
    """(set, count) of the sets that occur in at least t of the sorted lists. Where the least one does not, the t - 1 lists with
    the least heads jump to the next head, found in each by binary search: nothing before it can reach t."""
    heap = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= t:
        at, popped = heap[0][0], []
        while heap and heap[0][0] == at:
            popped.append(heapq.heappop(heap))
        count = len(popped)
        if count >= t:
            yield at, count
            following = at + 1
        else:
            while heap and len(popped) < t - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                return
            following = heap[0][0]
        for _, i, p in popped:
            p = bisect_left(lists[i], following, p)
            if p < len(lists[i]):
                heapq.heappush(heap, (lists[i][p], i, p))


def divide_skip(lists: list[list[int]], sizes: list[int], n: int, percent: int = PERCENT) -> list[int]:
    """Sets (numbers below len(sizes)) that link with a set of n members, of whose members ``lists`` are the inverted lists,
    sorted. A set reaches pair_overlap; its least value over the sets is T. The longest lists are set aside, the others are
    merged for sets that occur T times less the number of long ones, and those are looked for in the long lists."""
    fitting = [s for s in sizes if least_overlap(max(n, s), percent) <= min(n, s)]
    if not fitting or not lists:
        return []
    t = min(pair_overlap(n, s, percent) for s in fitting)
    if t > len(lists):
        return []
    lists = sorted(lists, key=len)
    n_long = long_lists(t, len(lists[-1]))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    out = []
    for at, count in merge_skip(short, t - n_long):
        need = pair_overlap(n, sizes[at], percent)
        for k, x in enumerate(long):
            if count >= need or count + len(long) - k < need:
                break
            p = bisect_left(x, at)
            count += p < len(x) and x[p] == at
        if count >= need and enough(n, sizes[at], need, percent):
            out.append(at)
    return out


def search(query: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """The sets that link with the query, by divide_skip over the inverted lists of its members."""
    where, which = [], []
    for k, s in enumerate(sets):
        at = np.searchsorted(query, s)
        at[at == len(query)] = 0
        hit = at[query[at] == s] if len(query) else at[:0]
        where.append(hit)
        which.append(np.full(len(hit), k))
    at = np.concatenate(where) if where else np.zeros(0, np.int64)
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    members, docs = at[order], np.concatenate(which)[order]
    cuts = np.flatnonzero(np.diff(members)) + 1
    lists = [x.tolist() for x in np.split(docs, cuts)]
    return divide_skip(lists, [len(s) for s in sets], len(query), percent)


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def ref(d: bytes) -> int:
    return int.from_bytes(d[:8], "big", signed=True)


def prefix_size(n):
    """First members of a set of n that step 2 looks at; also of an array of sizes."""
    return np.minimum(n, n - least_overlap(n) + np.maximum(1, n // 8))


def least_shared(n: int) -> int:
    """Members among the first prefix_size(n) that a linked set has among its own first ones, at least. Of the two prefixes
    take the one that ends first, of a set of m: what both sets have beyond it is at most m less its size, and they share
    least_overlap(m), so max(1, m // 8) are in both. The partner may be as small as three quarters of n."""
    return max(1, least_overlap(n) // 8)


def _meta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(len(s), digest(s) if len(s) else None) for s in sets_of(b.column("text"))]
        plain = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in plain], pa.array([n for n, _ in found], pa.int64()), pa.array([d for _, d in found], pa.binary())], names=[*plain, "n", "digest"])


def _blobs(flat: np.ndarray, lens: np.ndarray, tags: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Members by part: their names, the number of the set in the blob's table, and that table of tags (64-bit numbers)."""
    if not len(flat):
        return
    owner = np.repeat(np.arange(len(lens), dtype=np.uint32), lens)
    part = ((flat >> np.uint64(8)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    for idx in np.split(order, cuts):
        used, local = np.unique(owner[idx], return_inverse=True)
        head = np.array([len(idx), len(used)], np.uint32)
        yield int(part[idx[0]]), head.tobytes() + flat[idx].tobytes() + local.astype(np.uint16 if len(used) <= 65536 else np.uint32).tobytes() + tags[used].tobytes()


def _read(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, used = (int(x) for x in np.frombuffer(blob, np.uint32, 2))
    at = 8 + 8 * n
    kind = np.uint16 if used <= 65536 else np.uint32
    local = np.frombuffer(blob, kind, n, at)
    table = np.frombuffer(blob, np.int64, used * width, at + local.nbytes).reshape(used, width)
    return np.frombuffer(blob, np.uint64, n, 8), table[local]


def _part_batch(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["part", "blob"])


def _prefixes(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        members = 0

        def flush():
            out = list(_blobs(*[np.concatenate(x) for x in zip(*held)], parts)) if held else []
            held.clear()
            if out:
                yield _part_batch(out)

        for batch in batches:
            column = batch.column("text")
            for a, b in slices(column):
                found, first = flat_shingles(*buffer(column.slice(a, b - a)), N)
                size = np.diff(first)
                names = [found[i:j].tobytes() for i, j in zip(first[:-1].tolist(), first[1:].tolist())]
                names = [hashlib.blake2b(x, digest_size=16).digest() for x in names]
                some = np.zeros(len(size), bool)
                for i, d in enumerate(names):  # copies in one task go once
                    if size[i] and d not in seen:
                        some[i] = True
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(d)
                take = np.where(some, prefix_size(size), 0)
                within = np.arange(len(found)) - np.repeat(first[:-1], size)
                held.append((found[within < np.repeat(take, size)], take[some], np.array([ref(names[i]) for i in np.flatnonzero(some)], np.int64).reshape(-1, 1)))
                members += int(take.sum())
                if members >= FLUSH_MEMBERS:
                    yield from flush()
                    members = 0
        yield from flush()

    return run


def _shared(group: pa.Table) -> pa.Table:
    """How many of its members in this part each class shares with another class."""
    names, tags = zip(*[_read(b.as_py(), 1) for b in group.column("blob")])
    names, refs = np.concatenate(names), np.concatenate(tags)[:, 0]
    order = np.lexsort((refs, names))
    names, refs = names[order], refs[order]
    new = np.ones(len(names), bool)
    new[1:] = (names[1:] != names[:-1]) | (refs[1:] != refs[:-1])
    names, refs = names[new], refs[new]
    near = np.zeros(len(names), bool)
    near[1:] = names[1:] == names[:-1]
    near[:-1] |= near[1:].copy()
    found, counts = np.unique(refs[near], return_counts=True)
    return pa.table({"ref": pa.array(found), "c": pa.array(counts.astype(np.int64))})


def _crossing(group: pa.Table) -> pa.Table:
    """As _shared, for members that another component has as well; tags are (class, component)."""
    names, tags = zip(*[_read(b.as_py(), 2) for b in group.column("blob")])
    names, tags = np.concatenate(names), np.concatenate(tags)
    order = np.argsort(names, kind="stable")
    names, refs, comps = names[order], tags[order, 0], tags[order, 1]
    begin = np.concatenate([[0], np.flatnonzero(np.diff(names)) + 1])
    low, high = np.minimum.reduceat(comps, begin), np.maximum.reduceat(comps, begin)
    many = np.repeat(low != high, np.diff(np.append(begin, len(names))))
    found, counts = np.unique(refs[many], return_counts=True)
    return pa.table({"ref": pa.array(found), "c": pa.array(counts.astype(np.int64))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows whose text has the expected digest: the set, and its minima under four hashes."""
    for b in batches:
        rows = []
        for s, d, share in zip(sets_of(b.column("text")), b.column("digest").to_pylist(), b.column("share").to_pylist()):
            if len(s) and digest(s) == d:
                rows.append((d, len(s), s.tobytes(), [int((s * np.uint64(o) ^ (s >> np.uint64(31))).min().astype(np.int64)) for o in ODD[:4]], share))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.list_(pa.int64())), pa.array([r[4] for r in rows], pa.float64())], names=["digest", "n", "set", "minima", "share"])


def _component_blobs(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in b.column("set")]
            if sets:
                tags = np.stack([b.column("ref").to_numpy(zero_copy_only=False), b.column("component").to_numpy(zero_copy_only=False)], 1)
                yield _part_batch(list(_blobs(np.concatenate(sets), np.array([len(s) for s in sets]), tags, parts)))

    return run


def _search_block(group: pa.Table) -> pa.Table:
    """One query (``asks``) against a block of sets."""
    asks = group.column("asks").to_pylist()
    refs, sets = group.column("ref").to_pylist(), [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
    q = asks.index(True) if True in asks else None
    if q is None:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    others = [i for i, a in enumerate(asks) if not a]
    found = [refs[others[k]] for k in search(sets[q], [sets[i] for i in others])]
    return pa.table({"a": pa.array([refs[q]] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the given pairs that link: each query a in blocks of BLOCK of its candidates b."""
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    plain = sets.select("ref", "set")
    asked = sizes.join(plain, sizes["a"] == plain["ref"]).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("asks"), "ref", "set")
    others = pairs.join(sizes, "a").join(plain, F.col("b") == F.col("ref")).select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("asks"), "ref", "set")
    return asked.union(others).groupBy("a", "block").applyInArrow(_search_block, "a bigint, b bigint")


def _block_links(group: pa.Table) -> pa.Table:
    """Links between two blocks of a family, or within one, that join components which no link before has joined here."""
    a, b = group.column("block").to_pylist()[0], group.column("other").to_pylist()[0]
    refs, sets = group.column("ref").to_pylist(), [np.frombuffer(s, np.uint64) for s in group.column("set").to_pylist()]
    comps = np.unique(group.column("component").to_numpy(), return_inverse=True)[1]
    asks = np.array(group.column("asks").to_pylist())
    queries = np.flatnonzero(asks)
    targets = queries if a == b else np.flatnonzero(~asks)
    out: list[tuple[int, int]] = []
    if len(queries) and len(targets):
        sizes = [len(sets[t]) for t in targets]
        flat, owner = np.concatenate([sets[t] for t in targets]), np.repeat(np.arange(len(targets)), sizes)
        order = np.lexsort((owner, flat))
        members, begin = np.unique(flat[order], return_index=True)
        lists = np.split(owner[order], begin[1:])
        for k, q in enumerate(queries):
            allowed = comps[targets] != comps[q]
            if a == b:
                allowed[k:] = False
            if not allowed.any():
                continue
            at = np.searchsorted(members, sets[q])
            at[at == len(members)] = 0
            mine = [x for x in (lists[i][allowed[lists[i]]].tolist() for i in at[members[at] == sets[q]]) if x]
            for t in divide_skip(mine, sizes, len(sets[q])):
                t = targets[t]
                if comps[t] != comps[q]:
                    out.append((refs[q], refs[t]))
                    comps[comps == comps[t]] = comps[q]
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _family_links(sets: DataFrame) -> DataFrame:
    """(a, b) that join components, of sets (ref, n, component, set) that have a family."""
    # links are between sizes of at least PERCENT of each other: of one level, or of neighbouring ones
    leveled = sets.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / PERCENT) * (1 + 1e-9))))
    levels = durable(leveled.groupBy("family", "level").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_MEMBERS)).cast("int").alias("blocks")))
    dealt = leveled.join(levels, ["family", "level"]).withColumn("block", F.struct("level", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int").alias("i"))).drop("level", "blocks")
    up = levels.select("family", (F.col("level") - 1).alias("level"), F.col("blocks").alias("more"))
    low, high = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("more") - 1)
    within = levels.select("family", F.explode(low).alias("i"), "level", "blocks").select("family", F.struct("level", "i").alias("block"), F.explode(F.sequence(F.col("i"), F.col("blocks") - 1)).alias("j"), "level").select("family", "block", F.struct("level", F.col("j").alias("i")).alias("other"))
    between = levels.join(up, ["family", "level"]).select("family", "level", F.explode(low).alias("i"), high.alias("js")).select("family", F.struct("level", "i").alias("block"), "level", F.explode("js").alias("j")).select("family", "block", F.struct((F.col("level") + 1).alias("level"), F.col("j").alias("i")).alias("other"))
    both = within.union(between)
    asked = both.join(dealt, ["family", "block"]).select("family", "block", "other", F.lit(True).alias("asks"), "ref", "component", "set")
    rest = both.where("block <> other").join(dealt.withColumnRenamed("block", "other"), ["family", "other"]).select("family", "block", "other", F.lit(False).alias("asks"), "ref", "component", "set")
    return asked.union(rest).groupBy("family", "block", "other").applyInArrow(_block_links, "a bigint, b bigint")


def _explode_sets(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, n, c, s in zip(b.column("ref").to_pylist(), b.column("n").to_pylist(), b.column("component").to_pylist(), b.column("set").to_pylist()):
                m = np.frombuffer(s, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(np.full(len(m), r)), pa.array(np.full(len(m), n)), pa.array(np.full(len(m), c))], names=["member", "ref", "n", "component"])

    return sets.select("ref", "n", "component", "set").mapInArrow(run, "member bigint, ref bigint, n bigint, component bigint")


def class_components(docs: DataFrame, marks: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, marks, n, digest) of every document, digest null without shingles; and (digest, component) of the classes that
    link, component being the digest of one of them. marks: columns of whole numbers."""
    session(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # a row's id and text as one number: rows share it that are copies under one id, and no others that matter
    d = docs.select("text", F.xxhash64("doc_id", "text").alias("row_key"))
    meta = durable(docs.select("doc_id", "text", *marks, F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(_meta, ", ".join([f"doc_id {kind}", *(f"{m} bigint" for m in marks), "row_key bigint, n bigint, digest binary"])))
    total = meta.agg(F.sum("n")).first()[0] or 0
    parts = max(LEAST_PARTS, total * 3 // 8 // PART_MEMBERS)
    classes = meta.where("n > 0").groupBy("digest").agg(F.first("n").alias("n"), F.min("row_key").alias("one")).withColumn("ref", _ref(F.col("digest")))
    # step 2; two digests that begin alike only add up their counts here, and more is looked at
    shared = d.select("text").mapInArrow(_prefixes(parts), "part int, blob binary").groupBy("part").applyInArrow(_shared, "ref bigint, c bigint").groupBy("ref").agg(F.sum("c").alias("c"))
    need = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / 8))
    left = durable(classes.join(shared, "ref").where(F.col("c") >= need).select("digest", apart(F.col("one")).alias("one"), (F.col("c") / F.least("n", F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + F.greatest(F.lit(1), F.floor(F.col("n") / 8)))).alias("share")))
    # each class's text is that of one of its rows, never those of all rows that share its id
    whole = d.join(left, apart(F.col("row_key")) == F.col("one")).select("text", "digest", "share").mapInArrow(_sets, "digest binary, n bigint, set binary, minima array<bigint>, share double")
    # rows that share an id and a text are one class; its number is its place
    sets = durable(whole.dropDuplicates(["digest"]).withColumn("ref", F.monotonically_increasing_id()))
    # step 3
    mins = sets.select("ref", "share", F.posexplode("minima").alias("i", "m"))
    pivots = mins.groupBy("i", "m").agg(F.max(F.struct("share", "ref"))["ref"].alias("a"), (F.min("ref") < F.max("ref")).alias("many")).where("many").select(F.col("i").alias("pi"), apart(F.col("m")).alias("pm"), "a")
    pairs = durable(mins.join(pivots, (F.col("i") == F.col("pi")) & (apart(F.col("m")) == F.col("pm"))).where("ref <> a").select("a", F.col("ref").alias("b")).distinct())
    links = durable(_links(pairs, sets))
    first = components(links)
    marked = sets.drop("minima", "share", "digest").join(first.withColumnRenamed("id", "ref"), "ref", "left").withColumn("component", F.coalesce("component", "ref"))
    # step 4
    parts = max(LEAST_PARTS // 2, (sets.agg(F.sum("n")).first()[0] or 0) // PART_MEMBERS)
    crossing = marked.mapInArrow(_component_blobs(parts), "part int, blob binary").groupBy("part").applyInArrow(_crossing, "ref bigint, c bigint").groupBy("ref").agg(F.sum("c").alias("c"))
    open_sets = durable(marked.join(crossing, "ref").where(F.col("c") >= F.ceil(F.col("n") * PERCENT / 100)).select("ref", "n", "component", "set"))
    members = _explode_sets(open_sets)
    lists = members.groupBy("member").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select(apart(F.col("member")).alias("list"), "df")
    ranked = members.join(lists, apart(F.col("member")) == F.col("list")).withColumn("r", F.row_number().over(Window.partitionBy("ref").orderBy("df", "member"))).withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("ref")))
    # n - T + 1 rarest members; those in no other component are rarer than all of these
    rare = durable(ranked.where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1 - (F.col("n") - F.col("all"))).select("member", "ref", "n", "component"))
    # step 5
    common = rare.groupBy("member").agg(F.count(F.lit(1)).alias("df"), F.min("ref").alias("first")).where(F.col("df") > COMMON).select(apart(F.col("member")).alias("list"), "first")
    marked = durable(rare.join(common, apart(F.col("member")) == F.col("list"), "left").drop("list"))
    family = components(marked.where("first IS NOT NULL").select(F.col("ref").alias("a"), F.col("first").alias("b")).distinct())
    inside = _family_links(open_sets.join(family.withColumnRenamed("id", "ref").withColumnRenamed("component", "family"), "ref"))
    rare = marked.where("first IS NULL").drop("first")
    other = rare.select("member", F.col("ref").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    fits = (F.greatest("n", "nb") * PERCENT <= F.least("n", "nb") * 100) & (F.col("ref") < F.col("b")) & (F.col("component") != F.col("cb"))
    candidates = durable(rare.join(other, "member").where(fits).select(F.col("ref").alias("a"), "b").distinct())
    last = _links(candidates, open_sets)
    linked = components(links.union(last).union(inside))
    of = sets.select("ref", "digest")
    linked = linked.join(of, linked["id"] == of["ref"]).select("component", "digest")
    return meta, linked.join(of.withColumnRenamed("digest", "of"), linked["component"] == of["ref"]).select("digest", F.col("of").alias("component"))


def _ref(digest: Column) -> Column:
    """As ref(): the first eight bytes as a whole number."""
    return F.conv(F.hex(F.substring(digest, 1, 8)), 16, -10).cast("long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    meta, linked = class_components(docs)
    # one row a class before any join, so that no class is hot in it
    classes = meta.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least"))
    named = classes.join(linked, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    found = named.join(least, "component").select(F.col("digest").alias("class"), "component_id")
    out = meta.join(found, meta["digest"] == found["class"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _first_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows with the same two marks, the first: copies in all columns, so that a hot row leaves a task once."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        at = []
        for i, key in enumerate(zip(b.column("one").to_pylist(), b.column("two").to_pylist())):
            if key not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                at.append(i)
        yield b.take(pa.array(at, pa.int64()))


def keep(docs: DataFrame) -> DataFrame:
    """Of each group of linked rows one, the least by doc_id (nulls last), then by hashes of the whole row; of rows that are
    equal in every column, one. Rows without shingles link with nothing and all stay. Columns keep their names, whatever
    these are."""
    session(docs)
    # both hashes are of all columns: they name a row up to its copies, whatever its id
    whole = packed(docs, "doc_id", "text")
    columns = [F.to_json(F.col(f"row.`{c}`")) if "map<" in kind else F.col(f"row.`{c}`") for c, kind in docs.dtypes]
    named = whole.withColumns({"one": F.xxhash64(F.lit(1), *columns), "two": F.xxhash64(F.lit(2), *columns)})
    meta, linked = class_components(named, ("one", "two"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "one", "two")
    # one row a class before the join, so that no class is hot in it
    classes = meta.where("n > 0").groupBy("digest").agg(F.min(order).alias("least"))
    found = classes.join(linked, "digest", "left").groupBy(F.coalesce("component", "digest").alias("component")).agg(F.min("least").alias("least")).select("least.one", "least.two")
    worded = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    once = named.where(worded).mapInArrow(_first_of_equal, named.schema)
    kept = once.join(found, ["one", "two"], "left_semi").dropDuplicates(["one", "two"])
    return unpacked(kept.select("row").union(named.where(~worded).select("row")))


def op3_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


QUERIES = {"op3_ngram_join": op3_ngram_join}
#: All pairs that share a shingle, for tables small enough.
ORACLE = r"""
WITH RECURSIVE a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4])) END AS s FROM a),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT x.doc_id AS a, y.doc_id AS b FROM u x JOIN u y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON id = doc_id
"""
ORACLE_SQL = {"op3_ngram_join": ORACLE}
