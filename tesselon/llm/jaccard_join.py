"""N-gram Jaccard self-join with token-combination prefixes, and the components of its links.

A document's set holds the hashes of its distinct 5-word shingles (of the whole sequence, if it has
fewer words).  Documents link when 100 * |intersection| >= 75 * |union|.

1. *Screening.*  In hash order, the first n - o + l shingles of a set of n (o = ceil(0.75 n)) share
   at least l(0.75 n) with those of any partner, l(n) = max(1, n div 4).  The packed exchange tells
   which prefix shingles other sets have too; sets with too few are linked with nothing.
2. *Classes.*  Of the rest, equal sets are one *set*.  A second exchange gives each shingle's
   frequency class over distinct sets.  Rare shingles come first in the global order.
3. *Prefixes.*  A prefix must survive n - o losses.  Shingles that no other set has take losses and
   are not indexed.  Rare ones are indexed singly.  Frequent ones are dealt by hash into small
   groups, of which each counts one less than it holds and is indexed by its pairs; the prefix is
   extended until the count suffices, so that two linked sets share a single or a pair.  The number
   of groups depends on the size class, and a set near the end of its class is indexed in the next
   one too.  If the frequent ones run out first, the remaining need is indexed singly.
4. *Verifying.*  In each round a signature's members are compared, exactly, with one leader; what
   is known to be linked needs no further comparison.  After ``LEADER_ROUNDS``, sets that share a
   signature but no component are compared: with components of several sets in blocks of members,
   so no row is made a pair, and single sets with each other, where they are many in blocks too.
   No link is lost.  A signature that more than ``cluster.HOT`` sets have is dealt over several tasks.

Shingles are 64-bit chains over the words' BLAKE2b digests, and equal sets have equal 128-bit digests
of their shingles; texts can't be made to share them.

Cases: null, empty and wordless texts have n_shingles 0 and are their own component; a document is
a doc_id and a text, so rows that share a doc_id (or have none) but not the text are different
documents, grouped by links alone; a null doc_id counts as the least, its component is null; equal
rows get equal results; a very long text is a chunk by itself; extra columns are not read; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm import cluster, exchange
from tesselon.llm.components import components
from tesselon.llm.wordbytes import digests, gram_hashes, gram_positions, mix64, slices, split_words

SHINGLE = 5
NEED, OF = 75, 100
#: Shingles of at least 2**(FREQUENT - 1) sets are frequent.
FREQUENT = 6
#: Frequent shingles a group should hold in a prefix.
GROUP = 4
LEADER_ROUNDS = 2
#: Members of a component that are compared with an asked set in one go.
MEMBERS = 64
_NULL_ID = -(1 << 63)


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every distinct shingle, ordered by both."""
    words = split_words(texts)
    plain = words.hashes(lower=True)
    doc, at = gram_positions(words.first, n)
    counts = np.diff(words.first)
    docs, parts = [doc], [gram_hashes(plain, n, at)]
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        docs.append(short)
        parts.append(gram_hashes(plain, m, words.first[short], 100 + m))
    doc, grams = np.concatenate(docs), np.concatenate(parts)
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    return doc[new], grams[new]


def overlap_needed(n: np.ndarray) -> np.ndarray:
    """Least intersection of a set of n with any partner: ceil(0.75 n)."""
    return -(-n * NEED // OF)


def _extra(n: np.ndarray) -> np.ndarray:
    return np.maximum(n // 4, 1)


def _screen(piece: pa.RecordBatch, chunk: int, buckets: int) -> Iterator[tuple]:
    doc, grams = shingle_sets(piece.column("text"))
    rows = piece.num_rows
    size = np.bincount(doc, minlength=rows)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    keep = rank < (size - overlap_needed(size) + _extra(size))[doc]
    d, g = doc[keep], grams[keep]
    mixed = mix64(g)
    asked = exchange.Chunk(((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), mixed.astype(np.uint32), d, buckets)
    several = np.diff(np.append(asked.starts, len(asked.refs))) > 1
    header = [piece.column(k).to_numpy(zero_copy_only=False) for k in ("k1", "k2")]
    yield from asked.rows(chunk, several.astype(np.uint8), [*header, size.astype(np.int64)])


def _screened(home: exchange.Home, shared: np.ndarray, _keys: list) -> pa.RecordBatch:
    k1, k2, size = (np.frombuffer(h, np.int64) for h in home.header)
    hits = np.bincount(home.refs, shared[home.run] if len(home.refs) else None, len(size))
    alive = (size > 0) & (hits >= _extra(overlap_needed(size)))
    return pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(size), pa.array(alive)], names=["k1", "k2", "n", "alive"])


def _set_rows(docs: DataFrame) -> DataFrame:
    """k1, k2, h1, h2 (halves of the set's digest), n and the shingles as sorted 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                doc, grams = shingle_sets(piece.column("text"))
                cuts = np.searchsorted(doc, np.arange(piece.num_rows + 1))
                at = (cuts * 8).tolist()
                raw = grams.astype("<u8").tobytes()
                sets = pa.array([raw[a:b] for a, b in zip(at, at[1:], strict=False)], pa.binary())
                names = digests(sets).view("<i8")
                yield pa.RecordBatch.from_arrays([piece.column("k1"), piece.column("k2"), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(np.diff(cuts)), sets], names=["k1", "k2", "h1", "h2", "n", "grams"])

    return docs.select("k1", "k2", "text").mapInArrow(cluster.tidy(run), "k1 long, k2 long, h1 long, h2 long, n long, grams binary")


def _classes(piece: pa.RecordBatch, chunk: int, buckets: int) -> Iterator[tuple]:
    sets = piece.column("grams").to_pylist()
    size = np.array([len(s) // 8 for s in sets], np.int64)
    mixed = mix64(np.frombuffer(b"".join(sets), "<u8"))
    asked = exchange.Chunk(((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), mixed.astype(np.uint32), np.repeat(np.arange(len(sets)), size), buckets)
    count = np.diff(np.append(asked.starts, len(asked.refs))).astype("<u4")
    yield from asked.rows(chunk, count, [piece.column("id").to_numpy(zero_copy_only=False), size])


def _groups(size_class: int) -> int:
    """Groups that frequent shingles of sets of this size class (2**c to 2**(c+1) - 1) are dealt into."""
    return max(1, (1 << size_class) // (4 * GROUP))


def prefix_signatures(tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, int]:
    """Signatures of one set, and how many of its tokens other sets have."""
    n = len(tokens)
    losses = n - int(overlap_needed(np.array(n)))
    common = classes > 0
    tokens, classes = tokens[common], classes[common]
    shared = len(tokens)
    need = losses + 1 - (n - shared)
    if need <= 0 or not shared:
        return np.zeros(0, np.uint64), shared
    order = np.lexsort((tokens, classes))
    tokens, classes = tokens[order], classes[order]
    rare = tokens[classes < FREQUENT]
    own = [mix64(rare[:need])]
    need -= len(rare)
    if need > 0:
        frequent = tokens[len(rare) :]
        top = n.bit_length() - 1
        for size_class in [top, top + 1] if n * OF >= NEED << (top + 1) else [top]:
            own.append(_pairs(frequent, need, size_class))
    return np.unique(np.concatenate(own)), shared


def _pairs(frequent: np.ndarray, need: int, size_class: int) -> np.ndarray:
    """Pairs within groups of the shortest part of ``frequent`` that counts ``need``.

    If no part does, all pairs and, for a partner in the same case, all singles.
    """
    if not len(frequent):
        return np.zeros(0, np.uint64)
    salt = np.uint64(size_class + 1)
    group = mix64(frequent + np.uint64(77)) % np.uint64(_groups(size_class))
    seen = np.zeros(len(frequent), bool)
    _, first = np.unique(group, return_index=True)
    seen[first] = True
    counted = np.cumsum(~seen)
    end = int(np.searchsorted(counted, need)) + 1 if counted[-1] >= need else len(frequent)
    out = [] if counted[-1] >= need else [mix64(frequent + salt * np.uint64(0x1000003D))]
    tokens, group = frequent[:end], group[:end]
    order = np.lexsort((tokens, group))
    tokens, group = tokens[order], group[order]
    for gap in range(1, len(tokens)):
        same = group[gap:] == group[:-gap]
        if not same.any():
            break
        out.append(mix64((tokens[:-gap][same] * np.uint64(0x9E3779B97F4A7C15)) ^ mix64(tokens[gap:][same] + salt)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signatures(home: exchange.Home, classes: np.ndarray, keys: list[tuple[int, bytes]]) -> pa.RecordBatch:
    ids, size = (np.frombuffer(h, np.int64) for h in home.header)
    token = np.concatenate([np.frombuffer(k, "<u4").astype(np.uint64) | np.uint64(b << 32) for b, k in keys]) if keys else np.zeros(0, np.uint64)
    run = home.run
    order = np.argsort(home.refs, kind="stable")
    token, own = token[run[order]], classes[run[order]]
    cuts = np.concatenate([[0], np.cumsum(size)]).tolist()
    found, shared = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        signs, common = prefix_signatures(token[a:b], own[a:b])
        found.append(signs)
        shared.append(common)
    counts = [len(f) for f in found]
    columns = [np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64), *(np.repeat(np.array(c, np.int64), counts) for c in (ids, size, shared))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["sig", "id", "n", "shared"])


def links(n_a: np.ndarray, n_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return OF * both >= NEED * (n_a + n_b - both)


def _verified(pairs: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """Of the distinct pairs (leader, id, salt) those that link.  ``salt`` spreads a hot leader's members over tasks."""
    # After the members' join, each row holds one set; each leader comes once for each of its tasks.
    members = pairs.join(sets, "id").select("leader", "salt", "id", F.lit(1).alias("kind"), "grams")
    heads = pairs.select("leader", "salt").distinct().join(sets.withColumnRenamed("id", "leader"), "leader").select("leader", "salt", F.col("leader").alias("id"), F.lit(0).alias("kind"), "grams")
    met = members.union(heads).repartition(parts, "leader", "salt").sortWithinPartitions("leader", "salt", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            heads, ids, kinds = (batch.column(i).to_pylist() for i in (0, 2, 3))
            for i in range(batch.num_rows):
                grams = np.frombuffer(batch.column(4)[i].as_buffer(), "<u8")
                if kinds[i] == 0:
                    leader, mine = heads[i], grams.copy()
                    continue
                assert leader == heads[i]
                at = np.minimum(np.searchsorted(mine, grams), len(mine) - 1)
                both = int((mine[at] == grams).sum())
                if links(len(mine), len(grams), both):
                    found.append((leader, ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(cluster.tidy(run), "a long, b long")


def _fit(n: str, m: str, s: str, t: str) -> str:
    """Whether sizes n, m, of which s, t are shared with any other set, allow a link: 7 o >= 3 (n + m) for the overlap o."""
    return f"{OF} * least({n}, {m}) >= {NEED} * greatest({n}, {m}) and {OF + NEED} * least({s}, {t}) >= {NEED} * ({n} + {m})"


class _Joined:
    """Which ids links have joined so far, in one block."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, a: int) -> int:
        path = []
        while (up := self.parent.get(a, a)) != a:
            path.append(a)
            a = up
        self.parent.update(dict.fromkeys(path, a))
        return a

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(a), self.find(b)
        self.parent[a] = b
        return a != b


def _blocked(asked: DataFrame, members: DataFrame, parts: int, linked: bool) -> DataFrame:
    """Links (a, b) of asked sets with members of a block: rows (component, block, part) meet, pairs don't.

    ``asked``: component, block, part, id, grams; ``members``: the same for the members, each in one block
    and in all its parts.  Of the links of a block only those are returned that join what its others
    leave apart; members are joined beforehand if they are ``linked``, being of one component.
    """
    on = ["component", "block", "part"]
    met = members.select(*on, "id", F.lit(0).alias("kind"), "grams").union(asked.select(*on, "id", F.lit(1).alias("kind"), "grams"))
    met = met.repartition(parts, *on).sortWithinPartitions(*on, "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, ready, joined = None, [], None, _Joined()
        for batch in batches:
            found: list[tuple[int, int]] = []
            places = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            ids, kinds = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            for i in range(batch.num_rows):
                grams = np.frombuffer(batch.column(5)[i].as_buffer(), "<u8")
                if places[i] != place:
                    place, held, ready, joined = places[i], [], None, _Joined()
                if kinds[i] == 0:
                    held.append((ids[i], grams.copy()))
                    if linked:
                        joined.join(held[0][0], ids[i])
                    continue
                if not held:  # a block that no member fell into
                    continue
                if ready is None:
                    tokens = np.concatenate([g for _, g in held])
                    order = np.argsort(tokens, kind="stable")
                    owner = np.repeat(np.arange(len(held)), [len(g) for _, g in held])[order]
                    ready = tokens[order], owner, np.array([len(g) for _, g in held])
                tokens, owner, sizes = ready
                low, high = np.searchsorted(tokens, grams), np.searchsorted(tokens, grams, "right")
                n = high - low
                at = np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)
                both = np.bincount(owner[at], minlength=len(held))
                found += [(held[m][0], ids[i]) for m in np.flatnonzero(links(sizes, len(grams), both)).tolist() if joined.join(held[m][0], ids[i])]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], names=["a", "b"])

    return met.mapInArrow(cluster.tidy(run), "a long, b long")


def _dealt(index: DataFrame) -> DataFrame:
    """The rows of signatures that several sets have, with ``ways`` and ``salt``: how many tasks share the signature, and this row's."""
    size = cluster.stored(index.groupBy("sig").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared")
    met = cluster.spread_join(index, size, "sig", "m", "id").withColumn("ways", cluster.ways(F.col("m")))
    return cluster.stored(met.withColumn("salt", F.pmod(F.xxhash64("id"), "ways").cast("int")).drop("m"), "index")


def _copied(groups: DataFrame) -> DataFrame:
    """A row of a signature for each of the tasks that share it."""
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")


def _asked(minor: DataFrame, state: DataFrame) -> DataFrame:
    """(id, c, csize): each minor member with the larger components, of several sets, that share a signature with it.

    Signatures share lists of such components (at most ``MEMBERS`` in one), and a member meets each list
    once, in however many signatures, so the rows are not those of members by components of every signature.
    """
    held = cluster.stored(minor.select("id", "size", "component", F.explode("lists").alias("list")).distinct(), "held")
    lists = state.select(F.explode(F.arrays_zip(F.col("lists").alias("list"), F.col("large").alias("large"))).alias("l")).select("l.*").dropDuplicates(["list"])
    lists = cluster.stored(lists.join(held.groupBy("list").agg(F.count(F.lit(1)).alias("rows")), "list"), "lists")
    met = cluster.spread_join(held, lists, "list", "rows", "id")
    larger = F.filter("large", lambda c: c > F.struct("size", "component"))
    every = met.groupBy("id", "size", "component").agg(F.array_distinct(F.flatten(F.collect_list(larger))).alias("larger"))
    return every.select("id", F.explode("larger").alias("l")).select("id", F.col("l.component").alias("c"), F.col("l.size").alias("csize"))


def _rest(member: DataFrame, sets: DataFrame, labels: DataFrame, parts: int) -> DataFrame:
    """Links between different components that share a signature.

    In each signature the largest component is set apart; each other member is compared with
    every member of the components of several sets (in blocks) that are larger than its own, and
    single sets are compared with each other: in pairs, which are made distinct before a set is read,
    or in blocks of members where a signature has more than ``MEMBERS`` single sets.
    """
    on = ["sig", "salt"]
    counted = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    held = member.groupBy("component").agg(F.count(F.lit(1)).alias("rows"))
    sizes = cluster.stored(held.join(counted, "component", "left").withColumn("size", F.coalesce("size", F.lit(1))), "sizes")
    member = cluster.stored(cluster.spread_join(member, sizes, "component", "rows", "id").drop("rows"), "sized")
    rank = F.struct("size", "component")
    state = member.groupBy("sig").agg(F.max(rank).alias("top"), F.max("ways").alias("ways"), F.array_sort(F.collect_set(F.when(F.col("size") > 1, rank))).alias("large"))
    state = state.withColumn("large", F.when(F.size("large") > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size("large") / MEMBERS).cast("int") - 1), lambda i: F.slice("large", i * MEMBERS + 1, MEMBERS))).otherwise(F.array()))
    state = cluster.stored(state.withColumn("lists", F.transform("large", lambda a: F.concat_ws("_", F.xxhash64(a), F.xxhash64(a, F.lit(7))))), "lists")
    minor = cluster.stored(member.join(_copied(state.drop("large")), on).filter(rank < F.col("top")).drop("top"), "minor")
    asked = cluster.stored(_asked(minor, state), "asked")
    blocks = lambda size: F.ceil(size / MEMBERS).cast("int")
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(3)), cluster.ways(n)).cast("int").alias("part")
    every = lambda n: F.explode(F.sequence(F.lit(0), cluster.ways(n) - 1)).alias("part")
    sought = cluster.stored(asked.groupBy(F.col("c").alias("component")).agg(F.count(F.lit(1)).alias("n"), F.max("csize").alias("csize")), "sought")
    spread = cluster.spread_join(asked.select("id", F.col("c").alias("component")), sought, "component", "n", "id")
    spread = spread.select("id", "component", part(F.col("n")), F.explode(F.sequence(F.lit(0), blocks(F.col("csize")) - 1)).alias("block"))
    members = cluster.spread_join(labels, sought, "component", "csize", "id").select("component", F.pmod(F.xxhash64("id"), blocks(F.col("csize"))).cast("int").alias("block"), "id", every(F.col("n")))
    found = cluster.stored(cluster.merged(_blocked(spread.join(sets, "id"), members.join(sets, "id"), parts, linked=True), parts), "links")

    alone = member.filter("size = 1").select("sig", "ways", "salt", "id", "n", "shared")
    groups = alone.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.max("ways").alias("ways"), F.sum(F.xxhash64("id") % (1 << 40)).alias("a"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 40)).alias("b"), F.min("id").alias("lo"), F.max("id").alias("hi")).filter("m > 1")
    groups = cluster.stored(groups, "single")
    few = _copied(groups.filter(F.col("m") <= MEMBERS).select("sig", "ways"))
    left = alone.join(few, on).drop("salt", "ways")
    right = left.select("sig", F.col("id").alias("leader"), F.col("n").alias("ln"), F.col("shared").alias("ls"))
    pairs = left.join(right, "sig").filter(F.expr("id > leader and " + _fit("n", "ln", "shared", "ls"))).select("leader", "id", F.lit(0).alias("salt")).distinct()
    found = found.union(cluster.stored(cluster.merged(_verified(cluster.stored(pairs, "pairs"), sets, parts), parts), "links"))

    # Of signatures with the same single sets one suffices.
    many = groups.filter(F.col("m") > MEMBERS).groupBy("m", "a", "b", "lo", "hi").agg(F.min(F.struct("sig", "ways")).alias("one")).select("one.*", "m")
    own = cluster.stored(alone.drop("ways").join(_copied(many), on).select(F.col("sig").alias("component"), F.pmod(F.xxhash64("id", F.lit(2)), blocks(F.col("m"))).cast("int").alias("block"), "id", "m"), "blocks")
    later = own.select("component", F.explode(F.sequence(F.col("block"), blocks(F.col("m")) - 1)).alias("block"), "id", part(F.col("m")))
    if own.limit(1).count():
        met = _blocked(later.join(sets, "id"), own.select("component", "block", "id", every(F.col("m"))).join(sets, "id"), parts, linked=False)
        found = found.union(cluster.stored(cluster.merged(met, parts), "links"))
    return found


def _linked(index: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """(id, component) of every set that links with another."""
    spark = index.sparkSession
    index = _dealt(index)
    labels = spark.createDataFrame([], "id long, component long")
    edges = spark.createDataFrame([], "a long, b long")
    for turn in range(LEADER_ROUNDS + 1):
        member = index.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        order = F.xxhash64(F.lit(turn), "id") if turn else F.col("id")
        state = member.groupBy("sig").agg(
            F.min(F.struct(order.alias("o"), "id", "n", "shared", "component")).alias("head"),
            F.min("component").alias("lo"),
            F.max("component").alias("hi"),
            F.max("ways").alias("ways"),
        )
        state = cluster.stored(state.filter("lo <> hi").drop("lo", "hi"), "groups")
        if not state.limit(1).count():
            break
        if turn == LEADER_ROUNDS:
            open_ = cluster.stored(member.join(_copied(state.select("sig", "ways")), ["sig", "salt"]), "open")
            new = _rest(open_, sets, labels, parts)
        else:
            pairs = member.drop("ways").join(_copied(state.select("sig", "ways", "head")), ["sig", "salt"])
            pairs = pairs.select("id", "n", "shared", "component", "salt", F.col("head.id").alias("leader"), F.col("head.n").alias("ln"), F.col("head.shared").alias("ls"), F.col("head.component").alias("lc"))
            pairs = pairs.filter("component <> lc and " + _fit("n", "ln", "shared", "ls")).groupBy("leader", "id").agg(F.max("salt").alias("salt"))
            new = cluster.stored(cluster.merged(_verified(cluster.stored(pairs, "pairs"), sets, parts), parts), "links")
        edges = edges.union(new)
        labels = components(edges)
    return labels


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with their columns, that are the least document of their component; of equal documents with words one row stays."""
    found = cluster.stored(_documents(docs), "classes")
    least = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    a, b = cluster.fresh(docs, "_k1", "_k2")
    gone = cluster.stored(found.filter(~least).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "copies")
    left = cluster.sized_join(exchange.named(docs, a, b), gone, [a, b], "left_anti", 40)
    # Rows that repeat a document: of those with words one stays.
    some = found.filter((F.col("n") > 0) & least)
    again = cluster.stored(some.groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg(F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "repeated")
    if again.limit(1).count():
        repeated = cluster.sized_join(left, again, [a, b], "left_semi", 40)
        left = cluster.sized_join(left, again, [a, b], "left_anti", 40).unionByName(repeated.dropDuplicates([a, b]))
    return left.drop(a, b)


def document_components(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, n_shingles and component_id of every row."""
    public = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c))
    return _documents(docs).select("k1", "k2", public("k1").alias("doc_id"), F.col("n").alias("n_shingles"), public("c1").alias("component_id"))


def _documents(docs: DataFrame) -> DataFrame:
    """k1, k2, n and the keys c1, c2 of the least document of its component, of every row."""
    spark = docs.sparkSession
    keyed = exchange.with_keys(docs)
    parts = exchange.partitions(spark, cluster.text_bytes(docs))
    asked = exchange.answer(exchange.ask(keyed, _screen, parts), parts, exchange.reply_shared)
    every = cluster.stored(cluster.merged(exchange.collect_home(asked, parts, _screened, "u1", "k1 long, k2 long, n long, alive boolean"), parts), "screened")
    alive = cluster.stored(every.filter("alive").select("k1", "k2").distinct(), "alive")
    rows = cluster.stored(_set_rows(cluster.sized_join(keyed, alive, ["k1", "k2"], "inner", 40)).dropDuplicates(["k1", "k2"]), "sets")
    # Equal sets are one, numbered as they are stored; a document's keys don't fit one number.
    same = rows.groupBy("h1", "h2").agg(F.min(F.struct("k1", "k2")).alias("first"))
    same = cluster.stored(same.select("h1", "h2", "first.k1", "first.k2", F.monotonically_increasing_id().alias("id")), "equal")
    sets = cluster.sized_join(rows.select("k1", "k2", "grams"), same.select("k1", "k2", "id"), ["k1", "k2"], "inner", 48).select("id", "grams")
    asked = exchange.answer(exchange.ask(sets, _classes, parts, "grams"), parts, exchange.reply_classes)
    index = cluster.stored(exchange.collect_home(asked, parts, _signatures, "u1", "sig long, id long, n long, shared long"), "signatures")
    labels = _linked(index, sets, parts)

    part = cluster.stored(same.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    least = part.groupBy("component").agg(F.min(F.struct("k1", "k2")).alias("least"))
    part = part.join(least, "component").select("h1", "h2", F.col("least.k1").alias("c1"), F.col("least.k2").alias("c2"))
    owner = cluster.stored(rows.select("k1", "k2", "h1", "h2").join(part, ["h1", "h2"]).select("k1", "k2", "c1", "c2"), "components")
    out = cluster.sized_join(every, owner, ["k1", "k2"], "left", 48)
    return out.select("k1", "k2", "n", F.coalesce("c1", "k1").alias("c1"), F.coalesce("c2", "k2").alias("c2"))
