"""Jaccard join of documents on word shingles with adaptive multi-match prefixes.

All shingles stand in one order, frequent ones last. A set that reaches the threshold with another shares at
least ``m`` shingles with it among its first ``n - need + m``, for any ``m`` up to ``need``: a longer prefix
asks for more shared shingles. Each document takes the ``m`` whose estimated cost (lists read and candidates
left) is least; two documents are compared under the smaller of their two.

Equal sets are one node from the start. Where many nodes share a shingle, they are first compared with the
most typical of them, and what links becomes one component. Shingles that very many nodes share are then
settled in blocks: a task counts the shared shingles of two blocks of nodes at once and gives only a forest
of their links; nodes already in the largest component of a shingle are not compared with each other. After that nodes of different components that met in no block are paired, around the largest
component of each shingle, so that a large group of near copies is never turned into all its pairs. Every
link between different components is still found and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import BASES, as_bytes, slices, stored, window_hashes, word_hashes
from pagequarry.llm.links import components

SHINGLE = 4
PERCENT = 85
#: Most shared shingles a prefix may ask for.
MATCHES = 6
#: Cost of verifying one candidate, in list entries read.
VERIFY = 20
#: Nodes sharing a prefix shingle from which it is settled in blocks, of so many nodes; blocks a node goes to
#: are those of its first few such shingles.
DENSE = 64
BLOCK = 128
HOMES = 3
#: Shingles counted at a time, letters of text for each slice that their counts are added up in (at least so many
#: slices), and shingles known as frequent everywhere (16 bytes each), from so many texts on.
COUNTED = 1 << 20
SLICE_LETTERS = 1 << 20
SLICES = 1 << 10
FREQUENT = 1 << 16
OFTEN = 8


#: Shingles of a block counted in one product.
COLUMNS = 2048


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """The set of a text as sorted hashes: A-Z in lower case, runs of ``size`` words, or all if fewer."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(words)[:, 0], min(size, len(words)), BASES[0]))


def count_batches(batches: Iterator[pa.RecordBatch], size: int, bits: int) -> Iterator[pa.RecordBatch]:
    """``slice, shingles, counts``: all shingles of this task, sorted and cut by their high ``bits``, counted in parts."""
    waiting: list[np.ndarray] = []
    held = 0

    def settle() -> pa.RecordBatch:
        nonlocal waiting, held
        keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
        counts = counts.astype("<i4")
        place = (keys >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        edges = [*starts.tolist(), len(keys)]
        rows = [(i, keys[a:b].tobytes(), counts[a:b].tobytes()) for i, a, b in zip(place[starts].tolist(), edges, edges[1:])]
        waiting, held = [], 0
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], ["slice", "shingles", "counts"])

    for batch in slices(batches):
        for text in as_bytes(batch.column(0)):
            waiting.append(shingles(text, size))
            held += len(waiting[-1])
            if held >= COUNTED:
                yield settle()
    if held:
        yield settle()


def add_counts(part: pa.Table) -> pa.Table:
    """``shingle, n`` of one slice: the shingles of ``OFTEN`` texts or more, ``FREQUENT`` at most."""
    keys = np.frombuffer(b"".join(part.column("shingles").to_pylist()), "<u8")
    counts = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<i4")
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    keep = counts >= OFTEN
    keys, counts = keys[keep], counts[keep]
    top = np.lexsort((keys.view(np.int64), -counts))[:FREQUENT]
    return pa.table([pa.array(keys[top].view(np.int64)), pa.array(counts[top])], ["shingle", "n"])


def frequent_shingles(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of all texts and their counts: at most ``FREQUENT``, by hash.

    The counts are exact, whatever the partitions of ``texts``: each task hands on all its shingles, and those
    of a slice are added up in one place. There are as many slices as the letters of all texts ask for, so that a
    slice, which is held in memory, is no larger over more texts.
    """
    letters = texts.agg(F.sum(F.length("text").cast("long")).alias("n")).first().n or 0
    bits = max(SLICES, -(-letters // SLICE_LETTERS)).bit_length() - 1
    parts = texts.mapInArrow(lambda b: count_batches(b, size, bits), "slice long, shingles binary, counts binary")
    counted = stored(parts.groupBy("slice").applyInArrow(add_counts, "shingle long, n long"), "counts")
    found = counted.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    keys, counts = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order]


def prefix_batches(batches: Iterator[pa.RecordBatch], shared, size: int, percent: int, matches: int) -> Iterator[pa.RecordBatch]:
    """``id, mark, n, h1, h2, prefix`` of every text."""
    keys, counts = shared.value
    for batch in slices(batches):
        numbers, first, second, prefixes = [], [], [], []
        for text in as_bytes(batch.column(2)):
            found = shingles(text, size)
            n = len(found)
            digest = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
            numbers.append(n)
            first.append(int(digest[0]))
            second.append(int(digest[1]))
            if len(keys) and n:
                at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
                found = found[np.argsort(np.where(keys[at] == found, counts[at], 0), kind="stable")]
            prefixes.append(found[: n - -(-percent * n // 100) + matches].view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array(numbers, pa.int32()), pa.array(first, pa.int64()),
                pa.array(second, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())),
            ],
            ["doc_id", "mark", "n", "h1", "h2", "prefix"],
        )


def need(n: str, percent: int) -> str:
    """SQL: shingles that a partner must share at least."""
    return f"cast(ceil({percent} * {n} / 100) as int)"


def postings(nodes: DataFrame, percent: int, matches: int) -> DataFrame:
    """``shingle, node, n, level, least, weight`` of prefixes, for shingles that several nodes share.

    ``least`` is the number of shared shingles the node's own prefix asks for, ``weight`` how much its
    prefix is shared, which is highest for the most typical node of a group.
    """
    spread = nodes.select("node", "n", F.posexplode("prefix").alias("place", "shingle"))
    spread = spread.withColumn("level", F.expr(f"greatest(1, place + 1 - (n - {need('n', percent)}))"))
    often = spread.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    met = stored(spread.join(often, "shingle"), "postings")
    sums = [F.sum(F.when(F.col("level") <= m, F.col("df")).otherwise(0)).alias(f"read{m}") for m in range(1, matches + 1)]
    held = [F.count_if(F.col("level") <= m).alias(f"held{m}") for m in range(1, matches + 1)]
    by_node = met.groupBy("node").agg(F.first("n").alias("n"), *sums, *held)
    options = [
        # with fewer shared shingles than asked for there is no candidate at all
        f"if({m} > {need('n', percent)}, null, struct(if(held{m} < {m}, 0D, read{m} * (1 + {VERIFY} / {m})) as cost, {m} as m))"
        for m in range(1, matches + 1)
    ]
    best = by_node.select(
        "node", F.col("read1").alias("weight"), F.expr(f"array_min(filter(array({', '.join(options)}), x -> x is not null))").alias("best")
    ).where("best.cost > 0").select("node", "weight", F.col("best.m").alias("least"))
    return stored(met.join(best, "node").where("level <= least").select("shingle", "node", "n", "level", "least", "weight"), "prefixes")


def pack_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """``node, body``: the compressed text of a node, where the text is the one the node was made of."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        nodes, bodies = [], []
        for node, first, second, text in zip(*(batch.column(i).to_pylist() for i in range(3)), as_bytes(batch.column(3)), strict=True):
            digest = np.frombuffer(xxhash.xxh3_128_digest(shingles(text, size).tobytes()), "<i8")
            if (int(digest[0]), int(digest[1])) == (first, second):
                nodes.append(node)
                bodies.append(squeeze.compress(text))
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(bodies, pa.binary())], ["node", "body"])


def verify_batches(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of candidate pairs with their texts those that reach the threshold."""
    expand = zstandard.ZstdDecompressor()
    last, left = None, np.empty(0, np.uint64)
    for batch in slices(batches):
        a, b = [], []
        for x, y, one, other in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if x != last:
                last, left = x, shingles(expand.decompress(one), size)
            right = shingles(expand.decompress(other), size)
            both = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * both >= percent * (len(left) + len(right) - both):
                a.append(x)
                b.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def verified(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The links among candidate pairs ``x, y``."""
    left = bodies.select(F.col("node").alias("x"), F.col("body").alias("one"))
    right = bodies.select(F.col("node").alias("y"), F.col("body").alias("other"))
    full = pairs.join(right, "y").join(left, "x").select("x", "y", "one", "other")
    return stored(full.mapInArrow(lambda b: verify_batches(b, size, percent), "a long, b long"), "links")


def rooted(posts: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Postings with the component of their node."""
    if roots is None:
        return posts.withColumn("root", F.col("node"))
    return posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def close_enough(n: Column, m: Column, percent: int) -> Column:
    """Set sizes that can reach the threshold."""
    return (F.lit(100) * F.least(n, m)) >= (F.lit(percent) * F.greatest(n, m))


def typical_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """For each node one candidate: the most typical node of its shingles, of another component.

    At most one pair a node, however many nodes share a shingle.
    """
    rank = F.struct("weight", F.col("node").alias("c"), F.col("root").alias("c_root"), F.col("n").alias("c_n"))
    centres = posts.groupBy("shingle").agg(F.max(rank).alias("c"), F.min("root").alias("r")).where("c.c_root != r or r is null")
    near = posts.join(centres.select("shingle", "c.*"), "shingle").where(F.col("root") != F.col("c_root"))
    near = near.where(close_enough(F.col("n"), F.col("c_n"), percent))
    votes = near.groupBy("node", "c").agg(F.count("*").alias("votes"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "c")).alias("best"))
    return best.select(F.col("node").alias("y"), F.col("best.c").alias("x"))


def homes_of(posts: DataFrame) -> DataFrame:
    """``node, homes``: the first shared shingles of a node's prefix that very many nodes share."""
    first = posts.where("level = 1")
    dense = first.groupBy("shingle").agg(F.count("*").alias("k")).where(F.col("k") > DENSE)
    own = first.join(dense, "shingle").select("node", F.struct("k", "shingle").alias("h"))
    return own.groupBy("node").agg(
        F.transform(F.slice(F.sort_array(F.collect_list("h"), asc=False), 1, HOMES), lambda h: h["shingle"]).alias("homes")
    )


def tiles(homes: DataFrame, roots: DataFrame) -> DataFrame:
    """``shingle, kind, i, j, node, own``: the blocks of nodes of a dense shingle that are to be compared.

    Nodes of its largest component need not be compared with each other. Those outside it (kind 0) meet block by
    block, and their blocks meet those of the largest component (kind 1): one node beside a large family of near
    copies takes each of its bodies along once.
    """
    at_home = rooted(homes.select("node", F.explode("homes").alias("shingle")), roots)
    sizes = at_home.groupBy("shingle", "root").agg(F.count("*").alias("k"))
    groups = sizes.groupBy("shingle").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all"), F.count("*").alias("roots"))
    groups = groups.where("roots > 1").select(
        "shingle",
        F.col("m.root").alias("main"),
        F.ceil((F.col("all") - F.col("m.k")) / BLOCK).cast("int").alias("outer"),
        F.ceil(F.col("m.k") / BLOCK).cast("int").alias("inner"),
    )
    placed = at_home.join(groups, "shingle").withColumn("out", F.col("root") != F.col("main"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner"))).cast("int"))
    across = "transform(sequence(0, outer - 1), x -> struct(0 as kind, least(own, x) as i, greatest(own, x) as j))"
    inward = "transform(sequence(0, inner - 1), x -> struct(1 as kind, own as i, x as j))"
    outward = "transform(sequence(0, outer - 1), x -> struct(1 as kind, x as i, own as j))"
    met = placed.select("shingle", "node", "out", "own", F.inline(F.expr(f"if(out, concat({across}, {inward}), {outward})")))
    # the side of a node in a tile: 0 in block i, 1 in block j
    side = F.when(F.col("kind") == 1, (~F.col("out")).cast("int")).otherwise((F.col("own") != F.col("i")).cast("int"))
    return met.select("shingle", "kind", "i", "j", "node", side.alias("side"))


def block_links(homes: DataFrame, roots: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Links within each dense shingle between different components: a forest of those of every tile."""
    full = tiles(homes, roots).join(bodies, "node")
    return stored(
        full.groupBy("shingle", "kind", "i", "j").applyInArrow(lambda g: link_blocks(g, size, percent), "a long, b long").distinct(),
        "links",
    )


def link_blocks(group: pa.Table, size: int, percent: int) -> pa.Table:
    """A forest of the links between two blocks (or inside one), by counting shared shingles."""
    expand = zstandard.ZstdDecompressor()
    nodes, side = group.column("node").to_numpy(), group.column("side").to_numpy()
    left = np.flatnonzero(side == 0)
    # a block of the nodes outside meets itself too
    right = left if group.column("kind")[0].as_py() == 0 and group.column("i")[0] == group.column("j")[0] else np.flatnonzero(side == 1)
    sets = [shingles(expand.decompress(body), size) for body in group.column("body").to_pylist()]
    lengths = np.array([len(s) for s in sets])
    found, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), lengths)
    shared = times > 1
    number = np.cumsum(shared) - 1
    row, column = row[shared[column]], number[column[shared[column]]]
    both = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(shared.sum()), COLUMNS):
        here = slice(*np.searchsorted(column, [at, at + COLUMNS]))
        marks = np.zeros((len(sets), COLUMNS), np.float32)
        marks[row[here], column[here] - at] = 1
        both += marks[left] @ marks[right].T
    union = lengths[left][:, None] + lengths[right][None, :] - both
    x, y = np.nonzero(100 * both >= percent * union)
    root = list(range(len(sets)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    for a, b in zip(left[x].tolist(), right[y].tolist(), strict=True):
        if (p := find(a)) != (q := find(b)):
            root[p] = q
            links.append((int(nodes[a]), int(nodes[b])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def remaining_pairs(posts: DataFrame, homes: DataFrame, percent: int) -> DataFrame:
    """Every candidate pair of nodes of different components that met in no block.

    For each shingle the nodes outside its largest component meet all nodes of other components.
    """
    posts = posts.join(homes, "node", "left").withColumn("homes", F.coalesce("homes", F.array().cast("array<long>")))
    sizes = posts.groupBy("shingle", "root").agg(F.count("*").alias("k"))
    main = sizes.groupBy("shingle").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    main = main.select("shingle", F.col("m.root").alias("main"))
    live = posts.join(main, "shingle")
    names = ["node", "n", "level", "least", "root", "homes"]
    x = live.where("root != main").select("shingle", *[F.col(c).alias(f"x_{c}") for c in names])
    y = live.select("shingle", "main", *[F.col(c).alias(f"y_{c}") for c in names])
    asked = F.least("x_least", "y_least")
    met = x.join(y, "shingle").where(
        (F.col("x_root") != F.col("y_root"))
        & ~F.arrays_overlap("x_homes", "y_homes")
        & ((F.col("y_root") == F.col("main")) | (F.col("x_node") < F.col("y_node")))
        & (F.greatest("x_level", "y_level") <= asked)
        & close_enough(F.col("x_n"), F.col("y_n"), percent)
    )
    ordered = met.select(F.least("x_node", "y_node").alias("x"), F.greatest("x_node", "y_node").alias("y"), asked.alias("asked"))
    return ordered.groupBy("x", "y").agg(F.count("*").alias("k"), F.max("asked").alias("asked")).where("k >= asked").select("x", "y")


def link_groups(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT, matches: int = MATCHES) -> tuple[DataFrame, DataFrame]:
    """Documents and the groups of nodes: ``doc_id, mark, n, node`` and ``node, rep, root``.

    ``mark`` is a hash of the text; ``node`` is NULL for a text without words.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text"
    )
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts.select("text"), size))
    sets = stored(
        texts.mapInArrow(
            lambda b: prefix_batches(b, shared, size, percent, matches),
            "doc_id long, mark long, n int, h1 long, h2 long, prefix array<long>",
        ),
        "sets",
    )
    nodes = stored(
        sets.where("n > 0")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    posts = postings(nodes, percent, matches)
    wanted = posts.select("node").distinct().join(nodes.select("node", "rep", "h1", "h2"), "node")
    bodies = stored(
        texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["rep"]))
        .select("node", "h1", "h2", "text")
        .mapInArrow(lambda b: pack_batches(b, size), "node long, body binary")
        .dropDuplicates(["node"]),
        "bodies",
    )
    homes = stored(homes_of(posts), "homes")
    links = verified(typical_pairs(rooted(posts, None), percent), bodies, size, percent)
    roots = stored(components(links), "roots")
    links = links.unionByName(block_links(homes, roots, bodies, size, percent))
    roots = stored(components(links), "roots")
    links = links.unionByName(verified(remaining_pairs(rooted(posts, roots), homes, percent), bodies, size, percent))
    roots = stored(components(links), "roots")
    named = nodes.select("node", "rep").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = sets.join(nodes.select("h1", "h2", "node"), ["h1", "h2"], "left").select("doc_id", "mark", "n", "node")
    return known, stored(named, "groups")


def component_ids(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Two documents link when their sets of ``size``-word shingles (A-Z in lower case) have a Jaccard
    similarity of at least ``percent`` in a hundred; the component is named by the smallest ``doc_id``
    reachable over links. Fewer words than ``size`` are one shingle. A NULL text or one without words has an
    empty set and stays alone, as its own component. Repeated rows and equal texts are linked like any
    others. Rows with one ``doc_id`` and different texts are different documents. A NULL ``doc_id`` names a
    component only if nothing else is in it. Other columns are ignored; an empty table gives no rows.
    """
    known, groups = link_groups(docs, size=size, percent=percent)
    names = groups.groupBy("root").agg(F.min("rep").alias("name"))
    named = groups.select("node", "root").join(names, "root").select("node", "name")
    return known.join(named, "node", "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, *, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` with the smallest ``doc_id`` of each group, all columns kept; one row a group.

    Texts without words are groups of their own, and repeated rows of them stay.
    """
    known, groups = link_groups(docs, size=size, percent=percent)
    rooted_rows = known.where("n > 0").join(groups.select("node", "root"), "node").select("doc_id", "mark", "root")
    first = rooted_rows.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("k")).select("root", "k.*")
    first = first.select("root", F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    alone = known.where("n = 0").select(F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    rows = docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("__row"),
        F.col("doc_id").cast("long").alias("__doc"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("__text"),
    )
    kept = first.unionByName(alone)
    met = rows.join(kept, rows["__doc"].eqNullSafe(kept["__id"]) & (rows["__text"] == kept["__mark"]))
    grouped = met.where("root is not null").groupBy("root").agg(F.first("__row").alias("__row"))
    return grouped.select("__row.*").unionByName(met.where("root is null").select("__row.*"))
