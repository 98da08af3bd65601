"""N-gram Jaccard join with a token-group matrix, and the components of its links.

Documents are sets of word shingles; two link when 100 * |A & B| >=
percent * |A | B|.  Every link between different sets is found:

1. Nodes.  Equal sets are one node, so copies cost one row.
2. Groups.  Nodes with one min-hash are put together in groups of about
   ``GROUP`` nodes and linked there, then, with a second min-hash, one node
   of each component so far and the nodes without links.  A group for the
   search below is a component or a part of one.
3. Token-group matrix.  For each group the union of its members' prefixes:
   the first n - ceil(t * n) + 1 shingles of a set, rarest first.  Linked
   sets share a shingle of their prefixes, so a query whose prefix misses
   the union has no link there.  The first shingle they share must leave
   enough behind it in both, and sizes must fit; for groups of one, the
   prefixes themselves bound the overlap further.  Queries only look at
   groups of other, larger components.
4. Only groups within the bound are opened: members and queries meet, whole
   sets are compared.
5. Components of all links, by label propagation with pointer jumping.

The order of shingles comes from counts of hash classes over all documents,
so that a passage which many documents share stands last; any order gives
the same links.  Shingles are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_mark
from .hashing import NOT_SPACE, blocks, flat, mix, words
from .rows import forget, keep_rows, project, python_ready, written

SHINGLE = 5
PERCENT = 80
#: Hash classes of shingles that are counted, 2 ** this.
CLASS_BITS = 18
#: Nodes that a group has, about.
GROUP = 256
#: Queries that one task compares with a group, about.
QUERIES = 512
#: Tables of longs up to this many rows are broadcast (16 bytes a row); larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def by_text(order: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """``order`` within each text, text by text (small numbers are sorted by radix)."""
    small = doc.astype(np.uint16) if len(doc) and doc.max() < 1 << 16 else doc
    return order[np.argsort(small[order], kind="stable")]


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, hash) of each text's distinct shingles, sorted.

    A text of fewer than ``size`` words has its whole sequence as one.
    """
    data, begins = flat(texts)
    w = words(data, begins, NOT_SPACE)
    odd = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(w.hash)
    with np.errstate(over="ignore"):
        doc, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n >= size:
            full = w.doc[:n - size + 1] == w.doc[size - 1:]
            h = sum(w.hash[i:n - size + 1 + i] * odd[i] for i in range(size))[full]
            doc = w.doc[:n - size + 1][full]
        first = np.flatnonzero(np.diff(w.doc, prepend=-1))
        length = np.diff(np.append(first, n))
        first, length = first[length < size], length[length < size]
        short = length.astype(np.uint64) << np.uint64(56)
        for i in range(size - 1):
            has = i < length
            short[has] += w.hash[first[has] + i] * odd[i]
        doc, h = np.concatenate([doc, w.doc[first]]), mix(np.concatenate([h, short]))
    order = by_text(np.argsort(h), doc)
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def shingle_class(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def class_ranks(docs: DataFrame, size: int) -> np.ndarray:
    """For each class a rank that grows with its count over all documents;
    in steps of a sixteenth power of two.  2 ** CLASS_BITS bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CLASS_BITS, np.int64)
        for batch in batches:
            _, begins = flat(batch.column(1))
            for first, end in blocks(begins):
                total += np.bincount(shingle_class(shingles(batch.column(1)[first:end], size)[1]), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["class", "n"])

    counted = docs.mapInArrow(count, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << CLASS_BITS)
    counts[counted.column("class").to_numpy()] = counted.column("n").to_numpy()
    steps = np.floor(16 * np.log2(counts + 1))
    return np.minimum(steps - steps.min(), 255).astype(np.uint8)


def first_of(doc: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(doc, prepend=-1))


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares with any set it is linked to, at least."""
    return (percent * n + 99) // 100


NODE_COLUMNS = "doc_id long, digest binary, n long, fp1 long, fp2 long, m1 long, m2 long, tail long, prefix array<long>"


def signer(size: int, percent: int, ranks: np.ndarray):
    """Arrow batches (doc_id, text, digest) -> NODE_COLUMNS."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, begins = flat(batch.column(1))
            for first, end in blocks(begins):
                doc, h = shingles(batch.column(1)[first:end], size)
                rows = end - first
                n = np.bincount(doc, minlength=rows)
                some, at = np.flatnonzero(n), first_of(doc)
                out = np.zeros((4, rows), np.uint64)
                with np.errstate(over="ignore"):
                    for k, ufunc in enumerate((np.add, np.add, np.minimum, np.minimum)):
                        if len(at):
                            out[k, some] = ufunc.reduceat(mix(h ^ mix(np.array([k + 1], np.uint64))), at)
                # Rank first, then hash: h is sorted inside a text, and both sorts keep the order of equals.
                order = by_text(np.argsort(ranks[shingle_class(h)], kind="stable"), doc)
                place = np.arange(len(doc)) - np.repeat(at, n[some])
                keep = place < (n - need(n, percent) + 1)[doc]
                ends = np.searchsorted(doc[keep], np.arange(rows + 1))
                # Where the prefix ends in the order of all shingles: rank, then hash, as far as 63 bits hold.
                tail, ending = np.zeros(rows, np.int64), h[order][keep][ends[1:][some] - 1]
                tail[some] = (ranks[shingle_class(ending)].astype(np.int64) << 55) | (ending >> np.uint64(9)).astype(np.int64)
                prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[order][keep].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], batch.column(2)[first:end], pa.array(n, pa.int64()),
                     *[pa.array(x.view(np.int64)) for x in out], pa.array(tail), prefix],
                    ["doc_id", "digest", "n", "fp1", "fp2", "m1", "m2", "tail", "prefix"])

    return sign


def matched(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int | None = None) -> DataFrame:
    """left.join(right): by a broadcast if ``right``, a written table, has few
    enough rows, else by a shuffle."""
    rows = right.count() if rows is None else rows
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def whole_sets(docs: DataFrame, signed: DataFrame, nodes: DataFrame, size: int, name: str) -> DataFrame:
    """(node, n, s: sorted shingles) of ``nodes`` (node, doc_id, fp1, fp2),
    made from the texts of those documents again.

    ``signed`` says which ids repeat with one and the same set; only their
    texts have to be brought together to have one of each.
    """
    no_nulls = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id")]
    wanted = written(nodes.select("node", *no_nulls, "fp1", "fp2"), f"{name}-wanted")
    rows = wanted.count()
    repeated = written(signed.select(*no_nulls, "fp1", "fp2").groupBy("id", "no_id", "fp1", "fp2").agg(F.count(F.lit(1)).alias("k"))
                       .where("k > 1").select("id", "no_id").distinct(), f"{name}-repeated")
    named = docs.select(*no_nulls, "text")
    texts = matched(named, wanted.select("id", "no_id"), ["id", "no_id"], "left_semi", rows)
    n_repeated = repeated.count()
    if n_repeated:
        texts = matched(texts, repeated, ["id", "no_id"], "left_anti", n_repeated).union(
            matched(texts, repeated, ["id", "no_id"], "left_semi", n_repeated).dropDuplicates(["id", "no_id", "text"]))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, begins = flat(batch.column(2))
            for first, end in blocks(begins):
                doc, h = shingles(batch.column(2)[first:end], size)
                n, at = np.bincount(doc, minlength=end - first), first_of(doc)
                out = np.zeros((2, end - first), np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(2):
                        if len(at):
                            out[k, np.flatnonzero(n)] = np.add.reduceat(mix(h ^ mix(np.array([k + 1], np.uint64))), at)
                ends = np.append(0, np.cumsum(n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:end], batch.column(1)[first:end], *[pa.array(x.view(np.int64)) for x in out],
                     pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h.view(np.int64)))],
                    ["id", "no_id", "fp1", "fp2", "n", "s"])

    made = texts.mapInArrow(make, "id long, no_id boolean, fp1 long, fp2 long, n long, s array<long>")
    found = matched(made, wanted, ["id", "no_id", "fp1", "fp2"], "inner", rows)
    return written(found.select("node", "n", "s"), f"{name}-sets")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|x & y| for each x of ``a`` and y of ``b``; only shingles that both sides have are looked at."""
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(all_a, all_b)
    out = np.zeros((len(a), len(b)), np.float32)
    row_a, row_b = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    if not len(shared):
        return out
    at_a, at_b = (np.minimum(np.searchsorted(shared, x), len(shared) - 1) for x in (all_a, all_b))
    in_a, in_b = shared[at_a] == all_a, shared[at_b] == all_b
    step = 4096
    for low in range(0, len(shared), step):
        width = min(step, len(shared) - low)
        parts = []
        for rows, at, has, n in ((row_a, at_a, in_a, len(a)), (row_b, at_b, in_b, len(b))):
            here = has & (at >= low) & (at < low + width)
            one = np.zeros((n, width), np.float32)
            one[rows[here], at[here] - low] = 1
            parts.append(one)
        out += parts[0] @ parts[1].T
    return out


def linked(a: list[np.ndarray], b: list[np.ndarray], percent: int) -> np.ndarray:
    both = overlaps(a, b).astype(np.int64)
    sizes = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :]
    return 100 * both >= percent * (sizes - both)


def in_group(percent: int):
    """All nodes of a group -> (node, least node it reaches by links inside the group), where they differ."""

    def link(table: pa.Table) -> pa.Table:
        nodes = np.array(table.column("node"))
        order = np.argsort(nodes)
        sets = table.column("s")
        near = linked(*[[np.asarray(sets[int(i)].values) for i in order]] * 2, percent)
        label = np.arange(len(order))
        while True:
            low = np.where(near, label[None, :], len(order)).min(1)
            if (low == label).all():
                break
            label = low
        moved = label != np.arange(len(order))
        return pa.table({"a": pa.array(nodes[order][moved], pa.int64()), "b": pa.array(nodes[order][label[moved]], pa.int64())})

    return link


def shared_key(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """(node, key, part) of the nodes that share ``key`` with others.  Keys with many nodes are dealt to several parts."""
    sizes = written(nodes.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where("k > 1"), f"{name}-sizes")
    return written(matched(nodes, sizes, [key], "inner").select(
        "node", F.col(key).alias("key"), F.pmod(F.xxhash64("node"), F.ceil(F.col("k") / GROUP)).alias("part")), name)


def group_links(sets: DataFrame, dealt: DataFrame, percent: int, name: str) -> DataFrame:
    """Links inside the groups of ``dealt`` (``shared_key``)."""
    grouped = matched(sets, dealt, ["node"], "inner").select("node", "key", "part", "s")
    return written(grouped.groupBy("key", "part").applyInArrow(in_group(percent), "a long, b long"), name)


def components(links: DataFrame) -> DataFrame:
    """(node, label): for each node of ``links`` (a, b) the least node it
    reaches.  Each round takes the least label among neighbours, then the
    label's own label; tables are written, so a round's lineage is short."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "components-links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")),
                     "components-labels")
    rows = labels.count()
    while True:
        # A node's own label counts as that of a neighbour.
        near = matched(both, labels.select(F.col("node").alias("b"), "label"), ["b"], "inner", rows).select(
            F.col("a").alias("node"), F.col("label").alias("low"), F.lit(None).cast("long").alias("label"))
        own = labels.select("node", F.col("label").alias("low"), "label")
        now = near.union(own).groupBy("node").agg(F.min("low").alias("low"), F.max("label").alias("label"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = written(matched(now, jump, ["low"], "inner", rows).select(
            "node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")), "components-labels")
        labels = new.select("node", "label")
        if not new.where("moved").limit(1).count():
            return labels


def part_of(size) -> Column:
    """The part of its component that a node is in."""
    return F.pmod(F.xxhash64("node"), F.ceil(size / GROUP)).cast("int")


def candidates(nodes: DataFrame, groups: DataFrame, rows: int, percent: int) -> DataFrame:
    """(node, comp, part, alone) for each group that a query node may have to open.

    ``groups``: (node, comp, size) of nodes in components of several; any
    other node is a component of its own (``alone``).
    """
    placed = matched(nodes, groups.select("node", "comp", "size"), ["node"], "left", rows)
    # Both sides of the join below need the same columns, so the shingles are dealt out once.
    tokens = placed.select("node", "n", "comp", "size", F.posexplode("prefix").alias("at", "token")).repartition("token").select(
        "token", "node", "n", "at", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    # The matrix: which groups have the token; what a member has left behind it, and sizes, at the most.
    matrix = tokens.groupBy("token", F.col("comp").alias("g_comp"), part_of(F.col("size")).alias("g_part")).agg(
        F.max("size").alias("g_size"), F.max(F.col("n") - F.col("at") - 1).alias("rest"),
        F.min("n").alias("least"), F.max("n").alias("most"))
    larger = F.struct("size", "comp") < F.struct("g_size", "g_comp")
    sizes = (100 * F.col("n") >= percent * F.col("least")) & (100 * F.col("most") >= percent * F.col("n"))
    # The first shingle that a linked pair shares has the shared ones behind it, in both sets.
    shared = percent * (F.col("n") + F.col("least"))
    room = ((100 + percent) * (F.col("n") - F.col("at")) >= shared) & ((100 + percent) * (F.col("rest") + 1) >= shared)
    return tokens.join(matrix, "token").where(larger & sizes & room).groupBy("node", "g_comp", "g_part").agg(
        F.max("g_size").alias("g_size")).select(
        "node", F.col("g_comp").alias("comp"), F.col("g_part").alias("part"), (F.col("g_size") == 1).alias("alone"))


def bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (node, comp) of single nodes whose prefixes let them be linked.

    Of two prefixes take the one that ends first in the order of shingles:
    its shingles that the other prefix lacks, the other set lacks.  What it
    shares, and all behind it, bounds the overlap.
    """
    ends = nodes.select("node", "n", "tail", "prefix")
    left = matched(ends, pairs, ["node"], "inner")
    right = matched(ends, written(pairs.select(F.col("comp").alias("node")).distinct(), "jaccard-ends"), ["node"], "inner").select(
        F.col("node").alias("comp"), F.col("n").alias("n2"), F.col("tail").alias("tail2"), F.col("prefix").alias("prefix2"))
    behind = lambda n: F.ceil(percent * F.col(n) / 100) - 1
    most = F.size(F.array_intersect("prefix", "prefix2")) + (
        F.when(F.col("tail") < F.col("tail2"), behind("n")).when(F.col("tail") > F.col("tail2"), behind("n2"))
        .otherwise(F.greatest(behind("n"), behind("n2"))))
    return left.join(right, "comp").where((100 + percent) * most >= percent * (F.col("n") + F.col("n2"))).select("node", "comp")


def opened(percent: int):
    """Members and queries of a group -> (query, one member it is linked to)."""

    def link(table: pa.Table) -> pa.Table:
        node, is_query, sets = np.array(table.column("node")), np.array(table.column("query")), table.column("s")
        members, queries = ([np.asarray(sets[int(i)].values) for i in np.flatnonzero(is_query == k)] for k in (False, True))
        if not members or not queries:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        # The bound once more, now with the whole union.
        union = np.unique(np.concatenate(members))
        near = np.zeros((len(queries), len(members)), bool)
        for i, q in enumerate(queries):
            near[i] = np.isin(q, union, assume_unique=True).sum() >= need(np.int64(len(q)), percent)
        some = np.flatnonzero(near.any(1))
        if len(some):
            near[some] = linked([queries[i] for i in some], members, percent)
        hit = np.flatnonzero(near.any(1))  # members are one component, so one link to any of them says it all
        return pa.table({"a": pa.array(node[is_query][hit], pa.int64()),
                         "b": pa.array(node[~is_query][near[hit].argmax(1)], pa.int64())})

    return link


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, component (a
    number of its own for each component, null for texts without shingles),
    text_sha256.

    Words are runs of characters other than ASCII whitespace, A-Z
    lower-cased.  component_id is the smallest doc_id that links reach, the
    row's own included; null if none of them has an id.  A null or empty
    text, or one of whitespace, has no shingles and no links.  Equal texts
    are one class, whatever their ids.
    """
    spark, mark = docs.sparkSession, scratch_mark()
    python_ready(spark)
    docs = project(docs, id_col, text_col)
    ranks = class_ranks(docs, size)
    digested = docs.select("doc_id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    signed = written(digested.mapInArrow(signer(size, percent, ranks), NODE_COLUMNS), "jaccard-signed")
    nodes = written(signed.where("n > 0").groupBy("fp1", "fp2", "n").agg(
        F.min("doc_id").alias("doc_id"), F.first("m1").alias("m1"), F.first("m2").alias("m2"), F.first("tail").alias("tail"),
        F.first("prefix").alias("prefix"))
        .withColumn("node", F.monotonically_increasing_id()), "jaccard-nodes")

    # Groups of nodes with one min-hash; then of what that left apart, with another.
    by_first = shared_key(nodes.select("node", "m1"), "m1", "jaccard-first")
    by_second = shared_key(nodes.select("node", "m2"), "m2", "jaccard-second")
    some = written(by_first.select("node").union(by_second.select("node")).distinct(), "jaccard-some")
    sets = whole_sets(docs, signed, matched(nodes.select("node", "doc_id", "fp1", "fp2"), some, ["node"], "inner"), size, "jaccard-groups")
    links = group_links(sets, by_first, percent, "jaccard-links")
    labels = components(links)
    inner = written(labels.where("label < node").select("node"), "jaccard-inner")
    apart = shared_key(matched(matched(nodes.select("node", "m2"), some, ["node"], "inner"), inner, ["node"], "left_anti"),
                       "m2", "jaccard-apart")
    links = links.union(group_links(sets, apart, percent, "jaccard-links"))
    labels = components(links)

    # Their components, in parts, are the groups of the matrix.
    sizes = written(labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")), "jaccard-comps")
    groups = written(matched(labels, sizes, ["label"], "inner").select(
        "node", F.col("label").alias("comp"), "size", part_of(F.col("size")).alias("part")), "jaccard-parts")
    hits = written(candidates(nodes.select("node", "n", "prefix"), groups, groups.count(), percent), "jaccard-candidates")
    pairs = written(hits.where("alone").select("node", "comp"), "jaccard-pairs")
    wanted = written(hits.where("NOT alone").select("node", "comp", "part").union(
        bounded(pairs, nodes, percent).select("node", "comp", F.lit(0).alias("part"))), "jaccard-bounded")

    # Members and queries of the groups to open, the queries in as many portions as they need.
    to_open = written(wanted.groupBy("comp", "part").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("portions")),
                      "jaccard-open")
    n_open = to_open.count()
    queries = matched(wanted, to_open, ["comp", "part"], "inner", n_open).select(
        "node", "comp", "part", F.pmod(F.xxhash64("node"), F.col("portions")).cast("int").alias("portion"), F.lit(True).alias("query"))
    in_parts = matched(groups, to_open, ["comp", "part"], "inner", n_open).select("node", "comp", "part", "portions")
    singles = to_open.join(groups.select("comp"), "comp", "left_anti").select(F.col("comp").alias("node"), "comp", "part", "portions")
    members = in_parts.union(singles).select(
        "node", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(False).alias("query"))
    meet = written(queries.union(members), "jaccard-meet")
    opening = written(meet.select("node").distinct(), "jaccard-opening")
    more = whole_sets(docs, signed, matched(nodes.select("node", "doc_id", "fp1", "fp2"), opening, ["node"], "inner"), size, "jaccard-opened")
    met = matched(more, meet, ["node"], "inner").groupBy("comp", "part", "portion").applyInArrow(opened(percent), "a long, b long")
    found = written(met, "jaccard-found")

    # What the new links add to the components; then every document's.
    labelled = components(links.union(found))
    by_node = nodes.select("node", "fp1", "fp2", "n", "doc_id").join(labelled, "node", "left").select(
        "fp1", "fp2", "n", "doc_id", F.coalesce("label", "node").alias("label"))
    least = by_node.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    classes = written(by_node.join(least, "label").select("fp1", "fp2", "n", "component_id", F.col("label").alias("component")),
                      "jaccard-classes")
    forget(spark, mark, signed, classes)
    rows = signed.select("doc_id", "digest", "n", "fp1", "fp2")
    return rows.join(classes, ["fp1", "fp2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "component", F.lower(F.hex("digest")).alias("text_sha256"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns: of each component the one with the
    smallest doc_id (ids before nulls, then the smaller digest), and all rows
    without shingles."""
    found = written(jaccard_components(docs, size, percent), "jaccard-classed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")).alias("first")
    stay = found.where(F.col("component").isNotNull()).groupBy("component").agg(first).select("first.doc_id", "first.text_sha256")
    return keep_rows(docs, stay.union(found.where(F.col("component").isNull()).select("doc_id", "text_sha256")))
