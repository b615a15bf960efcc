"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Documents with equal sets form a class, and only
one representative per class goes on. Each representative is embedded by COORDINATES minwise
tokens. TREES independent trees branch it: the node at a depth is the path of the minwise tokens
selected so far, and now and then a node branches twice (``twice``), so that a pair at the threshold
survives on more paths than it loses, whatever the threshold. A node is small once at most LEAF of its members
lie outside its largest known group; then each of those is compared with all members (64-bit
one-bit sketches first), and confirmed on the full sets. In a node that one group dominates, a crowd
of near copies, nearly all tokens agree and branching parts similar pairs as often as others: up to
CROWD members outside the group are compared with all members on the full sets, in blocks. Other
nodes branch on; at DEPTH every node is compared, whatever its size, in the same blocks, so nothing is
dropped: every node of every tree is compared or has children.

Before branching, each root's members are linked with one of them, the root's pivot, where the full
sets confirm it. Known links make a crowd of near copies one group, and a pair inside a group needs no further
comparison: no node emits all its pairs. Groups are joined by label propagation over stored tables.

Node sizes come from map-side-combined counts; joins on nodes treat hot nodes apart and cut their
members into salted blocks. A pair at the threshold fails the sketches with a probability below SKETCH_MISS.
It shares no root with 7e-14 at 0.85 and 7e-12 at 0.80. Where all its nodes stay large down to DEPTH it misses
all trees with 4e-7 at 0.85 and 2e-6 at 0.80, by simulation: trees share coordinates, so this is more than for
independent ones. These figures are for thresholds of 0.8 and more; below, a pair misses the roots more often.

Null and empty texts have no shingles and are linked with nothing. Repeated rows of a doc_id are one
document: the result has a row for each. A null doc_id is reported alone. An empty table gives an
empty result. Extra columns are not read, and ``drop_near_copies`` keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .tables import clean_input, only_ids, stored, with_group_values, without_ids
from .workers import tidy

TREES, COORDINATES, DEPTH, LEAF = 16, 64, 4, 24
#: Second children of a node for each that would make up for the pairs lost at a level.
TWICE = 4
#: Most of the pairs at the threshold that may differ in too many sketch bits.
SKETCH_MISS = 2e-7
BLOCK_ROWS = 1_000
#: Members outside the largest group that a crowded node may have to be compared in blocks of so many rows.
CROWD, CROWD_ROWS = 4_096, 256
#: Most members of a node whose candidate pairs are listed one by one.
LISTED = 512
#: Shingles that are multiplied at once.
COLUMNS = 4_096
#: Ids whose edges a task contracts together.
CONTRACTED = 500_000
_SEEDS, _FACTORS = wh.seeds(COORDINATES, 7), wh.seeds(COORDINATES, 8) | np.uint64(1)


def twice(percent: int) -> int:
    """Second children of 100 nodes, TWICE times (100 / percent - 1) of them: 71 at 85, 100 at 80."""
    return -(-TWICE * (10_000 - 100 * percent) // max(percent, 1))


def sketch_bits(percent: int) -> int:
    """Sketch bits that may differ: a pair at the threshold differs in each with half its distance, in more than these with SKETCH_MISS at most."""
    p, bits = (100 - percent) / 200, 0
    while sum(math.comb(COORDINATES, i) * p**i * (1 - p) ** (COORDINATES - i) for i in range(bits + 1, COORDINATES + 1)) > SKETCH_MISS:
        bits += 1
    return bits


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets); a text of fewer than k words is one shingle."""
    lower = wh.LOWER[data]
    starts, ends, first = wh.spans(lower, offsets)
    words = wh.hashes(lower, starts, ends)
    at, shingles = wh.windows(words, first, k)
    size = np.diff(first)
    cuts = np.concatenate([[0], np.cumsum(np.maximum(size - k + 1, 0))])
    short = (size > 0) & (size < k)
    if short.any():
        whole = wh.folded(words, first)[0]
        shingles = np.insert(shingles, cuts[:-1][short], whole[short])
        cuts = np.concatenate([[0], np.cumsum(np.where(short, 1, np.diff(cuts)))])
    return wh.distinct_within(shingles, cuts)


def embed(sets: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper 32 bits of the minwise token of each coordinate, one bit of each as a 64-bit sketch)."""
    n = len(cuts) - 1
    tokens, sketch = np.zeros((n, COORDINATES), "<u4"), np.zeros(n, np.uint64)
    full = np.flatnonzero(cuts[:-1] < cuts[1:])
    if len(full):
        with np.errstate(over="ignore"):
            for c in range(COORDINATES):
                least = np.minimum.reduceat((sets ^ _SEEDS[c]) * _FACTORS[c], cuts[:-1][full])
                # which shingle it was, by another hash than the one that it is least in
                own = wh._mixed(least * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c))
                tokens[full, c] = (own >> np.uint64(32)).astype("<u4")
                sketch[full] |= (own & np.uint64(1)) << np.uint64(c)
    return tokens, sketch


_EMBEDDED = "doc_id long, n_shingles long, h1 long, h2 long, sketch long, tokens binary"


def _embedder(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in wh.blocks(batch.column(1)):
                sets, cuts = shingle_sets(data, offsets, k)
                h1, h2 = wh.folded(sets, cuts)
                tokens, sketch = embed(sets, cuts)
                raw = tokens.tobytes()
                columns = [batch.column(0).slice(row, len(offsets) - 1), pa.array(np.diff(cuts).astype(np.int64)), *(pa.array(wh.signed(x)) for x in (h1, h2, sketch)), pa.array([raw[i : i + 4 * COORDINATES] for i in range(0, len(raw), 4 * COORDINATES)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _EMBEDDED.split(", ")])

    return run


def _set_maker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in wh.blocks(batch.column(1)):
                sets, cuts = shingle_sets(data, offsets, k)
                raw = sets.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1), pa.array([raw[8 * a : 8 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())], names=["id", "shingles"])

    return run


def _confirmer(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                a, b = (a, b) if len(a) <= len(b) else (b, a)
                at = np.searchsorted(b, a)
                both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The distinct pairs (a < b) of doc_ids whose full shingle sets are similar enough, as a stored table."""
    pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _shingle_sets_of(ids, docs, k)
    wide = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b")), "b")
    wide = wide.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a")), "a")
    return stored(wide.select("a", "b", "of_a", "of_b").mapInArrow(tidy(_confirmer(percent)), "a long, b long"), "links")


def _alike(a: str, b: str, percent: int):
    """What a similar pair must fulfil by sizes and sketches."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.bit_count(F.col(f"{a}.sketch").bitwiseXOR(F.col(f"{b}.sketch"))) <= sketch_bits(percent))


def _coordinate(tree: int, depth: int) -> int:
    """Roots and the next three depths of all trees use each coordinate once."""
    return (tree + TREES * depth + 5 * (depth // 4)) % COORDINATES


def _token(coordinate: int):
    return F.substring("tokens", 4 * coordinate + 1, 4)


def roots(classes: DataFrame) -> DataFrame:
    """tree, node and the member's columns, one row per class and tree."""
    nodes = F.array(*[F.struct(F.lit(t).cast("int").alias("tree"), F.xxhash64(F.lit(t), _token(_coordinate(t, 0))).alias("node")) for t in range(TREES)])
    return classes.select(F.explode(nodes).alias("n"), "rep", "n_shingles", "sketch").select("n.tree", "n.node", "rep", "n_shingles", "sketch")


def branch(members: DataFrame, classes: DataFrame, depth: int, percent: int) -> DataFrame:
    """Children of the members' nodes at the next depth; a node's own hash says whether it has one more than the others."""
    # a class may be in as many nodes as there are trees; its tokens are looked up once
    own = members.groupBy("rep").agg(F.collect_list(F.struct("tree", "node")).alias("in"))
    wide = own.join(classes, "rep").select(F.explode("in").alias("m"), "rep", "n_shingles", "sketch", "tokens").select("m.tree", "m.node", "rep", "n_shingles", "sketch", "tokens")

    always, share = divmod(twice(percent), 100)

    def child(i: int):
        token = F.coalesce(*[F.when(F.col("tree") == t, _token((_coordinate(t, depth) + 7 * i) % COORDINATES)) for t in range(TREES)])
        return F.xxhash64("node", F.lit(depth), F.lit(i), token)

    children = [child(i) for i in range(always + 2)]
    nodes = F.when(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(100)) < share, F.array(*children)).otherwise(F.array(*children[:-1]))
    return wide.select("tree", F.explode(nodes).alias("node"), "rep", "n_shingles", "sketch")


def _small_nodes(members: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of nodes that are small: members outside the largest group against all members."""
    few = members.where("small AND grp <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_members - 1) div {BLOCK_ROWS} as int)")))).alias("x")
    all_ = members.where("small").withColumn("block", F.expr(f"cast(pmod(xxhash64(rep), (n_members - 1) div {BLOCK_ROWS} + 1) as int)")).alias("y")
    same = (F.col("x.node") == F.col("y.node")) & (F.col("x.block") == F.col("y.block")) & (F.col("x.grp") != F.col("y.grp"))
    once = (F.col("y.grp") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep"))
    return few.join(all_, same & once & _alike("x", "y", percent)).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, as products of 0/1 matrices."""
    out = np.zeros((len(x), len(y)), np.float32)
    both = np.intersect1d(np.unique(np.concatenate(x)), np.unique(np.concatenate(y)), assume_unique=True)
    for at in range(0, len(both), COLUMNS):
        columns = both[at : at + COLUMNS]
        a, b = (np.stack([np.isin(columns, s[np.searchsorted(s, columns[0]) : np.searchsorted(s, columns[-1], "right")], assume_unique=True) for s in side]).astype(np.float32) for side in (x, y))
        out += a @ b.T
    return out


def _crowd_comparer(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        rep, grp, few = (np.asarray(group[c]) for c in ("rep", "grp", "few"))
        sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group["shingles"]]
        xs, ys = np.flatnonzero(few), np.flatnonzero(~few)
        out: list[tuple[int, int]] = []
        if len(xs) and len(ys):
            size = np.array([len(s) for s in sets])
            both = _intersections([sets[i] for i in xs], [sets[i] for i in ys])
            hit = (100 * both >= percent * (size[xs][:, None] + size[ys][None] - both)) & (grp[xs][:, None] != grp[ys][None])
            # one link for each member and group that it reaches is as good as all
            done = set()
            for i, j in zip(*np.nonzero(hit), strict=True):
                if (xs[i], grp[ys[j]]) not in done:
                    done.add((xs[i], grp[ys[j]]))
                    out.append((int(rep[xs[i]]), int(rep[ys[j]])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _shingle_sets_of(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """id and sorted shingles of the documents in ``ids`` (doc_id, distinct), as a stored table."""
    texts = only_ids(clean_input(docs, "doc_id", "text").where("doc_id IS NOT NULL"), ids)
    # repeated rows of a doc_id: the same one for all pairs
    texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))
    return stored(texts.mapInArrow(tidy(_set_maker(k)), "id long, shingles binary"), "candidate-sets")


def _crowd_links(members: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of crowded nodes: members outside the largest group against all, block by block."""
    blocks = lambda n: F.expr(f"cast(({n} - 1) div {CROWD_ROWS} + 1 as int)")
    of = lambda n: F.expr(f"cast(pmod(xxhash64(rep), ({n} - 1) div {CROWD_ROWS} + 1) as int)")
    each = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    few = members.where("grp <> main").withColumn("xb", of("n_few")).withColumn("yb", each("n_members")).withColumn("few", F.lit(True))
    all_ = members.withColumn("yb", of("n_members")).withColumn("xb", each("n_few")).withColumn("few", F.lit(False))
    columns = ["node", "xb", "yb", "few", "rep", "grp"]
    sets = _shingle_sets_of(members.select(F.col("rep").alias("doc_id")).distinct(), docs, k)
    rows = few.select(*columns).unionByName(all_.select(*columns))
    rows = rows.groupBy("rep").agg(F.collect_list(F.struct(*[c for c in columns if c != "rep"])).alias("in")).join(sets.withColumnRenamed("id", "rep"), "rep")
    rows = rows.select(F.explode("in").alias("m"), "rep", "shingles").select("m.*", "rep", "shingles")
    return stored(rows.groupBy("node", "xb", "yb").applyInArrow(_crowd_comparer(percent), "a long, b long").distinct(), "crowd-links")


def linked_groups(classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(id, component_id) of all class representatives that are linked with another."""
    first = stored(roots(classes), "roots")
    total = first.count()
    # each tree has its own pivots: what one pivot misses of a crowd of near copies, the others link
    pivot = F.min_by(F.struct("rep", "n_shingles", "sketch"), F.struct(F.xxhash64("rep", "tree"), "rep"))
    sizes = stored(first.groupBy("node").agg(F.count(F.lit(1)).alias("n_members"), pivot.alias("pivot")).where("n_members > 1"), "root-sizes")
    members = stored(with_group_values(first, sizes, "node", "n_members", total), "members")
    star = members.where("rep <> pivot.rep").where((F.least("n_shingles", "pivot.n_shingles") * 100 >= F.greatest("n_shingles", "pivot.n_shingles") * percent) & (F.bit_count(F.col("sketch").bitwiseXOR(F.col("pivot.sketch"))) <= sketch_bits(percent)))
    labels = components(confirmed(star.select(F.col("pivot.rep").alias("a"), F.col("rep").alias("b")), docs, k, percent))
    pairs, crowds, depth = None, None, 0
    rows = members.select("tree", "node", "rep", "n_shingles", "sketch")
    while True:
        grouped = stored(rows.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("grp", F.coalesce("component_id", "rep")).drop("component_id"), "grouped")
        per = grouped.groupBy("node", "grp").count()
        stats = per.groupBy("node").agg(F.sum("count").alias("n_members"), F.count(F.lit(1)).alias("n_groups"), F.max_by("grp", F.struct("count", "grp")).alias("main"), F.max("count").alias("most")).where("n_groups > 1")
        few = F.col("n_members") - F.col("most")
        stats = stats.withColumn("n_few", few).withColumn("small", (few <= LEAF) & (F.col("n_members") <= LISTED))
        stats = stats.withColumn("dominated", (few <= CROWD) & (F.col("most") * 4 >= F.col("n_members")))
        stats = stored(stats.withColumn("crowded", ~F.col("small") & (F.col("dominated") | F.lit(depth >= DEPTH))), "nodes")
        joined = stored(with_group_values(grouped, stats, "node", "n_members", total), "node-members")
        own = joined.where("crowded").select("node", "rep", "grp", "main", "n_few", "n_members")
        crowds = own if crowds is None else crowds.union(own)
        new = _small_nodes(joined, percent)
        pairs = new if pairs is None else pairs.union(new)
        depth += 1
        large = joined.where("NOT small AND NOT crowded")
        if large.isEmpty():
            break
        rows = branch(large, classes, depth, percent)
    rest = confirmed(pairs, docs, k, percent)
    if not crowds.isEmpty():
        rest = rest.union(_crowd_links(crowds, docs, k, percent))
    if rest.isEmpty():
        return labels
    # the new links as links between groups
    for side in ("a", "b"):
        own = labels.select(F.col("id").alias(side), F.col("component_id").alias("label"))
        rest = rest.join(own, side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
    above = components(rest.where("a <> b").select("a", "b"))
    known = labels.join(above.select(F.col("id").alias("component_id"), F.col("component_id").alias("above")), "component_id", "left").select("id", F.coalesce("above", "component_id").alias("component_id"))
    return stored(known.unionByName(above.join(known.select("id"), "id", "left_anti")), "groups")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as edges from each id to the least id that it reaches within a run of CONTRACTED edges."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def contracted() -> pa.RecordBatch:
        ids = list(root)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["src", "dst"])

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            root.setdefault(x, x)
            root.setdefault(y, y)
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > CONTRACTED:
            yield contracted()
            root.clear()
    yield contracted()


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id reachable, for every id in ``edges`` (a, b).

    Each task first contracts the edges that it has. Then each round takes the least label among
    neighbours and the label's own label, so a chain halves. Every round is stored; joins are plain
    shuffle joins, whose large partitions Spark splits.
    """
    stars = stored(edges.mapInArrow(tidy(_contract), "src long, dst long"), "stars")
    both = stored(stars.union(stars.select("dst", "src")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("near"))
        step = stored(labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was")), "step")
        if step.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component_id")
        up = step.select(F.col("id").alias("label"), F.col("label").alias("above"))
        labels = stored(step.join(up, "label").select("id", F.least("label", "above").alias("label")), "labels")


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; percent: least Jaccard similarity in per cent."""
    embedded = stored(clean_input(docs, "doc_id", "text").mapInArrow(tidy(_embedder(k)), _EMBEDDED), "embedded")
    same = embedded.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n_shingles")
    classes = stored(same.agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs"), F.first("sketch").alias("sketch"), F.first("tokens").alias("tokens")), "classes")
    found = linked_groups(classes.select("rep", "n_shingles", "sketch", "tokens"), docs, k, percent)
    named = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.col("n_shingles").alias("n"), "n_docs", F.coalesce("component_id", "rep").alias("component_id"))
    named = stored(named.select(F.struct("h1", "h2", "n").alias("set"), "n_docs", "component_id"), "named")
    rows = stored(embedded.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "n_shingles", F.struct("h1", "h2", F.col("n_shingles").alias("n")).alias("set")), "rows")
    linked = with_group_values(rows, named, "set", "n_docs", rows.count()).select("doc_id", "n_shingles", "component_id")
    alone = embedded.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each component. Rows without doc_id stay."""
    return without_ids(docs, near_groups(docs, k, percent).select("doc_id", "kept"))
