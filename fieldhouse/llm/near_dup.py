"""MinHash near-deduplication by a chosen-path set similarity join.

A document's set holds its distinct word shingles. Equal sets are collapsed to one representative, the smallest doc_id.
Each representative has SIZE minwise tokens. In each of `trees` independent random trees a node picks every token position
with probability picks / (threshold * SIZE), by a hash of the node's own path, and sends a document to one child for each
picked position, named by the document's token there. Two sets of similarity s meet again in a child with probability
1 - exp(-picks * s / threshold); picks is 1 at the root and PICKS below. So with 16 trees a pair at the threshold that must
be found at depth 1, 2 or 3 is missed with probability about 1e-7, 4e-6 or 2e-5, and less above it.

1. Small nodes (up to `small` members) are compared exhaustively, inside one task, on sketches (2 bits of each token): pairs
   that cannot reach the threshold are dropped. Of the others, each member's nearest and its nearest of smaller id go out
   first, and the rest apart from them. A node that has more than `sparse` of the rest for a member is dense; it is only
   marked. Larger nodes are dealt out in blocks of small size, with the node's LEADERS (the least members in some random
   orders) as guests in each, for the nearest pairs; then they branch, up to depth `deepest`. Those still large are dense.
2. The nearest pairs are confirmed on full sets of the texts; star contraction gives components. A group of any size has
   about two such pairs for a member, whatever the number of its links.
3. Of the rest, and of dense nodes, only pairs across components can change anything. Pairs are confirmed like before.
   Dense nodes that hold one component are done; in the others the members outside the largest component are compared on
   full sets with all members, in blocks of bounded rows and bytes: a block holds its own members, and outsiders from other
   blocks pass through it one small batch at a time. What comes out are links between components, not pairs.
4. Components of components, joined back.

No pair inside a component is looked at again, since it could change nothing. Nodes are never gathered beyond a block.

Sets: A-Z lower-cased, words split at ASCII white space; with fewer words than a shingle the whole sequence is one
shingle; null and empty texts have none and are linked with nothing. Rows with one id are one document. A null id counts
as the smallest. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldhouse.llm.components import components
from fieldhouse.llm.util import WordCodes, byte_values, mixed, small_batches, trimmed, written

SIZE, TREES, SMALL, DEEPEST = 64, 16, 3000, 3
#: Picks of a node below the root, compared to the root's; guests in each block of a large node; pairs for a member beyond
#: which a node is dense; bytes of full sets in a block of a dense node.
PICKS, LEADERS, SPARSE, HOME_BYTES = 1.5, 8, 4, 16_000_000
#: Rows of nodes up to which they are compared together, by offsets; guests that pass through a block together.
FEW, GUESTS = 16, 256
_NONE = -(1 << 63)
_draw = np.random.default_rng(64)
_A = _draw.integers(1, 1 << 63, SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _draw.integers(1, 1 << 63, SIZE, dtype=np.uint64)


def shingles(text: bytes, width: int, codes: WordCodes) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a text."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    code = codes.of(words)
    size = min(width, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + code[j : j + len(out)])
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """SIZE minwise tokens of a set."""
    best = np.full(SIZE, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 4096):
        best = np.minimum(best, (own[start : start + 4096, None] * _A + _B).min(axis=0))
    return (mixed(best) >> np.uint64(32)).astype(np.uint32)


def sketches(tokens: np.ndarray) -> np.ndarray:
    """Two 64-bit words for each row of tokens, 2 bits for each token."""
    symbols = (tokens & np.uint32(3)).astype(np.uint64)
    shifts = np.uint64(2) * np.arange(SIZE // 2, dtype=np.uint64)
    return np.stack([(symbols[:, : SIZE // 2] << shifts).sum(axis=1, dtype=np.uint64), (symbols[:, SIZE // 2 :] << shifts).sum(axis=1, dtype=np.uint64)], axis=1)


def most_different(threshold: float) -> int:
    """Differing 2-bit symbols out of SIZE beyond which a pair is dropped: five deviations above their mean at the threshold
    (24 at 0.8). Unrelated pairs have 48 on average."""
    p = 0.75 * (1 - threshold)
    return int(np.ceil(SIZE * p + 5 * np.sqrt(SIZE * p * (1 - p))))


def _key() -> F.Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE))


def sets(docs: DataFrame, width: int) -> DataFrame:
    """k, n (distinct shingles), a 128-bit digest of the set, and its tokens."""
    names = ["k", "n", "d1", "d2", "tokens"]

    def run(batches):
        codes = WordCodes()
        for batch in batches:
            n, d1, d2, tokens = [], [], [], []
            for text in byte_values(batch.column(1)):
                own = shingles(text, width, codes)
                n.append(len(own))
                one = mixed(own)
                d1.append(one.sum(dtype=np.uint64))
                d2.append(mixed(one ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
                tokens.append(signature(own).tobytes() if len(own) else b"")
            arrays = [batch.column(0), pa.array(n, pa.int64()), *(pa.array(np.array(d, np.uint64).view(np.int64)) for d in (d1, d2)), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(_key().alias("k"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "k long, n long, d1 long, d2 long, tokens binary")


NODE = "node long, k long, n int, s1 long, s2 long"


def _children(node: np.ndarray, tokens: np.ndarray, threshold: float, picks: float) -> tuple[np.ndarray, np.ndarray]:
    """Row index and child node, for each picked token position of each row's node."""
    positions = np.arange(SIZE, dtype=np.uint64)
    limit = np.uint64(min((1 << 64) - 1, int((1 << 64) * picks / (threshold * SIZE))))
    picked = mixed(mixed(node)[:, None] + mixed(positions + np.uint64(1))[None, :]) < limit
    row, position = np.nonzero(picked)
    child = mixed(node[row] * np.uint64(3) + mixed(tokens[row, position].astype(np.uint64) * np.uint64(SIZE) + position.astype(np.uint64)))
    return row, child


def _branched(rows: DataFrame, threshold: float, trees: int = 0) -> DataFrame:
    """Child rows of (node, k, n, tokens); with trees > 0, of (k, n, tokens) from the roots of so many trees."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n = batch.column("k").to_numpy(), batch.column("n").to_numpy().astype(np.int32)
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, SIZE)
            sketch = sketches(tokens)
            roots = [mixed(np.full(len(k), t + 1, np.uint64)) for t in range(trees)] or [batch.column("node").to_numpy().view(np.uint64)]
            for node in roots:
                row, child = _children(node, tokens, threshold, 1.0 if trees else PICKS)
                columns = (child.view(np.int64), k[row], n[row], sketch[row, 0].view(np.int64), sketch[row, 1].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "k", "n", "s1", "s2"])

    return rows.mapInArrow(trimmed(run), NODE)


def _different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing symbols of sketches; a and b: arrays whose last axis is the two words."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.uint8)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of differing symbols between the rows of a and of b, some rows at a time."""
    out = np.empty((len(a), len(b)), np.uint8)
    for start in range(0, len(a), 128):
        out[start : start + 128] = _different(a[start : start + 128, None], b[None])
    return out


def _groups(batches, columns: int):
    """Batches of rows sorted by (first, second column) as numpy columns of whole groups. Keeps at most a batch and a group."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)])
        own = held[-1]
        turns = np.flatnonzero((own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1]))
        first = len(held) > 1 and (held[-2][0][-1], held[-2][1][-1]) != (own[0][0], own[1][0])
        if len(turns) or first:
            at = int(turns[-1]) + 1 if len(turns) else 0
            yield [np.concatenate([*(h[i] for h in held[:-1]), own[i][:at]]) for i in range(columns)]
            held = [[c[at:] for c in own]]
    if held:
        yield [np.concatenate([h[i] for h in held]) for i in range(columns)]


#: Kinds of rows that a comparison gives: a nearest pair, another pair, a dense node.
NEAREST, OTHER, DENSE = 0, 1, 2
COMPARED = "kind int, node long, a long, b long"


def _few(group: np.ndarray, k: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (i < j) of many nodes of at most FEW members, and whether each is a nearest one."""
    found = []
    for o in range(1, FEW):
        i = np.flatnonzero(group[o:] == group[:-o]) if len(group) > o else np.zeros(0, np.int64)
        d = _different(sketch[i], sketch[i + o])
        good = (d <= most) & (k[i] != k[i + o])
        found.append((i[good], i[good] + o, d[good]))
    i, j, d = (np.concatenate([f[x] for f in found]) for x in range(3))
    nearest = np.zeros(len(i), bool)
    if len(i):
        both, other, far, pair = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([d, d]), np.tile(np.arange(len(i)), 2)
        for keys, which in (((i, d, j), np.arange(len(i))), ((other, far, both), pair)):
            order = np.lexsort(keys)
            nearest[which[order[np.concatenate([[True], keys[-1][order][1:] != keys[-1][order][:-1]])]]] = True
    return i, j, nearest


def _many(k: np.ndarray, sketch: np.ndarray, guests: int, most: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The same for one node or block, whose first rows are `guests`; with more than `room` pairs that are not nearest
    ones the node is dense, and these are left out."""
    d = _between(sketch, sketch)
    d[k[:, None] == k[None]] = 255
    d[:guests, :guests] = 255
    rows = np.arange(len(k))
    near = np.concatenate([d.argmin(axis=1), np.where(np.tri(len(k), k=-1, dtype=bool), d, 255).argmin(axis=1)])
    both = np.tile(rows, 2)
    good = d[both, near] <= most
    pairs = np.unique(np.maximum(both, near)[good] * len(k) + np.minimum(both, near)[good])
    if int((d <= most).sum()) // 2 - len(pairs) > room:
        return pairs % len(k), pairs // len(k), np.ones(len(pairs), bool), True
    j, i = np.nonzero(np.tril(d <= most, -1))
    return i, j, np.isin(j * len(k) + i, pairs), False


def _compared(rows: DataFrame, threshold: float, sparse: int, last: bool) -> DataFrame:
    """Exhaustive comparison on sketches inside each (node, block) of (node, block, home, k, s1, s2, parts)."""
    most = most_different(threshold)

    def out(kind, node, a, b):
        columns = (np.asarray(kind, np.int32), node, np.minimum(a, b), np.maximum(a, b))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", "node", "a", "b"])

    def run(batches):
        for node, block, home, k, s1, s2, parts in _groups(batches, 7):
            sketch = np.stack([s1, s2], axis=1).view(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (block[1:] != block[:-1])]))
            size = np.diff(np.append(first, len(node)))
            group = np.repeat(np.arange(len(first)), size)
            few = np.flatnonzero((size[group] > 1) & (size[group] <= FEW) & (parts == 1))
            i, j, nearest = _few(group[few], k[few], sketch[few], most)
            if len(i):
                i, j = few[i], few[j]
                # a small node is never dense: its other pairs are fewer than FEW / 2 for a member
                yield out(np.where(nearest, NEAREST, OTHER), node[i], k[i], k[j])
            for start, n in zip(first.tolist(), size.tolist()):
                large = parts[start] > 1
                if n <= FEW and not large:
                    continue
                own = slice(start, start + n)
                i, j, nearest, dense = _many(k[own], sketch[own], int((home[own] == 0).sum()), most, sparse * n)
                if large:  # pairs across blocks were not seen: the node branches, or is dense at the last depth
                    i, j, nearest, dense = i[nearest], j[nearest], nearest[nearest], last
                if len(i):
                    yield out(np.where(nearest, NEAREST, OTHER), np.full(len(i), node[start]), k[own][i], k[own][j])
                if dense:
                    yield out([DENSE], node[start : start + 1], np.zeros(1, np.int64), np.zeros(1, np.int64))

    return rows.repartition("node", "block").sortWithinPartitions("node", "block", "home", "k").mapInArrow(trimmed(run), COMPARED)


def _blocks(members: DataFrame, large: DataFrame | None) -> DataFrame:
    """members in blocks: (node, block, home, k, s1, s2, parts). Rows of the nodes in `large` (node, parts) are dealt out by
    a hash of the id, and their leaders visit all blocks (home 0)."""
    names = ["node", "block", "home", "k", "s1", "s2", "parts"]
    if large is None:
        return members.withColumns({"block": F.lit(0), "home": F.lit(1), "parts": F.lit(1)}).select(*names)
    dealt = members.join(large, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumns({"block": F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"), "home": F.lit(1)})
    orders = [F.min(F.struct(F.xxhash64("k", F.lit(t)).alias("order"), "k", "s1", "s2")).alias(f"l{t}") for t in range(LEADERS)]
    leaders = members.join(large, "node").groupBy("node", "parts").agg(*orders)
    leaders = leaders.select("node", "parts", F.explode(F.array_distinct(F.array(*[F.struct(*[F.col(f"l{t}")[c].alias(c) for c in ("k", "s1", "s2")]) for t in range(LEADERS)]))).alias("l"))
    leaders = leaders.select("node", "parts", "l.*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block")).withColumn("home", F.lit(0))
    return dealt.select(*names).unionByName(leaders.select(*names))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of 0/1 matrices over the values that both
    sides have, some at a time."""
    own = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (left, right)]
    shared = np.intersect1d(np.unique(own[0]), np.unique(own[1]), assume_unique=True)
    out, step = np.zeros((len(left), len(right)), np.float32), 1024
    if not len(shared):
        return out
    for side in (0, 1):
        at = np.minimum(np.searchsorted(shared, own[side]), len(shared) - 1)
        there = shared[at] == own[side]
        order = np.argsort(at[there], kind="stable")
        own[side], rows[side] = at[there][order], rows[side][there][order]
    for start in range(0, len(shared), step):
        parts = []
        for side, sets_ in ((0, left), (1, right)):
            a, b = np.searchsorted(own[side], (start, start + step))
            part = np.zeros((len(sets_), min(step, len(shared) - start)), np.float32)
            part[rows[side][a:b], own[side][a:b] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _bridges(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between components, of dense nodes' rows (node, block, guest, outside, c, s1, s2, own): members outside
    the largest component, at home in the block or guests, against the block's own members, on full sets."""
    most, percent = most_different(threshold), round(threshold * 100)

    def found(left: list, right: list, linked: set) -> None:
        """left, right: lists of (c, sketch, set). Adds pairs of components to linked."""
        c, k = (np.array([r[0] for r in x], np.int64) for x in (left, right))
        near = _between(*(np.array([r[1] for r in x], np.uint64) for x in (left, right))) <= most
        near &= c[:, None] != k[None]
        one, two = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(one):
            return
        sizes = [np.array([len(x[i][2]) for i in at]) for x, at in ((left, one), (right, two))]
        common = overlaps([left[i][2] for i in one], [right[i][2] for i in two])
        good = near[np.ix_(one, two)] & (common > 0) & (100 * common >= percent * (sizes[0][:, None] + sizes[1][None] - common))
        i, j = np.nonzero(good)
        ends = np.stack([c[one[i]], k[two[j]]], axis=1)
        linked.update(map(tuple, np.unique(np.sort(ends, axis=1), axis=0).tolist()))

    def run(batches):
        key, home, guests, linked = None, [], [], set()

        def done():
            nonlocal home, guests, linked
            if guests and home:
                found(guests, home, linked)
            pairs = sorted(linked)
            home, guests, linked = [], [], set()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        def settled():
            """All own members are there: those outside against all."""
            outside = [r for r in home if r[3]]
            if outside:
                found(outside, home, linked)

        ready = False
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(8)]
            for node, block, guest, outside, c, s1, s2, own in zip(*columns):
                if (node, block) != key:
                    if key is not None:
                        if not ready:
                            settled()
                        yield done()
                    key, ready = (node, block), False
                row = (c, (s1 & _FULL, s2 & _FULL), np.frombuffer(own, np.uint64), outside)
                if not guest:
                    home.append(row)
                    continue
                if not ready:
                    settled()
                    ready = True
                guests.append(row)
                if len(guests) >= GUESTS:
                    if home:
                        found(guests, home, linked)
                    guests = []
        if key is not None:
            if not ready:
                settled()
            yield done()

    return rows.repartition("node", "block").sortWithinPartitions("node", "block", "guest", "c").mapInArrow(trimmed(run), "a long, b long").distinct()


_FULL = (1 << 64) - 1


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, threshold: float, name: str) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; stored in the shared folder.

    The ids needed are stored first, so that Spark knows their size: few of them are sent to the documents, many meet the
    documents in a join by id. Both lookups of texts read one exchange of the documents."""
    pairs = written(pairs.select("a", "b").distinct(), name)
    need = written(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct(), f"{name}-ids")
    texts = docs.select(_key().alias("k"), F.col("text").cast("string").alias("text")).join(need, "k", "left_semi")
    second = pairs.join(texts.select(F.col("k").alias("b"), F.col("text").alias("text_b")), "b")
    both = second.join(texts.select(F.col("k").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    percent = round(threshold * 100)

    def run(batches):
        codes, last, own = WordCodes(), None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = []
            for text_a, text_b in zip(byte_values(batch.column(2)), byte_values(batch.column(3))):
                if text_a != last:
                    last, own = text_a, shingles(text_a, width, codes)
                other = shingles(text_b, width, codes)
                common = len(np.intersect1d(own, other, assume_unique=True))
                good.append(common > 0 and 100 * common >= percent * (len(own) + len(other) - common))
            keep = np.array(good, bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[keep]), pa.array(np.array(b, np.int64)[keep])], names=["a", "b"])

    return written(both.mapInArrow(trimmed(run), "a long, b long"), f"{name}-links")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(k, own): the sorted shingle hashes of the documents whose keys are in ids (k), as bytes."""
    wanted = docs.select(_key().alias("k"), F.col("text").cast("string").alias("text")).join(ids, "k", "left_semi")

    def run(batches):
        codes = WordCodes()
        for batch in batches:
            own = [shingles(t, width, codes).tobytes() for t in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["k", "own"])

    return wanted.mapInArrow(trimmed(run), "k long, own binary")


def _dense_links(rows: DataFrame, docs: DataFrame, found: DataFrame, width: int, threshold: float, small: int) -> DataFrame | None:
    """Links between components found inside dense nodes, from their members' rows (node, k, n, s1, s2)."""
    named = rows.join(found.select(F.col("node").alias("k"), "component"), "k", "left")
    named = written(named.select("node", "k", "s1", "s2", F.coalesce("component", "k").alias("c"), "n"), "dense")
    parts = named.groupBy("node", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("values"))
    nodes = parts.groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("values").alias("values"), F.max(F.struct("rows", "c"))["c"].alias("top"), F.count("*").alias("components"))
    count = F.greatest(F.ceil(F.col("rows") / small), F.ceil(F.col("values") * 8 / HOME_BYTES)).cast("int")
    nodes = written(nodes.filter("components > 1").select("node", "top", count.alias("parts")), "dense-nodes")
    if nodes.isEmpty():
        return None
    mixed_rows = named.join(nodes, "node").withColumns({"block": F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"), "outside": F.col("c") != F.col("top")})
    names = ["node", "block", "guest", "outside", "c", "s1", "s2", "k"]
    home = mixed_rows.withColumn("guest", F.lit(False)).select(*names)
    visits = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda b: b != F.col("block"))).alias("block")
    guests = mixed_rows.filter("outside and parts > 1").select("node", visits, F.lit(True).alias("guest"), "outside", "c", "s1", "s2", "k")
    ids = mixed_rows.select("k").distinct()
    every = home.unionByName(guests).join(full_sets(docs, ids, width), "k")
    return written(_bridges(every.select(*names[:-1], "own"), threshold), "bridges")


def linked(docs: DataFrame, width: int = 5, threshold: float = 0.8, trees: int = TREES, small: int = SMALL, deepest: int = DEEPEST, sparse: int = SPARSE) -> DataFrame:
    """k (doc_id, the smallest long for null), n_shingles and component_id of every document."""
    small_batches(docs.sparkSession)
    every = written(sets(docs, width), "sets")
    firsts = every.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("k").alias("k"), F.first("tokens").alias("tokens"))
    firsts = written(firsts, "set-firsts")

    # 1. the trees, depth by depth
    members = written(_branched(firsts.select("k", "n", "tokens"), threshold, trees), "members")
    compared, dense = [], []
    for depth in range(1, deepest + 1):
        sizes = members.groupBy("node").agg(F.count("*").alias("rows")).filter(F.col("rows") > small)
        large = written(sizes.select("node", F.ceil(F.col("rows") / small).cast("int").alias("parts")), f"large-{depth}")
        branches = not large.isEmpty()
        pairs = written(_compared(_blocks(members, large if branches else None), threshold, sparse, depth == deepest), f"compared-{depth}")
        compared.append(pairs.filter(F.col("kind") != DENSE))
        marked = pairs.filter(F.col("kind") == DENSE).select("node")
        if not marked.isEmpty():
            dense.append(members.join(marked, "node", "left_semi"))
        if not branches or depth == deepest:
            break
        again = members.select("node", "k").join(large.select("node"), "node", "left_semi").join(firsts.select("k", "n", "tokens"), "k")
        members = written(_branched(again, threshold), f"members-{depth + 1}")
    pairs = compared[0]
    for part in compared[1:]:
        pairs = pairs.unionByName(part)

    # 2. components of the nearest pairs
    links = confirmed(pairs.filter(F.col("kind") == NEAREST), docs, width, threshold, "nearest")
    found = written(components(links), "components")

    # 3. the rest, across components
    name = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    across = lambda df: df.join(name("a"), "a", "left").join(name("b"), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")
    rest = written(across(pairs.filter(F.col("kind") == OTHER).select("a", "b").distinct()).select("a", "b"), "rest")
    bridges = []
    if not rest.isEmpty():
        bridges.append(across(confirmed(rest, docs, width, threshold, "rest")).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    if dense:
        crowd = dense[0]
        for part in dense[1:]:
            crowd = crowd.unionByName(part)
        more = _dense_links(crowd, docs, found, width, threshold, small)
        bridges += [more] if more is not None else []

    # 4. components of components
    if bridges:
        edges = bridges[0] if len(bridges) == 1 else bridges[0].unionByName(bridges[1])
        joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("larger"))
        heads = found.select("component").distinct()
        alone = joined.join(heads, "component", "left_anti").select(F.col("component").alias("node"), F.col("larger").alias("component"))
        found = found.join(joined, "component", "left").select("node", F.coalesce("larger", "component").alias("component")).unionByName(alone)
        found = written(found, "components-joined")
    named = firsts.select("d1", "d2", "n", "k").join(found.withColumnRenamed("node", "k"), "k", "left").select("d1", "d2", "n", F.coalesce("component", "k").alias("component"))
    joined = every.select("k", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    return joined.select("k", F.col("n").alias("n_shingles"), F.coalesce("component", "k").alias("component_id"))


def contract(docs: DataFrame) -> DataFrame:
    """The columns of op5: 2-word shingles, similarity 0.8."""
    rows = linked(docs, width=2)
    known = lambda c: F.when(F.col(c) != _NONE, F.col(c))
    return rows.select(known("k").alias("doc_id"), "n_shingles", known("component_id").alias("component_id"), (F.col("k") == F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without those whose component has a smaller id; same columns. Rows with one id stay or go together."""
    gone = written(linked(docs, width, threshold).filter(F.col("k") != F.col("component_id")).select("k").distinct(), "near-copies")
    return docs.join(gone, _key() == gone["k"], "left_anti")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.n + nb.n - p.c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, w.doc_id = c.m AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = w.doc_id
"""
