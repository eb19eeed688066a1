"""N-gram Jaccard join: count-vector R-trees over distributed blocks, exact verification, connected components.

A document is the set of its distinct word shingles (64-bit hashes of k words, A-Z lower-cased). Its tokens are hashed
into groups; the group counts are a point. The overlap of two sets is at most the sum of the coordinate-wise minima of
their points, and that bound also holds between a point and the upper corner of a bounding box, so an R-tree over points
gives, for each set, the ones that can reach the overlap that the threshold asks for.

One R-tree over a corpus would be one task, and in 16 and more dimensions random boxes overlap so much that nearly all
would be visited. So the points are dealt into blocks first, without loss: two sets that reach the threshold share one of
their first n - ceil(t * n) + 1 tokens in any fixed order of tokens. The order here is by hash, with tokens that occur in
many documents last, so that blocks stay small. Every block has a tree of its own; every pair of linked sets meets in at
least one block.

Within a token's block, sets without another of fitting size are dropped before points are fetched, and the sets
themselves are only gathered for pairs that pass the bound. A block does not list its pairs. First it emits stars over
pairs that pass the bound; those are verified on the sets themselves, and components of what is linked are formed. A
second pass looks at pairs that pass the bound and whose ends are in different components, as only those can still change
a component; it emits a spanning forest of them, so no more rows than a block has.

A token of more than PART sets is no block of its own. Its sets are dealt into bands of size, of which only neighbours can
hold linked sets, and into parts of PART sets by hash. The first pass stays within parts; then one set for each component
and window of bands stands for the others, so that the parts of a group of near copies meet through few rows; the second
pass looks at every pair of parts, but only where a window still holds several components.

Each tree of the forest is then solved exactly: its sets travel once, to a pivot P of the tree, and are kept as what they
lack of P and what they have besides, which is little for near copies; the overlap of A and B is |P| less what either
lacks, with what both have besides. Sets outside the tree's largest component are asked against all its sets by matrix
products over the differences that occur twice, in tiles of TILE tokens for large trees. Equal sets are one set throughout.

Shingles are compared by 63 bits of their hashes, and sets are told apart by 128 bits.

Defined cases: null, empty and blank texts have no shingles, are linked with nothing and are components of their own;
a text of fewer than k words has one shingle, its whole word sequence; texts of any length are whole sets; a null doc_id is not chosen as a component's id;
repeated rows are equal sets; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, Words, buffers, checkpoint, mix, release, slices, table
from .graph import components

#: Tokens are counted in one of so many distinct texts; those in HEAVY_LEAST of these, so in about PART of all, at any
#: number of documents, go to the end of the order. The most that are kept, the most frequent ones (8 bytes each,
#: broadcast). Any order of tokens, the same for all sets, loses nothing.
HEAVY_SAMPLE, HEAVY_LEAST, HEAVY_MOST = 16, 8, 1 << 20
#: Sets of a token that one task compares at once, parts that the second pass takes as one, and so many tokens (or windows
#: of them) whose list is broadcast.
PART, TAKEN, BROADCAST_TOKENS = 128, 4, 50_000
#: Rows of a block that are looked at before its largest tree is passed over.
FIRST = 8
#: Blocks up to this size compare all points at once; larger ones search their tree.
FLAT = 48
LEAF = 16
#: Roles of documents in stars whose list is broadcast to fetch their texts (about 100 bytes each); more are joined by shuffle.
BROADCAST_ROLES = 100_000
#: Rays of a star that are checked in one group, and the most groups of one; about so many tokens of sets on each side of a tile.
RAYS, GROUPS, TILE = 256, 512, 400_000
#: What a set counts in a tile besides its tokens: a tile of TILE / ROW sets on each side is a matrix of 4 million overlaps.
ROW = 200


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(texts)
    words = Words(LOWER[data], offsets)
    hashes = words.hashes()
    at, runs = words.windows(hashes, k)
    first = np.searchsorted(at, words.first) if len(at) else np.zeros(len(offsets), dtype=np.int64)
    out = []
    for i, n in enumerate(words.count):
        if n >= k:
            out.append(np.unique(runs[first[i] : first[i + 1]]))
        elif n:
            whole = np.uint64(n)
            for h in hashes[words.first[i] : words.first[i + 1]]:
                whole = mix(np.array([whole ^ h], dtype=np.uint64))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix(s: np.ndarray, heavy: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(num / den * n) + 1 tokens of a set: light ones by hash, then heavy ones by hash."""
    n = len(s)
    if not n:
        return s
    length = n + (-num * n // den) + 1
    if len(heavy):
        late = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
        s = np.concatenate([s[~late][:length], s[late]])
    return s[:length]


def text_key(text: Column) -> Column:
    """128 bits of a text, to tell rows with one doc_id (or none) apart; empty for null."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def needed(a, b, num: int, den: int):
    """The least overlap of linked sets of a and b tokens: the ceiling of num (a + b) / (num + den)."""
    return -(-num * (a + b) // (num + den))


def point(s: np.ndarray) -> np.ndarray:
    """Counts of a set's tokens in groups by their leading bits; 64 groups, or more for larger sets, up to 4,096."""
    bits = min(12, max(6, (len(s) // 16).bit_length()))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed(p: np.ndarray) -> bytes:
    """A point as bytes: the width of a count, then the counts."""
    width = 1 if p.max(initial=0) < 256 else 4
    return bytes([width]) + p.astype(f"u{width}").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, dtype=f"u{b[0]}", offset=1).astype(np.int64)


def fold(points: list[np.ndarray], groups: int) -> np.ndarray:
    """Points as rows of so many coordinates; finer ones are summed over neighbouring groups."""
    return np.stack([p.reshape(groups, -1).sum(axis=1) for p in points])


class CountTree:
    """An R-tree of points, packed by size and then by coordinates; nodes keep upper corners and least sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes
        order = np.arange(len(sizes))
        self.leaves = self._pack(order, 0)
        self.levels = []
        high = np.stack([points[x].max(axis=0) for x in self.leaves])
        low = np.array([sizes[x].min() for x in self.leaves])
        top = np.array([sizes[x].max() for x in self.leaves])
        self.levels.append((high, low, top))
        while len(high) > LEAF:
            cuts = range(0, len(high), LEAF)
            high = np.stack([high[i : i + LEAF].max(axis=0) for i in cuts])
            low, top = np.array([low[i : i + LEAF].min() for i in cuts]), np.array([top[i : i + LEAF].max() for i in cuts])
            self.levels.append((high, low, top))

    def _pack(self, rows: np.ndarray, depth: int) -> list[np.ndarray]:
        """Runs of LEAF rows at most: halved by the coordinate (or the size) that spreads most."""
        if len(rows) <= LEAF:
            return [rows]
        spread = self.points[rows].std(axis=0)
        by = self.sizes[rows] if self.sizes[rows].std() >= spread.max() else self.points[rows, spread.argmax()]
        rows = rows[np.argsort(by, kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        return self._pack(rows[:half], depth + 1) + self._pack(rows[half:], depth + 1)

    def reach(self, i: int, num: int, den: int) -> np.ndarray:
        """The rows, i among them, whose overlap bound with row i is enough."""
        q, n = self.points[i], self.sizes[i]
        nodes = np.arange(len(self.levels[-1][0]))
        for level in range(len(self.levels) - 1, -1, -1):
            high, low, top = (x[nodes] for x in self.levels[level])
            nodes = nodes[(np.minimum(high, q).sum(axis=1) >= needed(n, low, num, den)) & (top * den >= num * n) & (low * num <= n * den)]
            if level:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(self.levels[level - 1][0])]
        if not len(nodes):
            return nodes
        rows = np.concatenate([self.leaves[x] for x in nodes])
        return np.sort(rows[np.minimum(self.points[rows], q).sum(axis=1) >= needed(n, self.sizes[rows], num, den)])


class _Flat:
    """The same answers from all points at once, for small blocks."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        self.points, self.sizes = points, sizes

    def reach(self, i: int, num: int, den: int) -> np.ndarray:
        return np.flatnonzero(np.minimum(self.points, self.points[i]).sum(axis=1) >= needed(self.sizes[i], self.sizes, num, den))


class Levels:
    """A tree for each fineness of points in a block, so that large sets are not compared as coarsely as small ones.

    Two points are compared at the coarser one's number of groups: the tree of a level has that level's points, and finer
    ones folded.
    """

    def __init__(self, points: list[np.ndarray]) -> None:
        self.groups = np.array([len(p) for p in points])
        sizes = np.array([p.sum() for p in points])
        self.trees: dict[int, tuple[np.ndarray, CountTree | _Flat]] = {}
        for level in np.unique(self.groups).tolist():
            rows = np.flatnonzero(self.groups >= level)
            self.trees[level] = rows, (_Flat if len(rows) <= FLAT else CountTree)(fold([points[i] for i in rows], level), sizes[rows])

    def reach(self, i: int, num: int, den: int) -> np.ndarray:
        """The rows, i among them, whose overlap bound with row i is enough."""
        mine, out = self.groups[i], []
        for level, (rows, tree) in self.trees.items():
            # a set is at most den / num times as large as one linked with it, so its groups are not many times more
            if level <= mine and level * den * 2 >= mine * num:
                found = rows[tree.reach(int(np.searchsorted(rows, i)), num, den)]
                out.append(found if level == mine else found[self.groups[found] == level])
        return np.sort(np.concatenate(out))


def stars(points: list[np.ndarray], num: int, den: int) -> tuple[list[tuple[int, int]], bool]:
    """Stars over pairs that pass the bound, and whether other pairs pass too. Each row of such a pair is in a star."""
    tree, taken, out, rest = Levels(points), np.zeros(len(points), dtype=bool), [], False
    for i in range(len(points)):
        if taken[i]:
            continue
        taken[i] = True
        near = tree.reach(i, num, den)
        near, before = near[~taken[near]], near[taken[near] & (near != i)]
        rest |= len(before) > 0
        if len(before) and not len(near):
            out.append((int(before[0]), i))
        taken[near] = True
        out += [(i, int(j)) for j in near]
        rest |= len(near) > 1
    # rays of different stars, which no center looked at: here each star has one ray
    rest = rest or len(out) > 1 and any(len(tree.reach(j, num, den)) > 2 for _, j in out)
    return [(min(p), max(p)) for p in out], rest


class Forest:
    """Union-find over 0 .. n - 1."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether they were apart."""
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def across(points: list[np.ndarray], labels: list, num: int, den: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that pass the bound and whose labels differ."""
    kinds = np.unique(np.array(labels, dtype=object), return_inverse=True)[1]
    if kinds.max(initial=0) > 0:
        tree, forest, trees, largest = Levels(points), Forest(len(points)), len(points), None
        # one end at least of each pair does not have the label of most rows
        often = np.bincount(kinds)
        ask = np.flatnonzero(kinds != often.argmax()) if often.max() > len(kinds) // 2 else np.arange(len(kinds))
        for i in ask.tolist():
            if len(ask) == len(kinds) and i == FIRST:
                roots, sizes = np.unique([forest.find(x) for x in range(len(points))], return_counts=True)
                largest = int(roots[sizes.argmax()])
            # rows that are in one fixed tree of the forest by now need no look: what they could join will look at them
            if largest is not None and forest.find(i) == forest.find(largest):
                continue
            near = tree.reach(i, num, den)
            for j in near[kinds[near] != kinds[i]].tolist():
                if forest.join(i, j):
                    trees -= 1
                    yield min(i, j), max(i, j)
            if trees == 1:
                return


def overlaps(asked: list[np.ndarray], sets: list[np.ndarray], cells: int = 1 << 23) -> np.ndarray:
    """The overlap of each asked set with each set, by products of 0-1 matrices (of so many cells) over the tokens that occur twice."""
    columns = max(64, cells // max(1, len(asked) + len(sets)))
    sizes = np.array([len(s) for s in asked + sets])
    tokens, number, times = np.unique(np.concatenate(asked + sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    renumber = np.cumsum(times > 1) - 1
    keep = times[number] > 1
    row, column = row[keep], renumber[number[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(asked), len(sets)), dtype=np.float32)
    for a in range(0, int(renumber[-1]) + 1 if len(renumber) else 0, columns):
        lo, hi = np.searchsorted(column, [a, a + columns])
        part = np.zeros((len(sizes), min(columns, int(renumber[-1]) + 1 - a)), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        out += part[: len(asked)] @ part[len(asked) :].T
    return out.astype(np.int32)


def heavy_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """The sorted tokens that go to the end of the order, by a count in a sample of the texts of (text, key).

    What counts is how many sets meet in a token's block, not their share: a line in a thousandth of all documents makes
    a block whose pairs grow with the square of the table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for part in slices(batch, "text") for s in shingle_sets(part.column("text"), k)]
            if found:
                tokens, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(times)], ["token", "n"])

    some = docs.filter(F.pmod(F.xxhash64("key"), F.lit(HEAVY_SAMPLE)) == 0).groupBy("key").agg(F.first("text").alias("text"))
    counted = some.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counted = counted.filter(F.col("n") >= HEAVY_LEAST).orderBy(F.desc("n"), "token").limit(HEAVY_MOST).select("token").toArrow()
    return np.sort(counted.column("token").to_numpy().astype(np.int64).view(np.uint64))


def _signed(k: int, heavy, num: int, den: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = heavy.value
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"), k)
                first = [prefix(s, order, num, den) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(p) for p in first])]).astype(np.int32)
                tokens = np.concatenate(first).view(np.int64) if first else np.zeros(0, dtype=np.int64)
                ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())
                points = pa.array([packed(point(s)) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array([len(s) for s in sets], pa.int64()), ids, points, pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens))],
                    ["doc_id", "key", "n", "sid", "point", "tokens"],
                )

    return sign


def _cast(k: int):
    """For each document the stars that its set is in: a row with the set for each. A set's tokens go as 63 bits each."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for s, roles in zip(shingle_sets(part.column("text"), k), part.column("roles").to_pylist()):
                    own = set_id(s)
                    tokens = (s >> np.uint64(1)).astype("<u8").tobytes()
                    out += [(r["center"], r["salt"], r["ray"], own, r["label"], tokens) for r in roles if r["sid"] == own]
                    if sum(len(o[5]) for o in out[-64:]) > 1 << 22 or len(out) > 4096:
                        yield _cast_rows(out)
                        out = []
                if out:
                    yield _cast_rows(out)

    return cast


def _cast_rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["center", "salt", "ray", "sid", "label", "tokens"])


def _tokens(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<u8")


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["a", "b"])


def _checked(num: int, den: int):
    """Over partitions ordered so that a star's center comes before its rays: the rays that reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, middle = None, np.zeros(0, dtype=np.uint64)

        for batch in batches:
            links = []
            for center, salt, ray, sid, _, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if not ray:
                    star, middle = (center, salt), _tokens(raw)
                elif star == (center, salt):
                    other = _tokens(raw)
                    shared = len(np.intersect1d(middle, other, assume_unique=True))
                    if den * shared >= num * (len(middle) + len(other) - shared):
                        links.append((center, sid))
            yield _links(links)

    return check


#: Marks tokens that a set lacks of its pivot, so that they differ from all that it has.
LACKS = np.uint64(1 << 63)


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions ordered so that a tree's pivot comes first: each set's size and differences from the pivot."""
    tree, pivot = None, np.zeros(0, dtype=np.uint64)
    names, kinds = ["tree", "sid", "label", "pivot", "lacks", "tokens"], (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        out = []
        for center, salt, ray, sid, label, raw in zip(*(c.to_pylist() for c in batch.columns)):
            if not ray:
                tree, pivot = (center, salt), _tokens(raw)
            elif tree == (center, salt):
                own = _tokens(raw)
                lacks, more = np.setdiff1d(pivot, own, assume_unique=True), np.setdiff1d(own, pivot, assume_unique=True)
                out.append((center, sid, label, len(pivot), len(lacks), np.concatenate([more, lacks | LACKS]).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 6, kinds)], names)


def _solved(num: int, den: int):
    """Over partitions ordered by tile: links between different labels, no more than join labels of the tile.

    Rows: tree, salt, whether the set is asked, sid, label, size of the pivot, how many tokens the set lacks of it, and its
    differences.
    """

    def close(rows: list[tuple], out: list[tuple]) -> None:
        rows = list({(r[0], r[1]): r for r in rows}.values())
        mine = [i for i, r in enumerate(rows) if r[0]]
        if not mine or len({r[2] for r in rows}) < 2:
            return
        sets = [np.frombuffer(r[5], dtype=np.uint64) for r in rows]
        pivot, lacks = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        size = pivot - 2 * lacks + np.array([len(x) for x in sets])
        shared = pivot[None, :] - lacks[mine][:, None] - lacks[None, :] + overlaps([sets[i] for i in mine], sets)
        linked = den * shared >= num * (size[mine][:, None] + size[None, :] - shared)
        number = {x: i for i, x in enumerate({r[2]: None for r in rows})}
        label, forest = np.array([number[r[2]] for r in rows]), Forest(len(number))
        for i, row in zip(mine, linked):
            at = np.flatnonzero(row & (label != label[i]))
            for j in at[np.unique(label[at], return_index=True)[1]].tolist():
                if forest.join(int(label[i]), int(label[j])):
                    out.append((rows[i][1], rows[j][1]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != tile:
                    close(rows, out)
                    tile, rows = row[:2], []
                rows.append(row[2:])
        close(rows, out)
        yield _links(out)

    return solve


def _blocks(num: int, den: int, labelled: bool):
    """Over partitions ordered by (token, w, i, j), so that a block's rows follow each other."""

    def close(token: int, rows: list[tuple], out: list[tuple]) -> None:
        if len(rows) < 2:
            return
        points = [unpacked(r[1]) for r in rows]
        if labelled:
            out += [(rows[i][0], rows[j][0], None) for i, j in across(points, [r[2] for r in rows], num, den)]
            return
        pairs, rest = stars(points, num, den)
        out += [(rows[i][0], rows[j][0], None) for i, j in pairs]
        if rest:
            out.append((None, None, token))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, out = None, [], []

        def flush() -> pa.RecordBatch:
            pairs = list(dict.fromkeys(out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary()), pa.array([p[2] for p in pairs], pa.int64())], ["a", "b", "token"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                if row[:4] != block:
                    if block:
                        close(block[0], rows, out)
                    block, rows = row[:4], []
                    if len(out) >= 20_000:
                        yield flush()
                rows.append(row[4:])
        if block:
            close(block[0], rows, out)
        yield flush()

    return blocks


def _verified(pairs: DataFrame, docs: DataFrame, ids: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that reach the threshold. Sets are made again from the texts and travel once, to the middles of stars.

    A star of many rays is dealt over salts, each of which gets the middle. ids: sid, and doc_id (least) and text key of a document that has it.
    """
    salts = pairs.groupBy("a").agg(F.least(F.lit(GROUPS), F.ceil(F.count(F.lit(1)) / RAYS)).alias("salts"))
    rays = pairs.join(salts, "a").select(F.col("b").alias("sid"), F.col("a").alias("center"), F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"), F.lit(True).alias("ray"))
    middles = salts.select(F.col("a").alias("sid"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("ray"))
    sets = _fetched(rays.unionByName(middles).withColumn("label", F.lit(None).cast("binary")), docs, ids, k)
    return checkpoint(sets.mapInArrow(_checked(num, den), "a binary, b binary").distinct())


def _fetched(roles: DataFrame, docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """The sets of all roles (sid, center, salt, ray, label), together by center and salt, rows that are no rays first."""
    roles = roles.join(ids, "sid").groupBy("least", F.col("key").alias("least_key")).agg(F.collect_list(F.struct("sid", "center", "salt", "ray", "label")).alias("roles"))
    roles = checkpoint(roles)
    few = (roles.agg(F.sum(F.size("roles"))).first()[0] or 0) <= BROADCAST_ROLES
    both = docs.join(F.broadcast(roles) if few else roles, docs["doc_id"].eqNullSafe(roles["least"]) & (docs["key"] == roles["least_key"])).select("text", "roles")
    sets = both.mapInArrow(_cast(k), "center binary, salt long, ray boolean, sid binary, label binary, tokens binary")
    return sets.repartition("center", "salt").sortWithinPartitions("center", "salt", "ray")


def _joined(trees: DataFrame, docs: DataFrame, ids: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links between sets of one tree with different labels, enough to join all labels that any links join.

    trees: sid, tree (the sid of one of its sets, the pivot), label. A tree with more than TILE tokens of differences is
    dealt over tiles of asked sets by sets.
    """
    salts = trees.groupBy("tree").agg(F.least(F.lit(GROUPS), F.ceil(F.count(F.lit(1)) / RAYS)).alias("salts"))
    rays = trees.join(salts, "tree").select("sid", F.col("tree").alias("center"), F.pmod(F.xxhash64("sid"), F.col("salts")).alias("salt"), F.lit(True).alias("ray"), "label")
    pivots = salts.select(F.col("tree").alias("sid"), F.col("tree").alias("center"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("ray"), F.lit(None).cast("binary").alias("label"))
    sets = _fetched(rays.unionByName(pivots), docs, ids, k)
    rows = checkpoint(sets.mapInArrow(_differences, "tree binary, sid binary, label binary, pivot long, lacks long, tokens binary"))
    release(docs.sparkSession)
    rows = rows.withColumn("_t", F.octet_length("tokens") / 8 + ROW)
    labels = rows.groupBy("tree", "label").agg(F.sum("_t").alias("n")).groupBy("tree").agg(
        F.sum("n").alias("all"), F.max(F.struct("n", "label"))["label"].alias("largest"), F.max("n").alias("most")
    )
    rows = rows.join(labels, "tree").withColumn("asked", F.col("label") != F.col("largest")).withColumn("_h", F.xxhash64("sid"))
    rows = rows.withColumn("_x", F.ceil(F.col("all") / TILE)).withColumn("_y", F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / TILE)))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asked = rows.filter("asked").withColumn("_i", every("_x")).withColumn("salt", F.pmod("_h", F.col("_y")) * F.col("_x") + F.col("_i"))
    others = rows.withColumn("_i", every("_y")).withColumn("salt", F.col("_i") * F.col("_x") + F.pmod("_h", F.col("_x")))
    others = others.filter("_x > 1 OR NOT asked")  # one tile: asked sets are there already
    pick = lambda d, is_asked: d.select("tree", "salt", F.lit(is_asked).alias("asked"), "sid", "label", "pivot", "lacks", "tokens")
    tiles = pick(asked, True).unionByName(pick(others, False)).repartition("tree", "salt").sortWithinPartitions("tree", "salt")
    return checkpoint(tiles.mapInArrow(_solved(num, den), "a binary, b binary").distinct())


def clusters(df: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """For each row of (doc_id, text): n_shingles, and component_id, the least doc_id that links lead to."""
    return linked(df, k, num, den).select("doc_id", "n_shingles", "component_id")


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has so many rows at most."""
    return F.broadcast(df) if len(df.take(most + 1)) <= most else df


def _fitting(posted: DataFrame, big: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (token, n, sid, big) that have another of fitting size; those of big tokens, whose rows no one task holds, all stay."""
    posted = posted.join(_small(big.withColumn("big", F.lit(True)), BROADCAST_TOKENS), "token", "left")
    spread = F.when(F.col("big"), F.pmod(F.xxhash64("sid"), F.lit(1024))).otherwise(0)
    by_size = Window.partitionBy("token", "_spread").orderBy("n", "sid")
    posted = posted.withColumn("_spread", spread).withColumn("_less", F.lag("n").over(by_size)).withColumn("_more", F.lead("n").over(by_size))
    fits = (F.col("_less") * den >= F.col("n") * num) | (F.col("n") * den >= F.col("_more") * num)
    return posted.filter(F.coalesce(F.col("big"), fits, F.lit(False))).select("token", "n", "sid", F.col("big").isNotNull().alias("big"))


def _windows(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (token, w, parts, part, sid) of tokens with more: window w holds the sets of size bands w and w + 1.

    Linked sets are in one band or in neighbours; a window whose lower band is empty has only pairs that the next one has.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9) if num < den else F.col("n")
    rows = posted.withColumn("w", band)
    cells = rows.groupBy("token", "w").agg(F.count(F.lit(1)).alias("c"))
    # a token has few bands: their number goes with the logarithm of the largest set
    after = Window.partitionBy("token").orderBy("w")
    above = F.when(F.lead("w").over(after) == F.col("w") + 1, F.lead("c").over(after)).otherwise(0)
    cells = checkpoint(cells.withColumn("c", F.col("c") + above).filter("c > 1").select("token", "w", F.ceil(F.col("c") / PART).alias("parts")))
    rows = rows.withColumn("w", F.explode(F.array("w", F.col("w") - 1))).join(_small(cells, BROADCAST_TOKENS), ["token", "w"])
    return rows.select("token", "w", "parts", F.pmod(F.xxhash64("sid"), F.col("parts")).alias("part"), "sid")


def linked(df: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """clusters() with each row's text key and `component`, which is null for texts without shingles.

    A component is of texts, so rows that share a doc_id can be in several.
    """
    if not 0 < num <= den:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("key", text_key(F.col("text")))
    heavy = spark.sparkContext.broadcast(heavy_tokens(docs, k))

    signed = checkpoint(docs.mapInArrow(_signed(k, heavy, num, den), "doc_id long, key binary, n long, sid binary, point binary, tokens array<long>"))
    unique = signed.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"), F.first("point").alias("point"), F.first("tokens").alias("tokens"), F.first("n").alias("n"))
    unique = unique.select("sid", F.col("least.doc_id").alias("least"), F.col("least.key").alias("key"), "point", "tokens", "n")
    points = unique.select("sid", "point")
    posted = unique.select("sid", "n", F.explode("tokens").alias("token"))
    big = checkpoint(signed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PART).select("token"))
    release(spark)
    some, zero = bool(big.take(1)), F.lit(0).cast("long")
    fitting = checkpoint(_fitting(posted, big, num, den))
    first = blocks = fitting.filter("NOT big").select("token", F.lit(-2).cast("long").alias("w"), zero.alias("i"), zero.alias("j"), "sid")
    several = False
    if some:
        windows = checkpoint(_windows(fitting.filter("big").select("token", "n", "sid"), num, den))
        split = windows.filter("parts > 1")
        several = bool(split.take(1))
        first = blocks.unionByName(windows.select("token", "w", F.col("part").alias("i"), F.col("part").alias("j"), "sid"))

    del posted
    release(spark)

    keys = ("token", "w", "i", "j")
    near = lambda rows, labelled: (
        rows.repartition(*keys).sortWithinPartitions(*keys, "sid").mapInArrow(_blocks(num, den, labelled), "a binary, b binary, token long")
    )
    found = checkpoint(near(first.join(points, "sid").select(*keys, "sid", "point"), False).distinct())
    release(spark)
    tried = found.filter("token IS NULL").select("a", "b")

    ids = unique.select("sid", "least", "key")
    links = _verified(tried, docs, ids, k, num, den)
    release(spark)
    label = components(links, "a", "b")
    labelled = lambda rows: rows.join(label, F.col("sid") == F.col("node"), "left").withColumn("label", F.coalesce("component", "sid")).drop("node", "component")

    if several:
        # one set for each component of a window; where these are many, they are dealt into parts again
        stand = checkpoint(labelled(split).groupBy("token", "w", "label").agg(F.min("sid").alias("sid")))
        parts = stand.groupBy("token", "w").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token", "w", F.ceil(F.col("c") / PART).alias("parts"))
        part = F.pmod(F.xxhash64("sid"), F.col("parts"))
        stand = stand.join(_small(parts, BROADCAST_TOKENS), ["token", "w"]).select("token", "w", part.alias("i"), part.alias("j"), "sid")
        tried = near(stand.join(points, "sid").select(*keys, "sid", "point"), False).filter("token IS NULL").select("a", "b").distinct()
        links = checkpoint(links.unionByName(_verified(checkpoint(tried), docs, ids, k, num, den)).distinct())
        release(spark)
        label = components(links, "a", "b")

    open_tokens = found.filter("token IS NOT NULL").select("token").distinct()
    rows = blocks.join(open_tokens, "token", "left_semi").select(*keys, "sid")
    if some:
        one = windows.filter("parts = 1").join(open_tokens, "token", "left_semi").select("token", "w", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "sid")
        many, other = F.ceil(F.col("parts") / TAKEN), F.col("_q")
        pairs = split.withColumn("part", F.pmod(F.xxhash64("sid"), many)).withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)))
        pairs = pairs.select("token", "w", F.least("part", other).alias("i"), F.greatest("part", other).alias("j"), "sid")
        rows = labelled(rows.unionByName(one))
        mixed = labelled(split.select("token", "w", "sid")).groupBy("token", "w").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("token", "w")
        # parts are only paired in windows that hold several components
        rows = rows.unionByName(labelled(pairs.join(mixed, ["token", "w"], "left_semi")))
    else:
        rows = labelled(rows)
    ends = rows.groupBy(*keys).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(*keys)
    rows = rows.join(ends, list(keys), "left_semi")
    more = checkpoint(near(rows.join(points, "sid").select(*keys, "sid", "point", "label"), True).filter("a IS NOT NULL").select("a", "b").distinct())
    release(spark)
    if more.take(1):
        trees = components(more, "a", "b").select(F.col("node").alias("sid"), F.col("component").alias("tree"))
        trees = trees.join(label, F.col("sid") == F.col("node"), "left").select("sid", "tree", F.coalesce("component", "sid").alias("label"))
        more = _joined(checkpoint(trees), docs, ids, k, num, den)
        label = components(links.unionByName(more), "a", "b")
        release(spark)

    group = unique.select("sid", "least").join(label, F.col("sid") == F.col("node"), "left").select("sid", "least", F.coalesce("component", "sid").alias("group"))
    ids = group.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = group.join(ids, "group").select("sid", "group", "component_id")
    out = signed.select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("sid").alias("_sid")).join(ids, F.col("_sid") == F.col("sid"), "left")
    return out.select("doc_id", "key", "n_shingles", F.col("group").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "documents"), 3, 90, 100)


#: All pairs that share a shingle, and what is reachable by links: for small tables only.
SQL = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM texts
), sets AS (
  SELECT r, list_sort(s) AS s, len(s) AS n FROM shingles
), kinds AS (
  SELECT s, n, min(r) AS kind FROM sets WHERE n > 0 GROUP BY s, n
), tokens AS (
  SELECT kind, n, md5_number(unnest(s)) AS t FROM kinds
), links AS (
  SELECT a.kind AS x, b.kind AS y FROM tokens a JOIN tokens b ON a.t = b.t AND a.kind < b.kind AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.kind, b.kind, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), edges AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(x, y) AS (
  SELECT kind, kind FROM kinds
  UNION
  SELECT reach.x, e.y FROM reach JOIN edges e ON e.x = reach.y
), groups AS (
  SELECT x AS kind, min(y) AS g FROM reach GROUP BY x
), rows AS (
  SELECT c.r, c.doc_id, len(c.s)::BIGINT AS n_shingles, g.g FROM shingles c JOIN sets USING (r) LEFT JOIN kinds k ON k.s = sets.s LEFT JOIN groups g ON g.kind = k.kind
)
SELECT doc_id, n_shingles, CASE WHEN g IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS component_id FROM rows
"""
