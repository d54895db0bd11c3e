"""N-gram Jaccard join with a count-vector R-tree.

A text's set of distinct word shingles is also a point: tokens are hashed into
``GROUPS`` groups (more for very large sets), and a coordinate is the number of
shingles in a group. Two sets share at most the sum of coordinate minima, so an
R-tree over the points prunes every subtree whose box cannot reach the overlap
that the threshold asks for. Surviving rows are verified on the words themselves.

To let no tree grow with the corpus, trees are built over blocks: classes (equal
sets collapse) that share a shingle of their prefix. With one global order of
shingles, sets of Jaccard similarity t or more share one of their first
n - ceil(t n) + 1 shingles, so no link is lost. The order is by a count sketch of
fixed size over all documents, rare shingles first, then by hash. A row whose
position and size let no other row of its block reach the threshold is dropped.

What is passed on grows with the rows, never with their pairs:
 1. classes that share their smallest shingle are compared with a few of their
    group first, so that groups of near copies are mostly one component early;
 2. a block gives the clusters of its surviving pairs, a row for each member:
    pairs of classes known to be in one component or cluster are not tested;
 3. clusters that overlap are united over all blocks, and each is resolved on
    the texts: a forest of its links, each verified on words;
 4. components of all verified links are joined.

Groups beyond a bounded size (rows of a block, shingles of a cluster) are dealt
out in chunks: those of their largest component once, as its members are linked
already, the others against every chunk. So the work on a hot group grows with
its rows times the chunks of what is not in its largest component.

Defined results: null or wordless text has an empty set and no links; fewer than
five words make one shingle; very long texts count whole (they are one row, never
split); a null id is kept, with a null component and no links; rows that repeat
an id are one document; an empty table gives an empty result; extra columns of
any name are ignored by ``join`` and kept by ``stage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sliceframe.llm.common import LOWER_TABLE, as_row, durable, few
from sliceframe.llm.components import components

N, PERCENT = 5, 80
GROUPS, FULL = 512, 4096
SKETCH_BITS, SLICES = 22, 256
SALT_RANK, SALTS = 128, 64
PIVOTS, BLOCK, CHUNK, LEAF, FAN = 48, 4096, 1_000_000, 64, 8
FEATURES = "kind int, id long, cid long, n int, vec binary, k1 long"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER_TABLE).split()


def shingles(text: bytes | None, n: int = N):
    """Sorted 64-bit hashes of the distinct shingles."""
    import numpy as np
    import pandas as pd

    w = words_of(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    a = pd.util.hash_array(np.array(w, dtype=object), categorize=False)
    k = min(n, len(w))
    h = a[: len(a) - k + 1].copy()
    for j in range(1, k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + a[j : len(a) - k + 1 + j]
    h += np.uint64(k)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.unique(h ^ (h >> np.uint64(31)))


def need(n: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-PERCENT * n // 100)


def linked(a, b) -> bool:
    import numpy as np

    if min(len(a), len(b)) * 100 < PERCENT * max(len(a), len(b)) or not len(a):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def word_sets_linked(a: list[bytes], b: list[bytes], n: int = N) -> bool:
    """The exact test, on words."""
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set() for w in (a, b))
    both = len(x & y)
    return bool(x and y) and 100 * both >= PERCENT * (len(x) + len(y) - both)


def columns_of(batch):
    import pyarrow as pa

    return [c.cast(pa.binary()).to_pylist() if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist() for c in batch.columns]


def digest(s) -> int:
    """The class of a set."""
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def groups_of(n: int) -> int:
    """Coordinates of a point: a set of n falls into at least n / 8 groups, and adjacent sizes fold into each other."""
    return GROUPS << max(0, (max(n, 1) - 1) // FULL).bit_length()


def point(s) -> bytes:
    import numpy as np

    vec = np.bincount((s % np.uint64(groups_of(len(s)))).astype(np.int64), minlength=groups_of(len(s)))
    return vec.astype("u1" if vec.max() < 256 else "<u4").tobytes()


def unpack_point(vec: bytes, n: int, size: int):
    """The counts in ``size`` groups."""
    import numpy as np

    x = np.frombuffer(vec, dtype="u1" if len(vec) == groups_of(n) else "<u4")
    return x if len(x) == size else x.reshape(-1, size).sum(axis=0, dtype=np.uint32)


def features(batches):
    """Rows of kind 0 describe documents; those of kind 1 are the slices (id) of a count sketch of all shingles of a task."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    names = ["kind", "id", "cid", "n", "vec", "k1"]
    sketch = np.zeros(1 << SKETCH_BITS, dtype="<u4")
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            rows = []
            for i, t in zip(*columns_of(batch.slice(at, 1000))):
                s = shingles(t)
                if not len(s):
                    rows.append((0, i, 0, 0, None, None))
                    continue
                sketch[s >> np.uint64(64 - SKETCH_BITS)] += 1
                rows.append((0, i, digest(s), len(s), point(s), int(s[:1].view(np.int64)[0])))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(map(list, zip(*rows)), kinds)], names=names)
    z = zstandard.ZstdCompressor(level=1)
    parts = [(1, k, None, None, z.compress(part.tobytes()), None) for k, part in enumerate(np.split(sketch, SLICES)) if part.any()]
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(map(list, zip(*parts)), kinds)], names=names)


def sketch_ranks(batches):
    """Slices (id, vec) of the tasks' sketches to one slice each, of ranks: eight an octave of the summed counts."""
    import numpy as np
    import pyarrow as pa

    total: dict = {}
    for batch in batches:
        for k, vec in zip(*(c.to_pylist() for c in batch.columns)):
            x = np.frombuffer(unpacked(vec), dtype="<u4")
            total[k] = total[k] + x if k in total else x.astype(np.uint64)
    ranks = [np.minimum(255, 8 * np.log2(1.0 + v)).astype("u1").tobytes() for v in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int64()), pa.array(ranks, type=pa.binary())], names=["id", "vec"])


def packer(batches):
    """(key.., text) with the text normalised and compressed as the last column."""
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        text = columns_of(batch.select([batch.num_columns - 1]))[0]
        packed = pa.array([z.compress(b" ".join(words_of(t))) for t in text], type=pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], names=[*batch.schema.names[:-1], "blob"])


def unpacked(blob: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(blob)


def forest(rows, pivots: int | None = None) -> list[tuple[int, int]]:
    """Rows (chunk, comp, cid, blob) to verified links (a, b) that join all components with a link between them.

    Of several chunks only rows of different ones are compared. With ``pivots``, only so many rows are compared with all others.
    """
    import numpy as np

    chunks, comps, cids, blobs, sets, seen = [], [], [], [], [], set()
    for chunk, comp, cid, blob in rows:
        if cid in seen:
            continue
        s = shingles(unpacked(blob))
        # An id may stand on other texts too.
        if len(s) and digest(s) == cid:
            seen.add(cid)
            for column, value in ((chunks, chunk), (comps, comp), (cids, cid), (blobs, blob), (sets, s)):
                column.append(value)
    if len(set(comps)) < 2:
        return []
    label = np.unique(comps, return_inverse=True)[1]
    part, several = np.array(chunks), len(set(chunks)) > 1
    n = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    words, at = np.unique(np.concatenate(sets), return_inverse=True)
    mask = np.zeros(len(words), dtype=np.int32)
    out, used = [], 0
    for i in range(len(sets) - 1):
        other = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
        other = other[(100 * n[other] >= PERCENT * n[i]) & (100 * n[i] >= PERCENT * n[other])]
        if several:
            other = other[part[other] != part[i]]
        if not len(other):
            continue
        if len(other) < 4:
            both = np.array([np.intersect1d(sets[i], sets[j], assume_unique=True).size for j in other])
        else:
            mask[at[starts[i] : starts[i] + n[i]]] = 1
            first = other[0]
            both = np.add.reduceat(mask[at[starts[first] :]], starts[first:] - starts[first])[other - first]
            mask[at[starts[i] : starts[i] + n[i]]] = 0
        for j in other[100 * both >= PERCENT * (n[i] + n[other] - both)].tolist():
            if label[i] != label[j] and word_sets_linked(unpacked(blobs[i]).split(), unpacked(blobs[j]).split()):
                out.append((cids[i], cids[j]))
                label[label == label[j]] = label[i]
        used += 1
        if used == pivots:
            break
    return out


def forests(pivots: int | None = None):
    def emit(batches):
        """(g, ca, cb, chunk, comp, cid, blob) in order of g, ca, cb to the links of each group."""
        import pyarrow as pa

        def made(links):
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

        group, held = None, []
        for batch in batches:
            out = []
            for *of, chunk, comp, cid, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if of != group:
                    out += forest(held, pivots) if len(held) > 1 else []
                    group, held = of, []
                held.append((chunk, comp, cid, blob))
            yield made(out)
        yield made(forest(held, pivots) if len(held) > 1 else [])

    return emit


def prefixes(ranks):
    def emit(batches):
        """Texts to a row (key, salt, cid, at) for each shingle of the prefix, a class once a task; ``at`` holds size and position.

        Only shingles that the sketch takes for very frequent are salted.
        """
        import numpy as np
        import pyarrow as pa

        rank = np.frombuffer(ranks.value, dtype="u1")
        seen = set()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                keys, salts, sizes, cids, ns = [], [], [], [], []
                for t in columns_of(batch.slice(start, 1000))[0]:
                    s = shingles(t)
                    if not len(s) or (cid := digest(s)) in seen:
                        continue
                    seen.add(cid)
                    r = rank[s >> np.uint64(64 - SKETCH_BITS)]
                    first = np.argsort(r, kind="stable")[: len(s) - need(len(s)) + 1]
                    keys.append(s[first])
                    salts.append(np.where(r[first] >= SALT_RANK, cid % SALTS, -1).astype(np.int32))
                    sizes.append(len(first))
                    cids.append(cid)
                    ns.append(len(s))
                if keys:
                    at = np.repeat(np.array(ns, dtype=np.int64) << 32, sizes) | np.concatenate([np.arange(k) for k in sizes])
                    each = [np.concatenate(keys).view(np.int64), np.concatenate(salts), np.repeat(np.array(cids, dtype=np.int64), sizes), at]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in each], names=["key", "salt", "cid", "at"])

    return emit


def partnered(n, pos):
    """Rows of blocks (a matrix: blocks, rows) that may link with another row of theirs, by sizes and positions.

    The first shingle that two sets share leaves them at most min(n - pos, m - pos) in common.
    """
    import numpy as np

    most = np.minimum((n - pos)[:, :, None], (n - pos)[:, None, :])
    ok = most * (100 + PERCENT) >= PERCENT * (n[:, :, None] + n[:, None, :])
    i = np.arange(n.shape[1])
    ok[:, i, i] = False
    return ok.any(axis=2)


def shared_keys(batches):
    """(key, salt, cid, at) in order of key and salt to distinct (key, cid) that may have a partner; rows of salted keys all stay."""
    import numpy as np
    import pyarrow as pa

    def solve(key, salt, cid, at):
        order = np.lexsort((cid, salt, key))
        key, salt, cid, at = key[order], salt[order], cid[order], at[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (cid[1:] != cid[:-1])])
        key, salt, cid, at = key[new], salt[new], cid[new], at[new]
        edge = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        starts = np.flatnonzero(edge)
        size = np.diff(np.append(starts, len(key)))
        keep = salt >= 0
        n, pos = at >> 32, at & 0xFFFFFFFF
        for m in np.unique(size):
            first = starts[(size == m) & (salt[starts] < 0)]
            if m > BLOCK:
                for a in first:
                    keep[a : a + m] = True
            elif m > 1:
                step = max(1, (1 << 21) // int(m) ** 2)
                for k in range(0, len(first), step):
                    rows = first[k : k + step, None] + np.arange(m)
                    keep[rows] = partnered(n[rows], pos[rows])
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(cid[keep])], names=["key", "cid"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        cut = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        held = [x[cut:] for x in rows]
        if cut:
            yield solve(*(x[:cut] for x in rows))
    if held is not None:
        yield solve(*held)


class CountTree:
    """R-tree over count vectors (column 0: the size), bulk-loaded by halving the widest coordinate."""

    def __init__(self, points):
        import numpy as np

        order, stack, leaves = [], [np.arange(len(points))], []
        while stack:
            part = stack.pop()
            if len(part) <= LEAF:
                leaves.append((len(order), len(order) + len(part)))
                order.extend(part.tolist())
                continue
            p = points[part]
            # The size is a coordinate like others, and the widest as a rule.
            axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
            part = part[np.argsort(p[:, axis], kind="stable")]
            stack += [part[len(part) // 2 :], part[: len(part) // 2]]
        self.order, self.spans = np.array(order), np.array(leaves)
        self.points = points[self.order]
        low = np.array([self.points[a:b].min(axis=0) for a, b in leaves])
        high = np.array([self.points[a:b].max(axis=0) for a, b in leaves])
        # Levels from leaves to root; a node's children are FAN consecutive nodes below.
        self.levels = [(low, high)]
        while len(self.levels[-1][0]) > FAN:
            low, high = self.levels[-1]
            cuts = range(0, len(low), FAN)
            self.levels.append((np.array([low[i : i + FAN].min(axis=0) for i in cuts]), np.array([high[i : i + FAN].max(axis=0) for i in cuts])))

    def leaves_near(self, leaf: int):
        """Leaves from ``leaf`` on whose boxes may hold a partner of a point in its box."""
        import numpy as np

        low, high = (x[leaf : leaf + 1] for x in self.levels[0])
        nodes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            lows, highs = self.levels[k]
            nodes = nodes[possible(low, high, lows[nodes], highs[nodes])[0]]
            if k:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[k - 1][0])]
        return nodes[nodes >= leaf]

    def pairs(self, open_pairs=None):
        """Arrays (i, j) of points that may reach the threshold together, each pair once.

        ``open_pairs`` tells for two lists of points which pairs are still to be tested, as a matrix.
        """
        import numpy as np

        for leaf, (a, b) in enumerate(self.spans):
            for other in self.leaves_near(leaf):
                c, d = self.spans[other]
                test = np.ones((b - a, d - c), dtype=bool) if open_pairs is None else open_pairs(self.order[a:b], self.order[c:d])
                i, j = np.nonzero(np.triu(test, 1) if other == leaf else test)
                if len(i):
                    ok = bound(self.points[a + i], self.points[c + j])
                    yield self.order[a + i[ok]], self.order[c + j[ok]]


def bound(high, highs, low=None, lows=None):
    """Row by row: whether sets of these points (or boxes) may link, by sizes and summed coordinate minima."""
    import numpy as np

    out = np.zeros(len(high), dtype=bool)
    for at in range(0, len(high), 2048):
        p, q = high[at : at + 2048], highs[at : at + 2048]
        n, m = (x[at : at + 2048, 0].astype(np.int64) for x in ((high, highs) if low is None else (low, lows)))
        fits = np.flatnonzero((q[:, 0].astype(np.int64) * 100 >= PERCENT * n) & (m * PERCENT <= 100 * p[:, 0].astype(np.int64)))
        n, m = n[fits], m[fits]
        least = np.maximum(n, -(-PERCENT * m // 100)) + np.maximum(m, -(-PERCENT * n // 100))
        most = np.minimum(p[fits, 1:], q[fits, 1:]).sum(axis=1, dtype=np.int64)
        out[at + fits] = most * (100 + PERCENT) >= PERCENT * least
    return out


def possible(low, high, lows, highs):
    """The bound for each of one list of boxes and each of another, as a matrix."""
    import numpy as np

    i, j = (x.ravel() for x in np.indices((len(low), len(lows))))
    return bound(high[i], highs[j], low[i], lows[j]).reshape(len(low), len(lows))


def clusters(points, comp, chunk, large):
    """Labels of a block's rows: rows of one component, and what candidate pairs join, share one.

    points: sizes and counts; chunk: of each row, only rows of different ones are tested if there are several;
    large: finer points of large sets, by row.
    """
    import numpy as np

    names, own = np.unique(comp, return_inverse=True)
    label = np.arange(len(names))
    several = chunk.min() != chunk.max()

    def open_pairs(i, j):
        test = label[own[i]][:, None] != label[own[j]][None, :]
        return test & (chunk[i][:, None] != chunk[j][None, :]) if several else test

    def join(i, j):
        for x, y in zip(i.tolist(), j.tolist()):
            p, q = label[own[x]], label[own[y]]
            if p != q and not (x in large and y in large and apart(large[x], large[y])):
                label[label == q] = p

    if len(points) > LEAF:
        for i, j in CountTree(points).pairs(open_pairs):
            join(i, j)
    else:
        every = np.arange(len(points))
        i, j = np.nonzero(np.triu(open_pairs(every, every), 1))
        ok = bound(points[i], points[j])
        join(i[ok], j[ok])
    return label[own], names


def apart(a, b) -> bool:
    """Whether the finer counts of two large sets (size, counts) rule a link out."""
    import numpy as np

    (n, x), (m, y) = a, b
    size = min(len(x), len(y))
    most = int(np.minimum(*(v.reshape(-1, size).sum(axis=0, dtype=np.int64) for v in (x, y))).sum())
    return most * (100 + PERCENT) < PERCENT * (n + m)


def block_clusters(batches):
    """Blocks (key, ca, cb, chunk, comp, cid, n, vec) in order to their clusters of candidates: (cid, comp, root), linear in the rows."""
    import numpy as np
    import pyarrow as pa

    done: set = set()
    held = None

    def arrays(batch):
        vec, n = batch.column(7).to_pylist(), batch.column(6).to_pylist()
        if all(len(v) == GROUPS for v in vec):
            flat = np.frombuffer(b"".join(vec), dtype="u1").reshape(-1, GROUPS)
        else:
            flat = np.stack([unpack_point(v, m, GROUPS).astype(np.uint32) for v, m in zip(vec, n)])
        raw = [(m, unpack_point(v, m, groups_of(m))) if m > FULL else None for v, m in zip(vec, n)]
        return np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(7)], axis=1), flat, raw

    def solve(ints, flat, raw):
        edge = np.flatnonzero((ints[1:, :3] != ints[:-1, :3]).any(axis=1)) + 1
        starts, ends = np.array([0, *edge]), np.array([*edge, len(ints)])
        # The narrowest type that holds sizes and counts.
        kind = np.uint16 if ints[:, 6].max() < 1 << 16 else np.uint32
        points = np.concatenate([ints[:, 6:7].astype(kind), flat.astype(kind, copy=False)], axis=1)
        out = []
        # Most blocks are pairs of rows: tested together.
        two = starts[ends - starts == 2]
        two = two[ints[two, 4] != ints[two + 1, 4]]
        two = two[bound(points[two], points[two + 1])]
        blocks = [(a, a + 2) for a in two.tolist()]
        blocks += [(a, b) for a, b in zip(starts.tolist(), ends.tolist()) if b - a > 2 and (ints[a:b, 4] != ints[a, 4]).any()]
        for a, b in blocks:
            large = {k: raw[a + k] for k in range(b - a) if raw[a + k]}
            label, names = clusters(points[a:b], ints[a:b, 4], ints[a:b, 3], large)
            order = np.argsort(label, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                root = int(ints[a + rows, 4].min())
                if (ints[a + rows, 4] != root).any():
                    out += [(cid, comp, root) for cid, comp in zip(ints[a + rows, 5].tolist(), ints[a + rows, 4].tolist())]
        new = [x for x in dict.fromkeys(out) if x not in done]
        if len(done) > 300_000:
            done.clear()
        done.update(new)
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in new], type=pa.int64()) for i in range(3)], names=["cid", "comp", "root"])

    for batch in batches:
        if not batch.num_rows:
            continue
        ints, flat, raw = arrays(batch)
        if held is not None:
            ints, flat, raw = np.concatenate([held[0], ints]), np.concatenate([held[1], flat]), held[2] + raw
        # The last block may go on in the next batch.
        cut = np.flatnonzero((ints[:, :3] != ints[-1, :3]).any(axis=1))
        cut = int(cut[-1]) + 1 if len(cut) else 0
        held = ints[cut:], flat[cut:], raw[cut:]
        if cut:
            yield solve(ints[:cut], flat[:cut], raw[:cut])
    if held is not None:
        yield solve(*held)


def dealt(rows: DataFrame, by: str, weight, limit: int, broadcast_rows: int) -> DataFrame:
    """Rows (by, comp, cid, ..) of groups with several components, dealt to (by, ca, cb) by chunk.

    A group beyond ``limit`` falls into chunks. Rows of its largest component meet only the chunks of the others, all others meet every chunk.
    """
    weight = weight.cast("long")
    size = rows.groupBy(by).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum(weight).alias("w")).where("lo != hi").select(by, "w")
    size = durable(size)
    rows = rows.join(few(size, broadcast_rows), by)
    if size.where(F.col("w") > limit).isEmpty():
        return rows.withColumns({c: F.lit(0) for c in ("ca", "cb", "chunk")}).drop("w")
    per = rows.where(F.col("w") > limit).groupBy(by, "comp").agg(F.sum(weight).alias("own"))
    top = durable(per.groupBy(by).agg(F.max(F.struct("own", "comp")).alias("top")))
    rows = rows.join(few(top, broadcast_rows), by, "left")
    major, minor = (F.ceil(x / limit).cast("int") for x in (F.col("top.own"), F.col("w") - F.col("top.own")))
    h, zero = F.xxhash64("cid", F.lit(7)), F.lit(0)
    in_top, whole = F.col("comp") == F.col("top.comp"), F.col("top").isNull()
    chunk = F.when(whole, 0).when(in_top, minor + F.pmod(h, major)).otherwise(F.pmod(h, minor)).cast("int")
    others = F.when(whole, F.array(zero)).otherwise(F.sequence(zero, F.when(in_top, minor - 1).otherwise(major + minor - 1)))
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(others))
    return rows.withColumn("ca", F.least("chunk", "other")).withColumn("cb", F.greatest("chunk", "other")).drop("other", "w", "top")


def resolved(docs: DataFrame, rows: DataFrame, broadcast_rows: int, pivots: int | None = None) -> DataFrame:
    """Links of the groups of rows (id, g, ca, cb, chunk, comp, cid), on the texts."""
    wanted = durable(rows.select("id", "g", "ca", "cb", "chunk", "comp", "cid"))
    texts = docs.join(few(wanted, broadcast_rows), "id").select("g", "ca", "cb", "chunk", "comp", "cid", "text")
    packed = texts.mapInArrow(packer, "g long, ca int, cb int, chunk int, comp long, cid long, blob binary")
    groups = packed.repartition(F.col("g"), F.col("ca"), F.col("cb")).sortWithinPartitions("g", "ca", "cb", "cid")
    return durable(groups.mapInArrow(forests(pivots), "a long, b long"))


def join(docs: DataFrame, *, key: str = "doc_id", text: str = "text", broadcast_rows: int = 400_000) -> DataFrame:
    """(id, n_shingles, component) of every document."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    base = durable(docs.mapInArrow(features, FEATURES))
    each = base.where("kind = 0").drop("kind")
    usable = each.where("n > 0 and id is not null")
    classes = durable(usable.groupBy("cid").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("n", "vec", "k1")]))

    # Copies under one id but of several texts are one document.
    same = usable.groupBy("id").agg(F.min("cid").alias("b"), F.max("cid").alias("c")).where("b != c").select("id")
    same = usable.join(same, "id").select("cid", "id").distinct()
    same = same.join(same.groupBy("id").agg(F.min("cid").alias("b")), "id").select(F.col("cid").alias("a"), "b")

    size = classes.groupBy(F.col("k1").alias("g")).agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1").select("g", "w")
    salt = F.pmod(F.xxhash64("cid"), F.ceil(F.col("w") / CHUNK)).cast("int")
    star = classes.select("id", F.col("k1").alias("g"), "cid").join(few(durable(size), broadcast_rows), "g").withColumn("salt", salt)
    star = star.select("id", "g", F.col("salt").alias("ca"), F.col("salt").alias("cb"), F.col("salt").alias("chunk"), F.col("cid").alias("comp"), "cid")
    roots = components(resolved(docs, star, broadcast_rows, PIVOTS).unionAll(same))
    roots = few(roots.select(F.col("node").alias("cid"), "root"), broadcast_rows)

    slices = base.where("kind = 1").select("id", "vec").repartition("id").mapInArrow(sketch_ranks, "id long, vec binary")
    # SLICES rows of fixed size, however many documents there are.
    ranks = {r[0]: bytes(r[1]) for r in slices.collect()}
    empty = bytes((1 << SKETCH_BITS) // SLICES)
    ranks = spark.sparkContext.broadcast(b"".join(ranks.get(k, empty) for k in range(SLICES)))
    prefix = docs.where("id is not null").select("text").mapInArrow(prefixes(ranks), "key long, salt int, cid long, at long")
    # A key that isn't salted is, by the sketch, in a bounded number of documents.
    by_key = prefix.repartition(F.col("key"), F.col("salt")).sortWithinPartitions("key", "salt")
    rows = by_key.mapInArrow(shared_keys, "key long, cid long")
    rows = durable(rows.join(roots, "cid", "left").select("key", F.coalesce("root", "cid").alias("comp"), "cid"))
    blocks = dealt(rows, "key", F.lit(1), BLOCK, broadcast_rows).join(classes.select("cid", "n", "vec"), "cid")
    blocks = blocks.select("key", "ca", "cb", "chunk", "comp", "cid", "n", "vec").repartition(F.col("key"), F.col("ca"), F.col("cb"))
    found = durable(blocks.sortWithinPartitions("key", "ca", "cb").mapInArrow(block_clusters, "cid long, comp long, root long").distinct())

    united = components(found.select(F.col("comp").alias("a"), F.col("root").alias("b")).where("a != b").distinct())
    united = few(united.select(F.col("node").alias("comp"), F.col("root").alias("g")), broadcast_rows)
    members = found.select("cid", "comp").distinct().join(united, "comp", "left").withColumn("g", F.coalesce("g", "comp"))
    members = durable(members.join(classes.select("cid", "id", "n"), "cid"))
    verified = resolved(docs, dealt(members, "g", F.col("n"), CHUNK, broadcast_rows), broadcast_rows)
    final = components(roots.select(F.col("cid").alias("a"), F.col("root").alias("b")).unionAll(verified))

    named = classes.select("cid", "id").join(final, F.col("cid") == F.col("node"), "left").select("cid", "id", F.coalesce("root", "cid").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component"))
    of = named.join(smallest, "root").select("cid", "component")
    out = each.select("id", "n", "cid").join(of, "cid", "left")
    return out.select("id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def stage(spark, docs: DataFrame, broadcast_rows: int = 400_000) -> DataFrame:
    """One document of each component: the one with the smallest id, once; rows without an id stay."""
    found = durable(join(docs, broadcast_rows=broadcast_rows))
    gone = durable(found.where("component != id").select("id").distinct())
    twice = durable(found.where("id is not null").groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id"))
    every = docs.select(F.col("doc_id").cast("long").alias("id"), as_row(docs).alias("row"))
    kept = every.join(few(gone, broadcast_rows), "id", "left_anti")
    if not twice.isEmpty():
        # Ids that occur on several rows: one of those rows, in an order that reruns repeat.
        once = kept.join(few(twice, broadcast_rows), "id").groupBy("id").agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = kept.join(few(twice, broadcast_rows), "id", "left_anti").select("id", "row").unionAll(once)
    return kept.select("row.*")


#: Transitive closure over all pairs that share a shingle: for small tables.
ORACLE = r"""
WITH RECURSIVE low AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM low WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 80 * (x.n + y.n - m)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM low UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT low.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM low LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


def query(docs: DataFrame) -> DataFrame:
    return join(docs).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))
