"""SimHash fingerprints and a near-duplicate self-join over their binary trie."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, grouped_rows, small_parts, stash, utf8, whole_groups
from .components import connected_components, forest
from .tokens import chain, mix, token_hashes

#: Bits that lane k of a byte adds, for each byte value, most significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Node pairs that are opened at a time; a task's memory is a few dozen bytes for each child of these.
OPENED = 1 << 17
#: Rows of nodes that a task walks together, rows of one block of a node, and pairs of wide codes compared at a time.
PORTION, MOST, COMPARED = 1 << 16, 1 << 17, 1 << 18
#: Sets, and shingles, of a part of a large group of candidates; sets that all parts of a group are compared with.
PART_ROWS, PART_SHINGLES, PIVOTS = 1024, 1 << 20, 8


def majority(h: np.ndarray) -> bytes:
    """Big-endian words whose bits are 1 where they are set in over half of the rows of h (rows of 64-bit words)."""
    if not len(h):
        return b""
    rows = np.ascontiguousarray(h.reshape(len(h), -1).astype(">u8")).view(np.uint8)
    lanes = rows.shape[1]
    counts = np.zeros((lanes, 256), np.int64)
    for at in range(0, len(rows), 65536):
        block = rows[at : at + 65536].astype(np.int64) + np.arange(lanes) * 256
        counts += np.bincount(block.ravel(), minlength=lanes * 256).reshape(lanes, 256)
    return np.packbits(2 * (counts @ _BITS) > len(rows), axis=1).tobytes()


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the text's word shingles under XXH64: A-Z lower-cased, words split at ASCII white space and
    joined by one space; fewer words than a shingle: the whole sequence; none: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line, end = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate(([0], end[:-1] + 1))
    of = xxhash.xxh64_intdigest
    h = [of(line[a:b], seed) for a, b in zip(start[: len(words) - shingle + 1].tolist(), end[shingle - 1 :].tolist(), strict=True)]
    return int.from_bytes(majority(np.array(h, np.uint64)), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a signed long."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            fp = np.array([fingerprint(t, shingle) for t in utf8(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(of, "doc_id long, fp long")


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of letter-and-digit tokens."""
    return np.unique(chain(token_hashes(text), shingle))


def wide_fingerprint(own: np.ndarray, words: int) -> bytes:
    """`words` independent 64-bit SimHashes of a shingle set, end to end."""
    salts = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return majority(mix(own[:, None] ^ salts)) if len(own) else bytes(8 * words)


def set_key(own: np.ndarray) -> int:
    """A shingle set's 64-bit digest, as a signed long."""
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "big", signed=True)


class Trie:
    """A sorted array of codes, distinct within their group, seen as a binary trie below each group: the nodes of chosen
    depths are ranges of it. The codes of a group share their first bits, down to the first depth."""

    def __init__(self, codes: np.ndarray, bits: int, depths: list[int], group: np.ndarray | None) -> None:
        self.prefix, self.child = [], []
        starts = []
        for d in depths:
            p = codes >> np.uint64(bits - d) if d else np.zeros(len(codes), np.uint64)
            new = p[1:] != p[:-1] if group is None else (p[1:] != p[:-1]) | (group[1:] != group[:-1])
            first = np.flatnonzero(np.concatenate(([True], new)))
            starts.append(np.append(first, len(codes)))
            self.prefix.append(p[first])
        for upper, lower in zip(starts, starts[1:], strict=False):
            self.child.append(np.searchsorted(lower, upper))


def ring_limits(bits: int, budget: int, depths: list[int]) -> list[int]:
    """Differing bits allowed down to each depth. Of budget + 1 blocks round a ring that differ in at most budget bits
    together, some block begins a round in which the first k blocks differ in at most k - 1 bits, for every k (cycle
    lemma): a pair is met in the rotation that begins there, so all rotations may prune by this."""
    ends = [k * bits // (budget + 1) for k in range(1, budget + 2)]
    return [next(k for k, end in enumerate(ends) if end >= d) for d in depths]


def trie_join(a: np.ndarray, b: np.ndarray, bits: int, budget: int, top: int, group: np.ndarray | None = None, ring: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the codes of sorted distinct a and b that differ in at most budget of their bits; of a with
    itself (the same array), each pair once. The codes of either share their first `top` bits. Pairs of nodes are
    walked together from there: a pair's differing bits add up on the way and a pair beyond the budget is dropped
    with all below it. The walk goes depth first in bounded portions. With group (sorted, for a with itself), codes are
    distinct and share their first bits within their group only, and only codes of one group meet. With ring, the budget
    grows with the depth (ring_limits): pairs within it are met in one rotation of the codes at least."""
    if not len(a) or not len(b):
        return
    largest = max(len(a), len(b)) if group is None else int(np.unique(group, return_counts=True)[1].max())
    depths = [top, *range(top + 1, min(bits, top + 2 + int(math.log2(largest))) + 1)]
    depths = depths if depths[-1] == bits else [*depths, bits]
    allowed = ring_limits(bits, budget, depths) if ring else [budget] * len(depths)
    same = a is b
    ta = Trie(a, bits, depths, group)
    tb = ta if same else Trie(b, bits, depths, None)
    roots = np.arange(len(ta.prefix[0]))
    spent = np.bitwise_count(ta.prefix[0] ^ tb.prefix[0]).astype(np.int64)
    within = spent <= allowed[0]
    stack = [(0, roots[within], roots[within], spent[within])]
    while stack:
        level, i, j, e = stack.pop()
        if len(i) > OPENED:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half], e[:half]), (level, i[half:], j[half:], e[half:])]
            continue
        if level == len(depths) - 1:
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        lo_a, lo_b = ta.child[level][i], tb.child[level][j]
        n_b = tb.child[level][j + 1] - lo_b
        n = (ta.child[level][i + 1] - lo_a) * n_b
        if (most := int(n.sum())) > 8 * OPENED and len(i) > 1:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half], e[:half]), (level, i[half:], j[half:], e[half:])]
            continue
        of = np.repeat(np.arange(len(i)), n)
        step = np.arange(most) - np.repeat(np.cumsum(n) - n, n)
        ci, cj = lo_a[of] + step // n_b[of], lo_b[of] + step % n_b[of]
        mask = np.uint64((1 << (depths[level + 1] - depths[level])) - 1)
        spent = e[of] + np.bitwise_count((ta.prefix[level + 1][ci] ^ tb.prefix[level + 1][cj]) & mask)
        keep = spent <= allowed[level + 1]
        if same:
            keep &= ci <= cj
        stack.append((level + 1, ci[keep], cj[keep], spent[keep]))


def near_links(codes: DataFrame, budget: int = 3, bits: int = 64, similar: int | None = None, most: int = MOST, tables: int = 1) -> DataFrame:
    """Links (a, b) among coded rows that join exactly what the pairs within `budget` differing bits join.

    codes has key (long) and code (long, the low `bits` bits count); with `similar`, also wide (binary, whole 64-bit
    words), and a pair must differ in at most `similar` bits of it as well. With tables over 1, codes also has table (0
    to tables - 1), and only codes of one table meet.

    Two codes within the budget agree in one of budget + 1 blocks of their bits. So a code stands in as many tries,
    each rotated so that another block comes first, and meets what is under its node of that block only: it travels
    in budget + 1 copies, however many codes there are. The walks start below the block and prune by what may have been
    spent of the budget by then (ring_limits). A task walks all its nodes together. A node of over `most` rows is dealt into parts, and each
    pair of parts is a block of its own. What leaves a task is a spanning forest of its links, never all pairs.
    Rows whose code is null link with nothing; rows of one code link (with `similar`, if they are similar).
    """
    wide = ["wide"] if similar is not None else []
    turns = budget + 1
    depth = bits // turns
    if not depth:
        raise ValueError("a code needs more bits than the budget")
    held = codes.where(F.col("code").isNotNull())
    own = F.col("code").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))

    def rotated(by: int) -> Column:
        both = F.shiftleft(own, by).bitwiseOR(F.shiftrightunsigned(own, bits - by)) if by else own
        return both.bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else both

    turned = F.posexplode(F.array(*[rotated(t * bits // turns) for t in range(turns)])).alias("turn", "code")
    rows = held.select("key", *wide, *["table"] * (tables > 1), turned)
    trie = F.col("table") * turns + F.col("turn") if tables > 1 else F.col("turn")
    node = F.shiftleft(trie.cast("long"), depth) + F.shiftrightunsigned("code", bits - depth)
    rows = rows.select(node.alias("node"), "code", "key", *wide)
    # A node has no more rows than a table, so small inputs need no count of each node.
    large = stash(rows.groupBy("node").count().where(F.col("count") > most).select("node", F.ceil(F.col("count") / most).cast("int").alias("parts")), "large") if held.count() > most * tables else None
    if large is None or large.isEmpty():
        rows = rows.select("node", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("part"), "code", "key", *wide)
    else:
        rows = rows.join(large, "node", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("node", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "code", "key", *wide)

    def side(node: np.ndarray, rows: pa.Table) -> Side:
        code, key = rows.column("code").to_numpy().view(np.uint64), rows.column("key").to_numpy()
        order = np.lexsort((key, code, node))
        w = np.frombuffer(b"".join(rows.column("wide").to_pylist()), np.uint64).reshape(len(node), -1)[order] if wide and len(node) else None
        node, code, key = node[order], code[order], key[order]
        first = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (code[1:] != code[:-1])))[: len(node)])
        return Side(node[first], code[first], np.append(first, len(node)), key, w)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_groups(batches, ["node", "x", "y"], PORTION):
            node, x, y, part = (held.column(c).to_numpy() for c in ("node", "x", "y", "part"))
            within = x == y
            # Parts of one node are apart: a node's number and its part's make the group.
            group = np.unique(np.stack((node, x), axis=1), axis=0, return_inverse=True)[1].ravel() if x.any() else node
            alone = held if within.all() else held.filter(pa.array(within))
            own = side(group[within], alone)
            pairs = [(own, own)]
            if not within.all():
                edge = np.flatnonzero((node[1:] != node[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
                for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(node)], strict=True):
                    if x[lo] != y[lo]:
                        block, of = held.slice(lo, hi - lo), part[lo:hi]
                        pairs.append(tuple(side(np.zeros(int((of == p).sum()), np.int64), block.filter(pa.array(of == p))) for p in (x[lo], y[lo])))
            for left, right in pairs:
                if len(left.key) and len(right.key):
                    a, b = _links(left, right, bits, budget, depth, similar)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition("node", "x", "y").sortWithinPartitions("node", "x", "y").mapInArrow(walk, "a long, b long")


@dataclass
class Side:
    """Rows sorted by group and code: the groups and codes that differ, where each begins (and the end), and by row the
    key and the wide code."""

    group: np.ndarray
    code: np.ndarray
    bounds: np.ndarray
    key: np.ndarray
    wide: np.ndarray | None


def _links(left: Side, right: Side, bits: int, budget: int, top: int, similar: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The forest of what the groups of one side link within themselves (left is right), or one node's parts across,
    as keys."""
    same = left is right
    shift = 0 if same else len(left.key)
    keys = left.key if same else np.concatenate((left.key, right.key))
    got_i: list[np.ndarray] = []
    got_j: list[np.ndarray] = []
    held = 0

    def put(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal held, got_i, got_j
        got_i.append(i)
        got_j.append(j)
        held += len(i)
        if held > 1 << 20:
            i, j = forest(np.concatenate(got_i), np.concatenate(got_j))
            got_i, got_j, held = [i], [j], len(i)

    if same:  # rows of one code
        if similar is None:
            later = np.ones(len(keys), bool)
            later[left.bounds[:-1]] = False
            put(np.flatnonzero(later) - 1, np.flatnonzero(later))
        else:
            _rows_of_a_code(left.bounds, left.wide, similar, put)
    for i, j in trie_join(left.code, left.code if same else right.code, bits, budget, top, left.group if same else None, True):
        if similar is None:
            put(left.bounds[i], right.bounds[j] + shift)
            continue
        # All rows of the one code with all of the other, so many at a time.
        n_b = right.bounds[j + 1] - right.bounds[j]
        n = (left.bounds[i + 1] - left.bounds[i]) * n_b
        ends = np.cumsum(n)
        for at in range(0, int(ends[-1]), COMPARED):
            flat = np.arange(at, min(at + COMPARED, int(ends[-1])))
            of = np.searchsorted(ends, flat, "right")
            step = flat - (ends[of] - n[of])
            x, y = left.bounds[i[of]] + step // n_b[of], right.bounds[j[of]] + step % n_b[of]
            near = np.bitwise_count(left.wide[x] ^ right.wide[y]).sum(axis=1) <= similar
            put(x[near], y[near] + shift)
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = forest(np.concatenate(got_i), np.concatenate(got_j))
    # Each part hangs on its least key, so that other tries that join the same rows give the same links.
    part, at = np.unique(j, return_inverse=True)
    least = keys[part].copy()
    np.minimum.at(least, at, keys[i])
    nodes, ends = np.concatenate((keys[i], keys[part])), np.concatenate((least[at], least))
    return nodes[nodes != ends], ends[nodes != ends]


def _rows_of_a_code(bounds: np.ndarray, wide: np.ndarray, similar: int, put) -> None:
    """Links among rows of equal code: rows of equal wide code go by one of them, then all are compared in blocks of
    bounded size."""
    for at in np.flatnonzero(np.diff(bounds) > 1).tolist():
        lo, hi = bounds[at], bounds[at + 1]
        _, first, inverse = np.unique(wide[lo:hi], axis=0, return_index=True, return_inverse=True)
        put(np.arange(lo, hi), lo + first[inverse.ravel()])
        block = max(1, COMPARED // len(first))
        for k in range(0, len(first) if len(first) > 1 else 0, block):
            d = np.bitwise_count(wide[lo + first[k : k + block], None, :] ^ wide[None, lo + first, :]).sum(axis=2)
            x, y = np.nonzero(d <= similar)
            put(lo + first[x + k], lo + first[y])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over fingerprints of at most budget differing bits.

    Null and empty texts, and texts of white space, have fingerprint 0, which links like any other. A null doc_id
    has a fingerprint and component_id, and is never the smallest unless its whole group has none (then null).
    Equal texts share a fingerprint and so a group. Repeated rows come out repeated. Other columns don't matter.
    """
    held = stash(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    codes = stash(held.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    met = connected_components(near_links(codes.select(F.col("fp").alias("key"), F.col("fp").alias("code")), budget))
    roots = stash(codes.join(met, codes["fp"] == met["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    to = roots.join(least, "root").select("fp", "component_id")
    out = stash(held.join(to, "fp").select("doc_id", "fp", "component_id"), "duplicates")
    drop_stash(held, codes, met, roots)
    return out


def code_shape(n: int, least: float, budget: int, miss: float) -> tuple[int, int]:
    """(bits, tables): codes of more bits for more sets (28 up to a million, 4 more for each 16 times as many), so that
    what meets by chance stays a small share, in as many tables as two sets of similarity `least` need to be within
    budget in one of them but for a probability of miss."""
    bits = 28 + 4 * max(0, math.ceil(math.log2(max(1, n) / (1 << 20)) / 4))
    flip = math.acos(2 * least / (1 + least)) / math.pi
    met = sum(math.comb(bits, k) * flip**k * (1 - flip) ** (bits - k) for k in range(budget + 1))
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - met)))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, budget: int = 3, miss: float = 0.004, distance: float = 0.24, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of documents, linked where the Jaccard similarity of their sets of word shingles is `least`
    or more; component_id is the smallest doc_id of all that links join.

    Candidates come from SimHash. Of two sets of similarity 0.8 bits differ with probability 0.15: over 64 bits that is
    about ten, a budget that prunes no trie. So each set gets several independent codes (code_shape: twelve of 28 bits up
    to a million sets, more and longer ones beyond); two of 0.8 are within `budget` bits in one of them but for a
    probability of `miss` (of 0.9: under 1e-4; texts of five shingles against four: 0.07). What is met is a candidate
    if it differs in a share of at most `distance` of 256 bits: of pairs of 0.8 over 0.9999 (five against four: 0.99).
    The sets of all that candidates join are then compared, and only links of `least` or more count (verified_links).

    Equal sets link. Texts without a token (null, empty, marks only) are one group. Rows without an id are left out. Rows
    of one id and equal sets come out once; of rows of one id and different sets, each has its group. docs is read three
    times.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    bits, tables = code_shape(texts.count(), least, budget, miss)
    words = max(8, math.ceil(tables * bits / 64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            sets = [shingle_set(t, shingle) for t in utf8(batch.column(1))]
            columns = [pa.array([set_key(s) for s in sets], pa.int64()), pa.array([wide_fingerprint(s, words) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "key", "wide", "size"])

    held = stash(texts.mapInArrow(of, "doc_id long, key long, wide binary, size long"), "wide")
    distinct = stash(held.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("wide").alias("wide"), F.first("size").alias("size")), "codes")
    # The codes are cut from the first bits; the last 256 are what candidates are held against.
    per = bits // 4
    codes = F.array(*[F.conv(F.substring(F.hex("wide"), k * per + 1, per), 16, 10).cast("long") for k in range(tables)])
    links = near_links(distinct.where("size > 0").select("key", F.substring("wide", 8 * words - 31, 32).alias("wide"), F.posexplode(codes).alias("table", "code")), budget, bits, int(distance * 256), tables=tables)
    met = connected_components(links)
    members = stash(met.join(distinct.select("key", "least", "size"), F.col("node") == F.col("key")).select("key", "least", "size", "root"), "members")
    found = verified_links(texts, members, shingle, least)
    roots = connected_components(found)
    to = distinct.join(roots, distinct["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root"))
    to = stash(to, "roots")
    ids = to.groupBy("root").agg(F.min("least").alias("component_id"))
    out = held.select("doc_id", "key").distinct().join(to.join(ids, "root").select("key", "component_id"), "key").select("doc_id", "component_id")
    out = stash(out, "groups")
    drop_stash(held, distinct, met, members, found, roots, to)
    return out


def verified_links(texts: DataFrame, members: DataFrame, shingle: int, least: float, part_rows: int = PART_ROWS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """Links (a, b) that join exactly what the pairs of similarity `least` or more within a group join.

    members: key, least (a doc_id whose text has that set), size (of the set) and root (the group). A group of over
    part_rows sets, or part_shingles shingles, is dealt into parts. First each part is compared with itself and with a few
    sets of its group; what that joins need not be compared again. Then the sets outside of a group's largest
    component are compared with those of all other parts, a pair of parts in a task. No pair of a group is left out.
    """
    spark = texts.sparkSession
    sizes = members.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.array_distinct(F.array(*[F.min_by("key", F.xxhash64("key", F.lit(k))) for k in range(PIVOTS)])).alias("pivots"))
    parts = F.greatest(F.ceil(F.col("n") / part_rows), F.ceil(F.col("s") / part_shingles)).cast("int")
    large = stash(sizes.select("root", "pivots", parts.alias("parts")).where("parts > 1"), "large")
    dealt = members.join(large, "root", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches):
            own = [shingle_set(t, shingle) for t in utf8(batch.column("text"))]
            same = pa.array([set_key(s) == k for s, k in zip(own, batch.column("key").to_pylist(), strict=True)], pa.bool_())
            columns = [*(batch.column(c) for c in ("root", "key", "parts", "part", "pivot")), pa.array([s.tobytes() for s in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["root", "key", "parts", "part", "pivot", "own"]).filter(same)

    dealt = dealt.select("root", "key", "parts", "part", F.coalesce(F.array_contains("pivots", F.col("key")), F.lit(False)).alias("pivot"), F.col("least").alias("doc_id"))
    held = texts.join(dealt, "doc_id").mapInArrow(sets, "root long, key long, parts int, part int, pivot boolean, own binary")
    held = stash(held, "sets")
    every = F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("part")))
    first = stash(_compared(held.withColumn("x", every).select("root", "x", F.col("x").alias("y"), F.lit(0).alias("part"), F.col("key").alias("label"), "key", "own"), least), "links")
    if large.isEmpty():
        drop_stash(large, held)
        return first
    own = connected_components(first)
    rows = held.where("parts > 1").join(own.withColumnRenamed("root", "label"), F.col("key") == F.col("node"), "left")
    rows = rows.select("root", "key", "parts", "part", F.coalesce("label", "key").alias("label"), "own")
    counts = rows.groupBy("root", "label").agg(F.count_distinct("key").alias("n"), F.sum(F.length("own") / 8).alias("s"))
    most = counts.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    rest = counts.join(most, "root").where("label <> main").groupBy("root", "main").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    rest = stash(rest.select("root", "main", F.greatest(F.ceil(F.col("n") / part_rows), F.ceil(F.col("s") / part_shingles)).cast("int").alias("others")), "rest")
    rows = rows.join(rest, "root")
    end = F.col("parts") + F.col("others") - 1
    main = F.col("label") == F.col("main")
    rows = rows.withColumn("part", F.when(main, F.col("part")).otherwise(F.col("parts") + F.pmod(F.xxhash64("key", F.lit(1)), F.col("others")).cast("int")))
    rows = rows.withColumn("other", F.explode(F.when(main, F.sequence(F.col("parts"), end)).otherwise(F.sequence(F.lit(0), end))))
    rows = rows.select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "label", "key", "own")
    out = first.union(stash(_compared(rows, least), "links"))
    drop_stash(large, held, own, rest)
    return out


def _compared(rows: DataFrame, least: float) -> DataFrame:
    """The links of each block (root, x, y) of sets: of one part (x = y) all pairs count, of two those across."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = [np.empty(0, np.int64)]
        b: list[np.ndarray] = [np.empty(0, np.int64)]
        for (_, x, y), block in grouped_rows(batches, ["root", "x", "y"]):
            if block.num_rows < 2:
                continue
            key, at = np.unique(block.column("key").to_numpy(), return_index=True)
            own = block.column("own").to_pylist()
            part = block.column("part").to_numpy()[at] if x != y else None
            i, j = jaccard_links([np.frombuffer(own[k], np.uint64) for k in at.tolist()], block.column("label").to_numpy()[at], part, least)
            a.append(key[i])
            b.append(key[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    blocks = rows.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")
    return blocks.mapInArrow(compare, "a long, b long")


def jaccard_links(sets: list[np.ndarray], label: np.ndarray, part: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the pairs of sets (sorted, distinct, not empty) of similarity `least` or more join, beside what
    equal labels join already; with part, only of pairs of different parts."""
    size = np.array([len(s) for s in sets])
    start = np.concatenate(([0], np.cumsum(size)))
    _, token = np.unique(np.concatenate(sets), return_inverse=True) if sets else (None, np.empty(0, np.int64))
    marked = np.zeros(len(token), bool)
    label = np.unique(label, return_inverse=True)[1]
    got_i: list[np.ndarray] = [np.empty(0, np.int64)]
    got_j: list[np.ndarray] = [np.empty(0, np.int64)]
    for k in range(len(sets) - 1):
        rest = slice(k + 1, None)
        fits = (label[rest] != label[k]) & (np.minimum(size[rest], size[k]) >= least * np.maximum(size[rest], size[k]) - 1e-9)
        if part is not None:
            fits &= part[rest] != part[k]
        others = np.flatnonzero(fits) + k + 1
        if not len(others):
            continue
        mine = token[start[k] : start[k + 1]]
        marked[mine] = True
        if len(others) < 16:
            common = np.array([np.count_nonzero(marked[token[start[o] : start[o + 1]]]) for o in others.tolist()])
        else:
            common = np.add.reduceat(marked[token[start[k + 1] :]], start[k + 1 : -1] - start[k + 1], dtype=np.int64)[others - k - 1]
        marked[mine] = False
        near = others[common >= least * (size[k] + size[others] - common) - 1e-9]
        if len(near):
            got_i.append(np.full(len(near), k))
            got_j.append(near)
            label[np.isin(label, label[near])] = label[k]
    return np.concatenate(got_i), np.concatenate(got_j)
