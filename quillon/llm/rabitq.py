"""Embedding near-dedup by binary codes of randomly rotated vectors with stored correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, grouped_rows, small_parts, stash
from .components import connected_components, forest

SEED = 20240229
#: Rows of a bucket that are compared with as many others at a time.
CHUNK = 2048
#: Bits to which the coordinates of the other vector of a pair are rounded, and what single precision may err by.
PLANES, SLACK = 4, 1e-4


@lru_cache(maxsize=8)
def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of dim dimensions (the same everywhere). A worker keeps a few."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim, k]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def bands(rows: int, threshold: float, miss: float) -> tuple[int, int]:
    """Sign bits of a band and the number of bands, so that a bucket of `rows` vectors falls to about CHUNK and a
    pair at the threshold shares no band with a probability of at most miss. No miss: one bucket, in which all meet."""
    bits = max(0, math.ceil(math.log2(max(1, rows) / CHUNK))) if miss else 0
    if not bits:
        return 0, 1
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - alike))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1. The largest component is divided out first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as signs of their rotated coordinates (rows of -1 and 1 over the root of dim, so of length 1),
    correction factors (inner product of a code with its vector) and the rotated vectors."""
    turned = unit_rows(vectors) @ rotation(vectors.shape[1], 0).T
    code = np.where(turned >= 0, 1.0, -1.0) / math.sqrt(vectors.shape[1])
    return code, (code * turned).sum(axis=1), turned


def error_bound(factor: np.ndarray, threshold: float) -> np.ndarray:
    """How far below the truth a code's estimate for a pair of cosine >= threshold may lie. The estimate <code, q> /
    factor is unbiased over rotations; what it errs by is the code's part across the vector times q's, and these are at
    most as long as the bound says: it holds with certainty, so no pair is lost by it."""
    return math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(0, 1 - factor**2)) / np.maximum(factor, 1e-12)


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def rounded(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors to PLANES bits a coordinate: the planes of bits (rows, planes, words), least coordinate, step and
    the length of what rounding takes away."""
    low = turned.min(axis=1)
    step = (turned.max(axis=1) - low) / ((1 << PLANES) - 1)
    step[step == 0] = 1.0
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    error = np.linalg.norm(turned - low[:, None] - step[:, None] * level, axis=1)
    return np.stack([words_of(level >> p & 1) for p in range(PLANES)], axis=1), low, step, error


@dataclass
class Codes:
    """Of one chunk: the words of signs and planes, and factors, least coordinates, steps and rounding errors."""

    signs: np.ndarray
    planes: np.ndarray
    factor: np.ndarray
    low: np.ndarray
    step: np.ndarray
    error: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, dim: int) -> Codes:
        words = np.frombuffer(b"".join(rows.column("code").to_pylist()), "<u8").reshape(rows.num_rows, 1 + PLANES, -1)
        return cls(words[:, 0], words[:, 1:], *(rows.column(c).to_numpy().astype(float) for c in ("factor", "low", "step", "error")))


def possible(a: Codes, b: Codes, dim: int, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a, and which of b, have a partner whose estimate does not rule out a cosine of threshold: bit
    operations on packed codes only. With same, a row is no partner of itself."""
    hit_a, hit_b = np.zeros(len(a.factor), bool), np.zeros(len(b.factor), bool)
    weight = 1 << np.arange(PLANES)
    total = np.bitwise_count(b.planes).sum(axis=2, dtype=np.int64) @ weight
    ones = np.bitwise_count(a.signs).sum(axis=1, dtype=np.int64)
    least = a.factor * (threshold - error_bound(a.factor, threshold)) - SLACK
    for at in range(0, len(hit_a), 256):
        signs = a.signs[at : at + 256]
        dot = np.zeros((len(signs), len(hit_b)), np.int32)
        for p, w in enumerate(weight.tolist()):
            for word in range(signs.shape[1]):
                dot += np.bitwise_count(signs[:, None, word] & b.planes[None, :, p, word]) * np.int32(w)
        inner = (b.low * (2 * ones[at : at + 256, None] - dim) + b.step * (2 * dot - total)) / math.sqrt(dim)
        near = inner >= least[at : at + 256, None] - b.error
        if same:
            near[np.arange(len(signs)), at + np.arange(len(signs))] = False
        hit_a[at : at + 256] = near.any(axis=1)
        hit_b |= near.any(axis=0)
    return hit_a, hit_b


def exact_pairs(a: dict, b: dict, same: bool, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of cosine >= threshold in double precision that share no band before this one."""
    got_i, got_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(a["unit"]), 512):
        i, j = np.nonzero(a["unit"][at : at + 512] @ b["unit"].T >= threshold - 1e-9)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        if band:
            new = (a["values"][i, :band] != b["values"][j, :band]).all(axis=1)
            i, j = i[new], j[new]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = (a["unit"][x] * b["unit"][y]).sum(axis=1) >= threshold
            got_i.append(x[near])
            got_j.append(y[near])
    return np.concatenate(got_i), np.concatenate(got_j)


BLOCK = ["group", "dim", "band", "value", "x", "y"]


def vector_links(vectors: DataFrame, threshold: float = 0.98, miss: float = 1e-4, kind: str = "<f8") -> DataFrame:
    """What links the distinct vectors (group, dim, key, weight, vector: the bytes of its numbers of a kind): rows (a, b, null)
    join two keys, and rows (key, null, links) add the weights of a key's partners up.

    Within a group, vectors meet in buckets of their sign bits, in several bands. Only codes travel there: signs,
    coordinates rounded to PLANES bits and a few factors. Their estimates and bounds decide which vectors of a bucket
    may have a partner there; only these are fetched and computed exactly. A bucket of over CHUNK vectors is dealt
    into chunks and all pairs of chunks meet, each in a block of its own. A pair counts in the first band that it
    shares. Pairs never leave a task: only keys, sums and a spanning forest do.
    """
    spark = vectors.sparkSession
    most = vectors.groupBy("group", "dim").count().agg(F.max("count")).first()[0] or 0
    bits, count = bands(most, threshold, miss)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_parts(batches, 4096):
            dims = np.array(batch.column("dim").to_pylist())
            values = np.zeros((len(dims), count), np.int32)
            numbers = np.zeros((4, len(dims)), np.float32)
            code: list[bytes] = [b""] * len(dims)
            raw = batch.column("vector").to_pylist()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                v = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), dim).astype(float)
                own, factor, turned = encode(v)
                planes, *rest = rounded(turned)
                numbers[:, at] = [factor, *rest]
                for k, c in zip(at, np.concatenate((words_of(own > 0)[:, None, :], planes), axis=1), strict=True):
                    code[k] = c.tobytes()
                if bits:
                    need = bits * count
                    turns = [turned] + [v @ rotation(dim, k).T for k in range(1, math.ceil(need / dim))]
                    bit = (np.concatenate(turns, axis=1)[:, :need] >= 0).reshape(len(at), count, bits)
                    values[at] = bit @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values.tolist(), pa.list_(pa.int32())), pa.array(code, pa.binary()), *(pa.array(x) for x in numbers)], [*batch.schema.names, "values", "code", "factor", "low", "step", "error"])

    names = ["group", "dim", "key", "weight", "vector"]
    coded = vectors.select(*names).mapInArrow(signs, "group long, dim int, key long, weight long, vector binary, values array<int>, code binary, factor float, low float, step float, error float")
    coded = stash(coded, "codes")
    spread = coded.select("group", "dim", "key", "code", "factor", "low", "step", "error", F.posexplode("values").alias("band", "value"))
    sizes = spread.groupBy("group", "dim", "band", "value").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    spread = spread.join(sizes, ["group", "dim", "band", "value"])
    spread = spread.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spread = spread.withColumn("x", F.least("chunk", "other")).withColumn("y", F.greatest("chunk", "other")).drop("chunks", "other")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*_, x, y), rows in grouped_rows(batches, BLOCK):
            chunk, dim = rows.column("chunk").to_numpy(), rows.column("dim")[0].as_py()
            sides = [np.flatnonzero(chunk == c) for c in ([x] if x == y else [x, y])]
            own = [Codes.of(rows.take(pa.array(at)), dim) for at in sides]
            if all(len(at) for at in sides):
                hits = possible(own[0], own[-1], dim, threshold, x == y)
                # Within one chunk a pair's estimate may differ by direction: either end is enough to fetch both.
                hits = [hits[0] | hits[1]] if x == y else hits
                at = np.concatenate([s[h] for s, h in zip(sides, hits, strict=True)])
                if len(at):
                    yield from rows.take(pa.array(at)).select([*BLOCK, "chunk", "key"]).combine_chunks().to_batches()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    near = spread.repartition(n, *BLOCK).sortWithinPartitions(*BLOCK).mapInArrow(estimate, "group long, dim int, band int, value int, x int, y int, chunk int, key long")
    near = stash(near, "near")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, dim, band, _, x, y), rows in grouped_rows(batches, BLOCK):
            chunk = rows.column("chunk").to_numpy()

            def side(c: int, rows: pa.Table = rows, chunk: np.ndarray = chunk, dim: int = dim) -> dict:
                at = np.flatnonzero(chunk == c)
                own = rows.take(pa.array(at))
                v = np.frombuffer(b"".join(own.column("vector").to_pylist()), kind).reshape(len(at), dim).astype(float)
                return {"unit": unit_rows(v), "values": np.array(own.column("values").to_pylist()), "key": own.column("key").to_numpy(), "weight": own.column("weight").to_numpy()}

            a = side(x)
            b = a if x == y else side(y)
            if not len(a["key"]) or not len(b["key"]):
                continue
            i, j = exact_pairs(a, b, x == y, band, threshold)
            if not len(i):
                continue
            shift = 0 if x == y else len(a["key"])
            keys = a["key"] if x == y else np.concatenate((a["key"], b["key"]))
            links = np.zeros(len(keys), np.int64)
            np.add.at(links, i, b["weight"][j])
            np.add.at(links, j + shift, a["weight"][i])
            u, v = forest(i, j + shift)
            some = np.flatnonzero(links)
            none = [None]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((keys[u], keys[some]))), pa.array(keys[v].tolist() + none * len(some), pa.int64()), pa.array(none * len(u) + links[some].tolist(), pa.int64())], ["a", "b", "links"])

    blocks = near.join(coded.select("key", "weight", "vector", "values"), "key").repartition(n, *BLOCK).sortWithinPartitions(*BLOCK)
    out = stash(blocks.mapInArrow(link, "a long, b long, links long"), "links")
    drop_stash(near, coded)
    return out


def near_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.98, miss: float = 1e-4) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row: the number of other rows of its label with a cosine of
    threshold or more, and the smallest vec_id reachable by such links; kept is vec_id = component_id.

    Labels may be of any type that can be hashed; those that are no whole numbers go by a hash of 64 bits. A null label, and a vector that is null, empty, zero or holds a null or a non-finite component, links with
    nothing (0, itself, kept). Vectors of different lengths don't link. Equal vectors of a label link and are one
    vector to the search, so a large group of copies costs no more. Rows of one vec_id are vectors of their own; a
    null vec_id is never the smallest and is not kept. No rows: none. Other columns don't matter.

    A pair is missed only if it shares no band: with a probability of at most `miss` at the threshold, less above, and
    never in labels of up to CHUNK vectors or with a miss of 0, where all of a label meet. No pair below the threshold
    counts.
    """
    # Single-precision input travels as it is; all arithmetic is double.
    kind = "<f4" if dict(table.dtypes)[embedding] == "array<float>" else "<f8"
    e = F.col(embedding) if kind == "<f4" else F.col(embedding).cast("array<double>")
    whole = dict(table.dtypes)[label] in ("tinyint", "smallint", "int", "bigint")
    group = F.col(label).cast("long") if whole else F.when(F.col(label).isNotNull(), F.xxhash64(label))
    held = table.select(F.col(vec_id).cast("long").alias("vec_id"), group.alias("group"), e.alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0)
    held = held.withColumn("e", F.when(F.col("group").isNotNull() & (F.size("e") > 0) & fine, F.col("e")))
    rows = stash(held.select("vec_id", "group", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("h"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit("again"), "e")).alias("g"), "e"), "vectors")
    reps = rows.where("e is not null").groupBy("group", "h", "g").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("e").alias("e"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, kind).tobytes() for v in batch.column("e").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("group", "h", "g", "least", "weight")), pa.array([len(r) // int(kind[2]) for r in raw], pa.int32()), pa.array(raw, pa.binary())], ["group", "h", "g", "least", "weight", "dim", "vector"])

    reps = reps.mapInArrow(pack, "group long, h long, g long, least long, weight long, dim int, vector binary")
    # Vectors go by a number of their own: ids may be null or repeat, and a label must not meet another by them.
    reps = stash(reps.withColumn("key", F.monotonically_increasing_id()), "reps")
    found = vector_links(reps, threshold, miss, kind)
    links = found.where("links is not null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("links is null"))
    known = reps.select("group", "h", "g", "key", "least", "weight").join(roots.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    known_ = stash(known.withColumn("root", F.coalesce("root", "key")), "known")
    least = known_.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known_.join(least, "root").select(F.col("group").alias("g1"), F.col("h").alias("g2"), F.col("g").alias("g3"), "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.drop("e").join(known, (F.col("group") == F.col("g1")) & (F.col("h") == F.col("g2")) & (F.col("g") == F.col("g3")), "left")
    component = F.when(F.col("g1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    out = stash(out, "near_vectors")
    drop_stash(rows, reps, found, roots, known_)
    return out
