"""Vector bin packing of token sequences: a dot-product heuristic under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_parts

#: Ends a document.
STOP_ID = 0


@dataclass(frozen=True)
class Limits:
    """Of one sequence: tokens, segments and tokens that bear loss. group: examples that are packed together."""

    tokens: int = 1024
    segments: int = 64
    loss: int = 1024
    group: int = 4096


def bpe_encoder(ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a byte-level BPE by its rank file; special tokens' strings are ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def public_bpe() -> Callable[[str], list[int]]:
    """The ids of byte_bpe_50k.json with special tokens' strings as ordinary text, by the same vocabulary's rank file."""
    import public_tokenizers

    return bpe_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def json_bpe() -> Callable[[str], list[int]]:
    """The ids that tokenizers gives by byte_bpe_50k.json without adding special tokens: public_bpe's, but the strings of
    the JSON's added tokens are one id each wherever they stand in a text."""
    import json

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("json", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode(text, allowed_special="all", disallowed_special=())


def pack_group(need: np.ndarray, limits: Limits, cut: bool) -> list[list[tuple[int, int]]]:
    """Bins of (example, tokens of it), for examples that need (tokens, segments, loss tokens).

    A bin takes, again and again, the example among those that fit whose needs have the largest dot product with the
    room left (both as shares of the limits): it fills the dimension of which most is left. When none fits and cut
    is true, the largest example left gives a piece that fills the bin, in tokens and loss at least one of each if
    it has any; its rest stays. Without cut, an example beyond the limits is an error.
    """
    cap = np.array([limits.tokens, limits.segments, limits.loss], float)
    left = need.astype(np.int64).copy()
    if not cut and len(left) and (left > cap).any():
        raise ValueError("an example exceeds the limits and may not be cut")
    share = left / cap
    open_ = np.ones(len(left), bool)
    order = np.argsort(-left[:, 0], kind="stable")
    first = 0
    bins = []
    while True:
        while first < len(order) and not open_[order[first]]:
            first += 1
        if first == len(order):
            return bins
        if first > 64 and first * 2 > len(order):
            order, first = order[first:][open_[order[first:]]], 0
        live = order[first:]
        room = cap.copy()
        items: list[tuple[int, int]] = []
        ok = open_[live] & (left[live] <= room).all(axis=1)
        worth = share[live]
        while True:
            score = np.where(ok, worth @ (room / cap), -1.0)
            k = int(score.argmax()) if len(score) else 0
            if not len(score) or score[k] < 0:
                break
            x = int(live[k])
            items.append((x, int(left[x, 0])))
            room -= left[x]
            open_[x] = False
            ok[k] = False
            ok &= (left[live] <= room).all(axis=1)
        if cut and room.min() >= 1:
            rest = live[open_[live]]
            if len(rest):
                x = int(rest[left[rest, 0].argmax()])
                take = int(min(room[0], room[2] if left[x, 2] else room[0], left[x, 0] - 1))
                if take > 0:
                    items.append((x, take))
                    left[x, 0] -= take
                    left[x, 2] = max(0, left[x, 2] - take)
                    share[x] = left[x] / cap
        if not items:
            raise ValueError("an example fits no bin")
        bins.append(items)


def whole_powers(items: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The pieces of a short bin dealt into bins whose token counts are powers of two, largest first."""
    total = sum(n for _, n in items)
    out: list[list[tuple[int, int]]] = []
    todo = list(items)
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        now: list[tuple[int, int]] = []
        while want:
            x, n = todo.pop(0)
            take = min(n, want)
            now.append((x, take))
            want -= take
            if take < n:
                todo.insert(0, (x, n - take))
        out.append(now)
    return out


def pack_documents(docs: DataFrame, encode: Callable[[], Callable[[str], list[int]]], doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of documents packed into sequences.

    encode makes the tokenizer in the worker. A document is its ids and STOP_ID. Full runs of limits.tokens are
    sequences of their own; the rests are packed, limits.group documents at a time as they stream by, and may be
    cut to fill a bin. What the last short bins of a group hold is dealt into sequences whose length is a power of
    two, so these need no padding. Every token bears loss here. No row is moved: a task packs what it reads, in
    bounded memory, and a task that is run again gives the same pieces (given the same input partitions).

    Null text: empty, so one piece of STOP_ID. Repeated rows and null ids are documents like any others. No rows:
    no pieces. A text is encoded whole. Other columns don't matter.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of = encode()
        number = TaskContext.get().partitionId() << 40
        rests: list[tuple[int | None, int, np.ndarray]] = []
        rows: list[tuple] = []

        def piece(doc: int | None, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
            raw = ids.tobytes()
            rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, raw))

        def flush() -> None:
            nonlocal number
            need = np.array([(len(ids), 1, len(ids)) for _, _, ids in rests], np.int64).reshape(-1, 3)
            given = [0] * len(rests)
            for items in pack_group(need, limits, True):
                total = sum(n for _, n in items)
                for part in [items] if total == limits.tokens else whole_powers(items):
                    offset = 0
                    for x, n in part:
                        doc, base, ids = rests[x]
                        piece(doc, base + given[x], ids[given[x] : given[x] + n], base + len(ids), number, offset)
                        given[x] += n
                        offset += n
                    number += 1
            rests.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], PIECE_FIELDS)
            rows.clear()
            return batch

        for batch in small_parts(batches):
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*of(t or ""), STOP_ID], "<u4")
                full = len(ids) // limits.tokens * limits.tokens
                for at in range(0, full, limits.tokens):
                    piece(doc, at, ids[at : at + limits.tokens], len(ids), number, 0)
                    number += 1
                if full < len(ids):
                    rests.append((doc, full, ids[full:]))
                if len(rests) == limits.group:
                    flush()
                if len(rows) > 2000:
                    yield out()
        flush()
        yield out()

    held = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return held.mapInArrow(pack, PIECE_SCHEMA)


PIECE_FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
PIECE_SCHEMA = ", ".join(f"{f} long" for f in PIECE_FIELDS[:-1]) + ", ids binary"


def instruction_examples(turns: DataFrame, encode: Callable[[], Callable[[str], list[int]]], conv_id: str = "conv_id", role: str = "role", text: str = "text", answers: str = "assistant") -> DataFrame:
    """(example_id, tokens, segments, loss) of conversations, a row of turns each: a turn is its ids and STOP_ID and a segment
    of its own, and only the turns of the role that answers bear loss.

    Null text: empty. A null or other role bears no loss. Turns without a conversation are left out. The order of turns
    and other columns don't matter. No rows: none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encode()
        for batch in small_parts(batches):
            n = [len(of(t or "")) + 1 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["example_id", "answer", "tokens"])

    held = turns.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("example_id"), F.coalesce(F.col(role) == answers, F.lit(False)).alias("answer"), F.col(text).cast("string").alias("text"))
    counted = held.mapInArrow(count, "example_id long, answer boolean, tokens long")
    return counted.groupBy("example_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum(F.when(F.col("answer"), F.col("tokens")).otherwise(0)).alias("loss"))


def pack_examples(examples: DataFrame, limits: Limits = Limits(), alone: bool = False) -> DataFrame:
    """(example_id, sequence_id) for whole instruction examples (example_id, tokens, segments, loss): none is cut. One beyond
    a limit fails the job, or with alone has a sequence of its own. Null counts are 0; an example of no tokens takes a
    segment only. limits.group examples are packed at a time as they stream by. No rows: none."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        most = (limits.tokens, limits.segments, limits.loss)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            if alone:
                large = [r[0] for r in rows if any(x > m for x, m in zip(r[1:], most, strict=True))]
                rows = [r for r in rows if all(x <= m for x, m in zip(r[1:], most, strict=True))]
                yield _sequences(large, range(number, number + len(large)))
                number += len(large)
            held += rows
            while len(held) >= limits.group:
                made = _whole(held[: limits.group], limits, number)
                number, held = made[1], held[limits.group :]
                yield made[0]
        if held:
            yield _whole(held, limits, number)[0]

    return examples.select("example_id", *[F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("tokens", "segments", "loss")]).mapInArrow(pack, "example_id long, sequence_id long")


def _sequences(ids: list, of: Iterable[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(of), pa.int64())], ["example_id", "sequence_id"])


def _whole(held: list[tuple], limits: Limits, number: int) -> tuple[pa.RecordBatch, int]:
    bins = pack_group(np.array([h[1:] for h in held], np.int64), limits, False)
    ids = [held[x][0] for items in bins for x, _ in items]
    of = [number + k for k, items in enumerate(bins) for _ in items]
    return _sequences(ids, of), number + len(bins)
