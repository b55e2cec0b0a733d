"""Fill-in-the-middle: texts cut into prefix, middle and suffix and written in another order, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes of text that the kernel takes at a time (one longer text is taken alone): its work arrays are nine times as large.
PORTION = 4 << 20
INNER, WHITE, LINE, OTHER = range(4)


def _byte_classes() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[0x80:0xC0] = INNER
    kind[list(b"\t\x0b\x0c\r ")] = WHITE
    kind[10] = LINE
    return kind


KIND = _byte_classes()


def _borders(unit: str) -> np.ndarray:
    """Whether a unit starts at a byte, by the class of the byte before it and its own."""
    starts = np.zeros((4, 4), bool)
    if unit == "chars":
        starts[:, [WHITE, LINE, OTHER]] = True
    elif unit == "words":
        starts[np.ix_([WHITE, LINE], [OTHER])] = True
    elif unit == "lines":
        starts[LINE] = True
    else:
        raise ValueError(f"no unit {unit}")
    return starts


def byte_cuts(raw: np.ndarray, ends: np.ndarray, first: np.ndarray, second: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """(units, prefix units, middle units, byte where the middle starts, byte where the suffix starts) of every row.

    raw: the rows' bytes without gaps; ends: n + 1 offsets into it; first and second: a row's draws, each taken modulo
    its units + 1. A unit starts at a row's first byte and wherever the class of a byte and of the one before it say so;
    the running count of starts, less what it was at the row's beginning, numbers a row's units, and one search in it
    finds the cuts of all rows together.
    """
    borders = _borders(unit)
    kind = KIND[raw]
    begins = np.ones(len(raw), bool)
    begins[1:] = borders[kind[:-1], kind[1:]]
    begins[ends[:-1][ends[:-1] < ends[1:]]] = True
    count = np.cumsum(begins, dtype=np.int64)
    before = np.concatenate([[0], count])[ends]
    units = before[1:] - before[:-1]
    a, b = first % (units + 1), second % (units + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    at = [np.minimum(np.searchsorted(count, before[:-1] + k + 1), ends[1:]) for k in (low, high)]
    return units, low, high - low, *at


def portions(batch: pa.RecordBatch, text: int, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `most` bytes of text (or one row)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def _bytes_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """A text column without nulls, its bytes and its offsets into them (from 0)."""
    held = pc.fill_null(column.cast(pa.large_binary()), b"")
    ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]
    data = held.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, raw, ends - ends[0]


def _spans(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """raw[start:stop] of each row, as they stand in one buffer."""
    n = len(starts)
    edges = np.stack([starts, stops], axis=1).reshape(-1)
    edges = np.append(edges, edges[-1] if n else 0).astype(np.int64)
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * n, [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    return both.take(pa.array(np.arange(n) * 2))


def check_sentinels(marks: tuple[str, str, str]) -> None:
    """Marks must be found again wherever a text without them is cut: none may be empty or hold another, and none may begin
    with what one ends with."""
    inside = any(a in b for i, a in enumerate(marks) for j, b in enumerate(marks) if i != j)
    overlap = any(a[-k:] == b[:k] for a in marks for b in marks for k in range(1, min(len(a), len(b))))
    if not all(marks) or inside or overlap:
        raise ValueError(f"sentinels that can be mistaken for one another: {marks}")


FORMS = "n long, form string, prefix_units long, middle_units long, output string"


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "chars", seed: int = 1, plain: int = 10, suffix_first: int = 20, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output) of every document: its text cut at two of its n units' borders
    and written as form says, with sentinels (P, S, M) before the parts.

    unit: "chars" (code points), "words" (each with the white space behind it) or "lines". The draws are the first four
    8-digit groups of the hex sha256 of "seed:doc_id", so a document is always cut alike. form: "plain" (output is the
    text) where it is empty or holds a sentinel and for `plain` of 100 others; of the rest "spm" (S suffix P prefix M
    middle) for `suffix_first` of 100, else "psm" (P prefix S suffix M middle).

    Null text: empty, so plain. Null ids draw as an empty one. Equal ids draw equally. Repeated rows stay. No rows: none.
    A text is cut whole. Other columns don't matter. Nothing is shuffled.
    """
    check_sentinels(sentinels)
    _borders(unit)
    p, s, m = (pa.scalar(x.encode(), pa.large_binary()) for x in sentinels)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.scalar(b"", pa.large_binary())
        for whole in batches:
            for batch in portions(whole, 1):
                held, raw, ends = _bytes_of(batch.column(1))
                first, second, third, fourth = (batch.column(k).to_numpy() for k in range(2, 6))
                units, low, middle, a, b = byte_cuts(raw, ends, first, second, unit)
                marked = np.zeros(len(held), bool)
                for mark in sentinels:
                    marked |= pc.match_substring(held, mark).to_numpy(zero_copy_only=False)
                as_it_is = (ends[1:] == ends[:-1]) | marked | (third % 100 >= 100 - plain)
                spm = fourth % 100 < suffix_first
                prefix, mid, suffix = _spans(raw, ends[:-1], a), _spans(raw, a, b), _spans(raw, b, ends[1:])
                pick = pa.array(spm)
                turned = pc.binary_join_element_wise(pc.if_else(pick, s, p), pc.if_else(pick, suffix, prefix), pc.if_else(pick, p, s), pc.if_else(pick, prefix, suffix), m, mid, none)
                output = pc.if_else(pa.array(as_it_is), held, turned)
                form = np.where(as_it_is, "plain", np.where(spm, "spm", "psm"))
                rows = [batch.column(0), pa.array(units), pa.array(form), pa.array(low, mask=as_it_is), pa.array(middle, mask=as_it_is), output.cast(pa.large_string())]
                yield pa.RecordBatch.from_arrays(rows, ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    drawn = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(drawn, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)]
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *draws)
    return held.mapInArrow(cut, f"doc_id {held.schema['doc_id'].dataType.simpleString()}, {FORMS}")


def restore_text(formed: DataFrame, form: str = "form", output: str = "output", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The rows of fill_in_middle with one more column, restored: the text, rebuilt from output and form alone. Sentinels are
    searched in whole columns at a time. A form or an output that is null, or no such form, gives null; an output whose
    sentinels are not where its form has them fails the job. A column named restored is replaced."""
    check_sentinels(sentinels)
    p, s, m = (x.encode() for x in sentinels)
    kept = [c for c in formed.columns if c.lower() != "restored"]

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.scalar(b"", pa.large_binary())
        at_form, at_output = kept.index(form), kept.index(output)
        for whole in batches:
            for batch in portions(whole, at_output):
                held, raw, ends = _bytes_of(batch.column(at_output))
                known = pc.and_(pc.is_valid(batch.column(at_form)), pc.is_valid(batch.column(at_output)))
                of = pc.fill_null(batch.column(at_form), "")
                places = [pc.find_substring(held, x).to_numpy(zero_copy_only=False).astype(np.int64) + ends[:-1] for x in sentinels]
                parts = {}
                for name, marks, order in (("psm", (p, s, m), (0, 1, 2)), ("spm", (s, p, m), (1, 0, 2))):
                    own = pc.equal(of, name).to_numpy(zero_copy_only=False)
                    x, y, z = (places[k] for k in order)
                    sound = (x == ends[:-1]) & (x + len(marks[0]) <= y) & (y + len(marks[1]) <= z)
                    if (own & ~sound & known.to_numpy(zero_copy_only=False)).any():
                        raise ValueError("an output's sentinels are not where its form has them")
                    edge = lambda k: np.where(own & sound, k, ends[:-1])
                    one, two = _spans(raw, edge(x + len(marks[0])), edge(y)), _spans(raw, edge(y + len(marks[1])), edge(z))
                    last = _spans(raw, edge(z + len(marks[2])), np.where(own & sound, ends[1:], ends[:-1]))
                    prefix, suffix = (one, two) if name == "psm" else (two, one)
                    parts[name] = pc.binary_join_element_wise(prefix, last, suffix, none)
                text = pc.if_else(pc.equal(of, "psm"), parts["psm"], pc.if_else(pc.equal(of, "spm"), parts["spm"], held))
                known = pc.and_(known, pc.is_in(of, pa.array(["plain", "psm", "spm"])))
                text = pc.if_else(known, text, pa.scalar(None, pa.large_binary()))
                yield pa.RecordBatch.from_arrays([*batch.columns, text.cast(pa.large_string())], [*kept, "restored"])

    rows = formed.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(rebuild, f"{fields}, restored string")
