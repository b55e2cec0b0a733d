"""Spelling variants: words that one letter sets apart, found by anagram hashing, and the form that each goes back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, drop_stash, small_parts, stash, utf8

#: A word's letters in UTF-8: A-Z (folded before), a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Anagram keys are sums of fifth powers of code points modulo this prime: equal letters give equal keys, whatever their order.
#: The prime times the largest code point fits a long.
MODULUS, POWER = (1 << 42) - 11, 5
#: Code points of words that are held against each other by Spark's edit distance.
SHORT = 256
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000


def typo(doc_id: int | None, run: bytes, every: int) -> bytes:
    """The run without one of its letters, if `every` divides the CRC of "doc_id:run"."""
    h = zlib.crc32(b"%b:%b" % (b"" if doc_id is None else str(doc_id).encode(), run))
    if h % every:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, typo_every: int | None = None) -> DataFrame:
    """(word, n): the lower-cased (A-Z only) maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of at least least_length
    code points, with their occurrences, where these are at least least_count.

    typo_every: a run of a document loses a letter where the CRC-32 of "doc_id:run" is divisible by it, before lengths
    are looked at (planted typing errors, to measure by); None leaves texts as they are. Counts are summed up in each
    task first, so no frequent word is shuffled more than a few times a task. Null text: no words; a null id stands as
    an empty one. Repeated rows count each. No rows: none. Other columns don't matter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            rows = [(w, n) for w, n in seen.items() if len(w) >= least_length and len(w.decode()) >= least_length]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["word", "n"])

        for batch in small_parts(batches):
            for doc, t in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                own = Counter(RUN.findall(t.translate(FOLD)))
                for run, n in own.items():
                    seen[typo(doc, run, typo_every) if typo_every else run] += n
                if len(seen) > HELD:
                    yield out()
        yield out()

    held = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return held.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _value(letter: Column) -> Column:
    """A letter's power, modulo the prime after each step, so that nothing overflows."""
    code = value = F.ascii(letter).cast("long")
    for _ in range(POWER - 1):
        value = F.pmod(value * code, F.lit(MODULUS))
    return value


def _one_edit(a: str, b: str) -> Column:
    """Whether one inserted, deleted or replaced code point tells two different words apart, in time linear in their length
    (Spark's edit distance looks a letter up from the word's beginning)."""
    x, y = F.split(a, ""), F.split(b, "")
    at = F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int")
    m, n = F.size(x), F.size(y)
    rest = lambda letters, skip: F.slice(letters, at + skip, F.greatest(m, n))
    return F.when(m == n, rest(x, 1) == rest(y, 1)).when(m == n + 1, rest(x, 1) == rest(y, 0)).when(n == m + 1, rest(x, 0) == rest(y, 1)).otherwise(False)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all pairs of different words (word, n), both ways, that differ by exactly one inserted,
    deleted or replaced code point.

    A word has its key (the sum of its letters' powers) and, for each of its different letters, the key less that letter.
    Of two near words, either the shorter's key is one of the longer's lessened keys (addition and removal), or both
    have a lessened key in common (exchange). Keys are joined only together with half of the letters in their order:
    the edit falls into one half, so the other is equal; anagrams that share no half never meet. What meets is held
    against the order of all letters by its edit distance. A lessened key is the key of a word of `level` letters.

    Words are unique. Null or empty words and counts that are null are near to nothing. No rows: none.
    """
    letters = F.split("word", "")
    keyed = words.where("n is not null and length(word) > 0").select("word", "n", F.length("word").alias("m"), letters.alias("l"))
    total = F.aggregate(F.transform("l", _value), F.lit(0).cast("long"), lambda a, v: F.pmod(a + v, F.lit(MODULUS)))
    keyed = keyed.withColumn("key", total)
    kept = F.array(F.struct(F.col("m").alias("level"), F.col("key").alias("key")))
    lessened = F.transform(F.array_distinct("l"), lambda c: F.struct((F.col("m") - 1).alias("level"), F.pmod(F.col("key") - _value(c), F.lit(MODULUS)).alias("key")))
    met = keyed.select("word", "n", "m", F.explode(F.concat(kept, lessened)).alias("k")).select("word", "n", "m", "k.*")
    half = F.floor(F.col("level") / 2).cast("int")
    first, last = F.substring("word", F.lit(1), half), F.expr("right(word, level - cast(floor(level / 2) as int))")
    sides = F.array(F.struct(F.lit(0).alias("side"), first.alias("part")), F.struct(F.lit(1).alias("side"), last.alias("part")))
    met = met.select("word", "n", "m", "level", "key", F.explode(sides).alias("s")).select("word", "n", "m", "level", "key", "s.*")
    a, b = (met.select(*[F.col(c).alias(f"{x}_{c}" if c in ("word", "n", "m") else c) for c in met.columns]) for x in "ab")
    # of the pair that meets in both halves (as aaaa and aaaaa do) the first half's meeting counts
    alone = (F.col("side") == 0) | (F.substring("a_word", F.lit(1), half) != F.substring("b_word", F.lit(1), half))
    owns = (F.col("a_m") == F.col("level")) & (F.col("b_m") == F.col("level"))
    short = F.greatest("a_m", "b_m") <= SHORT
    near = ~owns & (F.col("a_word") < F.col("b_word")) & (F.abs(F.col("a_m") - F.col("b_m")) <= 1) & (~short | (F.levenshtein("a_word", "b_word", 1) == 1))
    pairs = a.join(b, ["level", "key", "side", "part"]).where(near & alone).where(short | _one_edit("a_word", "b_word"))
    ends = [F.struct(F.col(f"{x}_word").alias("word"), F.col(f"{x}_n").alias("n"), F.col(f"{y}_word").alias("other"), F.col(f"{y}_n").alias("other_n")) for x, y in ("ab", "ba")]
    return pairs.select(F.explode(F.array(*ends)).alias("p")).select("p.*")


def variant_forms(words: DataFrame, factor: float = 2.0) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word (word, n): form is its near word of the largest n (of equal ones
    the smallest in code-point order) if that is at least factor times the word's own, else null; root is where the forms
    end that are followed from word, the word itself if it has none; n_near counts its near words.

    factor must be over 1, so that forms cannot turn in circles; each step multiplies n by it, and each round of joins
    doubles the steps that are followed, so the rounds are few: log2(log(largest n) / log(factor)). Only words with a form
    are joined. Words are unique; rows with a null word or n are left out. No rows: none.
    """
    if factor <= 1:
        raise ValueError("factor must be over 1")
    words = stash(words.where("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("o"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    held = words.join(near, "word", "left").withColumns({"n_near": F.coalesce("n_near", F.lit(0).cast("long")), "other_n": -F.col("best.o")})
    goes = F.col("other_n") >= factor * F.col("n")
    held = stash(held.select("word", "n", "n_near", F.when(goes, F.col("best.word")).alias("form"), F.when(goes, F.col("other_n")).alias("form_n")), "forms")
    drop_stash(words)
    links = stash(held.where("form is not null").select("word", F.col("form").alias("root")), "links")
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stash(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        moved = not further.where("moved").isEmpty()
        drop_stash(links)
        links = further.select("word", "root")
        if not moved:
            return held.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 5, least_count: int = 3, factor: float = 2.0, typo_every: int | None = None) -> DataFrame:
    """variant_forms of word_counts: spelling variants of the words of documents. Defined cases as there."""
    return variant_forms(word_counts(docs, doc_id, text, least_length, least_count, typo_every), factor)
