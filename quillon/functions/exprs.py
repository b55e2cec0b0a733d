"""Column expressions: text normal forms, safe casts, times, hash buckets, tokens."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a patient hash, and the bounds of the train and validation shares.
BUCKETS, TRAIN_BELOW, VALIDATION_BELOW = 10_000, 8_000, 9_000
TRUE_WORDS = ("yes", "y", "true", "1")


def blank_to_null(c: Column) -> Column:
    """Trimmed text, or null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def nonblank(c: Column) -> Column:
    """Neither null nor blank. Never null."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def text_token(c: Column) -> Column:
    """Lower-case, every run of other characters than a-z and 0-9 an underscore (also at the ends); empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), F.lit(""))


def code_key(c: Column) -> Column:
    """Letters and digits only, lower-case; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]", ""), F.lit(""))


def unit_text(c: Column) -> Column:
    """Lower-case, white space runs one space; empty is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"\s+", " "), F.lit(""))


def says_true(c: Column) -> Column:
    """One of the words for true; null stays null."""
    return F.lower(F.trim(c)).isin(*TRUE_WORDS)


def first_of(*columns: Column) -> Column:
    """The first that is not blank, in order of precedence."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def class_key(c: Column, length: int = 4) -> Column:
    """The first characters of the trimmed upper-case code; blank is null."""
    return F.nullif(F.substring(F.upper(F.trim(c)), 1, length), F.lit(""))


def candidate_token(code: Column, class_code: Column, strategy: str = "code_or_class") -> Column:
    """P10: `rxnorm:` and the code, else `atc:` and its class; `class_or_code`: the class first."""
    by_code = F.concat(F.lit("rxnorm:"), blank_to_null(code))
    by_class = F.concat(F.lit("atc:"), class_key(class_code))
    if strategy == "code_or_class":
        return F.coalesce(by_code, by_class)
    if strategy == "class_or_code":
        return F.coalesce(by_class, by_code)
    raise ValueError(f"no such strategy: {strategy}")


def hash_bucket(key: Column, buckets: int = BUCKETS) -> Column:
    """A bucket from the first 32 bits of a text's MD5, the same in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def hash_uniform(key: Column) -> Column:
    """A number in [0, 1] from the first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(0xFFFFFFFF))


def split_name(patient: Column, source: Column, seed: int, external: str = "external") -> Column:
    """The external source's own split, else train, validation or test by the patient's bucket."""
    bucket = hash_bucket(F.concat(patient.cast("string"), F.lit(f"|{seed}")))
    return F.when(source == external, external).when(bucket < TRAIN_BELOW, "train").when(bucket < VALIDATION_BELOW, "validation").otherwise("test")


def patient_fold(patient: Column, seed: int, folds: int) -> Column:
    """A patient's fold."""
    if folds < 2:
        raise ValueError("at least two folds are needed")
    return hash_bucket(F.concat(F.lit(f"{seed}|"), patient.cast("string")), folds)


def hours_between(start: Column, end: Column) -> Column:
    """whole seconds from start to end, in hours."""
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / F.lit(3600.0)


def observation_end_hours(los_days: Column, offset_minutes: Column, start: Column, end: Column) -> Column:
    """The end of a stay in hours from its start: length of stay, else the offset, else the time stamps."""
    return F.coalesce(los_days.try_cast("double") * 24.0, offset_minutes.try_cast("double") / F.lit(60.0), hours_between(start, end))


def event_hours(source: Column, offset_minutes: Column, time: Column, start: Column, offset_source: str = "external") -> Column:
    """Offset minutes; else, in the source that gives times as minutes, the time as a number; else time stamps."""
    minutes = F.when(source == offset_source, time.cast("string").try_cast("double"))
    return F.coalesce(offset_minutes.try_cast("double") / F.lit(60.0), minutes / F.lit(60.0), hours_between(start, time.try_cast("timestamp_ntz")))


def after_hours(time: Column, hours: float) -> Column:
    """a timestamp some hours on."""
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)"))


def first_match(branches: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """P20: the value of the first branch whose condition holds."""
    return reduce(lambda rest, b: F.when(b[0], b[1]).otherwise(rest), reversed(list(branches)), default)


def allowed(c: Column, values: Iterable[str]) -> Column:
    """In the list; everything if the list is empty."""
    values = list(values)
    return c.isin(*values) if values else F.lit(True)


def scoring_scope(source: Column, split: Column, final: bool, dev: str = "dev") -> Column:
    """Train and validation of the development source; finally also test and all other sources."""
    own = (source == dev) & split.isin("train", "validation", *(["test"] if final else []))
    return own | (source != dev) if final else own


def with_provenance(df: DataFrame, **stamps: str) -> DataFrame:
    """Constant version and time columns."""
    return df.withColumns({k: F.lit(v) for k, v in stamps.items()})


def column_suffixes(tokens: Iterable[str]) -> dict[str, str]:
    """A column suffix for each token; tokens that would share one get a digest of the token behind it."""
    import hashlib
    import re
    from collections import Counter

    tokens = list(tokens)
    plain = {t: re.sub(r"[^a-z0-9]+", "_", t.lower()).strip("_") or "token" for t in tokens}
    seen = Counter(plain[t] for t in dict.fromkeys(tokens))
    return {t: plain[t] if seen[plain[t]] == 1 else f"{plain[t]}_{hashlib.sha1(t.encode()).hexdigest()[:8]}" for t in tokens}


def safe_div(a: Column, b: Column) -> Column:
    """A double quotient; null where the divisor is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def number(c: Column) -> Column:
    """a text as a double, null where it is none (Spark alone would also take a trailing d or f)."""
    return F.when(F.trim(c).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), c.try_cast("double"))


def code_variants(ndc: Column) -> Column:
    """an 11-digit drug code and its 10-digit forms (a leading zero of one of the 5-4-2 parts left out), distinct."""
    digits = F.regexp_replace(ndc, "[^0-9]", "")
    part = lambda a, n: F.substring(digits, a, n)
    ten = [F.when(part(at, 1) == "0", F.concat(part(1, at - 1), F.substring(digits, at + 1, 11))) for at in (1, 6, 10)]
    eleven = [F.concat(F.lit("0"), digits), F.concat(part(1, 5), F.lit("0"), F.substring(digits, 6, 10)), F.concat(part(1, 9), F.lit("0"), F.substring(digits, 10, 10))]
    forms = F.when(F.length(digits) == 11, F.array(digits, *ten)).when(F.length(digits) == 10, F.array(digits, *eleven)).otherwise(F.array(F.nullif(digits, F.lit(""))))
    return F.filter(F.array_distinct(forms), lambda x: x.isNotNull())


def drug_name(c: Column, forms: tuple[str, ...] = ("tab", "tabs", "tablet", "cap", "caps", "capsule", "inj", "soln", "solution", "oral", "iv", "mg", "ml", "mcg")) -> Column:
    """F16: a drug's name without strengths and dose forms: lower-case words of letters, the form words left out."""
    words = F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " ")), " ")
    return F.nullif(F.array_join(F.filter(words, lambda w: ~w.isin(*forms) & (w != "")), " "), F.lit(""))
