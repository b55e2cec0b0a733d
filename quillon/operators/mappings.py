"""Mapping tables from reference lists and the codes in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.exprs import blank_to_null, class_key, code_variants, drug_name, nonblank, text_token
from quillon.sources.files import range_lookup

from .relational import first_per_key, tiered_lookup

INFECTION_WORDS, SEPSIS_WORDS = ("infection", "infectious"), ("sepsis", "septic", "septicemia", "urosepsis")


def code_inventory(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The distinct code tuples in use and their rows, the most frequent first."""
    filled = None
    for c in columns:
        f = nonblank(F.col(c).cast("string"))
        filled = f if filled is None else filled | f
    return rows.where(filled).groupBy(*columns).agg(F.count("*").alias("row_count")).orderBy(F.desc("row_count"), *[F.col(c).asc_nulls_last() for c in columns])


def says_sepsis(token: Column) -> Column:
    """One of the words of a normalised text token says sepsis."""
    return F.coalesce(F.arrays_overlap(F.split(token, "_"), F.array(*[F.lit(w) for w in SEPSIS_WORDS])), F.lit(False))


def concept_labels(names: DataFrame, order: list[str]) -> DataFrame:
    """Of each concept's names (concept, kind, name), the one of the first kind in the order; ties by text."""
    place = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    held = names.where(F.col("kind").isin(*order) & nonblank(F.col("name"))).withColumn("__p", place)
    return first_per_key(held, ["concept"], [F.col("__p"), F.col("name")]).select("concept", F.trim("name").alias("label"))


def choose_per_code(candidates: DataFrame, code: str, preferences: list[Column], texts: list[str]) -> DataFrame:
    """One row for each code, by the preferences (true first), then by text."""
    order = [p.desc_nulls_last() for p in preferences] + [F.col(t).asc_nulls_last() for t in texts]
    return first_per_key(candidates, [code], order)


def code_mapping(codes: DataFrame, code_to_concept: DataFrame, concept_to_class: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Codes (code) with concept and class: every form of a code is looked up (17-digit forms by equality, not by
    trying each code against the list); a code without a concept takes the fallback's. One row for each code, those
    with a class first."""
    own = codes.where(nonblank(F.col("code"))).select("code").distinct()
    forms = own.withColumn("form", F.explode(code_variants(F.col("code"))))
    named = forms.join(code_to_concept.select(F.col("code").alias("form"), "concept"), "form").join(concept_to_class, "concept", "left")
    best = choose_per_code(named, "code", [F.col("class").isNotNull()], ["concept", "class"]).select("code", "concept", "class")
    out = own.join(best, "code", "left").withColumn("method", F.when(F.col("concept").isNotNull(), "reference"))
    if fallback is not None:
        old = first_per_key(fallback, ["code"], [F.col("concept").asc_nulls_last(), F.col("class").asc_nulls_last()]).select("code", F.col("concept").alias("__c"), F.col("class").alias("__k"))
        takes = F.col("concept").isNull() & F.col("__c").isNotNull()
        out = out.join(old, "code", "left").withColumn("method", F.when(takes, "existing").otherwise(F.col("method")))
        out = out.withColumns({"class": F.when(F.col("concept").isNull(), F.col("__k")).otherwise(F.col("class")), "concept": F.coalesce("concept", "__c")}).drop("__c", "__k")
    return out.withColumn("method", F.coalesce("method", F.lit("unmapped")))


def name_mapping(drugs: DataFrame, by_list: DataFrame, by_group: DataFrame, by_name: DataFrame) -> DataFrame:
    """Drugs (list_code, group_code, name) mapped by list code, else group code, else the name without forms
    and strengths."""
    held = drugs.withColumn("drug_token", drug_name(F.col("name")))
    names = by_name.withColumn("drug_token", drug_name(F.col("name"))).where("drug_token is not null").select("drug_token", "concept")
    blank = lambda df, c: df.withColumn(c, blank_to_null(F.col(c).cast("string")))
    tiers = [("list", ["list_code"], blank(by_list, "list_code")), ("group", ["group_code"], blank(by_group, "group_code")), ("name", ["drug_token"], names)]
    return tiered_lookup(blank(blank(held, "list_code"), "group_code"), tiers, "concept")


def graded_mapping(codes: DataFrame, references: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """D53 without its remote lookups: codes (code, name) mapped by the first reference (name, confidence, table of code
    and concept) that knows a form of the code."""
    forms = codes.select("code", F.explode(code_variants(F.col("code"))).alias("form"))
    found = None
    for place, (name, confidence, table) in enumerate(references):
        own = forms.join(table.select(F.col("code").alias("form"), "concept"), "form").select("code", "concept", F.lit(name).alias("reference"), F.lit(confidence).alias("confidence"), F.lit(place).alias("__p"))
        found = own if found is None else found.union(own)
    best = first_per_key(found, ["code"], [F.col("__p"), F.col("concept")]).drop("__p")
    return codes.join(best, "code", "left").withColumn("confidence", F.coalesce("confidence", F.lit("unmapped")))


def chapter_rows(codes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The chapter of each three-character category, from ranges (low, high, chapter)."""
    held = codes.select(F.left(F.upper(F.trim("code")), F.lit(3)).alias("category")).where("category <> ''").distinct()
    return range_lookup(held, "category", ranges, "low", "high", "chapter")


def infection_token(text: Column) -> Column:
    """A text's token and whether it speaks of infection or sepsis."""
    token = text_token(text)
    return F.struct(token.alias("token"), (says_sepsis(token) | F.coalesce(F.arrays_overlap(F.split(token, "_"), F.array(*[F.lit(w) for w in INFECTION_WORDS])), F.lit(False))).alias("infection"))


def name_candidates(drugs: DataFrame, names: DataFrame) -> DataFrame:
    """(drug, concept, shared, grade): of each drug (drug, name) the concepts of the reference names (concept, name) whose words all
    stand in its own name, forms and strengths left out: `same` if they are all its words, else `part`.

    A reference name is indexed under the rarest of its words only (ties by text), so a word that most names have joins
    few rows; whether all its words are there is seen from the two arrays. Names without words match nothing.
    """
    words = lambda c: F.array_distinct(F.split(drug_name(F.col(c)), " "))
    refs = names.select("concept", words("name").alias("of")).where("concept is not null and size(of) > 0").distinct()
    often = refs.select(F.explode("of").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rare = refs.select("concept", "of", F.explode("of").alias("word")).join(often, "word").groupBy("concept", "of").agg(F.min(F.struct("n", "word")).alias("w"))
    own = drugs.select("drug", words("name").alias("has")).where("size(has) > 0").distinct()
    met = own.select("drug", "has", F.explode("has").alias("word")).join(rare.select("concept", "of", F.col("w.word").alias("word")), "word")
    met = met.where(F.size(F.array_except("of", "has")) == 0)
    grade = F.when(F.size("of") == F.size("has"), "same").otherwise("part")
    best = met.groupBy("drug", "concept").agg(F.max(F.struct(F.size("of").cast("long").alias("shared"), grade.alias("grade"))).alias("b"))
    return best.select("drug", "concept", "b.shared", "b.grade")


def graded_codes(codes: DataFrame, concepts: DataFrame, classes: DataFrame, ingredients: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """D53 without its remote half: a row for each code (code, name; of repeated codes the least name) with concept, ingredient, class,
    source, confidence and status.

    The concept is that of the first of the code's forms that concepts (code, concept) knows, of several the least; else, with
    names (concept, name), that of the name that shares most words with its own (name_candidates; ties by concept). The
    class (three levels: four characters) is the least of the concept in classes (concept, class), else the least of its
    ingredient's, by ingredients (concept, ingredient, ingredient_concept; the least row). Confidence: unmapped; high by a
    code with one class, medium with several or none; by all words of a name medium, by some low.
    """
    own = codes.where(nonblank(F.col("code"))).groupBy("code").agg(F.min("name").alias("name"))
    forms = own.select("code", F.posexplode(code_variants(F.col("code"))).alias("at", "form"))
    known = concepts.where("code is not null and concept is not null").groupBy(F.col("code").alias("form")).agg(F.min("concept").alias("concept"))
    by_code = forms.join(known, "form").groupBy("code").agg(F.min_by("concept", "at").alias("by_code"))
    held = own.join(by_code, "code", "left")
    if names is not None:
        near = name_candidates(held.where("by_code is null").select(F.col("code").alias("drug"), "name"), names)
        order = F.struct((-F.col("shared")).alias("s"), "concept")
        held = held.join(near.groupBy(F.col("drug").alias("code")).agg(F.min_by(F.struct("concept", "grade"), order).alias("near")), "code", "left")
    else:
        held = held.withColumn("near", F.lit(None).cast("struct<concept string, grade string>"))
    held = held.select("code", "name", F.coalesce("by_code", "near.concept").alias("concept"), F.when(F.col("by_code").isNotNull(), "code").otherwise(F.col("near.grade")).alias("how"))
    of = classes.where("concept is not null and class is not null").groupBy("concept").agg(F.min("class").alias("class"), F.count_distinct("class").alias("n"))
    held = held.join(of, "concept", "left")
    if ingredients is not None:
        parts = ingredients.where("concept is not null").groupBy("concept").agg(F.min(F.struct("ingredient", "ingredient_concept")).alias("part"))
        held = held.join(parts, "concept", "left").join(of.select(F.col("concept").alias("__i"), F.col("class").alias("__c"), F.col("n").alias("__n")), F.col("part.ingredient_concept") == F.col("__i"), "left")
    else:
        held = held.withColumns({"part": F.lit(None).cast("struct<ingredient string, ingredient_concept string>"), "__c": F.lit(None).cast("string"), "__n": F.lit(None).cast("long")})
    c, none = F.col, F.lit(None).cast("string")
    several = F.coalesce("n", "__n") > 1
    # The sources, confidences and statuses.
    by = F.when(c("how") == "code", "code").when(c("how").isNotNull(), "name")
    by_class = F.when(c("class").isNotNull(), "class").when(c("__c").isNotNull(), "class(ingredient)")
    confidence = F.when(c("how").isNull(), "unmapped").when(c("how") == "part", "low").when((c("how") == "same") | several | F.coalesce("class", "__c").isNull(), "medium").otherwise("high")
    status = F.when(c("how").isNull(), "unmapped_code_to_concept").when(F.coalesce("class", "__c").isNotNull(), "mapped_concept_class").otherwise("mapped_concept_missing_class")
    source = F.when(c("how").isNotNull(), F.concat_ws(";", by, by_class)).otherwise(none)
    return held.select("code", "name", "concept", c("part.ingredient").alias("ingredient"), class_key(F.coalesce("class", "__c")).alias("class"), source.alias("source"), confidence.alias("confidence"), status.alias("status"))
