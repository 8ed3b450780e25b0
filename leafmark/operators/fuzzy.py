"""Fuzzy join of recognised terms: the words of a vocabulary that a term may stand for, as recognition misreads them.

A pair matches if its glyph-normal forms are equal, are within an edit distance (1; 2 for words of LONG letters), or share
enough trigrams. No pair is looked at that has nothing in common: equal forms meet by themselves, forms within a distance k
share a form with up to k letters left out, and trigram sets that are alike enough share one of their rarest trigrams,
so many of which each word sends that a pair can't miss. Candidates meet by key, once for each pair, and are verified.

Null terms match nothing; a term doesn't match itself; ties are all kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.functions import text as T

# The shortest terms that may match, the length from which two edits are allowed, and the least likeness.
SHORT, LONG, LIKENESS = 4, 10, 0.78
MOST_LONGER = 2  # letters that one form may have more than the other
GLYPHS, EDITS, TRIGRAMS = "ocr-glyph-normalized", "edit-distance", "trigram"


def _without_one(forms: Column) -> Column:
    """All forms with one letter left out."""
    cut = lambda v: F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.concat(v.substr(F.lit(1), i - 1), v.substr(i + 1, F.length(v))))
    return F.array_distinct(F.flatten(F.transform(F.filter(forms, lambda v: F.length(v) > 0), cut)))


def deletions(form: Column) -> Column:
    """The form with up to one letter left out, or two if it may match one of LONG letters."""
    once = _without_one(F.array(form))
    twice = F.when(F.length(form) >= LONG - MOST_LONGER, _without_one(once)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(form), once, twice))


def _rarest(words: DataFrame, counts: DataFrame) -> DataFrame:
    """term, form and key: the rarest trigrams of each form, one more than those that a pair alike enough may lack."""
    each = words.select("term", "form", F.explode(T.trigrams(F.col("form"))).alias("key")).join(counts, "key", "left")
    sets = each.groupBy("term", "form").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("keys"))
    size = F.size("keys")
    return sets.select("term", "form", F.explode(F.slice("keys", F.lit(1), (size - F.ceil(size * LIKENESS) + 1).cast("int"))).alias("x")).select("term", "form", "x.key")


def fuzzy_matches(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, other, method, distance, strength: the words other of vocabulary (term) that each of terms (term) may stand for."""
    normal = lambda rows: rows.select("term").filter(F.length("term") >= SHORT).distinct().withColumn("form", T.ocr_term(F.col("term"))).filter("form <> ''")
    asked, known = normal(terms), normal(vocabulary)
    right = lambda rows: rows.select(F.col("term").alias("other"), F.col("form").alias("other_form"), "key")
    by_edit = lambda rows: rows.select("term", "form", F.explode(deletions(F.col("form"))).alias("key"))
    met = by_edit(asked).join(right(by_edit(known)), "key").drop("key")
    counts = known.select(F.explode(T.trigrams(F.col("form"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    met = met.unionByName(_rarest(asked, counts).join(right(_rarest(known, counts)), "key").drop("key"))
    pairs = met.filter((F.col("term") != F.col("other")) & (F.abs(F.length("form") - F.length("other_form")) <= MOST_LONGER)).distinct()
    n, m = F.length("form"), F.length("other_form")
    distance = F.levenshtein("form", "other_form", 2)
    near = (distance >= 0) & (distance <= F.when(F.greatest(n, m) >= LONG, 2).otherwise(1)) & ((F.least(n, m) > SHORT) & (n != SHORT) & (m != SHORT) | (distance == 1))
    judged = pairs.withColumn("near", near & (distance > 0)).withColumn("edits", distance).withColumn("likeness", T.trigram_similarity(F.col("form"), F.col("other_form")))
    same, like = F.col("form") == F.col("other_form"), (F.least(n, m) > SHORT) & (F.col("likeness") >= LIKENESS) & ((distance < 0) | (distance > F.when(F.greatest(n, m) >= LONG, 2).otherwise(1)))
    method = F.when(same, GLYPHS).when(F.col("near"), EDITS).when(like, TRIGRAMS)
    strength = F.when(same, 0.66).when(F.col("near"), F.greatest(F.lit(0.42), 0.74 - F.col("edits") * 0.14)).otherwise(F.greatest(F.lit(0.36), F.col("likeness") * 0.58))
    found = judged.withColumn("method", method).filter("method is not null")
    return found.select("term", "other", "method", F.when(F.col("method") == EDITS, F.col("edits")).otherwise(0).cast("long").alias("distance"), T.half_up(strength).alias("strength"))


def best_matches(matches: DataFrame) -> DataFrame:
    """Of fuzzy_matches() each term's strongest word; of equals the first in alphabetical order."""
    best = matches.groupBy("term").agg(F.min(F.struct((-F.col("strength")).alias("s"), "other", "method", "distance")).alias("x"), F.count(F.lit(1)).alias("candidates"))
    return best.select("term", "x.other", "x.method", "x.distance", (-F.col("x.s")).alias("strength"), "candidates")
