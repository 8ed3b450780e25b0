"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows of the template
are hash-joined, and slots must be filled consistently, so that re-parameterised questions are caught too.

A text's tokens are its runs of letters and of digits. A number is a slot of kind number (thousands marks and decimals
included), a unit word or sign after a number is a slot of kind unit, a capitalised word that begins no sentence is a
slot of kind name; all other words stay, in lower case. A window has WORDS tokens. Where LITERALS at least of them are
words it is hashed as a template, with the slots' kinds; else, as in sums and tables, with what fills the slots, so that
verbatim copies of such passages are found too.

The documents' windows first pass a bitmap of the benchmark's window hashes (sized by their number, 32 MB at most), then
they are joined by hash with the benchmark's windows. Matches on one diagonal (document place minus item place) must fill
the item's slots consistently: one value of the item stands for one value of the document (two values of the item may
become one, as new parameters may coincide). Where a diagonal's fillings clash, its windows with the item's own values
still count. An item is found in a document if its windows matched so cover COVERED of the item's windows, or of its
template windows, or a run of LONG_RUN tokens.

Handling of special cases: null and empty texts have no windows; an item of fewer than WORDS tokens is one window of
them all (LITERALS is then reduced in proportion), and one of fewer than LEAST tokens is not looked for; equal items and
repeated rows are each reported, one row for each pair of doc_id and item_id; null keys are left out; keys may have any
type; very long texts are read whole; columns of other names are not read; an empty benchmark is found nowhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm.common import bounded_batches, mixed, read_table, stored, texts_of, window_hashes, without

WORDS, LITERALS = 8, 5
LEAST = 3
COVERED, LONG_RUN = 0.5, 40
LEAST_BITS, MOST_BITS, BITS_PER_WINDOW = 1 << 20, 1 << 28, 64  # of the bitmap
BLOCK_BITS = 1 << 20

# Words and signs that are units when they follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent pct usd eur gbp dollar dollars euro euros cent cents meter meters metre metres mile miles kilometer kilometers gram grams kilogram kilograms pound pounds liter liters litre litres degree degrees hz khz mhz ghz kb mb gb tb kw mw w v a j kj n pa".split())
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[%$€£°]|[.!?\n]")
NUMBER, UNIT, NAME = "\x01number", "\x01unit", "\x01name"


def template(text: str, begins: bool = True) -> tuple[list[str], dict[int, str]]:
    """The template's tokens, and what fills each slot, by its place. begins: the text begins a sentence."""
    words: list[str] = []
    fills: dict[int, str] = {}
    after_number = False
    for token in TOKEN.findall(text):
        if token.islower():  # most tokens
            if after_number and token in UNITS:
                fills[len(words)] = token
                token = UNIT
            words.append(token)
            begins = after_number = False
            continue
        first = token[0]
        if first in ".!?\n":
            begins, after_number = True, False
            continue
        if first.isdigit():
            fills[len(words)] = token
            words.append(NUMBER)
            after_number, begins = True, False
            continue
        low = token.lower()
        if first in "%$€£°" or after_number and low in UNITS:
            if after_number:
                fills[len(words)] = low
                words.append(UNIT)
            after_number = False
            continue
        if first != low[0] and not begins and (len(token) == 1 or token[1:] == low[1:]):
            fills[len(words)] = low
            words.append(NAME)
        else:
            words.append(low)
        begins = after_number = False
    return words, fills


_hash_of: dict[str, int] = {}


def token_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of tokens; those seen are kept, up to a bound."""
    try:
        return mixed(np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words)))
    except KeyError:
        if len(_hash_of) > 200_000:
            _hash_of.clear()
        for w in words:
            if w not in _hash_of:
                _hash_of[w] = xxhash.xxh64_intdigest(w)
        return mixed(np.fromiter(map(_hash_of.__getitem__, words), np.uint64, len(words)))


def windows(words: list[str], fills: dict[int, str], size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the window at each place, and whether it is a template's: the others hold too many slots, and are
    hashed with what fills them."""
    if len(words) < size or size < LEAST:
        return np.empty(0, np.uint64), np.empty(0, bool)
    literal = np.ones(len(words), np.int64)
    literal[list(fills)] = 0
    sums = np.concatenate([[0], np.cumsum(literal)])
    enough = sums[size:] - sums[:-size] >= -(-LITERALS * size // WORDS)
    hashes = window_hashes(token_hashes(words), size)
    if not enough.all():
        filled = token_hashes([w + fills[i] if i in fills else w for i, w in enumerate(words)])
        hashes = np.where(enough, hashes, window_hashes(filled, size))
    return hashes, enough


def template_windows(texts: DataFrame, key: str, text: str, sizes: tuple[int, ...] | None = None, bitmap: np.ndarray | None = None) -> DataFrame:
    """Rows of id, place, size, exact (no template's), n_windows, n_templates, h and fills of each text's windows.

    sizes: the window lengths; None for a benchmark's items: WORDS, or the whole text where that is shorter, and the
    first window also as it is in the middle of a sentence. bitmap: only windows whose bit is set."""
    bounded_batches(texts)
    bits = np.uint64(8 * len(bitmap) - 1) if bitmap is not None else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, t in zip(b["id"].tolist(), texts_of(b["t"])):
                words, fills = template(t)
                for size in sizes or (min(WORDS, len(words)),):
                    hashes, enough = windows(words, fills, size)
                    total, templates = len(hashes), int(enough.sum())
                    places = np.arange(total)
                    if bitmap is not None and total:
                        bit = hashes & bits
                        hit = bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
                        places = places[hit]
                    for p, h in zip(places.tolist(), hashes[places].view(np.int64).tolist()):
                        rows.append((key, p, size, not enough[p], total, templates, h, [fills.get(i, "") for i in range(p, p + size)]))
                    if sizes is None and total:
                        inner = template(t, False)
                        also, _ = windows(inner[0][:size], {i: v for i, v in inner[1].items() if i < size}, size)
                        if also[0] != hashes[0]:
                            rows.append((key, 0, size, not enough[0], total, templates, int(also.view(np.int64)[0]), [inner[1].get(i, "") for i in range(size)]))
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    schema = T.StructType([T.StructField("id", texts.schema[key].dataType)])
    for name, kind in (("place", T.IntegerType()), ("size", T.IntegerType()), ("exact", T.BooleanType()), ("n_windows", T.IntegerType()), ("n_templates", T.IntegerType()), ("h", T.LongType()), ("fills", T.ArrayType(T.StringType()))):
        schema = schema.add(name, kind)
    return texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("t")).mapInPandas(run, schema)


def bitmap_of(hashes: DataFrame, n: int) -> np.ndarray:
    """A bitmap of the low bits of n hashes, BITS_PER_WINDOW bits for each of them up to MOST_BITS (beyond, more of the
    documents' windows pass it and the join does the work). Tasks make blocks of it, which the driver joins."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_PER_WINDOW).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, own in b.groupby("block"):
                at = own["bit"].to_numpy(np.int64) % BLOCK_BITS
                marks = np.zeros(BLOCK_BITS // 8, np.uint8)
                np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
                yield pd.DataFrame({"block": [block], "marks": [marks.tobytes()]})

    low = hashes.select(F.col("h").bitwiseAND(bits - 1).alias("bit")).distinct().withColumn("block", F.shiftright("bit", BLOCK_BITS.bit_length() - 1))
    out = np.zeros((bits // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for r in low.repartition("block").mapInPandas(run, "block long, marks binary").collect():
        out[r["block"]] |= np.frombuffer(r["marks"], np.uint8)
    return out.ravel()


def contaminated(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Rows of doc_id, item_id, coverage, longest_run (tokens) and reparameterised (a slot has another value)."""
    asked = stored(template_windows(items, item_key, text), "asked")
    sizes = {r["size"]: r["n"] for r in asked.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most WORDS of them
    seen = template_windows(docs, doc_key, text, tuple(sorted(sizes)) or (WORDS,), bitmap_of(asked, sum(sizes.values())))
    met = seen.select(F.col("id").alias("doc_id"), F.col("place").alias("at"), "size", "h", F.col("fills").alias("has")).join(asked.select(F.col("id").alias("item_id"), "place", "size", "exact", "n_windows", "n_templates", "h", "fills"), ["h", "size"])
    met = met.withColumn("diagonal", F.col("at") - F.col("place")).withColumn("same", F.col("fills") == F.col("has")).dropDuplicates(["doc_id", "item_id", "diagonal", "place"])
    met = stored(met, "met")  # read twice below: the slots' and the places' sides
    line = ["doc_id", "item_id", "diagonal"]
    slots = met.select(*line, F.explode(F.filter(F.arrays_zip("fills", "has"), lambda x: x["fills"] != "")).alias("x")).groupBy(*line, F.col("x.fills").alias("value")).agg(F.min("x.has").alias("one"), F.max("x.has").alias("other"))
    clash = slots.groupBy(*line).agg(F.max((F.col("one") != F.col("other")).cast("int")).alias("clash"))
    kept = met.join(clash, line, "left").filter((F.coalesce("clash", F.lit(0)) == 0) | F.col("same"))
    place = F.struct("place", "exact")
    run = kept.groupBy(*line, "size", "n_windows", "n_templates").agg(F.sort_array(F.collect_set(place)).alias("places"), F.max((~F.col("same")).cast("int")).alias("other"))  # an item's places: bounded by its length
    gap = F.col("size")
    longest = F.aggregate("places.place", F.struct(F.lit(-(1 << 30)).alias("first"), F.lit(-(1 << 30)).alias("last"), F.lit(0).alias("best")), lambda a, p: F.when(p - a["last"] <= gap, F.struct(a["first"].alias("first"), p.alias("last"), F.greatest(a["best"], p - a["first"] + gap).alias("best"))).otherwise(F.struct(p.alias("first"), p.alias("last"), F.greatest(a["best"], gap).alias("best"))), lambda a: a["best"])
    per_line = run.select("doc_id", "item_id", "n_windows", "n_templates", "places", longest.alias("longest"), "other")
    pair = per_line.groupBy("doc_id", "item_id", "n_windows", "n_templates").agg(F.array_distinct(F.flatten(F.collect_set("places"))).alias("hit"), F.max("longest").alias("longest_run"), F.max("other").alias("other"))
    templates = F.size(F.filter("hit", lambda x: ~x["exact"]))
    covered = F.greatest(F.size("hit") / F.col("n_windows"), F.coalesce(F.try_divide(templates, F.col("n_templates")), F.lit(0.0)))
    found = pair.withColumn("coverage", covered).filter((F.col("coverage") >= COVERED) | (F.col("longest_run") >= LONG_RUN))
    return found.select("doc_id", "item_id", "coverage", F.col("longest_run").cast("long").alias("longest_run"), (F.col("other") == 1).alias("reparameterised"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, and which."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; those without a key stay."""
    return without(docs, contaminated(docs, read_table(spark, sf_dir, "benchmark")), "doc_id")
