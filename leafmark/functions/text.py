"""Text functions as Column expressions: built-in functions only, null texts count as empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark import config as C


def clean_text(c: Column) -> Column:
    """White space collapsed, zero-width characters dropped, trimmed."""
    v = F.regexp_replace(F.coalesce(c, F.lit("")), C.SPACES_JAVA, " ")
    for mark in C.ZERO_WIDTH_MARKS:  # found by their bytes, which is cheaper than a pattern
        v = F.replace(v, F.lit(mark), F.lit(""))
    return F.trim(v)


def let(value: Column, use) -> Column:
    """use(value), the value made once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def count_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(C.WORD_JAVA)).cast("long")


def has(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs between ASCII word bounds, in any case."""
    return F.lower(F.coalesce(c, F.lit(""))).rlike(C.bounded(pattern))


def half_up(x: Column, digits: int = 3) -> Column:
    """Rounding with floor(x + 0.5), as ECMAScript does."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def _term(t: Column) -> Column:
    """The term of a raw token: a token begins with a letter or digit, so only its end may need trimming."""
    return F.lower(F.rtrim(t, F.lit("_./-")))


def _technical(t: Column) -> Column:
    return ~t.rlike(C.PLAIN_TOKEN) & t.rlike(C.TECHNICAL)


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(C.TOKEN_JAVA), 0)


def tokens(c: Column, most: int | None = None) -> Column:
    """Terms in order: array of struct(term, weight); technical terms weigh 1.25. most: only so many first ones."""
    made = F.transform(raw_tokens(c), lambda t: F.struct(_term(t).alias("term"), F.when(_technical(t), 1.25).otherwise(1.0).alias("weight")))
    kept = F.filter(made, lambda t: ((F.length(t["term"]) >= 3) | (t["weight"] > 1)) & ~t["term"].isin(C.STOP_WORDS))
    return kept if most is None else F.slice(kept, 1, most)


def exploded_tokens(rows: DataFrame, *keep: str, text: str) -> DataFrame:
    """A row for each term of each row's text, with the columns keep, term and weight: tokens() in compiled code."""
    return terms_of(rows.select(*keep, F.explode(raw_tokens(F.col(text))).alias("t"))).select(*keep, "term", "weight")


def terms_of(raw: DataFrame, always: Column | None = None) -> DataFrame:
    """Rows of raw tokens (t) with term and weight in the place of t, without those that are no terms unless always holds."""
    others = [c for c in raw.columns if c != "t"]
    kept = lambda term, weight: ((F.length(term) >= 3) | (weight > 1)) & ~term.isin(C.STOP_WORDS)
    term, weight = _term(F.col("t")), F.when(_technical(F.col("t")), 1.25).otherwise(1.0)
    stays = kept(term, weight) if always is None else always | kept(term, weight)
    return raw.filter(stays).select(*others, term.alias("term"), weight.alias("weight"))


def term_set(c: Column, most: int | None = None) -> Column:
    return F.array_distinct(F.transform(tokens(c, most), lambda t: t["term"]))


def repeats(c: Column) -> Column:
    """How many sentences of 18 to 180 characters begin, in their first 90, as one before; 0 for fewer than four."""
    return _repeated(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?][ \n\t\r]+|\n+"), lambda p: F.lower(clean_text(p))))


def repeats_of_clean(low: Column) -> Column:
    """repeats() of a text from clean_text() in lower case: its parts are clean once runs of spaces, which zero-width
    characters leave behind, are one."""
    single = F.when(F.contains(low, F.lit("  ")), F.regexp_replace(low, "  +", " ")).otherwise(low)
    return _repeated(F.transform(F.split(single, "[.!?] +"), lambda p: F.trim(p)))


def _repeated(sentences: Column) -> Column:
    keys = F.transform(F.filter(sentences, lambda p: F.length(p).between(18, 180)), lambda p: F.substring(p, 1, 90))
    return let(keys, lambda k: F.when(F.size(k) >= 4, F.size(k) - F.size(F.array_distinct(k))).otherwise(0)).cast("long")


def hash_text(c: Column) -> Column:
    """31-multiplier signed 32-bit hash over UTF-16 units, its absolute value in base 36."""
    codes = F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda x: F.ascii(x).cast("long"))
    low, high = F.lit(0xDC00), F.lit(0xD800 - 0x40)  # of the two units of a code point beyond the basic plane
    pair = lambda a, x: (a * 31 + high + F.shiftright(x, 10)) * 31 + low + x.bitwiseAND(0x3FF)
    wrapped = F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: F.pmod(F.when(x < 0x10000, a * 31 + x).otherwise(pair(a, x)), F.lit(1 << 32)))
    return F.lower(F.conv(F.abs(F.when(wrapped >= 1 << 31, wrapped - (1 << 32)).otherwise(wrapped)).cast("string"), 10, 36))


def _undouble(c: Column) -> Column:
    last, before = F.substring(c, -1, 1), F.substring(c, -2, 1)
    return F.when((F.length(c) >= 4) & (last == before) & ~last.rlike("[aeiou]"), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)


def stem(c: Column) -> Column:
    """Conservative word-form stem; technical and short words stay."""
    v = F.lower(F.coalesce(c, F.lit("")))
    n = F.length(v)
    cut = lambda k: v.substr(F.lit(1), n - k)
    irregular = F.create_map(*[F.lit(x) for kv in C.IRREGULAR_STEMS.items() for x in kv])
    ruled = (
        F.when((n > 5) & v.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 6) & v.endswith("ing"), _undouble(cut(3)))
        .when((n > 5) & v.endswith("ed"), _undouble(cut(2)))
        .when((n > 5) & v.endswith("es"), cut(2))
        .when((n > 4) & v.endswith("s"), cut(1))
        .otherwise(v)
    )
    return F.when((n < 4) | v.rlike("[0-9_./+#-]"), v).otherwise(F.coalesce(F.try_element_at(irregular, v), ruled))


def trigrams(c: Column) -> Column:
    v = F.concat(F.lit("  "), F.coalesce(c, F.lit("")), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(v) - 2), lambda i: v.substr(i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over the larger set's size."""
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y))


def are_synonyms(a: Column, b: Column) -> Column:
    """Whether two different terms stand in one group of synonyms."""
    groups = F.create_map(*(F.lit(x) for i, g in enumerate(C.SYNONYMS) for w in g for x in (w, i)))
    return F.coalesce((F.try_element_at(groups, a) == F.try_element_at(groups, b)) & (a != b), F.lit(False))


def is_minor_typo(a: Column, b: Column) -> Column:
    """One substitution, insertion, deletion or adjacent transposition between words of seven letters or more with
    the same first letter and different stems that aren't synonyms."""
    n, m = F.length(a), F.length(b)
    at = F.aggregate(F.sequence(F.lit(1), F.least(n, m)), F.lit(0), lambda s, i: F.when((s == 0) & (a.substr(i, F.lit(1)) != b.substr(i, F.lit(1))), i).otherwise(s))
    swapped = F.concat(a.substr(F.lit(1), at - 1), a.substr(at + 1, F.lit(1)), a.substr(at, F.lit(1)), a.substr(at + 2, n))
    near = (F.levenshtein(a, b) <= 1) | ((n == m) & (at > 0) & (swapped == b))
    return (n >= 7) & (m >= 7) & (a != b) & (F.abs(n - m) <= 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & (stem(a) != stem(b)) & ~are_synonyms(a, b) & near


def ocr_comparable(c: Column) -> Column:
    """Lower case, hyphens at line ends joined, all else but letters and digits a single space."""
    v = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"-[ \t\n\r\f]+", "")
    return F.trim(F.regexp_replace(v, "[^a-z0-9]+", " "))


def ocr_term(c: Column) -> Column:
    """Glyphs that recognition confuses become one: 0 is o, i and 1 are l, rn is m."""
    v = F.translate(F.lower(F.coalesce(c, F.lit(""))), "0i1", "oll")
    return F.regexp_replace(F.regexp_replace(v, "rn", "m"), "[^a-z0-9]+", "")


def shortened(c: Column, most: int) -> Column:
    """At most `most` characters, the last three of a longer text being dots."""
    v = F.regexp_replace(clean_text(c), "^#+ *", "")
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.rtrim(v.substr(1, most - 3)), F.lit("...")))


def snippet(text: Column, terms: Column) -> Column:
    """A window from before the first term found, with ellipses where it is cut."""
    v = clean_text(text)
    first = F.element_at(F.concat(F.filter(F.transform(terms, lambda t: F.instr(F.lower(v), t)), lambda i: i > 0), F.array(F.lit(1))), 1)
    start = F.greatest(F.lit(0), first - 1 - C.SNIPPET_LEAD)
    end = F.least(F.length(v), start + C.SNIPPET_CHARS)
    return F.concat(F.when(start > 0, "... ").otherwise(""), F.trim(v.substr(start + 1, end - start)), F.when(end < F.length(v), " ...").otherwise(""))
