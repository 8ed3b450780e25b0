"""Many patterns at once: which of them occur in a row's texts, by Arrow's linear-time regular expressions inside tasks.

Java's matcher tries each alternative at each place, so its time is the text's length times the alternatives of all
patterns; Arrow's (RE2, as DuckDB's) takes one pass a pattern, and a pass for TOGETHER of them where none occurs: each is
searched by itself only in rows that hold one of them. Word bounds are ASCII's. What is found comes back as one
struct of a function that Spark takes as not deterministic, so that conditions on it are not pushed below it, which would
search the texts once more for each of them. Null texts are empty.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE = 1000  # rows whose joined texts are made at once
TOGETHER = 8  # patterns searched as one first


def bounded(pattern: str) -> str:
    """The pattern between ASCII word bounds."""
    return rf"\b(?:{pattern})\b"


def free(pattern: str) -> str:
    """The pattern with {B} as an ASCII word bound."""
    return pattern.replace("{B}", r"\b")


def _groups(tests: list[tuple[str, str, str]]) -> list[tuple[str, list[tuple[str, str]], str]]:
    """The tests of each text, TOGETHER at a time: the text, names and patterns, and the pattern that any of them makes."""
    out = []
    for where in dict.fromkeys(w for _, w, _ in tests):
        own = [(n, p) for n, w, p in tests if w == where]
        parts = [own[k : k + TOGETHER] for k in range(0, len(own), TOGETHER)]
        out += [(where, part, "|".join(f"(?:{p})" for _, p in part)) for part in parts]
    return out


def found(texts: dict[str, Column], tests: list[tuple[str, str, str]], counts: list[tuple[str, str, str]] = (), joined: dict[str, tuple[str, str]] | None = None, starts: dict[str, tuple[str, int]] | None = None) -> Column:
    """A struct of a boolean for each of tests and a long for each of counts (name, text, pattern). Texts are columns by
    name, two of these joined by a space, or the first characters of one of those."""
    names, joined, starts = list(texts), joined or {}, starts or {}
    fields = [pa.field(n, pa.bool_()) for n, _, _ in tests] + [pa.field(n, pa.int64()) for n, _, _ in counts]
    kind = ", ".join([f"{n} boolean" for n, _, _ in tests] + [f"{n} long" for n, _, _ in counts])

    groups = _groups(tests)

    def searched(texts: pa.Array, some: list[tuple[str, str]], whole: str) -> dict[str, pa.Array]:
        """Which texts each pattern occurs in."""
        if len(some) == 1:
            return {n: pc.match_substring_regex(texts, p) for n, p in some}
        hit = pc.match_substring_regex(texts, whole)
        none = pa.repeat(False, len(texts))
        if not hit.true_count:
            return {n: none for n, _ in some}
        left = texts.filter(hit)
        return {n: pc.replace_with_mask(none, hit, pc.match_substring_regex(left, p)) for n, p in some}

    def one(arrays: list[pa.Array]) -> pa.StructArray:
        read = {n: pc.fill_null(a, "") for n, a in zip(names, arrays)}
        for n, (a, b) in joined.items():
            read[n] = pc.binary_join_element_wise(read[a], read[b], " ")
        for n, (a, most) in starts.items():
            read[n] = pc.utf8_slice_codeunits(read[a], 0, most)
        met = {n: m for w, some, whole in groups for n, m in searched(read[w], some, whole).items()}
        made = [met[n] for n, _, _ in tests] + [pc.count_substring_regex(read[w], p).cast(pa.int64()) for _, w, p in counts]
        return pa.StructArray.from_arrays(made, fields=fields)

    def search(*arrays: pa.Array) -> pa.Array:
        parts = [one([a.slice(k, SLICE) for a in arrays]) for k in range(0, len(arrays[0]), SLICE)]
        return pa.concat_arrays(parts) if parts else one(list(arrays))

    return F.arrow_udf(search, kind, F.ArrowUDFType.SCALAR).asNondeterministic()(*texts.values())
