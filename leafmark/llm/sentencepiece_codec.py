"""SentencePiece encoding and decoding (merge-type models) with a last-token table over text prefixes.

For merge-type vocabularies the encoding of every prefix of a text ends in one certain token. The table holds that
token for each prefix: of the vocabulary pieces which an Aho-Corasick automaton finds ending there, it is the one
that the last token of the text before it stays apart from (a pair is compatible if encoding its joined text gives
the pair back). Ids are then read from the end of the table backwards.

Handling of special cases, which is that of the sentencepiece library: a null or empty text has no ids and decodes
to the empty text; characters outside the vocabulary become byte pieces; very long texts are encoded whole; equal
texts get equal ids; columns of other names are left as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from leafmark.llm.common import bounded_batches, read_table, texts_of

SPACE_MARK = "▁"
CHUNK_LIMIT, PAIR_LIMIT = 150_000, 600_000  # what a Python worker keeps: about 40 and 80 MB
FRAME_CHARS = 1 << 21  # of text, in one frame that a task sends back


class MergeCodec:
    """Encoder and decoder of one merge-type model."""

    def __init__(self, model_path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
        self.scores = [model.get_score(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if plain[i]}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = model.unk_id()
        self.hidden = {i for i in range(n) if model.is_control(i)}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after a letter: texts can't be cut at space marks")
        if [model.encode("  a ﬁ "), model.encode("")] != [self._reference_probe("  a ﬁ "), []]:
            raise ValueError("only models with identity normalisation and a leading space mark are supported")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.text_of = [self._shown(i) for i in range(n)]

    def _reference_probe(self, text: str) -> list[int]:
        return [i for c in (SPACE_MARK + text.replace(" ", SPACE_MARK)).split("\0") for i in self.merged(c)]

    def merged(self, text: str) -> list[int]:
        """Ids by merging the best pair again and again: the definition, used on pairs of pieces and in tests."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = self.ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return [i for p in parts for i in self._single(p)]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _single(self, piece: str) -> list[int]:
        k = self.ids.get(piece)
        if k is not None:
            return [k]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def apart(self, left: int, right: int) -> bool:
        """True if the pair stays a pair when its text is encoded; left is -1 at the start of a text."""
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if left < 0:
                known = self.merged(self.pieces[right]) == [right]
            else:
                known = self.merged(self.pieces[left] + self.pieces[right]) == [left, right]
            if len(self.pairs) >= PAIR_LIMIT:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Ids of a text without a space mark after a letter."""
        last = [None] * len(chunk)
        pairs, apart = self.pairs, self.apart
        for end, (size, token) in self.automaton.iter(chunk):
            if last[end] is not None:
                continue
            start = end - size
            left = last[start] if start >= 0 else None
            if left is None:  # the start, or a character in no piece, which nothing joins
                left = -1
            ok = pairs.get(left << 24 | token)
            if apart(left, token) if ok is None else ok:
                last[end] = token
        out: list[int] = []
        at = len(chunk) - 1
        while at >= 0:
            token = last[at]
            if token is None:
                out += self._single(chunk[at])[::-1]
                at -= 1
            else:
                out.append(token)
                at -= len(self.pieces[token])
        return tuple(out[::-1])

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of each chunk in order; chunks begin at a space mark that follows another character."""
        known = self.chunks
        for word in _chunks(text):
            ids = known.get(word)
            if ids is None:
                ids = self.chunk_ids(word)
                if len(word) <= 64:
                    if len(known) >= CHUNK_LIMIT:
                        known.clear()
                    known[word] = ids
            yield ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []

    def _shown(self, i: int) -> str | None:
        if i in self.hidden:
            return ""
        if i == self.unknown:
            return " ⁇ "
        return None if i in self.byte_of else self.pieces[i].replace(SPACE_MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte pieces join to characters (bytes that are no character become U+FFFD each), and
        the space mark put before the text when it was encoded goes."""
        texts = [self.text_of[i] for i in ids]
        if None in texts:
            out, run = [], bytearray()
            for i, t in zip(ids, texts):
                if t is None:
                    run.append(self.byte_of[i])
                    continue
                if run:
                    out.append(_characters(run))
                    run = bytearray()
                out.append(t)
            if run:
                out.append(_characters(run))
            shown = "".join(out)
        else:
            shown = "".join(texts)
        first = next((t for t in texts if t != ""), "")
        return shown[1:] if first and first[0] == " " and first != self.text_of[self.unknown] else shown


def _characters(run: bytearray) -> str:
    """UTF-8 with one U+FFFD for each byte that belongs to no character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(bytes(run[i : i + n]).decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


def _chunks(text: str) -> Iterator[str]:
    """The marked text cut before each run of space marks: a run stays with the word after it."""
    words = (" " + text).split(" ")
    lead = ""
    for w in words[1:]:
        if w:
            yield lead + SPACE_MARK + w
            lead = ""
        else:
            lead += SPACE_MARK
    if lead:
        yield lead


_codecs: dict[str, MergeCodec] = {}


def codec(model_path: str) -> MergeCodec:
    """One codec for each model and Python worker."""
    if model_path not in _codecs:
        _codecs[model_path] = MergeCodec(model_path)
    return _codecs[model_path]


def frames(batches: Iterator[pd.DataFrame], text: str) -> Iterator[pd.DataFrame]:
    """The batches cut into frames of about FRAME_CHARS of text, so that what a task adds to them stays bounded."""
    for b in batches:
        sizes = np.cumsum([len(t) for t in texts_of(b[text])])
        for _, frame in b.groupby(sizes // FRAME_CHARS, sort=False):
            yield frame


def encode_and_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str = "decoded") -> DataFrame:
    """The columns of docs without text, and ids (array of int), n_tokens and decoded, the text of the ids.

    Each row is encoded and decoded where it lies, in one pass and without a shuffle; columns of docs with the names
    of new ones are replaced."""
    bounded_batches(docs)
    kept = [f for f in docs.schema.fields if f.name not in (text, ids, n_tokens, decoded)]
    names = [f.name for f in kept]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        for b in frames(batches, text):
            found, shown = [], []
            for t in texts_of(b[text]):
                got = c.encode(t)
                shown.append(c.decode(got))
                found.append(np.array(got, np.int32))
            out = b[names].copy()
            out[ids], out[n_tokens], out[decoded] = found, [len(x) for x in found], shown
            yield out

    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(n_tokens, T.LongType()), T.StructField(decoded, T.StringType())]
    return docs.select(*names, text).mapInPandas(run, T.StructType([*kept, *added]))


def round_trip_digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text and returns key, n_tokens and the digests of ids and decoded text.

    The ids stay inside the task, so that only digests travel.
    """
    bounded_batches(docs)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model_path)
        for b in frames(batches, text):
            rows = []
            for k, t in zip(b[key].tolist(), texts_of(b[text])):
                got = c.encode(t)
                listed = repr(got)[1:-1].replace(" ", "")
                rows.append((k, len(got), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(c.decode(got).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    return docs.select(key, text).mapInPandas(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents."""
    import public_tokenizers

    return round_trip_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document's ids and their number, and in place of its text the text decoded from the ids."""
    import public_tokenizers

    return encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
