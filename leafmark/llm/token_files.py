"""Token ids in binary files: independent zstandard frames with a trailing seek table and per-frame checksums.

File layout: data frames, each with the ids (little-endian unsigned 32 bits) of whole documents and zstandard's own
content checksum; a skippable frame with the document index (doc ids and token counts, zstandard-compressed with a
checksum); a skippable frame with the seek table of the public zstandard seekable format (compressed size, plain
size and checksum of each frame), which ends the file. A reader takes the table and the index and decompresses only
the frames that hold the documents it wants.

Handling of special cases: a null or empty text has the end id only; rows with equal ids stay next to each other,
ordered by text; null ids come first; very long documents fill frames of their own; an empty table writes no file.
The formats' counts are unsigned 32 bits: a document of over 2^30 - 1 ids, or a file of over 4 GB in one frame, is
refused with an error. Files are named by their place in the order and moved into place when complete, so a repeated task replaces its file.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.llm.common import MOST_BUCKETS, bounded_batches, bucket_of, cut_points, fresh_path, read_table, stored, texts_of

FRAME_BYTES = 1 << 18
SKIPPABLE_INDEX, SKIPPABLE_SEEK = 0x184D2A50, 0x184D2A5E  # fixed values of the zstandard formats
SEEK_MAGIC = 0x8F92EAB1  # fixed value of the seekable format
KEPT = 400_000
GROUP_CHARS = 1 << 23
FIRST = " "  # marks a text's first piece, which no space precedes; others hold none
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
PLAIN = rf"\A(?P<word>[{LETTERS}]+)(?P<marks>[!-&(-/:-@\[-`{{-~]*)\z"  # letters, then marks but the apostrophe: the pattern cuts between them only


class ByteEncoder:
    """Ids of the tokenizers library, for texts cut where its pattern always cuts: before a space between characters
    that are no white space. A piece is what follows such a space. Arrow cuts a group of about GROUP_CHARS and numbers its
    different pieces; new ones are encoded together as one string, and told apart by the tokens that begin with a space,
    which only a piece's first token does. Plain pieces, nearly all, reach the library's model already cut and in its
    byte characters, which spares its pattern and its alignments.

    The ids of pieces are kept in two generations of at most KEPT each: a piece met again moves to the young one, and
    when that is full it becomes the old one. Texts with a piece that shows white space beside white space, a special
    token, or a mark that others read as white space, stay uncut.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        self.library = Tokenizer.from_file(path)
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        if any(" " in t for t in special):
            raise ValueError("a special token holds a space: texts can't be cut at spaces")
        self.uncut = re.compile("|".join([r"\A\s|\s\Z|\s\s|\A\Z|[\x1c-\x1f]", *map(re.escape, special)]))
        self.leads = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.leads[i] = token[0] == "\u0120"  # a space, in byte-level vocabularies
        form = json.loads(self.library.to_str())
        cut = form["pre_tokenizer"] or {}
        usual = form["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
        self.plain = PLAIN if usual and not any(re.fullmatch(rf"[{LETTERS}]*[!-/:-@\[-`{{-~]*", t) for t in special) else None
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in such vocabularies
        self.byte_chars = np.zeros(256, np.uint32)
        self.byte_chars[shown] = shown
        self.byte_chars[[i for i in range(256) if i not in shown]] = np.arange(256, 512 - len(shown))
        self.byte_chars[0x0A] = 0x0A  # parts the words
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        out, group, size = [], [], 0
        for t in texts:
            group.append(t)
            size += len(t)
            if size >= GROUP_CHARS:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        if len(self.young) > KEPT:
            self.old, self.young = self.young, {}
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        begin = cut.offsets.to_numpy().astype(np.int64)
        numbered = cut.flatten().dictionary_encode()
        seq = numbered.indices.to_numpy().copy()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = {}  # numbers of first pieces
        seq[begin[:-1]] = [own.setdefault(FIRST + pieces[i], len(pieces) + len(own)) for i in seq[begin[:-1]].tolist()]
        pieces += own
        used = np.zeros(len(pieces), bool)
        used[seq] = True
        found = list(map(self.young.get, pieces))
        absent = [i for i, ids in enumerate(found) if ids is None]
        missing = [i for i, u in zip(absent, used[absent].tolist()) if u]
        learned = self._learn([pieces[i] for i in missing]) if missing else {}
        for i in absent:
            found[i] = b""
        lacks = np.zeros(len(pieces), bool)
        for i in missing:
            if (ids := learned.get(pieces[i])) is None:
                lacks[i] = pieces[i] != FIRST  # of empty texts, and of those that begin with a space
            else:
                found[i] = ids
        blob = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        each = sizes[seq]
        at = np.concatenate([[0], np.cumsum(each)])
        ids = blob[np.repeat((np.cumsum(sizes) - sizes)[seq] - at[:-1], each) + np.arange(at[-1])]
        whole = np.add.reduceat(lacks[seq], begin[:-1], dtype=np.int64) > 0
        bounds = at[begin].tolist()
        return [np.frombuffer(self._ids([texts[i]])[0], np.uint32) if w else ids[a:z] for i, (w, a, z) in enumerate(zip(whole.tolist(), bounds, bounds[1:]))]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of different pieces that the young generation doesn't have, where they can be cut out; moves the short
        ones there."""
        learned = {c: ids for c in new if (ids := self.old.get(c)) is not None}
        fresh = [c for c in new if c not in learned]
        if self.plain and fresh:
            fresh = self._learn_plain(fresh, learned)
        fresh = [c for c in fresh if not self.uncut.search(c, c[:1] == FIRST)]
        first = [c for c in fresh if c[0] == FIRST and len(c) > 1]
        learned.update(zip(first, self._ids([c[1:] for c in first])))
        others = [c for c in fresh if c[0] != FIRST]
        if others:
            learned.update(self._parted(others, self._ids([" " + " ".join(others)])[0]))
        self.young.update(learned)
        for c in [c for c in learned if len(c) > 48]:
            del self.young[c]
        return learned

    def _learn_plain(self, fresh: list[str], learned: dict[str, bytes]) -> list[str]:
        """Adds the ids of the plain pieces to learned; returns the other pieces."""
        parts = pc.extract_regex(pa.array(fresh, pa.large_string()), self.plain)
        fits = parts.is_valid()
        word, marks = (parts.field(k).filter(fits) for k in (0, 1))
        if not len(word):
            return fresh
        space, line, none = (pa.scalar(c, pa.large_string()) for c in (" ", "\n", ""))
        shown = pc.binary_join_element_wise(space, word, line, marks, line, none)
        sent = self.byte_chars[np.frombuffer(shown.buffers()[2], np.uint8, int(pc.sum(pc.binary_length(shown)).as_py()))]
        fit = fits.to_pylist()
        learned.update(self._parted([c for c, p in zip(fresh, fit) if p], self._ids([sent.tobytes().decode("utf-32")], self.model)[0]))
        return [c for c, p in zip(fresh, fit) if not p]

    def _parted(self, pieces: list[str], raw: bytes) -> Iterator[tuple[str, bytes]]:
        at = (4 * np.flatnonzero(self.leads[np.frombuffer(raw, np.uint32)])).tolist()
        if len(at) != len(pieces):
            raise ValueError("the tokenizer joins across spaces: texts can't be cut")
        return ((c, raw[i:j]) for c, i, j in zip(pieces, at, [*at[1:], len(raw)]))

    def _ids(self, texts: list[str], by=None) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in (by or self.library).encode_batch_fast(texts, add_special_tokens=False)]


_encoders: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _encoders:
        _encoders[path] = ByteEncoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- one file


class Writer:
    """Writes documents, in order, to one file."""

    def __init__(self, out):
        self.out, self.pending, self.size = out, [], 0
        self.table: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.counts: list[int] = []
        self.pack = zstandard.ZstdCompressor(level=1, write_checksum=True)

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        if len(ids) >= 1 << 30:
            raise ValueError(f"document {doc_id} has {len(ids)} ids: more than a frame can hold")
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids))
        self.pending.append(ids.astype("<u4").tobytes())
        self.size += 4 * len(ids)
        if self.size >= FRAME_BYTES:
            self._frame()

    def _frame(self) -> None:
        plain = b"".join(self.pending)
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> tuple[int, int]:
        if self.pending:
            self._frame()
        index = self.pack.compress(np.array(self.doc_ids, "<i8").tobytes() + np.array(self.counts, "<u4").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 4) + index + struct.pack("<I", len(self.doc_ids)))
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        foot = struct.pack("<IBI", len(self.table), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(entries) + len(foot)) + entries + foot)
        return len(self.doc_ids), sum(self.counts)


class Reader:
    """Reads documents of one file by their places in it."""

    def __init__(self, source):
        self.source = source
        end = source.seek(0, io.SEEK_END)
        end = source.tell() if end is None else end
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(self._at(end - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.packed, self.plain, self.sums = (table[:, i].astype(np.int64) for i in range(3))
        self.begin = np.concatenate([[0], np.cumsum(self.packed)])
        magic, size = struct.unpack("<II", self._at(int(self.begin[-1]), 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError("no document index")
        body = self._at(int(self.begin[-1]) + 8, size)
        self.n = struct.unpack("<I", body[-4:])[0]
        raw = zstandard.ZstdDecompressor().decompress(body[:-4], max_output_size=12 * self.n + 1) if self.n else b""
        self.doc_ids = np.frombuffer(raw[: 8 * self.n], "<i8")
        self.counts = np.frombuffer(raw[8 * self.n :], "<u4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.first_byte = np.concatenate([[0], np.cumsum(self.plain)])
        self.held = (-1, b"")
        self.frames_read = 0

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, place: int) -> np.ndarray:
        """The ids of the document at this place; its frame is decompressed and its checksum compared."""
        k = int(np.searchsorted(self.first_byte, 4 * self.starts[place], side="right")) - 1
        if self.held[0] != k:
            plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), int(self.packed[k])), max_output_size=int(self.plain[k]))
            if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
                raise ValueError(f"frame {k} doesn't match its checksum")
            self.held = (k, plain)
            self.frames_read += 1
        at = int(4 * self.starts[place] - self.first_byte[k])
        return np.frombuffer(self.held[1][at : at + 4 * int(self.counts[place])], "<u4")


# ---------------------------------------------------------------- the operator

MANIFEST = "bucket int, path string, n_docs long, n_tokens long"


def cuts_by_bytes(docs: DataFrame, key: str, text: str, bytes_per_file: int, rows_per_share: int) -> np.ndarray:
    """Ascending boundaries of files of about equal bytes of text: fine shares of rows (at most MOST_BUCKETS) are
    measured, and neighbours joined. Rows with one key are never parted."""
    cuts = cut_points(docs, key, rows_per_share)
    if len(cuts) == 0:
        return cuts
    sizes = np.zeros(len(cuts) + 1, np.int64)
    for r in docs.groupBy(bucket_of(key, cuts).alias("share")).agg(F.sum(F.octet_length(text)).alias("b")).collect():
        sizes[r["share"]] = r["b"] or 0
    ends = np.cumsum(sizes)
    most = max(bytes_per_file, int(ends[-1]) // MOST_BUCKETS)
    return cuts[np.flatnonzero(np.diff((ends - 1) // most))]


def _grouped(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Keys, buckets and texts of batches, joined to groups of about GROUP_CHARS."""
    keys, places, texts, size = [], [], [], 0
    for b in batches:
        keys += b["k"].tolist()
        places += b["bucket"].tolist()
        texts += texts_of(b["t"])
        size += sum(map(len, texts[len(texts) - len(b) :]))
        if size >= GROUP_CHARS:
            yield keys, places, texts
            keys, places, texts, size = [], [], [], 0
    yield keys, places, texts


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 0, bytes_per_file: int = 8_000_000, rows_per_share: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the ids of all texts in ascending order of key to files under folder; returns the manifest, a stored
    table of bucket (place of the file in the order), path, n_docs, n_tokens.

    Texts are dealt to their files by one shuffle; a task writes its rows as they come, a frame at a time.
    """
    bounded_batches(docs)
    cuts = cuts_by_bytes(docs, key, text, bytes_per_file, rows_per_share)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer_path)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        bucket, out, writer, temporary = None, None, None, ""

        def finished() -> pd.DataFrame:
            docs_in, tokens = writer.close()
            out.close()
            store.move(temporary, f"{root}/ids-{bucket:08d}.zst")
            return pd.DataFrame({"bucket": [bucket], "path": [f"{folder}/ids-{bucket:08d}.zst"], "n_docs": [docs_in], "n_tokens": [tokens]})

        for keys, places, texts in _grouped(batches):
            for doc, place, ids in zip(keys, places, enc.encode_all(texts)):
                if place != bucket:
                    if writer:
                        yield finished()
                    bucket, temporary = place, f"{root}/.writing-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                    writer = Writer(out)
                writer.add(doc, np.append(ids, np.uint32(end_id)))
        if writer:
            yield finished()

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"), F.col(text).alias("t"), bucket_of(key, cuts).alias("bucket"))
    placed = rows.repartition(max(1, len(cuts) + 1), "bucket").sortWithinPartitions("bucket", "k", "t")
    return stored(placed.mapInPandas(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, wanted: np.ndarray | None = None) -> DataFrame:
    """Rows of doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids, read from the files.

    wanted: only these doc ids (a bounded list), whose frames alone are decompressed; None reads all.
    """
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one small row for each file
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    chosen = None if wanted is None else np.unique(np.asarray(wanted, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, before in zip(b["path"], b["before"]):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    r = Reader(source)
                    places = np.arange(r.n) if chosen is None else np.flatnonzero(np.isin(r.doc_ids, chosen))
                    for part in np.array_split(places, max(1, len(places) // 500)) if len(places) else ():
                        got = [r.ids(int(p)) for p in part]
                        yield pd.DataFrame({"doc_id": r.doc_ids[part], "start": before + r.starts[:-1][part], "n_tokens": r.counts[part], "ids_crc32": [zlib.crc32(i.tobytes()) for i in got], "ids": [i.astype(np.int64) for i in got]})

    dealt = files.select("bucket", "path", "before").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "bucket")
    return dealt.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def digests_of_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files; the ids stay in the task."""
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, before in zip(b["path"], b["before"]):
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as source:
                    r = Reader(source)
                    sums = [zlib.crc32(r.ids(p).tobytes()) for p in range(r.n)]
                    yield pd.DataFrame({"doc_id": r.doc_ids, "start": before + r.starts[:-1], "n_tokens": r.counts, "ids_crc32": sums})

    dealt = files.select("bucket", "path", "before").repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "bucket")
    rows = dealt.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.withColumn("doc_id", F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id")))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every whole text of documents to token files and reads them back."""
    import public_tokenizers

    manifest = write_token_files(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), fresh_path(spark, "tokens"))
    return digests_of_files(manifest)
