"""Cross-tokenizer alignment: how the tokens of two tokenizers lie over one another in the same bytes, and in how many
documents of the corpus each pair of ids is linked.

A text's bytes end in tokens of both tokenizers at certain offsets; where ends fall together, a group of tokens ends. The
stretches between all ends are the links: each lies in one token of either side. Both tokenizers part words at spaces, so a
word is aligned once in each block of texts, and a document is its sequence of words (texts that can't be parted are one).

1. Tasks align blocks of texts. For each block np.unique gives its pairs, packed as (A id << 32 | B id), and in how many
   of the block's documents each stands. A stored row holds this, the block's words and its documents as word numbers.
2. The partial counts are shuffled by range of key, sorted, and summed where equal keys meet: sorted shards of keys and
   counts, written to the shared folder. The largest count of each A id is at most a number for each id of a vocabulary.
3. Tasks map the shards into memory and look the pairs of each block up by searchsorted; sums by word give sums by
   document. Where the shared folder can't be mapped, a shard is read whole; shards have a bounded number of pairs.

Handling of special cases: null and empty texts, and texts whose tokens' joined bytes differ from a space and the text
(such as those with U+2581, which the second tokenizer reads as a space), have no tokens: zeros and the digest ''; they
count for no pair. Rows that repeat a key, null keys among them, are documents of their own; equal counts are all highest;
very long texts are read whole; an empty table gives an empty table; columns of other names aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import sentencepiece
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.llm.common import bounded_batches, fresh_path, read_table, stored, texts_of
from leafmark.llm.importance import packed, unpacked

BLOCK_WORDS, BLOCK_CHARS, BLOCK_DOCS = 200_000, 24_000_000, 1 << 16
GROUP_CHARS, CALL_WORDS = 1 << 20, 400  # of text, whose new words are aligned together; words in one call of a library
SHORT = 64  # longer words are aligned at each place
EXPANDED = 1 << 20  # pairs of documents counted at a time
SHARD_ROWS, MOST_SHARDS = 2_000_000, 4096
ID_BITS = 32


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Words:
    """Words of one block: for each the numbers of tokens, groups and links, its pairs, and its groups as text."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.sizes: list[np.ndarray] = []  # rows of n_a, n_b, n_groups, n_links, bad
        self.keys: list[np.ndarray] = []
        self.shown: list[bytes] = []

    def __len__(self) -> int:
        return len(self.shown)


class Aligner:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core already
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = byte_alphabet()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        n = self.b.get_piece_size()
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        plain = [self.b.id_to_piece(i) for i in range(n) if not self.b.is_control(i)]
        self.parted = not any("▁" in p.lstrip("▁") for p in plain) and not any(" " in x.decode(errors="replace").lstrip() for x in self.a_bytes)
        self.uncut = re.compile(r"\A\s|\s\Z|\s\s|\A\Z|[\x00\x1c-\x1f▁]")

    def learn(self, new: list[str], words: Words, keep: bool = True) -> list[int]:
        """Aligns words (each with a space before it) and returns their numbers."""
        out = []
        for at in range(0, len(new), CALL_WORDS * 64):
            calls = [new[i : i + CALL_WORDS] for i in range(at, min(len(new), at + CALL_WORDS * 64), CALL_WORDS)] if self.parted else [[w] for w in new[at : at + CALL_WORDS * 64]]
            joined = [" ".join(c) for c in calls]
            a = [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast([" " + j for j in joined], add_special_tokens=False)]
            b = [np.array(x, np.int64) for x in self.b.encode(joined, num_threads=1)]
            same = [b"".join(map(self.a_bytes.__getitem__, x.tolist())) == b"".join(map(self.b_bytes.__getitem__, y.tolist())) == b" " + j.encode() for j, x, y in zip(joined, a, b)]
            if all(same):
                out += self._add([w for c in calls for w in c], np.concatenate(a), np.concatenate(b), words)
                continue
            for call, x, y, equal in zip(calls, a, b, same):
                if equal:
                    out += self._add(call, x, y, words)
                elif len(call) > 1:
                    for w in call:
                        out += self.learn([w], words, False)
                else:
                    out.append(len(words))
                    words.sizes.append(np.array([[0, 0, 0, 0, 1]]))
                    words.shown.append(b"")
        if keep:
            words.number.update((w, i) for w, i in zip(new, out) if len(w) <= SHORT)
        return out

    def _add(self, new: list[str], a: np.ndarray, b: np.ndarray, words: Words) -> list[int]:
        """Adds words whose tokens a and b, joined, cover the same bytes."""
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        link_end = np.union1d(a_end, b_end)
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        words.keys.append(a[np.searchsorted(a_end, link_end)] << ID_BITS | b[np.searchsorted(b_end, link_end)])
        word_end = np.cumsum([len(w.encode()) + 1 for w in new])
        if not np.isin(word_end, common).all():
            raise ValueError("a tokenizer joins across spaces: texts can't be parted")
        upto = [np.searchsorted(x, word_end, side="right") for x in (a_end, b_end, common, link_end)]
        words.sizes.append(np.stack([*(np.diff(x, prepend=0) for x in upto), np.zeros(len(new), np.int64)], 1))
        # the ids of all groups in order, each group's A ids before its B ids
        a_group, b_group = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group, minlength=len(common)))])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=len(common)))])
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        a_place, b_place = np.arange(len(a)) + b_before[a_group], np.arange(len(b)) + a_before[b_group + 1]
        ids[a_place], ids[b_place] = a, b
        mark[a_place[a_before[1:] - 1]], mark[b_place[b_before[1:] - 1]] = ord("|"), ord(";")
        digits = len(str(max(len(self.a_bytes), len(self.b_bytes))))
        figures = np.empty((len(ids), digits + 1), np.uint8)
        for k in range(digits):
            figures[:, digits - 1 - k] = ids // 10**k % 10 + ord("0")
        figures[:, digits] = mark
        used = np.ones(figures.shape, bool)
        for k in range(1, digits):
            used[:, digits - 1 - k] = ids >= 10**k
        text = figures[used].tobytes()
        last = np.concatenate([[0], np.cumsum(used.sum(1))])[upto[0] + upto[1]]
        first = len(words)
        words.shown += [text[x : y - 1] for x, y in zip([0, *last[:-1].tolist()], last.tolist())]
        return list(range(first, len(words)))

    def documents(self, texts: list[str], words: Words) -> list[np.ndarray]:
        """Each text as numbers of words, new ones of which are aligned."""
        split = [t.split(" ") if t else [] for t in texts]
        missing = {w for s in split for w in s if w not in words.number}
        whole = {w for w in missing if not self.parted or self.uncut.search(w)}
        fresh = sorted(missing - whole)
        known = dict(zip(fresh, self.learn(fresh, words)))
        out = []
        for t, s in zip(texts, split):
            if whole and not whole.isdisjoint(s):
                out.append(np.array(self._whole(t, words), np.int64))
            else:
                out.append(np.array([words.number[w] if w in words.number else known[w] for w in s], np.int64))
        return out

    def _whole(self, text: str, words: Words) -> list[int]:
        """A text that can't be parted."""
        a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text), np.int64)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == b"".join(map(self.b_bytes.__getitem__, b.tolist())) == b" " + text.encode():
            return self._add([text], a, b, words)
        words.sizes.append(np.array([[0, 0, 0, 0, 1]]))
        words.shown.append(b"")
        return [len(words) - 1]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each pair of models and Python worker."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


# ---------------------------------------------------------------- blocks


BLOCKS = "ids binary, sizes binary, shas array<string>, seq binary, seq_sizes binary, word_links binary, word_pairs binary, pairs binary, counts binary"


def held_counts(docs: list[np.ndarray], links: np.ndarray, at: np.ndarray, pair_of: np.ndarray, n: int) -> np.ndarray:
    """In how many documents (arrays of distinct word numbers) each of n pairs stands; word w has the pairs
    pair_of[at[w] : at[w] + links[w]]."""
    out = np.zeros(n, np.int64)
    begin = 0
    while begin < len(docs):
        end, total = begin, 0
        while end < len(docs) and (end == begin or total + int(links[docs[end]].sum()) <= EXPANDED):
            total += int(links[docs[end]].sum())
            end += 1
        word = np.concatenate(docs[begin:end])
        doc = np.repeat(np.arange(end - begin), [len(d) for d in docs[begin:end]])
        each = links[word]
        first = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(each) else each
        place = np.arange(int(each.sum())) - np.repeat(first, each) + np.repeat(at[word], each)
        met = np.unique(np.repeat(doc, each) * n + pair_of[place])
        out += np.bincount(met % n, minlength=n) if len(met) else 0
        begin = end
    return out


def blocks_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Packed rows of blocks of (k, none, t): documents, their numbers, digests and words; the words' pairs; the pairs
    and in how many of the block's documents each stands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools, words, ids, held, chars, waiting, size = aligner(a_path, b_path), Words(), [], [], 0, [], 0

        def closed() -> pd.DataFrame:
            sizes = np.concatenate(words.sizes) if words.sizes else np.empty((0, 5), np.int64)
            bad, links = sizes[:, 4] > 0, sizes[:, 3]
            seqs = [s[:0] if bad[s].any() else s for s in held]
            keys, pair_of = np.unique(np.concatenate(words.keys) if words.keys else np.empty(0, np.int64), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(links)[:-1]]) if len(links) else links
            counts = held_counts([np.unique(s) for s in seqs], links, at, pair_of, len(keys)) if len(keys) else np.empty(0, np.int64)
            per_doc = np.array([sizes[s, :4].sum(0) for s in seqs], np.int64).reshape(len(seqs), 4)
            shas = [hashlib.sha256(b";".join([words.shown[i] for i in s.tolist()])).hexdigest() if len(s) else "" for s in seqs]
            row = (packed(np.array(ids, np.int64).ravel()), packed(per_doc.ravel()), shas, packed(np.concatenate(seqs)), packed(np.array([len(s) for s in seqs])), packed(links), packed(pair_of.ravel()), packed(np.diff(keys, prepend=0)), packed(counts))
            return pd.DataFrame([row], columns=[c.split(" ")[0] for c in BLOCKS.split(", ")])

        for b in batches:
            for k, none, t in zip(b["k"].tolist(), b["none"].tolist(), texts_of(b["t"])):
                ids.append((k, int(none)))
                waiting.append(t)
                size += len(t)
                if size >= GROUP_CHARS or len(ids) == BLOCK_DOCS:
                    held += tools.documents(waiting, words)
                    chars, waiting, size = chars + size, [], 0
                    if len(words) >= BLOCK_WORDS or chars >= BLOCK_CHARS or len(ids) == BLOCK_DOCS:
                        yield closed()
                        words, ids, held, chars = Words(), [], [], 0
        if ids:
            held += tools.documents(waiting, words)
            yield closed()

    return docs.mapInPandas(run, BLOCKS)


# ---------------------------------------------------------------- the sorted count table


SHARDS = "path string, first long, n long, a long, best long"


def written_shards(partial: DataFrame, folder: str, rows: int) -> DataFrame:
    """Sums (key, n) by key in order of key and writes the sums to files of keys and of counts, a pair for each task;
    returns their places, and for each A id of a file its largest count. A repeated task writes files of other names."""
    shards = min(MOST_SHARDS, max(partial.sparkSession.sparkContext.defaultParallelism, -(-rows // SHARD_ROWS)))
    dealt = partial.repartitionByRange(shards, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in SHARDS.split(", ")]
        out, path, first, n, last, a, best = None, "", 0, 0, None, None, 0

        def put(keys: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
            nonlocal out, path, first, n, a, best
            if not len(keys):
                return
            if out is None:
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root, recursive=True)
                name = f"counts-{uuid.uuid4().hex}"
                path, first = f"{folder}/{name}", int(keys[0])
                out = [store.open_output_stream(f"{root}/{name}.{kind}") for kind in ("keys", "counts")]
            out[0].write(keys.astype("<i8").tobytes())
            out[1].write(counts.astype("<i8").tobytes())
            n += len(keys)
            ids = keys >> ID_BITS
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            ids, most = ids[new], np.maximum.reduceat(counts, new)
            if a == ids[0]:
                most[0] = max(best, most[0])
            elif a is not None:
                ids, most = np.append(a, ids), np.append(best, most)
            a, best = int(ids[-1]), int(most[-1])
            yield pd.DataFrame({"path": None, "first": None, "n": None, "a": ids[:-1], "best": most[:-1]}, columns=columns)

        for b in batches:
            keys, counts = b["key"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
            if last is not None:
                keys, counts = np.append(last[0], keys), np.append(last[1], counts)
            if not len(keys):
                continue
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[new], np.add.reduceat(counts, new)
            last = (keys[-1], counts[-1])  # the next batch may go on with this key
            yield from put(keys[:-1], counts[:-1])
        if last is not None:
            yield from put(np.array([last[0]]), np.array([last[1]]))
            for o in out:
                o.close()
            yield pd.DataFrame([(path, first, n, a, best)], columns=columns)

    return stored(dealt.mapInPandas(run, SHARDS), "shards")


class Shards:
    """Looks counts up in the sorted shards, which are mapped into memory when first needed."""

    def __init__(self, first: np.ndarray, paths: list[str]):
        self.first, self.paths = first, paths
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        if i not in self.open:
            pair = []
            for kind in ("keys", "counts"):
                store, path = fs.FileSystem.from_uri(f"{self.paths[i]}.{kind}")
                if isinstance(store, fs.LocalFileSystem):
                    pair.append(np.memmap(path, "<i8", "r"))
                else:
                    self.open.clear()  # read whole, so one at a time
                    with store.open_input_file(path) as source:
                        pair.append(np.frombuffer(source.read(), "<i8"))
            self.open[i] = tuple(pair)
        return self.open[i]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, all of which the shards hold."""
        out = np.empty(len(keys), np.int64)
        cuts = np.searchsorted(keys, self.first[1:]) if len(self.first) else np.empty(0, np.int64)
        for i, (x, y) in enumerate(zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)])):
            if y > x:
                held, n = self._shard(i)
                at = np.minimum(np.searchsorted(held, keys[x:y]), len(held) - 1)
                if not (held[at] == keys[x:y]).all():
                    raise ValueError("a pair of ids isn't in the count table")
                out[x:y] = n[at]
        return out


# ---------------------------------------------------------------- the operator


def pair_table(blocks: DataFrame, folder: str) -> DataFrame:
    """written_shards() of all pairs of ids and the numbers of documents that hold them, from stored blocks."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["pairs"], b["counts"]):
                keys, n = np.cumsum(unpacked(p)), unpacked(c)
                yield pd.DataFrame({"key": keys[n > 0], "n": n[n > 0]})

    rows = blocks.select("pairs", "counts").mapInPandas(partial, "key long, n long")
    return written_shards(rows, folder, rows.count())


def aligned(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the key, n_a, n_b, n_groups, n_links, n_best (links whose pair has its A id's largest
    count), count_sum (of all links' counts) and groups_sha256."""
    spark = docs.sparkSession
    bounded_batches(docs)
    kind = docs.schema[key].dataType
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("k"), F.col(key).isNull().alias("none"), F.col(text).alias("t"))
    blocks = stored(blocks_of(rows, a_path, b_path), "aligned")
    table = pair_table(blocks, fresh_path(spark, "pairs"))
    files = sorted((r["first"], r["path"]) for r in table.filter("path is not null").select("first", "path").collect())  # at most MOST_SHARDS
    most = table.filter("a is not null").groupBy("a").agg(F.max("best").alias("best")).collect()  # at most the ids of the first vocabulary
    best = np.zeros(max([0, *(r["a"] for r in most)]) + 1, np.int64)
    for r in most:
        best[r["a"]] = r["best"]
    first, paths = np.array([f for f, _ in files], np.int64), [p for _, p in files]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = Shards(first, paths)
        for b in batches:
            for r in b.itertuples(index=False):
                ids, none = unpacked(r.ids).reshape(-1, 2).T
                keys, links, pair_of = np.cumsum(unpacked(r.pairs)), unpacked(r.word_links), unpacked(r.word_pairs)
                n, used = np.zeros(len(keys), np.int64), unpacked(r.counts) > 0  # words of texts without tokens aren't in the table
                n[used] = shards.counts(keys[used])
                is_best = n == best[np.minimum(keys >> ID_BITS, len(best) - 1)]
                ends = np.concatenate([[0], np.cumsum(links)])
                by_word = [np.diff(np.concatenate([[0], np.cumsum(v[pair_of])])[ends]) for v in (is_best.astype(np.int64), n)]
                seq, at = unpacked(r.seq), np.concatenate([[0], np.cumsum(unpacked(r.seq_sizes))])
                by_doc = [np.diff(np.concatenate([[0], np.cumsum(v[seq])])[at]) for v in by_word]
                sizes = unpacked(r.sizes).reshape(-1, 4).T
                yield pd.DataFrame({"k": ids, "none": none > 0, "n_a": sizes[0], "n_b": sizes[1], "n_groups": sizes[2], "n_links": sizes[3], "n_best": by_doc[0], "count_sum": by_doc[1], "groups_sha256": r.shas})

    found = blocks.mapInPandas(run, "k long, none boolean, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return found.select(F.when(~F.col("none"), F.col("k")).cast(kind).alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligns the tokens of both tokenizers over every whole text of documents."""
    import public_tokenizers

    return aligned(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
