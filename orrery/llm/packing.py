"""Packing token ids into fixed windows by best-fit decreasing.

Documents are tokenized whole; one longer than the window is first cut into full windows, and what is left of each document (under a
window) is packed best-fit decreasing: a segment tree indexed by remaining capacity finds the tightest open window. Packing runs in
groups of about `GROUP` documents chosen by hash, so tasks are even and bounded; a group leaves at most one loose end.

Defined results: null text is empty and becomes the end id alone; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import staged

WINDOW, END_ID, GROUP, CACHE, CACHE_CHARS = 4096, 2, 20_000, 250_000, 1 << 26
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
# white space as the tokenizer's normalizer sees it; Python's str.split would also cut at U+001C to U+001F
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

# punctuation that may end a word; not the apostrophe, which the tokenizer may join to letters after it
_ENDS = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"


class WordCache:
    """Ids of words, as little-endian bytes. The tokenizer drops white space and never joins over it, so a text's ids are its words' ids.

    New words are tokenized together, once each, without the punctuation that ends them after an ASCII letter or digit (where the
    tokenizer splits anyway). Two generations of at most CACHE words and CACHE_CHARS characters are kept, so frequent words outlive the
    many that occur once.
    """

    def __init__(self, tokenizer):
        from tokenizers.normalizers import ByteLevel

        self.tokenizer, self.model, self.byte_level, self.now, self.old, self.held = tokenizer, tokenizer.model, ByteLevel().normalize_str, {}, {}, 0
        ids = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
        if ids("One two.") != ids("one") + ids("two") + ids("."):
            raise ValueError("this tokenizer doesn't drop white space and case, so texts can't be tokenized by words")
        #: Whether lower-case letters go to the model as they are, byte by byte.
        self.plain = all(ids(w) == self.model_ids(w) for w in ("the", "straße", "élan", "unforeseeable"))

    def model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word if word.isascii() else self.byte_level(word))]

    def encode(self, words: list[str]) -> None:
        if self.plain:  # Latin letters in lower case pass the tokenizer's other steps unchanged
            rest, now, cut, level = [], self.now, self.model.tokenize, self.byte_level
            for w in words:
                if w.isalpha() and w.islower() and (w.isascii() or max(w) <= "ÿ"):
                    now[w] = array("I", [t.id for t in cut(w if w.isascii() else level(w))]).tobytes()
                else:
                    rest.append(w)
            words = rest
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            found = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            owner = np.array([-1 if x is None else x for x in found.word_ids], np.int64)
            if (owner < 0).any():  # ids that belong to no given word: one by one
                self.now.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()) for w in some)
                continue
            ends = (4 * np.searchsorted(owner, np.arange(1, len(some) + 1))).tolist()
            start = 0
            for word, end in zip(some, ends, strict=True):
                self.now[word] = ids[start:end]
                start = end

    def fill(self, words: set[str]) -> None:
        """Make the ids of all `words` known."""
        if len(self.now) > CACHE or self.held > CACHE_CHARS:
            self.now, self.old, self.held = {}, self.now if self.held <= CACHE_CHARS else {}, 0
        now, old = self.now, self.old

        def unknown(some: set[str]) -> set[str]:
            """Those of `some` that neither generation knows; the old one's are brought over."""
            new = some.difference(now)
            known = [w for w in new if w in old] if old else []
            now.update((w, old[w]) for w in known)
            return new.difference(known)

        whole, parts = set(), []
        for w in unknown(words):
            if len(w) > 256:
                self.held += len(w)  # others are bounded by their number
            if w[-1] in _ENDS:
                core = w.rstrip(_ENDS)
                # a letter or digit of ASCII stays one of its own whatever follows it; others may lower-case to a letter with a mark
                if core and core[-1].isascii() and core[-1].isalnum() and "<|" not in w:
                    parts.append((w, core, w[len(core) :]))
                    continue
            whole.add(w)
        whole.update(unknown({x for _, core, end in parts for x in (core, end)}))
        self.encode(list(whole))
        for w, core, end in parts:
            now[w] = now[core] + now[end]


_CACHES: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    if path not in _CACHES:
        from tokenizers import Tokenizer

        _CACHES[path] = WordCache(Tokenizer.from_file(path))
    return _CACHES[path]


def words_of(text: str) -> list[str]:
    """A text's words; in lower case where that can't change what the tokenizer, which finds special tokens, composes and lower-cases in
    this order, makes of them."""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    # str.split cuts where the tokenizer does, and at these four
    return text.split() if not any(c in text for c in "\x1c\x1d\x1e\x1f") else _SPACES.split(text)


def token_bytes(texts: list[str], cache: WordCache) -> Iterator[bytes]:
    """Ids of each text with the end id."""
    end, at = np.array([END_ID], "<u4").tobytes(), 0
    while at < len(texts):
        some, filled = [], 0
        while at < len(texts) and filled < 1 << 21:
            some.append(words_of(texts[at]))
            filled += len(texts[at])
            at += 1
        cache.fill(set().union(*some) - {""})
        known = cache.now
        known[""] = b""
        for words in some:
            yield b"".join(map(known.__getitem__, words)) + end


def tokenize(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents: PIECE's columns, and their ids (array) if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(tokenizer_path)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for doc, ids in zip(part.column(0).to_pylist(), token_bytes([t or "" for t in part.column(1).to_pylist()], cache), strict=True):
                    for at in range(0, len(ids), 4 * window):
                        piece = ids[at : at + 4 * window]
                        for k, v in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, np.frombuffer(piece, "<u4") if keep_ids else None), strict=True):
                            out[k].append(v)
                columns = [pa.array(out[k], pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns, names = [*columns, pa.array(out["ids"], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE + ", ids array<int>" * keep_ids)


class OpenWindows:
    """Open windows by remaining capacity under a segment tree: the tree's nodes tell whether any capacity below them is present."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.at: dict[int, list[int]] = {}

    def put(self, capacity: int, window: int) -> None:
        self.at.setdefault(capacity, []).append(window)
        i = capacity + self.leaves
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest capacity that holds `length`, with one of its windows, removed; None if none does."""
        i = length + self.leaves
        if not self.some[i]:
            while i > 1 and (i & 1 or not self.some[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.some[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        windows = self.at[capacity]
        window = windows.pop()
        if not windows:
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; pieces by falling length, ties in the order given."""
    where, offset, opened, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        found = opened.take(length) if length < window else None
        capacity, at = found or (window, made)
        made += found is None
        where[i], offset[i] = at, window - capacity
        if capacity > length:
            opened.put(capacity - length, at)
    return where, offset


def pack(pieces: DataFrame, window: int = WINDOW, group: int = GROUP, documents: int | None = None) -> DataFrame:
    """`pieces` (PIECE's columns and any others) with sequence_id and offset."""
    documents = pieces.where("start = 0").count() if documents is None else documents
    groups = max(1, -(-documents // group))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        first = table.column("_group")[0].as_py() << 32
        return table.drop_columns("_group").append_column("sequence_id", pa.array(first + where)).append_column("offset", pa.array(offset))

    grouped = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return grouped.groupBy("_group").applyInArrow(fit, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    return pack(staged(tokenize(docs, tokenizer_path, window, keep_ids), "pieces"), window)
