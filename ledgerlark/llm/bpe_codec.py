"""BPE encoding and decoding with a priority queue of merge ranks.

A word's symbols form a doubly linked list. A heap holds a (rank, place) entry for every pair of
neighbours that has a merge; the lowest rank, leftmost, is merged and the pairs that the merge
makes are pushed. Entries whose symbols have changed since are stale and skipped when they come
up. Equal words of a task are encoded once. Decoding concatenates vocabulary strings.

Before the merges a text is cut at added tokens, normalised and split into words. Texts of common
Latin characters (COMMON) take a pattern here, whose agreement with the library is verified for
every such character when the vocabulary is loaded; any other text goes through the library's
own normaliser and splitter, whose Unicode tables differ from Python's.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of

#: Characters whose composed forms, lower case and classes are verified at load: Latin letters,
#: dashes, quotes, bullets, the euro sign. None of them combines with its neighbours. U+001C to
#: U+001F are white space to Python only.
COMMON = [*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2027), 0x20AC]
_OTHER = re.compile("[^\\u0000-\\u001b\\u0020-\\u024f\\u2010-\\u2026\\u20ac]")
#: Pieces of text and words whose ids a task keeps, and characters of either, before it starts anew.
_KEPT_PIECES, _KEPT_WORDS, _KEPT_CHARS = 200_000, 400_000, 1 << 24
#: Stands before words that are in byte letters; no text that is split here has it.
_MARK = "\x1c"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters for themselves, the other
    bytes, in order, for characters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class MergeModel:
    """Merges, vocabulary and word splitter of a tokenizer file (BPE over byte letters)."""

    _loaded: dict[str, MergeModel] = {}

    @classmethod
    def load(cls, path: str) -> MergeModel:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:  # a library file, installed on every machine
            layout = json.load(f)
        model = layout["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "fuse_unk", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"{path}: a plain BPE model is needed, not {model['type']} with {odd}")
        self.library = Tokenizer.from_file(path)
        if self.library.pre_tokenizer is None:
            raise ValueError(f"{path}: words need a splitter")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.letters = str.maketrans({chr(b): letters[b] for b in range(256)})
        missing = [x for x in (*letters, *(x + self.suffix for x in letters)) if x not in self.vocabulary]
        if missing:
            raise ValueError(f"{path}: {len(missing)} bytes have no symbol")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = {self.vocabulary[a] << 24 | self.vocabulary[b]: (rank, self.vocabulary[a + b]) for rank, (a, b) in enumerate(merges)}
        self.added = {t["content"]: t["id"] for t in layout["added_tokens"]}
        if any(t[k] for t in layout["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens must be taken as they stand")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        strings = [""] * (1 + max([*self.vocabulary.values(), *self.added.values()]))
        for text, i in (*self.vocabulary.items(), *self.added.items()):
            strings[i] = text
        decoder = (layout.get("decoder") or {}).get("type")
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"{path}: decoder {decoder} isn't known")
        self.spaced = decoder is None
        code = {x: b for b, x in enumerate(letters)}
        raw = [s.encode() + b" " if self.spaced else bytes(code[x] for x in s) if all(x in code for x in s) else s.encode() for s in strings]
        self.byte_width = np.array([len(b) for b in raw], np.int64)
        self.byte_start = np.cumsum(self.byte_width) - self.byte_width
        self.byte_pool = np.frombuffer(b"".join(raw), np.uint8)
        self.words = self._common_words(layout)

    def _common_words(self, layout: dict):
        """The word pattern for texts of COMMON characters, if this file lower-cases and drops white
        space between words; its agreement with the library is checked for each character."""
        steps = [s.get("type") for s in (layout["normalizer"] or {}).get("normalizers", [])]
        split = (layout["pre_tokenizer"].get("pretokenizers") or [{}])[0]
        if steps != ["NFC", "Replace", "Lowercase"] or not split.get("invert") or split.get("behavior") != "Removed":
            return None
        pattern = regex.compile(split["pattern"]["Regex"])
        for c in map(chr, COMMON):
            for text in (f"a{c}a", f"!{c}!", f"1{c} '{c}"):
                if [self.lettered(w) for piece in text.split() for w in pattern.findall(piece.lower())] != self.library_words(text):
                    raise ValueError(f"words around U+{ord(c):04X} differ from the library's")
        return pattern

    def lettered(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def library_words(self, text: str) -> list[str]:
        """Words in byte letters by the library's normaliser and splitter."""
        normal = self.library.normalizer
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)]

    def merge(self, word: str) -> list[int]:
        """Ids of one word in byte letters."""
        symbols = [self.vocabulary[x] for x in word]
        if self.suffix:
            symbols[-1] = self.vocabulary[word[-1] + self.suffix]
        n, pairs = len(symbols), self.pairs
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(found[0], i, found[1]) for i in range(n - 1) if (found := pairs.get(symbols[i] << 24 | symbols[i + 1]))]
        heapify(queue)
        while queue:
            _, i, made = heappop(queue)
            j = after[i]
            if symbols[i] < 0 or j == n:
                continue
            now = pairs.get(symbols[i] << 24 | symbols[j])
            if now is None or now[1] != made:
                continue  # stale
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := pairs.get(made << 24 | symbols[k]):
                    heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get(symbols[h] << 24 | made)):
                heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> pa.Array:
        """Texts of the given numbers of ids: the vocabulary strings' bytes are gathered at once."""
        if len(ids) and ids.min() < 0:
            raise IndexError("ids can't be negative")
        widths = self.byte_width[ids]
        if self.spaced:  # none after the last
            widths[np.cumsum(sizes)[sizes > 0] - 1] -= 1
        raw = _gather(self.byte_pool, self.byte_start[ids], widths)
        total = np.concatenate([[0], np.cumsum(widths)])
        offsets = total[np.concatenate([[0], np.cumsum(sizes)])]
        if self.spaced:
            return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw)])
        data = raw.tobytes()  # a text may end within a character
        return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.string())


class _Words(dict):
    """Word -> its ids as the bytes of int32 values, merged when it first comes up."""

    def __init__(self, model: MergeModel):
        super().__init__()
        self.model, self.chars = model, 0

    def __missing__(self, word: str) -> bytes:
        model = self.model
        ids = array("i", model.merge(word[1:] if word[0] == _MARK else model.lettered(word))).tobytes()
        if len(self) >= _KEPT_WORDS or self.chars > _KEPT_CHARS:
            self.clear()
            self.chars = 0
        self.chars += len(word)
        self[word] = ids
        return ids


class _Numbers(dict):
    """Piece of text -> its number, in the order of first use; `fresh` has the ids of the new ones."""

    def __init__(self, model: MergeModel, words: _Words):
        super().__init__()
        self.model, self.words, self.fresh, self.chars = model, words, [], 0

    def __missing__(self, piece: str) -> int:
        words = self.words
        if piece[0] == _MARK:
            ids = words[piece]
        elif piece in self.model.added:
            ids = array("i", [self.model.added[piece]]).tobytes()
        else:
            found = self.model.words.findall(piece.lower())
            ids = words[found[0]] if len(found) == 1 else b"".join([words[w] for w in found])
        self.fresh.append(ids)
        self.chars += len(piece)
        number = self[piece] = len(self)
        return number


class _Encoder:
    """Encodes runs of texts. Pieces between white space (no word crosses it), words from the
    library's splitter (marked) and added tokens are encoded once and numbered; a text's ids are
    gathered from a pool by its pieces' numbers."""

    def __init__(self, model: MergeModel):
        self.model, self.words = model, _Words(model)
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers(self.model, self.words)
        self.pool, self.start, self.width = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _pieces(self, text: str) -> list[str]:
        model = self.model
        if model.words is not None and not _OTHER.search(text) and not (model.added and model.cut.search(text)):
            return text.split()
        out = []
        for part in model.cut.split(text) if model.added else [text]:
            if part in model.added:
                out.append(part)
            elif model.words is not None and not _OTHER.search(part):
                out += part.split()
            else:
                out += [_MARK + w for w in model.library_words(part)]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and each text's number of ids."""
        if len(self.number) > _KEPT_PIECES or self.number.chars > _KEPT_CHARS:
            self.clear()
        pieces = [self._pieces(t) for t in texts]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        which = np.fromiter(map(self.number.__getitem__, chain.from_iterable(pieces)), np.int64, int(sizes.sum()))
        if fresh := self.number.fresh:
            widths = np.fromiter(map(len, fresh), np.int64, len(fresh)) // 4
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(widths) - widths])
            self.width = np.concatenate([self.width, widths])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(fresh), np.int32)])
            fresh.clear()
        widths = self.width[which]
        total = np.concatenate([[0], np.cumsum(widths)])
        stops = np.cumsum(sizes)
        return _gather(self.pool, self.start[which], widths), total[stops] - total[stops - sizes]

    def ids(self, text: str) -> list[int]:
        return self.encode([text])[0].tolist()


def _gather(pool: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """pool[start : start + width] of all pairs, one after another."""
    ends = np.cumsum(width)
    return pool[np.repeat(start - (ends - width), width) + np.arange(int(ends[-1]) if len(ends) else 0)]


def _extended(df: DataFrame, into: str, kind: T.DataType) -> tuple[DataFrame, T.StructType]:
    kept = df.drop(into) if into in df.columns else df
    return kept, T.StructType([*kept.schema.fields, T.StructField(into, kind, False)])


def encode(docs: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds `into` (array<int>): the ids of every whole text, as the tokenizers library gives them
    without special tokens being added; added tokens that stand in a text get their ids. Null or
    empty text gives an empty list; repeated rows stay repeated; an empty table stays empty; a
    column named like `into` is replaced, all others stay. Narrow: one pass, no shuffle, runs of
    rows of about 1 MB of text (a longer text is a run of its own)."""
    kept, schema = _extended(docs, into, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(MergeModel.load(path))
        for batch in batches:
            for rows in slices(batch, text, 1 << 20):
                ids, sizes = encoder.encode(texts_of(rows.column(rows.schema.get_field_index(text))))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds `into` (string): the vocabulary strings of the ids one after another, special ones too:
    with a space between them where the file names no decoder, else the bytes that they stand for.
    Null or empty lists give empty text. Ids outside the vocabulary raise an error."""
    kept, schema = _extended(tokens, into, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = MergeModel.load(path)
        for batch in batches:
            for rows in slices(batch, ids, 1 << 18):
                lists = rows.column(rows.schema.get_field_index(ids))
                sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, model.decode(np.asarray(lists.flatten(), np.int64), sizes)], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, schema)


def packed(tokens: DataFrame, ids: str = "ids", into: str = "packed") -> DataFrame:
    """Adds `into` (binary): the ids as little-endian unsigned 32-bit integers, the form that token
    files have. The list's buffer is taken as it is. Null or empty lists give no bytes."""
    kept, schema = _extended(tokens, into, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lists = rows.column(rows.schema.get_field_index(ids))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes) * 4]).astype(np.int32)
            values = np.asarray(lists.flatten(), "<i4")
            raw = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
            yield pa.RecordBatch.from_arrays([*rows.columns, raw], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    tokens = encode(docs.select("doc_id", "text"), path).select("doc_id", "ids")
    back = packed(decode(tokens, path))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
