"""SentencePiece encoding and decoding by vectorised merge rounds.

The model's merges are applied to flat numpy arrays of symbols. A round finds the best
(lowest) pair rank of every segment with a segmented minimum, merges that pair's occurrences
from the left at the same time in all segments, and compacts the arrays; segments leave when
no pair remains. Equal words of a batch are encoded once.

Why this equals the library's one-merge-at-a-time order: a merge is "plain" if no piece that
is built upon its result has a rank at or below its own; then all its occurrences come before
anything that they make possible. For the other pieces only occurrences that are too far
apart to meet (twice the longest piece) merge together, the rest wait for the next round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts_of

_SPACE = "▁"
#: Words with the spaces before them. No piece has a space after another character, so words
#: never merge with each other. A long run of spaces is cut 16 at a time from its left, as the
#: run's own merges do, while at least 16 more follow.
_WORDS = re.compile(r" {16}(?= {16})| *[^ \n]+| +|\n")
#: Texts that a model is verified with when it is loaded.
_SAMPLES = (
    "", "a", " a", "a  b", "  two  spaces  ", " " * 50 + "x", "one\n\ntwo\n", "\t tab\x0b\x0c\r\n", "Hello, WORLD! it's 1234.56%", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ﬁ ½ Å Å é Ⅷ ＡＢ", "né ▁ 漢字 한국 🙂👍🏽 \u200b\ufeff end",
    "<s></s><unk><0x41>", "the quick brown fox jumps over the lazy dog. Der schnelle braune Fuchs; el zorro marrón; le renard brun.",
)
_NONE = np.iinfo(np.int32).max
_CACHED_WORDS = 200_000
_DENSE = 1024


class PieceModel:
    """Merge tables of a BPE model with byte fallback."""

    _loaded: dict[str, PieceModel] = {}

    @classmethod
    def load(cls, path: str) -> PieceModel:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = model.get_piece_size()
        self.prefix = model.encode("a", out_type=str)[0].startswith(_SPACE)  # a space before each text
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = np.zeros(256, np.int32)
        self.bytes_of: list[bytes] = []
        normal: dict[str, int] = {}
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                self.bytes_of.append(b"")
            elif model.is_unknown(i):
                self.bytes_of.append(" ⁇ ".encode())
            else:
                normal[piece] = i
                self.bytes_of.append(piece.replace(_SPACE, " ").encode())
        scores = sorted({-model.get_score(i) for i in normal.values()})
        place = {s: r for r, s in enumerate(scores)}
        rank = np.full(size, _NONE, np.int32)
        for i in normal.values():
            rank[i] = place[-model.get_score(i)]
        self.char_symbol = np.arange(0x110000, dtype=np.int32) + size
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char_symbol[ord(piece)] = i
        self.char_symbol[ord(" ")] = self.char_symbol[ord(_SPACE)]
        symbol = lambda s: normal.get(s, self.char_symbol[ord(s)] if len(s) == 1 else None)
        pairs: dict[int, int] = {}
        meets: set[int] = set()
        plain = np.ones(size, bool)
        self.longest = 1
        for piece, i in normal.items():
            self.longest = max(self.longest, len(piece))
            for k in range(1, len(piece)):
                meets.add(int(self.char_symbol[ord(piece[k - 1])]) << 21 | int(self.char_symbol[ord(piece[k])]))
                left, right = symbol(piece[:k]), symbol(piece[k:])
                if left is None or right is None:
                    continue
                pairs[int(left) << 21 | int(right)] = i
                for part, text in ((left, piece[:k]), (right, piece[k:])):
                    if len(text) > 1 and rank[i] <= rank[part]:
                        plain[part] = False
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        self.pair_rank = rank[self.pair_piece]
        self.pair_plain = plain[self.pair_piece]
        self.meets = np.array(sorted(meets), np.int64)
        # Pairs of the first characters by code: whether any piece holds them side by side, and
        # the place of their merge in pair_keys (-1: none).
        codes = self.char_symbol[:_DENSE].astype(np.int64)
        keys = codes[:, None] << 21 | codes[None, :]
        self.near_meets = _member(self.meets, keys)
        self.near_pair = np.where(self.near_meets, self._find(keys), -1).astype(np.int32)
        widths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_start, self.byte_width = np.concatenate([[0], np.cumsum(widths)])[:-1], widths
        self.opens_with_space = np.array([p.startswith(_SPACE) for p in self.pieces])
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of) or b"\0", np.uint8)
        self._verify(model, path)

    def _verify(self, model, path: str) -> None:
        """Hold this reading of the model (a BPE without own pieces or normaliser, no piece with a space
        after another character, new lines alone) against the library on texts that show each."""
        crossing = [p for p in self.pieces if _SPACE in p.lstrip(_SPACE)]
        encoder = _WordCache(self)
        for text in _SAMPLES:
            ids, _ = encoder.encode([text])
            raw, _ = self.decode(ids.astype(np.int64), np.array([len(ids)]))
            if crossing or ids.tolist() != model.encode(text) or raw.tobytes().decode("utf-8", "replace") != model.decode(model.encode(text)):
                raise ValueError(f"{path}: this model's pieces or normaliser aren't those that are read here ({text!r})")

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and each word's number of ids."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        symbols = self.char_symbol[codes].astype(np.int64)
        place = np.arange(len(symbols))
        joined, pair = np.zeros(len(symbols), bool), np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            near = (codes[:-1] < _DENSE) & (codes[1:] < _DENSE)
            left, right = np.where(near, codes[:-1], 0), np.where(near, codes[1:], 0)
            joined[1:], pair[:-1] = self.near_meets[left, right], self.near_pair[left, right]
            far = np.flatnonzero(~near)
            keys = symbols[far] << 21 | symbols[far + 1]
            joined[far + 1], pair[far] = _member(self.meets, keys), self._find(keys)
            joined[1:] &= word[1:] == word[:-1]
            pair[:-1][~joined[1:]] = -1
        symbols, place = self._merge(symbols, place, np.cumsum(~joined), pair)
        word = word[place]
        other = symbols >= self.size
        if other.any():  # characters without a piece become their UTF-8 bytes
            raw = [chr(c).encode("utf-8", "replace") for c in codes[place[other]]]
            widths = np.ones(len(symbols), np.int64)
            widths[other] = [len(b) for b in raw]
            out = np.repeat(symbols, widths)
            out[np.repeat(other, widths)] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            symbols, word = out, np.repeat(word, widths)
        return symbols.astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, at, -1)

    def _merge(self, symbols, place, segment, pair):
        """pair: the merge of each symbol with the next one of its segment, -1 if there is none."""
        done_s, done_p = [np.zeros(0, symbols.dtype)], [np.zeros(0, place.dtype)]
        while len(symbols):
            rank = np.where(pair >= 0, self.pair_rank[pair], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            best = np.repeat(best, sizes)
            live = best < _NONE
            chosen = np.flatnonzero((rank == best) & live)
            done_s.append(symbols[~live])
            done_p.append(place[~live])
            if not len(chosen):
                break
            new_run = np.concatenate([[True], np.diff(chosen) != 1])
            run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(chosen)), 0))
            keep = (np.arange(len(chosen)) - run_at) % 2 == 0
            first = np.concatenate([[True], segment[chosen[1:]] != segment[chosen[:-1]]])
            apart = np.concatenate([[True], np.diff(place[chosen]) >= 2 * self.longest])
            chosen = chosen[np.where(self.pair_plain[pair[chosen]], keep, first | apart)]
            symbols[chosen] = self.pair_piece[pair[chosen]]
            live[chosen + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[chosen] = True
            symbols, place, segment, pair, changed = symbols[live], place[live], segment[live], pair[live], changed[live]
            changed[:-1] |= changed[1:]
            at = np.flatnonzero(changed)
            after = np.minimum(at + 1, len(symbols) - 1)
            found = self._find(symbols[at] << 21 | symbols[after])
            pair[at] = np.where((after > at) & (segment[at] == segment[after]), found, -1)
        symbols, place = np.concatenate(done_s), np.concatenate(done_p)
        order = np.argsort(place, kind="stable")
        return symbols[order], place[order]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after another, and each text's number of bytes."""
        widths, start = self.byte_width[ids], self.byte_start[ids]
        if self.prefix:
            first = (np.cumsum(sizes) - sizes)[sizes > 0]
            first = first[self.opens_with_space[ids[first]]]
            widths[first] -= 1
            start[first] += 1
        ends = np.cumsum(widths)
        flat = np.repeat(start - (ends - widths), widths) + np.arange(int(ends[-1]) if len(ends) else 0)
        total = np.concatenate([[0], ends])
        stops = np.cumsum(sizes)
        return self.byte_pool[flat], total[stops] - total[stops - sizes]


def _member(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


class _Numbered(dict):
    """Numbers words as they first come up; fresh lists the new ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.fresh.append(word)
        return number


class _WordCache:
    """Encoded words of a task: pool[start : start + width] are a word's ids."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index = _Numbered()
        self.pool, self.start, self.width = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > _CACHED_WORDS:
            self.clear()
        lead = " " if self.model.prefix else ""
        words = [_WORDS.findall(lead + t.replace(_SPACE, " ")) if t else [] for t in texts]
        every = [w for ws in words for w in ws]
        which = np.fromiter(map(self.index.__getitem__, every), np.int64, len(every))
        if self.index.fresh:
            ids, widths = self.model.encode_words(self.index.fresh)
            self.index.fresh = []
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(widths) - widths])
            self.width = np.concatenate([self.width, widths])
            self.pool = np.concatenate([self.pool, ids])
        widths = self.width[which]
        ends = np.cumsum(widths)
        flat = np.repeat(self.start[which] - (ends - widths), widths) + np.arange(int(ends[-1]) if len(ends) else 0)
        counts = np.concatenate([[0], ends])
        stops = np.cumsum([len(ws) for ws in words], dtype=np.int64)
        sizes = counts[stops] - counts[np.concatenate([[0], stops[:-1]])] if len(words) else np.zeros(0, np.int64)
        return self.pool[flat], sizes


def encode(docs: DataFrame, model_path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Adds `into` (array<int>): the ids of every whole text, without begin or end ids, as the
    sentencepiece library encodes it. All input columns stay, except one named like `into`,
    which is replaced. Null or empty text gives an empty list; repeated rows stay repeated; an
    empty table stays empty. Narrow: one pass, no shuffle, memory bounded by runs of rows of
    about 1 MB (a longer text makes a run of its own).
    """
    kept = docs.drop(into) if into in docs.columns else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordCache(PieceModel.load(model_path))
        for batch in batches:
            for rows in slices(batch, text, 1 << 20):
                ids, sizes = cache.encode(texts_of(rows.column(rows.schema.get_field_index(text))))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, lists], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds `into` (string): the text of the id list. Null or empty lists give empty text. The
    other columns stay, except one named like `into`. Ids outside the model raise an error."""
    kept = tokens.drop(into) if into in tokens.columns else tokens
    schema = T.StructType([*kept.schema.fields, T.StructField(into, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.load(model_path)
        for batch in batches:
            for rows in slices(batch, ids, 1 << 18):  # 2**18 ids
                lists = rows.column(rows.schema.get_field_index(ids))
                sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
                raw, widths = model.decode(np.asarray(lists.flatten(), np.int64), sizes)
                data, text, at = raw.tobytes(), [], 0
                for w in widths.tolist():
                    text.append(data[at : at + w].decode("utf-8", "replace"))
                    at += w
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(text, pa.string())], names=[*rows.schema.names, into])

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    tokens = encode(docs.select("doc_id", "text"), model_path).select("doc_id", "ids")
    back = decode(tokens, model_path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
