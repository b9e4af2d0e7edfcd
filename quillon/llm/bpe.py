"""BPE encoding and decoding with a ready-made vocabulary, in batched numpy merge rounds.

The tokenizer file (its path is a parameter) is a word-level BPE in the ``tokenizers`` JSON format:
NFC, white space, lower case; a split pattern whose matches are the words; bytes written as
printable characters; a suffix on the last symbol of a word. Nothing is trained here.

A batch's unknown words lie in one flat symbol array. Each round looks up every adjacent pair by
binary search in the sorted pair keys, takes each word's lowest rank, and merges it in all words at
once. A worker keeps the encodings of words it has seen, in a table that is emptied when it is full
(speed only; results do not depend on it).

Decoding joins the token strings as the file's decoder says; with no decoder, by one space.

Defined results. A null text counts as empty: no ids, decoded text empty. Literal special tokens
inside a text become their ids, as the library does by default. Symbols outside the vocabulary are
dropped, as the library does without an unknown token. Rows that repeat are rows of their own. A very long text is one
row; a very long word is merged by itself. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from .common import ship_package, text_or_empty

NONE = np.int64(1 << 60)
#: Words a worker remembers, and characters of words encoded at a time.
CACHE_WORDS, ROUND_CHARS = 150_000, 1_000_000
#: Bytes from which on a word is merged by itself.
LONG = 2048


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in plain}
    for n, b in enumerate(x for x in range(256) if x not in table):
        table[b] = chr(256 + n)
    return [table[b] for b in range(256)]


def _newer_characters() -> frozenset[str]:
    """What ``regex`` knows and Python's older tables do not."""
    unassigned = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")
    return frozenset(regex.findall(r"\P{Cn}", unassigned))


class Bpe:
    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if model["type"] != "BPE" or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("only word-level BPE files without decoder and post-processor are supported")
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"])
        # Characters whose class depends on the Unicode version: for texts that hold one, the library's own tables part the words.
        self.newer = _newer_characters()
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.splitter = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.names = {i: s for s, i in (vocab | self.special).items()}
        self.width = max(self.names) + 1
        symbols = _byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], np.int64)
        self.final = np.array([vocab.get(s + self.suffix, -1) for s in symbols], np.int64)
        keys, new = [], []
        for pair in model["merges"]:
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            keys.append(vocab[x] * self.width + vocab[y])
            new.append(vocab[x + y])
        rank = np.arange(len(keys), dtype=np.int64)
        keys, new = np.array(keys, np.int64), np.array(new, np.int64)
        # A merge may be done everywhere in a word at once if no merge of what it makes ranks lower.
        first_use = np.full(self.width, NONE, np.int64)
        np.minimum.at(first_use, keys // self.width, rank)
        np.minimum.at(first_use, keys % self.width, rank)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.new, self.safe = keys[order], rank[order], new[order], (first_use[new] > rank)[order]
        self.by_rank = np.argsort(self.rank)
        self.known: dict[str, int] = {}  # word -> row in the tables below
        self.reset()

    def reset(self) -> None:
        self.known = {}
        self.flat = np.zeros(0, np.int64)
        self.start = np.zeros(1, np.int64)

    # --- normalisation and words -------------------------------------------------------------
    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        # Lower-casing is by character: without the rule for a sigma that ends a word.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def find(self, text: str) -> list[str]:
        if not text.isascii() and not self.newer.isdisjoint(text):
            normal = self.library.normalizer.normalize_str(text)
            return [w for w, _ in self.splitter.pre_tokenize_str(normal)]
        return self.words.findall(self.normal(text))

    def pieces(self, text: str) -> list[str]:
        """Words in order; a special token stands in the list as its own string after a space, which no word holds."""
        if not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for part in self.special_re.split(text):
            if part in self.special:
                out.append(" " + part)
            else:
                out += self.find(part)
        return out

    # --- merge rounds ------------------------------------------------------------------------
    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the number of ids of each."""
        raw = [w.encode() for w in words]
        far = np.fromiter((len(x) > LONG for x in raw), bool, len(raw))
        if not far.any():
            return self._merge_flat(raw)
        ids, count = self._merge_flat([x for x, f in zip(raw, far.tolist()) if not f])
        short = iter(np.split(ids, np.cumsum(count)[:-1])) if len(count) else iter(())
        lists = [self._merge_long(x) if f else next(short) for x, f in zip(raw, far.tolist())]
        return np.concatenate(lists), np.array([len(x) for x in lists], np.int64)

    def _merge_long(self, raw: bytes) -> np.ndarray:
        """Ids of one very long word. A round merges the pairs of the lowest rank at the places where they are known to
        stand, and looks up only the pairs that this makes, so the cost is nearly linear in the word."""
        sym = self.inner[np.frombuffer(raw, np.uint8)].astype(np.int64)
        sym[-1] = self.final[raw[-1]]
        sym = sym[sym >= 0]
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(pos: np.ndarray) -> None:
            pos = pos[after[pos] < n]
            key = sym[pos] * self.width + sym[after[pos]]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            pos, rank = pos[known], self.rank[at[known]]
            order = np.argsort(rank, kind="stable")
            pos, rank = pos[order], rank[order]
            heads = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else []
            for r, part in zip(rank[heads].tolist() if len(rank) else [], np.split(pos, heads[1:]) if len(rank) else []):
                if r not in waiting:
                    heapq.heappush(heap, r)
                waiting.setdefault(r, []).append(part)

        push(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            pos = np.unique(np.concatenate(waiting.pop(r)))
            a = self.by_rank[r]
            pos = pos[alive[pos] & (after[pos] < n)]
            pos = pos[sym[pos] * self.width + sym[after[pos]] == self.keys[a]]
            if not len(pos):
                continue
            # Leftmost first, as in the flat rounds.
            run = np.r_[True, after[pos[:-1]] != pos[1:]]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
            take = (np.arange(len(pos)) - begin) % 2 == 0
            if not self.safe[a]:
                take[1:] = False
                if len(pos) > 1:
                    heapq.heappush(heap, r)
                    waiting[r] = [pos[1:]]
            pos = pos[take]
            gone = after[pos]
            sym[pos], alive[gone], after[pos] = self.new[a], False, after[gone]
            last = after[pos] < n
            before[after[pos[last]]] = pos[last]
            left = before[pos]
            push(np.unique(np.r_[left[left >= 0], pos]))
        return sym[alive]

    def _merge_flat(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`merge`, of words as bytes: all symbols of all words in every round."""
        if not raw:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[data]
        end = np.cumsum(length) - 1
        sym[end] = self.final[data[end]]
        word = np.repeat(np.arange(len(raw)), length)
        if (sym < 0).any():
            keep = sym >= 0
            sym, word = sym[keep], word[keep]
        out_sym, out_word = [], []
        while len(sym):
            same = word[:-1] == word[1:]
            key = np.where(same, sym[:-1] * self.width + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.rank[at], NONE)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(np.append(rank, NONE), heads)
            size = np.diff(np.append(heads, len(word)))
            done = np.repeat(best == NONE, size)
            if done.any():
                out_sym.append(sym[done])
                out_word.append(word[done])
            hit = np.append((rank == np.repeat(best, size)[:-1]) & (rank < NONE), False)
            pos = np.flatnonzero(hit)
            if len(pos):
                # Leftmost first: in a run of overlapping hits every other one; of an unsafe merge only the first in its word.
                run = np.r_[True, (np.diff(pos) != 1) | (word[pos[1:]] != word[pos[:-1]])]
                begin = np.maximum.accumulate(np.where(run, np.arange(len(pos)), 0))
                take = (np.arange(len(pos)) - begin) % 2 == 0
                new_word = np.r_[True, word[pos[1:]] != word[pos[:-1]]]
                take &= self.safe[at[pos]] | new_word
                pos = pos[take]
                sym = sym.copy()
                sym[pos] = self.new[at[pos]]
            keep = ~done
            keep[pos + 1] = False
            sym, word = sym[keep], word[keep]
        if not out_sym:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=len(raw))

    def learn(self, words: list[str]) -> None:
        """Add words to the worker's table."""
        todo: list[str] = []
        size = 0
        for w in chain(words, (None,)):
            if w is not None:
                todo.append(w)
                size += len(w)
            if todo and (w is None or size > ROUND_CHARS):
                plain = [x for x in todo if x[0] != " "]
                ids, count = self.merge(plain) if plain else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                marks = [x for x in todo if x[0] == " "]
                ids = np.r_[ids, np.array([self.special[x[1:]] for x in marks], np.int64)]
                count = np.r_[count, np.ones(len(marks), np.int64)]
                at = len(self.start) - 1
                self.known.update(zip(plain + marks, range(at, at + len(count))))
                self.start = np.r_[self.start, self.start[-1] + np.cumsum(count)]
                self.flat = np.r_[self.flat, ids]
                todo, size = [], 0

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's ids begin (one more entry than texts)."""
        if len(self.known) > CACHE_WORDS:
            self.reset()
        lists = [self.pieces(t) for t in texts]
        unseen = set(chain.from_iterable(lists)).difference(self.known)
        if unseen:
            self.learn(sorted(unseen))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        row = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        begin, size = self.start[row], self.start[row + 1] - self.start[row]
        total = np.r_[0, np.cumsum(size)]
        flat = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return flat, total[np.r_[0, np.cumsum(counts)]]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    # --- decoding ----------------------------------------------------------------------------
    def token_bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All token strings in one byte array, a space after each; where each begins and its length."""
        raw = [(self.names.get(i, "") + " ").encode() for i in range(self.width)]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        return np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length, length

    def decode_batch(self, flat: np.ndarray, start: np.ndarray) -> list[bytes]:
        """UTF-8 of each text's tokens joined by one space."""
        if not hasattr(self, "_table"):
            self._table = self.token_bytes()
        data, begin, length = self._table
        out = []
        for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
            ids = flat[a:b]
            size = length[ids]
            total = np.cumsum(size)
            if not len(ids):
                out.append(b"")
                continue
            where = np.repeat(begin[ids] - (total - size), size) + np.arange(total[-1])
            out.append(data[where].tobytes()[:-1])
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].decode()


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def _slices(batches, chars: int):
    """Smaller batches, so that a few long texts don't fill a worker."""
    for b in batches:
        size = b.column(1).nbytes
        step = max(1, int(b.num_rows * chars / max(size, chars)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _digests(path: str, id_type: pa.DataType, with_ids: bool = False):
    schema = pa.schema([("key", id_type), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches):
        bpe = load(path)
        for b in _slices(batches, ROUND_CHARS):
            flat, start = bpe.encode_batch(b.column(1).to_pylist())
            wide = flat.astype("<u4")
            ids = [hashlib.sha256(wide[a:z].tobytes()).hexdigest() for a, z in zip(start[:-1].tolist(), start[1:].tolist())]
            text = [hashlib.sha256(x).hexdigest() for x in bpe.decode_batch(flat, start)]
            more = [pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat.astype(np.int32)))] if with_ids else []
            yield pa.record_batch([b.column(0), pa.array(np.diff(start)), pa.array(ids), pa.array(text), *more], schema=schema)

    return run


def _ids(path: str, id_type: pa.DataType):
    schema = pa.schema([("key", id_type), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        bpe = load(path)
        for b in _slices(batches, ROUND_CHARS):
            flat, start = bpe.encode_batch(b.column(1).to_pylist())
            ids = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.record_batch([b.column(0), ids], schema=schema)

    return run


def _texts(path: str, id_type: pa.DataType):
    schema = pa.schema([("key", id_type), ("text", pa.string())])

    def run(batches):
        bpe = load(path)
        for b in batches:
            lists = [x or [] for x in b.column(1).to_pylist()]
            start = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
            flat = np.fromiter(chain.from_iterable(lists), np.int64, int(start[-1]))
            yield pa.record_batch([b.column(0), pa.array([x.decode() for x in bpe.decode_batch(flat, start)])], schema=schema)

    return run


def _apply(docs: DataFrame, id_col: str, col, make, path: str, fields: list[tuple[str, T.DataType]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type

    ship_package(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("key"), col)
    kind = source.schema["key"].dataType
    schema = T.StructType().add("key", kind)
    for name, t in fields:
        schema = schema.add(name, t)
    return source.mapInArrow(make(path, to_arrow_type(kind)), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, ids`` of every text."""
    return _apply(docs, id_col, text_or_empty(text_col).alias("text"), _ids, path, [("ids", T.ArrayType(T.IntegerType()))])


def decode(encoded: DataFrame, path: str, id_col: str = "key", ids_col: str = "ids") -> DataFrame:
    """``key, text`` of every list of ids."""
    return _apply(encoded, id_col, F.col(ids_col).alias("ids"), _texts, path, [("text", T.StringType())])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``): each text encoded, and its ids decoded again."""
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    return _apply(docs, id_col, text_or_empty(text_col).alias("text"), partial(_digests, with_ids=with_ids), path, fields)
