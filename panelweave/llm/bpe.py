"""Byte-pair encoding and decoding in batched numpy merge rounds.

A vocabulary file holds a normaliser (NFC, white-space runs to a blank, lower case), a splitting pattern, a
byte alphabet, tokens and ranked merges. The distinct words of a batch become one flat array of symbols. In
every round each word's adjacent pairs are looked up by binary search in the sorted pair keys, its
lowest-ranked pair is merged, and finished words leave the array.

One merge per word and round would be exact by definition. All places of the pair are merged at once only
where that gives the same result: when every merge that uses the new symbol ranks after this one.

Null texts encode to no ids and decode to the empty text. Texts are encoded whole. Repeated rows are encoded
each, null ids of rows are no matter, an empty table gives no rows. All other columns pass through; a column
that has the name of a new one is replaced by it.
"""

from __future__ import annotations

import json
import unicodedata
from collections import defaultdict
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Regex, normalizers
from tokenizers.pre_tokenizers import Split

from panelweave.llm.batches import Batches, bounded, map_batches, other_fields

# Texts of about so many bytes, or so many ids, are handled at once.
CHUNK = 1 << 20
# White space to Python but not to the vocabulary's pattern.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_NONE = np.iinfo(np.int64).max


@cache
def _newer() -> regex.Pattern:
    """Letters and numbers that Python's own character tables don't know yet."""
    known = regex.compile(r"[\p{L}\p{N}]")
    found = [c for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn" and known.match(chr(c))]
    runs = [found[0]] if found else [0x10FFFF]
    spans = []
    for c, following in zip(found, [*found[1:], 0], strict=True):
        if following != c + 1:
            spans.append(f"{chr(runs[-1])}-{chr(c)}")
            runs.append(following)
    return regex.compile("[" + "".join(spans) + "]" if spans else r"(?!)")


def _unfamiliar(text: str) -> bool:
    return not text.isascii() and max(text) >= "\u0500" and bool(_newer().search(text))


def _byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, free = {b: chr(b) for b in visible}, 0x100
    for b in range(256):
        if b not in names:
            names[b] = chr(free)
            free += 1
    return [names[b] for b in range(256)]


class Vocabulary:
    """The tables of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, ids = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = dict.fromkeys(self.special.values()) | {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.texts = pa.array([self.tokens.get(i) for i in range(max(self.tokens) + 1)], pa.string())
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.splitter = Split(Regex(pattern), "removed", invert=True)
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()])
        alphabet = _byte_alphabet()
        self.inner = np.array([ids[c] for c in alphabet], np.int64)
        self.final = np.array([ids[c + end] for c in alphabet], np.int64)
        self.width = max(ids.values()) + 1
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in side], np.int64) for side in zip(*((a, b, a + b) for a, b in merges), strict=True))
        keys = left * self.width + right
        first_use = np.full(self.width, _NONE)
        for side in (left, right):
            np.minimum.at(first_use, side, np.arange(len(merges)))
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made
        self.together = first_use[made] > np.arange(len(merges))

    def chunks(self, text: str) -> list[str]:
        """The normalised text cut at white space, which no word spans."""
        if _unfamiliar(text):
            # Which of these are letters, and their case, depends on the library's version: it is asked.
            return self.normalizer.normalize_str(text).split(" ")
        text = unicodedata.normalize("NFC", text)
        # Lower case letter by letter: the final sigma has no form of its own.
        text = text.replace("Σ", "σ").lower()
        return regex.split(r"\s+", text) if any(c in text for c in _CONTROLS) else text.split()

    def words(self, chunk: str) -> list[str]:
        if _unfamiliar(chunk):
            return [w for w, _ in self.splitter.pre_tokenize_str(chunk)]
        return self.split.findall(chunk)

    def encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and the offsets of each word."""
        data = [w.encode() for w in words]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        symbol, word = self.inner[flat], np.repeat(np.arange(len(data)), sizes)
        ends = np.cumsum(sizes) - 1
        symbol[ends] = self.final[flat[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            place, rank = self._best(symbol, word)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lowest = np.minimum.reduceat(rank, starts)
            here = np.repeat(lowest, np.diff(np.append(starts, len(word))))
            over = here == _NONE
            if over.any():
                done.append((word[over], symbol[over]))
            chosen = self._chosen((rank == here) & ~over, rank, word)
            symbol[chosen] = self.made[rank[chosen]]
            over[chosen + 1] = True
            symbol, word = symbol[~over], word[~over]
        word = np.concatenate([d[0] for d in done]) if done else np.empty(0, np.int64)
        symbol = np.concatenate([d[1] for d in done]) if done else np.empty(0, np.int64)
        order = np.argsort(word, kind="stable")
        return symbol[order], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(data)))))

    def _best(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each symbol the place and rank of the merge with its right neighbour; _NONE without one."""
        rank = np.full(len(symbol), _NONE)
        key = symbol[:-1] * self.width + symbol[1:]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = (self.keys[place] == key) & (word[:-1] == word[1:])
        rank[:-1][found] = self.rank[place[found]]
        return place, rank

    def _chosen(self, candidate: np.ndarray, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places to merge: from the left without overlap, or only a word's first where later merges could interfere."""
        at = np.flatnonzero(candidate)
        new_run = np.concatenate(([True], np.diff(at) != 1))
        run_start = np.maximum.accumulate(np.where(new_run, at, 0)) if len(at) else at
        first = np.concatenate(([True], word[at][1:] != word[at][:-1])) if len(at) else np.empty(0, bool)
        return at[((at - run_start) % 2 == 0) & (first | self.together[rank[at]])]

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of each text."""
        index: dict[str, int] = defaultdict()
        index.default_factory = index.__len__
        places: list[np.ndarray] = []
        for text in texts:
            if text and any(s in text for s in self.special):
                mine: list[int] = []
                for i, part in enumerate(self.special_pattern.split(text)):
                    mine.extend([-1 - self.special[part]] if i % 2 else map(index.__getitem__, self.chunks(part)))
            else:
                mine = list(map(index.__getitem__, self.chunks(text or "")))
            places.append(np.array(mine, np.int64))
        inner = [self.words(c) for c in index]
        ids, offsets = self.encode_words([w for words in inner for w in words])
        offsets = offsets[np.cumsum([0, *map(len, inner)])]
        # Special tokens are one-id entries after the chunks.
        special = np.array(sorted(self.special.values()), np.int64)
        ids, offsets = np.concatenate((ids, special)), np.concatenate((offsets, offsets[-1] + 1 + np.arange(len(special))))
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        place = np.where(place >= 0, place, len(index) + np.searchsorted(special, -1 - place))
        sizes = np.diff(offsets)[place]
        total = np.concatenate(([0], np.cumsum(sizes)))
        flat = ids[np.repeat(offsets[place] - total[:-1], sizes) + np.arange(total[-1])]
        return flat, total[np.cumsum([0, *map(len, places)])]

    def decode(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The texts of ids in one array with offsets: tokens joined by a blank, special ones included.

        The file names no decoder, so that is all there is to it. Ids without a token are left out.
        """
        known = (flat >= 0) & (flat < len(self.texts))
        if not known.all():
            ends, flat = np.concatenate(([0], np.cumsum(known)))[ends], flat[known]
        tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.texts.take(pa.array(flat)))
        return pc.binary_join(tokens, " ")


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array column `ids`; the vocabulary file must be readable by every executor."""
    kept = other_fields(docs, [ids])
    kinds = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Batches) -> Batches:
        for batch in bounded(batches, text, CHUNK):
            rest = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, _lists(*vocabulary(path).encode(batch.column(text).to_pylist()))], kinds.names)

    return map_batches(docs, run, kinds)


def encode_and_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Replace `text` by its ids and add their decoding, in one pass over the texts."""
    kept = other_fields(docs, [text, ids, decoded])
    kinds = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Batches) -> Batches:
        for batch in bounded(batches, text, CHUNK):
            flat, ends = vocabulary(path).encode(batch.column(text).to_pylist())
            rest = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*rest, _lists(flat, ends), vocabulary(path).decode(flat, ends)], kinds.names)

    return map_batches(docs, run, kinds)


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the text column `decoded`; null ids decode to the empty text."""
    kept = other_fields(docs, [decoded])
    kinds = T.StructType([*kept, T.StructField(decoded, T.StringType())])

    def run(batches: Batches) -> Batches:
        for batch in bounded(batches, ids, CHUNK):
            rows = batch.column(ids)
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(rows.flatten(), -1).to_numpy(zero_copy_only=False)
            made = vocabulary(path).decode(flat, np.concatenate(([0], np.cumsum(sizes))))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], made], kinds.names)

    return map_batches(docs, run, kinds)
