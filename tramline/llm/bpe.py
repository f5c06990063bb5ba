"""Byte-pair encoding and decoding with a pair occurrence index.

The words of a batch that have not been met lately are laid out in one list of symbols. An index maps each pair of
neighbours to all of its positions; ranks that occur are applied in ascending order, each to all positions of its pair
from the left, and the lists of the pairs around a merge are updated. So a merge costs as much as the places it changes,
and words are never scanned again for their next merge. The vocabulary file is that of the tokenizers library, whose
ids and decoding this reproduces for vocabularies with word ends, lower-casing and byte-level symbols.

Defined cases: a null or empty text has no ids and decodes to the empty text; very long texts are encoded whole, word by
word; repeated rows have equal results; an empty table gives no rows; other columns of the input are not read, whatever
their names. Where a text has code points that this Python's Unicode doesn't know, the library's own normalizer and
splitter, which may know them, cut it into words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from tramline.llm.common import table

VOCABULARY = "word_bpe_49k"
#: Words, and pieces between white space, whose ids a worker keeps; twice as many at most.
REMEMBERED = 150_000
#: Texts of a batch are taken until they have so many characters.
STRIDE = 4_000_000
#: Separators to str.split() that aren't white space to the vocabulary.
ODD = regex.compile(r"[\x1c-\x1f]")


def _same_order(mark: str) -> bool:
    """Whether the library sorts a combining mark as unicodedata does, which its own tables may not know yet."""
    library = normalizers.NFC()
    return all(library.normalize_str(x) == unicodedata.normalize("NFC", x) for x in (f"a{mark}\u0334", f"a\u0345{mark}"))


@lru_cache(1)
def _unknown() -> re.Pattern:
    """The code points that unicodedata has no category for, and the marks that the library doesn't know."""
    odd = {c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cn" or unicodedata.combining(chr(c)) and not _same_order(chr(c))}
    edges, inside = [], False
    for c in range(sys.maxunicode + 2):
        if (c in odd) != inside:
            edges.append(c)
            inside = not inside
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True)) + "]")


#: Anything from the first of them on; a range is found faster than a class.
HIGH = re.compile("[\u0378-\U0010ffff]")


def unknown(text: str) -> bool:
    return HIGH.search(text) is not None and _unknown().search(text) is not None


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    place = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [place[b] for b in range(256)]


def merge_words(words: list[list[int]], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[list[int]]:
    """The words' symbols after all merges. ranks: pair to (rank, symbol)."""
    symbols: list[int] = []
    for word in words:
        symbols += word
        symbols.append(-1)  # no pair crosses it
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[tuple[int, int], list[int]] = {}
    for at in range(n - 1):
        pair = symbols[at], symbols[at + 1]
        if pair in ranks:
            index.setdefault(pair, []).append(at)
    active = [(*ranks[pair], *pair) for pair in index]
    heapq.heapify(active)
    while active:
        _, merged, left, right = heapq.heappop(active)
        places = index.pop((left, right), None)
        if places is None:
            continue
        places.sort()
        for at in places:
            second = after[at]
            if symbols[at] != left or second >= n or symbols[second] != right:
                continue  # a merge before took one of the two
            symbols[at], symbols[second] = merged, -2
            third = after[second]
            after[at] = third
            if third < n:
                before[third] = at
                found = ranks.get(pair := (merged, symbols[third]))
                if found:
                    if pair not in index:
                        heapq.heappush(active, (*found, *pair))
                        index[pair] = []
                    index[pair].append(at)
            first = before[at]
            if first >= 0:
                found = ranks.get(pair := (symbols[first], merged))
                if found:
                    if pair not in index:
                        heapq.heappush(active, (*found, *pair))
                        index[pair] = []
                    index[pair].append(first)
    out: list[list[int]] = []
    own: list[int] = []
    for s in symbols:
        if s >= 0:
            own.append(s)
        elif s == -1:
            out.append(own)
            own = []
    return out


class WordBpe:
    """A vocabulary file, and what it made of the words met lately."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        shown = byte_symbols()
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + self.end] for c in shown]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        self.normalizer, self.splitter = Tokenizer.from_file(path).normalizer, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        # No decoder is set: tokens are joined by blanks, as they stand in the vocabulary.
        self.text = {v: k for k, v in vocab.items()} | {v: k for k, v in self.special.items()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        """Encode pieces between white space that aren't known."""
        known, older = self.known, self.older
        new = []
        for p in pieces:
            if (value := older.get(p)) is None:
                new.append(p)
            else:
                known[p] = value
        words_of = {p: self._words(p) for p in new}
        missing = list({w for words in words_of.values() for w in words})
        encoded = [w.encode() for w in missing]
        merged = merge_words([[*(self.inner[b] for b in w[:-1]), self.last[w[-1]]] for w in encoded], self.ranks)
        ids = {w: struct.pack(f"<{len(m)}I", *m) for w, m in zip(missing, merged, strict=True)}
        for p, words in words_of.items():
            known[p] = ids[words[0]] if len(words) == 1 else b"".join(map(ids.__getitem__, words))

    def _words(self, piece: str) -> list[str]:
        return [w for w, _ in self.splitter.pre_tokenize_str(piece)] if unknown(piece) else self.split.findall(piece)

    def _pieces(self, text: str) -> list[str]:
        if not text.isascii():
            if unknown(text):
                return regex.split(r"\p{White_Space}+", self.normalizer.normalize_str(text))
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        text = text.lower()  # letter by letter, without the final sigma
        return regex.split(r"\p{White_Space}+", text) if ODD.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut: list[list[str] | bytes] = []
        rows = []
        for text in texts:
            start = len(cut)
            for k, part in enumerate(self.parts.split(text) if "<|" in text else (text,)):
                cut.append(struct.pack("<I", self.special[part]) if k % 2 else self._pieces(part))
            rows.append((start, len(cut)))
        lists = [x for x in cut if not isinstance(x, bytes)]
        self._learn(set().union(*lists).difference(self.known))
        get = self.known.__getitem__
        done = [x if isinstance(x, bytes) else b"".join(map(get, filter(None, x))) for x in cut]
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        return [b"".join(done[a:b]) for a, b in rows]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.text.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


@lru_cache(2)
def bpe_of(path: str) -> WordBpe:
    return WordBpe(path)


def _blocks(texts: list[str]) -> Iterator[list[str]]:
    block: list[str] = []
    size = 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= STRIDE:
            yield block
            block, size = [], 0
    if block:
        yield block


def _rows(path: str, with_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        bpe = bpe_of(path)
        for batch in batches:
            rows = []
            for block in _blocks([t or "" for t in batch["text"]]):
                for ids in bpe.encode(block):
                    decoded = bpe.decode(ids)
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *((ids, decoded) if with_ids else ())))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(("ids", "decoded") if with_ids else ())])
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    return run


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """n_tokens and digests of ids and decoded text for each document; with_ids, the ids and the decoded text too.

    path: a vocabulary file that all executors have; the installed one by default.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_rows(path or public_tokenizers.path(f"{VOCABULARY}.json"), with_ids), schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
