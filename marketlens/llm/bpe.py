"""BPE encoding and decoding of whole texts with a public vocabulary file.

Each distinct word is merged once per task over a contiguous rank array: the part boundaries and the
rank of every adjacent pair sit in two parallel lists; the least rank is found by a scan, its inner
boundary is deleted and the two neighbouring ranks are refreshed.  Words beyond ``SHORT`` parts go
through the same merges with a heap, so a very long "word" costs n log n instead of n squared.

Defined results: null and empty texts have no ids and decode to the empty text; repeated rows get equal
values; other columns of the input are untouched (the result is one added struct column, and an input
column of that name is replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import slices

SHORT = 128
#: Words whose merges a task keeps; beyond it the memo starts anew before the next text.
MEMO = 100_000
RESULT = "struct<n_tokens:bigint,ids:binary,decoded:string>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others take code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder for a word-end byte-level BPE file (lower-cased words, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model.get("end_of_word_suffix") or ""
        alphabet = byte_alphabet()
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        # Ids of each byte inside a word and at its end; a byte that the vocabulary lacks is dropped.
        self.inner = [vocab.get(alphabet[b]) for b in range(256)]
        self.last = [vocab.get(alphabet[b] + suffix) for b in range(256)]
        # Rank of a pair of ids, packed in one integer, and the id that each rank makes.
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for pair in model["merges"]:
            x, y = pair if not isinstance(pair, str) else pair.split(" ")
            self.rank.setdefault(vocab[x] << 32 | vocab[y], len(self.made))
            self.made.append(vocab[x + y])
        self.added_re = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        # Fixed value: the word pattern named by the vocabulary file, with white space spelt as the Unicode property.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
        # The same pattern where a text has only ASCII and Latin letters, for the standard library's faster matcher.
        letters = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
        self.latin_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\t-\r 0-9{letters}]+").findall
        self.beyond_latin = re.compile(rf"[^\x00-\x7f{letters}]").search
        self.ids_of, self.shown_of = _Memo(self.word_ids), _Memo(self.word_shown)

    def merged(self, word: str) -> list[int]:
        """The ids of one word after all merges, lowest rank first and leftmost among equals."""
        raw = word.encode()
        parts = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if None in parts:
            parts = [p for p in parts if p is not None]
        if len(parts) > SHORT:
            return self._merged_long(parts)
        none = len(self.made)
        get = self.rank.get
        near = [get(x << 32 | y, none) for x, y in zip(parts, parts[1:])]
        while near:
            least = min(near)
            if least == none:
                break
            i = near.index(least)
            parts[i] = new = self.made[least]
            del parts[i + 1], near[i]
            if i:
                near[i - 1] = get(parts[i - 1] << 32 | new, none)
            if i < len(near):
                near[i] = get(new << 32 | parts[i + 1], none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.rank.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if j < 0 or parts[i] != x or parts[j] != y:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (r := self.rank.get(parts[left] << 32 | parts[right])) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def word_ids(self, word: str) -> bytes:
        ids = self.merged(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def word_shown(self, word: str) -> str:
        return self.decode(self.ids_of[word])

    def _plain(self, text: str) -> tuple[bytes, str]:
        if self.beyond_latin(text):
            # Lower-casing is by character (no word-final form of sigma).
            words = self.words(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        else:
            words = self.latin_words(text.lower())
        return b"".join(map(self.ids_of.__getitem__, words)), " ".join(filter(None, map(self.shown_of.__getitem__, words)))

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the decoded text.

        Strings of added tokens are found in the raw text first, as the file's rules ask.
        """
        for memo in (self.ids_of, self.shown_of):
            if len(memo) > MEMO:
                memo.clear()
        if not (self.added_re and any(t in text for t in self.added)):
            return self._plain(text)
        parts, at = [], 0
        for m in self.added_re.finditer(text):
            parts += [self._plain(text[at : m.start()]), (struct.pack("<I", self.added[m[0]]), m[0])]
            at = m.end()
        parts.append(self._plain(text[at:]))
        return b"".join(p[0] for p in parts), " ".join(p[1] for p in parts if p[1])

    def decode(self, ids: bytes) -> str:
        """The tokens of ``ids`` joined by blanks: the file names no decoder, so that is its decoded form."""
        return " ".join(map(self.names.__getitem__, struct.unpack(f"<{len(ids) // 4}I", ids)))


class _Memo(dict):
    """A dict that fills itself."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        self[word] = out = self.make(word)
        return out


def _udf(path: str, digest: bool):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = WordBpe(path)
        for batch in slices(batches):
            n, first, second = [], [], []
            for text in batch:
                ids, shown = bpe.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if digest else ids)
                second.append(hashlib.sha256(shown.encode()).hexdigest() if digest else shown)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(first, pa.string() if digest else pa.binary()), pa.array(second, pa.string())], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, DIGEST if digest else RESULT)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """``docs`` with a struct column ``out``: n_tokens, ids (little-endian u32) and the decoded text."""
    return docs.withColumn(out, _udf(path, False)(F.col(f"`{text}`")))


def encode_digest(docs: DataFrame, path: str, text: str = "text", out: str = "bpe") -> DataFrame:
    """As :func:`encode`, but the task keeps only the count and the SHA-256 of ids and of the decoded text."""
    return docs.withColumn(out, _udf(path, True)(F.col(f"`{text}`")))
