"""SentencePiece BPE encoding and decoding of whole texts with a public model file, over a table of distinct chunks.

In these models no piece has anything before a white-space marker but markers, so no merge joins a character to a
marker that follows it (checked when the file is read; another model is refused).  A text is therefore a row of marked
words, a run of markers and the word behind it, that are merged independently.  Each slice of a task's texts becomes
one column of marked words in order; Arrow's dictionary encoding gives the distinct ones and, for each position, which
one stands there; only distinct ones are merged, once a task (up to ``MEMO`` are remembered); and the ids are joined
back by position, one gather over all positions of the slice.  Nothing is shuffled.  Decoding gathers the bytes of the
pieces in the same way.

Defined results: null and empty texts have the begin and end ids alone and decode to the empty text; a marker character
in a text is a blank, as for the library; bytes that are no UTF-8 (which only ids from elsewhere can give) decode to
one U+FFFD each; words of any length are merged whole (beyond ``SHORT`` characters with a heap, n log n) and very long
texts as a whole; repeated rows get equal values; an empty table gives no row; other columns are untouched (the result
is one added struct column, and an input column of its name is replaced).
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import slices

MARK = "▁"
#: Characters up to which a word's best pair is found by a scan.
SHORT = 64
#: Marked words whose ids a task remembers; beyond it the memo starts anew before the next slice.
MEMO = 500_000
#: Bytes of text that become one column of marked words, and ids or bytes that one gather makes.
SLICE, GATHER = 4 << 20, 1 << 20
RESULT = "struct<n_tokens:bigint,ids:binary,decoded:string>"
DIGEST = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


def gather(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``table`` at ``starts``, each of its size, one behind the other."""
    ends = np.cumsum(sizes)
    return table[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Ragged:
    """Arrays of several lengths in one, to which rows are added: row ``i`` is a stretch of ``flat``."""

    def __init__(self, kind: str):
        self.flat, self.ends = array(kind), array("q", [0])

    def add(self, row) -> int:
        self.flat.extend(row)
        self.ends.append(len(self.flat))
        return len(self.ends) - 2

    def sizes(self, rows: np.ndarray) -> np.ndarray:
        ends = np.frombuffer(self.ends, np.int64)
        return ends[rows + 1] - ends[rows]

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The rows' stretches, joined; a bounded number of items at a time."""
        if not len(rows) or not len(self.flat):
            return np.empty(0, self.flat.typecode)
        flat, starts, sizes = np.frombuffer(self.flat, self.flat.typecode), np.frombuffer(self.ends, np.int64)[rows], self.sizes(rows)
        upto = np.cumsum(sizes)
        if upto[-1] <= GATHER:
            return gather(flat, starts, sizes)
        cuts = np.searchsorted(upto, np.arange(GATHER, upto[-1], GATHER)) + 1
        return np.concatenate([gather(flat, a, n) for a, n in zip(np.split(starts, cuts), np.split(sizes, cuts))])


class PieceModel:
    """Reader of a BPE model file with byte fallback, a marker put before the text, and no other normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_

        spec, kinds = format_.ModelProto(), format_.ModelProto.SentencePiece
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules, train = spec.normalizer_spec, spec.trainer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        if not (train.model_type == train.BPE and train.byte_fallback and plain and not train.treat_whitespace_as_suffix):
            raise ValueError("the model must be BPE with byte fallback, a marker before the text and no other normalisation")
        if any(p.type not in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in spec.pieces):
            raise ValueError("the model must have no user-defined or unused pieces")
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kinds.NORMAL}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in normal):
            raise ValueError("a piece of the model crosses a white-space marker")
        self.id = normal
        # Merges go by score; equal scores share a rank, the leftmost of them comes first.
        scores = sorted({spec.pieces[i].score for i in normal.values()}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        self.rank = {p: rank[spec.pieces[i].score] for p, i in normal.items() if len(p) > 1}
        self.none = len(scores)
        byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == kinds.BYTE}
        self.byte = [byte[b] for b in range(256)]
        self.begin, self.end = train.bos_id, train.eos_id
        shown = {i: p.replace(MARK, " ").encode() for p, i in normal.items()} | {i: bytes([b]) for b, i in byte.items()}
        unknown = {i: train.unk_surface.encode() for i, p in enumerate(spec.pieces) if p.type == kinds.UNKNOWN}
        self.marked = np.array([p.type == kinds.NORMAL and p.piece.startswith(MARK) for p in spec.pieces])
        self.shown = Ragged("B")
        for i in range(len(spec.pieces)):
            self.shown.add((shown | unknown).get(i, b""))

    def parts(self, chunk: str) -> list[str]:
        """The pieces and single characters that merging leaves: best score first, leftmost among equals."""
        parts = list(chunk)
        if len(parts) > SHORT:
            return self._parts_long(parts)
        get, none = self.rank.get, self.none
        near = [get(chunk[i : i + 2], none) for i in range(len(parts) - 1)]
        while near and (least := min(near)) != none:
            i = near.index(least)
            parts[i] = piece = parts[i] + parts.pop(i + 1)
            del near[i]
            if i:
                near[i - 1] = get(parts[i - 1] + piece, none)
            if i < len(near):
                near[i] = get(piece + parts[i + 1], none)
        return parts

    def _parts_long(self, parts: list[str]) -> list[str]:
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, whole = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j < 0 or len(parts[i]) + len(parts[j]) != len(whole):
                continue
            parts[i], parts[j] = whole, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (r := self.rank.get(parts[x] + parts[after[x]])) is not None:
                    heapq.heappush(heap, (r, x, parts[x] + parts[after[x]]))
        return [p for p in parts if p]

    def chunk_ids(self, chunk: str) -> list[int]:
        out = []
        for p in self.parts(chunk):
            i = self.id.get(p)
            out += [i] if i is not None else [self.byte[b] for b in p.encode()]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes of the pieces joined, without the one blank that stands for the marker put in front."""
        ids = np.asarray(ids, np.int64)
        text = self.shown.take(ids).tobytes().decode("utf-8", "each_byte")
        first = ids[self.shown.sizes(ids) > 0][:1]
        return text[1:] if len(first) and self.marked[first[0]] else text


class ChunkTable:
    """Ids of marked words, each distinct one merged once."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.ids = Ragged("i")

    def row_of(self, chunk: str) -> int:
        """The row of a marked word's ids in the table; a new word is merged and gets the next one."""
        if (row := self.row.get(chunk)) is None:
            row = self.row[chunk] = self.ids.add(self.model.chunk_ids(chunk))
        return row

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (a string array; null is empty), begin and end included."""
        if not len(texts):
            return []
        if len(self.row) > MEMO:
            self.forget()
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), pattern=" ", replacement=MARK), pattern=MARK)
        flat, sizes = words.flatten(), pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        text_of, end = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
        # Each word has one marker before it; an empty word hands its own on to the next one, if its text has more.
        blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)
        stop = ~blank
        stop[end - 1] = True
        stop[(end - 1)[(sizes == 1) & blank[end - 1]]] = False  # an empty text has no marker either
        at = np.flatnonzero(stop)
        text_of, run = text_of[at], np.diff(at, prepend=-1)
        starts = np.flatnonzero(np.diff(text_of, prepend=-1))
        run[starts] = (at - (end - sizes)[text_of] + 1)[starts]
        coded = flat.take(pa.array(at)).dictionary_encode()
        code, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
        row = np.empty(len(at), np.int64)
        for n in np.unique(run).tolist():  # runs of one marker and the few other lengths there are
            here = run == n
            chosen, mark = np.unique(code[here]) if n > 1 else np.arange(len(names)), MARK * n
            rows = np.zeros(len(names), np.int64)
            rows[chosen] = [self.row_of(mark + names[c]) for c in chosen.tolist()]
            row[here] = rows[code[here]]
        ids, count = self.ids.take(row), np.bincount(text_of, self.ids.sizes(row), len(sizes)).astype(np.int64)
        begin, stop_ = np.array([self.model.begin]), np.array([self.model.end])
        return [np.concatenate([begin, x, stop_]) for x in np.split(ids, np.cumsum(count)[:-1])]


def _udf(path: str, digest: bool):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = ChunkTable(PieceModel(path))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in slices(batches, most=SLICE):
            n, ids, shown = [], [], []
            for one in table.encode(batch):
                raw, text = one.astype("<u4").tobytes(), table.model.decode(one)
                n.append(len(one))
                ids.append(sha(raw) if digest else raw)
                shown.append(sha(text.encode()) if digest else text)
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["n_tokens", "ids", "decoded"]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string() if digest else pa.binary()), pa.array(shown, pa.string())], names=names)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, DIGEST if digest else RESULT)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with a struct column ``out``: n_tokens (all ids), ids (little-endian u32) and the decoded text."""
    return docs.withColumn(out, _udf(path, False)(F.col(f"`{text}`")))


def encode_digest(docs: DataFrame, path: str, text: str = "text", out: str = "pieces") -> DataFrame:
    """As :func:`encode`, but the task keeps only the count and the SHA-256 of ids and of the decoded text."""
    return docs.withColumn(out, _udf(path, True)(F.col(f"`{text}`")))
