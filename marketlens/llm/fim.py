"""Fill-in-the-middle rearrangement of whole texts over ropes.

A text becomes a balanced tree of leaves of about ``LEAF`` characters, cut between units (a unit is a run of ASCII
letters, or any other single character); each node caches how many units and how many code points lie below it.  Two
units ranks split the tree into prefix, middle and suffix; the rearranged text is the concatenation of those subtrees
with sentinel leaves; only paths are rebuilt, leaves are shared.  A split or a concatenation costs the tree's height and
one leaf.  The inverse splits the rearranged text's own tree at code-point ranks of the sentinels and drops them.

A text that holds a sentinel stays as it is (``plain``), so that the sentinels of a rearranged text are always its
own: none can arise across a cut, because a sentinel starts with ``<``, ends with ``>`` and has neither inside.

Defined results: null and empty texts are ``plain`` and have the empty output; a null id draws like the empty one;
repeated rows get equal values; very long texts are rearranged whole (one long run of letters is one unit and one
leaf); an empty table gives no row; other columns are untouched (the result is one added struct column, and an input
column of its name is replaced).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import slices

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: UTF-8 bytes as "a" for letters and a blank for all others; a character's further bytes are dropped.
_KIND, _FURTHER = bytes(97 if 65 <= b & 0xDF <= 90 and b < 128 else 32 for b in range(256)), bytes(range(0x80, 0xC0))
_REST_OF_RUN = re.compile(r"(?<=[A-Za-z])[A-Za-z]*")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 draws: from this one on a text stays plain; below this one the suffix comes first (spm).
PLAIN_FROM, SPM_BELOW = 90, 20
#: Code points of a leaf (more where a unit goes on).
LEAF = 2048
RESULT = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


@dataclass(frozen=True, slots=True)
class Leaf:
    text: str
    units: int
    chars: int


@dataclass(frozen=True, slots=True)
class Node:
    left: Leaf | Node
    right: Leaf | Node
    units: int
    chars: int


Rope = Leaf | Node
EMPTY = Leaf("", 0, 0)


def units_in(text: str) -> int:
    """How many units a text has: its single characters, and the letters that no letter precedes."""
    kinds = b" " + text.encode().translate(_KIND, _FURTHER)
    return kinds.count(b" ") - 1 + kinds.count(b" a")


def leaf(text: str) -> Leaf:
    return Leaf(text, units_in(text), len(text)) if text else EMPTY


def concat(*ropes: Rope) -> Rope:
    """The ropes one behind the other, paired level by level; no text is copied.  No unit may span two of them."""
    row = [r for r in ropes if r.chars] or [EMPTY]
    while len(row) > 1:
        row = [Node(a, b, a.units + b.units, a.chars + b.chars) for a, b in zip(row[::2], row[1::2])] + row[len(row) & ~1 :]
    return row[0]


def rope(text: str) -> Rope:
    """A balanced rope of ``text`` whose leaves are cut between units."""
    leaves, at = [], 0
    while at < len(text):
        end = min(at + LEAF, len(text))
        if end < len(text) and (more := _REST_OF_RUN.match(text, end)):
            end = more.end()
        leaves.append(leaf(text[at:end]))
        at = end
    return concat(*leaves)


def split(tree: Rope, rank: int, by: str) -> tuple[Rope, Rope]:
    """The first ``rank`` units or code points (``by``: ``units`` or ``chars``) of a rope, and the rest."""
    if rank <= 0:
        return EMPTY, tree
    if rank >= getattr(tree, by):
        return tree, EMPTY
    if isinstance(tree, Leaf):
        at = rank if by == "chars" else next(islice(UNIT.finditer(tree.text), rank, None)).start()
        return leaf(tree.text[:at]), leaf(tree.text[at:])
    here = getattr(tree.left, by)
    if rank <= here:
        a, b = split(tree.left, rank, by)
        return a, concat(b, tree.right)
    a, b = split(tree.right, rank - here, by)
    return concat(tree.left, a), b


def text_of(tree: Rope) -> str:
    out, todo = [], [tree]
    while todo:
        t = todo.pop()
        if isinstance(t, Leaf):
            out.append(t.text)
        else:
            todo += [t.right, t.left]
    return "".join(out)


def rearranged(text: str, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text, by four draws: two cuts, plain or not, which form."""
    tree, (h1, h2, h3, h4) = rope(text), draws
    n = tree.units
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    head, suffix = split(tree, b, "units")
    prefix, middle = split(head, a, "units")
    form = "spm" if h4 % 100 < SPM_BELOW else "psm"
    first, second = ((SUFFIX, suffix), (PREFIX, prefix)) if form == "spm" else ((PREFIX, prefix), (SUFFIX, suffix))
    output = concat(leaf(first[0]), first[1], leaf(second[0]), second[1], leaf(MIDDLE), middle)
    return n, form, prefix.chars, middle.chars, text_of(output)


def restored(output: str, form: str) -> str:
    """The text that was rearranged, from its output and form alone."""
    if form == "plain":
        return output
    names = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    rest, at, parts = rope(output), 0, {}
    for name, after in zip(names, (*names[1:], None)):
        _, rest = split(rest, len(name), "chars")
        at += len(name)
        end = len(output) if after is None else output.index(after, at)
        parts[name], rest = split(rest, end - at, "chars")
        at = end
    return text_of(concat(parts[PREFIX], parts[MIDDLE], parts[SUFFIX]))


#: Bytes of text that a worker turns into Python objects at once.
SLICE = 4 << 20
_KIND_OF = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _parts(batches: Iterator[tuple[pa.Array, pa.Array]], other: str) -> Iterator[pa.RecordBatch]:
    return slices((pa.RecordBatch.from_arrays(list(b), ["text", other]) for b in batches), "text", most=SLICE)


def _rearrange(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    names = [f.name for f in _KIND_OF]
    for part in _parts(batches, "draws"):
        yield pa.array([dict(zip(names, rearranged(t or "", d))) for t, d in zip(part["text"].to_pylist(), part["draws"].to_pylist())], _KIND_OF)


def _restore(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for part in _parts(batches, "form"):
        yield pa.array([restored(o, f) for o, f in zip(part["text"].to_pylist(), part["form"].to_pylist())], pa.string())


def _udf(run, result: str):
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, result)


def draws(key: Column, seed: str) -> Column:
    """Four unsigned integers: the first 8-digit groups of the SHA-256 of seed, colon and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "fim", seed: str = "1") -> DataFrame:
    """``docs`` with a struct column ``out``: n (units), form, prefix_chars and middle_chars (null if plain), output."""
    return docs.withColumn(out, _udf(_rearrange, RESULT)(F.col(f"`{text}`"), draws(F.col(f"`{key}`"), seed)))


def restore(output: Column, form: Column) -> Column:
    """The text that was rearranged, from its output and form alone."""
    return _udf(_restore, "string")(output, form)
