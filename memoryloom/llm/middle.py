"""Fill-in-the-middle: a text's middle moved to its end, by cutting and joining ropes.

A rope is a balanced binary tree over runs of a text's bytes. Each node knows its units (words with the space before
them, or the space at the end of the text) and its code points, so that a tree is cut at a rank of either kind by one
walk down; trees are joined by a new root. Sentinels are leaves of no units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import tidy

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes of a leaf, up to the end of the word there.
LEAF_BYTES = 4096
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_WORD_END = re.compile(rb"(?<=[^\x20\x09-\x0D])[\x20\x09-\x0D]")


def _points(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


class Rope:
    """A leaf (data) or the join of two ropes, with the number of units and of code points in it."""

    __slots__ = ("chars", "data", "left", "right", "units")

    def __init__(self, data: bytes = b"", units: int = 0, left: Rope | None = None, right: Rope | None = None) -> None:
        self.data, self.left, self.right = data, left, right
        self.units, self.chars = (left.units + right.units, left.chars + right.chars) if left and right else (units, len(_points(data)))

    def leaves(self) -> Iterator[bytes]:
        below = [self]
        while below:
            node = below.pop()
            if node.left is None:
                yield node.data
            else:
                below += (node.right, node.left)

    def text(self) -> bytes:
        return b"".join(self.leaves())

    def cut(self, rank: int, kind: str) -> tuple[Rope, Rope]:
        """The ropes before and after rank units or chars (kind), from 0 to all."""
        if rank <= 0:
            return Rope(), self
        if rank >= getattr(self, kind):
            return self, Rope()
        if self.left is None:
            return self._cut_leaf(rank, kind)
        here = getattr(self.left, kind)
        if rank <= here:
            a, b = self.left.cut(rank, kind)
            return a, joined(b, self.right)
        a, b = self.right.cut(rank - here, kind)
        return joined(self.left, a), b

    def _cut_leaf(self, rank: int, kind: str) -> tuple[Rope, Rope]:
        if kind == "chars":
            at = len(_points(self.data)[:rank].encode("utf-8", "surrogateescape"))
            rank = len(_WORD.findall(self.data[:at]))
        else:
            at = next(m.end() for i, m in enumerate(_WORD.finditer(self.data), 1) if i == rank)
        return Rope(self.data[:at], rank), Rope(self.data[at:], self.units - rank)


def joined(*ropes: Rope) -> Rope:
    """One rope of all that aren't empty, in order, of the least height over them."""
    level = [r for r in ropes if r.chars]
    while len(level) > 1:
        level = [Rope(left=level[i], right=level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else Rope()


def rope(text: bytes, leaf_bytes: int = LEAF_BYTES) -> Rope:
    """A text's rope. Leaves end where words end; space at the end of the text is a unit of the last leaf."""
    found, at = [], 0
    while at < len(text):
        end = _WORD_END.search(text, at + leaf_bytes)
        stop = end.start() if end else len(text)
        data = text[at:stop]
        found.append(Rope(data, len(data.split()) + (stop == len(text) and data[-1:].isspace())))
        at = stop
    return joined(*found)


def draws(key: int | None, seed: int = 42) -> tuple[int, int, int, int]:
    """Four integers that the seed and a row's key decide."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def rearranged(text: bytes, key: int | None, seed: int = 42, percent: int = 50, spm_percent: int = 80, leaf_bytes: int = LEAF_BYTES) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and of the middle, output) of one text; see fill_in_middle."""
    whole, (h1, h2, h3, h4) = rope(text, leaf_bytes), draws(key, seed)
    n = whole.units
    if not text or h3 % 100 >= percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    rest, suffix = whole.cut(second, "units")
    prefix, middle = rest.cut(first, "units")
    mark = {m: Rope(m) for m in (PREFIX, SUFFIX, MIDDLE)}
    if h4 % 100 < spm_percent:
        form, out = "spm", joined(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    else:
        form, out = "psm", joined(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    return n, form, prefix.chars, middle.chars, out.text()


def rebuilt(output: bytes, form: str, leaf_bytes: int = LEAF_BYTES) -> bytes:
    """The text that became output in this form: the output's rope, cut at its sentinels and joined in the old order."""
    if form == "plain":
        return output
    points = _points(output)
    second = points.index("<S>" if form == "psm" else "<P>", 3)
    third = points.index("<M>", second + 3)
    head, last = rope(output, leaf_bytes).cut(third, "chars")
    one, two = head.cut(second, "chars")
    bare = lambda part: part.cut(3, "chars")[1]
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return joined(bare(prefix), bare(last), bare(suffix)).text()


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, restored: bool = False) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output[, restored]) of every row: the text with its middle moved.

    n counts the text's units. Hashes of seed and key choose two cuts, whether the text is rearranged at all (percent of
    them) and how: psm is <P>prefix<S>suffix<M>middle, spm (spm_percent of them) <S>suffix<P>prefix<M>middle. Texts that
    hold a sentinel, and empty ones, stay plain, with null counts. restored: also the text that is rebuilt from output
    and form alone.

    Null texts are empty ones; rows without key draw as those of an empty key; equal keys and texts, repeated rows too,
    give equal results; an empty table gives an empty one; other columns aren't read, whatever their names. Texts of any
    length are taken whole; a text must fit into a row. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            rows = [rearranged(t or b"", k, seed, percent, spm_percent) for k, t in zip(keys, batch.column(1).to_pylist(), strict=True)]
            n, form, first, middle, out = zip(*rows, strict=True) if rows else ((),) * 5
            columns = [pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary())]
            if restored:
                columns.append(pa.array(map(rebuilt, out, form), pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", *(["restored"] if restored else [])]
    types = ["long", "long", "string", "long", "long", "binary", "binary"]
    found = df.select(F.col(key).cast("long"), F.col(text).cast("binary")).mapInArrow(tidy(run), ", ".join(f"{c} {t}" for c, t in zip(names, types, strict=False)))
    return found.withColumns({c: F.col(c).cast("string") for c in names[5:]})


def restore(df: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """df with a column restored: the texts that fill_in_middle made output of. Outputs without form are plain."""

    @F.pandas_udf("binary")
    def texts(outputs, forms):
        return outputs.combine(forms, lambda o, f: None if o is None else rebuilt(bytes(o), f or "plain"))

    return df.withColumn("restored", texts(F.col(output).cast("binary"), F.col(form)).cast("string"))


def middle_digest(df: DataFrame) -> DataFrame:
    """fill_in_middle's counts and forms with SHA-256 digests of each output and of the text rebuilt from it."""
    found = fill_in_middle(df, restored=True)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
