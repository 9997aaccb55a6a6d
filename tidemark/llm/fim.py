"""Fill-in-middle transformation: texts cut at unit boundaries into prefix, middle and suffix, and joined in another order.

A unit is a run of ASCII letters or one other code point. Where a text is cut depends on its doc_id alone, so it is the same
in every run and on every layout.

An Aho-Corasick automaton finds the events of a text: ASCII characters at which the class changes (a letter after another
character, or the reverse, as patterns of two), and the sentinels. Between two events the class is one, so a gap's units
are arithmetic: one for letters, its length for others. A text is scanned in segments of SEGMENT code points; for each only
its number of units is kept, and a rank is looked up by scanning its segment once more. So memory follows SEGMENT.

For the scan a code point beyond ASCII is a question mark: not a letter, in no sentinel, and one for each.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain
from string import ascii_letters

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

SEGMENT = 1 << 20
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Rates:
    """Hundredths of texts that are transformed, and of those the ones with the suffix first."""

    transformed: int = 90
    suffix_first: int = 20


def automaton() -> ahocorasick.Automaton:
    """Class changes (value False) and sentinels (True)."""
    found = ahocorasick.Automaton()
    others = [chr(c) for c in range(128) if chr(c) not in ascii_letters]
    for a in ascii_letters:
        for b in others:
            found.add_word(a + b, False)
            found.add_word(b + a, False)
    for s in SENTINELS:
        found.add_word(s, True)
    found.make_automaton()
    return found


class Units:
    """Units of a text: how many there are, where the n-th begins, and whether the text has a sentinel."""

    def __init__(self, text: str, events: ahocorasick.Automaton):
        self.flat = text if text.isascii() else text.encode("ascii", "replace").decode("ascii")
        self.size, self.events, self.sentinel, self.last = len(text), events, False, (-1, None, None)
        counts = [int(self.runs(begin)[1].sum()) for begin in range(0, self.size, SEGMENT)]
        self.before = [0, *accumulate(counts)]

    def runs(self, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, units that begin in it) of the runs of one class in a segment; those of the last one are kept."""
        if self.last[0] == begin:
            return self.last[1:]
        end = min(begin + SEGMENT, self.size)
        # two more, for what a segment's border cuts
        at, sentinel = np.fromiter(chain.from_iterable(self.events.iter(self.flat, max(0, begin - 2), end)), np.int64).reshape(-1, 2).T
        self.sentinel |= bool(sentinel.any())
        starts = np.append(begin, at[(sentinel == 0) & (at > begin)])
        units = np.diff(starts, append=end)
        letters = (np.arange(len(starts)) % 2 == 0) == (self.flat[begin] in ascii_letters)
        units[letters] = 1
        if letters[0] and begin and self.flat[begin - 1] in ascii_letters:
            units[0] = 0  # goes on from the segment before
        self.last = (begin, starts, units)
        return starts, units

    def __len__(self) -> int:
        return self.before[-1]

    def start(self, unit: int) -> int:
        """Where this unit begins; the text's size for what comes after the last."""
        if unit >= len(self):
            return self.size
        segment = bisect_right(self.before, unit) - 1
        starts, units = self.runs(segment * SEGMENT)
        sums = np.cumsum(units)
        rest = unit - self.before[segment]
        run = int(np.searchsorted(sums, rest, side="right"))
        return int(starts[run] + rest - (sums[run] - units[run]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits, by the id; a null id is as the empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(text: str, doc_id: int | None, events: ahocorasick.Automaton, rates: Rates, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output)."""
    units, (h1, h2, h3, h4) = Units(text, events), draws(doc_id, seed)
    n = len(units)
    if not text or units.sentinel or h3 % 100 >= rates.transformed:
        return n, "plain", None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = units.start(first), units.start(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < rates.suffix_first:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, rates: Rates = Rates(), seed: int = 1) -> DataFrame:
    """docs (any columns, with doc_id and text) plus n (units), form, prefix_chars, middle_chars, output.

    form is psm or spm, or plain where the text stays as it is: if it is empty, has a sentinel, or isn't drawn. A null text
    is empty; a null doc_id draws as one id; repeated rows get the same; an empty table gives no rows. Columns of the new
    names are replaced. Long texts are scanned in segments.
    """
    kept = docs.drop("n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = automaton()
        for whole in batches:
            for batch in common.slices(iter([whole]), "text"):
                columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "doc_id"))
                found = [transformed(t or "", i, events, rates, seed) for t, i in zip(*columns, strict=True)]
                new = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "n", "form", "prefix_chars", "middle_chars", "output"])

    return kept.mapInArrow(run, common.schema_plus(kept, n="long", form="string", prefix_chars="long", middle_chars="long", output="string"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The exact text again. Parts have no sentinel, and none can arise at a joint, so splitting at sentinels is exact."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(SENTINELS), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each row of docs (doc_id, text).

    Nulls, repeated rows and empty tables as in transform().
    """
    rows = transform(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))
