"""Cross-tokenizer alignment of a byte-level BPE (A) with a sentencepiece model (B) over the bytes of space + text.

The B tokens' byte ranges are a static interval index: their starts and ends, ascending. Two bisections for each A token stab
it and give the run of B tokens that it overlaps. The gap behind an A token that no B token spans, so where both end, is a
group boundary; the tokens between two such gaps are a group, and the two that end there are linked.

Neither tokenizer joins over a single space or line end between two other characters, so texts are cut there into stretches,
and both end a token at each cut. A stretch is aligned once and its groups are kept; a text's alignment is its stretches' in a
row. Whether a B model allows that is read off its pieces; if not, a text is one stretch.

How often two ids are linked is counted over all documents: bounded by the vocabularies' product, whatever the corpus.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.bpe import byte_letters

MARK = "▁"
#: A table of at most so many id pairs is broadcast (24 bytes each); a larger one is joined by exchanges.
FEW_PAIRS = 1_000_000


#: Where a space, or a line end, has white space or an end of the text beside it.
_NEXT_TO_SPACE, _NEXT_TO_LINE_END = re.compile(r" \s|\s |^ | \Z"), re.compile(r"\n\s|\s\n|^\n|\n\Z")


#: A stretch: its text behind a space, or as a tuple of one its text behind a line end.
Stretch = str | tuple[str]
#: A stretch's alignment: token counts, groups as text, linked pairs of ids (a * B's size + b, 64 bits each).
Aligned = tuple[int, int, str, bytes]


def overlapped(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first and the last B token that it overlaps. Ends ascend, ranges follow one another from 0."""
    b_starts = np.concatenate([[0], b_ends[:-1]])
    a_starts = np.concatenate([[0], a_ends[:-1]])
    return np.searchsorted(b_ends, a_starts, side="right"), np.searchsorted(b_starts, a_ends, side="left") - 1


def listed(ids_a: np.ndarray, ids_b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> tuple[str, list[int]]:
    """All groups as `a1,a2|b1;`, one behind the other, and where each ends; a_last and b_last: places of the groups' last tokens."""
    first_a, first_b = (np.concatenate([[0], x[:-1] + 1]) for x in (a_last, b_last))
    own_a, own_b = np.repeat(np.arange(len(a_last)), a_last + 1 - first_a), np.repeat(np.arange(len(b_last)), b_last + 1 - first_b)
    ids, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.zeros(len(ids_a) + len(ids_b), np.int64)
    at_a, at_b = np.arange(len(ids_a)) + first_b[own_a], np.arange(len(ids_b)) + (a_last + 1)[own_b]
    ids[at_a], ids[at_b] = ids_a, ids_b
    marks[at_a[a_last]], marks[at_b[b_last]] = 1, 2
    shown = [*map(str, ids.tolist())]
    sizes = np.array([*map(len, shown)], np.int64) + 1
    return "".join(chain.from_iterable(zip(shown, map(",|;".__getitem__, marks.tolist()), strict=True))), np.cumsum(sizes)[at_b[b_last]].tolist()


class Aligner:
    """Alignments of texts; those of stretches of at most `longest` characters are kept, `most` new ones and as many that came before."""

    _made: dict[tuple[int, int], Aligner] = {}

    def __init__(self, a_model: str, b_model: bytes, most: int = 80_000, longest: int = 64):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_model), sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_padding()
        self.a.no_truncation()
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for p, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.get, p)) if all(c in letters for c in p) else p.encode()
        self.n_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([*map(len, known)], np.int64) for known in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(MARK)
        plain = "  x  y\té "  # as it is, but for the space in front
        kept = b"".join(self.b_bytes[i] for i in self.b.encode(plain)) == f" {plain}".encode()
        self.cuts = kept and not self.b.is_unknown(self.space) and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.lines = self.cuts and not any("\n" in p for p in pieces) and self.b.encode("\nx")[0] == self.space
        self.known: dict[Stretch, Aligned | None] = {}
        self.before: dict[Stretch, Aligned | None] = {}
        self.most, self.longest = most, longest

    @classmethod
    def of(cls, a_model: str, b_model: bytes) -> Aligner:
        """One for each pair of models in a worker, as workers are used for many tasks."""
        if (key := (hash(a_model), hash(b_model))) not in cls._made:
            cls._made = {key: cls(a_model, b_model)}
        return cls._made[key]

    def stretches(self, text: str) -> list[Stretch]:
        """The text's parts. Next to other white space no cut is made."""
        parts = text.split(" ") if self.cuts else [text]
        if self.cuts and _NEXT_TO_SPACE.search(text):
            parts = self.merged(parts)
        if not self.lines or "\n" not in text:
            return parts
        out = []
        for p in parts:
            if "\n" in p and not _NEXT_TO_LINE_END.search(p):
                first, *more = p.split("\n")
                out.append(first)
                out += [(x,) for x in more]
            else:
                out.append(p)
        return out

    def merged(self, parts: list[str]) -> list[str]:
        """Parts between which no cut can be made, together."""
        out, joins = [], False
        for p in parts:
            if out and (joins or not p or p[0].isspace()):
                out[-1].append(p)
            else:
                out.append([p])
            joins = not p or p[-1].isspace()
        return [*map(" ".join, out)]

    def exact(self, flat: np.ndarray, counts: np.ndarray, known: list[bytes], sizes: np.ndarray, data: list[bytes]) -> np.ndarray:
        """Whether each stretch's tokens' bytes are its data."""
        parts = [*map(known.__getitem__, flat.tolist())]
        ends = np.concatenate([[0], np.cumsum(counts)])
        if b"".join(parts) == b"".join(data) and (np.diff(np.concatenate([[0], np.cumsum(sizes[flat])])[ends]) == [*map(len, data)]).all():
            return np.ones(len(data), bool)
        return np.array([b"".join(parts[x:y]) == d for x, y, d in zip(ends[:-1].tolist(), ends[1:].tolist(), data, strict=True)])

    def learn(self, new: list[Stretch]) -> None:
        """Align new stretches, all at once: one behind the other they are one text that both tokenizers cut between any two."""
        spaced = [f" {s}" if isinstance(s, str) else f"\n{s[0]}" for s in new]
        data = [s.encode() for s in spaced]
        a = [x.ids for x in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        coded = self.b.encode([s if isinstance(s, str) else f"\n{s[0]}" for s in new], num_threads=1)
        b = [x[1:] if isinstance(s, tuple) else x if s else [self.space] for s, x in zip(new, coded, strict=True)]  # it adds a space
        n_a, n_b = (np.array([*map(len, part)], np.int64) for part in (a, b))
        ids_a, ids_b = (np.array([*chain.from_iterable(part)], np.int64) for part in (a, b))
        fine = self.exact(ids_a, n_a, self.a_bytes, self.a_sizes, data) & self.exact(ids_b, n_b, self.b_bytes, self.b_sizes, data)
        if not fine.all():
            self.known.update((s, None) for s, ok in zip(new, fine, strict=True) if not ok)
            new, ids_a, ids_b = [s for s, ok in zip(new, fine, strict=True) if ok], ids_a[np.repeat(fine, n_a)], ids_b[np.repeat(fine, n_b)]
            n_a, n_b = n_a[fine], n_b[fine]
        if not new:
            return
        a_ends, b_ends = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        _, last = overlapped(a_ends, b_ends)
        ends = np.flatnonzero(b_ends[last] == a_ends)  # A tokens behind which no B token spans the gap
        pairs = (ids_a[ends] * self.n_b + ids_b[last[ends]]).tobytes()
        text, stops = listed(ids_a, ids_b, ends, last[ends])
        groups = np.searchsorted(ends, np.cumsum(n_a) - 1, side="right")  # before the end of each stretch
        known, lo, begin = self.known, 0, 0
        for s, x, y, hi in zip(new, n_a.tolist(), n_b.tolist(), groups.tolist(), strict=True):
            stop = stops[hi - 1]
            known[s] = (x, y, text[begin : stop - 1], pairs[8 * lo : 8 * hi])
            lo, begin = hi, stop

    def texts(self, texts: list[str | None]) -> list[list[Aligned]]:
        """Each text's stretches' alignments; none where the text has no tokens."""
        if len(self.known) > self.most:
            self.known, self.before = {}, self.known
        parts = [self.stretches(t) if t else [] for t in texts]
        new = set().union(*parts).difference(self.known)
        again = new & self.before.keys()
        self.known.update((s, self.before[s]) for s in again)
        new = [*new - again]
        gc.disable()  # many small tuples and no cycles: collections would take a sixth of the time
        try:
            self.learn(new)
        finally:
            gc.enable()
        out = [[*map(self.known.__getitem__, p)] for p in parts]
        for s in new:
            if len(s if isinstance(s, str) else s[0]) > self.longest:
                del self.known[s]
        return [[] if None in found else found for found in out]


def alignments(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """docs (any columns, with text) plus n_a, n_b, n_groups, groups, pairs, times.

    groups is `a1,a2|b1;a3|b2,b3` of A's and B's ids; pairs are the distinct linked ids (a * size of B's vocabulary + b),
    times how many links of the text hold each. Texts that are null, empty, or whose tokens' bytes differ from space + text
    have zeros and none. Repeated rows get the same; an empty table gives no rows; columns of the new names are replaced.
    """
    context = docs.sparkSession.sparkContext
    models = context.broadcast((Path(a_file).read_text(encoding="utf-8"), Path(b_file).read_bytes()))  # two files of fixed size
    types = {"n_a": "long", "n_b": "long", "n_groups": "long", "groups": "string", "pairs": "array<long>", "times": "array<long>"}
    kept = docs.drop(*types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(*models.value)
        for whole in batches:
            for batch in common.slices(iter([whole]), "text", 1 << 19):
                found = aligner.texts(batch.column(batch.schema.get_field_index("text")).to_pylist())
                n_a, n_b, groups, pairs = zip(*(zip(*f, strict=True) if f else ((),) * 4 for f in found), strict=True)
                links = [np.frombuffer(b"".join(x), np.int64) for x in pairs]
                sums = [pa.array(x, pa.int64()) for x in (map(sum, n_a), map(sum, n_b), map(len, links))]
                texts = pa.array(map(";".join, groups), pa.string())
                each = [np.unique(x, return_counts=True) for x in links]
                lists = [pa.array([x[i] for x in each], pa.list_(pa.int64())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *sums, texts, *lists], [*batch.schema.names, *types])

    return kept.mapInArrow(run, common.schema_plus(kept, **types))


def linked_pairs(coded: DataFrame, n_b: int) -> DataFrame:
    """pair, count (over all links), best (whether no other pair of its B id has more), of rows with pairs and times."""
    each = coded.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy("p.pairs").agg(F.sum("p.times").alias("count"))
    counts = each.withColumnRenamed("pairs", "pair").withColumn("b", F.col("pair") % n_b)
    most = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row per B id
    return counts.join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def digests(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text).

    n_links are pairs of tokens that end together, n_best those whose ids' count over all documents is their B id's highest,
    count_sum the sum of those counts over the links. Without tokens groups_sha256 is empty. Nulls, repeated rows and empty
    tables as in alignments(). Texts aren't dealt out: what travels is a few numbers a document, and counts of id pairs.
    """
    folder = common.scratch(docs.sparkSession, "aligned")
    rows = alignments(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), a_file, b_file)
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    names = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    coded = common.written(rows.withColumn("groups_sha256", sha).select(F.monotonically_increasing_id().alias("row"), *names, "pairs", "times"), f"{folder}/coded")
    facts = common.few(linked_pairs(coded, vocabulary_size(b_file)), f"{folder}/pairs", FEW_PAIRS)
    each = coded.select("row", *names, F.explode_outer(F.arrays_zip("pairs", "times")).alias("p")).select("row", *names, F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = {"n_links": total(F.col("times")), "n_best": total(F.when(F.col("best"), F.col("times"))), "count_sum": total(F.col("times") * F.col("count"))}
    found = each.join(facts, "pair", "left").groupBy("row", *names).agg(*(v.alias(k) for k, v in sums.items()))
    return found.select("doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256")


def vocabulary_size(b_file: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=b_file).vocab_size()
