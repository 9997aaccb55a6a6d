"""Byte-level BPE: speculate and verify.

A word's tokens are proposed by greedy longest match. A proposal is the exact encoding when every token is one that
exact merging gives for its own bytes and no merge would ever cross a boundary between neighbours. Both are checked for
all new words at once with NumPy; failing words are proposed anew token by token, each verified against the one before it, with
shorter tokens and then earlier ones in place of what fails. Words are cached, so each costs this once.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.word_cache import SPACE

#: The splitting rule of the vocabulary's pre-tokenizer (fixed values), for text up to U+00FF; what counts as a letter or a
#: number beyond depends on the Unicode version, so the library's own pre-tokenizer splits stretches with other characters.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Bytes of texts that are encoded at once: their words, as strings of their own, take some 15 times as much.
AT_ONCE = 1 << 20
#: No piece crosses the boundaries that this coarser rule draws.
STRETCHES = rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}


class ByteBpe:
    _made: dict[tuple[int, int], ByteBpe] = {}

    def __init__(self, model: str, most: int = 300_000, longest: int = 64):
        from tokenizers import Tokenizer

        spec, letters = json.loads(model), byte_letters()
        self.library = Tokenizer.from_str(model).pre_tokenizer
        unlettered = lambda s: bytes(letters[c] for c in s)
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {s: i for s, i in spec["model"]["vocab"].items() if s not in self.added}
        self.ids = {unlettered(s): i for s, i in vocab.items()}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.most, self.longest, self.exact_words = most, longest, 0
        self.known, self.coded, self.known_before, self.coded_before = {}, {}, {}, {}  # what is used again moves on from a full cache to the next
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.stretches, self.pieces = regex.compile(STRETCHES), regex.compile(PIECES)
        n = self.n = max(self.bytes_of) + 1
        self.rank, self.left, self.right, self.sound = np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        for b, i in self.ids.items():
            got, last = self.merge(b)
            if got == [i] and last:
                (rank, a, c) = last
                self.rank[i], self.left[i], self.right[i] = rank, a, c
            self.sound[i] = got == [i]
        order = self.sound & (self.rank >= 0)
        self.sound[order] &= (self.rank[self.left] < self.rank)[order] & (self.rank[self.right] < self.rank)[order]
        # a trie of the sound tokens: (node << 8 | byte) gives the next node, taken the token that ends at a node
        self.steps, self.taken, self.sizes, self.shorter, at_node = {}, [-1], [0] * n, [-1] * n, {}
        for b, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if self.sound[i]:
                node, before = 0, -1
                for x in b:
                    before = node if self.taken[node] >= 0 else before
                    if (after := self.steps.get(node << 8 | x)) is None:
                        after = self.steps[node << 8 | x] = len(self.taken)
                        self.taken.append(-1)
                    node = after
                self.taken[node], self.sizes[i] = i, len(b)
                self.shorter[i] = self.taken[before] if before >= 0 else -1
        self.widest = max(self.sizes)
        self.ranks_of, self.undone, self.apart_known = {a * n + b: r for (a, b), (r, _) in self.merges.items()}, [x.tolist() for x in (self.rank, self.left, self.right)], {}
        self.pair_keys = np.array(sorted(a * n + b for a, b in self.merges), np.int64)
        self.pair_ranks = np.array([self.merges[divmod(int(k), n)][0] for k in self.pair_keys], np.int64)

    @classmethod
    def of(cls, model: str, most: int = 300_000) -> ByteBpe:
        if (key := (hash(model), most)) not in cls._made:
            cls._made = {key: cls(model, most)}
        return cls._made[key]

    def merge(self, word: bytes) -> tuple[list[int], tuple[int, int, int] | None]:
        """Exact merging: the lowest rank first, leftmost among equals. Also gives the last merge."""
        parts, last = [self.first[b] for b in word], None
        while len(parts) > 1:
            found = [(self.merges[p][0], at) for at, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges]
            if not found:
                break
            rank, at = min(found)
            last = (rank, parts[at], parts[at + 1])
            parts[at : at + 2] = [self.merges[parts[at], parts[at + 1]][1]]
        return parts, last

    def longest_at(self, word: bytes, at: int) -> int:
        """The longest sound token at a place."""
        node, best, steps, taken = 0, -1, self.steps, self.taken
        for b in word[at : at + self.widest]:
            if (node := steps.get(node << 8 | b)) is None:
                break
            if (t := taken[node]) >= 0:
                best = t
        return best

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, sizes, longest = [], 0, len(word), self.sizes, self.longest_at
        while at < n:
            out.append(t := longest(word, at))
            at += sizes[t]
        return out

    def retried(self, word: bytes, out: list[int], t: int) -> list[int]:
        """The exact encoding, from the first tokens of a proposal (out) and the one behind them that fails on: the longest token that stays apart from the one before it; where none does, the one before gives way to
        a shorter one. A place that was given up is never tried again, as the exact tokens up to a place are the only ones."""
        n, sizes, shorter, longest, apart, known = len(word), self.sizes, self.shorter, self.longest_at, self.apart, self.apart_known
        at, open_ = sum(map(sizes.__getitem__, out)), bytearray(b"\1") * (n + 1)
        while True:
            last = out[-1] * self.n if out else -1
            while t >= 0:
                if open_[at + sizes[t]]:
                    if last < 0:
                        break
                    if (ok := known.get(last + t)) is None:
                        ok = apart(last // self.n, t)
                    if ok:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += sizes[t]
                if at == n:
                    return out
                t = longest(word, at)
            else:
                open_[at] = 0
                t = out.pop()
                at -= sizes[t]

    def apart(self, a: int, b: int) -> bool:
        """compatible() for one pair; verdicts are kept."""
        (rank, left, right), x, y, limit = self.undone, a, b, 1 << 62
        while True:
            found = self.ranks_of.get(x * self.n + y)
            if found is not None and 2 * found < limit:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                ok = True
                break
            if rx > ry:
                limit, x = 2 * rx, right[x]
            else:
                limit, y = 2 * ry + 1, left[y]
        if len(self.apart_known) > 200_000:
            self.apart_known.clear()
        self.apart_known[a * self.n + b] = ok
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether a and b side by side stay apart. Merges are undone from the last back; before each undoing, a merge of
        the two tokens at the boundary must not come before the one undone. Of equal ranks the leftmost goes first."""
        keys, inverse = np.unique(a * self.n + b, return_inverse=True)
        ok, live = np.ones(len(keys), bool), np.arange(len(keys))
        x, y = keys // self.n, keys % self.n
        limit = np.full(len(keys), np.iinfo(np.int64).max)  # twice the rank, odd for what comes after a boundary merge of that rank
        while len(live):
            at = np.minimum(np.searchsorted(self.pair_keys, x * self.n + y), len(self.pair_keys) - 1)
            crossed = (self.pair_keys[at] == x * self.n + y) & (2 * self.pair_ranks[at] < limit)
            ok[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~crossed & ((rx >= 0) | (ry >= 0))
            undo_left = rx > ry
            limit = np.where(undo_left, 2 * rx, 2 * ry + 1)[on]
            live, x, y = live[on], np.where(undo_left, self.right[x], x)[on], np.where(undo_left, y, self.left[y])[on]
        return ok[inverse]

    def split(self, stretch: str) -> list[str]:
        """A stretch's pieces."""
        if stretch.isascii() or stretch.isspace() or max(stretch) <= "\xff":
            return self.pieces.findall(stretch)
        return [stretch[a:b] for _, (a, b) in self.library.pre_tokenize_str(stretch)]

    def learn(self, words: list[str]) -> None:
        """Encode new stretches into the cache; their pieces are kept as well, as most occur with other marks behind them too."""
        if len(self.coded) > self.most:
            self.coded, self.coded_before = {}, self.coded
        pieces, coded, before = [*map(self.split, words)], self.coded, self.coded_before
        new = set(chain.from_iterable(pieces)).difference(coded)
        coded.update((p, before[p]) for p in new.intersection(before))
        new = list(new.difference(before))
        data = [p.encode() for p in new]
        guess = [*map(self.greedy, data)]
        sizes = np.array([*map(len, guess)], np.int64)
        tokens = np.array([*chain.from_iterable(guess)], np.int64)
        owner = np.repeat(np.arange(len(new)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        crossed = inside[~self.compatible(tokens[inside], tokens[inside + 1])] if len(inside) else inside
        bad, at = np.unique(owner[crossed], return_index=True)  # the first boundary of each
        first = crossed[at] + 1 - (np.cumsum(sizes) - sizes)[bad]
        for i, k in zip(bad.tolist(), first.tolist(), strict=True):
            guess[i] = self.retried(data[i], guess[i][:k], guess[i][k])
        self.exact_words += len(bad)
        coded.update(zip(new, (array("I", g).tobytes() for g in guess), strict=True))
        self.known.update((w, coded[p[0]] if len(p) == 1 else b"".join(map(coded.__getitem__, p))) for w, p in zip(words, pieces, strict=True))
        for p in new:
            if len(p) > self.longest:
                del coded[p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.most:
            self.known, self.known_before = {}, self.known
        known, before, cut = self.known, self.known_before, self.stretches.findall
        parts = [[cut(t)] if not self.special or "<" not in t and not self.special.search(t) else [[s] if i % 2 else cut(s) for i, s in enumerate(self.special.split(t))] for t in texts]
        if self.special:
            known.update((s, np.array([i], "<u4").tobytes()) for s, i in self.added.items())
        new = set().union(*(x for p in parts for x in p)).difference(known)
        known.update((w, before[w]) for w in new.intersection(before))
        new = list(new.difference(before))
        self.learn(new)
        out = [b"".join([known[w] for x in p for w in x]) if len(p) != 1 else b"".join(map(known.__getitem__, p[0])) for p in parts]
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens' bytes joined; what isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer_file: str, decoded: bool = True, most: int = 300_000) -> DataFrame:
    """docs (any columns, with text) plus n_tokens, token_ids (binary, little-endian 32 bits each) and decoded (text).

    Null text counts as empty, repeated rows get the same, an empty table gives no rows. Columns of these names are replaced.
    A long text is encoded in one piece, so a task's memory follows its longest text. most: words in a worker's cache, of which
    there are two.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))  # one file of fixed size
    kept = docs.drop("n_tokens", "token_ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(model.value, most)
        for batch in common.slices(batches, "text", AT_ONCE):
            coded = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            cols = [pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(coded, pa.binary())]
            cols += [pa.array([bpe.decode(x) for x in coded], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "n_tokens", "token_ids", *["decoded"] * decoded])

    return kept.mapInArrow(run, common.schema_plus(kept, n_tokens="long", token_ids="binary", **{"decoded": "string"} if decoded else {}))


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what encode() gives, as digests that are taken where it is made.

    One row for each row of docs (doc_id, text), repeated ones included; null text is empty, an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.of(model.value)
        for batch in common.slices(batches, "text"):
            coded = bpe.encode([t or "" for t in batch.column("text").to_pylist()])
            sha = lambda x: hashlib.sha256(x).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([sha(x) for x in coded]), pa.array([sha(bpe.decode(x).encode()) for x in coded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
