"""Substring dedup, alignment of tokenizers and fill-in-middle against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import align, fim, substring_dedup

P = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def passages(seed, n):
    """Texts of shared passages in many surroundings, with chance repeats."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["é", "日本", "the", "A"]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(5)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b = base[rng.randrange(5)]
            parts += rng.choice([b[rng.randrange(40) :], [rng.choice(words) for _ in range(rng.randrange(30))], ["z"] * rng.randrange(20), b])
        if parts and rng.random() < 0.5:
            parts[rng.randrange(len(parts))] = "Changed"
        out.append(rng.choice([" ", "\n", " \t"]).join(parts))
    return out


@pytest.mark.parametrize("large", [20_000, 2])
def test_substring_dedup(spark, odd, large, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LARGE", large)
    texts = [*odd, *passages(3, 90)]
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(i + 200, t) for i, t in rows[20:40]] + rows[40:45] + [(60, texts[61]), (None, texts[30]), (None, texts[20]), (-5, texts[50]), (10**15, texts[51] + " end")]
    rng.shuffle(rows)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, i), i)
    want, kept_texts = [], []
    for (i, t), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12) if i is not None else ():
            if least[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), sha(kept)))
        kept_texts.append((i, kept if any(gone) else None, [x for x, g in enumerate(gone) if g]))
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "doc_id long, text string, row string, minimiser int, key string")
    got = [tuple(r) for r in substring_dedup.dedup(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[2] > 0 for x in want) > 40
    cut = [(r["doc_id"], r["kept"], [x for s in r["spans"] for x in range(s["start"], s["end"])]) for r in substring_dedup.deduplicated(docs).collect()]
    assert sorted(((i, k if s else None, s) for i, k, s in cut), key=str) == sorted(kept_texts, key=str)
    assert substring_dedup.dedup(docs.limit(0)).count() == 0


def test_super_kmers():
    """Every window is in one super-k-mer, equal windows have equal minimisers, and packed strings hold their windows."""
    rng = random.Random(2)
    texts = [[rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(n)] for n in (3000, 0, 12, 13, 40, 1, 500)]
    owner, first, n, kinds = substring_dedup.super_kmers(texts, substring_dedup._Hashes())
    seen, at = {}, {i: 0 for i in range(len(texts))}
    for i, begin, size, kind in zip(owner.tolist(), first.tolist(), n.tolist(), kinds.tolist(), strict=True):
        assert begin == at[i]
        windows = substring_dedup.windows_of(b" ".join(texts[i][begin : begin + size + 12]))
        assert len(windows) == size
        for win in windows:
            assert win == b" ".join(texts[i][at[i] : at[i] + 13]) and seen.setdefault(win, kind) == kind
            at[i] += 1
    assert [at[i] for i in range(len(texts))] == [max(0, len(t) - 12) for t in texts]
    assert [len(x) for x in substring_dedup.super_kmers([[], texts[2]], substring_dedup._Hashes())] == [0] * 4


def plain_alignment(a, b):
    """Groups and links of (id, bytes) lists by walking bytes."""
    ends = lambda x: [*np.cumsum([len(t) for _, t in x]).tolist()]
    ea, eb = ends(a), ends(b)
    both, groups, links = sorted(set(ea) & set(eb)), [], []
    low = 0
    for e in both:
        groups.append(",".join(str(a[i][0]) for i, x in enumerate(ea) if low < x <= e) + "|" + ",".join(str(b[i][0]) for i, x in enumerate(eb) if low < x <= e))
        low = e
    for i, x in enumerate(ea):
        for j, y in enumerate(eb):
            if x == y:
                links.append((a[i][0], b[j][0]))
    return groups, links


def test_alignment(spark, odd):
    import sentencepiece
    from tokenizers import Tokenizer

    rng = random.Random(7)
    bits = ["word", " the", "  ", "\n", "\t", "don't", " 12345", "é", "日本語", "😀", "<s>", "<|endoftext|>", "</s>", "<0x41>", "▁", "\x00", " ", " .", "...", " A", "\r\n", " ", "᠎", "﻿", "é", "ﬁ"]
    texts = [*odd[:3], *odd[4:6], "1 " * 300, *odd[8:], " lead", "trail ", "   ", " ", *("".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(300)), *("plain words here and there, " * rng.randrange(4) + rng.choice(bits) for _ in range(60))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "plain words here")]
    one, two = Tokenizer.from_file(A_FILE), sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    one.encode_special_tokens = True
    letters = {c: b for c, b in align.byte_letters().items()}
    want, all_links = [], []
    for _, t in rows:
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in one.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = [(i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()) for i in two.encode(t) for p in [two.id_to_piece(i)]] if t else []
        if not t or b"".join(x for _, x in a) != (" " + t).encode() or b"".join(x for _, x in b) != (" " + t).encode():
            a = b = []
        groups, links = plain_alignment(a, b)
        want.append([len(a), len(b), len(groups), len(links), sha(";".join(groups)) if groups else ""])
        all_links.append(links)
    count = Counter(x for links in all_links for x in links)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    for w, links in zip(want, all_links, strict=True):
        w[4:4] = [sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links)]
    docs = spark.createDataFrame([(*r, "x", 4) for r in rows], "doc_id long, text string, pairs string, n_a int")
    got = [(r[0], [*r[1:]]) for r in align.digests(docs, A_FILE, B_FILE).collect()]
    assert sorted(got, key=str) == sorted(((i, w) for (i, _), w in zip(rows, want, strict=True)), key=str)
    assert sum(w[0] > 0 for w in want) > 200 and sum(w[0] == 0 for w in want) > 10
    text = align.alignments(docs.where("doc_id = 3"), A_FILE, B_FILE).first()
    assert sha(text["groups"]) == want[3][-1] and text["text"] == texts[3]
    assert align.digests(docs.limit(0), A_FILE, B_FILE).count() == 0
    few, align.FEW_PAIRS = align.FEW_PAIRS, 5  # joined by exchanges
    assert sorted(((r[0], [*r[1:]]) for r in align.digests(docs, A_FILE, B_FILE).collect()), key=str) == sorted(got, key=str)
    align.FEW_PAIRS = few


def test_overlaps():
    """Stabbing gives the B tokens that share a byte with each A token."""
    rng = random.Random(5)
    for _ in range(50):
        a, b = (np.cumsum([rng.randrange(1, 5) for _ in range(rng.randrange(1, 20))]) for _ in range(2))
        b = np.append(b[b < a[-1]], a[-1])
        first, last = align.overlapped(a, b)
        for i in range(len(a)):
            lo = a[i - 1] if i else 0
            want = [j for j in range(len(b)) if (b[j - 1] if j else 0) < a[i] and b[j] > lo]
            assert (first[i], last[i]) == (want[0], want[-1])


def cut_by_units(text, i):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("segment", [1 << 20, 3, 7])
def test_fill_in_middle(spark, odd, segment, monkeypatch):
    rng = random.Random(9)
    bits = ["word", " ", "a", "B", "é", "日", "😀", "<", "P>", "<P", "<S>", "S>", "<M", ">", "1", "\n", "?", "\x00", "zz9"]
    texts = [*(t if segment > 7 or t is None else t[:500] for t in odd), "letters" * 30, "....." * 20, *("".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(400))]
    rows = [(rng.randrange(10**9), t) for t in texts] + [(5, "repeated row here"), (5, "repeated row here"), (None, "no id here"), (-3, "negative")]
    want = [(i, *cut_by_units(t or "", i)) for i, t in rows]
    events = fim.automaton()
    monkeypatch.setattr(fim, "SEGMENT", segment)
    assert [fim.transformed(t or "", i, events, fim.Rates(), 1) for i, t in rows] == [w[1:] for w in want]
    if segment < 100:
        return
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, form string, n int")
    got = [tuple(r) for r in fim.digests(docs).collect()]
    assert sorted(got, key=str) == sorted(((i, n, f, p, m, sha(o), sha(t or "")) for (i, n, f, p, m, o), (_, t) in zip(want, rows, strict=True)), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    back = fim.transform(docs).select("text", fim.restored().alias("again")).collect()
    assert all(r["again"] == (r["text"] or "") for r in back)
    assert fim.digests(docs.limit(0)).count() == 0
