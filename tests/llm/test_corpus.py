"""Operators over the corpus against brute force, and the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tidemark.llm import common, graph, resemblance, simhash, stages, suffix_dedup, topk


def test_suffix_dedup_of_long_texts(spark):
    """A passage of 900,000 bytes in texts of several pieces, at other distances from where pieces end."""
    rng = random.Random(6)
    noise = lambda n: rng.randbytes(n // 2).hex()
    a = noise(1_500_000)
    texts = [a, noise(300_000) + "z" + a[500_000:1_400_000] + "z" + noise(1_000_000), noise(2_200_000)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (1_500_000, 900_000, 1), 1: (2_200_002, 900_000, 1), 2: (2_200_000, 0, 0)}


def _steps(monkeypatch):
    """(what runs a step of suffix_dedup on a batch here, sizes of the arrays of names that are made meanwhile)."""
    made, refined = [], suffix_dedup._refined
    monkeypatch.setattr(suffix_dedup, "_refined", lambda a, b: made.append(len(a)) or refined(a, b))

    class Rows:
        mapInArrow = staticmethod(lambda run, schema: run)

    def step(what, **columns):
        made.clear()
        return pa.Table.from_batches(what(Rows)(iter([pa.RecordBatch.from_pydict(columns)]))).to_pylist()

    return step, made


def test_suffix_dedup_names_each_byte_a_few_times(monkeypatch):
    """Anchors take less than five names a byte; single starts of many short texts are named together; removing names nothing."""
    rng = random.Random(12)
    texts = [rng.randbytes(rng.randrange(300, 700)).hex() for _ in range(200)]
    step, made = _steps(monkeypatch)
    rows = step(suffix_dedup.anchored, doc_id=list(range(200)), text=texts)
    assert sum(made) < 5 * sum(map(len, texts))
    keys, data = zip(*((r["key"], r["packed"]) for r in step(suffix_dedup.packed, text=texts)), strict=True)
    shapes, places = [r["shapes"] for r in rows], [list(range(len(r["near"]))) for r in rows]
    starts = step(suffix_dedup.open_starts, row=list(range(200)), packed=data, shapes=shapes, open=places, shown=[None] * 200)
    assert len(made) < 200
    assert sorted((r["row"], r["start"]) for r in starts) == [(i, at) for i, t in enumerate(texts) for at in range(len(t) - 399)]
    gone = step(suffix_dedup.removed, key=keys, packed=data, shapes=shapes, whole=[p[:1] for p in places], starts=[[len(t) - 400] for t in texts])
    assert not made and all(r["spans"][0]["start"] == 0 and r["spans"][-1]["end"] == len(t) for r, t in zip(gone, texts, strict=True))


def test_suffix_dedup_shapes_hold_every_start(monkeypatch):
    """Runs of anchors follow each other from the first start to the last, in texts of several pieces too; names are those of the strings."""
    rng = random.Random(13)
    texts = ["", None, "x" * 399, "y" * 400, "ab" * 90_000, *("".join(rng.choice("ab ") for _ in range(n)) for n in (401, 3000, 70_000, 140_000))]
    step, _ = _steps(monkeypatch)
    rows = step(suffix_dedup.anchored, doc_id=list(range(len(texts))), text=texts)
    for r, t in zip(rows, texts, strict=True):
        first, place, last = suffix_dedup.runs_of(r["shapes"])
        assert len(first) == len(r["near"]) == len(r["next"]) == len(r["kinds"])
        assert np.concatenate([[0], last + 1]).tolist() == np.append(first, max(0, len(t or "") - 399)).tolist()
        assert (place >= last).all() and (place - first <= 200).all()
    long = [i for i, t in enumerate(texts) if len(t or "") >= 400]
    packed = {r["key"]: r["packed"] for r in step(suffix_dedup.packed, text=texts)}
    pick = lambda c: [rows[i][c] for i in long]
    shown = [list(range(0, len(near), 3)) for near in pick("near")]
    opened = [[i for i in range(len(near)) if i % 3] for near in pick("near")]
    starts = step(suffix_dedup.open_starts, row=long, packed=[packed[k] for k in pick("key")], shapes=pick("shapes"), open=opened, shown=shown)
    assert sum(1 for r in starts if r["row"] is None) > 0 and len(starts) == sum(len(texts[i]) - 399 for i in long)
    named = {}
    for r in starts:
        if r["row"] is not None:
            named.setdefault((r["name"], r["more"]), set()).add(texts[r["row"]][r["start"] : r["start"] + 400])
    strings = {next(iter(x)) for x in named.values()}
    assert all(len(x) == 1 for x in named.values()) and len(strings) == len(named)


def test_suffix_dedup(spark, documents, odd):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcde ") for _ in range(700)) for _ in range(4)]
    texts = [*odd, "b" * 399, "c" * 400, "d" * 401, "xy" * 210, "é" * 300]
    for _ in range(80):
        t = "".join(rng.choice([base[rng.randrange(4)][rng.randrange(600) :], "".join(rng.choice("abcde") for _ in range(rng.randrange(60))), "q" * rng.randrange(500)]) for _ in range(rng.randrange(1, 5)))
        at = rng.randrange(len(t) + 1)
        texts.append(t[:at] + "Z" + t[at + 1 :] if rng.random() < 0.5 else t)
    got = {r["doc_id"]: r for r in suffix_dedup.dedup(documents(texts)).collect()}
    cut = {r["doc_id"]: r for r in suffix_dedup.deduplicated(documents(texts)).collect()}
    seen = Counter(b[i : i + 400] for t in texts for b in [(t or "").encode()] for i in range(len(b) - 399))
    for n, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if seen[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        assert tuple(got[100 + n])[1:] == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        r = cut[100 + n]
        assert b"".join([b[x:y] for x, y in zip([0, *(s["end"] for s in r["spans"])], [*(s["start"] for s in r["spans"]), len(b)], strict=True)]) == kept and (bytes(r["kept"]) if r["kept"] is not None else b) == kept
    assert suffix_dedup.dedup(documents(["x"]).limit(0)).count() == 0


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def closure(near):
    root = np.arange(len(near))
    while True:
        new = np.array([root[row].min() for row in near])
        if (new == root).all():
            return root
        root = new


def test_simhash(spark, documents, odd):
    rng = random.Random(2)
    long = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(50)) for _ in range(400)) for _ in range(6)]
    texts = [*odd, *long, *(t + f" tail{i}" for i in range(4) for t in long), *(t.replace("alpha1", "Omega", 1) for t in long)]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(documents(texts)).collect()}
    fps = np.array([fingerprint(t) for t in texts], np.uint64)
    root = closure(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3)
    for i, fp in enumerate(fps):
        assert (got[100 + i]["fingerprint"], got[100 + i]["component_id"]) == (f"{fp:016x}", 100 + root[i])
    assert simhash.near_duplicates(documents(["x"]).limit(0)).count() == 0


@pytest.mark.parametrize("large", [20_000, 5, 2])
def test_links_of_crowded_fingerprints(spark, large, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE", large)
    rng, values = random.Random(5), set()
    for _ in range(20):
        base = rng.getrandbits(64)
        for _ in range(40):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    v = np.sort(np.array(sorted(values), np.uint64).view(np.int64))
    u = v.view(np.uint64)
    root = closure(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    edges = simhash.linked(spark.createDataFrame([(int(x),) for x in v], "fp long"))
    got = {r["node"]: r["root"] for r in graph.components(edges, common.scratch(spark, "components")).collect()}
    assert [got.get(int(x), int(x)) for x in v] == [int(v[r]) for r in root]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(edges, common.scratch(spark, "components")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    points = np.round(rng.normal(size=(700, 16)), 1)
    points[100:140] = points[100]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 16), (2060, [float("inf")] + [0.0] * 15), (2080, [1.0, 2.0])]
    for block in (topk.QUERIES, 7):
        was = topk.QUERIES, topk.ROWS, topk.LEAF
        topk.QUERIES, topk.ROWS, topk.LEAF = (block, block * 10, block // 2 + 1)
        got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20).collect()]
        topk.QUERIES, topk.ROWS, topk.LEAF = was
        ids = np.array([*range(700), 2080])
        v = np.floor(64 * np.vstack([points.astype(np.float32), np.array([[1.0, 2.0] + [0.0] * 14], np.float32)]).astype(np.float64)).astype(np.int64)
        want = []
        for q in np.flatnonzero(ids % 20 == 0):
            scores = v @ v[q]
            want += [(int(ids[q]), k + 1, int(ids[i]), int(scores[i])) for k, i in enumerate([i for i in np.lexsort((ids, -scores)) if i != q][:20])]
        assert sorted(got) == sorted(want)
    assert topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").limit(0), 20, 20).count() == 0


def depth(tree, node=0):
    first, last = tree.children[node]
    return 1 + max((depth(tree, c) for c in range(first, last)), default=0)


def test_cover_tree():
    """Nesting, covering and separation, on clustered and on evenly spread points, with repeated ones; real leaves at the bottom."""
    rng = np.random.default_rng(4)
    unit = rng.normal(size=(1500, 64))
    unit = np.floor(64 * unit / np.linalg.norm(unit, axis=1)[:, None])
    cases = [rng.integers(-50, 50, (40, 8)).repeat(30, axis=0) * 20 + rng.integers(-6, 7, (1200, 8)), rng.integers(-999, 999, (900, 3)), np.zeros((700, 4)), unit]
    for points, least in zip(cases, (3, 4, 1, 2), strict=True):
        tree = topk.CoverTree(np.arange(len(points)), points.astype(float))
        assert sorted(tree.ids) == list(range(len(points))) and depth(tree) >= least
        assert (tree.points == points[tree.ids]).all()
        for node, (first, last) in enumerate(tree.children):
            own = tree.points[tree.begin[node] : tree.end[node]]
            far = np.sqrt(((own - tree.points[tree.centre[node]]) ** 2).sum(axis=1))
            assert far.max() <= tree.radius[node] + 1e-9 and tree.begin[node] <= tree.centre[node] < tree.end[node]
            if first == last:
                assert len(own) <= topk.LEAF or tree.radius[node] == 0
                continue
            kids = range(first, last)
            assert tree.radius[node] <= 2.0 ** tree.level[node]
            centres = tree.points[tree.centre[first:last]]
            assert (centres == tree.points[tree.centre[node]]).all(axis=1).any()
            assert all(tree.radius[c] <= 2.0 ** (tree.level[node] - 1) for c in kids)
            d = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2)) + np.eye(len(centres)) * 1e9
            assert d.min() > 2.0 ** (tree.level[node] - 1)
            assert [tree.begin[node], *(tree.end[c] for c in kids)] == [*(tree.begin[c] for c in kids), tree.end[node]]


def test_dual_tree_search():
    """Exact whatever is dropped, and most pairs are dropped where points have clusters."""
    rng = np.random.default_rng(6)
    clustered = np.floor(rng.normal(size=(60, 16)).repeat(50, axis=0) * 300 + rng.normal(size=(3000, 16)) * 6)
    for points, share in ((clustered, 0.5), (np.floor(rng.normal(size=(1200, 24)) * 40), 1.0)):
        ids = np.arange(len(points)) * 3
        data, queries = topk.CoverTree(ids, points), topk.CoverTree(ids[::4], points[::4])
        best = topk.Best(len(queries.ids), 20, np.full(len(queries.ids), topk.NONE))
        topk.search(queries, data, best)
        for q, scores, found in zip(queries.ids, best.score, best.id, strict=True):
            exact = points @ points[q // 3]
            order = [i for i in np.lexsort((ids, -exact)) if ids[i] != q][:20]
            assert found.tolist() == ids[order].tolist() and scores.tolist() == exact[order].tolist()
        assert best.scored <= share * len(queries.ids) * len(ids)


def test_top_k_of_large_numbers(spark):
    """Finite vectors of any size take part: scores are exact, and those beyond 64 bits are the nearest that fit."""
    rng = random.Random(8)
    rows = [(0, [2.0**26, 0.0]), (20, [1.0, 1.0]), (3, [2.0**26, 1.0]), (40, [-(2.0**30), 2.0**29 + 0.5]), (5, [1e30, -1.0]), (60, [3e38, 3e38]), (61, [0.015625, -1e-9])] + [(100 + i, [rng.uniform(-1, 1) * 2.0 ** rng.randrange(40), rng.uniform(-9, 9)]) for i in range(120)]
    whole = {i: [int(np.floor(np.float64(np.float32(x)) * 64)) for x in v] for i, v in rows}
    want = []
    for q in sorted(i for i in whole if i % 20 == 0):
        fits = lambda x: min(2**63 - 1, max(-(2**63) + 1, x))
        scores = sorted(((-fits(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q))[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 20, 20).collect()]
    assert sorted(got) == want


def jaccard_roots(texts):
    """Which texts similarities of 0.8 or more link, by plain five-word sets; texts without words are alike."""
    words = [re.sub("[A-Z]", lambda m: m.group().lower(), t or "").split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    return closure(np.array([[a == b or len(a & b) >= 0.8 * len(a | b) for a in sets] for b in sets]))


def test_pipeline(spark, tmp_path):
    """Each stage against what a plain version keeps; then run() against the stages."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(3)
    words = [a + b for a in "ba de ki lo mu na pe ri so tu".split() for b in "lan ber kos min dar tel".split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    clean = [text(120) for _ in range(60)]
    item = text(40)
    # of five-word shingles: 0.97, 0.86 and 0.72 in common with the texts that they come from; fingerprints differ in many bits
    near = [clean[1] + " " + text(3), clean[2] + " " + text(20), clean[3] + " " + text(45)]
    texts = [*clean, clean[0], *near, "12 34 !!", text(30) + " " + item, text(50) + " password=s3cretvalue99 " + text(20), "", None, "kurz nur"]
    rows = [(i, t, "aa", f"src{i % 5}", None if t is None else len(t)) for i, t in enumerate(texts)] + [(3, clean[3], "aa", "src3", len(clean[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = [i for i, t in enumerate(texts) if t and re.search("[a-z]", t)]
    root = jaccard_roots([texts[i] for i in kept])
    assert [int(root[kept.index(61 + i)]) for i in range(3)] == [1, 2, kept.index(63)]
    first = [kept[i] for i in range(len(kept)) if root[i] == i]
    assert set(out) == {i for i in first if item not in texts[i]}
    assert len(out) == corpus_pipeline.run(spark, str(tmp_path)).count()
    masked = out[texts.index(next(t for t in texts if t and "password" in t))]
    assert stages.MASK in masked["text"] and "s3cretvalue99" not in masked["text"] and masked["n_chars"] == len(masked["text"])
    assert all(r["text"] == texts[i] for i, r in out.items() if i != masked["doc_id"])
    from tokenizers import Tokenizer

    ids = [e.ids for e in Tokenizer.from_file(stages.tokenizer(stages.BYTE_BPE)).encode_batch([r["text"] for r in out.values()], add_special_tokens=False)]
    assert all(np.frombuffer(r["token_ids"], "<u4").tolist() == x for r, x in zip(out.values(), ids, strict=True))
    for name, f in corpus_pipeline.STAGES:
        empty = f(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns + ["n_tokens", "token_ids"] * (name == "bpe_encoding") and empty.count() == 0, name


def test_clashing_columns_survive(spark, tmp_path):
    """Columns named like an operator's own keep their values and types in every stage."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    names = "score lang_pred rejected n_words n_hit n_items items_sha256 contaminated base extra row spans n_tokens token_ids decoded component fp __text __live key".split()
    texts = [" ".join(f"{a}{b}{i}" for a in "lorem ipsum dolor amet".split() for b in "abcdefgh") + (" password=s3cretvalue99 end" if i == 3 else "") for i in range(12)] + [None, ""]
    rows = [(i, t, "aa" if i % 2 else "bb", "src", *(f"{n}-{i}" for n in names)) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([(1, "nothing of the sort")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path)).collect()
        assert out, name
        for r in out:
            kept = [n if name != "bpe_encoding" or n not in ("n_tokens", "token_ids") else f"{n}_input" for n in names]
            assert [r[k] for k in kept] == [f"{n}-{r['doc_id']}" for n in names], name


def test_near_dedup_reaches_similarity(spark, documents, odd):
    """Copies with words changed, at five-word similarity of 0.8 or more, go; those below stay."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(100_000)}" for _ in range(400)] for _ in range(20)]
    change = lambda w, n: " ".join("new" if i % 40 == 20 and i // 40 < n else x for i, x in enumerate(w))
    texts = [*(" ".join(w) for w in base), *(change(w, n) for n in (4, 8) for w in base), *(" ".join("far" if i % 20 == 10 else x for i, x in enumerate(w)) for w in base)]
    short = ["one two three four five six seven eight", "one two three four five six seven eight nine", "one two three four five six seven"]
    texts += short
    root = jaccard_roots(texts)
    assert len(set(root)) == 42
    for large, size in ((resemblance.LARGE, resemblance.BYTES), (2, resemblance.BYTES), (resemblance.LARGE, 3000)):
        (resemblance.LARGE, resemblance.BYTES), was = (large, size), (resemblance.LARGE, resemblance.BYTES)
        out = stages.simhash_near_dedup(spark, documents(texts), "")
        assert sorted(r["doc_id"] for r in out.collect()) == sorted({100 + int(r) for r in root})
        resemblance.LARGE, resemblance.BYTES = was
    seen = {r["text"] for r in stages.simhash_near_dedup(spark, documents(odd), "").collect()}
    assert {t for t in odd if t and t.strip()} <= seen


def test_near_dedup_of_a_crowd(spark, documents, monkeypatch):
    """A crowd of near copies around the limit is dealt out once a text and block, not once a band, and no link in it is lost."""
    rng = random.Random(21)
    base = [f"w{i}" for i in range(150)]
    texts = [" ".join(f"n{rng.randrange(10**9)}" if x in gone else x for x in base) for gone in (set(rng.sample(base, rng.randrange(2, 9))) for _ in range(160))]
    root = jaccard_roots(texts)
    assert 20 < len(set(root)) < 150
    # neighbours in a chain of windows link if they are 12 words apart or fewer, and share bands if somewhat more
    at = np.cumsum([rng.randrange(9, 17) for _ in range(150)])
    chain = [" ".join(f"c{i}" for i in range(x, x + 120)) for x in at]
    dealt, written = [], common.written

    def counted(df, folder):
        out = written(df, folder)
        dealt.extend([out.count()] if folder.endswith("/keyed") else [])
        return out

    monkeypatch.setattr(common, "written", counted)
    # in a table of few places shared shingles are counted too often, never too seldom; groups of over WHOLE blocks may go by bands
    for some, large, marks, most in ((texts, 40, 64, 4 * len(texts)), (chain, 1, 1 << 20, len(chain) ** 2 - 1)):
        monkeypatch.setattr(resemblance, "LARGE", large)
        monkeypatch.setattr(resemblance, "MARKS", marks, raising=False)
        out = stages.simhash_near_dedup(spark, documents(some), "")
        assert sorted(r["doc_id"] for r in out.collect()) == sorted({100 + int(r) for r in jaccard_roots(some)})
        assert 0 < dealt[-1] <= most


def test_sieve(spark):
    """What is among the keys is always caught, and a small sieve catches more without losing any."""
    from pyspark.sql import functions as F

    df = spark.range(2000).select("id", F.xxhash64("id").alias("h"))
    keys = df.where("id % 10 = 0").union(df.where("id = 7"))
    for bits in (common.SIEVE_BITS, 1 << 12):
        common.SIEVE_BITS, was = bits, common.SIEVE_BITS
        words = common.sieve(keys, "h", f"{common.scratch(spark, 'sieve')}/words")
        caught, clear = ({r["id"] for r in common.sifted(df, "h", words, x).collect()} for x in (True, False))
        common.SIEVE_BITS = was
        assert {r["id"] for r in keys.collect()} <= caught and not caught & clear and len(caught) + len(clear) == 2000
        assert len(caught) < 400 and words.count() <= bits // 64


def test_near_dedup_of_shared_ids(spark):
    """Different texts under one doc_id stay, and copies without a doc_id go."""
    texts = [" ".join(f"{c}{i}" for i in range(50)) for c in "abcd"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (2, texts[0])]
    out = stages.simhash_near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, out), key=lambda r: r[1]) == [(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])]


def test_near_dedup_retrieves_by_simhash(spark):
    """Bands are what BK-trees over fingerprints link inside a table's buckets, also in crowds of near copies and in split buckets."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 4, 9, 60, 700)]
    found = resemblance.fingerprints(sets)
    bits = np.unpackbits(found.view(np.uint8).reshape(len(sets), -1), axis=1, bitorder="little")
    for own, row in zip(sets, bits, strict=True):  # a bit is 1 if set in over half of the word's hashes
        x = (own[:, None] * resemblance._FACTORS).view(np.uint64)
        x = (x ^ x >> np.uint64(32)) * resemblance._MIX
        x ^= x >> np.uint64(29)
        each = np.unpackbits(x.view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little")
        assert (row == (2 * each.sum(axis=0, dtype=int) > len(own))).all()

    centres = rng.integers(0, 1 << 63, (40, 2), np.uint64)
    flips = np.packbits(rng.random((400, 128)) < np.repeat(rng.uniform(0, 0.35, 400), 128).reshape(400, 128), axis=1).view(np.uint64)
    words = np.concatenate([centres, centres[np.where(np.arange(400) < 250, 0, rng.integers(0, 40, 400))] ^ flips])
    key, fp = np.where(rng.random(440) < 0.6, 3, rng.integers(0, 9, 440)), rng.permutation(440)
    out = resemblance.bands_of(pa.table({"key": key, "fp": fp, "w0": words[:, 0].view(np.int64), "w1": words[:, 1].view(np.int64)}))
    close = (np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2) <= resemblance.NEAR) & (key[:, None] == key)
    order = np.argsort(fp)
    root = closure(close[np.ix_(order, order)])
    sizes = np.bincount(root, minlength=440)
    want = sorted((int(i), int(r)) for i, r in enumerate(root) if sizes[r] > 1)
    assert sorted(zip(out["fp"].to_pylist(), out["first"].to_pylist(), strict=True)) == want and sizes.max() > 100
    assert len(set(out["band"].to_pylist())) == len({r for _, r in want})

    assert resemblance.bands_of(pa.table({c: np.arange(3) for c in ("key", "fp", "w0", "w1")})).num_rows == 0

    # one text's words changed bit by bit: crowded buckets are dealt out as pairs of blocks, and all stay linked
    base = resemblance.fingerprints([sets[4]])[0]
    rows = [(i, (base ^ np.array([1 << (i % 60), 0, 0, 0, 0, 0, 0, i // 60], np.uint64)).tobytes()) for i in range(900)] + [(5000, resemblance.fingerprints(sets[3:4])[0].tobytes()), (5001, None)]
    each = spark.createDataFrame(rows, "fp long, bits binary")
    for crowd in (resemblance.CROWD, 200):
        resemblance.CROWD, was = crowd, resemblance.CROWD
        bands = resemblance.banded(each, common.scratch(spark, "bands")).select("fp", "first").distinct().collect()
        resemblance.CROWD = was
        at = {r["fp"]: i for i, r in enumerate(bands)}
        ids = sorted({r["fp"] for r in bands})
        assert ids == [*range(900)] and at
        linked = np.eye(900, dtype=bool)
        for r in bands:
            linked[r["fp"], r["first"]] = linked[r["first"], r["fp"]] = True
        assert (closure(linked) == 0).all()
