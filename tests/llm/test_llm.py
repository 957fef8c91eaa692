"""The training-data operators against brute force, and on odd input."""

import base64
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from noveltide.llm import bpe, embed_dedup, jaccard, line_dedup, packing, ppm, quality, sharding, suffix_dedup, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, shard int, n_lines string, kept string, component_id long"
LINE = "This line is long enough to be counted by the rule, surely."
ODD = [(i, f"{LINE}\nown line of document number {i} that nobody else has at all\n{LINE} " + " ".join(f"w{(i * 7 + k) % 40}" for k in range(60))) for i in range(6)]
ODD += [(10, None), (11, ""), (12, " \t\n "), (None, LINE), (None, None), (3, ODD[3][1]), (3, ODD[3][1]), (20, "x" * 5000), (21, "é漢" * 300), (22, ODD[0][1] + " extra"), (23, LINE)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "a", "b", 9) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_line_dedup(odd, empty):
    keys = {}
    for i, t in ODD:
        for x in (t or "").split("\n"):
            k = re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
            if len(k) >= 40 and i is not None:
                keys.setdefault(k, set()).add(i)
    keep = {k: max(v) for k, v in keys.items() if len(v) >= 5}
    want = []
    for i, t in ODD:
        rows = (t or "").split("\n")
        stay = [x for x in rows if i is None or keep.get(x.strip(" \t\n\x0b\x0c\r").lower(), i) == i]
        want.append((i or -1, len(rows), len(rows) - len(stay), "\n".join(stay)))
    got = [(r["doc_id"] or -1, r["n_lines"], r["n_dropped"], r["text"] or "") for r in line_dedup.dedup_lines(odd).collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_bpe_round_trip(odd, empty):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for _, t in ODD] + ["a \n b\x1cc\x85  d's 12'll", "  ", "\n\n x", "naïve  café\t\t!"]
    got = bpe.encoder(path, public_tokenizers.PATTERN).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [own.encode_ordinary(x) for x in texts]
    rows = bpe.decode(bpe.encode(odd, path, public_tokenizers.PATTERN), path).collect()
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted((t or "").encode() for _, t in ODD)
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("capacity", [16, 128])
def test_packing_against_brute_force(spark, odd, empty, capacity):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = []
    for i, t in ODD:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want.append((-1 if i is None else i, k, at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())))
    rows = packing.pack(odd, path, capacity, with_ids=True).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    seqs = {}
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(seqs) <= sum(x[3] for x in want) / capacity * 1.2 + 1
    assert packing.pack(empty, path).count() == 0


def test_words_are_encoded_as_by_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.WordIds(path, limit=50)
    tok.encode_special_tokens = True
    assert own.ends is not None
    rng = np.random.default_rng(8)
    chars = list("aAbÉéß×÷ªµŒ'’ı İ12.,<|>\x1c\x02\u0301 中ñÑsStTdD\n\t")
    for text in ["", "<|endoftext|> don't DON'T ''s", *("".join(rng.choice(chars, int(rng.integers(1, 40)))) for _ in range(2000))]:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_plain_texts_are_encoded_by_pieces_which_stay_while_in_use():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), packing.WordIds(path, limit=40)
    tok.encode_special_tokens = True
    asked = []
    ids, own._ids = own._ids, lambda texts: asked.extend(" ".join(texts).split()) or ids(texts)
    rng = np.random.default_rng(9)
    chars = list("aAbÉéßsStTdDlLvVeErR'',.!12<|> \n\t\x0b\x0c")
    for _ in range(300):
        texts = ["".join(rng.choice(chars, int(rng.integers(0, 40)))) for _ in range(3)]
        texts += ["the same words, it's all the same", "x" * 60, "<|endoftext|> DON'T ''s\x0b,'s", "plain but for 中"]
        for text, found in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text
        assert len(own.pieces) < 300 and not any(len(p) > 48 for p in own.pieces)
    assert asked.count("same") == asked.count("words") == 1  # pieces in use are not encoded again


@pytest.mark.parametrize(("n", "share"), [(3_000, 0.0), (100_000, 0.9), (3_000_000, 0.9)])
def test_configurations_lay_out_nearly_all(n, share):
    rng = np.random.default_rng(0)
    lengths = np.clip(np.exp(rng.normal(5.3, 0.9, n)).astype(int) + 1, 1, 4096)
    counts = np.bincount(lengths, minlength=4097)
    solved = packing.configurations(counts, 4096)
    assert solved.gap() < 0.005
    placed = sum(config.total() * times for config, times in packing.rounded(solved.amounts, counts, 4096))
    assert placed >= share * (n - counts[4096])
    runs = packing.layout({int(s): int(counts[s]) for s in np.flatnonzero(counts)}, 4096)
    assert sum(b - a for _, a, b, *_ in runs) == n
    used = {(q, (b - a) // k) for _, a, b, q, k, _ in runs}
    assert max(q + m for q, m in used) <= solved.bound * 1.005 + counts[4096] + 2
    table, widths = packing.blocks(runs)
    assert table.num_rows <= 2 * len(runs) + 4096


def test_layout_covers_every_rank_once():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 200, 3000), np.full(500, 7), np.full(10, 256), np.array([256, 1]), np.arange(1, 257)):
        sizes, times = np.unique(lengths, return_counts=True)
        runs = packing.layout({int(s): int(n) for s, n in zip(sizes, times, strict=True)}, 256)
        seen, content = {}, {}
        for s, a, b, q, k, place in runs:
            for rank in range(a, b):
                assert (s, rank) not in seen
                seen[s, rank] = True
                content.setdefault(q + (rank - a) // k, []).append((place + (rank - a) % k * s, s))
        assert len(seen) == len(lengths)
        for parts in content.values():
            at = 0
            for place, s in sorted(parts):
                assert place == at
                at += s
            assert at <= 256
        assert len(content) <= np.ceil(lengths.sum() / 256) * 1.05 + 1
    assert packing.layout({}, 256) == []


def test_toxicity_learns(spark, empty):
    docs = [(i, f"plain text number {i} " + ("awfulword here" if i % 4 == 0 else "nice here")) for i in range(200)] + [(None, "awfulword"), (900, None)]
    lab = [(i, i % 2, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(d, spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))
    rows = toxicity.score(d, model).collect()
    assert all(r["toxic"] == (r["doc_id"] is None or r["doc_id"] < 200 and r["doc_id"] % 4 == 0) for r in rows)
    assert toxicity.score(empty, None).count() == 0
    assert toxicity.fit(d, spark.createDataFrame([], "doc_id long, quality int, toxic int")) is None


def test_toxicity_sees_through_punctuation(spark):
    import string

    docs = [(i, f"plain text number {i} " + ("awfulword here" if i % 4 == 0 else "nice here")) for i in range(200)]
    lab = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(lab, "doc_id long, quality int, toxic int"))
    glued = [(i, f"plain text {a}number{c} {c}awfulword{c * 3} here") for i, c in enumerate(string.punctuation) for a in ("", c)]
    rows = toxicity.score(spark.createDataFrame(glued, "doc_id long, text string"), model).collect()
    assert all(r["toxic"] for r in rows)
    assert toxicity.words_of(b"#$%&idiot*<> ### it's") == {b"idiot", b"it's"}


def brute_ppm(train):
    """Counts of all runs by context length, from plain dictionaries; gives a function text -> log10 probability."""
    order = ppm.ORDER
    after = [{} for _ in range(order + 1)]
    symbols = lambda t: [ppm.PAD] * order + list(t) + [ppm.END]
    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                own = after[k].setdefault(tuple(s[i - k : i]), {})
                own[s[i]] = own.get(s[i], 0) + 1

    def one(context, x):
        p, gone = 1.0, set()
        for k in range(order, -1, -1):
            own = after[k].get(tuple(context[len(context) - k :]))
            if own is None:
                continue
            left = {s: n for s, n in own.items() if s not in gone}
            total = sum(left.values()) + len(left)
            if x in left:
                return p * left[x] / total
            p *= len(left) / total if total else 1.0
            gone = set(own)
        return p / max(ppm.SYMBOLS - len(after[0].get((), {})), 1)

    def score(t):
        s = symbols(t)
        return sum(np.log10(one(s[:i], s[i])) for i in range(order, len(s)))

    return score


def test_ppm_sums_to_one():
    texts = [f"abracadabra {i} banana".encode() for i in range(30)]
    codes, counts = ppm.summed(ppm.grams(texts)[0])
    trie = ppm.build(codes, counts, ppm.summed(codes & ppm.low(ppm.KEY), counts))
    for context in (b"", b"abra", b"ban", b"qqq", b"a banan"):
        code = 0
        for s in ([ppm.PAD] * ppm.ORDER + list(context))[-ppm.ORDER :]:
            code = code << 9 | s
        codes = np.array([code << 9 | s for s in range(ppm.SYMBOLS)], dtype=np.uint64)
        assert abs((10 ** trie.log10(codes)).sum() - 1) < 1e-6


def test_ppm_takes_long_texts_in_pieces(monkeypatch):
    texts = [b"", ("ab cd\u00e9 " * 40).encode(), b"x" * 333, b"one two", b" "]
    hashes = ppm.WordHashes()
    whole = list(ppm.word_portions(texts, hashes))
    monkeypatch.setattr(ppm, "SPAN", 50)
    pieces = [ppm.codes_of(items)[0] for _, items in ppm.portions(texts)]
    assert len(pieces) > 5 and (np.concatenate(pieces) == ppm.grams(texts)[0]).all()
    cut = list(ppm.word_portions(texts, hashes))
    assert len(cut) > 5
    for k in (0, 1):
        assert (np.concatenate([x[k] for x in cut]) == np.concatenate([x[k] for x in whole])).all()


def test_ppm_against_brute_force(spark, odd, empty, monkeypatch):
    rng = np.random.default_rng(7)
    common = [f"word{k}" for k in range(40)]
    docs = [(i, " ".join(rng.choice(common, 30)) + f" rare passage {i} of zyx{i * 7919}q", 0) for i in range(60)]
    docs += [(400, docs[3][1][-30:], 0), (401, "wholly unknown \u00e9\u6f22 QQ~~ 7919", 0), (402, "", 0), (403, None, 0), (None, docs[5][1][-30:], 0), (4, docs[4][1], 0)]
    schema = "doc_id long, text string, code int"
    d = spark.createDataFrame(docs, schema)
    training = F.col("doc_id") < 60
    learned = [(t or "").encode() for i, t, _ in docs if i is not None and i < 60]
    brute = brute_ppm(learned)
    tokens = lambda t: [*t.lower().split(), None]
    counts = {}
    for t in learned:
        for w in tokens(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in docs:
        own = tokens((t or "").encode())
        base = sum(np.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want.append((-1 if i is None else i, len(own), sum(w in counts for w in own), n, base, brute((t or "").encode())))
    for support, word_support, span in ((ppm.SUPPORT, ppm.WORD_SUPPORT, ppm.SPAN), (8, 4, 50), (0, 0, 50)):
        monkeypatch.setattr(ppm, "SPAN", span)
        rows = ppm.score(d, training, support, word_support).drop("training").collect()
        got = [(-1 if r[0] is None else r[0], *r[1:]) for r in rows]
        assert [x[:4] for x in sorted(got)] == [x[:4] for x in sorted(want)]
        assert np.allclose([x[4:] for x in sorted(got)], [x[4:] for x in sorted(want)], atol=1e-6)
    nothing = ppm.score(odd, F.lit(False)).collect()
    assert {r["train_tokens"] for r in nothing} == {0}
    texts = sorted(len((t or "").encode()) + 1 for _, t in ODD)
    assert np.allclose(sorted(-r["score"] for r in nothing), [n * np.log10(ppm.SYMBOLS) for n in texts])
    assert ppm.score(odd, F.col("doc_id") % 2 == 0).count() == len(ODD)
    assert ppm.score(empty, F.lit(True)).count() == 0


@pytest.mark.parametrize(("slack", "cell_rows"), [(0.4, 40), (1.0, 40), (1.0, 4), (0.4, 4)])
def test_embeddings_against_brute_force(spark, slack, cell_rows):
    """With slack 1 all links are found; with 0.4 nine tenths at least, and never one that is none."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:60] + rng.normal(0, 0.03, (60, 16)), base[:5], base[:5]])
    label = np.array([i % 3 if i < 300 else (i - 300) % 60 % 3 for i in range(len(x))])
    rows = [(i, v.tolist(), int(k), "own") for i, (v, k) in enumerate(zip(x, label, strict=True))]
    odd = [(1000, [0.0] * 16, 1), (1001, None, 1), (1002, [1.0, None], 1), (1003, base[0].tolist(), None), (None, base[0].tolist(), 0), (1004, [float("nan")] * 16, 1), (1005, [], 1), (7, x[7].tolist(), 1)]
    rows += [(*r, "own") for r in odd]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    out = embed_dedup.near_vectors(table, cell_rows=cell_rows, block=50, slack=slack).collect()
    assert len(out) == len(rows)
    u = np.array([np.float32(v) for v in [*x, x[7], base[0]]], dtype=float)  # vector 7 is there twice, and base[0] without an id
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    ids, label = np.append(np.arange(len(x)), [7, -1]), np.append(label, [1, 0])
    link = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    link[-1] = link[:, -1] = False
    np.fill_diagonal(link, False)
    head = ids.copy()
    for _ in range(len(ids)):
        for i in range(len(ids)):
            head[i] = min([head[i], *head[link[i]]])
    want = sorted((int(ids[i]), int(link[i].sum()), int(head[i])) for i in range(len(ids) - 1))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None and r["vec_id"] < 1000)
    if slack == 1.0:
        assert got == want
    recall = sum(g[1] for g in got) / sum(w[1] for w in want)
    print(f"slack {slack}, {cell_rows} rows a cell: recall of links {recall:.3f}")
    assert recall >= 0.9 and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in out)
    assert all(r["n_links"] == 0 and r["kept"] for r in out if r["vec_id"] is None or r["vec_id"] >= 1000)
    assert embed_dedup.near_vectors(table.limit(0)).count() == 0


def test_sharding(odd, empty):
    rows = sharding.shard_documents(odd, 4).collect()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in rows) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ODD)
    for s in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.shard_documents(empty).count() == 0


def test_sharding_balances_and_keeps_groups_together(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPLIT", 50)
    rng = np.random.default_rng(12)
    size = [*[2] * 60, *[5] * 40, *[40] * 5, 900]  # copies of each text; the last group is a third of all rows
    texts = [f"text {g} " + "x" * int(rng.integers(10, 400)) for g, n in enumerate(size) for _ in range(1)]
    docs = [(g, texts[g]) for g, n in enumerate(size) for _ in range(n)] + [(0, f"single {k} " + "y" * int(rng.integers(10, 400))) for k in range(1000)] + [(0, None)] * 20
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 8).collect()
    shard = {r["doc_id"]: r["shard"] for r in rows}
    load = np.zeros(8)
    for r in rows:
        load[r["shard"]] += r["size"]
    assert abs(load - load.mean()).max() <= 2 * max(r["size"] for r in rows)

    def cut(where):
        """Linked documents away from the shard that holds most of their group."""
        away, at = 0, 0
        for n in size:
            own = [where(i) for i in range(at, at + n)]
            away += n - max(own.count(x) for x in set(own))
            at += n
        return away

    assert cut(shard.get) < 0.7 * cut(lambda i: zlib.crc32(str(i).encode()) % 8)


def shingles(t, width):
    w = words(t)
    k = min(width, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def brute_components(sets, percent):
    """For each set the number of the first set in its component."""
    head = list(range(len(sets)))
    links = [(a, b) for a in head for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(head[a], head[b])
            changed |= head[a] != low or head[b] != low
            head[a] = head[b] = low
    return head


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_jaccard_against_brute_force(spark, odd, empty, width, percent):
    rng = np.random.default_rng(width)
    docs = [(i, t) for i, t in ODD if i is not None]
    for f in range(12):
        base = [f"t{x}" for x in rng.integers(0, 500, int(rng.integers(8, 200)))]
        for k in range(8):
            copy = list(base)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = f"z{k}"
            docs.append((100 + f * 10 + k, " ".join(copy)))
    sets = [shingles(t, width) for _, t in docs]
    head = brute_components(sets, percent)
    want = sorted((i, len(s), min(docs[k][0] for k in range(len(docs)) if head[k] == h)) for (i, _), s, h in zip(docs, sets, head, strict=True))
    got = jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string"), width, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    assert jaccard.similar_documents(odd, width, percent).count() == len(ODD)
    assert jaccard.similar_documents(empty, width, percent).count() == 0


def test_jaccard_moves_only_sets_that_a_sketch_leaves_a_partner(spark, monkeypatch):
    """Documents that share half of their words share tokens too; before, all their sets were shuffled (F1)."""
    rng = np.random.default_rng(3)
    passage = [f"p{x}" for x in range(60)]
    docs = [(i, " ".join([f"o{x}" for x in rng.integers(0, 10**6, 60)] + passage)) for i in range(150)]
    docs += [(200, docs[7][1] + " end"), (201, docs[9][1])]
    kept, save = {}, jaccard.saved

    def spy(df):
        out = save(df)
        kept.setdefault(tuple(df.columns), []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "saved", spy)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == {i: {200: 7, 201: 9}.get(i, i) for i, _ in docs}
    assert kept["node", "n", "grp"][0] == 151 and sum(kept["node", "shingles"]) < 20


def test_sketches_differ_no_more_than_their_sets():
    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 300, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for swaps, more in ((0, 0), (n // 10, 0), (n // 10, n // 5), (n, n)):
            b = np.unique(np.concatenate([a[swaps:], rng.integers(0, 1 << 63, swaps + more).astype(np.uint64)]))
            if not len(b):
                continue
            x, y = jaccard.sketch(a)[None], jaccard.sketch(b)[None]
            few = min(x.shape[1], y.shape[1])
            apart = int(np.bitwise_count(jaccard.folded(x, few) ^ jaccard.folded(y, few)).sum())
            assert apart <= len(np.setxor1d(a, b)) and (apart > 0.2 * n or swaps < n or n < 64)


def test_sketches_are_compared_in_blocks(monkeypatch):
    """What sift leaves holds all links between parts, whatever it compares at once."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (40, 60, 70, 120, 130, 250, 260, 520)]
    sets = [np.unique(np.concatenate([b[k % 9 :], rng.integers(0, 1 << 63, k % 7).astype(np.uint64)])) for b in base for k in range(12)]
    rows = {"grp": [], "chunk": [], "side": [], "asks": [], "n": [], "part": [], "sketch": []}
    for i, s in enumerate(sets):
        for k, v in zip(rows, (i % 3, i % 2, int(i % 5 == 0), i % 4 > 0, len(s), i // 2, jaccard.sketch(s).tobytes()), strict=True):
            rows[k].append(v)
    table, got = pa.table(rows), []
    for pairs, words in ((1 << 18, 1 << 20), (5, 3)):
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        monkeypatch.setattr(jaccard, "SKETCH_WORDS", words)
        got.append(jaccard.sift(table, 80))
    assert got[0].tolist() == got[1].tolist() and got[0].sum() < len(sets)
    for i, j in ((i, j) for i in range(len(sets)) for j in range(len(sets))):
        alike = all(rows[c][i] == rows[c][j] for c in ("grp", "chunk")) and rows["side"][i] == 0 and rows["asks"][j] and rows["part"][i] != rows["part"][j]
        if alike and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])):
            assert got[0][i] and got[0][j]
    assert jaccard.sift(table.slice(0, 0), 80).tolist() == []


def test_groups_to_open_by_pairs_of_groups(spark, monkeypatch):
    """The groups that nodes ask for are those of a join of nodes with groups, from pairs of groups (F1)."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = sorted({(int(t), int(n), int(n) // 3, int(n) % 5) for t, n in zip(rng.integers(0, 30, 500), rng.integers(0, 60, 500), strict=True)})
    rows += [(100, 90, 30, 1), (100, 91, 30, 2)]  # one part: nothing to ask for
    placed = spark.createDataFrame(rows, "token long, node long, part long, grp long")
    want = {(a[3], b[3], a[1]) for a in rows for b in rows if a[0] == b[0] and a[3] != b[3] and a[2] != b[2]}
    for pairs in (jaccard.PAIRS, 7):
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        got = [tuple(r) for r in jaccard._wishes(placed).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert jaccard._wishes(placed.where(F.lit(False))).count() == 0


def brute_passages(rows, length):
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1) if i is not None else ():
            w = t[k : k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1) if i is not None else ():
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t)))
        out.append((-1 if i is None else i, len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [300, 100_000])
def test_suffix_dedup_against_brute_force(spark, odd, empty, chunk, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdef \n"), 2000))
    docs = list(ODD)
    for i in range(60):
        parts = []
        for _ in range(int(rng.integers(0, 5))):
            at, n = int(rng.integers(0, 1900)), int(rng.choice([30, 49, 50, 51, 60, 90]))
            parts.append(base[at : at + n] + "".join(rng.choice(list("xyz"), int(rng.integers(0, 30)))))
        docs.append((30 + i, "".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup_passages(df).collect())
    assert got == brute_passages([(i, (t or "").encode()) for i, t in docs], 50)
    assert suffix_dedup.dedup_passages(empty).count() == 0


def test_suffix_order_and_transform():
    s = np.append(np.array(list(b"mississippi")) - 96, 0)
    order = suffix_dedup.suffix_order(s, 12)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    before, onto = suffix_dedup.transform(s, order)
    assert "".join(chr(x + 96) if x else "$" for x in before) == "ipssm$pissii"
    assert [order[onto[r]] for r in range(len(s))] == [(i - 1) % len(s) for i in order]


@pytest.mark.parametrize("length", [1, 3, 10, 50])
def test_equal_prefixes_against_brute_force(length):
    rng = np.random.default_rng(length)
    base = rng.integers(1, 4, 400)
    strings = [base[a : a + int(n)].tolist() for a, n in zip(rng.integers(0, 300, 40), rng.integers(length, length + 60, 40), strict=True)]
    s = np.array([x for t in strings for x in [*t, 0]])
    group = suffix_dedup.equal_prefixes(s, length)
    seen = {}
    for i in range(len(s) - length + 1):
        if (s[i : i + length] > 0).all():
            seen.setdefault(tuple(s[i : i + length]), set()).add(group[i])
    assert all(len(x) == 1 for x in seen.values()) and len({min(x) for x in seen.values()}) == len(seen)


def brute_quality(t):
    w = words_as_they_are(t)
    lines = [x for x in (t or "").split("\n") if words_as_they_are(x)]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times = {}
    for r in runs:
        times[r] = times.get(r, 0) + 1
    cover = {i + k for i, r in enumerate(runs) if times[r] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), failed


def words_as_they_are(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(9)
    docs = list(ODD)
    for i in range(60):
        part = " ".join(rng.choice([f"w{k}" for k in range(30)] + ["#a", "é|", "\u00a0x", "<b>", "A*b"], int(rng.integers(1, 60))))
        docs.append((100 + i, part + rng.choice(["\n", " ", "\n\n", "\x1c", "\x0b"]) + part[: int(rng.integers(0, len(part)))] + "\n" + part))
    rows = quality.assess(spark.createDataFrame(docs, "doc_id long, text string"), None).collect()
    got = sorted((r["doc_id"] or -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert got == sorted((i or -1, *brute_quality(t)) for i, t in docs)
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # no model: the base rules decide


def held_out(spark, fit, verdict, column, good):
    """Share of right verdicts on labelled documents of sf0.01 that were not fitted on, for label values that are good and not."""
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = spark.read.parquet(f"{d}/labels.parquet").where(f"{column} is not null")
    side = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    counts = {True: [0, 0], False: [0, 0]}
    for half in (0, 1):
        model = fit(docs, known.where(side == half))
        for r in verdict(docs, model).join(known.where(side != half).select("doc_id", column), "doc_id").collect():
            if "base_failed" not in r or not r["base_failed"]:
                own = r["kept"] if "kept" in r else not r["toxic_found"]
                counts[(r[column] > 0) == good][0] += own == ((r[column] > 0) == good)
                counts[(r[column] > 0) == good][1] += 1
    return {k: a / max(b, 1) for k, (a, b) in counts.items()}, counts


def test_quality_on_held_out_labels(spark):
    share, counts = held_out(spark, quality.fit, quality.assess, "quality", True)
    print("quality, held out: right on good and on bad documents", share, counts)
    assert share[True] > 0.95 and (share[False] > 0.8 or counts[False][1] < 5)


def test_toxicity_on_held_out_labels(spark):
    verdict = lambda docs, model: toxicity.score(docs, model).withColumnRenamed("toxic", "toxic_found")
    share, counts = held_out(spark, toxicity.fit, verdict, "toxic", False)
    print("toxicity, held out: right on clean and on toxic documents", share, counts)
    assert share[True] > 0.97 and share[False] > 0.4


def test_long_text_among_short_ones(spark):
    """A text of 3 MB, one word of 300 kB, and a text of one line, in every operator that reads texts."""
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice([f"word{k}" for k in range(500)], 400_000).tolist())
    docs = [(1, long), (2, "short text"), (3, long + " end"), (4, "z" * 300_000), (5, None), (6, "\n".join([LINE] * 3))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["n_words"] for r in quality.assess(d, None).collect()}[1] == 400_000
    assert line_dedup.dedup_lines(d).count() == 6
    found = {r["doc_id"]: r for r in jaccard.similar_documents(d).collect()}
    assert found[3]["component_id"] == 1 and found[4]["component_id"] == 4
    cut = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.dedup_passages(d).collect()}
    assert cut[3] == len(long) and cut[1] == 0 and cut[4] == 0
    packed = packing.pack(d, public_tokenizers.path("word_bpe_49k.json")).where("doc_id = 1").agg(F.sum("length"), F.max("length")).first()
    assert packed[0] > 400_000 and packed[1] == 4096
    scored = {r["doc_id"]: r for r in ppm.score(d, F.col("doc_id") != 3).collect()}
    assert scored[3]["n_tokens"] == 400_002 and scored[3]["n_known"] == 400_001
    assert sharding.shard_documents(d, 2).count() == 6 and toxicity.score(d, None).count() == 6


CLASH = "doc_id long, text string, text_key long, kept string, keep_bits string, _keep_bits string, _doc string, _key string, node long, shard int, length int, tokens int, grp int, part int, component_id int, training int, n_lines int"


def test_columns_of_clashing_names(spark):
    docs = [(i, t, *[None] * 15) for i, t in ODD]
    d = spark.createDataFrame(docs, CLASH)
    plain = d.select("doc_id", "text")
    path = public_tokenizers.path("word_bpe_49k.json")
    for fn in (
        lambda x: line_dedup.dedup_lines(x).select("doc_id", "text", "n_dropped"),
        lambda x: jaccard.similar_documents(x),
        lambda x: suffix_dedup.dedup_passages(x),
        lambda x: packing.pieces(x, path),
        lambda x: ppm.score(x, F.col("doc_id") < 20).select("doc_id", "n_tokens", "n_known"),
        lambda x: sharding.shard_documents(x, 3).select("doc_id", "size", "shard"),
        lambda x: quality.assess(x, None),
        lambda x: toxicity.score(x, None),
    ):
        assert sorted(map(repr, fn(d).collect())) == sorted(map(repr, fn(plain).collect()))


def test_quality_statistics_and_signs(spark, odd, empty):
    t = "a b\na b\n\n # |x é\n" + " ".join(["one two three four five six seven eight nine"] * 2)
    (n, chars, symbols, dup, repeat), _ = quality.statistics(t.encode(), quality.WordHashes())
    w = words(t)
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    cover = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(8)}
    assert (n, chars, symbols, dup, repeat) == (len(w), sum(map(len, w)), 2, 1, len(cover))
    rng = np.random.default_rng(6)
    x = rng.uniform(size=(2000, 2))
    y = ((x[:, 0] + rng.normal(0, 0.3, 2000) < 0.5)).astype(float)
    trees = quality.fit_trees(x, y, [-1, 0])
    grid = np.stack([np.linspace(0, 1, 50), np.full(50, 0.5)], axis=1)
    assert (np.diff(trees.score(grid)) <= 1e-9).all()
    assert quality.assess(odd, None).count() == len(ODD)
    assert quality.assess(empty, None).count() == 0
    assert quality.keep_good(odd, None).columns == odd.columns


def test_a_suffix_task_lets_go_of_the_tokenizer():
    """Workers serve stages of several operators: what packing keeps in one is not there beside a suffix array."""
    import pyarrow as pa

    from noveltide.llm import common, suffix_dedup

    common.held("words", dict)
    assert list(suffix_dedup._chunks(pa.RecordBatch.from_pylist([], schema=pa.schema([("chunk_id", pa.int64())])), 50)) == []
    assert not common._held


def _peak(work):
    """What work() gives, and the most bytes that it took at once."""
    import tracemalloc

    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_suffix_tasks_take_little_beside_their_text():
    """Two tasks share an executor with a full heap: neither a chunk nor a bucket may take tens of bytes for each of its own."""
    import pyarrow as pa
    import zstandard

    rng = np.random.default_rng(3)
    text, sizes = rng.integers(97, 123, 1_000_000).astype(np.uint8), np.full(500, 2000, dtype="<i8")
    text[500_000:] = text[:500_000]
    ids = np.arange(500, dtype="<i8").tobytes()
    row = ids, ids, np.ones(500, dtype=np.uint8).tobytes(), sizes.tobytes(), zstandard.compress(text.tobytes())
    chunk, peak = _peak(lambda: suffix_dedup.Chunk(*row, 50))
    assert peak < 20 * len(text)
    unique, inverse, several = chunk.grams()
    assert several.all()
    (_, chosen, _, _), peak = _peak(lambda: chunk.picked(unique, inverse, several))
    assert len(chosen) == len(chunk.first) // 2 and peak < 20 * len(text)
    first = np.sort(rng.integers(0, len(text) - 80, 5000))
    end = first + rng.integers(1, 80, 5000)
    assert (suffix_dedup.span_keys(text, first, end, most=700) == suffix_dedup.span_keys(text, first, end, most=len(text))).all()
    # a bucket of 30,000 strings of 70 bytes, no two alike but in pairs of one anchor
    strings = rng.integers(97, 123, (30_000, 70)).astype(np.uint8)
    table = {
        "chunk_id": [0], "place": [np.arange(30_000, dtype="<i4").tobytes()], "docs": [np.arange(30_000, dtype="<i8").tobytes()],
        "several": [bytes(30_000)], "grams": [(np.arange(30_000, dtype="<u8") // 2).tobytes()], "counts": [bytes([21]) * 30_000],
        "strings": [zstandard.compress(strings.tobytes())],
    }
    _, peak = _peak(lambda: suffix_dedup._answer_strings(50)(pa.table(table)))
    assert peak < 25 * strings.size


def test_workers_keep_between_tasks_only_what_serves_the_next():
    """Operators share workers: a task drops what others held, and packing's table its older half when a task ends."""
    from noveltide.llm import common

    common.let_go()
    words = common.held(("words", "x"), lambda: packing.WordIds.__new__(packing.WordIds))
    words.pieces, words.older = {"a": b"1"}, {"b": b"2"}
    common.held("other", dict)
    common.let_go(("words", "x"))
    assert list(common._held) == [("words", "x")] and words.pieces and not words.older
    common.let_go()
    assert not common._held
