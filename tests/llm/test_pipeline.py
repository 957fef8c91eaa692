"""Each stage of the corpus pipeline against a brute-force version on a small, odd table."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_llm import LINE, brute_components, brute_passages, shingles, words  # noqa: E402

CLASH = ["_doc", "_key", "_keep_bits", "_text", "_id", "_place", "_grouped", "kept", "component_id", "n_lines", "n_dropped", "text_key", "shard", "_b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def table():
    rng = np.random.default_rng(3)
    prose = [" ".join(f"w{x}" for x in rng.integers(0, 900, 120)) for _ in range(12)]
    docs = [(i, f"{LINE}\n{prose[i]}\n {LINE.upper()} \nshort line") for i in range(8)]
    docs += [(20 + i, prose[i] + f" only{i} few{i} more{i}") for i in range(4)]  # near copies of the texts' middle
    docs += [(40 + i, f"{prose[8]} tail{i}") for i in range(5)] + [(50, prose[8] + " tail0"), (51, "é" * 30 + prose[9][:70] + "漢"), (52, prose[9])]
    docs += [(60, None), (61, ""), (62, " \n\t "), (None, prose[8]), (None, None), (None, LINE)]
    docs += [(1, prose[10]), (1, prose[10]), (1, prose[11]), (3, docs[3][1]), (70, "a b c"), (71, "a b c"), (72, " ".join(["same words here again"] * 30))]
    docs += [(80, "y" * 60_000 + " " + prose[5]), (81, LINE)]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), *[f"{c}{n}" for c in CLASH]) for n, (i, t) in enumerate(table())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('labels')}"
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def rows_of(df, docs):
    assert df.columns == docs.columns
    out = [r.asDict() for r in df.collect()]
    for r in out:
        assert r["n_chars"] == len(r["text"] or "") or "n_chars" not in r
        assert len({r[c][len(c) :] for c in CLASH}) == 1  # the extra columns of a row stay together
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["text"] or "") for r in out)


def test_quality_rules(spark, docs, folder):
    def good(t):
        w = words(t)
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen = {}
        for r in runs:
            seen[r] = seen.get(r, 0) + 1
        cover = {i + k for i, r in enumerate(runs) if seen[r] > 1 for k in range(8)}
        return len(w) >= 20 and 100 * len(cover) <= 30 * len(w)

    want = sorted((-1 if i is None else i, t or "") for i, t in table() if good(t or ""))
    assert rows_of(corpus_pipeline.quality_rules(spark, docs, folder), docs) == want  # labels of one class: the base rules decide


def test_line_duplicates(spark, docs, folder):
    keys = {}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    for i, t in table():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40 and i is not None:
                keys.setdefault(key(x), set()).add(i)
    keep = {k: max(v) for k, v in keys.items() if len(v) >= 5}
    want = sorted((-1 if i is None else i, "\n".join(x for x in (t or "").split("\n") if i is None or keep.get(key(x), i) == i)) for i, t in table())
    assert rows_of(corpus_pipeline.line_duplicates(spark, docs, folder), docs) == want


def test_near_duplicates(spark, docs, folder):
    distinct = sorted({(i, t or "") for i, t in table() if i is not None})
    head = brute_components([shingles(t, 5) for _, t in distinct], 80)
    want = [distinct[i] for i in range(len(distinct)) if head[i] == i and words(distinct[i][1])]
    want += [(i, t or "") for i, t in table() if i is not None and not words(t)] + [(-1, t or "") for i, t in table() if i is None]
    assert rows_of(corpus_pipeline.near_duplicates(spark, docs, folder), docs) == sorted(want)


def test_repeated_passages(spark, docs, folder):
    raw = [(i, (t or "").encode()) for i, t in table()]
    want = sorted((i, kept.decode("utf-8", "ignore")) for i, _, _, _, kept in brute_passages(raw, 50))
    assert rows_of(corpus_pipeline.repeated_passages(spark, docs, folder), docs) == want


def test_all_stages_on_no_rows(spark, docs, folder):
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, folder)
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.packed_sequences(spark, none, folder).count() == 0


def test_packed_sequences(spark, docs, folder):
    rows = corpus_pipeline.packed_sequences(spark, docs, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["piece"] == 0 and r["doc_id"] is not None) == sorted((False, i) for i, _ in table() if i is not None)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(seqs) <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_quality_rules_with_a_model(spark, folder, tmp_path):
    """Labelled halves of two kinds of text: the trees are fitted in the stage, and its other half is judged by them."""
    rng = np.random.default_rng(8)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 9))) for _ in range(60))
    junk = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 4)) + "###" for _ in range(60))
    rows = [(i, prose() if i % 2 else junk()) for i in range(200)]
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 100)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, "doc_id long, text string"), d)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(1, 200, 2))


def test_packed_ids_are_those_of_the_tokenizer(spark, docs, folder):
    from tokenizers import Tokenizer

    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    want = sorted((i, tuple([*plain.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in table() if i is not None)
    pieces = {}
    for r in corpus_pipeline.packed_sequences(spark, docs.where("doc_id is not null").dropDuplicates(["doc_id"]), folder).collect():
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert len(ids) == r["length"]
        pieces.setdefault(r["doc_id"], []).append((r["start"], ids))
    got = {i: tuple(x for _, ids in sorted(p) for x in ids) for i, p in pieces.items()}
    assert all((i, t) in want for i, t in got.items()) and set(got) == {i for i, _ in want}


def test_run_on_the_test_tables(spark):
    """The stages one by one give what run() gives, each keeps the columns and no more rows than it had; run() leaves its result only."""
    import os

    from noveltide.llm.common import saved

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, d))
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before, name
        before = docs.count()
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(folder))
    packed = corpus_pipeline.run(spark, d)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert len(set(os.listdir(folder)) - there) == 1
