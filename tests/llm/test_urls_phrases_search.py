"""URL filters, phrase mining and ranked search against brute force, and on odd input."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from noveltide.llm import phrases, search, url_filter

low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

# URL filters

PAGES = [
    (1, "https://www.Example.com/en/a?x=/fr/", "<p>free bets free bets casino</p>"),
    (2, "http://m.example.com/en/b#/q", "<script>var hidden = 1</script> free casino &amp; bets"),
    (3, "https://freebets.example.org/en/win", None),
    (4, "https://example.net/es/1", "<style>p{}</style>casino casino win"),
    (5, "https://news.example.net/fr/freebets", "win"),
    (6, "https://xcom/en/", "daily news daily news"),
    (7, "https://dailynews.example.org/de/9", ""),
    (8, None, "x"),
    (9, "no scheme.com/en/", None),
    (10, "a://b://c.com/d", None),
    (11, "https://shop.com", None),
    (12, "https://shop.com?/x", None),
    (13, "https://COM/Path/../Up", None),
    (13, "https://COM/Path/../Up", None),
    (None, "https://bücher-laden.example.org/de/é", "bücher laden"),
    (15, "https://" + "freebets" * 300 + ".org/en/" + "casino/" * 500, "long"),
    (16, "", None),
    (17, "https:///only/path", None),
    (18, "https://a.example.com\n.net/fr/\nx", None),
]


def brute_judge(pages):
    seen = Counter()
    for _, _, html in pages:
        text = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&#?\w+;", " ", html or "")
        seen.update(w for w in re.split(r"[\W_]+", low(text)) if 1 <= len(w) <= url_filter.LONGEST)
    total = sum(seen.values())

    def split(name):
        best = [(0.0, [])]
        for end in range(1, len(name) + 1):
            some = []
            for start in range(end - 1, max(0, end - url_filter.LONGEST) - 1, -1):
                w = name[start:end]
                value = math.log(seen[w]) if seen[w] else (1 - len(w)) * math.log(10)
                some.append((best[start][0] + value - math.log(total), [*best[start][1], w]))
            best.append(max(some, key=lambda x: x[0]))
        return best[-1][1]

    rows = []
    for page, url, _ in pages:
        url = url or ""
        rest = url[url.index("://") + 3 :] if "://" in url else ""
        host = low(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = []
        for verdict, rule in url_filter.RULES:
            name, start = rule.split("/", 1)
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start):
                fits.append((len(rule), rule, verdict))
        words = [w for name in re.split(r"[\W_]+", host) if name for w in split(name)]
        tokens = ["h:" + w for w in words] + ["p:" + w for w in re.split(r"[\W_]+", low(path)) if w]
        rows.append((page, host, path, words, max(fits, default=(0, None, None))[1:], tokens))
    counts = {v: Counter() for v in ("allow", "block")}
    urls = Counter(r[4][1] for r in rows if r[4][1])
    for r in rows:
        if r[4][1]:
            counts[r[4][1]].update(r[5])
    v = len(set(counts["allow"]) | set(counts["block"]))
    out = []
    for page, host, path, words, (rule, verdict), tokens in rows:
        if verdict is None:
            odds = {c: math.log(urls[c]) + sum(math.log((counts[c][t] + 1) / (sum(counts[c].values()) + v)) for t in tokens) for c in counts}
            verdict = "block" if odds["block"] > odds["allow"] else "allow"
        out.append((page, host, path, words, rule, verdict))
    return out


def test_urls_are_judged_as_by_brute_force(spark):
    df = spark.createDataFrame([(p, u, h, "x", "y") for p, u, h in PAGES], "page_id long, url string, html string, host string, verdict string").repartition(3)
    got = [tuple(r) for r in url_filter.judge(df).collect()]
    assert sorted(got, key=repr) == sorted(brute_judge(PAGES), key=repr)
    by_page = {r[0]: r for r in got}
    assert by_page[1][4:] == ("www.example.com/en/", "allow") and by_page[2][4:] == ("example.com/en/", "block")
    assert by_page[3][3] == ["free", "bets", "example", "org"] and by_page[7][3][:2] == ["daily", "news"]
    assert by_page[6][4] is None and by_page[11][4] is None and by_page[13][1:3] == ("com", "/Path/../Up")
    assert by_page[15][3][:600] == ["free", "bets"] * 300


def test_urls_without_rules_or_rows(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert url_filter.judge(df.limit(0)).count() == 0
    none = url_filter.judge(df, rules=()).collect()
    assert len(none) == len(PAGES) and {r["verdict"] for r in none} == {"allow"}
    assert {r["verdict"] for r in url_filter.judge(df, rules=(("block", "com/"),)).where("rule is null").collect()} == {"allow"}  # one class only


# Phrases


def brute_phrases(docs, least, top, most=4, share=80):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in some.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        rows = []
        for p, a in some.items():
            if 100 * inside[p] >= share * a:
                continue
            cuts = [(2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = np.array(["the", "New", "York", "of", "é", "漢字", "a-b", "x", "tab\tbed", "end.", "stop;", "line\nbreak", "q?"])
    docs = [(["en", "de", None, "und"][i % 4], "  ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(120)]
    docs += [("en", None), ("en", ""), (None, " \t.\n"), ("fr", "one two " * 5), ("en", "New York City " * 40), ("en", "w" * 9000 + " new york")]
    docs += [("en", " ".join(rng.choice(["a", "b", "c"], 5000)))] + [docs[0]] * 20  # a long text without any end of a piece; repeated rows
    return docs


@pytest.mark.parametrize("kw", [{}, {"bits": 10}, {"block": 500}, {"bits": 3, "block": 2000}])
def test_phrases_are_those_of_brute_force(spark, kw):
    """bits cuts the fingerprints, so that nearly all collide; block makes many blocks and cuts long pieces."""
    docs = corpus()
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n long, phrase string").repartition(3)
    got = [tuple(r) for r in phrases.collocations(df, least=5, top=40, **kw).collect()]
    want = [(lang, rank, p, a, left, right, n, s) for lang, rank, p, a, left, right, n, s in brute_phrases(docs, 5, 40)]
    assert sorted(got, key=repr) == want and len(want) > 60
    assert phrases.collocations(df.limit(0), **kw).count() == 0


def test_cut_texts_lose_no_word():
    rng = np.random.default_rng(5)
    count = lambda t, own: sum(m.start() < own for m in re.finditer(rb"[^ \t.,;:!?\n\x0b\x0c\r]+", t))
    for _ in range(300):
        text = bytes(rng.choice(list(b"ab  .") if rng.random() < 0.5 else list(b"abc "), rng.integers(1, 300)))
        parts = list(phrases.cut_text(text, int(rng.integers(3, 40)), 3))
        assert sum(count(*p) for p in parts) == count(text, len(text))
        assert all(phrases.Block("x", *p).own == count(*p) for p in parts)


# Search

ITEMS = [(1, "alpha beta beta"), (2, "Common common rare7"), (3, None), (4, ""), (5, "nothing-like-it zzzz"), (6, "é漢 X9"), (7, "alpha"), (7, "rare3"), (8, " ".join(f"rare{i}" for i in range(30)) + " common alpha")]


def texts():
    rng = np.random.default_rng(6)
    docs = [(i, " ".join(rng.choice(["common", "Alpha", "beta,gamma", "é漢", "x9!", *(f"rare{k}" for k in range(30))], rng.integers(0, 40), p=[0.3, 0.2, 0.1, 0.05, 0.05] + [0.01] * 30))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, " .,\n"), (None, "common rare7 rare7"), (5, docs[5][1]), (6, "rare7 again"), (1003, "alpha beta"), (1004, "alpha beta"), (1005, "common " * 300_000 + "alpha")]
    return docs


def brute_search(docs, items, top=20):
    own = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    held = [(d, Counter(own(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    asked = defaultdict(Counter)
    for item, t in items:
        asked[item].update(own(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for d, c in held:
            m = 75 + 25 * sum(c.values()) * n // total
            s = sum(k * int(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, k in terms.items() if c[t])
            if s > 0:
                rows.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "group", "share"), [(1 << 24, 256, 8), (2000, 3, 8), (900, 2, 1000)])
def test_search_ranks_as_brute_force(spark, block, group, share):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in texts()], "doc_id long, text string, term string, block long").repartition(2)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, score long")
    index = search.build_index(docs, block)
    got = [tuple(r) for r in search.search(index, items, group=group, short_share=share).collect()]
    assert sorted(got, key=repr) == brute_search(texts(), ITEMS)
    assert search.search(index, items.limit(0)).count() == 0
    assert search.search(search.build_index(docs.limit(0)), items).count() == 0


def test_walk_skips_and_is_exact():
    """Long lists of low scores beside short ones of high scores: most postings are never read."""
    rng = np.random.default_rng(7)
    skipped = []
    for trial in range(60):
        n = int(rng.integers(1, 40_000))
        lists = []
        for share, most in [(1.0, 3), (0.7, 5), (0.3, 40), (0.02, 900), (0.005, 2000), (0.001, 2000)][: rng.integers(1, 7)]:
            docs = np.flatnonzero(rng.random(n) < share)
            if len(docs):
                lists.append((docs, rng.integers(1, most, len(docs))))
        if not lists:
            continue
        total = np.zeros(n, dtype=np.int64)
        for docs, scores in lists:
            total[docs] += scores
        want = np.lexsort((np.arange(n), -total))[:20]
        want = want[total[want] > 0]
        seen = []
        docs, scores = search.best_documents(lists, n, 20, int(rng.choice([20, n // 8 + 1])), seen)
        assert docs.tolist() == want.tolist() and scores.tolist() == total[want].tolist()
        if len(lists) == 6 and n > 20_000:
            skipped.append(seen[0][0] / seen[0][1])
    assert skipped and np.mean(skipped) < 0.5


def test_sent_fingerprints_compress():
    """What a block sends comes back as it was, and is less than half of its 16 bytes a fingerprint once compressed."""
    import numpy as np
    import pyarrow as pa

    from noveltide.llm import phrases

    rng = np.random.default_rng(5)
    text = b" ".join(b"w%d" % x for x in rng.integers(0, 40_000, 60_000))
    block = phrases.Block("en", text, len(text), phrases.BITS)
    grams = [(n, *block.grams(n)) for n in (1, 2)]
    sent = phrases._sent(7, grams, 16)
    got = phrases.of_planes(sent["fps"].to_pylist(), "<u8")
    assert got.tolist() == sorted(set(np.concatenate([g[2] for g in grams]).tolist()))
    assert phrases.of_planes(sent["counts"].to_pylist(), "<u4").sum() == sum(len(g[1]) for g in grams)
    blobs = [x for c in ("fps", "counts", "places") for x in sent[c].to_pylist()]
    packed = sum(len(pa.Codec("lz4_raw").compress(x)) for x in blobs)
    assert packed < 8 * len(got)


def test_found_phrases_move_a_row_a_bucket():
    """A block's phrases go compressed, and not a row each; their counts are those of the text (op12_phrases)."""
    rng = np.random.default_rng(12)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    text = " ".join(rng.choice(words, 20_000)).encode()
    table = pa.table({"block": [1], "lang": ["en"], "own": [len(text)], "text": pa.array([text], pa.binary())})
    sent = phrases._short(8, 40)(table)
    known = pa.concat_tables([phrases._frequent(1)(sent.slice(i, 1)) for i in range(sent.num_rows)])
    moved = phrases._materialise(40, 2, 8)(table, known)
    got = {(r["n"], r["phrase"]): r["f"] for r in phrases._summed(1)(moved).to_pylist()}
    split = text.decode().split()
    want = Counter([(0, "")] * len(split) + [(1, w) for w in split] + [(2, " ".join(p)) for p in zip(split, split[1:])])
    assert got == want
    assert moved.num_rows == 8 and moved.nbytes < 0.75 * sum(len(p) + 12 for _, p in got)
