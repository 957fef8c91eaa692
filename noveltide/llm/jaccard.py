"""N-gram Jaccard join by a token-group matrix.

A document is its set of word shingles. Two sets at or above the threshold differ in at most D elements, where D
follows from their sizes; when the elements are dealt by hash into more than D parts, some part is the same in both.
The hashes of the parts are the tokens of the matrix: one for about nine shingles, and a text that merely holds a
common passage shares none of them. Documents with a shared token are put into groups of similar ones (those with the
same smallest shared token, split by hash when there are many), a group stores the union of its tokens, and a group
is opened for a document only if they share a token. First its sketch is compared with those of the members: parities of
its shingles' buckets, a bit for each shingle or less, whose differences are never more than those of the sets. Only sets
that a sketch leaves a partner move, and they are compared if their overlap with the union of the group's shingles still
allows the threshold.

Equal sets are one node from the start. Groups are opened in two rounds: first, for each node, the largest group of
each of its tokens, which joins large families with few openings; then the nodes with a token whose nodes are still in
different components are put into larger groups, which are opened for each node outside that shares such a token with a
node of another component in them. No link that could join different components is left out, and none is assumed.

Defined cases: null or empty text, or text without words, has no set and links with nothing. A null doc_id links with
nothing and is its own component (null). Repeated rows are equal sets. Hashes of shingles and sets have 64 bits and
are taken as the things themselves. An empty table gives an empty table. Extra columns are not read. A text is read
whole at any length; its set is one row of eight bytes a shingle. A similarity of exactly the threshold links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, as_bytes, components, forget, map_arrow, mix, saved, shingle_hashes

GROUP = 128
#: Pairs of places, and words of sketches, that a task holds at once.
PAIRS, SKETCH_WORDS = 1 << 18, 1 << 20
#: Shingles of the members of a group, and of the nodes in a chunk, that a task should not much exceed.
GROUP_SHINGLES = 2_000_000
RATIO = 1.4
#: Bits of the filter that spares the shuffle most texts without a partner (4 MB at any size of the input).
FILTER_BITS = 1 << 25
#: Bits that bitmap_construct_agg holds in a row.
BITMAP_BITS = 1 << 15


def size_classes(most: int = 1 << 40) -> np.ndarray:
    """Bounds of the size classes; partners are in the same class or the one below (for thresholds of 72 % and more)."""
    bounds = [1]
    while bounds[-1] < most:
        bounds.append(max(bounds[-1] + 1, int(np.ceil(bounds[-1] * RATIO))))
    return np.array(bounds, dtype=np.int64)


CLASSES = size_classes()


def shingle_set(text: bytes, width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(hashes.of(text.lower().split()), width))


def set_key(shingles: np.ndarray) -> int:
    return int(mix(np.array([int(mix(shingles).sum()) + len(shingles) & 0xFFFFFFFFFFFFFFFF], dtype=U64))[0])


def part_tokens(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The matrix tokens of a set: hashes of its parts, for its size class and the one below where a partner could be."""
    n = len(shingles)
    own = int(np.searchsorted(CLASSES, n, side="right")) - 1
    out = []
    for c in (own, own - 1):
        if c < 0 or c < own and percent * n > 100 * (int(CLASSES[c + 1]) - 1):
            continue
        top = int(CLASSES[c + 1]) - 1
        most = (100 - percent) * (top + top * 100 // percent) // (100 + percent)  # elements in which two sets may differ
        if most == 0:
            continue  # only equal sets
        mean = top / RATIO / most  # shingles of a part in the smallest sets of the class
        spare = 0 if most < 4 else 2 + int(most * max(1 / 16, 1.3 * (1 + mean) * np.exp(-mean)))
        parts = most + 1 + spare
        salted = mix(shingles ^ U64(c + 1))
        part = (salted % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=parts)
        used = np.flatnonzero(counts)
        sums = np.zeros(parts, dtype=U64)
        starts = (np.cumsum(counts) - counts)[used]
        sums[used] = np.add.reduceat(mix(salted)[order], starts)
        keys = mix(sums ^ mix(np.arange(parts, dtype=U64) + U64((c + 1) << 32)))
        # spare + 1 parts at least are the same in partners, so up to spare small ones, which many sets share, can be left
        # out; where two sets leave out up to different counts, the larger bound still drops no more than spare
        least = max(k for k in range(4) if (counts < k).sum() <= spare)
        out.append(keys[counts >= least])
    return np.concatenate(out) if out else np.zeros(0, dtype=U64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Words of parity bits: whether an odd number of shingles falls into each of 2^k buckets, at least as many as shingles."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles ^ U64(0x5DEECE66D)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches, a row each, as they are with fewer buckets."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, node, tokens, sketch) of every row; node is null where nothing can link."""
    hashes = WordHashes()

    def run(part):
        sizes, nodes, tokens, lengths, sketches = [], [], [], [0], []
        for doc, text in zip(part["doc_id"].to_pylist(), as_bytes(part["text"]), strict=True):
            s = shingle_set(text, width, hashes)
            sizes.append(len(s))
            if len(s) and doc is not None:
                nodes.append(set_key(s) - (1 << 63))
                tokens.append(part_tokens(s, percent))
                lengths.append(lengths[-1] + len(tokens[-1]))
                sketches.append(sketch(s).tobytes() if len(tokens[-1]) else None)
            else:
                nodes.append(None)
                sketches.append(None)
                lengths.append(lengths[-1])
        flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, dtype=np.int64)
        lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat))
        return part["doc_id"], part["text_key"], pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), lists, pa.array(sketches, pa.binary())

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return map_arrow(rows, run, "doc_id long, text_key long, n_shingles long, node long, tokens array<long>, sketch binary")


def ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """start[0], ..., stop[0] - 1, start[1], ..."""
    count = stop - start
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


def blocks(count: np.ndarray, most: int):
    """Slices of rows with about `most` in all of their counts."""
    if len(count):
        at = np.flatnonzero(np.diff((np.cumsum(count) - count) // most, prepend=-1))
        yield from (slice(i, j) for i, j in zip(at, [*at[1:], len(count)], strict=True))


def sift(rows: pa.Table, percent: int) -> np.ndarray:
    """The rows (grp, chunk, side, asks, n, part, sketch) of whole groups that sketches and sizes leave a link to another part."""
    grp, chunk, side, asks, n, part = (rows[c].to_numpy() for c in ("grp", "chunk", "side", "asks", "n", "part"))
    stays, order = np.zeros(len(grp), dtype=bool), np.lexsort((chunk, grp))
    fresh = np.append(True, (np.diff(grp[order]) != 0) | (np.diff(chunk[order]) != 0))[: len(grp)]
    place = np.empty(len(grp), dtype=np.int64)
    place[order] = np.cumsum(fresh)
    left, right = order[side[order] == 0], order[asks[order]]
    start, stop = (np.searchsorted(place[right], place[left], side=s) for s in ("left", "right"))
    texts = rows["sketch"].to_pylist()
    words = np.array([len(x) // 8 for x in texts], dtype=np.int64)
    of, spot = {}, np.zeros(len(grp), dtype=np.int64)  # sketches by their words, as they are and folded once
    for wide in np.unique(words):
        at = np.flatnonzero(words == wide)
        spot[at] = np.arange(len(at))
        of[wide, wide] = np.frombuffer(b"".join(texts[i] for i in at), dtype=U64).reshape(len(at), -1)
        of[wide, wide // 2] = folded(of[wide, wide], max(1, wide // 2))
    for some in blocks(stop - start, PAIRS):
        i, j = np.repeat(left[some], (stop - start)[some]), right[ranges(start[some], stop[some])]
        may = (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[may], j[may]
        for wide in np.unique(words[i]):
            for other in (wide // 2, wide, 2 * wide):  # partners' sizes are less than twice apart
                both = np.flatnonzero((words[i] == wide) & (words[j] == other))
                few = min(wide, other)
                for k in range(0, len(both), most := max(1, SKETCH_WORDS // int(wide))):
                    u, v = i[both[k : k + most]], j[both[k : k + most]]
                    apart = np.bitwise_count(of[wide, few][spot[u]] ^ of[other, few][spot[v]]).sum(axis=1, dtype=np.int64)
                    near = (100 + percent) * apart <= (100 - percent) * (n[u] + n[v])
                    stays[u[near]] = stays[v[near]] = True
    return stays


def open_group(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges between the members of a group (side 0) and the nodes that ask for it: a forest over the links found."""
    sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["shingles"]]
    nodes, side = pdf["node"].to_numpy(), pdf["side"].to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(pdf["asks"].to_numpy())
    if not len(left) or not len(right) or len(set(nodes)) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    size = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[i] for i in left])
    owner = np.repeat(np.arange(len(left)), size[left])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    low, high = size[left].min(), size[left].max()
    head = np.unique(nodes, return_inverse=True)[1]  # equal where edges join nodes
    edges = []
    for q in right:
        n = size[q]
        if 100 * n < percent * low or percent * n > 100 * high:
            continue
        a = np.searchsorted(flat, sets[q], side="left")
        b = np.searchsorted(flat, sets[q], side="right")
        hits = b - a
        if 100 * np.count_nonzero(hits) < percent * n:  # the bound by the group's union
            continue
        at = np.repeat(a - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        both = np.bincount(owner[at], minlength=len(left))
        linked = 100 * both >= percent * (size[left] + n - both)
        apart = left[linked][head[left[linked]] != head[q]]
        if len(apart):
            own, first = np.unique(head[apart], return_index=True)
            edges += [(nodes[i], nodes[q]) for i in apart[first]]
            head[np.isin(head, own)] = head[q]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, group_key) of every row: components of Jaccard similarity percent / 100.

    component_id is the smallest doc_id of the component. Where doc_ids repeat with different texts, rows are told apart
    by doc_id and text_key (xxhash64 of the text), and components by group_key (null for rows that have no set).
    """
    if not 72 <= percent <= 100:
        raise ValueError("percent must be from 72 to 100")
    whole = saved(signatures(docs, width, percent))
    found = saved(whole.drop("tokens", "sketch"))
    # equal sets are one node from here on; each has its tokens once
    many = found.where("node is not null").groupBy("node").agg(F.count("*").alias("seen")).where("seen > 1")
    own = whole.where("node is not null").select("node", "doc_id", F.col("n_shingles").alias("n"), "tokens", "sketch")
    own = _marked(own, saved(many.select("node")), "node")
    first = [F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n", "tokens", "sketch"))]
    copies = saved(own.where("_likely").groupBy("node").agg(*first))
    nodes = own.where("not _likely").drop("_likely").unionByName(copies)
    cells = nodes.select(F.explode("tokens").alias("token"), "node")
    common = saved(cells.groupBy("token").agg(F.count("*").alias("seen")).where("seen > 1").select("token"))
    matrix = saved(cells.join(common, "token"))  # tokens of at least two different sets
    forget(common)
    anchor = matrix.groupBy("node").agg(F.min("token").alias("anchor"))
    holder = saved(nodes.select("node", "doc_id", "n", "sketch").join(anchor, "node"))
    forget(whole)
    forget(copies)
    groups = saved(_groups(holder.select("node", "n", "anchor"), GROUP))

    def sets_of(near: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in near; only their texts are read into sets, and shuffled, once."""
        ids = saved(near.select("node").distinct().join(holder.select("node", "doc_id"), "node"))
        texts = _marked(docs.select(F.col("doc_id").cast("long"), "text"), ids, "doc_id").where("_likely").select("text")
        hashes = WordHashes()

        def run(part):
            sets = [shingle_set(t, width, hashes) for t in as_bytes(part["text"])]
            return pa.array([set_key(s) - (1 << 63) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())

        sets = map_arrow(texts, run, "node long, shingles binary")
        sets = saved(sets.join(ids.select("node"), "node").dropDuplicates(["node"]))
        forget(ids)
        return sets

    held = saved(matrix.join(groups.drop("n"), "node"))
    forget(matrix)
    # the group with most tokens stands first: a family then meets in one group and not in one for each token
    width_of = held.groupBy("grp").agg(F.count_distinct("token").alias("width"))
    first = held.select("token", "grp").distinct().join(width_of, "grp").groupBy("token").agg(F.max(F.struct("width", "grp")).alias("top"))
    star = held.select("token", "node").join(first, "token").select(F.col("top.grp").alias("grp"), "node")
    asked = saved(star.distinct().join(groups.select("grp", "node"), ["grp", "node"], "left_anti"))
    alone = holder.select("node", "n", "sketch", F.col("node").alias("part"))
    edges = _links(sets_of, alone, groups, asked, percent, 4 * GROUP)
    forget(asked)
    parts = components(edges)
    # round two: tokens whose nodes are still in different components, in groups by the commonest such token of a node
    state = held.select("token", "node").join(parts.withColumnRenamed("id", "node"), "node", "left")
    state = state.select("token", "node", F.coalesce("component_id", "node").alias("part"))
    joined = holder.join(parts.withColumnRenamed("id", "node"), "node", "left")
    joined = saved(joined.select("node", "n", "sketch", F.coalesce("component_id", "node").alias("part")))
    mixed = state.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("seen")).where("low <> high")
    state = saved(state.join(mixed.select("token", "seen"), "token"))
    forget(held)
    forget(parts)
    home = state.groupBy("node").agg(F.max(F.struct("seen", "token")).alias("top")).join(groups.select("node", "n"), "node")
    first_groups, groups = groups, saved(_groups(home.select("node", "n", F.col("top.token").alias("anchor")), 16 * GROUP))
    forget(first_groups)
    placed = saved(state.select("token", "node", "part").join(groups.select("node", "grp"), "node"))
    forget(state)
    wish = saved(_wishes(placed))
    forget(placed)
    # of two groups the one with fewer such nodes sends them to the other
    cost = wish.groupBy("home", "grp").agg(F.count("*").alias("cost"))
    back = cost.select(F.col("grp").alias("home"), F.col("home").alias("grp"), F.col("cost").alias("back"))
    way = cost.join(back, ["home", "grp"]).where("cost < back or cost = back and home < grp").select("home", "grp")
    more = saved(wish.join(way, ["home", "grp"]).select("grp", "node"))
    forget(wish)
    later = _links(sets_of, joined, groups, more, percent, 8 * GROUP)
    for spent in (joined, holder, more, groups):
        forget(spent)
    parts = components(edges.union(later))
    forget(edges)
    forget(later)
    nodes = found.join(parts.withColumnRenamed("id", "node"), "node", "left")
    nodes = nodes.withColumn("part", F.coalesce("component_id", "node")).drop("component_id")
    least = nodes.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"))
    nodes = nodes.join(least, "part", "left")
    return nodes.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "text_key", F.col("part").alias("group_key"))


def _marked(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """rows with _likely: true where held has the key (and on few others), by a bitmap of hashed keys.

    The bitmap has FILTER_BITS bits at most and lets all keys of held pass, so a join still has to follow.
    """
    spot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    bits = held.select(spot.alias("_spot")).groupBy(F.shiftright("_spot", 15).alias("_row"))
    bits = bits.agg(F.bitmap_construct_agg(F.col("_spot") % BITMAP_BITS).alias("_bits"))
    found = rows.withColumn("_spot", spot).withColumn("_row", F.shiftright("_spot", 15)).join(F.broadcast(bits), "_row", "left")
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast(_spot % {BITMAP_BITS} div 8 + 1 as int), 1)")), 16, 10).cast("int")
    likely = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(_spot % 8 as int))")) != 0, F.lit(False))
    return found.select(*rows.columns, likely.alias("_likely"))


def _tasks(df: DataFrame) -> int:
    """Tasks for few bytes that are much work: with a number of our own they are not merged into fewer."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _wishes(placed: DataFrame) -> DataFrame:
    """(home, grp, node): groups other than its own (home) in which a node of placed (token, node, part, grp) shares a token with another part.

    Pairs of groups are listed for each token they share; nodes meet them where all of a home is, so each node and group leaves a task once.
    """
    spans = placed.groupBy("token", "grp").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    alike = (F.col("low") == F.col("high")) & (F.col("home_low") == F.col("low")) & (F.col("home_high") == F.col("low"))
    pairs = spans.toDF("token", "home", "home_low", "home_high").join(spans, "token").where((F.col("home") != F.col("grp")) & ~alike)
    deal = F.pmod(F.xxhash64("home"), F.lit(_tasks(placed))).alias("deal")
    own = placed.select("token", "node", "part", F.col("grp").alias("home")).select(deal, "token", "node", "part", "home").toDF("deal", "token", "node", "part", "home")
    pairs = pairs.select(deal, "home", "token", "grp", "low", "high").toDF("deal", "home", "token", "grp", "low", "high")
    own, pairs = (x.repartition(_tasks(placed), "deal") for x in (own, pairs))

    def wishes(own: pa.Table, met: pa.Table) -> pa.Table:
        homes, tokens = (np.unique(own[c].to_numpy()) for c in ("home", "token"))  # every pair's home has its token
        key = lambda x: np.searchsorted(homes, x["home"].to_numpy()) * len(tokens) + np.searchsorted(tokens, x["token"].to_numpy())
        own = own.take(np.argsort(key(own), kind="stable"))
        met = met.take(np.lexsort((met["grp"].to_numpy(), met["home"].to_numpy())))
        start, stop = (np.searchsorted(key(own), key(met), side=s) for s in ("left", "right"))
        node, part = own["node"].to_numpy(), own["part"].to_numpy()
        home, grp, low, high = (met[c].to_numpy() for c in ("home", "grp", "low", "high"))
        out = [np.zeros((0, 3), dtype=np.int64)]
        for some in blocks(stop - start, PAIRS):
            pair = np.repeat(np.arange(len(home))[some], (stop - start)[some])
            at = ranges(start[some], stop[some])
            apart = (part[at] != low[pair]) | (part[at] != high[pair])
            pair, at = pair[apart], at[apart]
            out.append(np.unique(np.column_stack([home[pair], grp[pair], node[at]]), axis=0))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"home": found[:, 0], "grp": found[:, 1], "node": found[:, 2]})

    return own.groupBy("deal").cogroup(pairs.groupBy("deal")).applyInArrow(wishes, "home long, grp long, node long")


def _groups(anchored: DataFrame, most: int) -> DataFrame:
    """(node, n, grp) of nodes (node, n, anchor): those with the same anchor, split by hash beyond `most` or a size."""
    parts = F.ceil(F.greatest(F.count("*") / F.lit(most), F.sum("n") / F.lit(GROUP_SHINGLES)))
    splits = anchored.groupBy("anchor").agg(parts.alias("splits"))
    return anchored.join(splits, "anchor").select("node", "n", F.xxhash64("anchor", F.pmod(F.xxhash64("node"), F.col("splits"))).alias("grp"))


def _links(sets_of, held: DataFrame, groups: DataFrame, asked: DataFrame, percent: int, chunk: int) -> DataFrame:
    """Edges (a, b) between nodes: a group (node, n, grp) is opened for its members and for those that ask for it (grp, node).

    The nodes that a group is opened for are dealt into chunks of about `chunk` nodes and bounded size, and its members go once to
    each chunk, so a hub of thousands of nodes is many tasks and its members are repeated little. Only narrow rows are
    dealt; the sketches of held (node, n, sketch, part) then meet their places, and of the places that these leave each
    takes its set in one join.
    """
    every = asked.join(groups.select("node", "n"), "node").select("grp", "n").union(groups.select("grp", "n"))
    chunks = every.groupBy("grp").agg(F.count("*").alias("seen"), F.ceil(F.greatest(F.count("*") / F.lit(chunk), F.sum("n") / F.lit(GROUP_SHINGLES))).cast("int").alias("chunks"))
    chunks = chunks.where("seen > 1").drop("seen")
    place = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")
    members = groups.select("grp", "node").join(chunks, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), place.alias("own"), "node")
    members = members.select("grp", "chunk", F.lit(0).alias("side"), (F.col("chunk") == F.col("own")).alias("asks"), "node")
    others = asked.join(chunks, "grp").select("grp", place.alias("chunk"), F.lit(1).alias("side"), F.lit(True).alias("asks"), "node")
    rows = members.union(others).join(held, "node")
    rows = rows.repartition(_tasks(rows), "grp", "chunk")
    names = ["grp", "chunk", "side", "asks", "node"]

    def sifted(batches):
        batches = list(batches)
        if batches:
            whole = pa.Table.from_batches(batches)
            yield from whole.select(names).filter(pa.array(sift(whole, percent))).to_batches()

    near = saved(rows.mapInArrow(sifted, "grp long, chunk int, side int, asks boolean, node long"))
    sets = sets_of(near)
    edges = saved(near.join(sets, "node").groupBy("grp", "chunk").applyInPandas(lambda pdf: open_group(pdf, percent), "a long, b long"))
    forget(near)
    forget(sets)
    return edges
