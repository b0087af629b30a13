"""Near-duplicates by ProbMinHash: weighted 5-word shingles, banding, exact verification, components."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import components, cut, whole_groups, width

TOKEN = re.compile(r"\w+")
SHINGLE, THRESHOLD = 5, 0.8
#: 20 bands of 5 registers find a pair of similarity 0.8 with probability 0.9996, and of 0.85 with 0.99999.
BANDS, ROWS = 20, 5
#: Of 100 registers 80 agree on average at similarity 0.8; fewer than 60 do in one pair of a million.
LEAST_AGREEING = 60
WORDS_KEPT, SHINGLES_AT_ONCE, TILE = 500_000, 400_000, 2048
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * M2
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, kept between texts."""

    def __missing__(self, word: str) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, text: str | None) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        found = TOKEN.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words; a shorter text is one shingle, a text without words none."""
    n = len(words) - k + 1
    if len(words) == 0:
        return words
    with np.errstate(over="ignore"):
        if n < 1:
            out = np.full(1, len(words), np.uint64)
            for w in words:
                out = mixed(out * M1 + w)
            return out
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = mixed(out * M1 + words[i : i + n])
    return out


def prob_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures of n weighted sets at once: m registers each, which hold the element of the earliest arrival.

    Every element has a Poisson process with its weight as rate; each of its arrivals falls into a random
    register. An element stops once it is later than the latest register of its set, as no further arrival
    of it can matter. Two sets agree in a register with the probability Jaccard similarity.
    """
    first = np.full(n * m, np.inf)
    owner = np.zeros(n * m, np.uint32)
    t = np.zeros(len(elements))
    base = doc.astype(np.int64) * m
    name = (mixed(elements ^ M1) >> np.uint64(32)).astype(np.uint32)
    live, turn = np.arange(len(elements)), 0
    while len(live):
        turn += 1
        with np.errstate(over="ignore"):
            u = mixed(elements[live] + np.uint64(2 * turn) * M1)
            v = mixed(u + M1)
        t[live] -= np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        at = base[live] + (v % np.uint64(m)).astype(np.int64)
        now = t[live]
        np.minimum.at(first, at, now)
        won = first[at] == now
        owner[at[won]] = name[live[won]]
        docs = np.unique(doc[live]) if turn > 8 else np.arange(n)
        latest = np.zeros(n)
        latest[docs] = first.reshape(n, m)[docs].max(1)
        live = live[now < latest[doc[live]]]
    return owner.reshape(n, m)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(signatures), bands), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(rows):
            out = mixed(out * M1 + signatures[:, i::rows][:, :bands].astype(np.uint64) + np.uint64(1))
    return out.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        done: dict[int, int] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            i = 0
            while i < len(texts):
                sets, nodes, start, total = [], [], i, 0
                while i < len(texts) and total < SHINGLES_AT_ONCE:
                    w = words.of(texts[i])
                    nodes.append(xxhash.xxh3_64_intdigest(w.tobytes()) if len(w) else None)
                    fresh = len(w) > 0 and nodes[-1] not in done  # a copy of a text of this task needs no signature of its own
                    if fresh:
                        done[nodes[-1]] = 1
                    sets.append(shingles(w) if fresh else w[:0])
                    total += len(sets[-1])
                    i += 1
                if len(done) > WORDS_KEPT:
                    done = {}
                new = [k for k, s in enumerate(sets) if len(s)]
                signed = [None] * len(sets)
                keys = [None] * len(sets)
                if new:
                    doc = np.repeat(np.arange(len(new)), [len(sets[k]) for k in new])
                    e = np.concatenate([sets[k] for k in new])
                    order = np.lexsort((e, doc))
                    e, doc = e[order], doc[order]
                    starts = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (doc[1:] != doc[:-1])])
                    weights = np.diff(np.r_[starts, len(e)]).astype(float)
                    sig = prob_minhash(e[starts], weights, doc[starts], len(new), bands * rows)
                    for k, s, b in zip(new, sig, band_keys(sig, bands, rows), strict=True):
                        signed[k], keys[k] = s.tobytes(), b
                node = pa.array([None if x is None else x - (1 << 64) if x >> 63 else x for x in nodes], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, i - start), batch.column("mark").slice(start, i - start), node, pa.array(keys, pa.list_(pa.int64())), pa.array(signed, pa.binary())], ["id", "mark", "node", "keys", "sig"])

    return run


def prob_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Probability Jaccard similarity of two multisets of hashes, exactly."""
    ea, wa = np.unique(a, return_counts=True)
    eb, wb = np.unique(b, return_counts=True)
    if not len(ea) or not len(eb):
        return 0.0
    e = np.union1d(ea, eb)
    x, y = np.zeros(len(e)), np.zeros(len(e))
    x[np.searchsorted(e, ea)], y[np.searchsorted(e, eb)] = wa, wb
    with np.errstate(divide="ignore"):
        r = y / x
    order = np.argsort(r, kind="stable")
    x, y, r = x[order], y[order], r[order]
    both = (x > 0) & (y > 0)
    # for element d: sum of max(x'/x, y'/y); those with a ratio up to d's count by x, the others by y
    upto = np.searchsorted(r, r[both], side="right")
    cx, cy = np.r_[0, x.cumsum()], np.r_[0, y.cumsum()]
    return float((1 / (cx[upto] / x[both] + (cy[-1] - cy[upto]) / y[both])).sum())


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            keep = []
            last, mine = None, None
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True):
                if a != last:
                    last, mine = a, shingles(words.of(x.as_py()))
                keep.append(prob_jaccard(mine, shingles(words.of(y.as_py()))) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    for t in whole_groups(batches, ["key", "tile"]):
        key, tile = t.column("key").to_numpy(), t.column("tile").to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])])
        for i, j in zip(starts, np.r_[starts[1:], len(key)], strict=True):
            yield t.slice(i, j - i)


def _across(t: pa.Table, rows: int, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of a tile with the rows of other components that it is to be compared with: those whose signature
    agrees in at least `least` registers, if the tile's band is the first that the two share."""
    node, comp, side, band = (t.column(c).to_numpy() for c in ("node", "comp", "side", "band"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(t.num_rows, -1)
    for k in range(t.num_rows):
        other = np.flatnonzero((comp != comp[k]) & ((side > side[k]) if side.any() else (node > node[k])))
        if len(other):
            same = sig[other] == sig[k]
            ok = same.sum(1) >= least
            other, same = other[ok], same[ok]
            yield k, other[same.reshape(len(other), sig.shape[1] // rows, rows).all(2).argmax(1) == band[k]]


def _flagged(rows: int, least: int):
    """The nodes of each tile that have something to be compared with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches):
            mark = np.zeros(t.num_rows, bool)
            for k, other in _across(t, rows, least):
                mark[other] = True
                mark[k] |= len(other) > 0
            yield from t.filter(pa.array(mark)).combine_chunks().to_batches()

    return run


def _linked(rows: int, least: int, threshold: float):
    """The links across components in each tile, verified on the texts. Overlaps come from an inverted index of the
    tile's shingles; they give the similarity at once where no shingle is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for t in _tiles(batches):
            n = t.num_rows
            sets = [shingles(words.of(x)) for x in t.column("text").to_pylist()]
            single = [np.unique(x) for x in sets]
            sizes = np.array([len(x) for x in single])
            plain = sizes == np.array([len(x) for x in sets])
            every, ids = np.unique(np.concatenate(single), return_inverse=True)
            holder = np.repeat(np.arange(n), sizes)[np.argsort(ids, kind="stable")]
            starts = np.r_[0, np.bincount(ids, minlength=len(every)).cumsum()]
            own = np.split(ids, sizes.cumsum()[:-1])
            node = t.column("node").to_numpy()
            a, b = [], []
            for k, other in _across(t, rows, least):
                if not len(other):
                    continue
                shared = np.bincount(np.concatenate([holder[starts[i] : starts[i + 1]] for i in own[k]]), minlength=n)[other]
                alike = shared / (sizes[k] + sizes[other] - shared)
                hit = [x for x, j in zip(other, alike, strict=True) if (j >= threshold if plain[k] and plain[x] else prob_jaccard(sets[k], sets[x]) >= threshold)]
                a += [node[k]] * len(hit)
                b += node[hit].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, leader_rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, component, class_id) for every row of docs; mark is the xxhash64 of the text.

    Words are runs of \\w in the lower-cased text; weights are how often a 5-word shingle occurs. Texts with
    equal words are copies: one node. Nodes that share a band are candidates; pairs verified at probability
    Jaccard >= threshold are links; a class is what links reach, named by its smallest id.

    In each bucket, every member is first compared with one member that a hash picks, a different one for
    each band and round. Buckets whose members then still lie in more than one component are compared across
    components inside tiles of bounded size, each pair in the first band that it shares, with pairs dropped
    only where the signatures rule the threshold out; a tile puts out its links alone. So no bucket is expanded
    into its pairs, and no link between components is lost.

    A null or empty text, or one without words, is like no other and forms its own class. Rows that repeat
    an id have the class of their own text. Empty tables give empty results.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = cut(src.mapInArrow(_sign(bands, rows), f"id {src.schema['id'].dataType.simpleString()}, mark long, node long, keys array<long>, sig binary"), "signatures")
    nodes = cut(signed.where("sig is not null").select("node", "keys", "sig").dropDuplicates(["node"]), "nodes")
    buckets = nodes.select("node", F.posexplode("keys").alias("band", "hash")).select("node", "band", F.xxhash64("band", "hash").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key")
    buckets = cut(buckets.join(shared, "key"), "buckets")
    members = buckets.select("node").distinct()
    ids = signed.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "mark")).alias("x")).select("node", "x.id", "x.mark")
    holders = members.join(ids, "node").select("node", F.col("id").alias("h_id"), F.col("mark").alias("h_mark")).hint("shuffle_hash")
    texts = src.join(holders, F.col("id").eqNullSafe(F.col("h_id")) & (F.col("mark") == F.col("h_mark"))).select("node", "text")
    texts = cut(texts.dropDuplicates(["node"]), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(b, "b").join(a, "a").repartition(width(spark), F.xxhash64("a", "b"))
        return cut(both.mapInArrow(_verify(threshold), "a long, b long"), "links")

    def split_buckets(turn: int) -> tuple[DataFrame, DataFrame]:
        """Members with their components, and the buckets whose members lie in several, each with a leader."""
        inside = buckets.withColumn("comp", F.col("node")) if comps is None else buckets.join(comps, "node", "left").select("node", "band", "key", F.coalesce("component", "node").alias("comp"))
        leader = F.min(F.struct(F.xxhash64("key", "node", F.lit(turn)).alias("h"), F.col("node").alias("leader"), F.col("comp").alias("leader_comp"))).alias("x")
        return inside, inside.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"), leader).where("lo <> hi")

    links, comps, tried = None, None, None
    for turn in range(leader_rounds):
        inside, split = split_buckets(turn)
        pairs = inside.join(split.select("key", "x.leader", "x.leader_comp"), "key").where("comp <> leader_comp").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        found = verified(pairs)
        links = found if links is None else links.union(found)
        comps = cut(components(links).withColumnRenamed("id", "node"), "classes")

    inside, split = split_buckets(leader_rounds)
    tiled = inside.join(split.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks")), "key").join(nodes.select("node", "sig"), "node")
    tiled = tiled.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")
    tiled = tiled.select("key", tile.alias("tile"), "band", "node", "comp", (F.col("mine") > F.col("other")).cast("int").alias("side"), "sig")
    in_tiles = lambda df: df.repartition(width(spark), "key", "tile").sortWithinPartitions("key", "tile")
    flagged = cut(in_tiles(tiled).mapInArrow(_flagged(rows, LEAST_AGREEING), tiled.schema), "flagged")
    rest = in_tiles(flagged.join(texts, "node").select(*flagged.columns, "text")).mapInArrow(_linked(rows, LEAST_AGREEING, threshold), "a long, b long")
    comps = cut(components(links.union(cut(rest, "links"))).withColumnRenamed("id", "node"), "classes")
    named = ids.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    label = named.groupBy("component").agg(F.min("id").alias("class_id"))
    classes = cut(named.join(label, "component").select(F.col("node").alias("of"), "component", "class_id"), "classes")
    out = signed.select("id", "mark", "node").join(classes, F.col("node") == F.col("of"), "left")
    return out.select("id", "mark", "component", F.coalesce("class_id", "id").alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay when each class keeps the text of its smallest id.

    Documents without words all stay, null and empty texts included. Rows that repeat both id and text are one
    document and stay once: of rows that differ elsewhere the one of the smallest digest. Columns keep their names,
    whatever they are; an empty table gives an empty result.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    first = found.where("component is not null").groupBy("component").agg(F.min(F.struct("id", "mark")).alias("x")).select("x.id", "x.mark")
    stays = cut(first.union(found.where("component is null").select("id", "mark")).distinct(), "stays")
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col].cast("string")).alias("mark"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    s = stays.select(F.col("id").alias("s_id"), F.col("mark").alias("s_mark")).hint("shuffle_hash")
    kept = rows.join(s, F.col("id").eqNullSafe(F.col("s_id")) & (F.col("mark") == F.col("s_mark")), "left_semi")
    return kept.groupBy("id", "mark").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
