"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import crc_bucket, cut, unused
from epochlens.llm.neardup import M1, Words, mixed, shingles

#: A word's terms are its pieces of four characters, from its start on to its end, those after the first marked as such: the
#: first is much like a stem, in any language, and a run of a script without spaces is read to its end as well.
PIECES = re.compile(r"(?<!\w)(\w{1,4})|(\w{1,4})")
#: Labelled rows that are learned from: at most so many of each label, chosen by a hash of the id. Twice as many
#: are drawn, of which near copies count once.
EXAMPLES = 1500
#: Near copies are told by equal bands of so many MinHashes: of pairs at Jaccard 0.8, 0.88 share one, at 0.3, 0.03.
COPY_BANDS, COPY_ROWS = 4, 4
#: Texts and examples are compared by passages of at most so many terms, so that length doesn't hide a passage.
PASSAGE = 600
#: The vocabulary are all terms of at least so many examples; a term of one example can't bring two texts together.
LEAST_DF = 2
#: A term of more than this share of the documents is a stop term, unless its shares among the examples of either
#: label are so many standard errors apart.
STOP_SHARE, STOP_Z = 0.1, 3.0
NEIGHBOURS, BLOCK, FIRST_BLOCKS = 31, 64, 3
#: If more than this share of the blocks may hold a neighbour, posting lists are read whole and not block by block.
WHOLE_SHARE = 0.3
#: That is taken for granted where so many have more than this share of the largest bound, which a k-th score hardly reaches.
HOPELESS = 0.5
#: Terms of more than this share of the rows.
OFTEN = 0.1
#: Rows of the usual share of label 1 that texts without a term of the vocabulary are smoothed with.
PRIOR_ROWS = 10
#: Texts whose scores a task keeps, by digest.
SCORES_KEPT = 100_000

Sparse = tuple[np.ndarray, np.ndarray]


def terms_of(text: str | None) -> list[str]:
    return [first or "+" + later for first, later in PIECES.findall(text.lower())] if text else []


@cache
def in_words() -> np.ndarray:
    """By code point, whether it is part of words."""
    return np.array([c.isalnum() or c == "_" for c in map(chr, range(0x110000))])


def coded(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of a text in lower case, as terms_of() has them: their characters, two and two in a number, and whether they
    are a word's later pieces."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero(in_words()[points])
    each = np.arange(len(at))
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    place = each - np.maximum.accumulate(np.where(new, each, 0))
    first = np.flatnonzero(place & 3 == 0)
    size = np.append(first[1:], len(at)) - first
    points = np.append(points[at], np.zeros(3, np.uint32)).astype(np.uint64)
    one, two, three, four = (points[first + i] * (size > i) for i in range(4))
    return one << np.uint64(21) | two, three << np.uint64(21) | four, place[first] > 0


def coded_keys(one: np.ndarray, two: np.ndarray, later: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (one * M1 ^ two) * M1 + later


class Numbered:
    """The terms of texts as numbers of a vocabulary, looked up for a whole text at once by a key that is checked."""

    def __init__(self, vocabulary: list[str]):
        one, two, _ = coded(" ".join(t.lstrip("+") for t in vocabulary))
        later = np.array([t[0] == "+" for t in vocabulary], bool)
        keys = coded_keys(one, two, later)
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.one, self.two, self.later = (x[self.order] for x in (keys, one, two, later))
        if len(vocabulary) != len(np.unique(keys)):
            raise ValueError("two terms have one key")

    def of(self, text: str | None) -> np.ndarray:
        """The numbers of all terms of a text, in its order; -1 stands for those outside the vocabulary."""
        one, two, later = coded((text or "").lower())
        if not len(self.keys):
            return np.full(len(one), -1)
        keys = coded_keys(one, two, later)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        same = (self.keys[at] == keys) & (self.one[at] == one) & (self.two[at] == two) & (self.later[at] == later)
        return np.where(same, self.order[at], -1)


def passages(terms: np.ndarray) -> list[np.ndarray]:
    """Passages of at most PASSAGE terms and equal length."""
    n = -(-len(terms) // PASSAGE)
    size = -(-len(terms) // max(n, 1))
    return [terms[i * size : (i + 1) * size] for i in range(n)]


class BlockMaxIndex:
    """Posting lists of unit vectors, cut into blocks of BLOCK rows, with the largest weight of each term in each block.

    nearest() gives the exact k best by cosine: a query's products with a block's largest weights bound its cosine with
    each of the block's rows. The FIRST_BLOCKS of highest bound are scored first, of the others only those
    whose bound reaches the k-th score found; if these are many, lists are read whole.
    """

    def __init__(self, rows: list[Sparse], n_terms: int):
        self.n, self.n_blocks = len(rows), max(1, -(-len(rows) // BLOCK))
        self.lists: tuple[list, list] | None = None  # by term, made where they are read
        row = np.repeat(np.arange(self.n), [len(t) for t, _ in rows])
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in rows]])
        order = np.lexsort((row, term))
        self.rows, self.weights = row[order], np.concatenate([np.zeros(0), *[w for _, w in rows]])[order]
        #: A cell is a term in a block; its postings lie from starts[cell] to starts[cell + 1].
        cell = term[order] * self.n_blocks + row[order] // BLOCK
        self.starts = np.searchsorted(cell, np.arange(n_terms * self.n_blocks + 1))
        top = np.zeros(n_terms * self.n_blocks)
        np.maximum.at(top, cell, self.weights)
        #: Terms of many rows have their weights in all rows as well.
        size = np.diff(self.starts[:: self.n_blocks])
        often = np.flatnonzero(size > OFTEN * self.n)
        self.often_at = np.full(n_terms, -1)
        self.often_at[often] = np.arange(len(often))
        self.often = np.zeros((len(often), self.n))
        row_of = self.often_at[term[order]]
        self.often[row_of[row_of >= 0], self.rows[row_of >= 0]] = self.weights[row_of >= 0]
        #: rounded up
        self.block_max = np.nextafter(top.astype(np.float32), np.float32(np.inf)).reshape(n_terms, self.n_blocks) * (top > 0).reshape(n_terms, self.n_blocks)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"lists": None}

    def _scores(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Cosines of the rows of some blocks, summed by rising term, so that equal rows have equal ones."""
        cells = (terms[:, None] * self.n_blocks + blocks).ravel()
        first = self.starts[cells]
        size = self.starts[cells + 1] - first
        ends = size.cumsum()
        at = np.arange(ends[-1]) + np.repeat(first - ends + size, size)
        return np.bincount(self.rows[at], self.weights[at] * np.repeat(np.repeat(weights, len(blocks)), size), self.n)

    def _whole_scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines of all rows, summed row by row in one order, so that equal rows have equal ones."""
        at = self.often_at[terms]
        scores, product = np.zeros(self.n), np.empty(self.n)
        for i, w in zip(at[at >= 0].tolist(), weights[at >= 0].tolist(), strict=True):
            np.multiply(self.often[i], w, out=product)
            scores += product
        terms, weights = terms[at < 0], weights[at < 0]
        first, last = self.starts[terms * self.n_blocks], self.starts[(terms + 1) * self.n_blocks]
        if len(terms):
            if self.lists is None:
                cuts = self.starts[self.n_blocks : -1 : self.n_blocks]
                self.lists = np.split(self.rows, cuts), np.split(self.weights, cuts)
            rows, products = (np.concatenate([x[t] for t in terms.tolist()]) for x in self.lists)
            products *= np.repeat(weights, last - first)
            scores += np.bincount(rows, products, self.n)
        return scores

    def _pruned_scores(self, terms: np.ndarray, weights: np.ndarray, bounds: np.ndarray, order: np.ndarray, k: int, leave_out: np.ndarray | None) -> tuple[np.ndarray, float]:
        """Cosines of all rows that may be among the k best, and a score that these reach."""
        scores = self._scores(terms, weights, order[:FIRST_BLOCKS])
        if leave_out is not None:
            scores[leave_out] = 0
        of_first = (order[:FIRST_BLOCKS, None] * BLOCK + np.arange(BLOCK)).ravel()
        found = scores[of_first[of_first < self.n]]
        floor = np.partition(found, len(found) - k)[len(found) - k] * (1 - 1e-9) if len(found) > k else 0.0
        rest = order[FIRST_BLOCKS:]
        rest = rest[bounds[rest] >= floor]
        if len(rest) > WHOLE_SHARE * self.n_blocks:
            scores = self._whole_scores(terms, weights)
        elif len(rest):
            scores += self._scores(terms, weights, rest)
        if leave_out is not None:
            scores[leave_out] = 0
        return scores, floor

    def nearest(self, query: Sparse, k: int, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k best rows that share a term with the query and their scores, ties to the smaller row; leave_out marks rows that don't count."""
        terms, weights = query
        if not len(terms) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        bounds = weights.astype(np.float32) @ self.block_max[terms] * np.float32(1 + 1e-3)
        order = np.argsort(-bounds, kind="stable")
        many = int(WHOLE_SHARE * self.n_blocks)
        if many >= FIRST_BLOCKS and bounds[order[many]] > HOPELESS * bounds[order[0]]:
            scores, floor = self._whole_scores(terms, weights), 0.0
            if leave_out is not None:
                scores[leave_out] = 0
            if self.n > k:
                floor = np.partition(scores, self.n - k)[self.n - k]
        else:
            scores, floor = self._pruned_scores(terms, weights, bounds, order, k, leave_out)
        ids = np.flatnonzero(scores >= floor if floor > 0 else scores > 0)
        if len(ids) > k:
            ids = ids[scores[ids] >= np.partition(scores[ids], len(ids) - k)[len(ids) - k]]
        ids = ids[np.lexsort((ids, -scores[ids]))[:k]]
        return ids, scores[ids]


class ToxicityModel:
    """Passages of examples, their index, and the calibration from votes to probabilities."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, examples: list[tuple[object, str | None, int]], weights: tuple[float, float]):
        """examples: id, text, label."""
        self.terms = {t: i for i, t in enumerate(vocabulary)}
        self.numbered = Numbered(vocabulary)
        self.idf = idf
        self.kept: dict[int, tuple[float, list]] = {}
        vectors = [self.vectors(text) for _, text, _ in examples]
        rows = [(v, e) for e, vs in enumerate(vectors) for v in vs]
        often = np.bincount(np.concatenate([np.zeros(0, np.int64), *[v[0] for v, _ in rows]]), minlength=len(vocabulary))
        # alike texts meet in a block: by the commonest of their terms, which tells languages apart, then by length
        rows.sort(key=lambda x: (int(x[0][0][often[x[0][0]].argmax()]), len(x[0][0])))
        self.names = [i for i, _, _ in examples]
        self.owner = np.array([e for _, e in rows], np.int64)
        self.labels = np.array([y for _, _, y in examples], np.int64)[self.owner] if rows else np.zeros(0, np.int64)
        self.row_weight = np.array(weights)[self.labels]
        self.index = BlockMaxIndex([v for v, _ in rows], len(vocabulary))
        total = sum(weights[y] for _, _, y in examples)
        self.prior = sum(weights[1] for _, _, y in examples if y) / total if total else 0.0
        none = [y for (_, _, y), v in zip(examples, vectors, strict=True) if not v]
        # no term to compare: the share among the examples of that kind
        self.empty = (sum(weights[1] for y in none if y) + PRIOR_ROWS * self.prior) / (sum(weights[y] for y in none) + PRIOR_ROWS) if total else 0.0
        known = [(self.votes(vs, self.owner == e)[0], examples[e][2]) for e, vs in enumerate(vectors) if vs]
        y = np.array([label for _, label in known], np.int64)
        self.steps, self.levels = self.isotonic(np.array([v for v, _ in known]), y, np.array(weights)[y])

    def vectors(self, text: str | None) -> list[Sparse]:
        """Unit TF-IDF vectors of the text's passages that have a term of the vocabulary, their terms rising."""
        out = []
        for part in passages(self.numbered.of(text)):
            part = np.sort(part[part >= 0])
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
            terms, n = part[at], np.diff(at, append=len(part))
            v = n * self.idf[terms]
            terms, v = terms[v > 0], v[v > 0]
            if len(v):
                out.append((terms, v / np.sqrt((v * v).sum())))
        return out

    def votes(self, vectors: list[Sparse], leave_out: np.ndarray | None = None) -> tuple[float, np.ndarray]:
        """The largest vote of a text's passages and its nearest rows: the share of label 1 among the nearest, weighted by
        squared cosine, with the prior as one more."""
        best, rows = -1.0, np.zeros(0, np.int64)
        for v in vectors:
            ids, s = self.index.nearest(v, NEIGHBOURS, leave_out)
            w = s * s * self.row_weight[ids]
            vote = float(((w * self.labels[ids]).sum() + self.prior) / (w.sum() + 1))
            if len(ids) and vote > best:
                best, rows = vote, ids
        return (best, rows) if len(rows) else (self.prior, rows)

    @staticmethod
    def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pooled adjacent violators: the non-decreasing step function of least squared error."""
        pools: list[list[float]] = []
        for i in np.argsort(x, kind="stable"):
            pools.append([x[i], w[i] * y[i], w[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, a, b = pools.pop()
                pools[-1][1] += a
                pools[-1][2] += b
        return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])

    def score(self, text: str | None) -> tuple[float, list]:
        key = xxhash.xxh3_128_intdigest((text or "").encode("utf-8", "surrogatepass"))
        if key not in self.kept:
            if len(self.kept) >= SCORES_KEPT:
                self.kept.clear()
            self.kept[key] = self.score_vectors(self.vectors(text))
        return self.kept[key]

    def score_vectors(self, vectors: list[Sparse]) -> tuple[float, list]:
        vote, rows = self.votes(vectors) if len(self.levels) else (0.0, ())
        if not len(rows):
            return self.empty, []
        at = max(0, int(np.searchsorted(self.steps, vote, side="right")) - 1)
        near = list(dict.fromkeys(self.owner[rows].tolist()))[:5]
        return float(min(1.0, max(0.0, self.levels[at]))), [self.names[e] for e in near]


def _copy_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's bands of MinHashes of its 5-word shingles; a text without words has bands of the empty set."""
    words = Words()
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            s = shingles(words.of(text))
            with np.errstate(over="ignore"):
                least = [int(mixed(s + np.uint64(k) * M1).min()) if len(s) else k for k in range(COPY_BANDS * COPY_ROWS)]
            rows.append([xxhash.xxh3_64_intdigest(repr((b, least[b::COPY_BANDS]))) - (1 << 63) for b in range(COPY_BANDS)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], [*batch.schema.names, "bands"])


def _frequencies(vocabulary: list[str]):
    """Of how many rows of a partition each term of the vocabulary is part; -1 stands for the rows."""
    numbered = Numbered(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            for x in batch.column("text").to_pylist():
                rows += 1
                seen[np.unique(numbered.of(x))] += 1  # the last are those outside
        found = np.flatnonzero(seen[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int32()), pa.array([rows, *seen[found]], pa.int64())], ["term", "n"])

    return run


def examples_of(rows: DataFrame, known: DataFrame, examples: int) -> DataFrame:
    """(id, toxic, text, rank) of at most `examples` rows of each label, near copies once, the same under any partitioning."""
    rank = F.xxhash64("id", F.lit(3))
    drawn = [known.where(F.col("toxic") == y).select(F.col("id").alias("l_id"), "toxic").orderBy(F.xxhash64("l_id", F.lit(3)), "l_id").limit(2 * examples) for y in (0, 1)]
    kind = rows.schema["id"].dataType.simpleString()
    sample = rows.join(F.broadcast(drawn[0].union(drawn[1])), F.col("id") == F.col("l_id")).select("id", "toxic", "text")
    sample = cut(sample.groupBy("id", "toxic").agg(F.min("text").alias("text")).mapInArrow(_copy_bands, f"id {kind}, toxic int, text string, bands array<long>"), "labelled")
    least = F.min(F.struct(rank.alias("h"), "id")).alias("x")
    later = sample.select("id", "toxic", F.explode("bands").alias("band"))
    first = later.groupBy("toxic", "band").agg(least).select("toxic", "band", F.col("x.id").alias("first_id"))
    copies = later.join(first, ["toxic", "band"]).where("id <> first_id").select("id", "toxic").distinct()
    sample = sample.join(copies, ["id", "toxic"], "left_anti").select("id", "toxic", "text", rank.alias("rank"))
    kept = [sample.where(F.col("toxic") == y).orderBy("rank", "id").limit(examples) for y in (0, 1)]
    return cut(kept[0].union(kept[1]), "examples")


def fit(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (3, 1), examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from at most `examples` labelled rows of each label whose crc32(id) modulo held_out[0] isn't held_out[1].

    Near copies among them count once, else one much copied text could be all of a text's neighbours. The sample
    is weighted back to the share of each label. Its vocabulary are all terms of at least LEAST_DF examples but stop
    terms; document frequencies cover all documents. Rows that repeat an id count once, by their least text.
    """
    n, rest = held_out
    known = labels.select(labels[id_col].alias("id"), labels[label_col].alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.round(F.avg("toxic")).cast("int").alias("toxic"))
    known = known.where(crc_bucket("id", n) != rest)
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    sample = examples_of(rows, known, examples)
    own = [(r["id"], r["text"], r["toxic"]) for r in sorted(sample.collect(), key=lambda r: (r["rank"], str(r["id"]), r["toxic"]))]
    pos = sum(y for _, _, y in own)
    neg = len(own) - pos
    if not pos or not neg:
        return ToxicityModel([], np.zeros(0), [], (1.0, 1.0))
    counts = (Counter(), Counter())
    for _, text, y in own:  # texts take less of the driver's memory than their terms
        counts[y].update(set(terms_of(text)))
    vocabulary = sorted(t for t, c in (counts[0] + counts[1]).items() if c >= LEAST_DF)
    seen = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies(vocabulary), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    total = seen.get(-1, 0)
    share = np.array([seen.get(i, 0) for i in range(len(vocabulary))]) / max(total, 1)
    a, b = (np.array([c[t] for t in vocabulary]) + 0.5 for c in (counts[1], counts[0]))
    p, q = a / (pos + 1), b / (neg + 1)
    apart = np.abs(p - q) / np.sqrt(p * (1 - p) / pos + q * (1 - q) / neg) >= STOP_Z
    keep = (share <= STOP_SHARE) | apart
    idf = np.log((1 + total) / (1 + share[keep] * total))
    return ToxicityModel([t for t, k in zip(vocabulary, keep, strict=True) if k], idf, own, (totals[0] / neg, totals[1] / pos))


def toxicity(text: Column, model: ToxicityModel, id_type: str = "long") -> Column:
    """A struct of score (0 to 1) and evidence (ids of the nearest examples) for a text.

    A null or empty text, or one without a term of the vocabulary, has the score of the examples like it.
    """

    @F.pandas_udf(f"score double, evidence array<{id_type}>")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            got = [model.score(x) for x in part]
            yield pd.DataFrame({"score": [g[0] for g in got], "evidence": [g[1] for g in got]})

    return score(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out: tuple[int, int] = (3, 1), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with toxic_score, toxic_predicted and toxic_evidence; see fit() and toxicity().

    Rows that repeat an id or a text are scored alike; columns with these names are replaced, others keep theirs,
    whatever they are called; without labelled examples of both labels every score is 0; an empty table gives an
    empty result. Ids may be of any type that labels share.
    """
    model = fit(docs, labels, held_out, id_col=id_col, text_col=text_col)
    docs = docs.drop("toxic_score", "toxic_predicted", "toxic_evidence")
    own = unused(docs, "scored")
    out = docs.withColumn(own, toxicity(docs[text_col].cast("string"), model, docs.schema[id_col].dataType.simpleString()))
    score = F.col(own)["score"]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], score.alias("toxic_score"), (score >= threshold).cast("int").alias("toxic_predicted"), F.col(own)["evidence"].alias("toxic_evidence"))
