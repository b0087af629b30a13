"""LM scoring with a probabilistic suffix tree over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.llm.common import crc_bucket, cut

#: A word is a run of bytes other than space and \t \n \v \f \r, which is what bytes.split() takes; bytes.lower() maps A-Z alone.
END = b"\n"
#: A context is tested if it occurs CONTEXT_ROOT times the square root of all training tokens, and a next symbol is kept in
#: it from NEXT_ROOT times that root on (LEAST at least). So both grow with the corpus, by its square root.
CONTEXT_ROOT, NEXT_ROOT, LEAST = 0.02, 0.003, 2
#: A context is retained if its next symbols diverge from the shorter context's by DIVERGENCE * log(occurrences) nats for
#: each symbol it keeps, over all its occurrences.
DIVERGENCE = 0.5
#: Pseudo-counts drawn from the shorter context.
SMOOTHING = 5.0
FLUSH = 400_000
#: Positions that a task works on at once.
CHUNK = 1_000_000


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts; a task's table is sent on whenever it has grown to FLUSH words."""
    seen: Counter = Counter()

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            seen.update(tokens_of(text))
            seen[END] += 1
            if len(seen) >= FLUSH:
                yield sent()
    yield sent()


def _encoded(words: list[bytes], logs: np.ndarray):
    """Texts as numbers of the words with a number (-1 for others), with their base scores; the other words as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = {w: i for i, w in enumerate(words)}
        for batch in batches:
            codes, rare, known, base = [], [], [], []
            for text in batch.column("text").to_pylist():
                toks = [*tokens_of(text), END]
                x = np.fromiter((ids.get(w, -1) for w in toks), np.int32, len(toks))
                out = np.flatnonzero(x < 0)
                codes.append(x.tobytes())
                rare.append([toks[i] for i in out])
                known.append(len(x) - len(out))
                base.append(float(logs[x[x >= 0]].sum()))
            n = [len(c) // 4 for c in codes]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary()))], ["id", "held_out", "n_tokens", "known", "base", "codes", "rare"])

    return run


def _chunks(batch: pa.RecordBatch, start: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, its rows' codes one after another with the start before each, where each row begins)."""
    texts = batch.column("codes").to_pylist()
    at = 0
    while at < len(texts):
        first, rows, total = at, [], 0
        while at < len(texts) and total < CHUNK:
            rows.append(np.r_[np.int32(start), np.frombuffer(texts[at], np.int32)].astype(np.int64))
            total += len(rows[-1])
            at += 1
        yield first, np.concatenate(rows), np.cumsum([0, *[len(r) for r in rows[:-1]]])


def _place(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where x is in the sorted keys, -1 where it isn't."""
    if not len(keys):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, -1)


class SuffixTree:
    """Contexts by level. A context of n words is one of n - 1 words, the first ones, and a last word; its suffix is the
    state that it refines. A retained context (a state) has its kept next symbols and the weight it leaves to its suffix.
    """

    def __init__(self, log_base: np.ndarray):
        self.start = len(log_base)
        self.width = self.start + 1
        self.log_base = log_base
        self.contexts: list[np.ndarray] = []  # sorted keys: number of the context of the first words * width + last word
        self.suffix: list[np.ndarray] = []  # number of the suffix, a context one level up; -1 for the root
        self.left: list[np.ndarray] = []  # log10 of the weight left to the suffix, nan where a context isn't a state
        self.keys: list[np.ndarray] = []  # sorted context * width + next symbol, of states alone
        self.gains: list[np.ndarray] = []

    def log_probability(self, level: int, context: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """log10 P(next | context), by the longest state that ends the context; level 0 is the root."""
        if level == 0:
            return self.log_base[nxt].copy()
        left = self.left[level - 1][context]
        out = self.log_probability(level - 1, self.suffix[level - 1][context], nxt)
        state = ~np.isnan(left)
        out[state] += left[state]
        hit = np.where(state, _place(self.keys[level - 1], context * self.width + nxt), -1)
        out[hit >= 0] = self.gains[level - 1][hit[hit >= 0]]
        return out

    def add_level(self, contexts: np.ndarray, suffix: np.ndarray, total: np.ndarray, context: np.ndarray, nxt: np.ndarray, n: np.ndarray) -> None:
        """contexts: their keys, with their suffixes and occurrences; (context, nxt, n): counts of their next symbols, in order."""
        level = len(self.contexts) + 1
        self.contexts.append(contexts)
        self.suffix.append(suffix)
        parent = 10 ** self.log_probability(level - 1, suffix[context], nxt)
        p = (n + SMOOTHING * parent) / (total[context] + SMOOTHING)
        sums = lambda x: np.bincount(context, x, len(contexts))
        kept, taken, was = sums(np.ones(len(n))), sums(p), sums(parent)
        rest, before = np.maximum(1 - taken, 1e-9), np.maximum(1 - was, 1e-9)
        apart = total * (sums(p * np.log(p / parent)) + rest * np.log(rest / before))
        state = (kept > 0) & (apart >= DIVERGENCE * np.log(np.maximum(total, 2)) * (kept + 1))
        self.left.append(np.where(state, np.log10(rest / before), np.nan))
        mine = state[context]
        self.keys.append(context[mine] * self.width + nxt[mine])
        self.gains.append(np.log10(p[mine]))

    def longest(self, x: np.ndarray, level: int) -> np.ndarray:
        """At each position the number of the context of so many words that ends there, -1 for none."""
        at = _place(self.contexts[0], x)
        for k in range(1, level):
            before = np.r_[-1, at[:-1]]
            ok = np.flatnonzero((before >= 0) & (x >= 0) & (x != self.start))
            at = np.full(len(x), -1)
            at[ok] = _place(self.contexts[k], before[ok] * self.width + x[ok])
        return at

    def gain(self, x: np.ndarray) -> np.ndarray:
        """At each position but the first, log10 P(symbol | longest state before it) less that of its base probability.

        x: encoded texts with the start before each. A word without a number (-1) is in no state and kept by none;
        its base cancels out. The start is no symbol and has 0."""
        nxt = x[1:]
        plain = (nxt >= 0) & (nxt != self.start)
        base = np.where(plain, self.log_base[np.where(plain, nxt, 0)], 0.0) if self.start else np.zeros(len(nxt))
        out = base.copy()
        at = None
        for k in range(len(self.contexts)):
            if k == 0:
                at = _place(self.contexts[0], x)
            else:
                before = np.r_[-1, at[:-1]]
                ok = np.flatnonzero((before >= 0) & (x >= 0) & (x != self.start))
                at = np.full(len(x), -1)
                at[ok] = _place(self.contexts[k], before[ok] * self.width + x[ok])
            context = at[:-1]
            state = np.flatnonzero(context >= 0)
            state = state[~np.isnan(self.left[k][context[state]])]
            out[state] += self.left[k][context[state]]
            state = state[plain[state]]
            hit = _place(self.keys[k], context[state] * self.width + nxt[state])
            out[state[hit >= 0]] = self.gains[k][hit[hit >= 0]]
        return np.where(nxt == self.start, 0.0, out - base)


def _next_counts(tree: SuffixTree, contexts: np.ndarray):
    """Counts of (context, next symbol) for the given contexts, which are one word longer than the tree's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = len(tree.contexts)
        for batch in batches:
            for _, x, _ in _chunks(batch, tree.start):
                last, nxt = x[:-1], x[1:]
                ok = np.flatnonzero((last >= 0) & (nxt >= 0) & (nxt != tree.start))
                if level:
                    before = np.r_[-1, tree.longest(x, level)[:-2]]
                    ok = ok[(before[ok] >= 0) & (last[ok] != tree.start)]
                    key = before[ok] * tree.width + last[ok]
                else:
                    key = last[ok]
                at = _place(contexts, key)
                ok, at = ok[at >= 0], at[at >= 0]
                got, n = np.unique(at * tree.width + nxt[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(got // tree.width), pa.array(got % tree.width), pa.array(n, pa.int64())], ["context", "next", "n"])

    return run


def _gains(tree: SuffixTree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gains = np.zeros(batch.num_rows)
            for first, x, begins in _chunks(batch, tree.start):
                gains[first : first + len(begins)] = np.add.reduceat(np.r_[0.0, tree.gain(x)], begins)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "held_out", "n_tokens", "known", "base")], pa.array(gains)], ["row", "id", "held_out", "n_tokens", "known", "base", "gain"])

    return run


def learn(train: DataFrame, log_base: np.ndarray, many: np.ndarray, end: int, least_context: float, least_next: float) -> SuffixTree:
    """Grow the tree level by level over train (codes), until no longer context is frequent enough or none is retained.

    many: occurrences of each numbered word and of the start. A context of one word more is tested if it is
    frequent, its first words were a context, its suffix is a state, and it doesn't hold an end.
    """
    tree = SuffixTree(log_base)
    contexts = np.flatnonzero((many >= least_context) & (np.arange(len(many)) != end))
    suffix, total = np.zeros(len(contexts), np.int64), many[contexts]
    while len(contexts):
        found = train.mapInArrow(_next_counts(tree, contexts), "context long, next long, n long").groupBy("context", "next").agg(F.sum("n").alias("n"))
        got = found.where(F.col("n") >= least_next).toPandas().sort_values(["context", "next"])
        context, nxt, n = (got[k].to_numpy(np.int64) for k in ("context", "next", "n"))
        tree.add_level(contexts, suffix, total, context, nxt, n)
        deep = (n >= least_context) & (nxt != end)
        context, nxt, n = context[deep], nxt[deep], n[deep]
        shorter = nxt if len(tree.contexts) == 1 else tree.suffix[-1][context] * tree.width + nxt
        suffix = _place(tree.contexts[-1], shorter)
        state = (suffix >= 0) & ~np.isnan(np.r_[tree.left[-1], np.nan][suffix])
        contexts, suffix, total = (context * tree.width + nxt)[state], suffix[state], n[state]
    return tree


def score_documents(docs: DataFrame, held_out: tuple[int, int] = (10, 0), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    Training texts are those whose crc32(id) modulo held_out[0] isn't held_out[1]. All their words are counted, and
    those that can be kept by a context have numbers. Texts are written as numbers once; each level of the tree, of
    contexts one word longer, takes a pass over these. Contexts are tested from a number of occurrences on that grows
    with the square root of the corpus, are retained by a divergence test of their next-symbol distribution against
    the shorter context's, with which it is smoothed, and have no largest length. A token's probability is that of the
    longest suffix of what precedes it that is a state; the root has the add-0.1 probabilities of the base score.

    The tree is broadcast: it has at most sqrt(training tokens) / NEXT_ROOT next symbols a level. Words without a
    number are joined with their counts, by word, and summed; no word of them is frequent.
    A null or empty text is its end alone; rows that repeat an id are scored each; without training texts
    nothing is known and every token has the same base probability. An empty table gives an empty result. Ids may
    be of any type.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), (crc_bucket(id_col, held_out[0]) == held_out[1]).alias("held_out"))
    id_type = rows.schema["id"].dataType.simpleString()
    counts = cut(rows.where(~F.col("held_out")).select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    got = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    total, distinct = got["n"] or 0, got["v"]
    bottom = total + 0.1 * (distinct + 1)
    unknown = float(np.log10(0.1 / bottom))
    least_context, least_next = (max(LEAST, root * total**0.5) for root in (CONTEXT_ROOT, NEXT_ROOT))
    named = sorted((bytes(r["word"]), r["n"]) for r in counts.where((F.col("n") >= least_next) | (F.col("word") == F.lit(END))).collect())
    words = [w for w, _ in named]
    n = np.array([k for _, k in named], np.int64)
    logs = np.log10((n + 0.1) / bottom)
    end = words.index(END) if words else -1

    plain = "held_out boolean, n_tokens long, known long, base double"
    coded = rows.mapInArrow(_encoded(words, logs), f"id {id_type}, {plain}, codes binary, rare array<binary>")
    coded = cut(coded.withColumn("row", F.monotonically_increasing_id()), "codes")
    tree = learn(coded.where(~F.col("held_out")).select("codes"), logs, np.r_[n, n[end]] if words else np.zeros(1, np.int64), end, least_context, least_next)
    scored = coded.drop("rare").mapInArrow(_gains(tree), f"row long, id {id_type}, {plain}, gain double")
    tail = coded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.count("n").alias("more"), F.sum(F.when(F.col("n").isNull(), unknown).otherwise(F.log10((F.col("n") + 0.1) / bottom))).alias("rest"))
    out = scored.join(tail, "row", "left")
    base = F.col("base") + F.coalesce("rest", F.lit(0.0))
    return out.select("id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
