"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from epochlens.llm.common import crc_bucket

#: Signs that are alphanumeric but neither letters nor digits: fractions, superscripts, Roman numerals and such.
_NUMERALS = "".join(c for c in map(chr, range(0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
#: Sequences are runs of letters, lower-cased, as UTF-8; longer ones are cut between letters into pieces of at most so many bytes.
LETTERS = re.compile(rf"[^\W\d_{re.escape(_NUMERALS)}]+")
#: The same and those signs: LETTERS tries each letter against hundreds of signs, so only runs that hold one are given to it.
RUNS = re.compile(r"[^\W\d_]+")
PIECE = 48
#: Documents of each language, and words of theirs, that training uses, chosen by hashes.
DOCUMENTS, WORDS = 300, 8000
HIDDEN, EPOCHS, BATCH, RATE = 12, 6, 128, 0.01
#: Runs whose outputs a task keeps; beyond, it starts anew.
WORDS_KEPT = 400_000
NAMES = ("in_f", "in_b", "rec_f", "rec_b", "out", "bias")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_parameters(n: int, hidden: int = HIDDEN, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    shapes = {"in_f": (256, 3 * hidden), "in_b": (256, 3 * hidden), "rec_f": (hidden, 3 * hidden), "rec_b": (hidden, 3 * hidden), "out": (2 * hidden, n), "bias": (n,)}
    return {k: (rng.normal(size=s) * (0.3 if k[:2] != "bi" else 0)).astype(np.float32) for k, s in shapes.items()}


def gru(x: np.ndarray, enter: np.ndarray, rec: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States after each byte of x (sequences by time); keep collects what the backward pass needs."""
    b, t = x.shape
    k = rec.shape[0]
    h = np.zeros((b, k), np.float32)
    states = np.empty((t, b, k), np.float32)
    for i in range(t):
        a, u = enter[x[:, i]], h @ rec
        gates = sigmoid(a[:, : 2 * k] + u[:, : 2 * k])
        z, r, q = gates[:, :k], gates[:, k:], u[:, 2 * k :]
        n = np.tanh(a[:, 2 * k :] + r * q)
        if keep is not None:
            keep.append((h, z, r, q, n))
        h = n + z * (h - n)
        states[i] = h
    return states


def gru_back(x: np.ndarray, rec: np.ndarray, kept: list, grad: np.ndarray, d_enter: np.ndarray, d_rec: np.ndarray) -> None:
    """Add the gradients of one direction, from the last byte to the first; grad: by state."""
    k = rec.shape[0]
    carry = np.zeros_like(grad[0])
    for i in range(len(kept) - 1, -1, -1):
        h, z, r, q, n = kept[i]
        d = grad[i] + carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * q * r * (1 - r)
        inner = np.concatenate([dz, dr, dn * r], 1)
        np.add.at(d_enter, x[:, i], np.concatenate([dz, dr, dn], 1))
        d_rec += h.T @ inner
        carry = d * z + inner @ rec.T


def log_probabilities(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """log P(language) at every byte: time, sequence, language."""
    both = np.concatenate([gru(x, p["in_f"], p["rec_f"]), gru(x[:, ::-1], p["in_b"], p["rec_b"])[::-1]], 2)
    y = both @ p["out"] + p["bias"]
    y -= y.max(2, keepdims=True)
    return y - np.log(np.exp(y).sum(2, keepdims=True))


def gradients(p: dict[str, np.ndarray], x: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all bytes of all sequences, and its gradients."""
    keep_f: list = []
    keep_b: list = []
    f, b = gru(x, p["in_f"], p["rec_f"], keep_f), gru(x[:, ::-1], p["in_b"], p["rec_b"], keep_b)[::-1]
    both = np.concatenate([f, b], 2)
    y = both @ p["out"] + p["bias"]
    y -= y.max(2, keepdims=True)
    prob = np.exp(y)
    prob /= prob.sum(2, keepdims=True)
    each = np.arange(len(label))
    loss = -np.log(prob[:, each, label] + 1e-12).mean()
    d = prob
    d[:, each, label] -= 1
    d /= d.shape[0] * d.shape[1]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["out"] = np.einsum("tbh,tbn->hn", both, d)
    g["bias"] = d.sum((0, 1))
    back = d @ p["out"].T
    k = p["rec_f"].shape[0]
    gru_back(x, p["rec_f"], keep_f, back[:, :, :k], g["in_f"], g["rec_f"])
    gru_back(x[:, ::-1], p["rec_b"], keep_b, back[::-1, :, k:], g["in_b"], g["rec_b"])
    return float(loss), g


def train(words: list[tuple[bytes, int]], n: int, epochs: int = EPOCHS, seed: int = 2) -> dict[str, np.ndarray]:
    """Adam over batches of words of one length."""
    rng = np.random.default_rng(seed)
    p = new_parameters(n)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    by_length: dict[int, list[tuple[bytes, int]]] = {}
    for w, y in words:
        by_length.setdefault(len(w), []).append((w, y))
    for epoch in range(epochs):
        batches = []
        for rows in by_length.values():
            order = rng.permutation(len(rows))
            batches += [[rows[j] for j in order[i : i + BATCH]] for i in range(0, len(rows), BATCH)]
        for i in rng.permutation(len(batches)):
            x = np.frombuffer(b"".join(w for w, _ in batches[i]), np.uint8).reshape(len(batches[i]), -1)
            _, g = gradients(p, x, np.array([y for _, y in batches[i]]))
            step += 1
            rate = RATE * (0.5 if epoch >= epochs - 2 else 1.0)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def runs(text: str | None) -> list[str]:
    """Runs of letters and signs; of those over PIECE characters the pieces, so that none is long."""
    found = RUNS.findall(text.lower()) if text else []
    if max(map(len, found), default=0) > PIECE:
        found = [x for w in found for x in ([w] if len(w) <= PIECE else [p.decode() for p in run_pieces(w)])]
    return found


def pieces(text: str | None) -> list[bytes]:
    return [p for run in runs(text) for p in run_pieces(run)]


def run_pieces(run: str) -> list[bytes]:
    out = []
    for w in [run] if run.isalpha() else LETTERS.findall(run):
        b = w.encode()
        while len(b) > PIECE:
            end = PIECE
            while b[end] & 0xC0 == 0x80:  # inside a letter
                end -= 1
            out.append(b[:end])
            b = b[end:]
        out.append(b)
    return out


class LanguageModel:
    """Languages of texts: the network labels every byte, and a document has the mean over its bytes.

    A sequence is one run of letters, so equal runs have equal outputs, which are kept.
    """

    def __init__(self, languages: list[str], parameters: dict[str, np.ndarray]):
        self.languages, self.parameters = languages, parameters
        self.place: dict[str, int] = {}
        self.sums = np.zeros((0, 2 * len(languages) + 1))

    def learn(self, new: list[str]) -> None:
        """Per run: sums over the bytes of its pieces of log probabilities and of probabilities, and the number of bytes."""
        alike: dict[tuple[int, int], list[tuple[bytes, int]]] = {}  # by length and place in the run
        for i, run in enumerate(new):
            for nth, p in enumerate(run_pieces(run)):
                alike.setdefault((len(p), nth), []).append((p, i))
        sums = np.zeros((len(new), self.sums.shape[1]))
        for (size, _), same in alike.items():
            for at in range(0, len(same), 4096):
                part = same[at : at + 4096]
                logp = log_probabilities(self.parameters, np.frombuffer(b"".join(p for p, _ in part), np.uint8).reshape(len(part), size))
                sums[[i for _, i in part]] += np.concatenate([logp.sum(0), np.exp(logp).sum(0), np.full((len(part), 1), size)], 1)
        self.place.update({run: len(self.sums) + i for i, run in enumerate(new)})
        self.sums = np.concatenate([self.sums, sums])

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        found = [runs(x) for x in texts]
        every = set().union(*found)
        if len(self.place) + len(every) > WORDS_KEPT:
            self.place, self.sums = {}, self.sums[:0]
        if missing := every - self.place.keys():
            self.learn(sorted(missing))
        names, scores, k = [], [], len(self.languages)
        for own in found:
            total = self.sums[np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))].sum(0)
            if not total[-1]:
                names.append("und")
                scores.append(0.0)
                continue
            best = int(total[:k].argmax())
            names.append(self.languages[best])
            scores.append(float(min(1.0, max(0.0, total[k + best] / total[-1]))))
        return names, scores


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([pieces(x) for x in batch.column("text").to_pylist()], pa.list_(pa.binary()))], ["lang", "words"])


def fit(docs: DataFrame, held_out: tuple[int, int] = (4, 2), documents: int = DOCUMENTS, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and network from a bounded sample: so many words of so many documents of each language."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where("lang is not null and id is not null").where(crc_bucket("id", held_out[0]) != held_out[1])
    first = rows.select("id", "lang").withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(11)), "id"))).where(F.col("nth") <= documents)
    sample = rows.join(F.broadcast(first.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "text")
    found = sample.mapInArrow(_words, "lang string, words array<binary>").select("lang", F.posexplode("words").alias("at", "word"))
    found = found.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("word", "at"), "word"))).where(F.col("nth") <= words)
    got = sorted((r["lang"], r["nth"], bytes(r["word"])) for r in found.select("lang", "nth", "word").collect())
    languages = sorted({r[0] for r in got})
    number = {x: i for i, x in enumerate(languages)}
    return languages, train([(w, number[x]) for x, _, w in got], len(languages)) if languages else new_parameters(1)


_KEPT: dict[bytes, LanguageModel] = {}


def _predict(languages: list[str], parameters: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = b"".join(parameters[k].tobytes() for k in NAMES)
        if mark not in _KEPT:  # a worker keeps the words it knows between tasks
            _KEPT.clear()
            _KEPT[mark] = LanguageModel(languages, parameters)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                names, scores = _KEPT[mark].predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, held_out: tuple[int, int] = (4, 2), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row of docs.

    Learns from documents with a language whose crc32(id) modulo held_out[0] isn't held_out[1]. The language
    is the one of the largest sum of log probabilities over all bytes of letters, score its mean probability
    there. A null or empty text or one without a letter is `und` with score 0, and so is everything if there is
    nothing to learn from; rows that repeat an id are predicted each; an empty table gives an empty result.
    """
    languages, parameters = fit(docs, held_out, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_predict(languages, parameters), f"id {id_type}, lang_pred string, score double")
    return out.select("id", (crc_bucket("id", held_out[0]) == held_out[1]).alias("held_out"), "lang_pred", "score")
