"""Abusive, hateful or sexual content: a convolutional text classifier over hashed word embeddings.

A document is scored by its worst passage (line). A line's words, freed from disguises, are hashed to embeddings; filters of
several widths run over them, are max-pooled, and a dense layer gives one logit per kind of content. Labels exist only for
whole documents, so training alternates between choosing the lines that carry a document's label and fitting the network to
these lines against all lines of clean documents. Thresholds are calibrated per language on documents held out in turn.
Everything is numpy. The network is fitted on at most max_docs labelled documents, the folds side by side; scoring covers all lines of
all documents and remembers lines it has seen, since notebooks repeat them.
"""

from __future__ import annotations

import base64
import math
import pickle
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.words import INVISIBLE, LOOKALIKES, UNICODE_ESCAPE

KINDS = ("abuse", "hate", "sexual")
BUCKETS = 1 << 14
DIM, FILTERS, WIDTHS = 16, 24, (1, 2, 3, 5)
CHUNK, STEP = 48, 40
HIDDEN = 0.08
#: Logit under which an unlabelled line is taken for clean.
QUIET = -1.0
#: Log odds of a word between guilty and clean documents from which it may make a line guilty.
TELLING = 1.5

LONG_RUN = 41
DATA_RUN = re.compile(r"[A-Za-z0-9+/=_-]{41,}")
#: Words and numbers of a run: capitals, a capitalised or small word, digits.
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NUMBER = re.compile(r"(?<![A-Za-z@$0-9])[0-9][0-9.,:]*(?![A-Za-z@$0-9])")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_\-]){2,}[^\W\d_](?![^\W_])")
TOKEN = re.compile(r"[^\W_@$!]*[^\W\d_@$!][^\W_]*(?:[@$!]+[^\W_]+)*[@$]*|[^\W_]*[@$]+[^\W_@$]+(?:[@$!]*[^\W_]+)*[@$]*|[0-9]+")
DOUBLED = re.compile(r"(.)\1+")
# Signs that stand for letters in disguised words.
SIGNS = str.maketrans("@$!013457", "asioieast")
SCRIPT = re.compile(r"[@$!0-9]")


def unpacked(run: str) -> str:
    """What a long run without spaces says: the words it is joined from, or the text it encodes, or 'data' if neither.

    Words are joined with signs or by case; at least half of the letters and digits must lie in words of three letters or
    more, or the run is taken for encoded. Encoded text is what decodes from base 64 to printable UTF-8.
    """
    parts = PART.findall(run)
    if 2 * sum(len(p) for p in parts if len(p) > 2 and p.isalpha()) >= sum(map(len, parts)):
        return " " + " ".join(parts) + " "
    coded = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        text = base64.b64decode(coded + "=" * (-len(coded) % 4), validate=True).decode("utf-8")
    except (ValueError, UnicodeDecodeError):
        return " data "
    return " " + text + " " if all(c.isprintable() or c.isspace() for c in text) else " data "


def line_key(line: str) -> str:
    """What two lines have in common if they can only score alike: numbers and what encodes no text are masked."""
    if len(line) >= LONG_RUN:
        line = DATA_RUN.sub(lambda m: unpacked(m[0]), line)
    return NUMBER.sub("0", line).strip()


def line_words(line: str) -> list[str]:
    """Words of a line in lower case, without accents, invisible characters, look-alikes, spacing, stretching and sign letters."""
    if "\\" in line:
        line = UNICODE_ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)), line)
    if not line.isascii():
        line = INVISIBLE.sub("", unicodedata.normalize("NFKD", line)).translate(LOOKALIKES)
    line = line.lower()
    line = SPACED.sub(lambda m: re.sub(r"[ .*_\-]", "", m[0]), line)
    out = []
    for w in TOKEN.findall(line):
        if w.isdigit():
            out.append("0")
            continue
        if SCRIPT.search(w):
            w = w.rstrip("!").translate(SIGNS)
        out.append(DOUBLED.sub(r"\1", w))
    return out


def word_id(word: str) -> int:
    """Bucket of a word, from 2; 0 is padding, 1 stands for words not seen in training."""
    return zlib.crc32(word.encode()) % (BUCKETS - 2) + 2


@dataclass
class Network:
    """Weights: embeddings, one filter bank per width, dense layer."""

    embed: np.ndarray
    banks: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    shift: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        embed = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        embed[0] = 0
        banks = [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Network(embed, banks, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(KINDS))).astype(np.float32), np.full(len(KINDS), -3.0, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.embed, *self.banks, *self.biases, self.dense, self.shift]

    def forward(self, ids: np.ndarray) -> tuple[np.ndarray, list]:
        """Logits (rows, kinds) of padded rows of word ids, and what the backward pass needs."""
        x = self.embed[ids]
        rows, length, _ = x.shape
        pooled, kept = [], []
        for w, bank, bias in zip(WIDTHS, self.banks, self.biases, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(rows, length - w + 1, w * DIM)
            z = view @ bank + bias
            at = z.argmax(axis=1)
            top = np.take_along_axis(z, at[:, None, :], axis=1)[:, 0, :]
            pooled.append(np.maximum(top, 0))
            kept.append((view, at, top > 0))
        h = np.concatenate(pooled, axis=1)
        return h @ self.dense + self.shift, [h, kept]

    def backward(self, ids: np.ndarray, kept: list, d_logit: np.ndarray) -> list[np.ndarray]:
        h, banks = kept
        d_h = d_logit @ self.dense.T
        places, shares = [], []
        d_banks, d_biases = [], []
        rows = np.arange(len(ids))[:, None]
        for k, (w, bank) in enumerate(zip(WIDTHS, self.banks, strict=True)):
            view, at, on = banks[k]
            g = d_h[:, k * FILTERS : (k + 1) * FILTERS] * on
            d_banks.append(np.einsum("bfk,bf->kf", view[rows, at], g, optimize=True))
            d_biases.append(g.sum(axis=0))
            spread = g[:, :, None] * bank.T[None]  # rows, filters, w * DIM
            for j in range(w):
                places.append(ids[rows, at + j].ravel())
                shares.append(spread[:, :, j * DIM : (j + 1) * DIM].reshape(-1, DIM))
        flat = (np.concatenate(places)[:, None].astype(np.int64) * DIM + np.arange(DIM)).ravel()
        d_embed = np.bincount(flat, weights=np.concatenate(shares).ravel(), minlength=BUCKETS * DIM).astype(np.float32).reshape(BUCKETS, DIM)
        d_embed[0] = 0
        return [d_embed, *d_banks, *d_biases, h.T @ d_logit, d_logit.sum(axis=0)]


def padded(lines: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of CHUNK word ids and the line each belongs to; a longer line is several overlapping rows."""
    rows, owner = [], []
    for k, ids in enumerate(lines):
        for at in range(0, max(1, len(ids) - (CHUNK - STEP)), STEP):
            rows.append(ids[at : at + CHUNK])
            owner.append(k)
    table = np.zeros((len(rows), CHUNK), np.int32)
    for r, ids in enumerate(rows):
        table[r, : len(ids)] = ids
    return table, np.array(owner, np.int64)


def score_lines(net: Network, lines: list[list[int]]) -> np.ndarray:
    """Logits (lines, kinds); lines of like length are handled together, so little padding is computed."""
    out = np.full((len(lines), len(KINDS)), -12.0, np.float32)
    table, owner = padded(lines)
    length = (table > 0).sum(axis=1)
    order = np.argsort(length, kind="stable")
    order = order[length[order] > 0]
    for lo in range(0, len(order), 4096):
        part = order[lo : lo + 4096]
        width = max(max(WIDTHS), int(length[part].max()))
        logits, _ = net.forward(table[part, :width])
        np.maximum.at(out, owner[part], logits)
    return out


def fit_lines(ids: list[list[int]], target: np.ndarray, seed: int, epochs: int, net: Network | None = None) -> Network:
    """Adam on the logistic loss; the rare kinds of line are drawn as often as the clean ones."""
    rng = np.random.default_rng(seed)
    net = net or Network.fresh(seed)
    table, owner = padded(ids)
    target = target[owner]
    positive, negative = np.flatnonzero(target.max(axis=1) > 0.5), np.flatnonzero(target.max(axis=1) <= 0.5)
    if not len(positive) or not len(negative):
        return net
    filled = table > 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    step = 0
    for epoch in range(epochs):
        drawn = np.concatenate([rng.choice(positive, max(len(positive), 1024)), rng.choice(negative, min(6144, max(len(negative), 1024)))])
        if epoch % 2:
            # The clean lines that still look worst, beside the random ones.
            some = rng.choice(negative, min(len(negative), 8_000), replace=False)
            logits = np.concatenate([net.forward(table[some[lo : lo + 2048]])[0] for lo in range(0, len(some), 2048)]).max(axis=1)
            drawn = np.concatenate([drawn, some[np.argsort(-logits)[:1024]]])
        rng.shuffle(drawn)
        for lo in range(0, len(drawn), 256):
            part = drawn[lo : lo + 256]
            width = max(max(WIDTHS), int((table[part] > 0).sum(axis=1).max()))
            # Words are hidden at random, so that the network learns what an unknown word says, which is little.
            x = np.where(filled[part, :width] & (rng.random((len(part), width)) < HIDDEN), 1, table[part, :width])
            logits, kept = net.forward(x)
            p = 1 / (1 + np.exp(-logits))
            d = ((p - target[part]) / len(part)).astype(np.float32)
            step += 1
            for value, grad, (m, v) in zip(net.parts(), net.backward(x, kept, d), moments, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                value -= 0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


@dataclass
class Labelled:
    """One labelled document: its distinct lines as word ids, per kind 1 if every rater says so and 0 if none does."""

    lines: list[list[int]]
    target: np.ndarray
    language: str


def _train(docs: list[Labelled], background: list[list[int]], seed: int, rounds: int = 3, epochs: int = 6) -> Network:
    """Alternate choosing the guilty lines of labelled documents and fitting the network.

    background: lines of documents nobody labelled. From the second round on, those that don't look guilty count as clean,
    so that the network knows the corpus' usual words.
    """
    guilty = [d for d in docs if d.target.max() > 0]
    clean = [d for d in docs if d.target.max() == 0]
    if not guilty or not clean:
        return Network.fresh(seed)
    # First choice: words seen in guilty documents far more often than in clean ones.
    count = np.zeros((2, BUCKETS))
    for d in docs:
        count[int(d.target.max() > 0), list({w for line in d.lines for w in line})] += 1
    odds = np.log((count[1] + 0.3) / (len(guilty) + 0.6)) - np.log((count[0] + 0.3) / (len(clean) + 0.6))
    odds[count[1] < 2] *= 0.5
    suspicion = lambda line: float(np.sort(np.maximum(odds[list(set(line))], 0))[-4:].sum()) if line else 0.0
    net = None
    often = Counter(tuple(line) for d in clean for line in d.lines)
    known = set(often)
    # A line of many clean documents is worth more rows than one of a single document.
    innocent = [list(line) for line, n in often.items() for _ in range(int(math.log2(1 + n)))]
    for k in range(rounds):
        lines = list(innocent)
        if net is not None and background:
            quiet = score_lines(net, background).max(axis=1) < QUIET
            lines += [line for line, q in zip(background, quiet, strict=True) if q]
            count[0] += np.bincount([w for line, q in zip(background, quiet, strict=True) if q for w in set(line)], minlength=BUCKETS)
        target = [np.zeros(len(KINDS))] * len(lines)
        for d in guilty:
            # Only a line with a telling word can be the guilty one; a document without any teaches nothing.
            open_lines = [line for line in d.lines if tuple(line) not in known and line and odds[line].max() >= TELLING]
            if not open_lines:
                continue
            if net is None:
                score = np.array([suspicion(line) for line in open_lines])
            else:
                logits = score_lines(net, open_lines)
                score = logits[:, d.target > 0].max(axis=1)
            picked = {int(score.argmax())}
            if net is not None:
                picked |= set(np.flatnonzero(score > 0).tolist())
            lines += [open_lines[i] for i in sorted(picked)]
            target += [d.target] * len(picked)
        net = fit_lines(lines, np.array(target, np.float32), seed + k, epochs, net)
    unseen = count.sum(axis=0) == 0
    unseen[:2] = False
    net.embed[unseen] = net.embed[1]
    return net


def _doc_scores(net: Network, docs: list[Labelled]) -> np.ndarray:
    """Highest logit of each document."""
    lines = [line for d in docs for line in d.lines]
    owner = np.repeat(np.arange(len(docs)), [len(d.lines) for d in docs])
    out = np.full(len(docs), -12.0)
    if lines:
        np.maximum.at(out, owner, score_lines(net, lines).max(axis=1))
    return out


def _best_threshold(score: np.ndarray, truth: np.ndarray, noise: float) -> float:
    """Threshold of the highest F1 to be expected if every score may differ by noise (a deviation) on the network in use.

    A narrow gap between two documents' scores thus counts for nothing, and the threshold lies in the wide one.
    """
    at = np.linspace(score.min() - 1, score.max() + 1, 801)
    over = 1 / (1 + np.exp(np.clip(-1.702 * (score[:, None] - at[None, :]) / noise, -60, 60)))
    hits, said = over[truth > 0].sum(axis=0), over.sum(axis=0)
    f1 = 2 * hits / (said + truth.sum())
    best = np.flatnonzero(f1 >= f1.max() - 1e-6)
    return float(at[best[len(best) // 2]])


@dataclass
class Classifier:
    """A fitted network, the threshold (logit) per language and the one for all others, and the held-out F1."""

    net: Network
    thresholds: dict[str, float] = field(default_factory=dict)
    usual: float = 0.0
    held_out_f1: float = float("nan")


def language_key(lang: str | None) -> str:
    """First two letters of a language tag in lower case; 'und' if there is none."""
    text = (lang or "").strip().lower()[:2]
    return text if text.isalpha() and len(text) == 2 else "und"


def _in_turn(jobs: list[Callable[[], object]]) -> list:
    return [job() for job in jobs]


def on_cluster(spark: SparkSession) -> Callable[[list[Callable[[], object]]], list]:
    """Runs jobs as tasks of the cluster, one task each; what they refer to is broadcast once, and their results come back."""

    def run(jobs: list[Callable[[], object]]) -> list:
        shared = spark.sparkContext.broadcast(jobs)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([pickle.dumps(shared.value[k]())], pa.binary())], names=["job", "result"])

        rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(work, "job long, result binary").collect()  # one row per job
        shared.unpersist()
        return [pickle.loads(r.result) for r in sorted(rows, key=lambda r: r.job)]

    return run


def _whole(docs: list[Labelled], background: list[list[int]], seed: int) -> tuple[Network, np.ndarray]:
    """The network of all documents and their scores."""
    net = _train(docs, background, seed)
    return net, _doc_scores(net, docs)


def _held_out(docs: list[Labelled], fold: np.ndarray, k: int, background: list[list[int]], seed: int) -> np.ndarray:
    """Scores of the documents of fold k from a network fitted on the others."""
    other = _train([d for d, f in zip(docs, fold, strict=True) if f != k], background, seed + 100 * (k + 1), epochs=5)
    return _doc_scores(other, [d for d, f in zip(docs, fold, strict=True) if f == k])


def fit_classifier(
    docs: list[Labelled], background: list[list[int]], seed: int = 11, folds: int = 3, least_positives: int = 30, run: Callable[[list[Callable[[], object]]], list] = _in_turn
) -> Classifier:
    """Network on all documents; thresholds on scores that each fold got from a network not fitted on it.

    The trainings don't depend on each other; run may do them at the same time (see on_cluster).
    """
    truth = np.array([d.target.max() > 0 for d in docs], dtype=float)
    score, fold = np.zeros(len(docs)), np.zeros(len(docs), int)
    for value in (0, 1):
        where = np.flatnonzero(truth == value)
        fold[where] = np.arange(len(where)) % folds
    calibrated = truth.sum() >= 2 * folds and (1 - truth).sum() >= 2 * folds

    (net, own), *scores = run([partial(_whole, docs, background, seed), *[partial(_held_out, docs, fold, k, background, seed) for k in range(folds if calibrated else 0)]])
    if not calibrated:
        return Classifier(net)
    for k, values in enumerate(scores):
        score[fold == k] = values
    # How far the network in use scores clean documents otherwise than the networks that held them out.
    moved = (own - score)[truth == 0]
    shift = float(np.median(moved))
    noise = max(0.5, 1.4826 * float(np.median(np.abs(moved - shift))))
    score += shift
    usual = _best_threshold(score, truth, noise)
    languages = np.array([d.language for d in docs])
    thresholds = {}
    for lang in sorted(set(languages)):
        theirs = languages == lang
        if truth[theirs].sum() >= least_positives and (1 - truth[theirs]).sum() >= least_positives:
            thresholds[lang] = _best_threshold(score[theirs], truth[theirs], noise)
    said = score > np.array([thresholds.get(x, usual) for x in languages])
    f1 = 2 * (said * truth).sum() / max(1, said.sum() + truth.sum())
    return Classifier(net, thresholds, usual, float(f1))


def word_lines(text: str, seen: dict[str, list[int]]) -> list[list[int]]:
    """Word ids of a text's distinct lines; seen remembers lines."""
    out = []
    for key in sorted({k for k in map(line_key, text.splitlines()) if k}):
        if key not in seen:
            seen[key] = [word_id(w) for w in line_words(key)]
        if seen[key]:
            out.append(seen[key])
    return out


def drawn_ids(ids: DataFrame, most: int) -> DataFrame:
    """At most that many of the ids (column doc), those of lowest hash: the same ones however the rows are partitioned.

    A threshold on the hash, twice as wide as needed, leaves little to sort whatever the number of partitions.
    """
    total = ids.count()
    share = F.pmod(F.xxhash64("doc"), F.lit(1 << 30))
    if total > 4 * most:
        ids = ids.where(share < int((1 << 30) * 2 * most / total))
    return ids.orderBy(share, "doc").limit(most)


def background_sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, max_docs: int) -> list[list[int]]:
    """Distinct lines of at most max_docs documents (drawn by hash of the id) without any label."""
    texts = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text")).where("text <> '' and doc is not null")
    free = drawn_ids(texts.select("doc").join(labels.select(F.col(doc_id).alias("doc")).distinct(), "doc", "left_anti"), max_docs)
    seen: dict[str, list[int]] = {}
    for row in texts.join(F.broadcast(free), "doc").collect():  # at most max_docs rows, but for repeated ids
        word_lines(row.text, seen)
    return [seen[k] for k in sorted(seen) if seen[k]]


def labelled_sample(documents: DataFrame, labels: DataFrame, doc_id: str, text: str, lang: str, label: str, max_docs: int) -> list[Labelled]:
    """At most max_docs labelled documents (drawn by hash of the id) on whose content all their raters agree."""
    votes = (
        labels.select(F.col(doc_id).alias("doc"), F.lower(F.trim(F.col(label).cast("string"))).alias("label")).where("doc is not null and label is not null and label <> ''")
        .groupBy("doc").agg(F.collect_set("label").alias("kinds"), F.count(F.lit(1)).alias("votes")).where("not (array_contains(kinds, 'none') and size(kinds) > 1)")
    )
    votes = votes.join(F.broadcast(drawn_ids(votes.select("doc"), max_docs)), "doc")
    texts = documents.select(F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text <> ''")
    seen: dict = {}
    out = []
    for row in texts.join(F.broadcast(votes), "doc").collect():  # at most max_docs rows, but for repeated ids
        lines = word_lines(row.text, seen)
        target = np.array([float(k in row.kinds) for k in KINDS], np.float32)
        out.append((row.doc, Labelled(lines, target, language_key(row.lang))))
    return [d for _, d in sorted(out, key=lambda p: zlib.crc32(str(p[0]).encode()))]


def fit_documents(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "label", max_docs: int = 4000, max_background: int = 3000, seed: int = 11, least_positives: int = 30
) -> Classifier:
    """The classifier of a labelled corpus; its trainings run side by side on the cluster. Classifier can be pickled and reused."""
    sample, background = labelled_sample(documents, labels, doc_id, text, lang, label, max_docs), background_sample(documents, labels, doc_id, text, max_background)
    return fit_classifier(sample, background, seed, least_positives=least_positives, run=on_cluster(documents.sparkSession))


def score_documents(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "label", max_docs: int = 4000, max_background: int = 3000, seed: int = 11,
    least_positives: int = 30, model: Classifier | None = None,
) -> DataFrame:
    """doc, source, language, abuse, hate, sexual (probabilities of the worst line), score (worst logit over the threshold), flagged.

    Every row of documents comes out, with its whole text scored; NULL and empty texts score 0 and are not flagged. Languages
    without least_positives labelled documents of either kind share one threshold. Labels that are NULL, blank or on which
    raters disagree are not used; without any usable label the classifier is untrained and nothing is flagged. The fit is the
    only bounded part; with model (see fit_documents) nothing is fitted.
    """
    model = model or fit_documents(documents, labels, doc_id, text, lang, label, max_docs, max_background, seed, least_positives)
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = documents.schema[doc_id].dataType.simpleString()
    trained = bool(np.any(model.net.biases[0] != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        memory: dict[str, np.ndarray] = {}
        quiet = np.full(len(KINDS), -12.0, np.float32)
        for batch in batches:
            n = batch.num_rows
            texts = batch.column(1)
            out = np.tile(quiet, (n, 1))
            for lo in range(0, n, 1000):
                docs = [[k for k in map(line_key, (texts[i].as_py() or "").splitlines()) if k] for i in range(lo, min(n, lo + 1000))]
                fresh = list({k for d in docs for k in d if k not in memory})
                ids = [[word_id_cached(w) for w in line_words(k)] for k in fresh]
                memory.update(zip(fresh, score_lines(fitted.net, ids) if ids else [], strict=True))
                for i, d in enumerate(docs):
                    if d:
                        out[lo + i] = np.max([memory[k] for k in d], axis=0)
                if len(memory) > 200_000:
                    memory.clear()
            langs = [language_key(x.as_py()) for x in batch.column(2)]
            cut = np.array([fitted.thresholds.get(x, fitted.usual) for x in langs])
            over = out.max(axis=1) - cut
            p = 1 / (1 + np.exp(-out))
            flagged = (over > 0) & trained & (out.max(axis=1) > -12)
            arrays = [batch.column(0), batch.column(3), pa.array(langs), *[pa.array(p[:, k].astype(float)) for k in range(len(KINDS))], pa.array(over.astype(float)), pa.array(flagged)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc", "source", "language", *KINDS, "score", "flagged"])

    return documents.select(
        F.col(doc_id).alias("doc"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")
    ).mapInArrow(run, f"doc {kind}, source string, language string, abuse double, hate double, sexual double, score double, flagged boolean")


_IDS: dict[str, int] = {}


def word_id_cached(word: str) -> int:
    """word_id with a bounded memory."""
    got = _IDS.get(word)
    if got is None:
        if len(_IDS) > 500_000:
            _IDS.clear()
        got = _IDS[word] = word_id(word)
    return got


def rates(scored: DataFrame) -> DataFrame:
    """Per source: documents, flagged ones, rate."""
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged")).withColumn("rate", F.col("flagged") / F.col("documents"))
