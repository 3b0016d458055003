"""Abusive, hateful and sexual content by positive-unlabelled learning (problem 9).

A document is unfit if one statement in it is, so sentences are scored and the
worst one scores the document. Reviewers judge documents, therefore the
confirmed examples are found first: in each unfit document the sentence whose
words set unfit documents apart most, if they do so surely; documents without
one (wrong verdicts among them) stay unlabelled. A linear model on
hashed words and word pairs is then fitted to those examples against
unlabelled sentences with the non-negative risk estimator

    pi * R+(P) + max(0, R-(U) - pi * R-(P)),

pi being the share of unfit sentences. Letters are normalised before hashing,
so full-width or mathematical letters, look-alikes, hidden characters, split,
spaced, stretched or partly masked words look like the words themselves, or
at least leave their neighbours in place.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import cut

#: Bounds of the training sample, taken by the hash of the identifier.
MAX_LABELLED, MAX_UNLABELLED = 8000, 2000
#: Characters of the training sample at most; texts are taken in the order of the hash until it is full.
MAX_CHARACTERS = 60_000_000
#: Buckets of the feature hash.
BUCKETS = 1 << 18
#: Class prior: unfit sentences among all, as so many for each document found unfit.
PER_DOCUMENT = 1.1
#: Sum of log ratios beyond which a sentence surely is the one that the verdict meant.
SURE = 6.0
#: Fewer confirmed documents than this can't be learned from.
LEAST_POSITIVE = 4
#: Characters worked on at once; bounds the memory of a task.
CHUNK = 3_000_000

_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u202a-\u202e\u180e]")
_MIXED = re.compile(r"[A-Za-z][Ͱ-ϿЀ-ӿ]|[Ͱ-ϿЀ-ӿ][A-Za-z]")
_RUN = re.compile(r"[A-Za-zͰ-ϿЀ-ӿ]+")
#: Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = str.maketrans("асеорхуіјѕԁһкмтвнгѵαονιυκρτχε", "aceopxyijsdhkmtbhrvaoviukptxe")
_LEET = {ord(a): ord(b) for a, b in zip("013457@$!|", "oieastasil")}

OTHER, LETTER, DIGIT, SINGLE, END, BREAK, GLUE, SPACE = range(8)


def _classes() -> np.ndarray:
    table = np.zeros(0x10000, np.uint8)
    for o in range(0x10000):
        ch = chr(o)
        kind = unicodedata.category(ch)
        if kind[0] == "L" or kind[0] == "M":
            table[o] = SINGLE if 0x0E00 <= o < 0x0E80 or 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 else LETTER
        elif kind[0] == "N":
            table[o] = DIGIT
        elif kind[0] == "Z" or ch in "\t\x0b\x0c":
            table[o] = SPACE
    table[[ord(c) for c in ".!?…"]] = END
    table[[ord(c) for c in "\n\r\u2028\u2029。！？｡।؟"]] = BREAK
    table[[ord(c) for c in "-'’‐‑"]] = GLUE
    table[[ord(c) for c in "*@$"]] = OTHER
    return table


_CLASS = _classes()
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)


def plain(text: str) -> str:
    """Lower case, compatibility forms resolved, hidden characters out, look-alikes in Latin words replaced."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
        if _MIXED.search(text):
            text = _RUN.sub(lambda m: m[0].lower().translate(_LOOK_ALIKE) if _MIXED.search(m[0]) else m[0], text)
    return text.lower()


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all sentences: ``(bucket of each feature, its sentence, document of each sentence, features of each sentence)``."""
    lean = [plain(t) for t in texts]
    c = np.frombuffer("".join(t + "\n\n" for t in lean).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc_of = np.repeat(np.arange(len(lean), dtype=np.int32), np.array([len(t) + 2 for t in lean], np.int64))
    k = np.where(c < 0x10000, _CLASS[np.minimum(c, 0xFFFF)], np.where((c >= 0x20000) & (c < 0x40000), SINGLE, OTHER)).astype(np.uint8)

    def beside(flag: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flag), bool)
        out[1:-1] = flag[:-2] & flag[2:]
        return out

    letter = k == LETTER
    inside = beside(letter)
    # masked and substituted letters: a sign or digit between two letters
    sign = (c == 42) | (c == 64) | (c == 36)
    near = letter | sign | (k == DIGIT)
    odd = np.flatnonzero((sign | (k == DIGIT)) & beside(near))
    if len(odd):
        has = np.zeros(len(c), bool)
        has[odd] = True
        before = letter.copy()
        for _ in range(3):  # up to three signs in a row inside a word
            before[1:] |= before[:-1] & has[1:]
        after = letter.copy()
        for _ in range(3):
            after[:-1] |= after[1:] & has[:-1]
        mask = has & np.r_[False, before[:-1]] & np.r_[after[1:], False]
        at = np.flatnonzero(mask)
        c = c.copy()
        for a, b in _LEET.items():
            c[at[c[at] == a]] = b
        k[at] = LETTER
        letter = k == LETTER
    # a sign at the start of a word: $ick
    start = np.flatnonzero(sign[:-1] & letter[1:] & (k[:-1] != LETTER))
    if len(start):
        c = c.copy()
        for a, b in _LEET.items():
            c[start[c[start] == a]] = b
        k[start] = LETTER
        letter = k == LETTER
    keep = ~((k == GLUE) & inside)
    # stretched words: three or more of one letter count as one
    same = np.zeros(len(c), bool)
    same[1:] = (c[1:] == c[:-1]) & letter[1:]
    triple = np.zeros(len(c), bool)
    triple[2:] = same[2:] & same[1:-1]
    long = triple.copy()
    long[:-1] |= triple[1:]
    keep &= ~long
    # spaced words: three or more single letters one space apart
    alone = letter & np.r_[True, ~letter[:-1]] & np.r_[~letter[1:], True]
    step = np.zeros(len(c), bool)
    step[2:] = alone[2:] & alone[:-2] & (k[1:-1] == SPACE)
    chain = np.zeros(len(c), bool)
    chain[2:] = step[2:] & step[:-2]
    chain[:-2] |= chain[2:] & step[:-2]
    gaps = np.flatnonzero(chain & step) - 1
    keep[gaps] = False
    c, k, doc_of = c[keep], k[keep], doc_of[keep]
    # sentences end at a break, or at a full stop before a space
    ends = k == BREAK
    ends[:-1] |= (k[:-1] == END) & ((k[1:] == SPACE) | (k[1:] == BREAK))
    sentence_at = np.cumsum(ends) - ends
    word = (k == LETTER) | (k == DIGIT) | (k == SINGLE)
    first = word.copy()
    first[1:] &= (k[1:] != k[:-1]) | (k[1:] == SINGLE)
    # letters and digits in one word stay together
    joint = np.zeros(len(c), bool)
    joint[1:] = ((k[1:] == LETTER) & (k[:-1] == DIGIT)) | ((k[1:] == DIGIT) & (k[:-1] == LETTER))
    first &= ~joint
    begin = np.flatnonzero(first)
    if not len(begin):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    group = np.cumsum(first) - 1
    value = np.where(word, (c.astype(np.uint64) + np.uint64(1)) * _powers(len(c), _BASE), np.uint64(0))
    h = np.add.reduceat(np.where(group >= 0, value, np.uint64(0)), begin) * _powers(len(c), _INVERSE)[begin]
    number = np.add.reduceat(((k == LETTER) | (k == SINGLE)).astype(np.int32), begin) == 0
    h[number] = np.uint64(7)
    h = (h ^ (h >> np.uint64(29))) * _MIX
    s = sentence_at[begin]
    pair = (h[:-1] * np.uint64(3) + (h[1:] ^ (h[1:] >> np.uint64(31)))) * _BASE
    linked = s[1:] == s[:-1]
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    bucket = np.concatenate([h >> shift, pair[linked] >> shift]).astype(np.int64)
    owner = np.concatenate([s, s[1:][linked]])
    used, owner = np.unique(owner, return_inverse=True)
    doc = np.zeros(len(used), np.int64)
    doc[np.searchsorted(used, s)] = doc_of[begin]
    return bucket, owner, doc, np.bincount(owner, minlength=len(used))


class Model:
    """Linear model of a sentence; a document scores as its worst sentence."""

    def __init__(self) -> None:
        self.w, self.b, self.threshold = np.zeros(BUCKETS, np.float32), -8.0, 0.0

    def sentence_scores(self, bucket: np.ndarray, owner: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.bincount(owner, self.w[bucket], len(size)) / np.sqrt(np.maximum(size, 4)) + self.b

    def document_scores(self, texts: list[str | None]) -> np.ndarray:
        """Worst sentence of each text, as a probability; 0 for a text without words."""
        out = np.full(len(texts), -np.inf)
        at = 0
        while at < len(texts):
            stop, n = at, 0
            while stop < len(texts) and (stop == at or n + len(texts[stop] or "") <= CHUNK):
                n += len(texts[stop] or "")
                stop += 1
            bucket, owner, doc, size = features([t or "" for t in texts[at:stop]])
            if len(size):
                np.maximum.at(out, doc + at, self.sentence_scores(bucket, owner, size))
            at = stop
        return 1 / (1 + np.exp(-(out - self.threshold)))


class Sentences:
    """Features of the sentences of a training sample, by rows."""

    def __init__(self, texts: list[str]):
        buckets, owners, docs, fulls = [], [], [], []
        often = np.zeros(BUCKETS, np.int32)
        at, first = 0, 0
        while at < len(texts):
            # by chunks of a million characters: the working memory stays small
            stop, n = at, 0
            while stop < len(texts) and (stop == at or n + len(texts[stop]) <= 1_000_000):
                n += len(texts[stop])
                stop += 1
            bucket, owner, doc, size = features(texts[at:stop])
            often += np.bincount(np.unique(doc[owner] * BUCKETS + bucket) % BUCKETS, minlength=BUCKETS).astype(np.int32)
            order = np.argsort(owner, kind="stable")
            buckets.append(bucket[order].astype(np.int32))
            owners.append((owner[order] + first).astype(np.int32))
            docs.append((doc + at).astype(np.int32))
            fulls.append(size)
            first += len(size)
            at = stop
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        bucket, owner, self.doc, self.full = join(buckets, np.int32), join(owners, np.int32), join(docs, np.int32), join(fulls, np.int64)
        del buckets, owners
        # features of a single document teach nothing: those of two or more get a compact number
        kept = often >= 2
        self.buckets = np.flatnonzero(kept)
        number = (np.cumsum(kept) - 1).astype(np.int32)
        use = kept[bucket]
        self.bucket, self.owner = number[bucket[use]], owner[use]
        self.size = np.bincount(self.owner, minlength=len(self.full))
        self.start = np.r_[0, np.cumsum(self.size)[:-1]] if len(self.size) else np.zeros(0, np.int64)
        self.scale = 1 / np.sqrt(np.maximum(self.full, 4))
        self.n = len(texts)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.size[rows]
        ends = np.cumsum(n)
        at = np.repeat(self.start[rows] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        return self.bucket[at], np.repeat(np.arange(len(rows)), n), n

    def scores(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.owner, w[self.bucket], len(self.size)) * self.scale + b

    def worst(self, score: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and score of the best-scoring sentence of each of ``docs``; row -1 for a document without words."""
        order = np.lexsort((score, self.doc))
        last = np.full(self.n, -1, np.int64)
        last[self.doc[order]] = order
        rows = last[docs]
        return rows, np.where(rows >= 0, score[rows], -np.inf)


def _contrast(rows: Sentences, positive: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Weight of each feature that sets the positive documents apart: log ratio of document frequencies where it is sure."""
    k = len(rows.buckets)
    seen = np.unique(rows.doc[rows.owner].astype(np.int64) * k + rows.bucket)
    chosen = np.zeros(rows.n, bool)
    chosen[positive] = True
    ours = chosen[seen // k]
    seen %= k
    a = (np.bincount(seen[ours], minlength=k) + 0.5) / (len(positive) + 1)
    b = (np.bincount(seen[~ours], minlength=k) + 0.5) / (len(rest) + 1)
    z = (a - b) / np.sqrt(a / (len(positive) + 1) + b / (len(rest) + 1))
    return np.where((z > 2) & (a > 3 * b), np.log(a / b), 0.0)


def fit(rows: Sentences, positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 10, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by Adam over mini-batches."""
    rng = np.random.default_rng(0)
    k = len(rows.buckets)
    w, b = np.zeros(k), -3.0
    m, v, mb, vb, t = np.zeros(k), np.zeros(k), 0.0, 0.0, 0
    sig = lambda z: 1 / (1 + np.exp(-z))
    fp, rp, _ = rows.take(positive)
    scale_p = rows.scale[positive]
    for epoch in range(epochs):
        order = rng.permutation(unlabelled)
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(order, max(1, len(order) // 8192)):
            fu, ru, _ = rows.take(batch)
            scale_u = rows.scale[batch]
            zp, zu = np.bincount(rp, w[fp], len(positive)) * scale_p + b, np.bincount(ru, w[fu], len(batch)) * scale_u + b
            if np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() >= 0:
                gp, gu = np.full(len(positive), -prior), sig(zu)
            else:  # the risk of the negatives fell below zero: only the positive risk counts
                gp, gu = prior * (sig(zp) - 1), np.zeros(len(batch))
            gp, gu = gp / len(positive), gu / len(batch)
            g = np.bincount(fp, (gp * scale_p)[rp], k) + np.bincount(fu, (gu * scale_u)[ru], k) + 1e-7 * w
            gb = gp.sum() + gu.sum()
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            rate_t = step * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w -= rate_t * m / (np.sqrt(v) + 1e-8)
            b -= rate_t * mb / (np.sqrt(vb) + 1e-8)
    return w, float(b)


def learn(texts: list[str], verdicts: np.ndarray, prior: float | None = None) -> Model | None:
    """Model from texts with verdicts: 1 unfit, 0 fit, -1 unlabelled. None if too few are unfit."""
    positive = np.flatnonzero(verdicts == 1)
    if len(positive) < LEAST_POSITIVE:
        return None
    rows = Sentences(texts)
    rest = np.flatnonzero(verdicts != 1)
    everything = np.arange(len(rows.size))
    if prior is None:
        prior = PER_DOCUMENT * len(positive) / len(everything)
    # first guess of the sentence meant by each verdict
    weight = _contrast(rows, positive, rest)
    guess = np.bincount(rows.owner, weight[rows.bucket], len(everything))
    picks, strength = rows.worst(guess, positive)
    chosen = picks[strength > SURE]
    if len(chosen) < LEAST_POSITIVE:
        # too few verdicts to be sure of any: the clearer half of what there is
        chosen = picks[(strength > 0) & (strength >= np.median(strength))]
    if not len(chosen):
        return None
    w, b = fit(rows, chosen, everything, prior)
    model = Model()
    model.w[rows.buckets] = w
    _, z = rows.worst(rows.scores(w, b), np.arange(len(verdicts)))
    model.b, model.threshold = b, _threshold(z, verdicts)
    return model


def _threshold(z: np.ndarray, verdicts: np.ndarray) -> float:
    """Of the cuts that agree with the verdicts nearly as well as the best one, that with the fewest documents nearby."""
    y, judged = verdicts == 1, z[verdicts >= 0]
    cuts = np.arange(-4, 3.01, 0.05)
    f1 = np.array([2 * (y & (z > c)).sum() / max(1, y.sum() + (judged > c).sum()) for c in cuts])
    good = cuts[f1 >= f1.max() - 0.01]
    near = np.array([(np.abs(z - c) < 0.3).sum() for c in good])
    return float(np.median(good[near == near.min()]))


def training_sample(documents: DataFrame, labels: DataFrame, key: str, text: str, verdict: str, max_labelled: int, max_unlabelled: int, max_characters: int = MAX_CHARACTERS) -> pd.DataFrame:
    """``text, verdict`` of at most so many labelled and unlabelled documents, by the hash of their key, and at most so many characters.

    Verdicts of one document are settled by majority; ties and nulls count as
    unlabelled.
    """
    judged = labels.where(F.col(key).isNotNull() & F.col(verdict).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.avg(F.col(verdict).cast("double")).alias("p"))
    judged = judged.where("p <> 0.5").select("k", (F.col("p") > 0.5).cast("int").alias("verdict")).orderBy(F.xxhash64("k"), "k").limit(max_labelled)
    others = documents.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.lit(-1).alias("verdict")).orderBy(F.xxhash64("k", F.lit(1)), "k").limit(max_unlabelled)
    # at most max_labelled + max_unlabelled identifiers are broadcast
    wanted = judged.union(others).groupBy("k").agg(F.max("verdict").alias("verdict"))
    sample = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).cast("string").alias("text")).join(F.broadcast(wanted), "k")
    sample = cut(sample.withColumn("h", F.xxhash64("k")))
    # only keys and lengths come to the driver before the bound holds
    sizes = sample.select("k", "h", F.length("text").alias("n")).orderBy("h", "k").toPandas()
    if sizes["n"].sum() > max_characters:
        last = sizes["h"][int((sizes["n"].cumsum() <= max_characters).sum()) - 1] if sizes["n"][0] <= max_characters else sizes["h"].min() - 1
        sample = sample.where(F.col("h") <= int(last))
    return sample.select("k", "verdict", "text").orderBy("k").toPandas()


def score_documents(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", verdict: str = "unfit", keep: list[str] | None = None, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> DataFrame:
    """``key, *keep, score, unfit``: every document with the probability of its worst sentence.

    The model is fitted on a bounded sample (``max_labelled`` documents with
    verdicts, ``max_unlabelled`` others, ``MAX_CHARACTERS`` in all) and applied
    to every whole text. It needs some thousand verdicts: with a few hundred,
    of which a dozen unfit, it finds less than half of the unfit documents
    among several times as many fit ones, and should not be used. Null,
    empty and wordless texts score 0; repeated rows are scored each; with fewer
    than ``LEAST_POSITIVE`` confirmed documents every score is 0; an empty
    table gives no row; further columns are not read.
    """
    keep = keep or []
    sample = training_sample(documents, labels, key, text, verdict, max_labelled, max_unlabelled)
    model = learn(sample["text"].tolist(), sample["verdict"].to_numpy(np.int64), prior) if len(sample) else None
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias(key), *[F.col(c).alias(c) for c in keep], F.col(text).cast("string").alias("__text"))
    types = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, *keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(len(keep) + 1).to_pylist()
            score = model.document_scores(texts) if model else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array(score > 0.5, pa.bool_())], [key, *keep, "score", "unfit"])

    return rows.mapInArrow(run, ", ".join([*types, "score double", "unfit boolean"]))


def rates(scored: DataFrame, source: str = "source") -> DataFrame:
    """``source, n_documents, n_unfit, rate, mean_score``; a null source is one of its own."""
    return scored.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_documents"), F.count_if("unfit").alias("n_unfit"), F.avg(F.col("unfit").cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
