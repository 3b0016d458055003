"""Speech transcripts into clean, ordered speaker turns (problem 5).

Three parts work together. Tokens of a caption line are classified as spoken
or filler: sound notes, times and set-off phrases by their form, hesitation
sounds by their letters and, where these could also be an abbreviation or a
word, by boosted trees on the context of the token. Speaker labels are
normalised against the full names of their call. Boosted trees decide whether
words before a colon or dash that fit a speaker are a label or speech, and for
each pair of adjacent segments whether a new turn begins, from the labels, the
gap and the text on both sides; in training half of the labels are hidden, so
that gap and context have to speak for themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.skew import salted_lookup
from earshot.session import cut

#: Positions that one window handles; longer calls go in blocks of this size.
BLOCK = 4096
#: Labelled lines the boundary model is fitted on at most.
TRAIN_LINES = 20_000
OPERATOR, UNIDENTIFIED = "operator", "unidentified analyst"

_ARROW_TIME = re.compile(r"\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?\s*-->\s*\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?")
_BRACKET_TIME = re.compile(r"[\[(<{]\s*\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?\s*[\])>}]")
_LONG_TIME = re.compile(r"(?<![\d:])\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?(?![\d:])")
_LEAD_TIME = re.compile(r"^\s*\d{1,2}:\d{2}(?:\.\d+)?(?=\s*[-–—]\s|\s+[A-Z\[(<]|\s*$)(?!\s*[ap]\.?m)", re.I)
_SOUND_WORDS = (
    "inaudible indiscernible unintelligible laughter laughs laughing applause clapping crosstalk music coughs coughing cough breath breathing sighs sigh noise silence pause static "
    "beep chuckles technical difficulty difficulties operator instructions phone rings ringing background foreign language no response audio gap break overlapping speakers cheering"
).split()
_SOUND = re.compile(r"[\[({<*]\s*/?\s*(?:(?:" + "|".join(sorted(_SOUND_WORDS, key=len, reverse=True)) + r")\b[\s/,]*)+[\])}>*]|[♪♫]+", re.I)
#: Hesitation sounds: fixed forms with any number of repeats.
_HESITATION = re.compile(r"(?:u+h+m*|u+m+|e+rm*|e+r{3,}m*|e+h+|a+h+m*|h+m+|m{2,}|mm+-?h+mm*|uh-?huh|m+h+m+)", re.I)
_PHRASE = re.compile(r"(?:(?<=,)|(?<=[.?!:;–—-])|^)(\s*)(?:you know|i mean)\s*(?:,|(?=[.?!]|\s*$))", re.I)
_PHRASE_WORDS = re.compile(r"you know|i mean", re.I)
_NOTE_SIGN = re.compile(r"[\[({<*♪♫]")
_MAY_HESITATE = re.compile(r"[^\w]*[uhermaUHERMA-]+[^\w]*$").match
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_TITLE = re.compile(r"\b(?:officer|president|director|head|relations|analyst|chair\w*|manager|treasurer|counsel|partner|founder|secretary|controller|ceo|cfo|coo|cto|vp|svp|evp)\b", re.I)
_HONORIFIC = re.compile(r"^(?:mr|mrs|ms|miss|dr|prof|sir|madam)\b\.?\s*", re.I)
_NAME = re.compile(r"^[^\W\d_][^\W\d_'’.-]*(?:[\s-][^\W\d_][\w'’.-]*){0,3}$")


#: Hesitation sounds that nothing else is written like, in any case; the others may be abbreviations if in capitals (ERM, ER, EH, AH, MM).
_CERTAIN = re.compile(r"(?:u+h+m*|u+m+|h+m+|uh-?huh|m+h+m+|mm+-?h+mm*)", re.I)
_LETTER = re.compile(r"[^\W_]")
TOKEN_FEATURES = ["capitals", "sentence_start", "after_comma", "comma", "dots", "before_capital", "before_i", "alone"]


def token_context(core: str, piece: str, before: str | None, following: str | None) -> list[float]:
    """Features of a token: its case, its marks and the pieces on both sides."""
    mark = piece[piece.rfind(core) + len(core) :][:1]
    return [
        float(core.isupper() and len(core) > 1),
        float(before is None or before[-1] in ".?!"),
        float(before is not None and before[-1] == ","),
        float(mark == ","),
        float(mark in ("…", ".")),
        float(bool(following) and following[0].isupper()),
        float(following == "I"),
        float(not following),
    ]


def token_examples(text: str) -> list[tuple]:
    """``(features, y)`` of the tokens of a line, behind its label, that are surely hesitations (1) or surely words in capitals or at the start of a sentence (0)."""
    pieces = [p for p in text_label(without_notes(text))[1].split() if _LETTER.search(p)]
    cores = [_EDGES.sub("", p) for p in pieces]
    out = []
    for k, core in enumerate(cores):
        sure = bool(_CERTAIN.fullmatch(core))
        if sure or not _HESITATION.fullmatch(core) and core.isalpha() and (core.isupper() and len(core) > 1 or k == 0 or pieces[k - 1][-1] in ".?!"):
            following = next((c for c in cores[k + 1 :] if not _CERTAIN.fullmatch(c)), None)
            before = next((pieces[j] for j in range(k - 1, -1, -1) if not _CERTAIN.fullmatch(cores[j])), None)
            out.append((token_context(core, pieces[k], before, following), float(sure)))
    return out


def is_filler(piece: str, before: str | None, following: str | None, model: Boosted | None = None) -> bool:
    """Whether a white-space piece is a hesitation sound; one in capitals that may be an abbreviation is judged by its context.

    Without a model the context speaks for a hesitation if the token stands at
    the start of a sentence and before another start.
    """
    core = _EDGES.sub("", piece)
    if not core or not _HESITATION.fullmatch(core):
        return False
    if not core.isupper() or _CERTAIN.fullmatch(core):
        return True
    context = token_context(core, piece, before, following)
    if model is None:
        return bool(context[1] and context[5] and not context[6])
    return bool(model.decide(np.array([context]))[0])


def without_times(text: str) -> str:
    if ":" not in text:
        return text
    text = _ARROW_TIME.sub(" ", text)
    text = _BRACKET_TIME.sub(" ", text)
    text = _LONG_TIME.sub(" ", text)
    return _LEAD_TIME.sub(" ", text)


def without_notes(text: str) -> str:
    """A text without caption times and sound notes."""
    text = without_times(text)
    return _SOUND.sub(" ", text) if _NOTE_SIGN.search(text) else text


def spoken_words(text: str, model: Boosted | None = None) -> list[str]:
    """The words said in a text that has no label, times and sound notes any more: white-space pieces with a letter or digit."""
    pieces = text.split()
    if any(map(_MAY_HESITATE, pieces)):
        pieces = [p for p in pieces if _LETTER.search(p) or p[-1] in ",.?!;:"]
        cores = [_EDGES.sub("", p) if _MAY_HESITATE(p) else "" for p in pieces]
        sounds = [bool(c) and bool(_HESITATION.fullmatch(c)) for c in cores]
        kept: list[str] = []
        for k, p in enumerate(pieces):
            if sounds[k]:
                following = None
                if cores[k].isupper():
                    following = next((_EDGES.sub("", pieces[j]) for j in range(k + 1, len(pieces)) if not sounds[j] and _LETTER.search(pieces[j])), None)
                if is_filler(p, kept[-1] if kept else None, following, model):
                    # its comma still sets off what stands beside it
                    if kept and kept[-1][-1] not in ",.?!;:" and p[-1] in ",":
                        kept.append(",")
                    continue
            kept.append(p)
        pieces = kept
    line = " ".join(pieces)
    if _PHRASE_WORDS.search(line):
        line = re.sub(r"\s+([,.?!;:])", r"\1", line)
        while (shorter := _PHRASE.sub(r"\1", line)) != line:
            line = shorter
        pieces = line.split()
    return [p for p in pieces if _LETTER.search(p)]


def spoken(text: str, model: Boosted | None = None) -> list[str]:
    """The words of a line without label that were said."""
    return spoken_words(without_notes(text), model)


def fold(name: str) -> str:
    """Lower case, composed, single spaces."""
    return " ".join(unicodedata.normalize("NFC", name).casefold().split())


def parse_label(label: str | None) -> str | None:
    """A speaker label without times, marks and role letters; None if it says nothing."""
    if label is None:
        return None
    label = without_notes(label).strip()
    if (m := re.fullmatch(r"[<\[(]\s*(.*?)\s*[>\])]", label)) and not re.search(r"[<>\[\]()]", m[1]):
        label = m[1]
    label = re.sub(r"^\s*[AQ]\s*[-–—:]\s+", "", label)
    label = re.sub(r"[\s:–—-]+$", "", re.sub(r"^[\s:–—-]+", "", label))
    return " ".join(label.split()) if re.search(r"[^\W\d_]", label) else None


#: What tells a label before the text from speech: brackets or a colon, a capital behind it, its words and commas.
PREFIX_FEATURES = ["marked", "capital", "n_words", "upper", "comma"]
_LABEL_FORMS = [r"\[(?P<b>[^\[\]]{2,80})\]\s*[:–—-]*", r"<(?P<a>[AQ] - [^<>]{2,80})>", r"(?P<c>[^:\[\]<>]{2,80}?)\s*:(?=\s)", r"(?P<d>[^\[\]<>:]{2,80}?)\s+(?:--|–|—|-)(?=\s)"]
_TEXT_LABEL = re.compile(rf"^\s*(?:{'|'.join(_LABEL_FORMS)})\s*")
_DASH_LABEL = re.compile(rf"^\s*(?:{'|'.join([_LABEL_FORMS[0], _LABEL_FORMS[1], r'(?P<c>(?!))', _LABEL_FORMS[3]])})\s*")


def text_label(lean: str) -> tuple[str | None, str, list[float]]:
    """``(label, rest, features)`` of a line without times and notes that may begin with a label; whether it is one is decided by ``PREFIX_FEATURES`` and the speakers of the call."""
    m = _TEXT_LABEL.match(lean)
    if m and m["c"] and (dash := _DASH_LABEL.match(lean)) and dash.end() < m.end():
        # a colon behind a dash: a title or firm stands between them, or the text has begun
        inner = [w for w in m["c"][dash.end() :].split() if w not in ("of", "and", "&")]
        if not inner or sum(w[0].isupper() for w in inner) < 0.75 * len(inner):
            m = dash
    label = parse_label(m["b"] or m["a"] or m["c"] or m["d"]) if m else None
    if not label or len(label.split()) > 9:
        return None, lean, []
    if not re.match(r"[A-Z\W]", label) and fold(label) not in (OPERATOR, "the operator", UNIDENTIFIED):
        return None, lean, []
    rest = lean[m.end() :]
    words = [w for w in re.split(r"[\s,]+", label) if w]
    upper = sum(w[0].isupper() for w in words) / max(1, len(words))
    return label, rest, [float(m["d"] is None), float(bool(re.match(r"\W*[A-Z0-9]", rest))), float(len(words)), upper, float("," in label)]


def split_label(label: str) -> tuple[str, str]:
    """``(name, description)``: description holds title or firm, the name may be empty."""
    m = re.match(r"^(.*?)\s*(?:\s[-–—]+\s|\(|,)\s*(.*?)\)?$", label)
    name, rest = (m[1].strip(), m[2].strip()) if m else (label, "")
    if m and not re.search(r"[-–—(]", label[: m.end(1) + 3]) and rest and not _TITLE.search(rest) and len(rest.split()) <= 2 and len(name.split()) == 1:
        return f"{rest} {name}", ""  # last name first
    if not rest and _TITLE.search(name):
        return "", name
    return name, rest


def close(a: str, b: str) -> bool:
    """One typing slip apart: a letter more, less, other or two exchanged."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def _initials(title: str) -> str:
    return "".join(w[0] for w in title.split() if w != "of")


def _variants(word: str) -> set[str]:
    """Keys of which two words one slip apart share at least one."""
    return {word, *(word[:k] + word[k + 1 :] for k in range(len(word)))}


class Roster:
    """The speakers of one call, told by the labels of its speaker column, and the look-up of any label among them.

    Full names with a title or firm are taken as spelled; other full names are
    speakers unless they are one slip from a more frequent one. Last names,
    initials, titles alone and slips are looked up by index.
    """

    def __init__(self, labels: dict[str, int]):
        full: Counter = Counter()
        described: dict[str, str] = {}
        for label, n in labels.items():
            name, rest, words = self._parts(label)
            if len(words) == 2 and len(words[0].rstrip(".")) > 1 and not _HONORIFIC.match(fold(name)) and fold(name) not in ("the operator", UNIDENTIFIED) and _NAME.match(name):
                key = " ".join(words)
                full[key] += n + (1000 if rest else 0)
                if rest:
                    described.setdefault(rest, key)
        self.names: set[str] = set()
        self.near: dict[str, list[str]] = {}
        self.last: dict[str, list[str]] = {}
        self.near_last: dict[str, list[str]] = {}
        for name, _ in full.most_common():
            if any(close(name, r) for v in _variants(name) for r in self.near.get(v, ())):
                continue
            self.names.add(name)
            last = name.split()[-1]
            self.last.setdefault(last, []).append(name)
            for v in _variants(name):
                self.near.setdefault(v, []).append(name)
            for v in _variants(last):
                self.near_last.setdefault(v, []).append(name)
        self.titles: dict[str, set[str]] = {}
        for rest, name in described.items():
            for key in (rest, _initials(rest)):
                self.titles.setdefault(key, set()).add(name)

    @staticmethod
    def _parts(label: str) -> tuple[str, str, list[str]]:
        name, rest = split_label(label)
        flat = _HONORIFIC.sub("", fold(name)).split()
        return name, fold(rest), [w for w in flat if not re.fullmatch(r"[^\W\d_]\.?", w) or w == flat[0]]

    def _by_last(self, word: str) -> list[str]:
        return self.last.get(word) or [r for v in _variants(word) for r in self.near_last.get(v, ()) if close(r.split()[-1], word)]

    def speaker(self, label: str) -> str | None:
        """"first last", operator, unidentified analyst, or None if the label names nobody."""
        _, rest, words = self._parts(label)
        whole, plain = " ".join(words), fold(label)
        if whole in (OPERATOR, "the operator") or plain in (OPERATOR, "the operator"):
            return OPERATOR
        if "unidentified" in plain or "unknown" in plain or plain == "analyst":
            return UNIDENTIFIED
        if whole in self.names:
            return whole
        if not words:
            hits = self.titles.get(rest, set())
        elif len(words) == 2 and len(words[0].rstrip(".")) == 1:
            hits = {r for r in self._by_last(words[1]) if r[0] == words[0][0]}
        elif len(words) == 1:
            hits = set(self._by_last(words[0]))
        else:
            hits = {r for v in _variants(whole) for r in self.near.get(v, ()) if close(r, whole)} or {r for r in [" ".join(words[::-1])] if r in self.names}
        if not hits and words and close(whole, OPERATOR):
            return OPERATOR
        return next(iter(hits)) if len(hits) == 1 else None


def resolve_labels(labels: dict[str, int], in_text: dict[str, int] | None = None) -> dict[str, str | None]:
    """Speaker of each label of one call; labels cut from the text (``in_text``) add no speaker of their own."""
    roster = Roster(labels)
    return {label: roster.speaker(label) for label in [*(in_text or {}), *labels]}


class Boosted:
    """Gradient-boosted trees of depth two for the logistic loss, on a few numeric features."""

    def __init__(self, trees: int = 30, rate: float = 0.5):
        self.trees, self.rate, self.model, self.base = trees, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        """``weight``: how often each row counts."""
        weight = np.ones(len(y)) if weight is None else weight
        rate = min(max(float(np.average(y, weights=weight)), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        # possible splits: every feature at a few of its quantiles
        splits = [(f, float(c)) for f in range(x.shape[1]) for c in np.unique([*np.quantile(x[:, f], [0.05, 0.25, 0.5, 0.75, 0.95]), x[:, f].mean()]) if (x[:, f] > c).any()]
        if not splits:
            return self
        left = np.column_stack([x[:, f] <= c for f, c in splits]).astype(np.float64)

        def best(g: np.ndarray, h: np.ndarray) -> int:
            total_g, total_h, a, b = g.sum(), h.sum(), g @ left, h @ left
            return int(np.argmax(a * a / (b + 1) + (total_g - a) ** 2 / (total_h - b + 1)))

        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            k = best(g, h)
            tree = []
            for side in (left[:, k], 1 - left[:, k]):
                k2 = best(g * side, h * side)
                leaf = []
                for part in (side * left[:, k2], side * (1 - left[:, k2])):
                    leaf.append(float(self.rate * (g @ part) / (h @ part + 1)))
                    score += leaf[-1] * part
                tree.append((*splits[k2], *leaf))
            self.model.append((*splits[k], tree))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row."""
        score = np.full(len(x), self.base)
        for f, cut, tree in self.model:
            for side, (f2, cut2, low, high) in zip((x[:, f] <= cut, x[:, f] > cut), tree):
                score += side * np.where(x[:, f2] <= cut2, low, high)
        return score

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.score(x) > 0


FEATURES = ["labelled", "same", "prefix", "prefix_same", "gap", "asked", "ended", "words", "words_before", "thanks"]
_LINES = pa.schema([("call", pa.int64()), ("pos", pa.int64()), ("line", pa.int64()), ("label", pa.string()), ("in_text", pa.string()), ("prefix", pa.list_(pa.float64())), ("n_all", pa.int64()), ("n_rest", pa.int64()), ("asks", pa.bool_()), ("ends", pa.bool_()), ("thanks", pa.bool_())])
_LINES_TYPE = "call bigint, pos bigint, line bigint, label string, in_text string, prefix array<double>, n_all bigint, n_rest bigint, asks boolean, ends boolean, thanks boolean"
_THANKS = re.compile(r"\W*(?:thanks?|good (?:morning|afternoon|evening|day)|hello|hi|yes|yeah|sure|okay|please)\b", re.I)


def _parser(model: Boosted | None) -> Callable:
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            call, pos, line, speaker, text = (batch.column(i) for i in range(5))
            rows: list[tuple] = []
            labels: dict[str | None, str | None] = {}
            for s, t in zip(speaker.to_pylist(), text.to_pylist()):
                if s not in labels:
                    labels[s] = parse_label(s)
                lean = without_notes(t or "")
                label, rest, prefix = text_label(lean)
                n = len(spoken_words(lean, model))
                tail = lean.rstrip()[-1:]
                rows.append((labels[s], label, prefix, n, len(spoken_words(rest, model)) if label else n, tail == "?", tail in (".", "!", "?"), bool(_THANKS.match(rest))))
            if rows:
                yield pa.RecordBatch.from_arrays([call, pos, line, *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_LINES)[3:]))], schema=_LINES)

    return parse


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (call, label, in_text?, n), the labels of a call's column before those cut from its text -> (call, label, speaker).

    Only the labels of the column are held; those of the text are looked up as they pass.
    """
    schema = pa.schema([("call", pa.int64()), ("label", pa.string()), ("speaker", pa.string())])
    call, columns, roster = None, {}, None

    for batch in batches:
        out: list[tuple] = []
        for c, label, inside, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if c != call or inside and roster is None:
                if c != call and columns:
                    roster = roster or Roster(columns)
                    out += [(call, k, v) for k in columns if (v := roster.speaker(k))]
                if c != call:
                    call, columns, roster = c, {}, None
            if not inside:
                columns[label] = n
            else:
                roster = roster or Roster(columns)
                if label not in columns and (v := roster.speaker(label)):
                    out.append((call, label, v))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
    if columns:
        roster = roster or Roster(columns)
        if out := [(call, k, v) for k in columns if (v := roster.speaker(k))]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)


def _carry(rows: DataFrame, value: str, name: str, current: bool) -> DataFrame:
    """Add ``name``: the last non-null ``value`` before each row of its call (up to it with ``current``), block by block."""
    w = Window.partitionBy("call", "block").orderBy("pos", "line").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    ends = rows.where(F.col(value).isNotNull()).groupBy("call", "block").agg(F.max_by(value, F.struct("pos", "line")).alias("__end"))
    blocks = rows.select("call", "block").distinct().join(ends, ["call", "block"], "left")
    over = Window.partitionBy("call").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("call", "block", F.last("__end", ignorenulls=True).over(over).alias("__before"))
    out = rows.withColumn("__within", F.last(value, ignorenulls=True).over(w)).join(before, ["call", "block"])
    return out.withColumn(name, F.coalesce("__within", "__before")).drop("__within", "__before")


def fit_fillers(lines: DataFrame, text: str = "text") -> Boosted | None:
    """Context model of hesitation sounds, from the sure tokens of at most ``TRAIN_LINES`` lines taken by hash; None if there is too little to learn from."""
    sample = lines.select(F.col(text).alias("t")).where("t is not null").select("t", F.xxhash64("t").alias("h")).orderBy("h").limit(TRAIN_LINES)
    schema = pa.schema([("x", pa.list_(pa.float64())), ("y", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter((tuple(x), y) for t in batch.column(0).to_pylist() for x, y in token_examples(t))
            yield pa.RecordBatch.from_arrays([pa.array([list(x) for x, _ in counts], schema[0].type), pa.array([y for _, y in counts], pa.float64()), pa.array(list(counts.values()), pa.int64())], schema=schema)

    # the features are yes or no: a few hundred distinct rows whatever the number of lines
    found = sample.repartition(16, "h").select("t").mapInArrow(run, "x array<double>, y double, n bigint").groupBy("x", "y").agg(F.sum("n").alias("n")).toPandas()
    if len(found) < 4 or found["y"].nunique() < 2 or found["n"].sum() < 50:
        return None
    return Boosted().fit(np.array(found["x"].tolist(), float), found["y"].to_numpy(float), found["n"].to_numpy(float))


def fit_prefixes(parsed: DataFrame, speakers: DataFrame) -> Boosted | None:
    """Whether words before a colon, dash or bracket are a label: learned from at most ``TRAIN_LINES`` lines without speaker column whose prefix surely is one (a full name, or the operator, of its call) or surely is none (it fits nobody).

    The prefix's being a name is what is to be told, so it is no feature.
    """
    cand = parsed.where("in_text is not null and label is null").select("call", "in_text", "prefix")
    known = salted_lookup(cand, speakers.select("call", F.col("label").alias("in_text"), "speaker"), ["call", "in_text"], "left", salts=4)
    full = F.lower("in_text") == F.lower("speaker")
    sample = known.where(F.col("speaker").isNull() | full).select("prefix", F.col("speaker").isNotNull().cast("double").alias("y"), F.xxhash64("call", "in_text").alias("h")).orderBy("h").limit(TRAIN_LINES).toPandas()
    if len(sample) < 50 or sample["y"].nunique() < 2:
        return None
    return Boosted().fit(np.array(sample["prefix"].tolist(), float), sample["y"].to_numpy(float))


def labelled_lines(lines: DataFrame, call: str, position: str, line: str, speaker: str, text: str) -> DataFrame:
    """Lines with words: ``call, pos, line, block, speaker`` (null: no label), ``prefix, words, asks, ends, thanks``; each line once."""
    raw = lines.where(F.col(call).isNotNull() & F.col(position).isNotNull()).select(
        F.col(call).cast("bigint"), F.col(position).cast("bigint"), F.coalesce(F.col(line).cast("bigint"), F.xxhash64(call, position, text)), F.col(speaker).cast("string"), F.col(text).cast("string").alias("text")
    )
    parsed = raw.mapInArrow(_parser(fit_fillers(raw)), _LINES_TYPE).dropDuplicates(["call", "line"])
    parsed = cut(parsed)
    named = parsed.where("label is not null").groupBy("call", "label").agg(F.lit(False).alias("inside"), F.count("*").alias("n"))
    inside = parsed.where("in_text is not null").groupBy("call", F.col("in_text").alias("label")).agg(F.lit(True).alias("inside"), F.count("*").alias("n"))
    speakers = cut(named.union(inside).repartition("call").sortWithinPartitions("call", "inside", "label").mapInArrow(_resolve, "call bigint, label string, speaker string"))
    model = fit_prefixes(parsed, speakers)

    @F.pandas_udf("boolean")
    def is_label(prefix: pd.Series) -> pd.Series:
        if not len(prefix):
            return pd.Series([], dtype=bool)
        x = np.array(prefix.tolist(), float)
        return pd.Series(model.decide(x) if model else x[:, 1] + x[:, 0] > 0)

    both = F.explode(F.array(F.struct("label", F.lit(False).alias("i")), F.struct(F.col("in_text").alias("label"), F.lit(True).alias("i"))))
    sides = parsed.where("label is not null or in_text is not null").select("call", "line", both.alias("k"), "prefix").select("call", "line", "k.label", "k.i", "prefix").where("label is not null")
    found = salted_lookup(sides, speakers, ["call", "label"], "inner", salts=4).where(~F.col("i") | is_label(F.when(F.col("i"), F.col("prefix")).otherwise(F.array(*[F.lit(0.0)] * len(PREFIX_FEATURES)))))
    per = found.groupBy("call", "line").agg(F.max(F.when(~F.col("i"), F.col("speaker"))).alias("s1"), F.max(F.when(F.col("i"), F.col("speaker"))).alias("s2"))
    out = parsed.join(per, ["call", "line"], "left")
    words = F.when(F.col("s2").isNotNull(), F.col("n_rest")).otherwise(F.col("n_all"))
    out = out.select("call", "pos", "line", F.floor(F.col("pos") / BLOCK).alias("block"), F.coalesce("s2", "s1").alias("speaker"), F.col("s2").isNotNull().alias("in_text"), words.alias("words"), "asks", "ends", "thanks")
    return out.where("words > 0")


def boundary_features(rows: DataFrame) -> DataFrame:
    """Each line beside the one before it, with the features of ``FEATURES``."""
    w = Window.partitionBy("call", "block").orderBy("pos", "line")
    rows = _carry(rows, "speaker", "before", current=False)
    same = (F.col("speaker") == F.col("before")).cast("double")
    return rows.select(
        "*",
        (F.col("speaker").isNotNull() & ~F.col("in_text")).cast("double").alias("f_labelled"),
        F.when(~F.col("in_text"), same).alias("f_same"),
        F.col("in_text").cast("double").alias("f_prefix"),
        F.when(F.col("in_text"), same).alias("f_prefix_same"),
        (F.col("pos") - F.lag("pos", 1).over(w)).cast("double").alias("f_gap"),
        F.lag("asks", 1).over(w).cast("double").alias("f_asked"),
        F.lag("ends", 1).over(w).cast("double").alias("f_ended"),
        F.col("words").cast("double").alias("f_words"),
        F.lag("words", 1).over(w).cast("double").alias("f_words_before"),
        F.col("thanks").cast("double").alias("f_thanks"),
    ).fillna(0.0, [f"f_{f}" for f in FEATURES])


def hidden(x: np.ndarray, share: int = 2) -> np.ndarray:
    """The features with the label of every ``share``-th row hidden (rows stand in the order of a hash)."""
    x = x.copy()
    x[::share, :4] = 0.0
    return x


def fit_boundaries(rows: DataFrame) -> Boosted:
    """Boundary model from at most ``TRAIN_LINES`` labelled lines, taken by the hash of their call.

    A labelled line is a boundary if its speaker is another than the one
    before. Half of the lines are learned from with their label hidden, as
    lines without label look, so that the trees also weigh gap, questions,
    greetings and lengths.
    """
    sample = rows.where("before is not null and speaker is not null").select(F.xxhash64("call").alias("h"), F.xxhash64("call", "line").alias("h2"), *[f"f_{f}" for f in FEATURES], (F.col("speaker") != F.col("before")).cast("double").alias("y")).orderBy("h", "h2").limit(TRAIN_LINES).toPandas().sort_values("h2")
    if len(sample) < 50 or sample["y"].nunique() < 2:
        # too little to learn from: the definition
        x = np.array([[a, b, c, d, 1, 0, 1, 9, 9, 0] for a, b, c, d in ((0, 0, 0, 0), (1, 0, 0, 0), (1, 1, 0, 0), (0, 0, 1, 0), (0, 0, 1, 1))] * 20, float)
        return Boosted().fit(x, ((x[:, 0] + x[:, 2] == 1) & (x[:, 1] + x[:, 3] == 0)).astype(float))
    return Boosted().fit(hidden(sample[[f"f_{f}" for f in FEATURES]].to_numpy(float)), sample["y"].to_numpy(float))


def _boundary(model: Boosted) -> Callable:
    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(float) for c in columns])))

    return score(*[f"f_{f}" for f in FEATURES])


def speaker_turns(lines: DataFrame, call: str = "call_id", position: str = "sentence_id", line: str = "line_id", speaker: str = "speaker", text: str = "sentence_text") -> DataFrame:
    """``call_id, first_sentence_id, speaker, n_words``: the turns of each call.

    A turn begins where the boundary model says so and the line has a known
    speaker: a line without label continues the turn before it, whatever its
    score; such lines before the first label of a call have no known speaker
    and are in no turn. Lines without words belong to no turn and change
    nothing. Null texts are lines without words; rows with a null call or
    position are left out; a line delivered twice counts once; an empty table
    gives no turn.
    """
    rows = cut(boundary_features(labelled_lines(lines, call, position, line, speaker, text)))
    model = fit_boundaries(rows)
    rows = rows.where("speaker is not null or before is not null")
    begins = F.col("before").isNull() | (F.col("speaker").isNotNull() & (_boundary(model) > 0))
    rows = rows.select("call", "block", "pos", "line", "words", F.col("speaker"), F.when(begins, F.col("pos")).alias("start"))
    rows = _carry(rows, "start", "turn", current=True)
    turns = rows.groupBy("call", "turn").agg(F.min_by("speaker", F.struct("pos", "line")).alias("speaker"), F.sum("words").alias("n_words"))
    return turns.select(F.col("call").alias("call_id"), F.col("turn").cast(lines.schema[position].dataType).alias("first_sentence_id"), "speaker", "n_words")
