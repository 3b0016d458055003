"""Sentence boundaries across languages and scripts (problem 2).

A semi-Markov model: candidate cuts lie after every sentence mark (with the
closing quotes and brackets behind it), between Thai phrases and at blank lines.
Dynamic programming then chooses whole spans between cuts; a span is scored by
its length, its opening word, its closing word with the mark, and by the
quotations and brackets that it cuts, so that the marks inside a quotation,
an abbreviation or a number lose against the span that holds them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Costs in a span's score: each quoted part cut at one side, over-long spans, spans that begin without letter or digit.
PART, LONG, BARE = 6.0, 0.2, 2.0
#: Characters beyond which a span is over-long, and within which the word before a dot (with the one before it) must lie to be an abbreviation.
LONG_SPAN, LOOK_BACK = 1000, 256

_BLANK_LINE = re.compile(r"(?:\r\n?|\n|\u2028)[^\S\r\n]*(?:\r\n?|\n|\u2028)|\u2029")
_MARKS = re.compile(r"[.!?。！？．｡…‥।॥؟۔;;։።။]+")
_CLOSERS = "\"'”’“»›」』)]）】］}"
_OPENERS = "\"'“‘„«‹「『([（【{¿¡"
_PAIRS = {"”": "“", "»": "«", "」": "「", "』": "『", ")": "(", "]": "[", "】": "【"}
_WIDE = {"（": "(", "）": ")"}
_SIGN = re.compile(r"[\"“”„«»「」『』()\[\]（）【】]")
_ALNUM = re.compile(r"[^\W_]")
_THAI_SPACE = re.compile(r"(?<=[\u0e00-\u0e7f])\s+(?=\S)")
_UNIT_AFTER = re.compile(r"[\d.,]+\s*[A-Za-z]")
_WORD = re.compile(r"[^\W\d_]+(?:[.'’-][^\W\d_]+)*")
_LAST = re.compile(r"[^\s\"'“”„«»(\[（「」』）》】。！？；：，、।؟!?;:\u3040-\u30ff\u3400-\u9fff]+$")

#: Abbreviations that a name, number or further words follow: their dot ends nothing.
LEADING = frozenset(
    """mr mrs ms messrs dr prof rev hon gen col capt lt sgt sen rep gov st mt ft no nos nr sec art fig vol ch pp pg p para eq ref op cf viz vs approx ca est
    e.g i.e z.b d.h u.a bzw vgl evtl ggf inkl exkl hr fr frl mio mrd tsd
    ex env mme mlle mm me chap
    sr sra srta dña pág pág pag art núm num aprox ee vd ud
    ок т.е те ул стр рис гл им проф
    αρ π.χ κ κκ σελ δρ
    د أ م रु डॉ ड० श्री""".split()
)
MONTHS_SHORT = frozenset("jan feb mar apr jun jul aug sep sept oct nov dec".split())
#: Legal forms: as the next word they carry on a name.
LEGAL = frozenset("inc ltd corp co llc llp plc lp ag gmbh sa s.a bros sons jr sr".split())
#: Words before a German ordinal number, and words that follow one.
BEFORE_ORDINAL = frozenset("im am dem den vom zum zur der des die das beim ab bis und oder jedem ihrem seinem unserem ersten".split())
AFTER_ORDINAL = frozenset("quartal quartals halbjahr halbjahres jahrhundert jahrhunderts januar februar märz april mai juni juli august september oktober november dezember".split())
#: Common first words of sentences; they decide after acronyms.
OPENING = frozenset(
    """the a an we our i he she it they you this that these those there here in on at by for from with as if when while what who why how where is are was were do does did can could will would should may
    and but so or yet however mr mrs ms dr no yes please thank thanks
    der die das ein eine wir ich er sie es ist sind im in am herr frau und aber
    le la les un une nous je il elle ils on est m mme peut
    el los las un una nosotros en es qué""".split()
)
_ACRONYM = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")

_TAIL = re.compile(r"(?<=[^\W\d_]{2})\.(?:[^\W\d_]\.)+[^\W\d_]$|(?<=[\d%)])\.(?:[^\W\d_]\.)+[^\W\d_]$")


def _script(ch: str) -> str:
    """Rough script: han (also kana), hangul, thai, greek, cased or other."""
    o = ord(ch)
    if 0x0E00 <= o <= 0x0E7F:
        return "thai"
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF or 0x20000 <= o <= 0x3FFFF:
        return "han"
    if 0xAC00 <= o <= 0xD7AF or 0x1100 <= o <= 0x11FF:
        return "hangul"
    if 0x0370 <= o <= 0x03FF or 0x1F00 <= o <= 0x1FFF:
        return "greek"
    return "cased" if ch.isupper() or ch.islower() else "other"


def _opening(text: str, at: int) -> float:
    """How well a sentence can begin at ``at``."""
    while at < len(text) and (text[at] in _OPENERS or text[at].isspace()):
        at += 1
    if at == len(text):
        return -1.0
    ch = text[at]
    if ch.isdigit():
        return 0.0
    if ch.isalpha() or _script(ch) in ("thai", "han", "hangul"):
        if ch.islower():
            return 0.3 if at + 1 < len(text) and text[at + 1].isupper() else -4.0
        word = _WORD.match(text, at)
        bonus = 1.0 if word and word[0].lower() in OPENING else 0.0
        return (0.5 if ch.isupper() else 0.4) + bonus
    if ch in ",;:.!?)]}、。，–—-/%":
        return -5.0
    return 0.0


def _closing(text: str, begin: int, mark: int, end: int, cut: int, nxt: int) -> float:
    """How well a sentence can end with the marks ``text[mark:end]``; closers reach to ``cut``, the next piece begins at ``nxt``."""
    marks, closers = text[mark:end], cut > end
    glued = nxt == cut
    before = text[mark - 1] if mark > begin else ""
    after = text[nxt]
    if glued and (after.isalpha() or after.isdigit() or _script(after) != "cased"):
        if closers:
            # a closed quotation that runs on: particle, verb of speech or adverb
            if not after.isupper():
                return -5.0
        elif after.isdigit() and before.isdigit():
            return -9.0
        elif after.islower() and not (nxt + 1 < len(text) and text[nxt + 1].isupper()):
            return -5.0
        elif after.isdigit() and not before.isalpha() and before not in "%)":
            return -5.0
    if marks[0] in ";;":
        if marks[0] == ";" and not (before and _script(before) == "greek"):
            return -9.0
        return 2.0
    if "…" in marks or "‥" in marks or marks.count(".") > 1:
        strong = any(m in marks for m in "!?！？")
        return 1.5 if strong else 0.2 if not glued or (after.isupper() and before.isalpha()) else -5.0
    if any(m in marks for m in "!?！？؟。｡।॥۔։።။"):
        return 2.0
    # a single dot
    near = text[max(begin, mark - LOOK_BACK) : mark]
    token = _LAST.search(near)
    word = token[0].strip(".,;:)").lower() if token else ""
    if not word:
        return 0.5 if closers or before in ")”\"»]%" else 1.0 if _script(before or " ") == "han" else -2.0
    if before.isdigit():
        lead = near[: len(near) - len(re.search(r"[\d.,]+$", near)[0])].split()
        lead_word = lead[-1].lower() if lead else ""
        follows = _WORD.match(text, nxt)
        if follows and follows[0].lower() in AFTER_ORDINAL:
            return -6.0
        if lead_word in BEFORE_ORDINAL and len(re.search(r"\d+$", near)[0]) <= 2:
            return -4.0
        return 1.0
    if "." in word and word not in LEADING and not _ACRONYM.fullmatch(word):
        # a space was lost before this word: only what follows the earlier dot counts
        word = (_TAIL.search(word) or re.search(r"[^.]*$", word))[0].lstrip(".")
        if not word:
            return 1.0
    tail = re.split(r"[-/’']", word)[-1]
    if word in LEADING or tail in LEADING:
        return -6.0
    if word in MONTHS_SHORT:
        return -6.0 if after.isdigit() else 0.0
    follows = _WORD.match(text, nxt)
    if follows and follows[0].lower() in LEGAL:
        return -6.0
    if tail == "г":  # year after a number, else town
        lead = near[:-1].split()
        return 0.5 if lead and lead[-1][-1].isdigit() else -6.0
    if len(tail) == 1 and tail.isalpha() and _script(tail) in ("cased", "greek"):
        return -6.0 if tail != "i" else -0.5
    if _ACRONYM.fullmatch(word):
        return -0.9
    return 1.0


def _candidates(text: str, begin: int, end: int) -> list[tuple[int, int, float, float]]:
    """``(end of the left span, begin of the right span, closing, opening)`` of every possible cut in a paragraph, with the scores of its two sides."""
    out = {}
    for m in _MARKS.finditer(text, begin, end):
        cuts = [m.end()]
        at = m.end()
        while at < end and text[at] in _CLOSERS:
            at += 1
            cuts.append(at)
        if at == m.end() and at + 1 < end and text[at] in " \u00a0\u202f" and text[at + 1] == "»":
            cuts.append(at + 2)
        for cut in cuts:
            nxt = cut
            while nxt < end and text[nxt].isspace():
                nxt += 1
            if nxt < end:
                out[cut, nxt] = (_closing(text, begin, m.start(), m.end(), cut, nxt), _opening(text, nxt))
    for m in _THAI_SPACE.finditer(text, begin, end):
        cut, nxt = m.span()
        if nxt >= end or text[nxt].isdigit() and not _UNIT_AFTER.match(text, nxt, end):
            continue
        if _script(text[nxt]) != "thai" and not (text[nxt].isalnum() or text[nxt] in _OPENERS):
            continue
        out[cut, nxt] = (1.0, 0.0)
    return sorted((c, n, *s) for (c, n), s in out.items())


def _straight(text: str, marks: list[int], begin: int, end: int) -> list[tuple[int, int]]:
    """Pairs of straight quotation marks: by turns if their number is even, else by the side on which a word stands."""
    if len(marks) % 2 == 0:
        return list(zip(marks[::2], marks[1::2]))
    out, opened = [], None
    for k in marks:
        free_before = k == begin or text[k - 1].isspace() or text[k - 1] in _OPENERS
        free_after = k + 1 >= end or text[k + 1].isspace() or text[k + 1] in ".,;:!?" + _CLOSERS
        if opened is None or free_before and not free_after:
            opened = k if not (free_after and not free_before) else None
        else:
            out.append((opened, k))
            opened = None
    return out


def quoted_parts(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Positions of each opening quotation mark or bracket and of its partner; those without partner are left out.

    One pass with a stack for each kind of sign. A closing sign that stands
    where one opens (»so«, ”so”) opens.
    """
    out: list[tuple[int, int]] = []
    straight: list[int] = []
    opened: dict[str, list[int]] = {}
    take = lambda kind, k: out.append((opened[kind].pop(), k))
    for m in _SIGN.finditer(text, begin, end):
        k, ch = m.start(), m[0]
        if ch == '"':
            straight.append(k)
            continue
        ch = _WIDE.get(ch, ch)
        if ch == "“" and opened.get("„"):
            take("„", k)
        elif ch == "«" and opened.get("»"):
            take("»", k)
        elif ch in _PAIRS:
            kind = next((o for o in (_PAIRS[ch], *("„”" if ch == "”" else "")) if opened.get(o)), None)
            if kind:
                take(kind, k)
            elif ch in "»”" and (k == begin or text[k - 1].isspace()):
                opened.setdefault(ch, []).append(k)
        else:
            opened.setdefault(ch, []).append(k)
    return out + _straight(text, straight, begin, end)


def _cut_parts(pairs: list[tuple[int, int]], cuts: list[int]) -> list[int]:
    """How many quoted or bracketed parts each cut position (in order) runs through."""
    opens, closes = sorted(o for o, _ in pairs), sorted(c for _, c in pairs)
    return [bisect_left(opens, c) - bisect_left(closes, c) for c in cuts]


def _spans(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """The spans of the highest total score in a paragraph.

    A span from ``i`` to ``j`` scores opening(i) + closing(j) + length(i, j) +
    balance(i, j). The balance costs ``PART`` for each quoted or bracketed part
    that the span cuts at its begin and at its end. The length costs ``LONG``
    beyond ``LONG_SPAN`` characters and ``BARE`` if the first eight hold no
    letter or digit. The best start of every end comes from a sliding maximum,
    so the work is linear in the number of cuts however long a span grows.
    """
    cuts = _candidates(text, begin, end)
    if not cuts:
        return [(begin, end)]
    begins = [begin, *(n for _, n, _, _ in cuts)]
    ends = [*(c for c, _, _, _ in cuts), end]
    parts = _cut_parts(quoted_parts(text, begin, end), ends[:-1])
    closing = [*(c - PART * n for (_, _, c, _), n in zip(cuts, parts)), 0.0]
    opening = [0.0, *(o - PART * n for (_, _, _, o), n in zip(cuts, parts))]
    word = [m.start() if (m := _ALNUM.search(text, b, b + 8)) else end + 8 for b in begins]
    value: list[float] = []  # best score of what lies before a start, with its opening
    back: list[int] = []
    best, far, far_at = 0.0, float("-inf"), -1  # far: best start more than LONG_SPAN back
    near: deque[tuple[float, int]] = deque()  # falling scores of the starts within LONG_SPAN
    fresh: deque[int] = deque()  # starts whose first word may lie behind the end
    for j, stop in enumerate(ends):
        value.append(best + opening[j])
        fresh.append(j)
        while fresh and (word[fresh[0]] < stop or begins[fresh[0]] + 8 <= stop):
            i = fresh.popleft()
            v = value[i] - (BARE if word[i] >= stop else 0.0)
            while near and near[-1][0] <= v:
                near.pop()
            near.append((v, i))
        while near and stop - begins[near[0][1]] > LONG_SPAN:
            v, i = near.popleft()
            if v >= far:
                far, far_at = v, i
        top, at = (near[0] if near else (float("-inf"), 0))
        if far - LONG > top:
            top, at = far - LONG, far_at
        for i in fresh:
            if begins[i] < stop and value[i] - (BARE if word[i] >= stop else 0.0) >= top:
                top, at = value[i] - (BARE if word[i] >= stop else 0.0), i
        back.append(at)
        best = top + closing[j]
    out, j = [], len(ends)
    while j > 0:
        i = back[j - 1]
        out.append((begins[i], ends[j - 1]))
        j = i
    return out[::-1]


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """0-based, end-exclusive code-point spans of the sentences, outer white space excluded."""
    if not text or text.isspace():
        return []
    out, at = [], 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        stop = m.start() if m else len(text)
        a, z = at, stop
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if a < z:
            out += _spans(text, a, z)
        at = m.end() if m else stop
    return out


def sentences(documents: DataFrame, key: str = "block_id", text: str = "sentence_text") -> DataFrame:
    """``key, start_pos, end_pos, sentence``: one row per sentence, 1-based code points of its first and last character.

    The language is taken from the script and words of the text itself, not
    from a language column. Null, empty and blank texts have no sentence;
    repeated rows give repeated sentences; further columns are not read.
    """
    rows = documents.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text")).where("__text is not null")
    kind = rows.schema["__key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends, texts = [], [], [], []
            for k, t in zip(range(batch.num_rows), batch.column(1).to_pylist()):
                for a, z in sentence_spans(t):
                    keys.append(k)
                    starts.append(a + 1)
                    ends.append(z)
                    texts.append(t[a:z])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())], [key, "start_pos", "end_pos", "sentence"])

    return rows.mapInArrow(run, f"`{key}` {kind}, start_pos bigint, end_pos bigint, sentence string")
