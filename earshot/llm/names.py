"""Variant spellings of names typed by people (problem 6).

A name is parsed into its parts: root (founding name), founder's first name,
line of business, further generic words, legal form. Lines of business and
generic words are those of a vocabulary and all words that follow many
different founding names in the data; they are recognised when written out,
abbreviated, cut off or with one slip. They only keep firms of one founding
name apart: every name enters the join, whatever words it holds. Roots with slips
are found by a pigeonhole segment join: a string within k edits of another
keeps one of its k + 1 segments whole, at a position shifted by k at most, so
each root is cut into segments that are joined with the substrings of the
others by hash, and every candidate is verified by a banded edit distance.
Linked cores are closed to organisations by connected components.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.splits import connected_components
from earshot.operators.skew import spread_join
from earshot.session import cut

#: Edits that the segment join finds; two slips count only if all other parts agree.
EDITS = 2

#: Legal forms by spelling.
LEGAL = {"inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd", "llc": "llc", "llp": "llp", "lp": "lp", "plc": "plc", "ag": "ag", "sa": "sa", "gmbh": "gmbh", "nv": "nv", "bv": "bv", "spa": "spa", "oyj": "oyj", "asa": "asa", "ab": "ab", "se": "se"}
#: Lines of business: they tell firms of one founding name apart. A parameter of the operator.
LINES = tuple(
    "airlines airways apparel automotive banking bioscience biologics biotech brewing broadcasting cable capital ceramics chemicals communications computers construction containers dairy drilling education electric electronics energy "
    "engineering entertainment environmental fertilizer financial foods footwear furniture gaming gas glass gold healthcare homes hospitality hotels instruments insurance leasing logistics machinery marine media medical metals mining "
    "motors networks oil optics outfitters packaging paper petroleum pharma pharmaceuticals pipelines plastics power properties publishing railways realty refining restaurants retail robotics rubber security semiconductor shipping "
    "software solar staffing steel storage stores telecom textiles therapeutics timber tobacco toys transport trucking turbines utilities water wireless".split()
)
#: Further generic words of company names.
GENERIC = tuple("associates brands combined enterprises group holdings industries international laboratories manufacturing partners products resources services systems technologies trust ventures".split())
#: Short forms of first names.
NICKNAMES = {
    "al": "albert", "alex": "alexander", "andy": "andrew", "beth": "elizabeth", "bill": "william", "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "charlie": "charles", "chris": "christopher", "dan": "daniel", "danny": "daniel",
    "dave": "david", "dick": "richard", "dima": "dmitri", "ed": "edward", "eddie": "edward", "fred": "frederick", "gabe": "gabriel", "greg": "gregory", "hank": "henry", "harry": "henry", "jack": "john", "jake": "jacob", "jeff": "jeffrey", "jen": "jennifer",
    "jenny": "jennifer", "jim": "james", "jimmy": "james", "joe": "joseph", "johnny": "john", "jon": "jonathan", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "ken": "kenneth", "larry": "lawrence", "liz": "elizabeth", "maggie": "margaret",
    "marge": "margaret", "matt": "matthew", "meg": "margaret", "mike": "michael", "nat": "nathan", "nick": "nicholas", "pam": "pamela", "pat": "patricia", "peggy": "margaret", "pete": "peter", "phil": "philip", "ray": "raymond", "rich": "richard", "rick": "richard",
    "rob": "robert", "ron": "ronald", "sam": "samuel", "sandy": "alexandra", "steve": "steven", "sue": "susan", "ted": "edward", "tim": "timothy", "toby": "tobin", "tom": "thomas", "tommy": "thomas", "tony": "anthony", "vicky": "victoria", "walt": "walter", "will": "william",
}
FIRST_NAMES = frozenset(NICKNAMES) | frozenset(NICKNAMES.values())
#: Founding names that a word must follow to count as a line of business, at least and as a share of all names (which bounds the words).
LINE_SUPPORT, LINE_SHARE = 12, 1 / 5000
#: Entries that are no names.
NO_NAME = ("unknown",)

_NOTE = re.compile(r"\b(?:f/k/a|d/b/a|formerly|a/k/a)\b.*|\([^)]*\)|\([^)]*$|\s*-\s*(?:adr|ad|a|old|ol|o|cl(?:ass)?\s*[a-c]?|c)\s*$|\s+-\s*$", re.I)
_PERSON = re.compile(r"^\s*([^\W\d_]{2,}),\s*([^\W\d_]{2,})\.?\s*$")
_LAST_FIRST = re.compile(r"^\s*([^\W\d_]+),\s*([^\W\d_]+\.?)\s+(?=(?:&|and)\s+sons\b|sons\b)", re.I)
_INITIALS = re.compile(r"[A-Z]\.?[A-Z]\.?")


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, exchange of neighbours) in a band of width ``most``; ``most + 1`` if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before2: list[int] = []
    before = [j if j <= most else far for j in range(len(b) + 1)]
    for i in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before2[j - 2] + 1)
            row[j] = min(d, far)
        if min(row) > most:
            return far
        before2, before = before, row
    return before[-1]


def _abbreviates(short: str, word: str) -> bool:
    if len(short) < 3 or short[0] != word[0] or len(short) >= len(word):
        return False
    rest = iter(word)
    return all(c in rest for c in short)


@lru_cache(200_000)
def generic_word(token: str, words: tuple[str, ...], last: bool = False) -> str | None:
    """The one word of the vocabulary that the token spells, shortens, cuts off (``last``) or misses by one slip."""
    for fits in (
        lambda w: w == token,
        lambda w: w.startswith(token) and len(token) >= 3,
        lambda w: _abbreviates(token, w),
        lambda w: len(token) >= 4 and abs(len(token) - len(w)) <= 1 and distance(token, w, 1) <= 1,
        lambda w: last and w.startswith(token),
        lambda w: last and len(token) >= 5 and any(distance(token, w[:k], 1) <= 1 for k in (len(token), len(token) - 1, len(token) + 1)),
    ):
        hits = [w for w in words if fits(w)]
        if len(hits) == 1:
            return hits[0]
        if hits:
            close = [w for w in hits if distance(token, w, 1) <= 1]
            if len(close) == 1:
                return close[0]
            # plural and singular forms of one stem count as one
            return min(hits, key=len) if len({h.rstrip("s")[:6] for h in hits}) == 1 else None
    return None


@dataclass(frozen=True)
class Name:
    """Parts of a name; ``hint``: what is left of a line of business that could not be told (initials, cut word)."""

    root: str
    first: str
    line: str
    hint: str
    generic: str
    legal: str


def _tokens(name: str) -> list[str]:
    name = re.sub(r"(?<=[a-zà-ÿ])(?=[A-Z][a-zà-ÿ])", " ", unicodedata.normalize("NFKC", name))  # a lost space
    name = _NOTE.sub(" ", name)
    name = _NOTE.sub(" ", name.rstrip())
    name = _LAST_FIRST.sub(r"\2 \1 ", name)
    name = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    name = re.sub(r"(?<=\w)['’](?=\w)", "", name)
    name = re.sub(r"\b([A-Za-z])\.\s?([A-Za-z])\b\.?", r"\1\2", name)  # S.A., L.P., initials
    return re.findall(r"[^\W_]+", name)


def parse_name(name: str | None, lines: tuple[str, ...] = LINES) -> Name | None:
    """Parts of a name; None for null, blank and no names."""
    if name is None or name.strip().lower() in NO_NAME:
        return None
    if (m := _PERSON.match(name)) and not any(generic_word(m[2].lower(), w, True) or m[2].lower() in LEGAL for w in (lines, GENERIC)):
        name = f"{m[2]} {m[1]}"  # last name first
    raw = _tokens(name)
    tokens = [t.lower() for t in raw]
    if tokens and tokens[0] == "the" and len(tokens) > 1:
        raw, tokens = raw[1:], tokens[1:]
    if not tokens:
        return None
    line = generic = legal = ""
    unknown: list[int] = []
    sons = next((k for k, t in enumerate(tokens) if k and t in ("sons", "son")), None)
    for k, t in enumerate(tokens):
        if k == sons or t in ("and",):
            continue
        if t in LEGAL and k:
            legal = legal or LEGAL[t]
        elif t in lines and not line:
            line = t
        elif t in GENERIC and k:
            generic = generic or t
        else:
            unknown.append(k)
    if not unknown:
        return Name(" ".join(tokens), "", "", "", "", "")
    if sons is None and not line and not generic and len(unknown) == 2:
        # a person's name: first name first, in its long form
        if tokens[unknown[1]] in FIRST_NAMES and tokens[unknown[0]] not in FIRST_NAMES and not legal:
            unknown.reverse()
        given, family = (tokens[k] for k in unknown)
        if given in FIRST_NAMES and not any(generic_word(family, w, True) for w in (lines, GENERIC)):
            return Name(NICKNAMES.get(given, given), "", "", family, "", legal)
    return _parts(raw, tokens, unknown, sons, line, generic, legal, lines)


def _parts(raw: list[str], tokens: list[str], unknown: list[int], sons: int | None, line: str, generic: str, legal: str, lines: tuple[str, ...]) -> Name:
    """The parts of a name whose words outside the vocabulary are ``unknown``."""
    first = hint = ""
    if sons is None and len(unknown) >= 3 and (near := [k for k in unknown[1:] if distance(tokens[k], "sons", 1) <= 1]):
        sons = near[0]
        unknown.remove(sons)
    if sons is not None:
        lead = [k for k in unknown if k < sons]
        tail = [k for k in unknown if k > sons]
        if not lead:
            lead, tail = tail[:1], tail[1:]
        if not lead:
            return Name(" ".join(tokens), "", line, "", generic, legal)
        root = tokens[lead[-1]]
        first = NICKNAMES.get(tokens[lead[-2]], tokens[lead[-2]]) if len(lead) > 1 else "?"
    else:
        lead, tail = unknown[:1], unknown[1:]
        if tail and not line and generic_word(tokens[lead[0]], lines) and not generic_word(tokens[tail[0]], lines):
            lead, tail = tail[:1], [lead[0], *tail[1:]]
        root = tokens[lead[0]]
        if not line and not tail:
            for w in lines:  # a lost space in a name of one case
                if root.endswith(w) and len(root) - len(w) >= 4:
                    root, line = root[: -len(w)], w
                    break
    for k in tail:
        t, last = tokens[k], k == len(tokens) - 1
        if not line and not hint:
            if len(t) == 2 and not last and _INITIALS.fullmatch(raw[k]) and sons is None:
                hint = t
            elif (w := generic_word(t, lines, last)) is not None:
                line = w
            elif (w := generic_word(t, GENERIC)) is not None:
                generic = generic or w
            else:
                hint = t
        elif (w := generic_word(t, GENERIC, last)) is not None:
            generic = generic or w
        elif last and not legal and len(t) >= 2:
            fits = {v for s, v in LEGAL.items() if s.startswith(t)}
            legal = fits.pop() if len(fits) == 1 else ""
    if sons is not None and not first:
        first = "?"
    return Name(root, first, line, "" if line else hint, generic, legal)


def segments(length: int, k: int) -> list[tuple[int, int]]:
    """Start and length of the k + 1 nearly equal segments of a string."""
    short, longer = divmod(length, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        n = short + (i >= k + 1 - longer)
        out.append((at, n))
        at += n
    return out


def _index_keys(root: str, k: int) -> list[str]:
    return [f"{len(root)}.{i}.{root[a : a + n]}" for i, (a, n) in enumerate(segments(len(root), k))]


def _probe_keys(root: str, k: int) -> list[str]:
    """Substrings that a segment of an equally long or shorter root may equal, by its position.

    An exchange across the border of two segments spoils both with one edit:
    each substring also stands with that exchange undone at either end.
    """
    out = set()
    for length in range(max(1, len(root) - k), len(root) + 1):
        shift = len(root) - length
        for i, (a, n) in enumerate(segments(length, k)):
            for at in range(max(0, a - (k - shift) // 2 - 1, a - k), min(len(root) - n, a + k) + 1):
                part = root[at : at + n]
                out.add(f"{length}.{i}.{part}")
                if n and i and at:
                    out.add(f"{length}.{i}.{root[at - 1]}{part[1:]}")
                if n and i < k and at + n < len(root):
                    out.add(f"{length}.{i}.{part[:-1]}{root[at + n]}")
    return sorted(out)


def _first_fits(a: str, b: str) -> bool:
    if a == b or "?" in (a, b) and a and b:
        return True
    if not a or not b:
        return True
    return a[0] == b[0] if 1 in (len(a), len(b)) else distance(a, b, 1) <= 1


def _part_fits(a: str, b: str) -> bool:
    return not a or not b or a == b


def _hint_fits(hint: str, line: str, generic: str, founded: bool) -> bool:
    """Whether initials or a cut-off word may stand for the line of business."""
    if len(hint) == 2 and not founded:
        return bool(line) and bool(generic) and hint == line[0] + generic[0]
    return line.startswith(hint) or (len(hint) >= 4 and (distance(hint, line[: len(hint)], 1) <= 1 or distance(hint, line, 1) <= 1))


def same_organisation(a: Name, b: Name) -> bool:
    """Whether two cores denote one organisation: both with lines of business or both without."""
    if a.hint != b.hint and (a.root != b.root or min(len(a.hint), len(b.hint)) < 5 or distance(a.hint, b.hint, 1) > 1):
        return False
    if a.line != b.line or not _first_fits(a.first, b.first) or not _part_fits(a.generic, b.generic):
        return False
    if bool(a.first) != bool(b.first):
        # the founder and "& Sons" left out: nothing else may differ
        return a.root == b.root and _part_fits(a.legal, b.legal)
    d = distance(a.root, b.root, 2)
    if d == 0:
        return True
    if d == 1:
        return min(len(a.root), len(b.root)) >= 4 and (_part_fits(a.legal, b.legal) or "co" in (a.legal, b.legal))
    return d == 2 and min(len(a.root), len(b.root)) >= 7 and a.generic == b.generic and a.legal == b.legal != "" and a.first == b.first


def learned_lines(names: DataFrame, name: str = "name", known: tuple[str, ...] = LINES) -> tuple[str, ...]:
    """``known`` and the words that follow at least ``LINE_SUPPORT`` different founding names of ``names`` (distinct).

    A word that abbreviates, cuts off or misspells a known, a generic or a
    more frequent such word is none of its own. The share ``LINE_SHARE`` of all
    names that a word must follow bounds how many reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(w, t[0]) for n in batch.column(0).to_pylist() if n for t in [[x.lower() for x in _tokens(n)]] for w in t[1:] if len(w) >= 4 and w.isalpha() and w not in LEGAL and w not in ("sons", "and") and w != t[0]}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["word", "root"])

    followed = names.select(F.col(name).alias("name")).mapInArrow(run, "word string, root string").distinct().groupBy("word").agg(F.count("*").alias("n"))
    least = names.agg(F.greatest(F.lit(LINE_SUPPORT), F.count("*") * LINE_SHARE).alias("least"))
    found = followed.crossJoin(F.broadcast(least)).where("n >= least").orderBy(F.desc("n"), "word").select("word").toPandas()["word"]
    out = list(known)
    for w in found:
        if not any(x.startswith(w) or w.startswith(x) and len(w) <= len(x) + 2 or _abbreviates(w, x) or abs(len(w) - len(x)) <= 1 and distance(w, x, 1) <= 1 for x in [*out, *GENERIC, *LEGAL]):
            out.append(w)
    return tuple(out)


_CORE = "root string, first string, line string, hint string, generic string, legal string"


def organisations(names: DataFrame, name: str = "name", lines: tuple[str, ...] = LINES, edits: int = EDITS) -> DataFrame:
    """``name, org`` of every distinct name: the spellings of one organisation share ``org`` (a bigint).

    Case, accents, spacing, punctuation, order of the parts, notes in brackets,
    former names, share classes, legal forms spelled otherwise or left out,
    abbreviations, cut-off ends, initials and short forms of first names, and
    slips do not tell names apart; line of business, unlike generic words and
    unlike first names do. ``lines`` are known lines of business, to which the
    words that follow many founding names are added. A name whose line of business is unreadable joins
    the one organisation of its root that it fits; one that fits none joins
    names of the same unknown words, as do names of a root alone. Null,
    blank and ``UNKNOWN`` are no names; repeated rows count once; an empty
    table gives no row; further columns are not read.
    """
    distinct = names.select(F.col(name).cast("string").alias("name")).where(F.col("name").isNotNull()).distinct()
    distinct = cut(distinct)
    lines = learned_lines(distinct, "name", tuple(lines))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["name", "root", "first", "line", "hint", "generic", "legal"]
        schema = pa.schema([(c, pa.string()) for c in columns])
        for batch in batches:
            rows = []
            for n in batch.column(0).to_pylist():
                if (p := parse_name(n, lines)) is not None:
                    rows.append((n, p.root, p.first, p.line, p.hint, p.generic, p.legal))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)

    parsed = distinct.mapInArrow(parse, f"name string, {_CORE}").withColumn("core", F.xxhash64("root", "first", "line", "hint", "generic", "legal"))
    parsed = cut(parsed)
    cores = parsed.select("core", "root", "first", "line", "hint", "generic", "legal").distinct()
    told = cores.where("line <> ''")

    def keyed(make: Callable, side: str) -> tuple[Callable, str]:
        """A function for ``mapInArrow`` that repeats each core for each of its join keys, and its type."""
        schema = pa.schema([("key", pa.string()), *((f"{side}{c}", pa.int64() if c == "core" else pa.string()) for c in ("core", "root", "first", "line", "hint", "generic", "legal"))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = [], []
                for k, (root, line) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 3)))):
                    made = make(root, line)
                    keys += made
                    at += [k] * len(made)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(c.take(pa.array(at, pa.int64())) for c in batch.columns)], schema=schema)

        return run, "key string, " + ", ".join(f"{side}{c} {'bigint' if c == 'core' else 'string'}" for c in ("core", "root", "first", "line", "hint", "generic", "legal"))

    index, index_type = keyed(lambda root, what: [f"{what}.{x}" for x in _index_keys(root, edits)], "a_")
    probe, probe_type = keyed(lambda root, what: [f"{what}.{x}" for x in _probe_keys(root, edits)], "b_")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if same_organisation(Name(*row[1:7]), Name(*row[8:14])):
                    us.append(row[0])
                    vs.append(row[7])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    fields = ["core", "root", "first", "line", "hint", "generic", "legal"]

    def linked(some: DataFrame) -> DataFrame:
        """``node, root`` of the cores that are linked with others of the same line of business or the same unknown words."""
        pairs = spread_join(some.mapInArrow(index, index_type), some.mapInArrow(probe, probe_type), "key", "a_core").where("a_core <> b_core").drop("key").dropDuplicates(["a_core", "b_core"])
        return connected_components(pairs.select(*[f"a_{c}" for c in fields], *[f"b_{c}" for c in fields]).mapInArrow(verify, "u bigint, v bigint"))

    return _finish(parsed, cores, told, linked, edits, keyed)


def _finish(parsed: DataFrame, cores: DataFrame, told: DataFrame, linked: Callable, edits: int, keyed: Callable) -> DataFrame:
    """Organisations of the told cores, then of the names whose line could not be told."""
    orgs = told.join(linked(told).select(F.col("node").alias("core"), F.col("root").alias("org")), "core", "left").withColumn("org", F.coalesce("org", "core"))
    index, index_type = keyed(lambda root, what: _index_keys(root, edits), "a_")
    probe, probe_type = keyed(lambda root, what: _probe_keys(root, edits), "b_")
    untold = cores.where("line = '' and hint <> ''")
    fields = ["core", "root", "first", "line", "hint", "generic", "legal"]
    # either side may be the longer one: both go into the index and both probe
    one = spread_join(untold.mapInArrow(index, index_type), told.mapInArrow(probe, probe_type), "key", "a_core").select(*[f"a_{c}" for c in fields], *[f"b_{c}" for c in fields])
    two = spread_join(told.mapInArrow(index, index_type), untold.mapInArrow(probe, probe_type), "key", "a_core").select(*[F.col(f"b_{c}").alias(f"a_{c}") for c in fields], *[F.col(f"a_{c}").alias(f"b_{c}") for c in fields])
    pairs = one.union(two).dropDuplicates(["a_core", "b_core"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = Name(*row[1:7]), Name(*row[8:14])
                if _first_fits(a.first, b.first) and (_part_fits(a.legal, b.legal) or "co" in (a.legal, b.legal)) and distance(a.root, b.root, 1) <= 1 and _hint_fits(a.hint, b.line, b.generic, bool(a.first)):
                    us.append(row[0])
                    vs.append(row[7])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    hits = cut(pairs.mapInArrow(verify, "u bigint, v bigint"))
    fit = hits.join(orgs.select(F.col("core").alias("v"), "org"), "v").groupBy(F.col("u").alias("core")).agg(F.min("org").alias("org"), F.max("org").alias("other")).where("org = other").select("core", "org")
    free = linked(cores.where("line = ''").join(hits.select(F.col("u").alias("core")).distinct(), "core", "left_anti"))
    whole = orgs.select("core", "org").union(fit).union(free.select(F.col("node").alias("core"), F.col("root").alias("org")))
    return parsed.join(whole, "core", "left").select("name", F.coalesce("org", "core").alias("org"))


def spelling_pairs(named: DataFrame) -> DataFrame:
    """``name_a, name_b``: every pair of different spellings of one organisation, ``name_a < name_b`` by code point.

    An organisation has as many rows as its spellings have pairs; the spellings are
    distinct strings, however often each occurs.
    """
    a = named.select("org", F.col("name").alias("name_a"))
    b = named.select("org", F.col("name").alias("name_b"))
    return a.join(b, "org").where("name_a < name_b").select("name_a", "name_b")
