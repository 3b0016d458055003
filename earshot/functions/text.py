"""Text functions: Column -> Column, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions import fixed


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether any of the words is a substring of the text."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def count_contained(text: Column, words: list[str]) -> Column:
    """How many of the words are substrings of the text."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def words_in(tokens: Column, words: list[str]) -> Column:
    """Occurrences of the words among the tokens."""
    return F.size(F.filter(tokens, lambda t: t.isin(words)))


def drop_headers(text: Column, pattern: str = fixed.HEADER_PATTERN) -> Column:
    """Paragraphs without headers (F1): those that hold a header word, only a time, or at most 60 characters all upper case go."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\r\n|\r", "\n"), r"(?i)\(operator instructions\)", " ")

    def keep(p: Column) -> Column:
        low = F.lower(F.regexp_replace(p, r"^\p{Z}+|\p{Z}+$", ""))
        # (?U): white space, words and digits of every script
        short = F.length(F.regexp_replace(p, r"(?U)^\s+|\s+$", "")) <= 60
        shout = short & p.rlike(r"\p{IsUppercase}") & ~p.rlike(r"[\p{IsLowercase}\p{Lt}]")
        return (low == "") | ~(low.rlike("(?U)" + pattern) | low.rlike(r"(?U)^\d{2}:\d{2}:\d{2}$") | shout)

    return F.array_join(F.filter(F.split(clean, r"(?U)\n\s*\n"), keep), "\n\n")


def sentence_spans(text: Column) -> Column:
    """Sentences whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(fixed.SENTENCE_PATTERN), F.lit(0))


#: White space of any script, in a form that all engines read.
SPACE = r"[\t\n\x0b\f\r\x{85}\p{Z}]"


def protected_sentences(text: Column) -> Column:
    """Sentences split at marks before white space, six abbreviations protected, pieces under two characters dropped."""
    # the stand-in of a protected dot is a private character, put back only where an abbreviation was
    hidden = {a: a.replace(".", "\ue000") for a in fixed.PROTECTED}
    for a, b in hidden.items():
        text = F.replace(text, F.lit(a), F.lit(b))

    def restored(s: Column) -> Column:
        for a, b in hidden.items():
            s = F.replace(s, F.lit(b), F.lit(a))
        return F.regexp_replace(s, f"^{SPACE}+|{SPACE}+$", "")

    return F.filter(F.transform(F.split(text, f"(?<=[。！？!?.]){SPACE}+"), restored), lambda s: F.length(s) >= 2)


def metric_tokens(text: Column) -> Column:
    """Tokens of letters, digits and hyphens."""
    return F.regexp_extract_all(F.lower(F.translate(text, "　 ", "  ")), F.lit(r"[a-z0-9\-]+"), F.lit(0))


def english_tokens(text: Column) -> Column:
    """Words that may hold apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'-]*"), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """Runs of Latin letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))


def normalize_term(term: Column) -> Column:
    """Lower case, trimmed, single spaces."""
    return F.regexp_replace(F.trim(F.lower(term)), r"\s+", " ")


def norm_token(token: Column) -> Column:
    """Letters, digits, hyphens and spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(token), r"[^a-z0-9\- ]+", " "), r"\s+", " "))


def ngrams(tokens: Column, n: int) -> Column:
    """All n-grams as text; none if there are fewer tokens."""
    grams = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def only_stopwords(gram: Column) -> Column:
    """Whether every word of a gram is a stopword."""
    return F.forall(F.split(gram, " "), lambda t: t.isin(fixed.STOPWORDS))


def content_gram(gram: Column) -> Column:
    """What is left of a gram without stopwords and units (X9); empty if nothing is."""
    return F.array_join(F.filter(F.split(gram, " "), lambda t: ~t.isin(fixed.STOPWORDS + fixed.UNIT_WORDS)), " ")


def merge_short(sentences: Column, min_tokens: int = 3, min_chars: int = 10) -> Column:
    """Fold short sentences into their neighbours.

    A sentence is short under ``min_tokens`` tokens or ``min_chars`` letters
    and digits. It joins the one before; the first joins the next. The fold
    keeps joining while the last part is itself short. The concatenation stays
    that of the input.
    """

    def short(s: Column) -> Column:
        return (F.size(metric_tokens(s)) < min_tokens) | (F.length(F.regexp_replace(s, r"[^\p{L}\p{N}]", "")) < min_chars)

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, s)))
        return F.when(F.size(acc) == 0, F.array(s)).when(short(s) | short(last), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sentences, F.array().cast("array<string>"), step)


def theme(label: Column) -> Column:
    """Theme of a label by ordered substring tests."""
    low = F.lower(F.coalesce(label, F.lit("")))
    out = None
    for name, words in fixed.THEMES:
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(fixed.THEME_OTHER)


def canonical_risk(label: Column) -> Column:
    """One of the four causes by what the cleaned label holds; null if none (X11)."""
    low = F.regexp_replace(F.lower(label), "[^a-z0-9]+", "")
    out = None
    for name, words in fixed.RISK_LABELS:
        hit = contains_any(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def top_labels(values: dict[str, Column], k: int = 3) -> Column:
    """``name:0.123; …`` of the k largest values, ties by name."""
    pairs = F.array(*[F.struct((-v).alias("v"), F.lit(n).alias("n")) for n, v in values.items()])
    return F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.concat(p["n"], F.lit(":"), F.format_string("%.3f", -p["v"]))), "; ")


def first_max(values: dict[str, Column]) -> Column:
    """Name of the largest value, the first of ties."""
    array = F.array(*values.values())
    return F.get(F.array(*[F.lit(n) for n in values]), F.array_position(array, F.array_max(array)) - 1)


def file_name(name: Column) -> Column:
    """A name without characters that files may not hold."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[\\/:*?"<>|\r\n]+', " "), r"\s+", " "), 1, 180)


def type_number(path: Column) -> Column:
    """The number in Type_1 .. Type_3 of a path or label."""
    return F.regexp_extract(path, r"Type_([123])", 1).try_cast("int")


def parse_date(text: Column) -> Column:
    """A date from ISO, ``yyyymmdd``, ``d-Mon-yyyy`` or ``m/d/yyyy`` within a text; null if there is none."""
    iso = F.try_to_date(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
    packed = F.try_to_date(F.regexp_extract(text, r"(?<!\d)((?:19|20)\d{6})(?!\d)", 1), "yyyyMMdd")
    month = F.try_to_date(F.initcap(F.regexp_extract(text, r"(\d{1,2}-[A-Za-z]{3}-\d{4})", 1)), "d-MMM-yyyy")
    slashed = F.try_to_date(F.regexp_extract(text, r"(\d{1,2}/\d{1,2}/\d{4})", 1), "M/d/yyyy")
    return F.coalesce(iso, packed, month, slashed)


def document_parts(doc_id: Column) -> dict[str, Column]:
    """Company, its short key, date, quarter and year of ``Company_YYYY-MM-DD_Qn YYYY``."""
    pattern = r"^(.*)_(\d{4}-\d{2}-\d{2})_Q(\d)\s*(\d{4})$"
    return {
        "company": F.regexp_extract(doc_id, pattern, 1),
        "company_id": F.trim(F.substring_index(F.substring_index(doc_id, "_", 1), ",", 1)),
        "file_date": F.try_to_date(F.regexp_extract(doc_id, pattern, 2), "yyyy-MM-dd"),
        "quarter": F.regexp_extract(doc_id, pattern, 3).try_cast("int"),
        "fiscal_year": F.regexp_extract(doc_id, pattern, 4).try_cast("int"),
    }
