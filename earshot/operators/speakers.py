"""Speaker context, fills, islands and role alignment within a call."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from earshot.functions import fixed
from earshot.functions.roles import role_of_title, role_scores, switch_line
from earshot.functions.text import SPACE


def context_window(rows: DataFrame, call: str, order: list[str], text: str, role: Column, before: int = 2, after: int = 2) -> Column:
    """The sentence with its neighbours and markers; a marker without neighbours is left out."""
    w = Window.partitionBy(call).orderBy(*order)
    prev = F.array_join(F.collect_list(text).over(w.rowsBetween(-before, -1)), " ")
    nxt = F.array_join(F.collect_list(text).over(w.rowsBetween(1, after)), " ")
    return F.concat_ws(" ", F.concat(F.lit("[SPEAKER="), role, F.lit("]")), F.when(prev != "", F.concat(F.lit("[CTX_BEFORE] "), prev)), F.col(text), F.when(nxt != "", F.concat(F.lit("[CTX_AFTER] "), nxt)))


def forward_fill(value: Column, call: str, order: list[str]) -> Column:
    """The last non-null value up to the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(call).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def islands(rows: DataFrame, value: str, call: str, order: list[str]) -> DataFrame:
    """Runs of one value within a call: ``call, island, value, first, last, n``."""
    w = Window.partitionBy(call).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) | (F.row_number().over(w) == 1)
    numbered = rows.withColumn("island", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(call, "island").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))


def positional_zip(sentences: DataFrame, roles: DataFrame, call: str, order: str, role: str, default: str = "IR") -> DataFrame:
    """The i-th role of a call on its i-th sentence; sentences beyond the roles get the default."""
    index = F.row_number().over(Window.partitionBy(call).orderBy(order))
    left = sentences.withColumn("idx", index)
    right = roles.select(call, F.col(role).alias("__role"), F.row_number().over(Window.partitionBy(call).orderBy(order)).alias("idx"))
    return left.join(right, [call, "idx"], "left").withColumn(role, F.coalesce("__role", F.lit(default))).drop("__role")


def degenerate_fix(role: Column, index: Column, n_roles: Column, n_rows: Column, allowed: list[str]) -> Column:
    """In a call of one role and ten or more sentences every seventh index gets a role of the allowed list in turn."""
    turn = F.get(F.array(*[F.lit(a) for a in allowed]), F.pmod(index, F.lit(len(allowed))))
    return F.when((n_roles == 1) & (n_rows >= 10) & (F.pmod(index, F.lit(7)) == 0), turn).otherwise(role)


def role_targets(n: int, priors: dict[str, float]) -> dict[str, int]:
    """How many of n sentences each role should have: the rounded share, one at least, then one more or less in turn until they sum to n."""
    target = {r: max(1, round(p * n)) for r, p in priors.items()}
    turn = [r for r in fixed.ROLE_TURN if r in target]
    left, k = n - sum(target.values()), 0
    while left and (left > 0 or any(target[r] > 1 for r in turn)):
        r = turn[k % len(turn)]
        if left > 0:
            target[r] += 1
            left -= 1
        elif target[r] > 1:
            target[r] -= 1
            left += 1
        k += 1
    return target


def _rebalanced(roles: list[str], scores: np.ndarray, names: list[str], priors: dict[str, float]) -> list[str]:
    """Roles that lack sentences take them, in the order of ``names``, from those of IR or of no listed role: best score first, then the earliest."""
    held, target = Counter(roles), role_targets(len(roles), priors)
    free = np.array([i for i, r in enumerate(roles) if r == "IR" or r not in priors], np.int64)
    out = list(roles)
    for k, r in enumerate(names):
        need = max(0, target[r] - held[r])
        best = free[np.argsort(-scores[free, k], kind="stable")[:need]]
        for i in best.tolist():
            out[i] = r
        free = free[~np.isin(free, best)]
    return out


def rebalance(rows: DataFrame, call: str, order: str, role: str, text: str, priors: dict[str, float] | None = None) -> DataFrame:
    """``call, order, role`` with each call's roles moved towards the shares of ``priors``.

    The scores are columns; the reassignment ranks the sentences of a call, so
    sorted partitions are worked through call by call. Roles outside the
    priors that aren't taken stay as they are.
    """
    priors = priors or fixed.ROLE_PRIORS
    names = list(priors)
    score = role_scores(F.col(text))
    scored = rows.select(F.col(call).alias(call), F.col(order).alias(order), F.col(role).alias(role), *[score[r].alias(f"s_{r}") for r in names])
    schema = f"{call} {rows.schema[call].dataType.simpleString()}, {order} {rows.schema[order].dataType.simpleString()}, {role} string"

    def done(batch: pa.Table) -> pa.RecordBatch:
        keys = batch.column(0).to_pylist()
        given = batch.column(2).to_pylist()
        scores = np.column_stack([batch.column(3 + k).to_numpy() for k in range(len(names))]) if keys else np.zeros((0, len(names)))
        out, at = [], 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[at]:
                out += _rebalanced(given[at:k], scores[at:k], names, priors)
                at = k
        return pa.RecordBatch.from_arrays([batch.column(0).combine_chunks(), batch.column(1).combine_chunks(), pa.array(out, pa.string())], [call, order, role])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            keys = held.column(0)
            last = keys[held.num_rows - 1]
            # the last call of a batch may go on in the next
            cut = held.num_rows
            while cut and keys[cut - 1] == last:
                cut -= 1
            if cut:
                yield done(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield done(held)

    return scored.where(F.col(call).isNotNull()).repartition(call).sortWithinPartitions(call, order).mapInArrow(run, schema)


_TIME = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?"
_TITLE = r"(?i:officer|president|director|relations|analyst|head|chair)"


def label_name(label: Column) -> Column:
    """The name in a speaker label, without times, question or answer marks, title, firm and separators; "Last, First" turned round."""
    bare = F.trim(F.regexp_replace(label, rf"^(?:\s*[\[(<]?\s*{_TIME}(?:\s*-->\s*{_TIME})?\s*[\])>]?)+", ""))
    bare = F.regexp_replace(bare, r"^<\s*[QA]\s*[-–—]\s*(.*?)\s*>$", "$1")
    bare = F.regexp_replace(bare, rf"^(\p{{L}}[\p{{L}}\p{{M}}.'’-]*),\s*(?!\S*{_TITLE})(\p{{L}}[\p{{L}}\p{{M}}.'’-]*)$", "$2 $1")
    bare = F.regexp_replace(bare, r"(?s)(?:\s[-–—](?:\s.*)?|\s*:|\s*\(.*|,\s.*)$", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def full_label(label: Column) -> Column:
    """Whether a label introduces its speaker: a name and, after a dash, a comma or in brackets, a title, or a firm inside question marks."""
    titled = label.rlike(rf"\p{{L}}\.?(?:\s[-–—]\s|,\s|\s*\().*{_TITLE}")
    return (titled | label.rlike(r"<\s*[QA]\s*[-–—]\s.*\s[-–—]\s.*>\s*$")) & F.contains(label_name(label), F.lit(" "))


def match_names(rows: DataFrame, name: str, roster: str, least: float = 0.75) -> DataFrame:
    """Add ``matched, ratio``: the closest name of the row's roster array by sequence similarity, exact first."""
    schema = StructType([*rows.schema.fields, StructField("matched", StringType()), StructField("ratio", DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found, ratios = [], []
            for n, names in zip(pdf[name], pdf[roster]):
                best, top = None, 0.0
                for other in names if names is not None and n is not None else []:
                    r = 1.0 if other == n else difflib.SequenceMatcher(None, n.lower(), other.lower()).ratio()
                    if r > top:
                        best, top = other, r
                found.append(best if top >= least else None)
                ratios.append(top)
            yield pdf.assign(matched=found, ratio=ratios)

    return rows.mapInPandas(run, schema)


def _squeeze(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def participants(text: Column) -> Column:
    """Participants of a transcript and their roles: ``array<struct<name, role>>``, names in lower case, the last mention counting.

    A heading opens a block, the start of the talk closes it. In a block, a
    line "Name - title" (dash or comma between spaces, reference numbers left
    out) names a participant: the role is that of the title, else Analyst for
    an analyst, a broker or in a block of analysts, else IR. One pass over the
    lines carries the open block along.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"), _squeeze), lambda p: p != "")
    split = rf"{SPACE}+[-—,]{SPACE}+"

    def entry(line: Column, block: Column) -> Column:
        bare = F.regexp_replace(line, r"\s*\[\d+\]\s*$", "")
        name, right = F.trim(F.lower(F.regexp_extract(bare, rf"(?s)^(.*?){split}", 1))), F.regexp_extract(bare, rf"(?s)^.*?{split}(.*)$", 1)
        analyst = F.contains(F.lower(right), F.lit("analyst")) | F.contains(block, F.lit("analyst"))
        role = F.coalesce(F.get(F.transform(F.array(right), role_of_title), 0), F.when(analyst, "Analyst"), F.lit("IR"))
        return F.when(bare.rlike(split) & (name != ""), F.struct(name.alias("name"), role.alias("role")))

    found = "array<struct<name: string, role: string>>"
    start = F.struct(F.lit(None).cast("string").alias("block"), F.array().cast(found).alias("found"))

    def step(acc: Column, line: Column) -> Column:
        opens, closes = line.rlike(fixed.PARTICIPANTS_OPEN), line.rlike(fixed.PARTICIPANTS_CLOSE)
        block = F.when(opens, F.lower(line)).when(~closes, acc["block"])
        inside = acc["block"].isNotNull() & ~opens & ~closes
        new = F.when(inside, entry(line, acc["block"]))
        return F.struct(block.alias("block"), F.when(new.isNotNull(), F.concat(acc["found"], F.array(new))).otherwise(acc["found"]).alias("found"))

    listed = F.aggregate(lines, start, step, lambda acc: acc["found"])
    # the last mention of a name counts
    return F.transform(F.array(listed), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["name"] == p["name"])))[0]


def _name_role(name: str, roster: dict[str, str], brokers: bool = True) -> str | None:
    """Role of a name: as listed, else of the closest listed name, else Analyst for one with a broker in it."""
    key = name.lower().strip()
    if key in roster:
        return roster[key]
    near = difflib.get_close_matches(key, list(roster), n=1, cutoff=0.75) if roster else []
    if near:
        return roster[near[0]]
    return "Analyst" if brokers and any(b.lower() in key for b in fixed.BROKERS) else None


def transcript_roles(documents: DataFrame, key: str, text: str, start: str = "IR", miss: str | None = None, brokers: bool = True) -> DataFrame:
    """``key, part_no, role, part``: the parts of each transcript with the role that speaks.

    Lines that switch the speaker, rulings and headings are no text. A part
    ends where the speaker switches, at a ruling, and at a line that ends a
    sentence once the part holds 200 characters. Roles start as ``start``; a
    switch line gives the role of its name, else that of its title, else
    ``miss`` (None: the role stays); a line that begins with "Q:" or
    "Operator:" switches too. Null texts give no part. The older way of
    reading (R15) is ``start="Unknown", miss="Unknown", brokers=False``.
    """
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"), _squeeze), lambda p: p != "")
    rows = documents.where(F.col(text).isNotNull()).select(F.col(key).alias(key), lines.alias("lines"), F.transform(participants(F.col(text)), lambda p: p).alias("who"))
    rows = rows.select(key, "who", F.transform("lines", lambda x: F.struct(x.alias("line"), switch_line(x).alias("s"))).alias("lines"))
    schema = f"`{key}` {documents.schema[key].dataType.simpleString()}, part_no int, role string, part string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, parts = [], []
            for n, (who, lines) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                found = list(_parts({p["name"]: p["role"] for p in who or []}, lines, start, miss, brokers))
                at += [n] * len(found)
                parts += [(k, *p) for k, p in enumerate(found)]
            columns = [pa.array([p[j] for p in parts], t) for j, t in enumerate((pa.int32(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], [key, "part_no", "role", "part"])

    return rows.mapInArrow(run, schema)


def _parts(roster: dict[str, str], lines: list[dict], start: str, miss: str | None, brokers: bool) -> Iterator[tuple[str, str]]:
    role, held, size = start, [], 0
    for x in lines:
        line, switch = x["line"], x["s"]
        if any(re.match(p, line) for p in fixed.HEADING_LINES):
            continue
        new = role
        ends = bool(re.match(r"^[-=]{3,}$", line))
        if not ends and switch is not None and (switch["name"] is not None or switch["role"] is not None):
            ends, new = True, (switch["name"] is not None and _name_role(switch["name"], roster, brokers)) or switch["role"] or miss or role
        elif not ends and (m := re.match(fixed.SWITCH_PREFIX, line)):
            ends, new = True, "Operator" if m[1].lower() == "operator" else "Analyst"
        if not ends:
            held.append(line)
            size += len(line)
            ends = size > 200 and line[-1] in "。.!?"
        if ends and held:
            yield role, " ".join(held)
            held, size = [], 0
        role = new if new in fixed.ROLES or new == miss else role
    if held:
        yield role, " ".join(held)


def fill_near(value: Column, call: str, order: list[str], reach: int = 3) -> Column:
    """The value, else the nearest known one within ``reach`` rows of the call, the row before winning."""
    w = Window.partitionBy(call).orderBy(*order)
    near = [f(value, d).over(w) for d in range(1, reach + 1) for f in (F.lag, F.lead)]
    return F.coalesce(value, *near)
