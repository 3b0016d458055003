"""Speaker roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.functions import fixed
from earshot.functions.text import SPACE, contains_any, count_contained


def canonical_role(text: Column) -> Column:
    """The role of the first alias that the cleaned text holds, in the order of the alias list; empty if none.

    Aliases are substrings, so "director" counts as "cto": that is the defined behaviour.
    """
    return _first_alias(_letters(text))


def _letters(text: Column) -> Column:
    """Lower case, letters only, single spaces."""
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z\s]", " "))), r"\s+", " ")


def _first_alias(clean: Column) -> Column:
    out = None
    for alias, role in fixed.ROLE_ALIASES:
        hit = F.contains(clean, F.lit(alias))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("")


def normal_role(text: Column) -> Column:
    """Exact alias, else the substring rule, else title case; Unknown for null and blank."""
    low = F.lower(F.trim(text))
    exact = F.create_map(*[F.lit(x) for pair in [*fixed.ROLE_ALIASES, *fixed.ROLE_ALIASES_OTHER] for x in pair])[low]
    loose = canonical_role(text)
    return F.when(F.coalesce(low, F.lit("")) == "", "Unknown").otherwise(F.coalesce(exact, F.when(loose != "", loose), F.initcap(F.trim(text))))


def role_by_phrases(text: Column) -> Column:
    """Operator or Analyst at one phrase, CFO, CEO or IR at two; null if none fits."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(contains_any(low, fixed.ROLE_PHRASES["Operator"]), "Operator").when(contains_any(low, fixed.ROLE_PHRASES["Analyst"]), "Analyst")
    for role in ("CFO", "CEO", "IR"):
        out = out.when(count_contained(low, fixed.ROLE_PHRASES[role]) >= 2, role)
    return out


def role_scores(text: Column) -> dict[str, Column]:
    """Score of each role: questions, greetings, numbers and phrases."""
    low = F.lower(F.coalesce(text, F.lit("")))
    scores = {r: count_contained(low, words).cast("double") for r, words in fixed.ROLE_PHRASES.items()}
    scores["Analyst"] = scores["Analyst"] + F.when(F.contains(low, F.lit("?")) | F.trim(low).startswith("q:") | F.trim(low).startswith("question:"), fixed.QUESTION_POINTS).otherwise(0.0)
    scores["Operator"] = scores["Operator"] + F.when(contains_any(low, fixed.GREETINGS), fixed.GREETING_POINTS).otherwise(0.0)
    scores["CFO"] = scores["CFO"] + F.when(F.size(F.regexp_extract_all(low, F.lit(r"\d+(\.\d+)?"), F.lit(0))) >= 2, fixed.NUMBER_POINTS).otherwise(0.0)
    return scores


def role_of_title(title: Column) -> Column:
    """The role that a title or firm gives: its alias, else Analyst for a broker; null if none."""
    alias = F.get(F.transform(F.array(_letters(title)), _first_alias), 0)
    broker = contains_any(F.lower(title), [b.lower() for b in fixed.BROKERS])
    return F.when(alias != "", alias).when(broker, "Analyst")


def switch_line(text: Column) -> Column:
    """``struct<name, role>`` of a line that switches the speaker (X15), null of one that does not.

    A lone "Operator", "Moderator" or "Host", a lone "Q:" or "Question:", a
    name with a colon and nothing behind it, or a name and, behind a dash or
    comma, a title or firm. Name or role may be null.
    """
    return F.get(F.transform(F.array(F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")), _switch), 0)  # the trimmed line is bound once


def _switch(s: Column) -> Column:
    none = F.lit(None).cast("string")
    line = lambda name, role: F.struct(name.alias("name"), role.alias("role"))
    title = F.array(F.regexp_replace(F.regexp_extract(s, fixed.SWITCH_TITLED, 2), f"^{SPACE}+|{SPACE}+$", ""))
    return (
        F.when(s.rlike(fixed.SWITCH_OPERATOR), line(none, F.lit("Operator")))
        .when(s.rlike(fixed.SWITCH_QUESTION), line(none, F.lit("Analyst")))
        .when(s.rlike(fixed.SWITCH_NAME), line(F.regexp_replace(s, r"\s*:$", ""), none))
        .when(s.rlike(fixed.SWITCH_TITLED), line(F.trim(F.regexp_extract(s, fixed.SWITCH_TITLED, 1)), F.get(F.transform(title, role_of_title), 0)))
    )
