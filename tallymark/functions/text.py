"""Text columns: trimming, clipping, redaction, model names, roles and templates of prompts."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Redactions, in order: pattern and replacement.
REDACTIONS = [
    (r"sk-[A-Za-z0-9_\-]{8,}", "sk-[REDACTED]"),
    (r"AKIA[0-9A-Z]{16}", "AKIA[REDACTED]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "gh_[REDACTED]"),
    (r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b", "[REDACTED@email]"),
    (r"(?i)\b(?:api[_-]?key|token|secret|password)\b\s*[:=]\s*\S+", "[REDACTED credential]"),
    (r"(?i)\bbearer\s+\S+", "bearer [REDACTED]"),
    (r"(?i)\b[0-9a-f]{32,}\b", "[REDACTED hex]"),
]
#: Words that a template leaves out.
STOPWORDS = "the a an this that these those of for to in on as is are and or from with into by at be".split()
#: Roles of prompts, the first match counts.
ROLES = [
    (r"\brout|\bintent\b", "Router"),
    (r"classif|categor", "Classifier"),
    (r"sentiment", "SentimentTrier"),
    (r"\bspam\b", "SpamFilter"),
    (r"toxic|moderat", "Moderator"),
    (r"\brat(?:e|ing)|\bscor(?:e|ing)|prioriti", "Rater"),
    (r"\bjudg|evaluat", "Judge"),
    (r"\bextract", "Extractor"),
    (r"\blabel|\btag(?:s|ging)?\b", "Tagger"),
    (r"\bfilter|duplicate", "Filter"),
    (r"\bverif|\bvalidat|\bcheck", "Verifier"),
    (r"triage", "TriageSorter"),
]
DEFAULT_ROLE = "Decider"


def stripped(c: Column) -> Column:
    """Without Unicode space at either end."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def folded(c: Column) -> Column:
    """In lower case as patterns that ignore case see it: the four letters outside ASCII that equal an ASCII one become that one.

    A pattern in lower case then needs no ``(?i)``, which costs several times as much in Java.
    """
    return F.lower(F.when(F.length(c) == F.octet_length(c), c).otherwise(F.translate(c, "ſıİ\u212a", "siik")))


def any_of(stems: list[str]) -> str:
    """One pattern for all stems that asks for the start of a word once for those that want one, not once for each."""
    starts = [s.removeprefix(r"\b").replace(r"|\b", "|") for s in stems if s.startswith(r"\b")]
    return "|".join([rf"\b(?:{'|'.join(starts)})", *(s for s in stems if not s.startswith(r"\b"))])


def holds(low: Column, pattern: str) -> Column:
    """Whether a folded text matches ``pattern``; it is searched only where it holds the letters that an alternative begins with."""
    letters = re.findall(r"(?:^|\|(?![^(]*\)))(?:\\b)?([a-z]+)", pattern)
    return reduce(operator.or_, (F.contains(low, F.lit(x)) for x in letters)) & low.rlike(f"(?U)(?:{pattern})")


def clipped(c: Column, head: int = 300, tail: int = 120, limit: int = 440) -> Column:
    """Stripped; beyond ``limit`` characters, the head and the tail around an ellipsis."""
    t = stripped(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, head), F.lit(" … "), F.right(t, F.lit(tail)))).otherwise(t)


def normal_output(c: Column) -> Column:
    """Stripped, lower case, runs of space as one space."""
    return stripped(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))


def normal_model(c: Column) -> Column:
    """Lower case, last path segment, without a date at the end."""
    return F.regexp_replace(F.substring_index(F.lower(stripped(F.coalesce(c, F.lit("")))), "/", -1), r"(-\d{4}-\d{2}-\d{2}|-\d{8})\z", "")


def redacted(c: Column) -> Column:
    """Keys, addresses, credentials and long hex strings masked, rule by rule."""
    for pattern, to in REDACTIONS:
        c = F.regexp_replace(c, f"(?U){pattern}", to)
    return c


def cell(c: Column, most: int | None = None) -> Column:
    """One table cell of Markdown: pipes escaped, line ends shown, cut with an ellipsis if asked."""
    c = F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ⏎ "))
    return c if most is None else F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 1), F.lit("…"))).otherwise(c)


def role(prompt: Column) -> Column:
    """The role that a prompt asks for."""

    def first(low: Column) -> Column:
        out = F.lit(DEFAULT_ROLE)
        for pattern, name in reversed(ROLES):
            out = F.when(holds(low, pattern), F.lit(name)).otherwise(out)
        return out

    return F.transform(F.array(folded(prompt)), first)[0]  # folded once, not once for each role


def template(prompt: Column, words: int = 5) -> Column:
    """The first words of a prompt that are not stopwords, in lower case."""
    found = F.regexp_extract_all(F.lower(prompt), F.lit("([a-z']+)"), 1)
    return F.array_join(F.slice(F.filter(found, lambda w: ~w.isin(STOPWORDS)), 1, words), " ")
