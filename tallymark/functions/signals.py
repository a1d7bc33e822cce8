"""How much a call looks like a typed decision: six signals between 0 and 1, a score and a verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.functions.text import any_of, folded, stripped

#: Weights of the signals.
WEIGHTS = {
    "short_output": 0.25,
    "structured_output": 0.25,
    "decision_language": 0.20,
    "question_shape": 0.10,
    "short_input": 0.10,
    "low_output_diversity": 0.10,
}
#: Least scores of the verdicts.
LIKELY, MAYBE = 0.60, 0.35
#: Verdicts in the order of reports.
VERDICTS = ["likely", "maybe", "unlikely", "insufficient"]
#: Factor of calls that ask for prose and for no decision.
PENALTY = 0.6
#: Stems of decision language.
DECISION = [
    r"classif", r"categor", r"\brout(?:e|es|ed|ing|er)\b", r"\bjudg(?:e|es|ed|ing)\b", r"evaluat", r"\brat(?:e|es|ed|ing)\b", r"\bscor(?:e|es|ed|ing)\b",
    r"\blabel(?:s|ed|ling)?\b", r"\btag(?:s|ged|ging)?\b", r"\bextract", r"\bfilter", r"moderat", r"\bverif", r"\bvalidat", r"\bcheck(?:s|ed|ing)?\b",
    r"sentiment", r"\bspam\b", r"toxic", r"\bintent\b", r"\btopic\b", r"triage", r"prioriti", r"approv", r"\bflag(?:s|ged|ging)?\b", r"\brank(?:s|ed|ing)?\b",
    r"duplicate", r"\bgrade\b|\bgrading\b", r"\bdecide|\bdecision", r"yes or no",
]
#: Stems of generative language.
GENERATIVE = [
    r"\bwrite|\bwrote|\bwriting\b", r"\bdraft", r"\bsummar", r"\bessay", r"\bstory\b", r"\bpoem", r"\brewrite", r"\btranslat", r"\bexplain", r"\bgenerat",
    r"\bbrainstorm", r"\bblog\b", r"\barticle", r"\bcompose", r"\brefactor",
]
#: Verbs that open a question.
STARTERS = "is are was were does do did should would can could will has have".split()
#: Least tokens or characters over which a step of a signal ends, and its value there.
OUTPUT_TOKENS = [(4, 1.0), (16, 0.9), (32, 0.6), (64, 0.3), (128, 0.1)]
OUTPUT_CHARS = [(0, 0.0), (8, 1.0), (32, 0.8), (64, 0.5), (128, 0.25)]
INPUT_TOKENS = [(512, 1.0), (1024, 0.7), (2048, 0.4), (4096, 0.15)]
INPUT_CHARS = [(0, 0.0), (2048, 1.0), (4096, 0.7), (8192, 0.4), (16384, 0.15)]


def steps(c: Column, table: list[tuple[int, float]]) -> Column:
    """The value of the first step that reaches c; 0 beyond all."""
    out = F.lit(0.0)
    for most, value in reversed(table):
        out = F.when(c <= most, F.lit(value)).otherwise(out)
    return out


def _by_size(tokens: Column, text: Column, by_tokens: list, by_chars: list) -> Column:
    return F.when(tokens.isNotNull(), steps(tokens, by_tokens)).otherwise(steps(F.length(stripped(F.coalesce(text, F.lit("")))), by_chars))


def short_output(tokens: Column, text: Column) -> Column:
    return _by_size(tokens, text, OUTPUT_TOKENS, OUTPUT_CHARS)


def short_input(tokens: Column, text: Column) -> Column:
    return _by_size(tokens, text, INPUT_TOKENS, INPUT_CHARS)


def is_json(text: Column) -> Column:
    """Whether a text is one JSON array or object as Python reads it: NaN, Infinity and repeated keys pass. Null is not.

    Escapes and the insides of strings are taken out first, so only the structure is left. That has to be
    the single member of an array and of an object alike, so nothing can follow it: a bracket ends one of
    the two too early, a comma makes a second member. Arrays nested more than about a thousand deep are no JSON.
    """
    control = F.lit(r"[\x00-\x1F]")
    plain = F.regexp_replace(text, r'\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4})', "x")
    bare = F.regexp_replace(plain, r'"[^"]*"', '""')
    inside_clean = (F.regexp_count(plain, control) == F.regexp_count(bare, control)) & ~F.contains(plain, F.lit("\\")) & ~F.contains(bare, F.lit("'"))
    numbers = F.regexp_replace(bare, r"(?<![\w.+-])(?:-?Infinity|NaN)(?![\w.])", "0")
    member = F.json_array_length(F.concat(F.lit("["), numbers, F.lit("]"))) == 1
    value = F.size(F.json_object_keys(F.concat(F.lit('{"x":'), numbers, F.lit("}")))) == 1
    return F.coalesce(inside_clean & member & value, F.lit(False))


def structured_output(text: Column) -> Column:
    t = stripped(F.coalesce(text, F.lit("")))
    begins = F.substring(t, 1, 1).isin("{", "[")
    return (
        F.when(t == "", 0.0)
        .when(begins, F.when(is_json(t), 1.0).otherwise(0.5))
        .when(F.lower(t).isin("yes", "no", "true", "false"), 1.0)
        .when(t.rlike(r"(?U)\A-?\d+(?:\.\d+)?\z"), 1.0)
        .when((F.length(t) <= 48) & t.rlike(r"\A[A-Za-z0-9][A-Za-z0-9_\-/ ]{0,47}\z") & (F.size(F.split(t, " +")) <= 4), 0.8)
        .otherwise(0.0)
    )


def hits(text: Column, stems: list[str]) -> Column:
    """Stems found in a text, without overlaps."""
    return F.regexp_count(folded(F.coalesce(text, F.lit(""))), F.lit(f"(?U){any_of(stems)}"))


def decision_language(prompt: Column) -> Column:
    n = hits(prompt, DECISION)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), 0.5 + 0.15 * n))


def question_shape(prompt: Column) -> Column:
    t = stripped(F.coalesce(prompt, F.lit("")))
    ends, starts = t.endswith("?"), t.rlike(rf"(?iU)\A\s*(?:{'|'.join(STARTERS)})\b")
    return F.least(F.lit(1.0), F.when(ends, 0.7).otherwise(0.0) + F.when(starts, 0.3).otherwise(0.0))


def penalty(prompt: Column, decides: Column | None = None) -> Column:
    """``decides``: whether the prompt has decision language, where that is known already."""
    decides = hits(prompt, DECISION) > 0 if decides is None else decides
    return F.when(~decides & (hits(prompt, GENERATIVE) > 0), PENALTY).otherwise(1.0)


def low_diversity(cluster: Column) -> Column:
    """By how many calls of a model gave the same output."""
    return F.when(cluster >= 5, 1.0).when(cluster >= 2, 0.6).otherwise(0.0)


def score(signals: Column, prompt: Column, factor: Column | None = None) -> Column:
    """Weighted sum of a signals struct with the penalty, at four digits. ``factor``: the penalty, where that is known already."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * signals[name]
    return F.round(total * (penalty(prompt, signals["decision_language"] > 0) if factor is None else factor), 4)


def verdict(score: Column, likely: float = LIKELY, maybe: float = MAYBE) -> Column:
    return F.when(score >= likely, "likely").when(score >= maybe, "maybe").otherwise("unlikely")
