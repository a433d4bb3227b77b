"""Corrections in conversations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.model import Model, ask, confirms
from ..functions.text import scrub

#: Wording of negation, of directives and of repeated complaints.
NEGATION = r"\b(hay[ıi]r|yanl[ıi][şs]|öyle de[ğg]il|olmaz|demedim|de[ğg]il mi|no|wrong|incorrect|not right|that'?s not)\b"
DIRECTIVE = r"(şöyle olmal[ıi]|böyle yap|yapma\b|kald[ıi]r\b|tekrar yap|düzelt|bir daha|asla|her zaman|lütfen .* yapma|should (be|have)|don'?t\b|instead\b|actually\b|next time|always|never)\b"
REPEAT = r"(yine|gene|demi[şs]tim|söylemi[şs]tim|again|told you|as i said)"
THRESHOLD = 0.5


def ascii_words(pattern: str) -> str:
    """A pattern as RE2 (SQL's dialect) reads it with (?i): word edges know ASCII letters, digits and _ only, a letter matches its
    own case folding (so no dotless or dotted capital for i), and the dot all but the line feed."""
    edge = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"

    def one(m: re.Match) -> str:
        c = m[0]
        if c.startswith("\\"):
            return edge if c == r"\b" else c
        folded = {x for x in (c, c.lower(), c.upper(), "\u017f", "\u212a") if len(x) == 1 and x.casefold() == c.casefold()}
        return "[" + "".join(sorted(folded)) + "]"

    return "(?d)" + re.sub(r"\\.|[^\W\d_]", one, pattern)


def signals(text: Column, ascii_only: bool = False) -> Column:
    """The kinds of wording found. Words are Unicode's; with ascii_only they are SQL's (ascii_words), where "noñ" holds the word no."""
    read = ascii_words if ascii_only else lambda p: "(?iuU)" + p
    found = [F.when(text.rlike(read(p)), n) for n, p in (("negation", NEGATION), ("directive", DIRECTIVE), ("repeat", REPEAT))]
    return F.array_compact(F.array(*found))


MOST_BEFORE, MOST_VERIFIED = 300, 600


def correction_text(text: Column, previous: Column) -> Column:
    """What is classified: the assistant's last words, cut, and the user's.

    Fixed values: the two labels."""
    before = F.concat(F.lit("AI şunu yaptı: "), F.substring(previous, 1, MOST_BEFORE), F.lit("\n"))
    return F.concat(F.coalesce(F.when(previous != "", before), F.lit("")), F.lit("Kullanıcı düzeltmesi: "), F.coalesce(text, F.lit("")))


def verified(scanned: DataFrame, model: Model | None) -> DataFrame:
    """scan()'s corrections that a model confirms (all without a model, and where it gave no answer), with text to classify."""
    found = scanned.where("correction").withColumn("raw", correction_text(F.col("text"), F.col("previous")))
    if model is None:
        return found.withColumn("verified", F.lit(True))
    cut = lambda c: F.substring(scrub(c), 1, MOST_VERIFIED)
    prompt = F.concat(cut(F.coalesce("previous", F.lit(""))), F.lit("\n\n"), cut(F.coalesce("text", F.lit(""))))
    asked = ask(found, "Does the user correct the assistant's last answer? Say YES or NO.", prompt, model)
    return asked.withColumn("verified", F.coalesce(confirms(F.col("reply")), F.lit(True))).where("verified").drop("reply")


def scan(turns: DataFrame, ascii_only: bool = False) -> DataFrame:
    """turns: conv_id, turn, role, text. Each user turn with the latest assistant text before it, its signals and score."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = turns.withColumn("previous", F.last(F.when(F.col("role") == "assistant", F.col("text")), ignorenulls=True).over(before))
    return scored(t.where("role = 'user'").select("conv_id", "turn", "text", "previous"), ascii_only)


def scored(said: DataFrame, ascii_only: bool = False) -> DataFrame:
    """said: conv_id, turn, text and previous of user turns, with signals and score."""
    t = said.withColumn("signals", signals(F.coalesce("text", F.lit("")), ascii_only))
    score = F.least(F.lit(1.0), 0.5 * F.size("signals"))
    return t.select("conv_id", "turn", "text", "previous", "signals", score.alias("score"), (score >= THRESHOLD).alias("correction"))
