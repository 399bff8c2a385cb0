"""Scalar functions on text as Column expressions; all run inside Spark's JVM.

Character classes are the publication engine's: code points, not locale. Java's \\s, \\w and \\d are ASCII, so (?U) is set where Unicode is meant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Character classes, as the insides of a bracket expression that Java and RE2 both read.
HAN = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}"
CJK = HAN + r"\x{3000}-\x{303F}\x{FF01}-\x{FF5E}"
MATH = "∈∉∑∏√∫≈≠≤≥±×⋅∗∘→←↔∂∇‖⊤∀∃αβγδθλμσπΣΠ"
TERMINAL = r".!?\"”’…:;)。！？」』）"
CLAUSE = "，、；：,;:"
BLOCKED = "=·∗†‡∈∑∏√∫≈≤≥±×"
#: Limits of the rules.
MIN_TEXT_CHARS = 200
FAILED_MARK = "[translation failed]"
SLUG_CHARS = 60


def occurrences(text: Column, chars: str) -> Column:
    """How often a character of the class occurs."""
    return F.regexp_count(text, F.lit(f"[{chars}]"))


def clean_space(text: Column) -> Column:
    """Runs of white space of any kind to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def cjk_ratio(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(occurrences(text, CJK) / F.length(text))


def has_han(text: Column) -> Column:
    return text.rlike(f"[{HAN}]")


def is_chinese(text: Column) -> Column:
    """Any Han character, or mostly characters of the wider class."""
    return has_han(text) | (cjk_ratio(text) > 0.5)


def latin_count(text: Column) -> Column:
    return occurrences(text, "A-Za-z")


def han_count(text: Column) -> Column:
    return occurrences(text, HAN)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]{2,}"))


def has_words(text: Column, n: int) -> Column:
    """Whether word_count is n or more, without a count: a look that ends at the n-th word."""
    return text.rlike(rf"(?:(?<![A-Za-z])[A-Za-z]{{2,}}+[^A-Za-z]++(?:[A-Za-z][^A-Za-z]++)*+){{{n - 1}}}[A-Za-z]{{2}}")


def is_non_prose(text: Column) -> Column:
    """Formula debris, labels and references; the order of the rules counts. Numbers are tested by looks, as they matter up to five only."""
    math, n = text.rlike(f"[{MATH}]"), F.length(text)
    return F.when(has_han(text), False).when(~has_words(text, 2), True).when((n < 250) & text.rlike(f"(?s)[{MATH}].*[{MATH}]"), True).when((n < 120) & math & ~has_words(text, 5), True).otherwise(False)


def is_page_number(text: Column, y0: Column, height: Column) -> Column:
    return text.rlike(r"^\p{Nd}+$") & (F.length(text) <= 4) & (y0 > 0.85 * height)


def is_header_date(text: Column, y1: Column, height: Column) -> Column:
    return text.rlike(r"^\p{Nd}{4}[./-]\p{Nd}{1,2}[./-]\p{Nd}{1,2}$") & (y1 < 0.15 * height)


def ends_terminal(text: Column) -> Column:
    return text.rlike(f"[{TERMINAL}]$") & ~text.rlike("\n$")


def starts_like_continuation(text: Column, before: Column) -> Column:
    """A small letter, or Han after Han."""
    return text.rlike(r"^\p{Ll}") | (text.rlike(f"^[{HAN}]") & before.rlike(f"[{HAN}]$"))


def join_text(a: Column, b: Column) -> Column:
    """Two pieces of a paragraph: a hyphen goes, CJK takes no space."""
    return F.when(a.endswith("-"), F.concat(F.substr(a, F.lit(1), F.length(a) - 1), b)).when(a.rlike(f"[{CJK}]$") | b.rlike(f"^[{CJK}]"), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def escape_currency(text: Column) -> Column:
    """A dollar sign before a digit is money, not mathematics; fenced text stays."""
    return F.when(text.startswith("```"), text).otherwise(F.regexp_replace(text, r"\$(?=\p{Nd})", r"\\\$"))


def pad_inline_math(text: Column) -> Column:
    """A space on either side of a one-line $...$ span; $$ and escaped signs stay.

    Spans are set between two marks that no text has; a mark beside something else than white space becomes a space, the others go."""
    a, b = "﷐", "﷑"
    marked = F.regexp_replace(text, r"(?<![$\\])(\$[^$\n]+?\$)(?!\$)", f"{a}$1{b}")
    # two spans side by side get one space
    marked = F.regexp_replace(marked, b + a, " ")
    marked = F.regexp_replace(marked, f"(?U)(?<=\\S){a}", " ")
    return F.regexp_replace(F.regexp_replace(marked, f"(?U){b}(?=\\S)", " "), f"[{a}{b}]", "")


def slug(title: Column) -> Column:
    """A file name's middle: letters, digits and Han, joined by hyphens, at most 60 characters."""
    joined = F.btrim(F.regexp_replace(title, r"[^A-Za-z0-9\x{4E00}-\x{9FFF}]+", "-"), F.lit("-"))
    cut = F.regexp_replace(F.substr(joined, F.lit(1), F.lit(SLUG_CHARS)), "-+$", "")
    return F.when(cut == "", F.lit("untitled")).otherwise(cut)


def safe_file_name(name: Column) -> Column:
    return name.rlike(r"(?U)^[\w\-\x{4E00}-\x{9FFF}（）()]+\.md$")


def strip_fences(reply: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(reply, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "^```json", ""), "^```", "")
    bare = F.regexp_replace(bare, "```$", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def repaired_json(text: Column, schema: str) -> Column:
    """The first that parses: the text, its end quoted anew before the last brace, a quote and brace more, a brace more; else null."""
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    quoted = F.when(bare.endswith("}"), F.concat(F.regexp_replace(F.substr(bare, F.lit(1), F.length(bare) - 1), r"(?U)\s+$", ""), F.lit('"}')))
    options = {"allowUnquotedControlChars": "true", "mode": "PERMISSIVE"}
    tries = [text, quoted, F.concat(text, F.lit('"}')), F.concat(text, F.lit("}"))]
    return F.coalesce(*(F.from_json(t, schema, options) for t in tries))


def zh_variants(zh: Column) -> Column:
    """Renderings that count: all of it, what stands before a gloss in brackets, and it without title marks; two characters at least."""
    forms = F.array(zh, F.substring_index(zh, "（", 1), F.translate(zh, "《》", ""))
    return F.array_distinct(F.filter(F.transform(forms, lambda v: F.trim(v)), lambda v: F.length(v) >= 2))


def preview(text: Column, chars: int) -> Column:
    return F.substr(text, F.lit(1), F.lit(chars))


def has_term(text_lower: Column, key: Column) -> Column:
    """The key between characters that are no small letters or digits."""
    return F.rlike(text_lower, F.concat(F.lit(r"(?<![a-z0-9])\Q"), key, F.lit(r"\E(?![a-z0-9])")))


def is_math_only(spans: Column) -> Column:
    """A line whose spans (font, text) are mathematics: a core mathematical font, and 85 of 100 characters in any such font."""
    chars = lambda xs: F.aggregate(xs, F.lit(0), lambda n, s: n + F.length(s["text"]))
    total = chars(spans)
    math = chars(F.filter(spans, lambda s: s["font"].rlike(r"(?i)^(CM|MSAM|MSBM|Euler|.*Math)")))
    core = F.exists(spans, lambda s: s["font"].rlike(r"(?i)^(CMMI|CMSY|CMEX)"))
    return F.when(total == 0, False).otherwise(core & (math / total >= 0.85))
