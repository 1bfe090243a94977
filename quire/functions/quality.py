"""How faithful a candidate rendition of a page is to its reference text, and how clean it is."""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx

# Openings of a refusal; words whose loss changes the meaning; patterns of what lint finds, and of a
# code with its label. Digits are ASCII digits here.
REFUSALS = ("non posso aiutart", "non sono in grado di", "mi dispiace, ma", "i'm sorry", "i am sorry", "i cannot assist", "as an ai", "non posso fornire")
CRITICAL_WORDS = ("non", "esclusi", "salvo", "tranne", "fino a", "almeno", "entro")

UNMAPPED_BULLET = r"(?m)^\s*n\s+[a-zàèéìòù]"
DOUBLE_SYMBOL = r"\d\s*%\s*%|%%|€€"
CODE_PAIR = r"(\d{1,3})\*{0,2}\s*=\s*([^\n;·|]+)"


@dataclass(frozen=True)
class Limits:
    overlap: float = 0.6
    number_recall: float = 0.95
    coverage_min: float = 0.5
    coverage_max: float = 2.0
    label_overlap: float = 0.5


def _once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def share(found: Column, of: Column) -> Column:
    """Size of one set in terms of another; 1 if the other is empty."""
    return F.when(F.size(of) == 0, F.lit(1.0)).otherwise(F.size(found) / F.size(of))


def recall(reference: Column, candidate: Column) -> Column:
    return share(F.array_intersect(reference, candidate), reference)


def jaccard(a: Column, b: Column) -> Column:
    """1 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def token_overlap(candidate: Column, reference: Column) -> Column:
    return recall(tx.content_words(reference), tx.content_words(candidate))


def coverage(candidate: Column, reference: Column) -> Column:
    n = F.length(tx.stripped(reference))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.length(tx.stripped(candidate)) / n)


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, as strings."""

    def of(w: Column) -> Column:
        count = F.size(w) - (n - 1)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))

    return _once(words, of)


def most_repeats(items: Column) -> Column:
    """How often the most frequent item occurs: sorted, so that equal items stand together."""
    start = F.struct(F.lit(None).cast("string").alias("item"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["item"] == x, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("item"), run.alias("run"), F.greatest(s["most"], run).alias("most"))

    return F.aggregate(F.array_sort(items), start, step, lambda s: s["most"])


def repeated(items: Column) -> Column:
    """(item, n) of items that occur more than once, within one row: sorted, so that equal ones are neighbours."""

    def of(s: Column) -> Column:
        n = F.greatest(F.size(s) - 1, F.lit(0))
        again = F.zip_with(F.slice(s, F.lit(1), n), F.slice(s, F.lit(2), n), lambda a, b: F.when(a == b, a))
        return F.transform(F.array_distinct(F.array_compact(again)), lambda g: F.struct(g.alias("item"), F.size(F.filter(s, lambda x: x == g)).cast("long").alias("n")))

    return _once(F.array_sort(items), of)


def _may_repeat(words: Column, n: int, most: int) -> Column:
    """False only if no n-gram occurs more than `most` times. Each n-gram holds a block of words that begins at a multiple
    of the block's length, at one of as many places as that length; if these are no more than `most`, two occurrences
    have it at the same place, so that a block occurs twice."""
    size = min((n + 1) // 2, most)
    if size < 1:
        return F.lit(True)
    count = F.floor(F.size(words) / size).cast("int")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: (i - 1) * size + 1)
    blocks = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
    return (count > 0) & _once(blocks, lambda b: F.size(F.array_distinct(b)) < F.size(b))


def repeats_itself(c: Column, n: int = 10, most: int = 8, diversity: float = 0.5, rows: Column | None = None) -> Column:
    """From 12 lines on, whether distinct lines are few; of shorter texts, whether an n-gram is too frequent. Its
    lines may be given."""
    rows = F.filter(F.transform(tx.lines(c) if rows is None else rows, tx.stripped), lambda x: x != "")
    words = F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    by_lines = _once(rows, lambda r: F.when(F.size(r) >= 12, F.size(F.array_distinct(r)) / F.size(r) < diversity))
    # n-grams are made and sorted only where one can be too frequent
    by_words = _once(words, lambda w: F.when(_may_repeat(w, n, most), most_repeats(ngrams(w, n)) > most).otherwise(F.lit(False)))
    return F.coalesce(by_lines, by_words)


def is_refusal(c: Column, markers: tuple[str, ...] = REFUSALS) -> Column:
    """Empty, or with the opening of a refusal."""
    low = F.lower(c)
    found = F.lit(False)
    for m in markers:
        found |= F.contains(low, F.lit(m))
    return (tx.stripped(c) == "") | found


def early_subheadings(rows: Column) -> Column:
    """Of lines, third-level headings before the first of the second level."""
    start = F.struct(F.lit(0).alias("n"), F.lit(False).alias("seen"))

    def step(s: Column, line: Column) -> Column:
        early = F.startswith(line, F.lit("### ")) & ~s["seen"]
        return F.struct((s["n"] + early.cast("int")).alias("n"), (s["seen"] | F.startswith(line, F.lit("## "))).alias("seen"))

    return F.aggregate(rows, start, step, lambda s: s["n"])


def heading_count(c: Column) -> Column:
    """Headings of the second and third level."""
    return F.size(F.filter(tx.lines(c), lambda r: F.startswith(r, F.lit("## ")) | F.startswith(r, F.lit("### "))))


def without_artifacts(c: Column, known: tuple[str, ...]) -> Column:
    for a in known:
        c = F.replace(c, F.lit(a), F.lit(""))
    return c


def artifacts(c: Column, known: tuple[str, ...]) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*map(F.lit, known)).cast("array<string>"), lambda a: F.contains(low, F.lower(a)))


def code_pairs(c: Column) -> Column:
    """(code, label) of `N = label`, the first label of each code."""
    pattern = F.lit(CODE_PAIR)
    found = F.arrays_zip(F.regexp_extract_all(c, pattern, 1).alias("code"), F.transform(F.regexp_extract_all(c, pattern, 2), tx.stripped).alias("label"))
    start = F.array().cast("array<struct<code:string,label:string>>")
    pairs = F.aggregate(found, start, lambda a, x: F.when(F.exists(a, lambda y: y["code"] == x["code"]), a).otherwise(F.concat(a, F.array(x))))
    return F.when(~F.contains(c, F.lit("=")), start).otherwise(pairs)  # most texts have none


def code_mismatches(candidate: Column, reference: Column, least: float = 0.5) -> Column:
    """Codes in both whose labels share too few words: (code, overlap), in order of codes."""
    return _once(code_pairs(candidate), lambda a: _once(code_pairs(reference), lambda b: _mismatches(a, b, least)))


def _mismatches(a: Column, b: Column, least: float) -> Column:
    def compare(pairs: Column, code: Column) -> Column:
        return F.filter(pairs, lambda p: p["code"] == code)[0]["label"]

    codes = F.array_sort(F.array_intersect(F.transform(a, lambda p: p["code"]), F.transform(b, lambda p: p["code"])))
    each = F.transform(codes, lambda c: F.struct(c.alias("code"), jaccard(tx.content_words(compare(a, c)), tx.content_words(compare(b, c))).alias("overlap")))
    return F.filter(each, lambda x: x["overlap"] < least)


def word_count(c: Column, word: str) -> Column:
    return F.regexp_count(F.lower(c), F.lit(rf"(?U)\b\Q{word.lower()}\E\b"))


def critical_losses(candidate: Column, reference: Column, words: tuple[str, ...] = CRITICAL_WORDS) -> Column:
    """Words that occur less often in the candidate: (word, in candidate, in reference). Single words are found in
    one pass over each text, as no two of them overlap, and counted among what was found."""
    single = [w.lower() for w in words if re.fullmatch(r"\w+", w)]
    any_of = rf"(?U)\b({'|'.join(rf'\Q{w}\E' for w in single)})\b"

    def hits(c: Column) -> Column:
        return F.regexp_extract_all(F.lower(c), F.lit(any_of), 1) if single else F.array().cast("array<string>")

    def count(found: Column, c: Column, word: str) -> Column:
        return F.size(F.filter(found, lambda h: h == word.lower())) if word.lower() in single else word_count(c, word)

    def losses(x: Column) -> Column:
        each = [F.struct(F.lit(w).alias("word"), count(x["a"], candidate, w).alias("candidate"), count(x["b"], reference, w).alias("reference")) for w in words]
        return F.filter(F.array(*each), lambda y: y["candidate"] < y["reference"])

    # an array of one, so that what was found has a name
    return F.transform(F.array(F.struct(hits(candidate).alias("a"), hits(reference).alias("b"))), losses)[0]


def audit_differs(a: Column, b: Column, words: tuple[str, ...] = CRITICAL_WORDS) -> Column:
    """Whether two renditions have other numbers or other counts of critical words."""
    differs = ~F.array_sort(tx.numbers(a)).eqNullSafe(F.array_sort(tx.numbers(b)))
    for w in words:
        differs |= word_count(a, w) != word_count(b, w)
    return differs


def lint(c: Column, boilerplate: Column | None = None, page: Column | None = None, orphans: tuple[str, ...] = ()) -> Column:
    """(fails, warnings) of a page: what blocks it and what is only told."""
    rows = F.transform(tx.lines(c), tx.stripped)
    heads = F.filter(rows, lambda r: F.startswith(r, F.lit("#")))
    empty = F.lit(None).cast("string")
    fails = [F.when(F.regexp_like(c, F.lit(UNMAPPED_BULLET)), F.lit("unmapped bullet")), F.when(F.regexp_like(c, F.lit(DOUBLE_SYMBOL)), F.lit("double symbol"))]
    if boilerplate is not None:
        fails.append(F.when(F.exists(boilerplate, lambda b: (b != "") & F.contains(c, b)), F.lit("header or footer")))
    if page is not None:
        fails.append(F.when(F.array_contains(rows, page.cast("string")), F.lit("page number")))
    warnings = [F.when(F.size(heads) != F.size(F.array_distinct(heads)), F.lit("repeated headings")), empty]
    warnings += [F.when(F.contains(c, F.lit(s)), F.lit(f"orphan: {s}")) for s in orphans]
    return F.struct(F.array_compact(F.array(*fails)).alias("fails"), F.array_compact(F.array(*warnings)).alias("warnings"))


def checked(pairs: DataFrame, candidate: str, reference: str, known: tuple[str, ...] = (), page: str | None = None, words: tuple[str, ...] = CRITICAL_WORDS, limits: Limits = Limits()) -> DataFrame:
    """pairs with all measures of a candidate, the reasons why it needs a review, and warnings. Known artifacts and
    hyphenation are taken out of the reference alone; a page number in the reference is no content. Words, numbers
    and lines are columns for a while, so that each text is taken apart once."""
    c = F.col
    clean = without_artifacts(tx.dehyphenated(c(reference)), known)
    df = pairs.withColumn("_clean", clean).withColumns({
        "_rw": tx.content_words(c("_clean")), "_cw": tx.content_words(c(candidate)), "_rn": tx.numbers(c("_clean")), "_cn": tx.numbers(c(candidate)),
        "_rp": code_pairs(c("_clean")), "_cp": code_pairs(c(candidate)), "_cl": tx.lines(c(candidate)),
    })
    wanted = F.array_remove("_rn", c(page).cast("string")) if page else c("_rn")
    df = df.withColumns({
        "overlap": recall(c("_rw"), c("_cw")),
        "number_recall": recall(wanted, c("_cn")),
        "missing_numbers": F.array_sort(F.array_except(wanted, "_cn")),
        "extra_numbers": F.array_sort(F.array_except("_cn", wanted)),
        "coverage": coverage(c(candidate), c("_clean")),
        "repetition": repeats_itself(c(candidate), rows=c("_cl")),
        "empty_or_refusal": is_refusal(c(candidate)),
        "heading_issues": early_subheadings(c("_cl")),
        "artifacts": artifacts(c(candidate), known),
        "code_issues": _mismatches(c("_cp"), c("_rp"), limits.label_overlap),
        "losses": critical_losses(c(candidate), c("_clean"), words),
    })
    return df.drop("_clean", "_rw", "_cw", "_rn", "_cn", "_rp", "_cp", "_cl").withColumns(verdict_columns(limits))


def verdict_columns(limits: Limits = Limits()) -> dict[str, Column]:
    """Of a frame with check_columns: blocking reasons, warnings and needs_review."""
    c = F.col
    reasons = [
        F.when(c("empty_or_refusal"), F.lit("empty or refusal")),
        F.when(c("overlap") < limits.overlap, F.lit("low overlap")),
        F.when(c("number_recall") < limits.number_recall, F.lit("missing numbers")),
        F.when(c("repetition"), F.lit("repetition")),
        F.when(F.size("artifacts") > 0, F.lit("artifacts")),
        F.when(F.size("code_issues") > 0, F.lit("code labels")),
        F.when(F.size("losses") > 0, F.lit("critical words")),
    ]
    warnings = [F.when(~c("coverage").between(limits.coverage_min, limits.coverage_max), F.lit("coverage")), F.when(c("heading_issues") > 0, F.lit("headings"))]
    found = F.array_compact(F.array(*reasons))
    return {"reasons": found, "warnings": F.array_compact(F.array(*warnings)), "needs_review": F.size(found) > 0}
