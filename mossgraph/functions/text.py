"""Normalisers, tokenisers and set similarities as column expressions.

The five normalisers differ on purpose (which letters survive, which stop words go, whether repeats stay); none of them is
a special case of another.  JavaScript's ``\\w`` is ASCII, as Java's is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the claim normaliser.
CLAIM_STOP_WORDS = "about after also and are but can for from has have into its may more not now of on or that the their this to was were which with".split()
# Stop words of scopes and labels.
SCOPE_STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during "
    "before after above below between and but or not so if then that this these those it its about which who whom what when where how all each every both few more most other some "
    "such no nor only own same than too very"
).split()
# Negation words.
NEGATIONS = "not no never cannot can't won't don't doesn't isn't aren't hasn't haven't couldn't wouldn't shouldn't".split()
# Wording of denial and of assertion.
DENIAL = r"(?i)\b(no longer|not|without|removed|removes|deprecated|drops?|disable[sd]?|cannot|can't)\b"
ASSERTION = r"(?i)\b(adds?|added|supports?|introduced|enables?|includes?|allows?)\b"
# Words on opposite ends of a direction.
ANTONYMS = (("increase", "decrease"), ("improve", "reduce"), ("faster", "slower"), ("better", "worse"), ("more", "less"), ("higher", "lower"), ("grow", "shrink"))
# Wording of replacement and of narrowing.
REPLACEMENT = r"(?i)\b(replaces?|supersedes?|deprecated|deprecates?|removed|no longer supported)\b"
NARROWING = r"(?i)\b(only|unless|when|if|provided|limited to|under)\b"


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def unicode_words(text: Column) -> Column:
    """Lower case; anything but letters, digits and white space becomes one space."""
    return squeezed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]+", " "))


def ascii_words(text: Column) -> Column:
    """Lower case; anything but ASCII word characters and white space becomes a space."""
    return squeezed(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s]", " "))


def anchor_terms(text: Column, stop: tuple[str, ...] | list[str] = tuple(CLAIM_STOP_WORDS)) -> Column:
    """Distinct terms over ``a-z0-9@._/-`` without edge punctuation, longer than two, without stop words."""
    raw = F.split(squeezed(F.regexp_replace(F.lower(text), r"[^a-z0-9@._/\-\s]", " ")), " ")
    trimmed = F.transform(raw, lambda t: F.regexp_replace(t, r"^[._/\-]+|[._/\-]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: (F.length(t) > 2) & ~t.isin(*stop)))


def scope_tokens(text: Column, stop: tuple[str, ...] | list[str] = tuple(SCOPE_STOP_WORDS), unicode_letters: bool = False) -> Column:
    """Tokens longer than one, hyphens kept, repeats kept."""
    kept = r"[^\p{L}\p{N}\s\-]" if unicode_letters else r"[^a-z0-9\s\-]"
    raw = F.split(squeezed(F.regexp_replace(F.lower(text), kept, " ")), " ")
    return F.filter(raw, lambda t: (F.length(t) > 1) & ~t.isin(*stop))


def plain_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two distinct-element arrays; ``empty`` where both are (1 for the reconciler and labels, 0 for clustering)."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(F.array_distinct(a), F.array_distinct(b))) / least)


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 where either norm is."""
    n = F.least(F.size(a), F.size(b))
    dot = lambda x, y: F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


# The forms of anchors; the last is a date with the name of its month.
ANCHORS = (r"(?i)@[a-z0-9][\w.-]*/[a-z0-9][\w.-]*", r"(?i)\bv?\d+(?:\.\d+)*(?:-[\w.]+)?\b", r"\b\d{4}-\d{2}-\d{2}\b")
NAMED_DATE = r"(?i)\b(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\s+\d{1,2},\s+\d{4}\b"
# A phrase with a short form, and names that count as discriminators wherever they stand.
SHORT_FORM = ("model context protocol", "mcp")
KNOWN_NAMES = ("claude desktop", "anthropic")


def anchors(text: Column, named_dates: bool = False) -> Column:
    """Scoped packages, versions and numbers, ISO dates; for the alignment of evidence dates with a month's name too."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (*ANCHORS, *([NAMED_DATE] if named_dates else []))]
    return F.array_distinct(F.transform(F.concat(*found), F.lower))


def discriminators(text: Column) -> Column:
    """Anchors, runs of capitalised words, words in capitals and known names, all in lower case; one phrase by its short form."""
    phrase, short = SHORT_FORM
    phrases = F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)+\b"), F.lit(0)), lambda p: F.regexp_replace(F.lower(p), r"\s+", " "))
    capitals = F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}\b"), F.lit(0)), F.lower)
    phrases = F.filter(phrases, lambda p: p != phrase)
    lower = F.lower(text)
    known = F.filter(F.array(F.when(lower.rlike(rf"\b{phrase}\b"), F.lit(short)), *[F.when(lower.contains(n), F.lit(n)) for n in KNOWN_NAMES]), lambda n: n.isNotNull())
    return F.array_distinct(F.concat(anchors(text), phrases, capitals, known))


def discriminator_gap(a: Column, b: Column) -> Column:
    """What only one side has, sorted; nothing where a side has none."""
    gap = F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.array().cast("array<string>")).otherwise(gap)


def contradiction_signal(a: Column, b: Column) -> Column:
    """One side denies what the other asserts."""
    return (a.rlike(DENIAL) & b.rlike(ASSERTION)) | (b.rlike(DENIAL) & a.rlike(ASSERTION))


def has_negation(text: Column) -> Column:
    words = F.transform(plain_tokens(F.regexp_replace(text, "’", "'")), lambda w: F.regexp_replace(w, "[^a-z']", ""))
    return F.arrays_overlap(words, F.array(*map(F.lit, NEGATIONS)))


def opposed(a: Column, b: Column) -> Column:
    """Whether one lower-case text has a direction word, also within a longer word, and the other its opposite."""
    out = F.lit(False)
    for x, y in ANTONYMS:
        out = out | (F.contains(a, F.lit(x)) & F.contains(b, F.lit(y))) | (F.contains(a, F.lit(y)) & F.contains(b, F.lit(x)))
    return out


def newer_version(a: Column, b: Column) -> Column:
    """Whether dotted version ``a`` is above ``b``; missing parts count as 0."""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, "^v", ""), r"\."), lambda p: F.coalesce(p.try_cast("long"), F.lit(0)))
    pad = lambda v, n: F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.greatest(n - F.size(v), F.lit(0))))
    x, y = parts(a), parts(b)
    n = F.greatest(F.size(x), F.size(y))
    return F.aggregate(F.zip_with(pad(x, n), pad(y, n), lambda p, q: F.sign(p - q).cast("int")), F.lit(0), lambda s, d: F.when(s == 0, d).otherwise(s)) > 0


def numbers_agree(value_a: Column, unit_a: Column, value_b: Column, unit_b: Column, tolerance: float = 0.1) -> Column:
    """Null if either side has no number; false on another unit; else whether the relative difference is small."""
    scale = F.greatest(F.abs(value_a), F.abs(value_b), F.lit(1.0))
    return F.when(value_a.isNull() | value_b.isNull(), F.lit(None).cast("boolean")).when(~unit_a.eqNullSafe(unit_b), F.lit(False)).otherwise(F.abs(value_a - value_b) / scale <= tolerance)


def djb2(text: Column) -> Column:
    """``djb2:`` and the 32-bit hash of the UTF-16 code units (of ASCII and other basic-plane text) in hex."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + c, F.lit(1 << 32)))
    return F.concat(F.lit("djb2:"), F.lower(F.hex(total)))


def title_label(tokens: Column, n: int, default: str) -> Column:
    words = F.transform(F.slice(tokens, 1, n), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w))))
    return F.when(F.size(tokens) == 0, F.lit(default)).otherwise(F.array_join(words, " "))
