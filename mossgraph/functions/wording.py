"""Column functions of the research loop: keys, tiers, labels, escaping, parsing of answers, classes of errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of content terms.
CONTENT_STOP_WORDS = (
    "about after also and are because been being but can could does for from has have into its may more not now of official on or "
    "released release says since that the their this to was were what when which with"
).split()
# Verbs that predicates are reduced to, with their forms.
VERB_FORMS = (
    ("reduce", "reduces|reduced|reducing"), ("increase", "increases|increased|increasing"), ("improve", "improves|improved|improving"), ("achieve", "achieves|achieved|achieving"),
    ("outperform", "outperforms|outperformed|outperforming"), ("surpass", "surpasses|surpassed|surpassing"), ("show", "shows|showed|showing"), ("indicate", "indicates|indicated|indicating"),
    ("suggest", "suggests|suggested|suggesting"), ("provide", "provides|provided|providing"), ("enable", "enables|enabled|enabling"), ("require", "requires|required|requiring"),
    ("use", "uses|used|using"), ("employ", "employs|employed|employing"),
)
# Priorities of gaps.
GAP_PRIORITY = {
    "unanswered_sub_question": 1, "low_confidence": 2, "missing_source_type": 3, "missing_recency": 4, "overrepresented_viewpoint": 3, "unresolvable_contradiction": 2, "thin_coverage": 1, "single_source_dependency": 1,
    "low_content_depth": 2, "promotional_bias": 2,
}
# Codes of errors that pass and of errors that stay.
PASSING_STATUS, LASTING_STATUS, PASSING_CODES, LASTING_RPC = (429, 503), (400, 401, 403, 404), ("ETIMEDOUT", "ECONNRESET", "ECONNREFUSED"), (-32700, -32600, -32602)
# Bounds of fields in bytes, and of arrays.
SHORT_FIELD, MEDIUM_FIELD, BODY_FIELD, ARRAY_MOST = 2 * 1024, 16 * 1024, 256 * 1024, 100
# Fields of run events that may be shown, by type.
SHOWN_FIELDS = {
    "RUN_QUEUED": ("runId", "rootRunId", "attempt", "familyId", "query", "strategy", "depth", "queuedAt", "retryOf"), "RUN_STARTED": ("runId", "familyId", "query", "strategy"), "RUN_STARTING": ("runId", "ownerId", "startingAt"),
    "RUN_RUNNING": ("runId", "ownerId", "startedAt"), "RUN_PROGRESS": ("runId", "phase", "percent", "message", "counts"), "RUN_COMPLETED": ("runId", "entityCount", "claimCount", "sourceCount", "evidenceCount"), "RUN_FAILED": ("runId", "error"),
    "RUN_CANCELLED": ("runId", "reason"), "RUN_CANCELLATION_REQUESTED": ("runId", "requestedAt", "reason"), "RUN_INTERRUPTED": ("runId", "interruptedAt", "reason"), "RUN_ROLLED_BACK": ("run_id",),
}


def key_words(text: Column) -> Column:
    """Lower case; all but word characters, white space and hyphens become spaces, which are collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9_\s-]", " "), r"\s+", " "))


def predicate_stem(text: Column) -> Column:
    """Key words with the forms of fourteen verbs reduced to their base."""
    out = key_words(text)
    for base, forms in VERB_FORMS:
        out = F.regexp_replace(out, rf"\b({forms})\b", base)
    return out


def keys_match(subject_a: Column, predicate_a: Column, subject_b: Column, predicate_b: Column) -> Column:
    """Whether two cluster keys are alike: most of the shorter subject and a common predicate word, or all of the subject."""
    words = lambda text: F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    a, b = words(subject_a), words(subject_b)
    least = F.least(F.size(a), F.size(b))
    share = F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)
    common = F.arrays_overlap(words(predicate_a), words(predicate_b))
    return ((subject_a == subject_b) & (predicate_a == predicate_b)) | ((share >= 0.6) & (common | (share >= 1.0)))


def hedge_of(confidence: Column) -> Column:
    return F.when(confidence > 0.8, F.lit("certain")).when(confidence > 0.5, F.lit("likely")).otherwise(F.lit("uncertain"))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def backoff(attempt: Column, base: float = 1000.0, most: float = 30000.0) -> Column:
    """Milliseconds before the next attempt, without jitter."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most)).cast("long")


def rendered(subject: Column, predicate: Column, object_: Column, style: str = "spaced") -> Column:
    """An assertion as text: ``spaced`` with an empty object where there is none, ``joined`` or ``lines`` without empty parts."""
    if style == "spaced":
        return F.concat(subject, F.lit(" "), predicate, F.lit(" "), F.coalesce(object_, F.lit("")))
    parts = F.filter(F.array(subject, predicate, object_), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(parts, " " if style == "joined" else "\n")


def gap_priority(category: Column) -> Column:
    out = None
    for name, priority in GAP_PRIORITY.items():
        out = F.when(category == name, F.lit(priority)) if out is None else out.when(category == name, F.lit(priority))
    return out


def gap_key(category: Column, question: Column, finding: Column) -> Column:
    return F.concat_ws("::", category, F.coalesce(question.cast("string"), F.lit("")), F.coalesce(finding.cast("string"), F.lit("")))


def markdown_text(text: Column) -> Column:
    """One line, with backslashes, inline marks and a leading list mark escaped."""
    line = F.regexp_replace(text, r"[\r\n]+", " ")
    marked = F.regexp_replace(F.regexp_replace(line, r"\\", r"\\\\"), r"([>`#*+_\]])", r"\\$1")
    return F.regexp_replace(marked, r"^([ \t]*)- ", r"$1\\- ")


def link_target(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29"))


def first_upper(text: Column, upper: bool = True) -> Column:
    return F.concat((F.upper if upper else F.lower)(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def json_in(text: Column) -> Column:
    """The text itself if it is JSON, else the first fenced block that is; null if there is none."""
    valid = lambda t: F.try_parse_json(t).isNotNull()
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    blocks = F.filter(F.regexp_extract_all(text, F.lit(r"(?is)```(?:json)?\s*(.*?)\s*```"), F.lit(1)), lambda t: (t != "") & valid(F.trim(t)))
    return F.when(valid(whole), whole).otherwise(F.try_element_at(blocks, F.lit(1)))


def agent_response(text: Column) -> Column:
    """``(kind, thought, tool, arguments, answer)`` of an agent's turn; an answer goes before an action."""
    part = lambda pattern: F.trim(F.regexp_extract(text, pattern, 1))
    thought = part(r"(?is)THOUGHT:\s*(.*?)(?=\n?\s*(?:ACTION|ANSWER):|$)")
    answered, acted = text.rlike(r"(?i)ANSWER:"), text.rlike(r"(?i)ACTION:\s*\S")
    return F.struct(
        F.when(answered, F.lit("answer")).when(acted, F.lit("action")).otherwise(F.lit("error")).alias("kind"), thought.alias("thought"),
        F.when(~answered & acted, part(r"(?i)ACTION:\s*(\S+)")).alias("tool"), F.when(~answered & acted, part(r"(?is)ARGUMENTS:\s*(.*?)(?=\n(?:THOUGHT|ACTION|ANSWER):|$)")).alias("arguments"),
        F.when(answered, part(r"(?is)ANSWER:\s*(.*)")).alias("answer"),
    )


def error_class(name: Column, classification: Column, rpc_code: Column, status: Column, code: Column, message: Column) -> Column:
    """Whether an error may pass (TRANSIENT) or stays (PERMANENT); columns are null where the error has no such field."""
    passing, lasting = F.lit("TRANSIENT"), F.lit("PERMANENT")
    text = F.lower(message)
    return (
        F.when(classification == "PERMANENT", lasting).when(name == "AbortError", lasting).when(rpc_code.isin(*LASTING_RPC), lasting)
        .when(status.isin(*PASSING_STATUS), passing).when(status.isin(*LASTING_STATUS), lasting).when(code.isin(*PASSING_CODES), passing).when(code == "ENOTFOUND", lasting)
        .when(text.contains("socket hang up") | text.contains("econnreset"), passing).otherwise(passing)
    )


def finding_confidence(directness: Column, n_sources: Column, n_caveats: Column) -> Column:
    direct = F.when(directness == "direct", 3).when(directness == "near-direct", 1).otherwise(0)
    return direct + F.least(n_sources, F.lit(5)) - F.when(n_caveats > 0, 1).otherwise(0)


def source_rank(quality: Column, relevance: Column, freshness: Column) -> Column:
    return F.coalesce(quality, F.lit(0.0)) + F.coalesce(relevance, F.lit(0.0)) + F.coalesce(freshness, F.lit(0.0))


def source_tier(authority: Column) -> Column:
    return F.when(authority.isin("official_spec", "official_changelog"), F.lit("primary")).when(authority.isin("official_repo", "package_registry"), F.lit("secondary")).otherwise(F.lit("tertiary"))


def depth_of(n_sources: Column) -> Column:
    return F.when(n_sources <= 10, F.lit("quick")).when(n_sources <= 25, F.lit("standard")).when(n_sources <= 60, F.lit("deep")).otherwise(F.lit("exhaustive"))


def sanitised(items: Column, length: int, most: int) -> Column:
    """Strings of an array, each cut to ``length``, ``most`` of them; null or no array gives none."""
    kept = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())
    return F.slice(F.transform(kept, lambda x: F.left(x, F.lit(length))), 1, most)


def opaque_id(*parts: Column, prefix: str = "", length: int = 26) -> Column:
    """An id that depends on its parts alone, so that a task that runs twice makes the same one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length))


def without_controls(text: Column) -> Column:
    """Without C0 and C1 control characters but tab, newline and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]", "")


def bytes_capped(text: Column, most: int) -> Column:
    """At most ``most`` bytes of UTF-8, whole characters only, with an ellipsis where something was cut."""
    room = most - 3
    raw = F.substring(text.cast("binary"), 1, room + 1)
    # A byte 10xxxxxx behind the cut means that a character is torn: go back to its first byte, three at most.
    at = lambda k: F.conv(F.hex(F.substring(raw, F.lit(1) + k, F.lit(1))), 16, 10).cast("int")
    torn = lambda k: at(F.lit(k)).between(128, 191)
    keep = F.when(~torn(room), room).when(~torn(room - 1), room - 1).when(~torn(room - 2), room - 2).otherwise(room - 3)
    cut = F.decode(F.substring(raw, F.lit(1), keep), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(cut, F.lit("…")))


def shown_payload(event_type: Column, payload: Column) -> Column:
    """Only the fields of a run event's JSON payload that may be shown, without nulls; nothing of other events."""
    value, out = F.try_parse_json(payload), None
    for kind, fields in SHOWN_FIELDS.items():
        shown = F.to_json(F.struct(*[F.try_variant_get(value, f"$.{name}", "variant").alias(name) for name in fields]))
        out = F.when(event_type == kind, shown) if out is None else out.when(event_type == kind, shown)
    return out.otherwise(F.lit("{}"))


def page_limit_column(limit: Column, default: int = 50, most: int = 100) -> Column:
    """A page's size: the default where none is given, no more than ``most``; null where the value is an error."""
    return F.when(limit.isNull(), F.lit(default)).when((limit < 1) | (limit != F.floor(limit)), F.lit(None).cast("int")).otherwise(F.least(limit, F.lit(most)).cast("int"))


def search_text(text: Column, most: int = 200) -> Column:
    """``(text, error)``: trimmed; nothing where it is empty; an error where it is too long."""
    trimmed = F.trim(text)
    return F.struct(F.when((trimmed != "") & (F.length(trimmed) <= most), trimmed).alias("text"), F.coalesce(F.length(trimmed) > most, F.lit(False)).alias("error"))


def url_check(url: Column) -> Column:
    """Whether an address has the form of one, or was likely made up."""
    return F.when(F.coalesce(url.rlike(r"^(?i)[a-z][a-z0-9+.-]*://[^\s/?#]+"), F.lit(False)), F.lit("OK")).otherwise(F.lit("LIKELY_HALLUCINATED"))
