"""Normalising and checking what a model wrote about a shot."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Standard frame rates, and marks of failures in messages.
RATES = (23.976, 24.0, 25.0, 29.97, 30.0, 48.0, 50.0, 59.94, 60.0)
TRANSIENT = ("503", "502", "504", "500", "429", "unavailable", "resource_exhausted", "overloaded", "high demand", "timeout", "timed out", "deadline", "connection", "temporarily")
ENVIRONMENT = (
    "invalid_grant", "expired or revoked", "reauthenticate", "api key not valid", "api_key_invalid", "unauthenticated", "invalid authentication credentials", "billing", "per day", "perday",
    "permission_denied", "drive is not connected", "downloadquotaexceeded", "download quota",
)
DRIVE_QUOTA = ("downloadquotaexceeded", "download quota")
DRIVE_REFUSED = r"googleapis\.com/drive/.*\b403\b"
NO_ROOM, CUT_OFF = ("free disk",), ("stopped", "empty", "incomplete")
UNREADABLE = ("ffprobe could not read", "contains no image or video", "could not decode", "could not read", "moov atom", "invalid data")
LEAST_CONFIDENCE, LEAST_CATEGORY = 0.7, 0.6


def normalise_term(v: Column) -> Column:
    """Lower case, single spaces, no space or ` .,;:` at the ends."""
    return F.btrim(F.regexp_replace(F.lower(F.trim(v)), r"\s+", " "), F.lit(" .,;:"))


def enum_key(v: Column) -> Column:
    return F.regexp_replace(F.btrim(F.lower(v)), "[^a-z0-9]+", "_")


def coerce_enum(v: Column, aliases: dict[str, str]) -> Column:
    """The key form of a value, by its alias if it has one."""
    pairs = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, enum_key(v)), enum_key(v))


def split_enum(rows: DataFrame, column: str, values: tuple) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) by a closed set of values; nulls are quarantined."""
    ok = F.coalesce(F.col(column).isin(*values), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def clean_list(v: Column, most: int) -> Column:
    """Normal forms without blanks and repeats, the first `most` of them."""
    terms = F.filter(F.transform(v, normalise_term), lambda t: t.isNotNull() & (t != ""))
    return F.slice(F.array_distinct(terms), 1, most)


def clamp(v: Column, default: float | None) -> Column:
    """A number in [0, 1]; what is none becomes the default."""
    number = v.try_cast("double")
    return F.when(number.isNull(), F.lit(default).cast("double")).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def out_of_vocabulary(rows: DataFrame, fields: dict[str, str], vocabulary: DataFrame) -> DataFrame:
    """(field, term) of each row's values that the vocabulary (field, term) lacks."""
    pairs = rows.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(c).alias("term")) for f, c in fields.items()))).alias("x")).select("x.*")
    return pairs.filter(F.col("term").isNotNull()).join(vocabulary, ["field", "term"], "left_anti")


def candidates(terms: DataFrame, at: str, least: int) -> DataFrame:
    """(field, term, n, first_seen, last_seen) of terms seen `least` times."""
    return terms.groupBy("field", "term").agg(F.count("*").alias("n"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen")).filter(F.col("n") >= least)


def _stems(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda w: F.substring(w, 1, 5))


def mentioned(term: Column, text: Column) -> Column:
    """Whether the term has words, and each, cut to five letters, is a word of the text cut so."""
    return mentioned_in(term, _stems(text))


def mentioned_in(term: Column, have: Column) -> Column:
    """As mentioned(), by the text's words, cut already: a lambda works out what it holds anew for each element."""
    words = _stems(term)
    return (F.size(words) > 0) & (F.size(F.array_except(words, have)) == 0)


def mentions(text: Column, use) -> Column:
    """use(the text's cut words), which are worked out once for a row, not once for each element of a list in it."""
    return F.element_at(F.transform(F.array(_stems(text)), use), 1)


def supported(tags: Column, text: Column, stop: tuple) -> Column:
    """Distinct tags that the text bears out, without stop words."""
    return mentions(text, lambda have: F.filter(F.array_distinct(tags), lambda t: ~t.isin(*stop) & mentioned_in(t, have)))


def evidence(tags: Column, themes: Column, text: Column, stop: tuple, names: tuple, concepts: tuple, allowed: tuple) -> tuple[Column, Column]:
    """(tags, themes) held to what the text shows: no stop words, names of the featured person, or repeats.

    Words for feelings, looks and ideas (`concepts`, allowed themes among them) stay tags only if the text mentions them; those that it
    doesn't become themes if they are allowed ones. Other tags stay. At most four themes, given ones first. Null lists are empty.
    """
    none = F.array().cast("array<string>")
    words = F.filter(F.array_distinct(F.coalesce(tags, none)), lambda t: ~t.isin(*stop, *names))
    idea = lambda t: t.isin(*concepts, *allowed) & ~F.coalesce(mentioned(t, text), F.lit(False))
    given = F.filter(F.array_distinct(F.coalesce(themes, none)), lambda t: t.isin(*allowed))
    moved = F.filter(words, lambda t: idea(t) & t.isin(*allowed))
    return F.filter(words, lambda t: ~idea(t)), F.slice(F.array_union(given, moved), 1, 4)


def review_reasons(confidence: Column, category_confidence: Column, unmatched: Column, flags: Column, defects: tuple) -> Column:
    """Why a person should look: an unsure description, an unsure or unknown folder, a defect of the picture. What is null gives no reason."""
    return F.array_compact(
        F.array(
            F.when(confidence < LEAST_CONFIDENCE, "low_confidence"), F.when(category_confidence < LEAST_CATEGORY, "low_category_confidence"),
            F.when(unmatched, "category_unmatched"), F.when(F.arrays_overlap(flags, F.array(*map(F.lit, defects))), "quality_defect"),
        )
    )


def _has(message: Column, marks: tuple) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(m, F.lit(x)) for x in marks])


def drive_quota(message: Column) -> Column:
    """A read that the drive refused for its download quota, in words or as a 403 of its address."""
    return _has(message, DRIVE_QUOTA) | F.lower(F.coalesce(message, F.lit(""))).rlike(DRIVE_REFUSED)


def environment(message: Column) -> Column:
    """Failures of the setup, which every file meets until someone mends it."""
    return _has(message, ENVIRONMENT) | F.lower(F.coalesce(message, F.lit(""))).rlike(DRIVE_REFUSED)


def transient(message: Column) -> Column:
    """Failures that are worth another try."""
    return _has(message, TRANSIENT) | environment(message)


def failure_kind(message: Column) -> Column:
    """Which list a file that has failed for good belongs on, from its last error."""
    return (
        F.when(_has(message, NO_ROOM), "too_big").when(_has(message, ("download",)) & _has(message, CUT_OFF), "download_incomplete").when(_has(message, UNREADABLE), "unreadable").otherwise("analysis_failed")
    )


def snap_fps(fps: Column, tolerance: float = 0.015) -> Column:
    """The nearest standard rate within the tolerance, else the rate to three places."""
    near = F.array_min(F.filter(F.transform(F.array(*map(F.lit, RATES)), lambda r: F.struct(F.abs(fps - r).alias("d"), r.alias("r"))), lambda x: x["d"] / x["r"] <= tolerance))
    return F.coalesce(near["r"], F.round(fps, 3))


def fingerprint(data: Column, part: int = 1 << 20) -> Column:
    """SHA-256 of size, first part, and last part of data longer than two parts."""
    n = F.octet_length(data)
    last = F.when(n > 2 * part, F.substr(data, n - part + 1, F.lit(part))).otherwise(F.lit(b""))
    return F.sha2(F.concat(n.cast("string").cast("binary"), F.substr(data, F.lit(1), F.lit(part)), last), 256)


def joined(*columns: str) -> Column:
    """Values and lists in order, blanks left out, joined by commas."""
    return F.concat_ws(", ", *columns)


def folder_words(path: Column) -> Column:
    """The folders of a path, leaf first, without number prefixes and repeats."""
    return F.array_distinct(F.transform(F.reverse(F.split(path, "/")), lambda p: F.regexp_replace(p, r"^\d+[_ -]+", "")))


def overlay(rows: DataFrame, fixes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with corrections (key, has_<column>, new_<column>) laid over: corrected rows are indexed and marked."""
    j = rows.join(fixes, key, "left")
    touched = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"has_{c}"), F.lit(False)) for c in columns])
    new = {c: F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    return j.select(key, *(new.get(c, F.when(touched, "indexed").otherwise(F.col(c)) if c == "status" else F.col(c)).alias(c) for c in rows.columns if c != key), touched.alias("corrected"))
