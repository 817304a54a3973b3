"""Personal data by weak supervision.

Fixed patterns give the base spans of e-mail addresses, IP addresses, payment cards and phone numbers, which always
stay. Wider patterns propose more candidates: those that fail a base pattern's test, written-out or defanged addresses,
national phone numbers, cards in other groups, and secrets (tokens, keys, passwords). Labelers vote yes, no or nothing
on base spans and proposals alike: form, checksum, gazetteer, context for, context against, edges, company.
The gazetteer comes from the data: domains, networks, issuers, country and area codes, and names of secrets that stand
in at least GAZETTEER_DOCS documents and in a share of 1 / GAZETTEER of all documents with that kind. Expectation-
maximisation over the counts of vote patterns estimates each labeler's reliability per kind; its posteriors train a
logistic span classifier on votes and shape, which accepts or turns down every proposal. What reaches the driver are
counts of patterns over all documents, at most kinds x 3^labelers x SHAPES, and fewer than GAZETTEER keys a kind.
"""

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotlake.llm.common import keep, table

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LABELERS = ("form", "checksum", "gazetteer", "context", "counter-context", "edges", "company")
SHAPES = 16
ACCEPT = 0.9
#: Votes (none, yes, no) of each labeler on false and on true spans before any is seen; checksums are believed most.
BELIEF = np.array([[(0.1, 0.5, 8.0) if x == "checksum" else (1.0, 0.5, 2.0) for x in LABELERS], [(0.1, 8.0, 0.1) if x == "checksum" else (1.0, 2.0, 0.5) for x in LABELERS]])
GAZETTEER, GAZETTEER_DOCS = 1000, 3
#: Characters before a span that the context labelers read, and between spans that keep company.
CONTEXT, COMPANY = 32, 80

# possessive quantifiers and look-behinds find the same leftmost matches without trying a long run again from its middle
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_HOST = re.compile(r"[A-Za-z0-9-]++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")

#: (kind, whether the form is the usual one, pattern, what a text must hold for it to match)
_PROPOSALS = (
    ("email", True, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)|\{at\}|<at>) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|<dot>|\.) ?[A-Za-z0-9-]{1,63}+){1,5}", re.I), ("at]", "at)", "at}", "at>", "AT]", "AT)")),
    ("email", False, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ at [A-Za-z0-9-]{1,63}+(?: dot [A-Za-z0-9-]{1,63}+){1,5}"), (" dot ",)),
    ("ip", True, re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}){3}(?![0-9])"), ("[.]", "(.)", "[dot]")),
    ("card", True, re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2,3}[._/]?[0-9]{0,4}(?![0-9])"), (".", "_", "/")),
    ("phone", True, re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"), None),
    ("phone", True, re.compile(r"(?<![0-9+])00[1-9][0-9]{0,2}(?:[ ().-]{1,2}[0-9]{2,4}){2,5}(?![0-9])"), ("00",)),
    ("secret", True, re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+=*"), None),
)
_FOR = {
    "email": re.compile(r"\b(?:e-?mails?|mail|contact|write|reach|address|correo|courriel)\b", re.I), "ip": re.compile(r"\b(?:ip|ipv4|host|server|address|login|from)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pay|carte|tarjeta|karte)\b", re.I), "phone": re.compile(r"\b(?:tel|telephone|phone|call|fax|mobile|cell|whatsapp|t[ée]l[ée]phone|telefon|tel[ée]fono)\b", re.I),
    "secret": re.compile(r"\b(?:\w*(?:token|secret|passw(?:or)?d|pwd|credentials?)|(?:api|access|private|secret|auth)[ _-]?key)[\"']?\s*(?:[:=]|is)\s*[\"']?\Z", re.I),
}
_AGAINST = re.compile(r"\b(?:version|v|order|invoice|isbn|issn|sku|serial|ref|reference|id|section|chapter|page|figure|commit|sha(?:1|256)?|md5|hash|checksum|uuid|etag)\b\W*\Z", re.I)
_KEY = re.compile(r"(\w{1,32})\W{1,4}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base spans of each kind, leftmost and non-overlapping within a kind; offsets in code points."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out["email"].append((start, end))
        at = text.find("@", max(at + 1, end))
    out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in _DIGITS for c in m[0]) <= 15]
    return out


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def candidates(text: str) -> list[tuple[str, int, int, bool, bool]]:
    """(kind, start, end, base, usual form) of base spans and proposals; proposals that a base span overlaps are left out."""
    base = base_spans(text)
    out = [(k, s, e, True, True) for k in KINDS for s, e in base[k]]
    taken = sorted((s, e) for _, s, e, _, _ in out)
    more = [("ip", *m.span(), True) for m in _IP.finditer(text)] + [("card", *m.span(), True) for m in _CARD.finditer(text) if 12 <= sum(c in _DIGITS for c in m[0]) <= 20]
    at = text.find("@")
    while at >= 0:
        start = at
        while start > max(0, at - 64) and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)) and len(m[0]) <= 63:
            more.append(("email", start, m.end(), False))
        at = text.find("@", at + 1)
    if "+" in text:
        more += [("phone", *m.span(), False) for m in _PHONE.finditer(text) if 7 <= sum(c in _DIGITS for c in m[0]) <= 17]
    for kind, usual, pattern, hints in _PROPOSALS:
        if hints is None or any(h in text for h in hints):
            for m in pattern.finditer(text):
                if kind != "secret" or (not m[0].isdigit() and any(c in _DIGITS for c in m[0]) and any(c.isalpha() for c in m[0])):
                    more.append((kind, *m.span(), usual))
    starts = [s for s, _ in taken]
    reach = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    for kind, s, e, usual in more:
        before = bisect.bisect_left(starts, e)
        if not before or reach[before - 1] <= s:
            out.append((kind, s, e, False, usual))
    return out


def _key(text: str, kind: str, start: int, end: int, digits: str) -> str:
    """What of a span a gazetteer may know."""
    if kind == "email":
        return ".".join(re.split(r"[^A-Za-z0-9-]+", text[start:end].lower().replace(" dot ", "."))[-2:])
    if kind == "ip":
        return ".".join(re.findall("[0-9]+", text[start:end])[:2])
    if kind == "secret":
        found = _KEY.search(text[max(0, start - CONTEXT) : start])
        return found[1].lower() if found else ""
    return digits[:4]


def _votes(text: str, kind: str, start: int, end: int, usual: bool, company: bool) -> tuple[list[int], int, str]:
    """The votes (0 none, 1 yes, 2 no; the gazetteer's still open), the span's shape, and its key."""
    span = text[start:end]
    digits = "".join(c for c in span if c in _DIGITS)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + 1]
    if kind == "email":
        parts = re.split(r"[^A-Za-z0-9]+", re.sub(r" at |[\[({<]at[\])}>]", "@", span, flags=re.I).rpartition("@")[2])
        check = 1 if len(parts) > 1 and parts[-1].isalpha() and len(parts[-1]) > 1 else 2
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        check = 1 if len(parts) == 4 and all(map(_octet, parts)) else 2
    elif kind == "card":
        check = 1 if 13 <= len(digits) <= 19 and luhn(digits) else 2
    elif kind == "phone":
        check = 1 if 9 <= len(digits) <= 15 else 2
    else:
        check = 1 if _entropy(span) >= 3 else 2
    quoted = kind == "secret" and before[-1:] in ('"', "'") and after == before[-1:]
    # clean edges say little, quotes around a secret do
    edges = 2 if before[-1:].isalnum() or after.isalnum() else 1 if quoted else 0
    votes = [1 if usual else 2, check, 0, 1 if _FOR[kind].search(before) else 0, 2 if _AGAINST.search(before) else 0, edges, 1 if company else 0]
    shape = min(3, len(span) // 12) * 4 + min(1, len(digits) // 8) * 2 + any(c in " -()." for c in span)
    return votes, shape, _key(text, kind, start, end, digits)


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id and found: array of (kind, start, stop, base, votes, shape, key); votes is a number in base 3, without the gazetteer's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for t in b["text"]:
                t, out = t or "", []
                spans = candidates(t)
                near = sorted(s for _, s, _, x, _ in spans if x)
                for kind, s, e, base, usual in spans:
                    around = bisect.bisect_right(near, e + COMPANY) - bisect.bisect_left(near, s - COMPANY)
                    votes, shape, key = _votes(t, kind, s, e, usual, around > base)
                    out.append({"kind": kind, "start": s, "stop": e, "base": base, "votes": int("".join(map(str, votes)), 3), "shape": shape, "key": key})
                found.append(out)
            yield pd.DataFrame({"doc_id": b["doc_id"], "found": found})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id string, found array<struct<kind:string,start:int,stop:int,base:boolean,votes:int,shape:int,key:string>>"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


_GAZETTEER_VOTE = 3 ** (len(LABELERS) - 1 - LABELERS.index("gazetteer"))


def _unpack(votes: np.ndarray) -> np.ndarray:
    return np.stack([votes // 3 ** (len(LABELERS) - 1 - i) % 3 for i in range(len(LABELERS))], axis=1)


def gazetteer(found: DataFrame) -> set[tuple[str, str]]:
    """(kind, key) of the keys that many documents hold in base spans, or in secrets with a context: fewer than GAZETTEER a kind."""
    context = 3 ** (len(LABELERS) - 1 - LABELERS.index("context"))
    seen = found.select(F.explode(F.array_distinct(F.transform(F.filter("found", lambda s: s["base"] | ((s["kind"] == "secret") & (F.floor(s["votes"] / context) % 3 == 1))), lambda s: F.struct(s["kind"].alias("kind"), s["key"].alias("key"))))).alias("k"))
    counts = seen.groupBy("k.kind", "k.key").agg(F.count("*").alias("n")).filter("key <> ''")
    totals = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    out: set[tuple[str, str]] = set()
    for kind, total in totals.items():
        out |= {(kind, r["key"]) for r in counts.filter((F.col("kind") == kind) & (F.col("n") >= max(GAZETTEER_DOCS, total / GAZETTEER))).collect()}
    return out


def reliabilities(votes: np.ndarray, n: np.ndarray, belief: np.ndarray = BELIEF, rounds: int = 50) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of labelers' votes, n times each): prior of true, P(vote | truth) as (2, labelers, 3), posteriors.

    Labelers start out, and in the few cases remain, better than chance: belief is what each is taken to have said already.
    """
    yes, no = (votes == 1).sum(axis=1), (votes == 2).sum(axis=1)
    p = (yes + 1) / (yes + no + 2)
    for _ in range(rounds):
        prior = float((n @ p + 1) / (n.sum() + 2))
        given = np.empty((2, votes.shape[1], 3))
        for y, w in ((0, n * (1 - p)), (1, n * p)):
            for v in range(3):
                given[y, :, v] = ((votes == v) * w[:, None]).sum(axis=0) + belief[y, :, v]
            given[y] /= given[y].sum(axis=1, keepdims=True)
        log = np.log(np.take_along_axis(given[:, None].repeat(len(votes), 1), votes[None, :, :, None].repeat(2, 0), 3)[..., 0]).sum(axis=2)
        odds = np.log(prior / (1 - prior)) + log[1] - log[0]
        p = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
    return prior, given, p


def _features(votes: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(3)[votes].reshape(len(votes), -1), np.eye(SHAPES)[shape], np.ones((len(votes), 1))], axis=1)


def span_classifier(votes: np.ndarray, shape: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 300, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression on one-hot votes and shapes, fitted to the posteriors p; its weights."""
    x = _features(votes, shape)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + ridge / len(w) * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (weight * (p - q)) - ridge / len(w) * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(found: DataFrame, known: set[tuple[str, str]]) -> dict[str, np.ndarray]:
    """The classifier's weights for each kind that occurs."""
    spans = found.select(F.explode("found").alias("s")).select("s.kind", "s.key", "s.votes", "s.shape")
    if known:
        spans = spans.join(F.broadcast(found.sparkSession.createDataFrame(sorted(known), "kind string, key string").withColumn("yes", F.lit(_GAZETTEER_VOTE))), ["kind", "key"], "left").withColumn("votes", F.col("votes") + F.coalesce("yes", F.lit(0)))
    counts = spans.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")).toPandas().sort_values(["kind", "votes", "shape"], ignore_index=True)
    out = {}
    for kind, g in counts.groupby("kind"):
        votes, n = _unpack(g["votes"].to_numpy()), g["n"].to_numpy(float)
        out[kind] = span_classifier(votes, g["shape"].to_numpy(), n, reliabilities(votes, n)[2])
    return out


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans, n_added.

    spans lists base and accepted spans as kind:start:end, secrets last; n_spans counts them, n_added the accepted ones.
    A null text is empty, and an empty one has no spans; repeated rows give repeated results; an empty table gives an
    empty result. Whole texts are read. Of accepted spans of a kind that overlap, the first stays.
    """
    found = keep(extract(docs, doc_id, text), "pii-found")
    known = gazetteer(found)
    shared = docs.sparkSession.sparkContext.broadcast((known, train(found, known)))
    order = {k: i for i, k in enumerate(ALL_KINDS)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, weights = shared.value
        limit = math.log(accept / (1 - accept))
        for b in batches:
            out = []
            for d, spans in zip(b["doc_id"], b["found"], strict=True):
                base = sorted((order[s["kind"]], s["start"], s["stop"]) for s in spans if s["base"])
                more = []
                for s in spans:
                    if not s["base"]:
                        votes = _unpack(np.array([s["votes"] + _GAZETTEER_VOTE * ((s["kind"], s["key"]) in known)]))
                        if (_features(votes, np.array([s["shape"]])) @ weights[s["kind"]])[0] >= limit:
                            more.append((order[s["kind"]], s["start"], s["stop"]))
                kept, last = [], (-1, 0)
                for k, s, e in sorted(more):
                    if k != last[0] or s >= last[1]:
                        kept.append((k, s, e))
                        last = (k, e)
                say = lambda x: ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for k, s, e in x)
                out.append((d, *(sum(x[0] == i for x in base) for i in range(len(KINDS))), hashlib.sha256(say(base).encode()).hexdigest(), say(sorted(base + kept)), len(base) + len(kept), len(kept)))
            yield pd.DataFrame(out, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"])

    kind = found.schema["doc_id"].dataType
    rows = found.withColumn("doc_id", F.col("doc_id").cast("string"))
    return rows.mapInPandas(run, f"doc_id string, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long, n_added long").withColumn("doc_id", F.col("doc_id").cast(kind))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
QUERIES = {"op5_pii": op5_pii}
