"""WARC archives and their capture index.

Pages become WARC records, written by Spark's text writer (a record per row), so that files land in shared storage by
the usual commit protocol; files are bounded in bytes. Reading parses the archives by Content-Length, file by file; each
file's captures, sorted by URL key and time, form a run. Every SPLIT_ROWS-th key of the runs becomes a candidate for a
cut; between the cuts lie key ranges. A run leaves its task as stretches, one row for each range it touches and sorted
as it was, and each range merges its stretches through a loser tree: capture histories in global order, range after range.
"""

import base64
import bisect
import hashlib
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shotlake.llm.common import attach, keep, shared_dir, table

#: (payload bytes up to, records of an archive file): files have 32 MB and headers at most, or one record.
FILES = ((1 << 15, 1000), (1 << 19, 64), (1 << 23, 4), (1 << 62, 1))
#: Captures of a range at about most, and captures of a run for each key of it that may become a cut.
RANGE_ROWS, SPLIT_ROWS = 50_000, 500
#: Without a column of capture times, a page is captured so many seconds after this moment as its id, modulo 2^31, says.
FIRST_CAPTURE, CAPTURES = 1_704_067_200, 1 << 31
_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: twenty bits, five hex digits, are four base32 digits."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _B32)


def _header(text: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(text, "[\\r\\n]+", "%0A")


def _uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """Write one record per row. Among payloads of at least `least` bytes that are equal, the smallest id's is the response, others are revisits of it.

    A null html is an empty payload; a null url leaves the target out; null ids are larger than others here; rows that
    repeat the smallest id with its payload are responses like the first. Payloads count as equal by SHA-256 and length:
    there are known pairs of one SHA-1.
    """
    full = F.coalesce(F.col(html), F.lit("")).cast("binary")
    slim = keep(pages.select(F.monotonically_increasing_id().alias("_rk"), F.col(page_id).alias("_id"), F.sha2(full, 256).alias("_sha"), F.octet_length(full).alias("_bytes")), "warc-digests")
    groups = keep(slim.filter(F.col("_bytes") >= least).groupBy("_sha", "_bytes").agg(F.count("*").alias("n"), F.min(F.struct(F.col("_id").isNull().alias("none"), "_id")).alias("_first")).filter("n > 1"), "warc-equal")
    revisits = keep(attach(slim, groups, ["_sha", "_bytes"], ["_rk"]).filter("_first is not null and not (_first._id <=> _id)").groupBy("_id", "_sha", "_bytes").agg(F.count("*").alias("n"), F.first(F.col("_first._id")).alias("_to")), "warc-revisits")
    # whole payloads move only if there are many revisits: Spark broadcasts their list while it is small
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"), base32_sha1(full).alias("_digest"), F.sha2(full, 256).alias("_sha"), F.octet_length(full).alias("_bytes"))
    rows = rows.join(revisits.select(F.col("_id").alias("_r"), F.col("_sha").alias("_d"), "_to"), F.col("_id").eqNullSafe(F.col("_r")) & (F.col("_sha") == F.col("_d")), "left")
    revisit = F.col("_d").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("_html")))
    when = F.date_format(F.timestamp_seconds(F.pmod(F.coalesce(F.col("_id").try_cast("long"), F.lit(0)), F.lit(CAPTURES)) + F.lit(FIRST_CAPTURE)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), _uri(F.col("_id")), F.lit("\r\nWARC-Date: "), when,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), _header(F.col("_url"))), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("_digest"), F.lit("\r\nX-Payload-Bytes: "), F.col("_bytes"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _uri(F.col("_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
    )
    # a record ends with two line ends: the second is the writer's
    record, largest, above = F.concat(head, block, F.lit("\r\n")).alias("value"), slim.agg(F.max("_bytes")).first()[0] or 0, -1
    for upto, per_file in FILES:
        if above < max(largest, FILES[0][0]):
            rows.filter(F.col("_bytes").between(above + 1, upto)).select(record).write.mode("append").option("lineSep", "\r\n").option("compression", "none").option("maxRecordsPerFile", per_file).text(path)
        above = upto


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels in reverse, then path and sorted query; no scheme, `www`, fragment or case of host."""
    if url is None:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return url
    labels = [x for x in host.removeprefix("www.").split(".") if x]
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(labels))}{f':{port}' if port not in (None, 80, 443) else ''}){unquote(parts.path or '/').lower()}{f'?{query}' if query else ''}"


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The (headers, block) of each record of an archive."""
    view, at = memoryview(archive), 0
    while at < len(view):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = bytes(view[at:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines)
        start = end + 4
        stop = start + int(headers["Content-Length"])
        if archive[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} is cut off")
        yield headers, bytes(view[start:stop])
        at = stop + 4


RUN_SCHEMA = "run string, url_key string, captured string, page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, at long"
ORDER = ["url_key", "captured", "run", "at"]
_NAMES = [n.split()[0] for n in RUN_SCHEMA.split(", ")]


def _page(uri: str | None) -> str | None:
    page = uri[len("<urn:page:") : -1] if uri else None
    return None if page == "null" else page


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run of captures per archive file. A response's digest and size are those of the payload as read, and must be what its header says."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                out = []
                for i, (h, block) in enumerate(records(content)):
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Bytes"])
                    if h["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4 :]
                        if (digest, size) != (base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)):
                            raise ValueError(f"{h['WARC-Record-ID']} in {name} is damaged")
                    url = h.get("WARC-Target-URI")
                    out.append((name, url_key(url), h["WARC-Date"], _page(h["WARC-Record-ID"]), url, h["WARC-Type"], size, digest, _page(h.get("WARC-Refers-To")), i))
                out.sort(key=lambda r: (r[1], r[2], r[9]))
                yield pd.DataFrame(out, columns=_NAMES).assign(nth=range(len(out)))

    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0).select("path", "content")
    return files.mapInPandas(run, f"{RUN_SCHEMA}, nth long")


class LoserTree:
    """k sorted runs in one order: each inner node keeps the loser of its match, and the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.head = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _play(self, leaf: int) -> None:
        node = (leaf + self.k) // 2
        while node:
            if self.tree[node] < 0:  # no opponent yet: wait here
                self.tree[node] = leaf
                return
            if self._before(self.tree[node], leaf):
                self.tree[node], leaf = leaf, self.tree[node]
            node //= 2
        self.tree[0] = leaf

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.head[winner := self.tree[0]] is not None:
            yield self.head[winner]
            self.head[winner] = next(self.runs[winner], None)
            self._play(winner)


def range_cuts(runs: DataFrame, range_rows: int = RANGE_ROWS, split_rows: int = SPLIT_ROWS) -> list[tuple]:
    """Sort keys that cut all captures into ranges of about range_rows: one key for each range but the first reaches the driver.

    Every split_rows-th capture of a run stands for the split_rows before it; the last one of a run, for the rest.
    """
    per = max(1, range_rows // split_rows)
    marks = runs.filter(F.col("nth") % split_rows == split_rows - 1).select(*ORDER)
    n = marks.count()
    if n < per:
        return []
    ranges = -(-n // per)
    # marks are few; they are sorted by ranges of their own and numbered, and every per-th one is a cut
    at = F.monotonically_increasing_id()
    some = keep(marks.repartitionByRange(max(1, ranges // 64), *ORDER).sortWithinPartitions(*ORDER).withColumns({"_p": F.spark_partition_id(), "_i": at.bitwiseAND(F.lit((1 << 33) - 1))}), "warc-marks")
    before = some.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).select("_p", "_b")
    cuts = some.join(before, "_p").filter((F.col("_b") + F.col("_i")) % per == per - 1)
    return sorted(map(tuple, cuts.select(*ORDER).collect()))


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """All captures of sorted runs by (url_key, captured, run, at): `range` numbers the key ranges in order, `position` the captures in a range, `capture` those of a URL in it.

    Ranges are cut on the whole sort key, so one URL with many captures spans several. runs has a run's rows in order, each
    with its number `nth`.
    """
    cuts = range_cuts(runs, range_rows, split_rows)
    shared = runs.sparkSession.sparkContext.broadcast(cuts)

    def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys = list(zip(*(b[c] for c in ORDER), strict=True))
            at = 0
            while at < len(keys):
                run, where = keys[at][2], bisect.bisect_right(shared.value, keys[at])
                stop = at + 1
                end = shared.value[where] if where < len(shared.value) else None
                while stop < len(keys) and keys[stop][2] == run and keys[stop] > keys[at] and (end is None or keys[stop] < end):
                    stop += 1
                yield pd.DataFrame({"range": [where], "first": [int(b["nth"].iloc[at])], "run": [run], "rows": [b[_NAMES].iloc[at:stop].to_dict("records")]})
                at = stop

    def merge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["run", "first"], kind="stable")
        # a run that a batch of rows cut in two goes on where it stopped
        tree = LoserTree([((*(r[c] for c in ORDER), tuple(r[c] for c in _NAMES)) for rows in part["rows"] for r in rows) for _, part in g.groupby("run", sort=False)])
        out, last, k = [], None, 0
        for i, (url, *_, row) in enumerate(tree):
            k = k + 1 if url == last else 0
            last = url
            out.append((*row, int(key[0]), i, k))
        return pd.DataFrame(out, columns=[*_NAMES, "range", "position", "capture"])

    rows = ", ".join(n.replace(" ", ":") for n in RUN_SCHEMA.split(", "))
    stretches = runs.mapInPandas(stretch, f"range int, first long, run string, rows array<struct<{rows}>>")
    return stretches.groupBy("range").applyInPandas(merge, f"{RUN_SCHEMA}, range int, position long, capture long")


def archive_and_index(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages' archives, read them back, and return the merged capture index, one row per page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to, url, url_key, captured, range, position,
    capture. Null html, url or ids and repeated rows are kept, see write_archives(); an empty table gives an empty index.
    """
    spark = pages.sparkSession
    if path is None:
        import uuid

        path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, page_id, url, html, least)
    index = merge_runs(keep(read_runs(spark, path), "warc-runs"))
    kind = pages.schema[page_id].dataType
    return index.select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind), "url", "url_key", "captured", "range", "position", "capture")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_index(table(spark, sf_dir, "pages"))


ORACLE: dict[str, str] = {}
QUERIES = {"op2_warc": op2_warc}
