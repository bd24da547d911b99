"""WARC archives of pages, read back and indexed by an external merge.

Every record is a gzip member of its own, and the index holds the member's offset, so
a record can be read without those before it. Archives are written by Spark's own
text sink, so any file system Spark knows will do and a lost task is simply written
again: the sink's line separator is the zero byte that ends each member (the highest
byte of its length). Reading gives each archive's captures as a run sorted by URL key
and time. Runs are cut at the same range borders, and every range merges its parts of
all runs with a loser tree, which yields one global order of capture histories.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import columns_as, fresh_path, materialise, small_batches

#: Payloads under this size are never deduplicated.
LEAST_REVISIT = 1000
#: Records of one archive at most, by payload size up to so many bytes: an archive unpacks to 256 MB, or to one record.
ARCHIVE_RECORDS = ((1 << 18, 1000), (1 << 22, 64), (1 << 26, 4), (1 << 31, 1))
#: Captures that one merging task holds, about.
RANGE_CAPTURES = 100_000
#: Pages carry no time; page i counts as captured i nanoseconds after this one, so times of all 64-bit ids exist and sort as text.
FIRST_CAPTURE = datetime.datetime(2024, 1, 1)
#: Member sizes from which the highest byte of the length may not be zero.
_LONG = 1 << 24
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)(?::[0-9]*)?([^#]*)"
_END = b"\r\n\r\n"
_INFO = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:page:info>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n" + _END


def url_key(url: Column) -> Column:
    """Sort key of a URL: the host's labels from the top level down, then path and query; no scheme, port or fragment."""
    url = F.coalesce(url, F.lit(""))
    host, rest = F.lower(F.regexp_extract(url, _URL, 1)), F.regexp_extract(url, _URL, 2)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(url.rlike(_URL), key).otherwise(url)


def capture_time(page: int | None) -> str:
    """WARC date with nine places, so that the order of the texts is that of the ids."""
    seconds, nanoseconds = divmod(page or 0, 10**9)
    return f"{(FIRST_CAPTURE + datetime.timedelta(seconds=seconds)).isoformat()}.{nanoseconds:09d}Z"


def _members(record: bytes) -> bytes:
    """The record as a gzip member; of a very long one, its end is a member of its own, so that the last byte is always zero."""
    if len(record) < _LONG:
        return zlib.compress(record, 6, wbits=31)
    return zlib.compress(record[: -len(_END)], 6, wbits=31) + zlib.compress(_END, 6, wbits=31)


def _record(page: int | None, url: str | None, payload: bytes, digest: str, keeper: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if keeper is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if keeper is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {capture_time(page)}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([] if keeper is None else ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{keeper}>"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + _END + block + _END


def _records(most: int):
    """Pages to the values of the text sink, which begins a new file after ``most`` of them: a member without its last byte, after the archive's own record where a file begins."""
    info = _members(_INFO)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                values = []
                for page, url, payload, digest, keeper in zip(*(b.column(c).slice(lo, 256).to_pylist() for c in ("page_id", "url", "payload", "digest", "keeper")), strict=True):
                    member = _members(_record(page, url, payload, digest, keeper))
                    values.append((b"" if n % most else info) + member[:-1])
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one record per row: response, or revisit of the record with the largest id of equal payloads of 1000 bytes or more.

    Ids are whole numbers of any sign and size up to 64 bits; others are refused.
    Rows that repeat the kept id are responses too. A null payload is empty, a null
    URL an empty target, a null id is left out of its header; a group of payloads
    without any id has no revisits. Line ends in a URL become blanks. Large payloads
    get archives of fewer records, in a folder for each class of sizes.
    """
    kind = pages.schema[id_col].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"ids of pages must be whole numbers, not {kind}")
    base = columns_as(pages, page_id=id_col, url=url_col, html=payload_col).select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("bigint"))
    told = materialise(base.select("page_id", "digest", "n"), "digests")
    groups = told.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1 and keeper is not null")
    groups = materialise(groups.select(F.col("digest").alias("key"), "keeper"), "copies")
    largest = told.agg(F.max("n")).first()[0] or 0
    # payloads that are never deduplicated, equal ones too, are dealt out by themselves
    key = F.when(F.col("n") >= LEAST_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    rows = base.withColumn("key", key).join(groups, "key", "left")
    rows = rows.withColumn("keeper", F.when(F.col("page_id").eqNullSafe(F.col("keeper")), None).otherwise(F.col("keeper"))).withColumn("payload", F.col("payload").cast("binary"))
    least = -1
    for most_bytes, most in ARCHIVE_RECORDS:
        some = rows.where((F.col("n") > least) & (F.col("n") <= most_bytes)).select("page_id", "url", "payload", "digest", "keeper")
        values = some.mapInArrow(_records(most), "value binary").select(F.col("value").cast("string").alias("value"))
        values.write.option("lineSep", "\0").option("maxRecordsPerFile", most).text(f"{path}/upto-{most_bytes}")
        least = most_bytes
        if largest <= most_bytes:
            break


def _unpacked(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; a plain file is one piece."""
    if data[:2] != b"\x1f\x8b":
        yield 0, data
        return
    view, at = memoryview(data), 0
    while at < len(data):
        d, parts, to = zlib.decompressobj(wbits=31), [], at
        while not d.eof:
            if to >= len(data):
                raise ValueError(f"the member at byte {at} is cut short")
            piece = view[to : to + (1 << 16)]
            parts.append(d.decompress(piece))
            to += len(piece)
        yield at, b"".join(parts)
        at = to - len(d.unused_data)


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Records of an archive: offset (of the gzip member, or in a plain file), headers by lower-case name, block. Raises ValueError where the form is broken."""
    plain = data[:2] != b"\x1f\x8b"
    held, offset = b"", 0
    for at, piece in _unpacked(data):
        if not held:
            offset = at
        held, pos = held + piece, 0
        while pos < len(held):
            end = held.find(_END, pos)
            lines = held[pos : max(end, pos)].decode("utf-8", "surrogatepass").split("\r\n")
            if end >= 0 and not lines[0].startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {offset}")
            headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            if end >= 0 and not headers.get("content-length", "").isdigit():
                raise ValueError(f"the record at byte {offset} has no length")
            to = end + 4 + int(headers["content-length"]) + 4 if end >= 0 else len(held) + 1
            if to > len(held):
                break
            if held[to - 4 : to] != _END:
                raise ValueError(f"the record at byte {offset} doesn't end where it says")
            yield offset, headers, held[end + 4 : to - 4]
            offset += to - pos if plain else 0
            pos = to
        held = held[pos:]
    if held:
        raise ValueError(f"the record at byte {offset} is cut short")


def _page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri or "")
    return int(m[1]) if m else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            rows = []
            for at, headers, block in parse_archive(content.as_py()):
                if headers["warc-type"] == "warcinfo":
                    continue
                digest, n = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
                if headers["warc-type"] == "response":
                    payload = block[block.index(_END) + 4 :]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != n:
                        raise ValueError(f"the payload at byte {at} of {path} doesn't match its digest")
                rows.append((_page_of(headers["warc-record-id"]), headers.get("warc-target-uri", ""), headers["warc-date"], headers["warc-type"], n, digest, _page_of(headers.get("warc-refers-to")), at))
            name = "/".join(path.as_py().split("/")[-2:])
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array([name] * len(rows))], names=["page_id", "url", "time", "record_type", "payload_bytes", "payload_digest", "refers_to", "offset", "archive"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, time, record_type, payload_bytes, payload_digest, refers_to, archive and the offset in it. Payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = "page_id bigint, url string, time string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, offset bigint, archive string"
    return files.mapInArrow(_read, schema)


class LoserTree:
    """Merges k sorted sequences: each inner node keeps the loser of its match, the winner goes up; a step costs log2(k) comparisons."""

    def __init__(self, runs: Sequence[Sequence]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._play(1) if len(runs) > 1 else 0

    def _key(self, r: int):
        """A run's next item; an exhausted run loses to all others, equal items go by run."""
        at = self.at[r]
        return (0, self.runs[r][at], r) if at < len(self.runs[r]) else (1,)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._key(a) <= self._key(b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) of every item in order."""
        for _ in range(sum(map(len, self.runs))):
            w = self.winner
            yield w, self.at[w]
            self.at[w] += 1
            node = (w + self.k) // 2
            key = self._key(w)
            while node:
                other = self.losers[node]
                if other >= 0 and self._key(other) < key:
                    self.losers[node], w = w, other
                    key = self._key(w)
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, sorted by archive and place in its run, in; the same rows in global order out, with range and place."""
    from pyspark import TaskContext

    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    archive = table["archive"].to_pylist()
    keys = list(zip(table["url_key"].to_pylist(), table["time"].to_pylist(), [-1 if p is None else p for p in table["page_id"].to_pylist()], strict=True))
    first = [i for i in range(len(archive)) if i == 0 or archive[i] != archive[i - 1]]
    runs = [keys[i:j] for i, j in zip(first, [*first[1:], len(keys)], strict=True)]
    order = pa.array([first[r] + i for r, i in LoserTree(runs)], pa.int64())
    part = TaskContext.get().partitionId()
    out = table.take(order).append_column("range", pa.array([part] * len(order), pa.int32())).append_column("place", pa.array(range(len(order)), pa.int64()))
    yield from out.combine_chunks().to_batches()


def merge_index(captures: DataFrame) -> DataFrame:
    """``captures`` (as read) with url_key and capture_rank, their place in the global order by URL key, time and page id, from 0."""
    runs = captures.withColumn("url_key", url_key(F.col("url"))).drop("url")
    # an archive's captures, in order: its run (of 1000 at most)
    in_run = Window.partitionBy("archive").orderBy("url_key", "time", "page_id", "offset")
    runs = materialise(runs.withColumn("seq", F.row_number().over(in_run)), "runs")
    n = max(1, -(-runs.count() // RANGE_CAPTURES), int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # time and id are part of the border, so one URL's captures may fill several ranges
    ranged = runs.repartitionByRange(n, "url_key", "time", "page_id", "archive", "offset").sortWithinPartitions("archive", "seq")
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in runs.schema)}, range int, place bigint"
    merged = materialise(ranged.mapInArrow(_merge, schema), "merged")
    sizes = merged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return merged.join(before, "range").withColumn("capture_rank", F.col("before") + F.col("place")).drop("range", "place", "before", "seq")


def archive_and_index(pages: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Write ``pages`` as archives in ``path`` (the shared folder, if none is given), read them back and index them.

    An empty table gives no archives with records and an empty result.
    """
    small_batches(pages.sparkSession)
    path = path or fresh_path(pages.sparkSession, "archives")
    write_archives(pages, path, **columns)
    return merge_index(read_archives(pages.sparkSession, path))


SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS url,
         sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
  FROM pages
), k AS (
  SELECT *, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\-]*://')
    THEN array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)(?::[0-9]*)?([^#]*)', 1)), '.')), ',') || ')'
         || coalesce(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)(?::[0-9]*)?([^#]*)', 2), ''), '/')
    ELSE url END AS url_key,
    max(page_id) OVER (PARTITION BY payload) AS last_page
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_page THEN last_page END AS refers_to,
       url_key, row_number() OVER (ORDER BY url_key, page_id) - 1 AS capture_rank
FROM k
"""
