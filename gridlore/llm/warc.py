"""WARC archives: a Python data source that reads and writes them, and archiving with revisit records.

    register(spark)
    df.write.format("warc").mode("append").save(folder)
    spark.read.format("warc").load(folder).filter("warc_type = 'response'")

Reading. Partitions are planned on the driver over files and, where a file has an index beside it (the
writer leaves one), over byte ranges of whole records, so a large file is read by many tasks. Equality
and IN filters on warc_type, and equality on any header column, are pushed down (Spark's
spark.sql.python.filterPushdown.enabled must be on). Of each record the header is parsed first; a record
that the filters turn away, and the payload where option payload=false, is passed over without being
decoded. With an index, records of other types are not even read.

Writing. Records are gzip members of their own (option compress=false: plain), with sizes and digests
in the header. A task writes files under names of its own; the driver's commit lists them in a manifest
with the reader's file sizes, so files of lost or repeated tasks are never read.

Files are opened by pyarrow.fs, so any store that it knows can hold archives.

Defined cases: a null payload is written as an empty one; a null field, also a null key, leaves its header out and is
read as null; very long payloads are one record each; of rows that repeat with key and payload one is the response;
an empty table gives a folder with an empty manifest, which reads as no rows; other columns are not written, whatever
their names.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
import zlib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from gridlore.llm.common import new_path, stage

#: Column, header name. Fixed names of the format; those with X- are this writer's own.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "page_id": "X-Page-ID", "refers_to_page": "X-Refers-To-Page", "payload_bytes": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload binary"
MANIFEST = "manifest-"
PLANNED_BYTES = 16 << 20


def _fs(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:"):
            return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def header_bytes(values: dict[str, str | None], length: int) -> bytes:
    lines = ["WARC/1.1"]
    lines += [f"{HEADERS[c]}: {v}" for c, v in values.items() if v is not None]
    lines.append(f"Content-Length: {length}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(lines: list[bytes]) -> dict[str, str]:
    """Header names in lower case to values; continuation lines are joined."""
    out: dict[str, str] = {}
    last = ""
    for x in lines:
        if x[:1] in b" \t" and last:
            out[last] += " " + x.decode("utf-8", "replace").strip()
        elif b":" in x:
            k, _, v = x.partition(b":")
            last = k.decode("latin-1").strip().lower()
            out[last] = v.decode("utf-8", "replace").strip()
    return out


@dataclass
class Piece(InputPartition):
    """A file's records from start to end; end None: to the end of the file. skips: (start, end) of single records to read instead."""

    path: str
    start: int = 0
    end: int | None = None
    records: list = field(default_factory=list)

    def __post_init__(self):
        self.value = (self.path, self.start)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, [f.name for f in schema.fields], overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true") != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, top = _fs(self.path)
        found = {i.path: i.size for i in store.get_file_info(fs.FileSelector(top, recursive=True)) if i.is_file}
        listed = [p for p in found if p.rsplit("/", 1)[-1].startswith(MANIFEST)]
        if listed:
            names = [f"{p.rsplit('/', 1)[0]}/{n}" for p in listed for n in json.loads(store.open_input_file(p).read())]
        else:
            names = [p for p in found if p.endswith((".warc", ".warc.gz"))]
        out = []
        for name in sorted(names):
            if f"{name}.idx" in found:
                out += self._ranges(store, name)
            else:
                out.append(Piece(name))
        return out or [Piece("")]

    def _ranges(self, store, name):
        """Runs of records of the wanted types, of PLANNED_BYTES or so."""
        import numpy as np

        kinds, table = json.loads(store.open_input_file(f"{name}.idx").read()), []
        for kind, starts in kinds.items():
            if "warc_type" not in self.wanted or kind in self.wanted["warc_type"]:
                table.append(np.array(starts, np.int64).reshape(-1, 2).cumsum(0))
        ends = np.sort(np.concatenate(table).view("i8,i8").ravel(), order="f0") if table else []
        out, run = [], None
        for a, b in ends:
            a, b = int(a), int(b)
            if run and run.end == a and b - run.start <= PLANNED_BYTES:
                run.end = b
            elif run and sum(y - x for x, y in run.records) + (run.end - run.start) + b - a <= PLANNED_BYTES:
                run.records.append((run.start, run.end))
                run.start, run.end = a, b
            else:
                if run:
                    out.append(run)
                run = Piece(name, a, b)
        if run:
            out.append(run)
        return out

    def read(self, piece):
        if not piece.path:
            return
        store, _ = _fs(self.path)
        with store.open_input_file(piece.path) as f:
            for start, end in [*piece.records, (piece.start, piece.end)]:
                f.seek(start)
                yield from self._records(f.read(end - start) if end is not None else f, piece.path.endswith(".gz"))

    def _records(self, source, packed: bool):
        raw = io.BytesIO(source) if isinstance(source, bytes) else source
        stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if packed else io.BufferedReader(raw, 1 << 16)
        names = [(c, h.lower()) for c, h in HEADERS.items()]
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue  # the blank lines that end a record
            lines = []
            while (line := stream.readline()).strip():
                lines.append(line.rstrip(b"\r\n"))
            h = parse_header(lines)
            n = int(h.get("content-length", 0))
            row = [h.get(x) for _, x in names]
            if any(h.get(HEADERS[c].lower()) not in v for c, v in self.wanted.items()):
                _skip(stream, n)
                continue
            if self.payload:
                row.append(stream.read(n))
            else:
                _skip(stream, n)
                row.append(None)
            yield tuple(row)


def _skip(stream, n: int) -> None:
    while n > 0 and (x := stream.read(min(n, 1 << 16))):
        n -= len(x)


@dataclass
class Written(WriterCommitMessage):
    names: list


class WarcWriter(DataSourceWriter):
    """Rows with any of the header columns and payload. Files hold up to file_bytes of payload."""

    def __init__(self, options, columns, overwrite):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.compress = options.get("compress", "true") != "false"
        self.level = int(options.get("level", "3"))
        self.file_bytes = int(options.get("file_bytes", str(256 << 20)))

    def write(self, rows):
        store, top = _fs(self.path)
        store.create_dir(top, recursive=True)
        at = {c: self.columns.index(c) for c in (*HEADERS, "payload") if c in self.columns}
        names, out, kinds, place, last = [], None, {}, 0, {}

        def close():
            if out is not None:
                out.close()
                with store.open_output_stream(f"{top}/{names[-1]}.idx", compression=None) as f:
                    f.write(json.dumps(kinds).encode())

        for r in rows:
            if out is None or place >= self.file_bytes:
                close()
                names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.compress)
                out, kinds, place, last = store.open_output_stream(f"{top}/{names[-1]}", compression=None), {}, 0, {}
            values = {c: None if r[i] is None else str(r[i]) for c, i in at.items() if c != "payload"}
            payload = r[at["payload"]] if "payload" in at else None
            payload = payload.encode() if isinstance(payload, str) else bytes(payload or b"")
            record = header_bytes(values, len(payload)) + payload + b"\r\n\r\n"
            if self.compress:
                z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                record = z.compress(record) + z.flush()
            out.write(record)
            kind = values.get("warc_type") or ""
            a, b = last.get(kind, (0, 0))  # differences are short
            kinds.setdefault(kind, []).extend((place - a, place + len(record) - b))
            last[kind] = (place, place + len(record))
            place += len(record)
        close()
        return Written(names)

    def commit(self, messages):
        store, top = _fs(self.path)
        store.create_dir(top, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for i in store.get_file_info(fs.FileSelector(top)):
                if i.is_file and i.base_name.startswith(MANIFEST):
                    store.delete_file(i.path)
        with store.open_output_stream(f"{top}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages):
        store, top = _fs(self.path)
        for m in messages:
            for n in m.names if m else ():
                for name in (n, f"{n}.idx"):
                    try:
                        store.delete_file(f"{top}/{name}")
                    except OSError:
                        pass


def register(spark) -> None:
    """Makes format "warc" known to the session and lets filters reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


REVISIT_BYTES = 100


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES, small_rows: int = 500_000) -> DataFrame:
    """Pages as WARC rows. Of equal payloads of at least `least` bytes the one with the smallest key (null last) is the response; the
    others revisit it and carry no payload. Only digests are shuffled; the table of repeated payloads is broadcast up to small_rows rows.
    If pages repeat with key and payload, one of them is the response; only then pages are staged, so that rows keep their numbers."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    p = pages.select(F.col(key).alias("k"), F.col(url).alias("u") if url in pages.columns else F.lit(None).cast("string").alias("u"), body.alias("body"))
    p = p.withColumn("n", F.octet_length("body").cast("long")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    alike = p.filter(F.col("n") >= least).groupBy("digest", "k").agg(F.count("*").alias("same")).groupBy("digest")
    alike = alike.agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "same")).alias("f"), F.sum("same").alias("of")).filter("of > 1")
    repeated = stage(alike.select("digest", F.col("f.k").alias("first"), F.col("f.same").alias("same")), "repeats")
    tied = repeated.filter("same > 1")
    if tied.isEmpty():
        p = p.withColumn("uid", F.lit(0).cast("long"))
        repeated = repeated.select("digest", "first", F.lit(0).cast("long").alias("keep"))
    else:
        p = stage(p.withColumn("uid", F.monotonically_increasing_id()), "pages")
        own = p.select("digest", "k", "uid").join(tied.select("digest", "first"), "digest").filter(F.col("k").eqNullSafe(F.col("first"))).groupBy("digest").agg(F.min("uid").alias("row"))
        repeated = repeated.join(own, "digest", "left").select("digest", "first", "row")
        repeated = stage(repeated.withColumnRenamed("row", "keep"), "repeats")
    repeated = repeated.withColumn("found", F.lit(True))
    if repeated.count() <= small_rows:
        repeated = F.broadcast(repeated)
    j = p.join(repeated, "digest", "left")
    here = F.col("k").eqNullSafe(F.col("first")) & (F.col("keep").isNull() | (F.col("uid") == F.col("keep")))
    again = F.col("found").isNotNull() & (F.col("n") >= least) & ~here
    name = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">")))
    return j.select(
        F.when(again, "revisit").otherwise("response").alias("warc_type"), name(F.col("k")).alias("record_id"), F.regexp_replace("u", r"[\r\n]+", " ").alias("target_uri"),
        F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("payload_digest"), F.when(again, name(F.col("first"))).alias("refers_to"),
        F.col("k").cast("string").alias("page_id"), F.when(again, F.col("first").cast("string")).alias("refers_to_page"), F.col("n").cast("string").alias("payload_bytes"),
        F.when(~again, F.col("body")).alias("payload"),
    )


def archive(pages: DataFrame, folder: str, **how) -> None:
    register(pages.sparkSession)
    records(pages, **how).write.format("warc").mode("append").save(folder)


def round_trip(pages: DataFrame, key: str = "page_id", folder: str | None = None, **how) -> DataFrame:
    """Archives pages and reads the archives back: key, payload_bytes, payload_digest, record_type, refers_to.

    Responses are read with their payloads, whose size and digest are taken anew; of revisits only the headers are."""
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    archive(pages, folder, key=key, **how)
    kind = pages.schema[key].dataType
    full = spark.read.format("warc").load(folder).filter("warc_type = 'response'")
    brief = spark.read.format("warc").option("payload", "false").load(folder).filter("warc_type = 'revisit'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to_page")
    brief = brief.select("page_id", F.col("payload_bytes").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), F.col("warc_type").alias("record_type"), "refers_to_page")
    return full.unionByName(brief).select(F.col("page_id").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").cast(kind).alias("refers_to"))
