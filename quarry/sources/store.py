"""The engine: a folder of tables, SQL, documents with their index, search, snapshots.

A table is a folder of parts (folders of Parquet files) and of numbered manifests; the manifest with the
highest number names the parts in use, the schema and what to leave out of each part. A writer writes
its parts and then renames a finished manifest to the next number, which fails if another writer was
faster: readers see a whole table and never one that is being written, and a crash at any point leaves
the table as it was. Appending adds a part; replacing a collection's documents writes only that
collection; tables of many parts are rewritten as one.

The full-text index is maintained by every change of documents: postings of new documents are appended
with a sequence number, replaced ones are listed as dead up to a number, and document frequencies are
kept as sums of additions and removals. It names the documents' manifest it belongs to, so after a
crash between the two it is rebuilt.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vectors
from ..operators import index as text_index
from ..operators import filters, match, search
from ..operators import queue as work_queue

SCHEMA_VERSION = 4
DOCUMENTS = "rowid long, id string, title string, content string, collection string, metadata string, created_at long, updated_at long"
COLLECTIONS = "name string, created_at long, updated_at long, schema_version int, config string, embedding_provider string, embedding_dimensions int, embedding_status string, processing_status string"
VECTORS = "rowid long, embedding array<float>"
NAME = re.compile(r"[A-Za-z0-9_-]{1,64}\Z")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,127}\Z")
MAX_METADATA = 1 << 20
#: Parts after which a table is rewritten as one.
MAX_PARTS = 32
FIELDS = ("title", "content", "metadata")
POSTINGS = "rowid long, term string, tf long, positions array<struct<field:int,pos:int>>, field_tf array<long>, dl long, seq long, bucket int"


def errors(metadata_limit: int = MAX_METADATA) -> Column:
    """What is wrong with a document row (id, title, content, metadata): an array of messages, empty if nothing."""
    blank = lambda c: F.length(F.trim(F.coalesce(c, F.lit("")))) == 0
    meta = F.col("metadata")
    checks = [
        (blank("title") & blank("content"), "content or title is required"), (F.col("id").isNotNull() & blank("id"), "id is blank"),
        (meta.isNotNull() & ~F.coalesce(F.trim(meta).startswith("{") & F.try_parse_json(meta).isNotNull(), F.lit(False)), "metadata is not an object"),
        (F.get_json_object(meta, "$.collection").isNotNull(), "metadata must not name a collection"), (F.octet_length(meta) > metadata_limit, "metadata is too large"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for c, m in checks]), lambda e: e.isNotNull())


def check_name(name: str) -> str:
    if not NAME.match(name):
        raise ValueError(f"{name!r} is no collection name: 1 to 64 letters, digits, _ or -")
    return name


def check_identifier(name: str) -> str:
    if not IDENTIFIER.match(name):
        raise ValueError(f"{name!r} is no table name")
    return name


def check_limit(n: int) -> int:
    if not isinstance(n, int) or isinstance(n, bool) or not 1 <= n <= 10_000:
        raise ValueError("a limit is an integer from 1 to 10000")
    return n


def check_threshold(x: float) -> float:
    if not 0 <= x <= 1:
        raise ValueError("a threshold is between 0 and 1")
    return x


def text_words(text: str | None) -> list[str]:
    """The words that full-text search would look for."""
    return match.split_terms(text or "")


def _commas(text: str) -> list[str]:
    """text split at commas outside quotes and brackets."""
    out, depth, quoted, last = [], 0, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                out.append(text[last:i])
                last = i + 1
    return [*out, text[last:]]


def optimal_batch_size(docs: DataFrame, cache_bytes: int = 8 << 20) -> int:
    """Between 5 and 50 by the mean size of documents; 10 for none."""
    size = F.length(F.coalesce("content", F.lit(""))) * 5 + F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("metadata", F.lit("")))
    mean = docs.agg(F.avg(size)).first()[0]
    return max(5, min(50, int(0.25 * cache_bytes / mean))) if mean else 10


class Statement:
    """A prepared query read row by row without bringing the result to the driver at once."""

    def __init__(self, engine: Engine, text: str):
        self.engine, self.text, self.args, self.rows, self.row, self.names = engine, text, None, None, None, []

    def bind(self, args: dict | list | None) -> bool:
        self.args, self.rows, self.row = args, None, None
        return True

    def step(self) -> bool:
        if self.rows is None:
            df = self.engine.sql(self.text, self.args)
            self.names, self.rows = df.columns, df.toLocalIterator()
        self.row = next(self.rows, None)
        return self.row is not None

    def get(self) -> list:
        return list(self.row) if self.row is not None else []

    def as_dict(self) -> dict:
        return dict(zip(self.names, self.row)) if self.row is not None else {}

    def columns(self) -> list[str]:
        return self.names or self.engine.sql(self.text, self.args).columns

    def reset(self) -> None:
        self.rows = self.row = None

    def free(self) -> None:
        self.reset()
        self.args = None

    def __iter__(self) -> Iterator[dict]:
        while self.step():
            yield self.as_dict()


MANIFEST = re.compile(r"(\d{12})\.json\Z")


def _extra(manifest: dict) -> dict:
    return {k: v for k, v in manifest.items() if k not in ("schema", "by", "parts", "number")}


def _but_number(manifest: dict) -> dict:
    return {k: v for k, v in manifest.items() if k != "number"}


@dataclass
class Changed:
    """What a statement did: rows modified, and the rows it returns."""

    rows_modified: int
    returned: DataFrame | None = None


class Engine:
    """Tables below path, reachable by SQL under their names."""

    BASE = {"documents": DOCUMENTS, "collections": COLLECTIONS, "vectors": VECTORS, "queue": work_queue.SCHEMA}
    PARTITIONS = {"documents": ["collection"], "fts_postings": ["bucket"]}

    def __init__(self, spark: SparkSession, path: str, buckets: int = text_index.BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._opened: tuple[int, text_index.TextIndex] | None = None
        self._current = False
        self.init_schema()

    # files

    def _exists(self, p: str) -> bool:
        return self.fs.exists(self.fs_path(p))

    def _names(self, p: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.fs_path(p))] if self._exists(p) else []

    def _numbers(self, name: str) -> list[int]:
        """The numbers of a table's manifests, ascending."""
        return sorted(int(m[1]) for x in self._names(f"{self.path}/{name}/manifests") if (m := MANIFEST.match(x)))

    def _manifest(self, name: str) -> dict | None:
        have = self._numbers(name)
        if not have:
            return None
        return json.loads(self._read(f"{self.path}/{name}/manifests/{have[-1]:012d}.json")) | {"number": have[-1]}

    def _read(self, p: str) -> str:
        f = self.fs.open(self.fs_path(p))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def _rename(self, old: str, new: str) -> None:
        """Fails if new exists."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self.fs_path(old), self.fs_path(new), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _publish(self, name: str, manifest: dict, before: dict | None, keep: int = 2) -> None:
        """Make manifest the table's next one after ``before``; of older ones and their parts, ``keep`` - 1 stay for
        readers at work."""
        folder, number = f"{self.path}/{name}/manifests", (before["number"] if before else 0) + 1
        tmp = f"{folder}/.{uuid.uuid4().hex}"
        out = self.fs.create(self.fs_path(tmp), True)
        out.write(bytearray(json.dumps({k: v for k, v in manifest.items() if k != "number"}).encode()))
        out.close()
        try:
            self._rename(tmp, f"{folder}/{number:012d}.json")
        except Exception as e:
            self.fs.delete(self.fs_path(tmp), False)
            raise RuntimeError(f"table {name} was changed by another writer") from e
        numbers = self._numbers(name)
        parts = lambda n: {p["dir"] for p in json.loads(self._read(f"{folder}/{n:012d}.json"))["parts"]}
        used = set().union(*(parts(n) for n in numbers[-keep:]), *({p["dir"] for p in t[name]["parts"]} for t in self._savepoints().values() if name in t))
        for n in numbers[:-keep]:
            for d in parts(n) - used:
                self.fs.delete(self.fs_path(f"{self.path}/{name}/{d}"), True)
            self.fs.delete(self.fs_path(f"{folder}/{n:012d}.json"), False)

    def _part(self, name: str, df: DataFrame, by: list[str]) -> str:
        part = f"__part={uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(f"{self.path}/{check_identifier(name)}/{part}")
        return part

    # tables

    def init_schema(self) -> None:
        """Make the base tables that are missing. A folder with any manifest is a table, never made anew."""
        for name, schema in self.BASE.items():
            if not self._numbers(name):
                self.write(name, self.spark.createDataFrame([], schema))
        if self.table("collections").isEmpty():
            self.create_collection("default")

    def tables(self) -> list[str]:
        return sorted(n for n in self._names(self.path) if not n.startswith((".", "_")) and self._numbers(n))

    def table(self, name: str) -> DataFrame:
        m = self._manifest(check_identifier(name))
        if m is None:
            raise ValueError(f"no table {name}")
        return self._rows(name, m)

    def _rows(self, name: str, m: dict) -> DataFrame:
        schema = StructType.fromJson(m["schema"])
        whole = [f"{self.path}/{name}/{p['dir']}" for p in m["parts"] if not p["without"]]
        # parts are partitions of the table's folder, beside those that they have themselves
        read = lambda paths: self.spark.read.option("basePath", f"{self.path}/{name}").schema(schema).parquet(*paths).select(*schema.names)
        found = [read(whole)] if whole else []
        for p in m["parts"]:
            if p["without"]:  # values of the first partition column: their files are not read
                by = F.col(m["by"][0])
                found.append(read([f"{self.path}/{name}/{p['dir']}"]).where(~by.isin(p["without"]) | by.isNull()))
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None, keep: int = 2, **extra: Any) -> DataFrame:
        """df as the table's new version; the ``keep`` latest versions stay for readers at work."""
        before, by = self._manifest(check_identifier(name)), partition_by or self.PARTITIONS.get(name, [])
        part = self._part(name, df, by)
        self._publish(name, {"schema": json.loads(df.schema.json()), "by": by, "parts": [{"dir": part, "without": []}], **extra}, before, keep)
        return self.table(name)

    def append(self, name: str, df: DataFrame, **extra: Any) -> DataFrame:
        """Add rows as a part of their own; columns that either side lacks are null (schema evolution)."""
        m = self._manifest(check_identifier(name))
        if m is None:
            return self.write(name, df, **extra)
        old = StructType.fromJson(m["schema"])
        if len(m["parts"]) >= MAX_PARTS:
            return self.write(name, self._rows(name, m).unionByName(df, allowMissingColumns=True), m["by"], **{**_extra(m), **extra})
        df = df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in old], *[c for c in df.columns if c not in old.names])
        part = self._part(name, df, m["by"])
        self._publish(name, {**m, **extra, "schema": json.loads(df.schema.json()), "parts": [*m["parts"], {"dir": part, "without": []}]}, m)
        return self.table(name)

    def replace(self, name: str, df: DataFrame, values: list[str], **extra: Any) -> DataFrame:
        """df as all rows of these values of the table's first partition column; other rows are not touched."""
        m = self._manifest(name)
        if len(m["parts"]) >= MAX_PARTS:
            return self.write(name, self._rows(name, m).where(~F.col(m["by"][0]).isin(values)).unionByName(df), m["by"], **{**_extra(m), **extra})
        part = self._part(name, df.select(*StructType.fromJson(m["schema"]).names), m["by"])
        old = [{"dir": p["dir"], "without": sorted({*p["without"], *values})} for p in m["parts"]]
        self._publish(name, {**m, **extra, "parts": [*old, {"dir": part, "without": []}]}, m)
        return self.table(name)

    def add_column(self, name: str, column: str, kind: str) -> DataFrame:
        """A new column, null in the rows there are: only the manifest changes."""
        m = self._manifest(check_identifier(name))
        schema = StructType.fromJson(m["schema"]).add(check_identifier(column), kind)
        self._publish(name, {**m, "schema": json.loads(schema.json())}, m)
        return self.table(name)

    def compact(self, name: str) -> DataFrame:
        m = self._manifest(name)
        return self.write(name, self._rows(name, m), m["by"], **_extra(m))

    def drop(self, name: str) -> None:
        self.fs.delete(self.fs_path(f"{self.path}/{check_identifier(name)}"), True)

    def clear(self) -> None:
        for name in self.tables():
            self.drop(name)
        self.init_schema()

    # savepoints

    def _savepoints(self) -> dict[str, dict]:
        return {n[:-5]: json.loads(self._read(f"{self.path}/_savepoints/{n}")) for n in self._names(f"{self.path}/_savepoints") if n.endswith(".json") and not n.startswith(".")}

    def savepoint(self, name: str) -> None:
        """Remember all tables as they are; their parts stay until the savepoint is released."""
        state = {t: self._manifest(t) for t in self.tables()}
        out = self.fs.create(self.fs_path(f"{self.path}/_savepoints/{check_identifier(name)}.json"), True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    def rollback_to(self, name: str) -> None:
        """All tables as they were; newer tables go. The savepoint stays."""
        state = self._savepoints().get(name)
        if state is None:
            raise ValueError(f"no savepoint {name}")
        for t in self.tables():
            if t not in state:
                self.drop(t)
        for t, m in state.items():
            now = self._manifest(t)
            if now is None or _but_number(now) != _but_number(m):
                self._publish(t, m, now)
        if (m := self._manifest("fts_lengths")) is not None:  # it belongs to documents that have a new number now
            kept = state["fts_lengths"].get("documents") == state["documents"]["number"] if "fts_lengths" in state else False
            self._publish("fts_lengths", {**m, "documents": self._manifest("documents")["number"] if kept else -1}, m)
        self._opened = None

    def release(self, name: str) -> None:
        self.fs.delete(self.fs_path(f"{self.path}/_savepoints/{check_identifier(name)}.json"), False)

    def transaction(self, f: Callable[[Engine], Any]) -> Any:
        """f's changes all hold, or none if it fails."""
        name = f"t_{uuid.uuid4().hex}"
        self.savepoint(name)
        try:
            return f(self)
        except BaseException:
            self.rollback_to(name)
            raise
        finally:
            self.release(name)

    #: Settings of the session that may be read and set by name.
    PRAGMAS = {"shuffle_partitions": "spark.sql.shuffle.partitions", "broadcast_threshold": "spark.sql.autoBroadcastJoinThreshold", "adaptive": "spark.sql.adaptive.enabled", "time_zone": "spark.sql.session.timeZone"}

    def pragma(self, name: str, value: Any = None) -> Any:
        """Read or set a setting; table_info(t), table_list, user_version."""
        if m := re.fullmatch(r"table_info\((\w+)\)", name):
            return [(f.name, f.dataType.simpleString(), f.nullable) for f in self.table(m[1]).schema]
        if name == "table_list":
            return self.tables()
        if name == "user_version":
            return self.schema_version()
        if name not in self.PRAGMAS:
            raise ValueError(f"no pragma {name}")
        if value is not None:
            self.spark.conf.set(self.PRAGMAS[name], str(value))
        return self.spark.conf.get(self.PRAGMAS[name])

    # SQL

    def sql(self, text: str, args: dict[str, Any] | list | None = None) -> DataFrame:
        """Any query over the tables, with named (:x) or positional (?) parameters."""
        if not isinstance(text, str) or not text.strip():
            raise ValueError("a query is a non-empty string")
        self._views(text)
        return self.spark.sql(text, args) if args else self.spark.sql(text)

    def _views(self, text: str) -> None:
        for name in self.tables():
            if re.search(rf"\b{re.escape(name)}\b", text):
                self.table(name).createOrReplaceTempView(name)

    def execute(self, text: str, args: dict[str, Any] | list | None = None) -> Changed:
        """INSERT INTO t [(columns)] VALUES ... or SELECT ..., UPDATE t SET c = e, ... [WHERE ...], or DELETE FROM t
        [WHERE ...], each with [RETURNING expressions]; parameters as in sql(). Documents change through their own
        methods, which keep the index."""
        text = text.strip().rstrip(";").strip()
        if isinstance(args, list):  # positions become names, so that a clause may be used twice
            parts = re.split(r"('(?:[^']|'')*')|\?", text)
            names = iter(range(len(args)))
            text = "".join(p if p is not None else f":_p{next(names)}" for p in parts)
            args = {f"_p{i}": v for i, v in enumerate(args)}
        m = re.match(r"(?is)(insert\s+into|update|delete\s+from)\s+([A-Za-z_]\w*)\s*(.*?)(?:\s+returning\s+(.+))?\Z", text)
        if not m:
            raise ValueError("a change is INSERT INTO, UPDATE or DELETE FROM")
        verb, name, rest, returning = m[1].split()[0].lower(), m[2], m[3], m[4]
        if name == "documents" or name.startswith("fts_"):
            raise ValueError(f"{name} changes by upsert_documents and delete_documents")
        old, view = self.table(name), f"_{name}_{uuid.uuid4().hex[:8]}"
        ask = lambda q: self.spark.sql(q, args or {})
        if verb == "insert":
            i = re.match(r"(?is)\(([^()]*)\)\s*((?:values|select|with)\b.*)\Z", rest)
            columns, source = ([c.strip() for c in i[1].split(",")], i[2]) if i else (old.columns, rest)
            self._views(source)
            got = ask(source)
            if len(got.columns) != len(columns):
                raise ValueError(f"{len(columns)} columns, {len(got.columns)} values")
            new = got.toDF(*columns)
            kinds = {f.name: f.dataType for f in old.schema}
            new = new.select(*[F.col(c).cast(kinds[c]) if c in columns else F.lit(None).cast(kinds[c]).alias(c) for c in old.columns])
            new = self._settled(new)
            self.append(name, new)
            changed, left = new, None
        else:
            old.createOrReplaceTempView(view)
            u = re.match(r"(?is)set\s+(.*?)(?:\s+where\s+(.*))?\Z" if verb == "update" else r"(?is)()(?:where\s+(.*))?\Z", rest)
            if not u:
                raise ValueError(f"no such change: {text!r}")
            hit = f"coalesce(({u[2]}), false)" if u[2] else "true"
            if verb == "delete":
                changed, left = self._settled(ask(f"SELECT * FROM {view} WHERE {hit}")), ask(f"SELECT * FROM {view} WHERE NOT {hit}")
            else:
                put = dict(re.match(r"(?is)\s*`?(\w+)`?\s*=\s*(.+?)\s*\Z", x).groups() for x in _commas(u[1]))
                for c in put:
                    if c not in old.columns:
                        raise ValueError(f"table {name} has no column {c}")
                kinds = {f.name: f.dataType.simpleString() for f in old.schema}
                made = ", ".join(f"CAST({put[c]} AS {kinds[c]}) AS `{c}`" if c in put else f"`{c}`" for c in old.columns)
                changed, left = self._settled(ask(f"SELECT {made} FROM {view} WHERE {hit}")), ask(f"SELECT * FROM {view} WHERE NOT {hit}")
                left = left.unionByName(changed)
            self.write(name, left, self._manifest(name)["by"])
            self.spark.catalog.dropTempView(view)
        out = None
        if returning:
            changed.createOrReplaceTempView(view)
            out = ask(f"SELECT {returning} FROM {view}")
        return Changed(changed.count(), out)

    def _settled(self, df: DataFrame) -> DataFrame:
        """df written below the engine's folder, so that what a statement returns is what it stored."""
        path = f"{self.path}/_work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def prepare(self, text: str) -> Statement:
        return Statement(self, text)

    def register_function(self, name: str, f: Callable, returns: str = "string") -> None:
        """A scalar function for SQL; f takes and gives pandas series."""
        self.spark.udf.register(check_identifier(name), F.pandas_udf(f, returns))

    def register_aggregate(self, name: str, f: Callable, returns: str = "double") -> None:
        """An aggregate for SQL; f takes pandas series (annotated) and gives a scalar."""
        self.spark.udf.register(check_identifier(name), F.pandas_udf(f, returns))

    def bulk_insert(self, name: str, rows: list[dict] | DataFrame) -> int:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows)
        n = df.count()
        self.append(name, df)
        return n

    def insert_batches(self, batches: Iterator[DataFrame], collection: str = "default", now: int = 0, progress: Callable[[int, int], None] | None = None) -> int:
        """Upsert batch after batch; progress(batches, documents) is told after each. Returns the documents rejected."""
        documents = rejected = 0
        for i, df in enumerate(batches, 1):
            _, bad = self.upsert_documents(df, collection, now)
            documents, rejected = documents + df.count(), rejected + bad.count()
            if progress is not None:
                progress(i, documents)
        return rejected

    # collections and documents

    def create_collection(self, name: str, config: dict | None = None, provider: str | None = None, dimensions: int = 384, now: int = 0) -> None:
        check_name(name)
        if self.collection_exists(name):
            raise ValueError(f"collection {name} exists")
        row = (name, now, now, SCHEMA_VERSION, json.dumps(config or {"vectorDim": dimensions, "metric": "cosine"}), provider, dimensions, "enabled" if provider else "pending", "idle")
        self.append("collections", self.spark.createDataFrame([row], COLLECTIONS))

    def collection_exists(self, name: str) -> bool:
        return not self.table("collections").where(F.col("name") == name).isEmpty()

    def collection_info(self) -> DataFrame:
        counts = self.table("documents").groupBy("collection").agg(F.count(F.lit(1)).alias("documents"))
        c = self.table("collections")
        return c.join(counts, c.name == counts.collection, "left").drop("collection").fillna(0, ["documents"])

    def schema_version(self) -> int:
        return self.table("collections").agg(F.max("schema_version")).first()[0] or 0

    def upsert_documents(self, docs: DataFrame, collection: str = "default", now: int = 0) -> tuple[DataFrame, DataFrame]:
        """Insert or replace documents (id, title, content, metadata; collection wins over the argument). The last
        row of a key stays. Returns (documents, rejected rows with their errors). Metadata stays byte for byte."""
        have = {c: F.col(c) if c in docs.columns else F.lit(None).cast("string") for c in ("id", "title", "content", "collection", "metadata")}
        rows = docs.select(
            have["id"].cast("string").alias("id"), have["title"].cast("string").alias("title"), have["content"].cast("string").alias("content"),
            F.coalesce(have["collection"], F.lit(collection)).alias("collection"), have["metadata"].cast("string").alias("metadata"),
        )
        rows = rows.withColumn("errors", errors())
        known = self.table("collections").select(F.col("name").alias("collection"))
        rejected = rows.where(F.size("errors") > 0).unionByName(rows.where(F.size("errors") == 0).join(known, "collection", "left_anti").withColumn("errors", F.array(F.lit("unknown collection"))).select(*rows.columns))
        # the order of rows is that of the input: numbered before any join
        good = rows.withColumn("__at", F.monotonically_increasing_id()).where(F.size("errors") == 0).drop("errors").join(F.broadcast(known), "collection", "left_semi")
        good = good.withColumn("id", F.coalesce(F.trim("id"), F.concat(F.lit("doc_"), F.sha2(F.concat_ws("\0", "collection", "title", "content"), 256))))
        last = good.withColumn("__n", F.row_number().over(Window.partitionBy("collection", "id").orderBy(F.desc("__at")))).where("__n = 1").drop("__n", "__at")
        last = self._settled(last.withColumn("rowid", F.xxhash64("collection", "id")))
        key = ["collection", "id"]
        touched = [r.collection for r in last.select("collection").distinct().collect()]  # collections, not documents
        old = self.table("documents").where(F.col("collection").isin(touched))
        before = self._settled(old.join(last.select(*key), key, "left_semi").select(*key, "rowid", F.col("created_at").alias("__c")))
        new = last.join(before.drop("rowid"), key, "left").select(
            "rowid", "id", "title", "content", "collection", "metadata", F.coalesce("__c", F.lit(now)).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at")
        )
        clash = [r.collection for r in before.select("collection").distinct().collect()]
        self._index_is_current()
        if clash:  # collections with replaced documents are written anew, the others only get a part
            kept = old.where(F.col("collection").isin(clash)).join(before.select(*key), key, "left_anti").select(*old.columns)
            self.replace("documents", kept.unionByName(new.where(F.col("collection").isin(clash))), clash)
            if len(clash) < len(touched):
                self.append("documents", new.where(~F.col("collection").isin(clash)))
        else:
            self.append("documents", new)
        self._reindex(new, before.select("rowid"))
        return self.table("documents"), rejected

    def verify_documents(self, docs: DataFrame, collection: str = "default") -> DataFrame:
        """collection, id, in_documents, in_index of each of docs (id, collection): what an insert has left undone."""
        asked = docs.select(F.coalesce(F.col("collection") if "collection" in docs.columns else F.lit(None).cast("string"), F.lit(collection)).alias("collection"), F.trim("id").alias("id")).distinct()
        have = self.table("documents").select("collection", "id", "rowid", F.lit(True).alias("__d"))
        lengths = self.index().lengths.select("rowid", F.lit(True).alias("__i"))
        out = asked.join(have, ["collection", "id"], "left").join(lengths, "rowid", "left")
        return out.select("collection", "id", F.coalesce("__d", F.lit(False)).alias("in_documents"), F.coalesce("__i", F.lit(False)).alias("in_index"))

    def delete_documents(self, keys: DataFrame) -> int:
        keys = keys.select("collection", "id").distinct()
        touched = [r.collection for r in keys.select("collection").distinct().collect()]
        old = self.table("documents").where(F.col("collection").isin(touched))
        gone = self._settled(old.join(keys, ["collection", "id"], "left_semi").select("rowid"))
        n = gone.count()
        if n:
            self._index_is_current()
            self.write("vectors", self.table("vectors").join(gone, "rowid", "left_anti"))
            self.replace("documents", old.join(keys, ["collection", "id"], "left_anti").select(*old.columns), touched)
            self._reindex(None, gone)
        return n

    # full-text index

    def _index_is_current(self) -> bool:
        """Does the index belong to the documents as they are? Remembered for the change that follows."""
        m = self._manifest("fts_lengths")
        self._current = m is not None and m.get("documents") == self._manifest("documents")["number"]
        return self._current

    def build_index(self) -> text_index.TextIndex:
        """The whole index anew; it is also what compacts it."""
        docs = self._manifest("documents")["number"]
        ix = text_index.build(self.table("documents"), FIELDS)
        self.write("fts_postings", text_index.layout(ix.postings.withColumn("seq", F.lit(0).cast("long")), self.buckets).select(*[x.split()[0] for x in POSTINGS.split(", ")]))
        self.write("fts_terms", text_index.layout(text_index.frequencies(self.table("fts_postings")), self.buckets, False), ["bucket"])
        self.write("fts_dead", self.spark.createDataFrame([], "rowid long, seq long"))
        by_rowid = self.table("documents").select("rowid", "collection")
        self.write("fts_lengths", ix.lengths.join(by_rowid, "rowid").withColumn("seq", F.lit(0).cast("long")), documents=docs, seq=0)
        return self.index()

    def _reindex(self, new: DataFrame | None, replaced: DataFrame) -> None:
        """Bring the index, if it was current, up to a change: new documents (full rows) and rowids that went."""
        if not self._current:
            return
        docs, m = self._manifest("documents")["number"], self._manifest("fts_lengths")
        seq = m["seq"] + 1
        if not replaced.isEmpty():
            dead = self.index().postings.join(F.broadcast(replaced) if replaced.count() <= search.MAX_BROADCAST_ROWS else replaced, "rowid", "left_semi")
            self.append("fts_terms", text_index.layout(text_index.frequencies(dead).withColumn("df", -F.col("df")), self.buckets, False))
            self.append("fts_dead", replaced.select("rowid", F.lit(seq - 1).cast("long").alias("seq")))
        if new is not None:
            ix = text_index.build(new, FIELDS)
            self.append("fts_postings", text_index.layout(ix.postings.withColumn("seq", F.lit(seq).cast("long")), self.buckets))
            self.append("fts_terms", text_index.layout(text_index.frequencies(ix.postings), self.buckets, False))
            lengths = ix.lengths.join(new.select("rowid", "collection"), "rowid").withColumn("seq", F.lit(seq).cast("long"))
        else:
            lengths = self.spark.createDataFrame([], "rowid long, dl long, collection string, seq long")
        self.append("fts_lengths", lengths, documents=docs, seq=seq)

    def index(self) -> text_index.TextIndex:
        """The maintained index, built if it is missing or belongs to other documents."""
        if not self._index_is_current():
            return self.build_index()
        number = self._manifest("fts_lengths")["number"]
        if self._opened is not None and self._opened[0] == number:
            return self._opened[1]
        postings, lengths, dead = self.table("fts_postings"), self.table("fts_lengths"), self.table("fts_dead")
        if not dead.isEmpty():
            last = dead.groupBy("rowid").agg(F.max("seq").alias("__dead"))
            alive = lambda df: df.join(last, "rowid", "left").where(F.col("__dead").isNull() | (F.col("seq") > F.col("__dead"))).drop("__dead")
            postings, lengths = alive(postings), alive(lengths)
        df = self.table("fts_terms").groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df > 0")
        ix = text_index.TextIndex(postings, lengths, FIELDS, df, self.buckets)
        self._opened = (number, ix)
        return ix

    # search

    def search(self, queries: str | DataFrame, collection: str | None = None, vector: list[float] | None = None, limit: int = 10, method: str = "rrf", with_documents: bool = True, **options: Any) -> search.SearchResult:
        """Search by text, vector or both (a DataFrame of query_id, text, vector asks many at once), in a collection
        or all. options are those of operators.search.search: weights, enable_like, operator, metric, prefilter, rrf_k,
        custom, field_weights, threshold. The debug part has the time to plan, the channels and what they used."""
        start = time.perf_counter()
        check_limit(limit)
        single = not isinstance(queries, DataFrame)
        if single:
            row, kind = ([0, queries, vector], "query_id long, text string, vector array<double>") if vector is not None else ([0, queries], "query_id long, text string")
            queries = self.spark.createDataFrame([row], kind)
        ix = self.index() if "text" in queries.columns else None
        restrict = None if collection is None else self.index().lengths.where(F.col("collection") == check_name(collection)).select("rowid")
        docs = self.table("documents")
        docs = docs if collection is None else docs.where(F.col("collection") == collection)
        items = self.table("vectors") if "vector" in queries.columns else None
        found = search.search(docs, ix, items, queries, limit, method, restrict=restrict, **options)
        hits = search.attach(found.hits, docs, limit if single else None) if with_documents else found.hits
        return search.SearchResult(hits, found.debug | {"collection": collection, "planning_ms": round(1000 * (time.perf_counter() - start), 1)})

    def search_text(self, text: str, collection: str | None = None, limit: int = 10, syntax: bool = False, **options: Any) -> search.SearchResult:
        """Text search with substring fusion; with syntax, the full query syntax. A text of no words falls back to
        substring search alone."""
        if syntax:
            hits = search.top(search.fts(self.index(), text, **options), limit, F.col("fts_score"), F.col("rowid"))
            return search.SearchResult(search.attach(hits, self.table("documents"), limit), {"channels": ["fts"], "syntax": True})
        if text_words(text):
            return self.search(text, collection, limit=limit, enable_like=search.like_skip_reason(text) is None, **options)
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        docs = self.table("documents") if collection is None else self.table("documents").where(F.col("collection") == check_name(collection))
        hits = search.like(docs, asked, limit).where(F.col("like_rank") < limit).withColumn("score", 1.0 / (1 + F.col("like_rank")))
        return search.SearchResult(search.attach(hits, docs, 2 * limit), {"channels": ["like"], "fallback": True, "skipped": search.like_skip_reason(text)})

    def search_semantic(self, text: str | list[str], provider: vectors.EmbeddingProvider, limit: int = 10, threshold: float = 0.1, metric: str = "cosine") -> DataFrame:
        """The nearest documents of the texts' embeddings within threshold: query_id, distance, score and the documents."""
        texts = [text] if isinstance(text, str) else text
        provider.initialize()
        asked = self.spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(provider.embed(texts))], "query_id long, vector array<double>")
        near = search.knn(self.table("vectors"), asked, check_limit(limit), metric, threshold).withColumn("score", 1 - F.col("distance"))
        return search.attach(near, self.table("documents"), limit * len(texts))

    def search_global(self, text: str, how: str = "unified_ranking", limit: int = 10, **options: Any) -> DataFrame:
        """One ranking over all collections; options are those of merge_collections."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        hits = search.bm25(self.index(), asked)
        hits = hits.join(self.index().lengths.select("rowid", "collection"), "rowid").select("query_id", "collection", "rowid", (-F.col("fts_score")).alias("score"))
        return search.merge_collections(hits, how, check_limit(limit), **options)

    def search_advanced(self, text: str, filters_: dict | None = None, aggregations: dict | None = None, facets: dict | None = None, limit: int = 20, offset: int = 0) -> dict[str, DataFrame]:
        """Hits (a page), aggregations and facets of a text search under filters."""
        asked = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        hits = search.bm25(self.index(), asked).select("rowid", (-F.col("fts_score")).alias("score"))
        return filters.advanced(self.table("documents"), hits, filters_, aggregations, facets, check_limit(limit), offset)

    def put_vectors(self, rows: DataFrame, dimensions: int | None = None) -> int:
        """Insert or replace vectors; a wrong dimension is refused."""
        if dimensions is not None and not rows.where(~vectors.has_dimension(F.col("embedding"), dimensions)).isEmpty():
            raise ValueError(f"vectors need {dimensions} dimensions")
        new = self._settled(rows.select("rowid", F.col("embedding").cast("array<float>").alias("embedding")))
        n, old = new.count(), self.table("vectors")
        if old.join(new.select("rowid"), "rowid", "left_semi").isEmpty():
            self.append("vectors", new)
        else:
            self.write("vectors", old.join(new.select("rowid"), "rowid", "left_anti").unionByName(new))
        return n

    def embedding_status(self) -> DataFrame:
        """collection, documents, embedded, percent, ready."""
        d = self.table("documents").select("collection", "rowid").join(self.table("vectors").select("rowid", F.lit(1).alias("has")), "rowid", "left")
        g = d.groupBy("collection").agg(F.count(F.lit(1)).alias("documents"), F.count("has").alias("embedded"))
        return g.withColumn("percent", F.round(100 * F.col("embedded") / F.col("documents"))).withColumn("ready", F.col("embedded") == F.col("documents"))

    def regenerate_embeddings(self, provider: vectors.EmbeddingProvider, collection: str | None = None, force: bool = False) -> int:
        d = self.table("documents")
        if collection is not None:
            d = d.where(F.col("collection") == collection)
        if not force:
            d = d.join(self.table("vectors").select("rowid"), "rowid", "left_anti")
        made = vectors.embed(d.select("rowid", F.concat_ws("\n", "title", "content").alias("text")), provider)
        return self.put_vectors(made.where(F.col("embedding").isNotNull()).select("rowid", "embedding"), provider.dimensions)

    # snapshots

    def snapshot(self, path: str, kind: str = "parquet") -> dict:
        """Every table below path, as parquet or json, with a manifest."""
        if kind not in ("parquet", "json"):
            raise ValueError(f"unknown format {kind!r}")
        manifest = {"format": kind, "schema_version": SCHEMA_VERSION, "tables": {}}
        for name in self.tables():
            if name.startswith("fts_"):
                continue  # the index is rebuilt from the documents
            df = self.table(name)
            df.write.mode("overwrite").format(kind).save(f"{path}/{name}")
            manifest["tables"][name] = {"schema": df.schema.json(), "rows": df.count()}
        self.spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/MANIFEST")
        return manifest

    def restore(self, path: str, overwrite: bool = False) -> dict:
        """Tables of a snapshot, after its manifest, version and row counts are checked."""
        manifest = json.loads(self.spark.read.text(f"{path}/MANIFEST").first()[0])
        if manifest.get("schema_version") != SCHEMA_VERSION:
            raise ValueError(f"snapshot of version {manifest.get('schema_version')}; this is {SCHEMA_VERSION}")
        used = [n for n in manifest["tables"] if n in self.tables() and n not in self.BASE or n == "documents" and not self.table(n).isEmpty()]
        if used and not overwrite:
            raise ValueError(f"tables exist: {', '.join(used)}")
        frames = {}
        for name, t in manifest["tables"].items():
            frames[name] = self.spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).format(manifest["format"]).load(f"{path}/{name}")
            if frames[name].count() != t["rows"]:
                raise ValueError(f"table {name} of the snapshot is damaged")
        for name, df in frames.items():
            self.write(name, df)
        return manifest

    def stats(self) -> dict:
        return {"version": SCHEMA_VERSION, "tables": {n: self.table(n).count() for n in self.tables() if not n.startswith("fts_")}}

    def close(self) -> None:
        """Tables are already written; what statements left behind goes."""
        self.fs.delete(self.fs_path(f"{self.path}/_work"), True)
