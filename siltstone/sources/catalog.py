"""Collections: versioned sets of parquet files with a manifest for each commit.

``<root>/<collection>/commits/<n>.json`` names the data files of version n, their number of rows, indexes, retention and
rollup paths; readers use the newest and keep the version they opened. A commit is the exclusive creation of the next file.
Inserts add files. Deletes and updates find the files that hold matching rows and rewrite only those; the others are kept by
reference. Documents are rows of system columns and a VARIANT with the rest.
"""

from __future__ import annotations

import datetime
import json
import secrets
import threading
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone import errors as E
from siltstone import messages as M
from siltstone.functions.paths import EPSILON, Frame, Schemaless, is_number
from siltstone.limits import MAX_BULK_DOCUMENTS, MAX_DOCUMENT_BYTES, PROFILE_ROWS, ROLLUP_CARDINALITY
from siltstone.operators import rollup as R
from siltstone.operators.filters import All, Test, parse, paths_of
from siltstone.operators.mutations import cutoff, hit, parse_set
from siltstone.sources.files import Files

SYSTEM = ("_id", "_rev", "_created_at", "_updated_at", "_received_at")
DOCUMENT = T.StructType([T.StructField(n, T.LongType() if n == "_rev" else T.StringType()) for n in SYSTEM] + [T.StructField("doc", T.VariantType())])
#: Files of a collection above which an insert puts the small ones together.
MANY_FILES = 64
SMALL_FILE_ROWS = 100_000
#: Files that a rollup's tables may hold beside those of the version, before they are written anew.
MANY_DEAD = 1_000


def now_text() -> str:
    """The present instant as text."""
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="microseconds")


class _Ids:
    """Version-7 ids that rise, also within a millisecond."""

    def __init__(self):
        self._last, self._lock = 0, threading.Lock()

    def next(self) -> str:
        with self._lock:
            self._last = max(self._last + 1, (time.time_ns() // 1_000_000) << 12)
            high, low = self._last >> 12, self._last & 0xFFF
        return str(uuid.UUID(int=high << 80 | 7 << 76 | low << 64 | 2 << 62 | secrets.randbits(62)))


_IDS = _Ids()


def id_millis(doc_id: str) -> int | None:
    """The millisecond of a version-7 id; None for other text."""
    try:
        return uuid.UUID(doc_id).int >> 80
    except ValueError:
        return None


def generated_ids(now_ms: int) -> Column:
    """Version-7 ids for the rows of a DataFrame, in the order of its partitions and rows; one salt for a commit."""
    place = F.monotonically_increasing_id()
    head = f"{now_ms:012x}"
    high = F.lpad(F.lower(F.hex(F.shiftright(place, 48).bitwiseAND(F.lit(0x3FFF)).bitwiseOR(F.lit(0x8000)))), 4, "0")
    low = F.lpad(F.lower(F.hex(place.bitwiseAND(F.lit((1 << 48) - 1)))), 12, "0")
    return F.concat(F.lit(f"{head[:8]}-{head[8:]}-7{secrets.randbits(12):03x}-"), high, F.lit("-"), low)


@dataclass(frozen=True)
class Manifest:
    """One version of a collection."""

    name: str
    created_at: str
    version: int = 0
    files: dict[str, int] = field(default_factory=dict)
    indexes: list[dict] = field(default_factory=list)
    layout: list[str] = field(default_factory=list)
    ttl: dict | None = None
    streams: dict[str, int] = field(default_factory=dict)
    #: The smallest and largest ``_id`` of each file.
    spans: dict[str, list[str]] = field(default_factory=dict)
    #: Paths whose joint counts are kept for each file, the tables that hold them and their rows, and files that are in these
    #: tables but not in the version any more.
    rollup: list[str] = field(default_factory=list)
    rollup_parts: dict[str, int] = field(default_factory=dict)
    rollup_dead: list[str] = field(default_factory=list)
    #: Whether categorical paths have been looked for.
    profiled: bool = False

    @property
    def rows(self) -> int:
        return sum(self.files.values())


@dataclass
class Accelerator:
    """How rollups are kept: of ``fields``, or, without, of the categorical paths found once a collection has ``sample_rows``
    rows; of paths with less than ``max_cardinality`` values."""

    enabled: bool = True
    fields: list[str] = field(default_factory=list)
    max_cardinality: int = ROLLUP_CARDINALITY
    sample_rows: int = PROFILE_ROWS


@dataclass
class Written:
    """New files: their rows, the bounds of their ids, and the table of their joint counts with its rows."""

    files: dict[str, int] = field(default_factory=dict)
    spans: dict[str, list[str]] = field(default_factory=dict)
    parts: dict[str, int] = field(default_factory=dict)


def _folder(name: str) -> str:
    """A folder's name for any collection name."""
    return "".join(c if c.isascii() and (c.isalnum() or c == "-") else f"_{ord(c):x}_" for c in name)


def check_collection_name(name: object) -> None:
    """Raises InvalidDocument for what can't name a collection."""
    if not isinstance(name, str) or not name:
        raise E.InvalidDocument(M.NAME_EMPTY)
    if name.startswith("_"):
        raise E.InvalidDocument(M.NAME_UNDERSCORE)
    if not all(c.isalnum() or c in "_-.#$" for c in name):
        raise E.InvalidDocument(M.NAME_CHARACTERS)


def merge_patch(target: object, patch: object) -> object:
    """``target`` with a JSON merge patch. A new member is taken as it is, nulls inside included."""
    if not isinstance(target, dict) or not isinstance(patch, dict):
        return patch
    out = dict(target)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def set_path(document: dict, path: str, value: object) -> None:
    """Sets a dotted path; missing objects on the way are made and other values there replaced."""
    *way, last = path.split(".")
    if len(way) >= 20:
        return
    for name in way:
        if not isinstance(document.get(name), dict):
            document[name] = {}
        document = document[name]
    document[last] = value


def _size(document: dict) -> int:
    return len(json.dumps(document, ensure_ascii=False, separators=(",", ":")).encode())


class Collection:
    """One collection at its newest version; every method is one transaction."""

    def __init__(self, spark: SparkSession, files: Files, root: str, name: str, accelerator: Accelerator | None = None):
        self.spark, self.name = spark, name
        self._files, self._root = files, f"{root}/{_folder(name)}"
        self._lock = threading.RLock()
        self.accelerator = accelerator or Accelerator()
        self._columns: tuple[int, list[dict]] = (-1, [])

    # Versions

    def manifest(self) -> Manifest:
        """The newest version; raises CollectionNotFound."""
        commits = [c for c in self._files.names(f"{self._root}/commits") if c.endswith(".json")]
        if not commits:
            raise E.CollectionNotFound(self.name)
        return Manifest(**json.loads(self._files.read(f"{self._root}/commits/{commits[-1]}")))

    def commit(self, manifest: Manifest) -> Manifest:
        """Makes ``manifest`` the version after the one it was made from; raises DocumentConflict if another is."""
        made = replace(manifest, version=manifest.version + 1)
        if self._files.broken:
            raise E.StoragePoisoned(self._files.broken)
        if not self._files.create(f"{self._root}/commits/{made.version:020d}.json", json.dumps(asdict(made))):
            raise E.DocumentConflict(f"{self.name} was changed at the same time")
        return made

    def drop(self) -> None:
        """Removes all files of the collection, its indexes, retention and rollups with them."""
        self.manifest()
        self._files.remove(self._root)

    # Rows

    def _schema(self, layout: list[str]) -> T.StructType:
        side = [T.StructField(f".ix{i}.{c}", k) for i in range(len(layout)) for c, k in (("s", T.StringType()), ("n", T.DoubleType()))]
        return T.StructType([*DOCUMENT, *side])

    def _read(self, files: list[str], layout: list[str]) -> DataFrame:
        schema = self._schema(layout)
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self._root}/data/{f}" for f in files))

    def frame(self, manifest: Manifest | None = None) -> Frame:
        """The rows of a version; paths go to the system columns or into the document."""
        m = manifest or self.manifest()
        return Frame(self._read(list(m.files), m.layout), "doc")

    def _write(self, df: DataFrame, m: Manifest, few: bool = False) -> Written:
        """Writes rows (system columns and ``doc``) to new files with the side columns of the version's layout.

        Where there is a layout, rows are range-partitioned (but not a ``few``) and sorted by its paths, so that a file's and
        row group's bounds on these paths are narrow. One pass over the new files counts their rows and, where a rollup is kept, the
        combinations of its paths' values in each.
        """
        if self._files.broken:
            raise E.StoragePoisoned(self._files.broken)
        batch, frame = uuid.uuid4().hex, Frame(df, "doc")
        fields = [f if isinstance(f, Schemaless) else None for f in map(frame.field, m.layout)]
        side = [
            c.alias(f".ix{i}.{n}")
            for i, (p, f) in enumerate(zip(m.layout, fields, strict=True))
            for n, c in (("s", f.string if f else frame.field(p).value.cast("string")), ("n", f.number if f else frame.field(p).number))
        ]
        out = df.select(*DOCUMENT.names, *side)
        if m.layout:
            keys = [F.col(f"`.ix{i}.{n}`") for i in range(len(m.layout)) for n in "sn"]
            out = (out if few else out.repartitionByRange(*keys, F.col("_id"))).sortWithinPartitions(*keys, "_id")
        out.write.parquet(f"{self._root}/data/{batch}")
        written = [f"{batch}/{n}" for n in self._files.names(f"{self._root}/data/{batch}") if n.endswith(".parquet")]
        return self._counted(written, m) if written else Written()

    def _counted(self, files: list[str], m: Manifest) -> Written:
        """What a manifest says of files; with the table of their joint counts, if the version keeps a rollup."""
        rows, path, made = self._read(files, []), F.col("_metadata.file_path"), Written()
        name = F.concat_ws("/", F.element_at(F.split(path, "/"), -2), F.element_at(F.split(path, "/"), -1))
        ends = [F.min("_id").alias("a"), F.max("_id").alias("b")]
        if m.rollup:
            part = f"{self._root}/rollups/{uuid.uuid4().hex}"
            built = R.build(Frame(rows.withColumn(".f", name), "doc"), m.rollup, [F.col("`.f`").alias("f")], ends).df
            built.write.parquet(part)
            counts = self.spark.read.schema(built.schema).parquet(part)
            each = counts.groupBy("f").agg(F.sum("n_rows").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("kinds")).collect()
            made.parts = {part.rsplit("/", 1)[1]: sum(r["kinds"] for r in each)} if each else {}
        else:
            each = rows.groupBy(name.alias("f")).agg(F.count(F.lit(1)).alias("n"), *ends).collect()
        made.files = {r["f"]: r["n"] for r in each}
        made.spans = {r["f"]: [r["a"], r["b"]] for r in each}
        return made

    @staticmethod
    def _changed(m: Manifest, made: Written, gone: list[str] = ()) -> Manifest:
        """The version with new files and without others."""
        left = set(gone)
        return replace(
            m,
            files={f: n for f, n in m.files.items() if f not in left} | made.files,
            spans={f: s for f, s in m.spans.items() if f not in left} | made.spans,
            rollup_parts=m.rollup_parts | made.parts,
            rollup_dead=sorted({*m.rollup_dead, *left}) if m.rollup else [],
        )

    def narrowing(self, node, layout: list[str]) -> list[Column]:
        """Conditions on side columns that every match of the filter meets: they reach the scan, where files, row groups and
        pages outside their bounds are skipped. They never change the result."""
        out = []
        for t in [node] if isinstance(node, Test) else node.parts if isinstance(node, All) else ():
            if not isinstance(t, Test) or t.path not in layout:
                continue
            text, number = (F.col(f"`.ix{layout.index(t.path)}.{c}`") for c in "sn")
            v, name = t.operand, {"$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__"}.get(t.op)
            if t.op == "$eq" and isinstance(v, str):
                out.append(text == v)
            elif t.op == "$eq" and is_number(v):
                out.append(number.between(v - 2 * EPSILON, v + 2 * EPSILON))
            elif t.op == "$in" and isinstance(v, list) and v and all(isinstance(x, str) for x in v):
                out.append(text.isin(v))
            elif name and isinstance(v, str):
                out.append(getattr(text, name)(F.lit(v)))
            elif name and is_number(v):
                out.append(getattr(number, name)(F.lit(float(v))))
        return out

    def covered_files(self, node, m: Manifest) -> list[str] | None:
        """The files that hold rows for which the parts of the filter on the rollup's paths are true; None if there is no
        rollup, no such part, or one file only. The rest of the filter is left to the rows."""
        kept = self.rollup(m) if len(m.files) > 1 else None
        tests = [t for t in (node.parts if isinstance(node, All) else [node]) if kept and paths_of(t) and paths_of(t) <= set(kept.paths)]
        if not tests:
            return None
        found = {r["f"] for r in kept.df.filter(hit(kept.frame, All(tuple(tests)))).select("f").distinct().collect()}
        return [f for f in m.files if f in found]

    def narrowed(self, node, manifest: Manifest, files: list[str] | None = None) -> Frame:
        """The rows of a version, or of some of its files, with the conditions of ``narrowing``."""
        frame = self.frame(manifest) if files is None else Frame(self._read(files, manifest.layout), "doc")
        for c in self.narrowing(node, manifest.layout):
            frame = Frame(frame.df.filter(c), "doc")
        return frame

    # Documents

    @staticmethod
    def documents(df: DataFrame) -> list[dict]:
        """The rows of a page as Python documents."""
        rows = df.select(*SYSTEM, F.to_json("doc").alias("doc")).collect()
        return [dict(sorted((json.loads(r["doc"]) | {n: r[n] for n in SYSTEM}).items())) for r in rows]

    def _rows(self, documents: list[dict]) -> DataFrame:
        rows = [(*(d[n] for n in SYSTEM), json.dumps({k: v for k, v in d.items() if k not in SYSTEM}, ensure_ascii=False)) for d in documents]
        df = self.spark.createDataFrame(rows, T.StructType([*DOCUMENT.fields[:-1], T.StructField("doc", T.StringType())]))
        return df.coalesce(1).withColumn("doc", F.parse_json("doc"))

    def insert(self, document: object) -> dict:
        """Adds one document; a client's ``_id`` is replaced."""
        if not isinstance(document, dict):
            raise E.InvalidDocument(M.DOCUMENT_FORM)
        stamped = self._stamp(document)
        if _size(stamped) > MAX_DOCUMENT_BYTES:
            raise E.DocumentTooLarge
        self._append(self._rows([stamped]), few=True)
        return stamped

    def bulk_insert(self, documents: list) -> tuple[int, list[str]]:
        """Adds the valid documents in one commit; their number and the errors of the others."""
        if len(documents) > MAX_BULK_DOCUMENTS:
            raise E.InvalidDocument(M.BULK.format(MAX_BULK_DOCUMENTS))
        self.manifest()
        good, bad = [], []
        for i, d in enumerate(documents):
            if not isinstance(d, dict):
                bad.append(M.BULK_FORM.format(i))
            elif _size(stamped := self._stamp(d)) > MAX_DOCUMENT_BYTES:
                bad.append(M.BULK_SIZE.format(i))
            else:
                good.append(stamped)
        if good:
            self._append(self._rows(good), few=True)
        return len(good), bad

    @staticmethod
    def _stamp(document: dict) -> dict:
        now = now_text()
        return document | {"_id": _IDS.next(), "_rev": 1, "_created_at": now, "_updated_at": now, "_received_at": now}

    def ingest(self, texts: DataFrame, column: str, stream: str | None = None, batch: int = 0) -> tuple[int, int]:
        """Adds a document for each JSON object in a STRING column of any number of rows, in one commit and without passing
        through the driver; the numbers of rows added and refused (null, malformed, no object, too large).

        The commit also notes the ``batch`` of a ``stream``; a batch that was noted already adds nothing.
        """
        if stream is not None and self.manifest().streams.get(stream, -1) >= batch:
            return 0, 0
        seen, now = Observation(), now_text()
        parsed = texts.select(F.col(column).alias("t"), F.try_parse_json(F.col(column)).alias("doc"))
        good = F.coalesce(F.schema_of_variant("doc").startswith("OBJECT") & (F.octet_length("t") <= MAX_DOCUMENT_BYTES), F.lit(False))
        counted = parsed.observe(seen, F.count_if(~good).alias("bad"), F.count_if(good).alias("good"))
        stamps = [F.lit(now).alias(n) for n in SYSTEM[2:]]
        added = counted.filter(good).select(generated_ids(time.time_ns() // 1_000_000).alias("_id"), F.lit(1).cast("bigint").alias("_rev"), *stamps, "doc")
        self._append(added, {} if stream is None else {stream: batch})
        return seen.get["good"], seen.get["bad"]

    def _append(self, rows: DataFrame, streams: dict[str, int] | None = None, few: bool = False) -> None:
        with self._lock:
            m = self._accelerated(self.manifest())
            m = self.commit(replace(self._changed(m, self._write(rows, m, few)), streams=m.streams | (streams or {})))
            if sum(n < SMALL_FILE_ROWS for n in m.files.values()) > MANY_FILES:
                self.compact(m)
            elif len(m.rollup_parts) > MANY_FILES or len(m.rollup_dead) > MANY_DEAD:
                self.commit(self._merged(m))
            if self.accelerator.enabled and not (m.profiled or m.rollup) and m.rows >= self.accelerator.sample_rows:
                self.detect_rollup(self.accelerator.sample_rows, self.accelerator.max_cardinality)

    def _accelerated(self, m: Manifest) -> Manifest:
        """The version with a rollup of the given fields, if there are such and it has none yet."""
        given = self.accelerator.fields if self.accelerator.enabled and not m.profiled else []
        return self._with_rollup(m, given) if given and not m.rollup else m

    def compact(self, manifest: Manifest | None = None) -> None:
        """Puts small files together; where there is a layout, sorted by it."""
        with self._lock:
            m = manifest or self.manifest()
            small = [f for f, n in m.files.items() if n < SMALL_FILE_ROWS]
            if len(small) < 2:
                return
            rows = sum(m.files[f] for f in small)
            df = self._read(small, m.layout).select(*DOCUMENT.names)
            m = self._changed(m, self._write(df if m.layout else df.coalesce(max(1, rows // SMALL_FILE_ROWS)), m), small)
            self.commit(self._merged(m))

    def _merged(self, m: Manifest) -> Manifest:
        """The version with the tables of its rollup in one, without the files that are gone; rows aren't read."""
        if len(m.rollup_parts) <= 1 and not m.rollup_dead:
            return m
        part, kept = uuid.uuid4().hex, self._rollup_table(m)
        kept.coalesce(1 + sum(m.rollup_parts.values()) // 1_000_000).write.parquet(f"{self._root}/rollups/{part}")
        return replace(m, rollup_parts={part: self.spark.read.parquet(f"{self._root}/rollups/{part}").count()}, rollup_dead=[])

    def get(self, doc_id: str) -> dict:
        """The document with an id; raises DocumentNotFound. Files whose ids don't reach to it aren't opened."""
        m = self.manifest()
        files = [f for f in m.files if f not in m.spans or m.spans[f][0] <= doc_id <= m.spans[f][1]]
        found = self.documents(self._read(files, m.layout).filter(F.col("_id") == doc_id).limit(1)) if files else []
        if not found:
            raise E.DocumentNotFound(doc_id)
        return found[0]

    def replace(self, doc_id: str, document: object) -> dict:
        """A new body for a document; a ``_rev`` in it must be the present one."""
        with self._lock:
            old = self.get(doc_id)
            rev = document.get("_rev") if isinstance(document, dict) else None
            if isinstance(rev, int) and not isinstance(rev, bool) and rev >= 0 and rev != old["_rev"]:
                raise E.DocumentConflict(M.REVISION.format(rev, old["_rev"]))
            if not isinstance(document, dict):
                raise E.InvalidDocument(M.DOCUMENT_FORM)
            kept = {n: old[n] for n in ("_id", "_created_at", "_received_at")}
            new = document | kept | {"_rev": old["_rev"] + 1, "_updated_at": now_text()}
            if _size(new) > MAX_DOCUMENT_BYTES:
                raise E.DocumentTooLarge
            self._rewrite(Test("_id", "$eq", doc_id), lambda rest, _: rest.unionByName(self._rows([new])))
            return new

    def patch(self, doc_id: str, patch: object) -> dict:
        """A JSON merge patch of a document."""
        with self._lock:
            merged = merge_patch(self.get(doc_id), patch)
            return self.replace(doc_id, merged)

    def delete(self, doc_id: str) -> None:
        """Removes a document; raises DocumentNotFound."""
        if not self._rewrite(Test("_id", "$eq", doc_id), lambda rest, _: rest):
            raise E.DocumentNotFound(doc_id)

    def delete_by_query(self, filter_spec: object) -> int:
        """Removes all matches in one commit; their number."""
        return self._rewrite(parse(filter_spec), lambda rest, _: rest)

    def update_by_query(self, filter_spec: object, update: object) -> int:
        """``$set`` on all matches in one commit; their number. Objects on a dotted path are made where missing."""
        node, values = parse(filter_spec), parse_set(update)
        for n in (n for n in values if n in SYSTEM and not isinstance(values[n], int if n == "_rev" else str)):
            raise E.InvalidQuery(f"{n} must stay {'a number' if n == '_rev' else 'text'}")
        inside = {p: v for p, v in values.items() if p not in SYSTEM}

        @F.pandas_udf("string")
        def changed(texts):
            def one(text):
                document = json.loads(text)
                for path, v in inside.items():
                    set_path(document, path, v)
                return json.dumps(document, ensure_ascii=False)

            return texts.map(one)

        def change(rest: DataFrame, found: DataFrame) -> DataFrame:
            new = found.withColumn("doc", F.parse_json(changed(F.to_json("doc")))) if inside else found
            stamps = {n: F.lit(values[n]) for n in SYSTEM if n in values} | {"_rev": F.col("_rev") + 1, "_updated_at": F.lit(now_text())}
            return rest.unionByName(new.withColumns(stamps))

        return self._rewrite(node, change)

    def _rewrite(self, node, change) -> int:
        """Rewrites the files that hold matches of ``node`` as ``change(other rows, matches)``; the number of matches."""
        with self._lock:
            m = self.manifest()
            if not m.files:
                return 0
            frame = self.narrowed(node, m, self.covered_files(node, m))
            name = F.col("_metadata.file_name").alias("f")
            hits = {r["f"]: r["n"] for r in frame.df.filter(hit(frame, node)).groupBy(name).agg(F.count(F.lit(1)).alias("n")).collect()}
            if not hits:
                return 0
            old = [f for f in m.files if f.rsplit("/", 1)[1] in hits]
            own = Frame(self._read(old, m.layout).select(*DOCUMENT.names), "doc")
            rows = change(own.df.filter(~hit(own, node)), own.df.filter(hit(own, node)))
            self.commit(self._changed(m, self._write(rows, m), old))
            return sum(hits.values())

    # Indexes, retention and rollups

    def create_index(self, name: str, fields: list[str]) -> dict:
        """An index is a layout: side columns for its paths, and rows sorted by them. The rows are laid out anew at once."""
        if not isinstance(name, str) or not name:
            raise E.InvalidIndex(M.INDEX_EMPTY)
        if not all(c.isalnum() or c in "_-" for c in name):
            raise E.InvalidIndex(M.INDEX_CHARACTERS)
        if not fields:
            raise E.InvalidIndex(M.INDEX_NO_PATH)
        if not all(isinstance(f, str) and f for f in fields):
            raise E.InvalidIndex(M.INDEX_PATH)
        with self._lock:
            m = self.manifest()
            if any(i["name"] == name for i in m.indexes):
                raise E.IndexExists(name)
            if len(fields) == 1 and any(i["fields"][0] == fields[0] for i in m.indexes):
                raise E.IndexExists(f"An index on field '{fields[0]}' already exists")
            made = {"name": name, "collection": self.name, "fields": list(fields), "field": fields[0], "created_at": now_text()}
            self._lay_out(replace(m, indexes=[*m.indexes, made]))
            return made

    def drop_index(self, name: str) -> None:
        """Forgets an index; its side columns go with the next layout."""
        with self._lock:
            m = self.manifest()
            if all(i["name"] != name for i in m.indexes):
                raise E.IndexNotFound(name)
            self._lay_out(replace(m, indexes=[i for i in m.indexes if i["name"] != name]))

    def _lay_out(self, m: Manifest) -> None:
        layout = list(dict.fromkeys(f for i in m.indexes for f in i["fields"] if f not in SYSTEM))
        if layout != m.layout and m.files:
            df, old = self._read(list(m.files), m.layout).select(*DOCUMENT.names), list(m.files)
            m = replace(m, layout=layout, rollup_parts={}, rollup_dead=[])
            m = replace(self._changed(m, self._write(df, m), old), rollup_dead=[])
        self.commit(replace(m, layout=layout))

    def set_ttl(self, days: int, path: str = "_created_at") -> dict:
        """Retention by the text of a path."""
        if not isinstance(days, int) or isinstance(days, bool) or days < 1:
            raise E.InvalidDocument(M.RETENTION)
        made = {"retention_days": days, "field": path, "enabled": True}
        with self._lock:
            self.commit(replace(self.manifest(), ttl=made))
        return made

    def delete_ttl(self) -> None:
        """Ends retention."""
        with self._lock:
            self.commit(replace(self.manifest(), ttl=None))

    def cleanup(self, now: datetime.datetime | None = None) -> int:
        """Removes what retention has run out for; the number of documents."""
        ttl = self.manifest().ttl
        if not ttl or not ttl["enabled"]:
            return 0
        before = cutoff(ttl["retention_days"], now or datetime.datetime.now(datetime.UTC))
        return self._rewrite(Test(ttl["field"], "$lt", before), lambda rest, _: rest)

    def set_rollup(self, paths: list[str]) -> None:
        """The paths whose joint counts are kept with every version; none to keep no rollup."""
        with self._lock:
            self.commit(replace(self._with_rollup(self.manifest(), paths), profiled=True))

    def _with_rollup(self, m: Manifest, paths: list[str]) -> Manifest:
        m = replace(m, rollup=list(paths), rollup_parts={}, rollup_dead=[])
        return replace(m, rollup_parts=self._counted(list(m.files), m).parts) if m.files and paths else m

    def detect_rollup(self, rows: int = PROFILE_ROWS, most: int = ROLLUP_CARDINALITY) -> list[str]:
        """Keeps a rollup of the categorical paths found in the first ``rows`` rows; the paths."""
        frame = self.frame()
        paths = R.scalar_paths(frame, rows)
        chosen = R.choose(R.profile(frame, paths, rows, most)) if paths else []
        self.set_rollup(chosen)
        return chosen

    def _rollup_table(self, m: Manifest) -> DataFrame:
        table = self.spark.read.parquet(*(f"{self._root}/rollups/{p}" for p in m.rollup_parts))
        return table.filter(~F.col("f").isin(m.rollup_dead)) if m.rollup_dead else table

    def rollup(self, manifest: Manifest) -> R.Rollup | None:
        """The rollup of a version: the joint counts of each of its files, written with the commit that added the file. None
        if none is kept, or if it isn't smaller than a tenth of the rows."""
        m = manifest
        if not (m.rollup and m.rollup_parts and self.accelerator.enabled) or sum(m.rollup_parts.values()) > max(1000, m.rows // 10):
            return None
        return R.Rollup(self._rollup_table(m), m.rollup)

    def rollup_columns(self, m: Manifest) -> list[dict]:
        """The rollup's paths with the number of their values and the bytes of all its tables."""
        kept = self.rollup(m)
        if kept is None:
            return []
        if self._columns[0] != m.version:
            counts = kept.df.agg(*(F.count_distinct(F.to_json(F.struct(f"p{i}"))).alias(f"c{i}") for i in range(len(m.rollup)))).first()
            size = sum(self._files.size(f"{self._root}/rollups/{p}") for p in m.rollup_parts)
            self._columns = m.version, [{"field": p, "cardinality": n, "memory_bytes": size // len(m.rollup)} for p, n in zip(m.rollup, counts, strict=True)]
        return self._columns[1]

    def info(self) -> dict:
        """Name, number of documents and indexes."""
        m = self.manifest()
        return {"name": self.name, "created_at": m.created_at, "doc_count": m.rows, "indexes": [i["name"] for i in m.indexes]}

    def storage_info(self) -> dict:
        """The same with bytes, the instants of the oldest and newest id, retention and rollup; no rows are read."""
        m = self.manifest()

        def instant(doc_id):
            ms = id_millis(doc_id) if doc_id else None
            return None if ms is None else datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).isoformat()

        oldest, newest, _ = self.id_range()
        out = {"name": self.name, "doc_count": m.rows, "index_count": len(m.indexes), "indexes": [i["name"] for i in m.indexes]}
        out |= {"oldest_doc": instant(oldest), "newest_doc": instant(newest), "bytes": self._files.size(f"{self._root}/data")}
        out |= {"ttl": m.ttl} if m.ttl else {}
        if columns := self.rollup_columns(m):
            out["scan_accelerator"] = {"total_positions": m.rows, "bitmap_columns": columns}
        return out

    def id_range(self) -> tuple[str | None, str | None, int]:
        """The smallest and largest ``_id`` and the number of documents, from the manifest alone."""
        m = self.manifest()
        return min((s[0] for s in m.spans.values()), default=None), max((s[1] for s in m.spans.values()), default=None), m.rows

    def vacuum(self) -> int:
        """Deletes data folders and rollups that the newest version doesn't use, and older commits; the number removed."""
        with self._lock:
            m, gone = self.manifest(), 0
            used = {f.split("/", 1)[0] for f in m.files}
            for sub, keep in (("data", used), ("rollups", set(m.rollup_parts)), ("commits", {f"{m.version:020d}.json"})):
                for n in self._files.names(f"{self._root}/{sub}"):
                    if n not in keep:
                        gone += self._files.remove(f"{self._root}/{sub}/{n}")
            return gone


class Catalog:
    """The collections under a folder."""

    def __init__(self, spark: SparkSession, root: str, accelerator: Accelerator | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.accelerator = accelerator or Accelerator()
        self._files, self._open, self._lock = Files(spark, root), {}, threading.Lock()

    def collection(self, name: str) -> Collection:
        """A collection by name; raises CollectionNotFound."""
        with self._lock:
            c = self._open.setdefault(name, Collection(self.spark, self._files, self.root, name, self.accelerator))
        c.manifest()
        return c

    def create(self, name: str) -> dict:
        """Makes an empty collection."""
        check_collection_name(name)
        c = Collection(self.spark, self._files, self.root, name, self.accelerator)
        try:
            c.manifest()
        except E.CollectionNotFound:
            c.commit(Manifest(name, now_text()))
            return c.info()
        raise E.CollectionExists(name)

    @property
    def broken(self) -> str:
        """Why the storage takes no more writes; empty while it does."""
        return self._files.broken

    def names(self) -> list[str]:
        """The names of all collections, sorted."""
        found = []
        for folder in self._files.names(self.root):
            commits = [c for c in self._files.names(f"{self.root}/{folder}/commits") if c.endswith(".json")]
            if commits:
                found.append(json.loads(self._files.read(f"{self.root}/{folder}/commits/{commits[-1]}"))["name"])
        return sorted(found)

    def drop(self, name: str) -> None:
        """Removes a collection."""
        self.collection(name).drop()
        with self._lock:
            self._open.pop(name, None)
