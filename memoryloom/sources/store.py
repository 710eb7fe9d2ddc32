"""The store: logs of note versions, decisions, file symbols and index rows, changed by commits, read by snapshots."""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..operators import bm25
from ..schema import FILE_SYMBOLS, MEMORIES, MEMORY_TYPES
from .checkpoints import staged

DECISIONS = "user_id string, candidate_id string, action string, decided_on string"


def newest_first() -> tuple[Column, ...]:
    return F.desc("created_at"), F.asc("id")


def last_version(log: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that was written last (last writer wins)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


#: A note's key. Rows are sorted by it: id first, as it tells more rows apart at once than the user does.
NOTE_KEY = ["id", "user_id"]


def last_notes(versions: DataFrame) -> DataFrame:
    return last_version(versions, NOTE_KEY, [F.desc("version"), F.desc("superseded"), *newest_first()])


def active(memories: DataFrame) -> DataFrame:
    return memories.filter(~F.col("superseded"))


def by_user(memories: DataFrame, user: str, include_superseded: bool = False) -> DataFrame:
    rows = memories.filter(F.col("user_id") == user)
    return (rows if include_superseded else active(rows)).orderBy(*newest_first())


def by_type(memories: DataFrame, user: str, memory_type: str, limit: int | None = None) -> DataFrame:
    rows = by_user(memories, user).filter(F.col("memory_type") == memory_type)
    return rows if limit is None else rows.limit(limit)


def recent(memories: DataFrame, n: int) -> DataFrame:
    """The newest n active notes of every user."""
    w = Window.partitionBy("user_id").orderBy(*newest_first())
    return active(memories).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def decoded(rows: DataFrame, schema: str = MEMORIES) -> DataFrame:
    """rows in the table's schema: missing columns are added, unknown memory types become records, flags default."""
    spark = rows.sparkSession
    want = StructType.fromDDL(schema)
    rows = spark.createDataFrame([], want).unionByName(rows, allowMissingColumns=True).select(*want.names)
    if "memory_type" in want.names:
        kind = F.when(F.col("memory_type").isin(*MEMORY_TYPES), F.col("memory_type")).otherwise("record")
        rows = rows.withColumns({"memory_type": kind, "superseded": F.coalesce("superseded", F.lit(False)), "version": F.coalesce("version", F.lit(1))})
    return rows


#: The tables of a store. Those of the index hold signed rows: what a note had is taken back when it changes.
TABLES = {
    "memories": MEMORIES,
    "decisions": DECISIONS,
    "file_symbols": FILE_SYMBOLS,
    "index_docs": "user_id string, id string, memory_type string, created_at timestamp, embedding array<float>, sign int",
    "index_postings": "user_id string, term string, id string, tf long, dl int, sign int",
    "index_terms": "user_id string, term string, df long",
    "index_counts": "user_id string, df long, terms long",
    "index_users": "user_id string, n long, tokens long",
}
#: Parts by hash of the user (of user and term for terms and postings): readers of some users skip the others' files.
BUCKETS = 16


def bucket(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("bucket")


def _part(name: str) -> Column:
    return bucket("user_id", "term") if name in ("index_postings", "index_terms") else bucket("user_id")


class Snapshot:
    """The tables as of one version: a fixed list of folders each, whatever is written meanwhile."""

    def __init__(self, spark: SparkSession, path: str, version: int, folders: dict[str, list[str]]) -> None:
        self.spark, self.path, self.version, self.folders = spark, path, version, folders

    def log(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """All rows of a table; with keys (user_id and, for terms and postings, term) theirs alone: where keys are few, the
        other buckets aren't read."""
        schema = StructType.fromDDL(TABLES[name])
        found = self.folders.get(name, [])
        if not found:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema.add("bucket", "integer")).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{f}" for f in found])
        if keys is not None:
            on = [c for c in ("user_id", "term") if c in keys.columns]
            rows = rows.join(keys.select(*on, _part(name)), [*on, "bucket"], "left_semi")
        return rows.select(*[c for c in schema.names if c != "bucket"])

    def memories(self, users: DataFrame | None = None) -> DataFrame:
        return last_notes(decoded(self.log("memories", users)))

    def file_symbols(self, users: DataFrame | None = None) -> DataFrame:
        return last_version(self.log("file_symbols", users), ["user_id", "file"], [F.desc("updated_at"), F.desc(F.xxhash64("symbols"))])

    def decided(self, users: DataFrame | None = None) -> DataFrame:
        """The candidates that a decision was made on, whatever it was."""
        return self.log("decisions", users).select("user_id", "candidate_id").distinct()

    def index(self, users: DataFrame | None = None) -> bm25.Index:
        """The stored index (of some users): signed rows added up. Notes' texts aren't read."""
        docs = self.log("index_docs", users)
        docs = docs.groupBy("user_id", "id", "memory_type", "created_at", "embedding").agg(F.sum("sign").alias("_sign")).filter("_sign > 0").drop("_sign")
        counts = self.log("index_counts", users).groupBy("user_id", "df").agg(F.sum("terms").alias("terms")).filter("terms > 0")
        totals = self.log("index_users", users).groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).filter("n > 0")

        def postings(asked: DataFrame) -> DataFrame:
            rows = self.log("index_postings", asked).groupBy("user_id", "term", "id", "tf", "dl").agg(F.sum("sign").alias("_sign"))
            return rows.filter("_sign > 0").drop("_sign")

        def frequencies(asked: DataFrame) -> DataFrame:
            return self.log("index_terms", asked).groupBy("user_id", "term").agg(F.sum("df").alias("df")).filter("df > 0")

        return bm25.Index(docs, totals, counts, postings, frequencies)


class Change:
    """Writes to several tables that become visible together. before: what the store held when the change began.

    made tells after the end whether the change was committed; it is not if another writer came first.
    """

    def __init__(self, store: Store) -> None:
        self.store, self.before, self.added, self.replaced, self.made = store, store.snapshot(), {}, set(), False

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.made = self.store._commit(self)

    def write(self, name: str, rows: DataFrame) -> None:
        folder = f"{name}/commit={uuid.uuid4().hex}"
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TABLES[name])]).withColumn("bucket", _part(name))
        # a user's rows of a bucket are one file while they are few, and are split over tasks where they are many
        out.hint("rebalance", F.col("bucket"), F.col("user_id")).sortWithinPartitions("bucket", "user_id").write.partitionBy("bucket").parquet(f"{self.store.path}/{folder}")
        self.added.setdefault(name, []).append(folder)

    def write_memories(self, rows: DataFrame) -> None:
        """Add versions of notes and bring the index up to them. Versions that the log holds are left out, so that replays
        add nothing. The index is brought up from what was written, as read back; notes whose last version stays cost it
        nothing."""
        keys = [*NOTE_KEY, "version", "superseded"]
        rows, users = decoded(rows), None
        if self.before.folders.get("memories"):
            rows = staged(rows, "versions")
            users = rows.select("user_id").distinct()
            # merged: a log's keys take far more memory than their files tell the planner
            rows = rows.join(self.before.log("memories", users).select(*keys).hint("merge"), keys, "left_anti")
        self.write("memories", rows)
        new = Snapshot(self.store.spark, self.store.path, 0, {"memories": self.added["memories"][-1:]}).log("memories")
        if new.isEmpty():
            self.added["memories"].pop()
            return
        changes = index_changes(None if users is None else self.before.memories(users), last_notes(new), self.before)
        with ThreadPoolExecutor(len(changes)) as pool:  # small jobs: side by side
            list(pool.map(self.write, changes, changes.values()))

    def write_decisions(self, decisions: DataFrame) -> None:
        self.write("decisions", decisions.filter("candidate_id is not null"))

    def write_file_symbols(self, rows: DataFrame) -> None:
        self.write("file_symbols", rows)


def index_changes(old: DataFrame | None, new: DataFrame, before: Snapshot) -> dict[str, DataFrame]:
    """The index tables' signed rows for notes whose last version was one of old, if any, and is one of new if that comes
    later (columns of memories): where it doesn't, nothing changes."""
    columns = ["memory_type", "created_at", "embedding", "content"]
    note = F.struct("version", "superseded", *columns)
    rows = new.select(*NOTE_KEY, note.alias("_new"))
    signed = [F.struct(F.lit(1).alias("sign"), F.col("_new").alias("r"))]
    if old is not None:
        rows = rows.join(old.select(*NOTE_KEY, note.alias("_old")).hint("merge"), NOTE_KEY, "left")
        rows = rows.filter(F.col("_old").isNull() | (F.struct("_new.version", "_new.superseded") > F.struct("_old.version", "_old.superseded")))
        signed.append(F.struct(F.lit(-1).alias("sign"), F.col("_old").alias("r")))
    both = rows.select("user_id", "id", F.inline(F.array(*signed))).filter("not r.superseded").select("user_id", "id", *[f"r.{c}" for c in columns], "sign")
    bags = bm25.token_bags(both, "user_id", "id", "content", *columns[:3], "sign")
    postings = bags.select("user_id", "id", "dl", "sign", F.inline("bag"))
    terms = staged(postings.groupBy("user_id", "term").agg(F.sum("sign").alias("df")).filter("df <> 0"), "terms")
    was = before.index().frequencies(terms.select("user_id", "term")).withColumnRenamed("df", "_was")
    moved = terms.join(was, ["user_id", "term"], "left").fillna(0, ["_was"])
    steps = F.explode(F.array(F.struct(F.col("_was").alias("df"), F.lit(-1).alias("terms")), F.struct((F.col("_was") + F.col("df")).alias("df"), F.lit(1).alias("terms"))))
    counts = moved.select("user_id", steps.alias("s")).select("user_id", "s.*").filter("df > 0").groupBy("user_id", "df").agg(F.sum("terms").alias("terms")).filter("terms <> 0")
    users = bags.groupBy("user_id").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("dl")).alias("tokens"))
    return {"index_docs": bags.drop("bag", "dl"), "index_postings": postings, "index_terms": terms, "index_counts": counts, "index_users": users}


class Store:
    """Tables under a path, as lists of Parquet folders that numbered manifests name.

    A change writes new folders and then one manifest, the next number, by a rename that fails if that number is taken: so
    readers see all of it or nothing, a writer that dies leaves folders that no manifest names, and of two writers that
    began alike one is told to begin anew. The rename is as atomic as the file system's.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def _hadoop(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs

    def _files(self):
        p = self._hadoop.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit; 0 if there is none."""
        files, at = self._files(), self._hadoop.Path(f"{self.path}/_commits")
        names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self.version() if version is None else version
        text = "{}"
        if version:
            text = self.spark.read.option("wholetext", "true").text(f"{self.path}/_commits/{version:012d}.json").first()[0]
        return Snapshot(self.spark, self.path, version, json.loads(text))

    def change(self) -> Change:
        return Change(self)

    def _commit(self, change: Change) -> bool:
        tables = {n: [*([] if n in change.replaced else change.before.folders.get(n, [])), *change.added.get(n, [])] for n in TABLES}
        sc, fs = self.spark.sparkContext, self._hadoop
        files, folder = self._files(), fs.Path(f"{self.path}/_commits")
        files.mkdirs(folder)
        ready = fs.Path(folder, f".{uuid.uuid4().hex}")
        out = files.create(ready, False)
        out.write(json.dumps(tables).encode())
        out.close()
        names = getattr(fs, "Options$Rename")
        never = sc._gateway.new_array(names, 1)
        never[0] = names.valueOf("NONE")
        context = fs.FileContext.getFileContext(folder.toUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(ready, fs.Path(folder, f"{change.before.version + 1:012d}.json"), never)
        except Py4JJavaError as e:
            files.delete(ready, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def memories(self, users: DataFrame | None = None) -> DataFrame:
        return self.snapshot().memories(users)

    def file_symbols(self, users: DataFrame | None = None) -> DataFrame:
        return self.snapshot().file_symbols(users)

    def decided(self) -> DataFrame:
        return self.snapshot().decided()

    def index(self, users: DataFrame | None = None) -> bm25.Index:
        return self.snapshot().index(users)

    def count(self) -> int:
        return self.memories().count()

    def _alone(self, write) -> None:
        """write(change) in a change of its own, begun anew while other writers come first."""
        while True:
            with self.change() as change:
                write(change)
            if change.made:
                return

    def write_memories(self, rows: DataFrame) -> None:
        self._alone(lambda c: c.write_memories(rows))

    def write_decisions(self, decisions: DataFrame) -> None:
        self._alone(lambda c: c.write_decisions(decisions))

    def write_file_symbols(self, rows: DataFrame) -> None:
        self._alone(lambda c: c.write_file_symbols(rows))

    def compact(self, *names: str) -> None:
        """Rewrite tables (all by default) to what they say now: last versions, and index rows that don't cancel out.
        Readers of older versions keep their folders, which vacuum() deletes."""

        def write(change: Change) -> None:
            now, index = change.before, change.before.index()
            views = {
                "memories": now.memories, "file_symbols": now.file_symbols, "decisions": lambda: now.log("decisions").distinct(),
                "index_docs": lambda: index.docs.withColumn("sign", F.lit(1)), "index_counts": lambda: index.counts, "index_users": lambda: index.users,
                "index_terms": lambda: now.log("index_terms").groupBy("user_id", "term").agg(F.sum("df").alias("df")).filter("df > 0"),
                "index_postings": lambda: now.log("index_postings").groupBy("user_id", "term", "id", "tf", "dl").agg(F.sum("sign").alias("sign")).filter("sign > 0"),
            }
            for n in names or TABLES:
                if now.folders.get(n):
                    change.write(n, views[n]())
                    change.replaced.add(n)

        self._alone(write)

    def vacuum(self) -> None:
        """Delete folders that the last manifest doesn't name, and older manifests. Not while others read or write."""
        files, now = self._files(), self.snapshot()
        named = {f for folders in now.folders.values() for f in folders}
        for name in TABLES:
            at = self._hadoop.Path(f"{self.path}/{name}")
            for f in files.listStatus(at) if files.exists(at) else []:
                if f"{name}/{f.getPath().getName()}" not in named:
                    files.delete(f.getPath(), True)
        at = self._hadoop.Path(f"{self.path}/_commits")
        for f in files.listStatus(at) if files.exists(at) else []:
            if f.getPath().getName() != f"{now.version:012d}.json":
                files.delete(f.getPath(), False)

    def reset(self) -> None:
        self._files().delete(self._hadoop.Path(self.path), True)


def unnest_symbols(file_symbols: DataFrame) -> DataFrame:
    return file_symbols.select("user_id", "file", "lang", F.explode("symbols").alias("s")).select("user_id", "file", "lang", "s.*")


def nest_symbols(symbols: DataFrame, updated_at: Column) -> DataFrame:
    one = F.struct("name", "kind", "line", "node_type")
    return symbols.groupBy("user_id", "file", "lang").agg(F.array_sort(F.collect_set(one)).alias("symbols")).withColumn("updated_at", updated_at)


def read_transcripts(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Raw rows of JSONL files, lines numbered in order in each file, malformed ones kept for the parser to skip.

    A file is one session, named by the file, unless session says where in a row (a JSON path) its name stands. A file may
    be read in several splits: a line's number is its place in the split and the lines of the splits before, so no task
    holds more than a split.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.jsonl)?$", 1)
    lines = spark.read.text(path).select(name.alias("_name"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_in_split"), F.col("value").alias("raw"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lines.groupBy("_file", "_start").agg(F.count("*").alias("_lines")).select("_file", "_start", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_in_split")) - 1
    numbered = lines.withColumn("_at", inside).join(offsets, ["_file", "_start"]).withColumn("row_pos", (F.col("_at") + F.col("_offset")).cast("int")).filter(F.trim("raw") != "")
    own = F.col("_name") if session is None else F.coalesce(F.when(F.try_parse_json("raw").isNotNull(), F.get_json_object("raw", session)), F.col("_name"))
    named = numbered.withColumn("session_id", own)
    return named.select(F.lit("").alias("user_id"), "session_id", F.col("session_id").alias("request_id"), "row_pos", "raw")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Task files, one JSON object each; unreadable ones are dropped."""
    schema = "instance_id string, repo string, problem_statement string, patch string, _corrupt_record string"
    return spark.read.schema(schema).option("multiLine", "true").json(path).filter("_corrupt_record is null").drop("_corrupt_record")


def write_report(summary: DataFrame, path: str) -> None:
    summary.coalesce(1).write.mode("overwrite").json(path)
