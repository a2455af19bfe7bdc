"""Tables with keys, defaults, sequences, indexes and transactions, over immutable Parquet folders.

A database is a folder. `log/N.json` is its N-th state: all tables' schemas, data folders, sequences, indexes and
statistics. A commit writes new data folders first, then creates `log/N+1.json` exclusively, so it is atomic over all
tables and the loser of a race gets ConflictError. Data columns are named by column id, so RENAME and DROP COLUMN touch
no data, and ADD COLUMN gives older folders its default on read.

A transaction reads a pinned state through its own changes: changed keys and put rows are folders of their own, written
by each statement. Commit checks what others committed since (their changed keys are kept with the state): the same key
changed (every level), a key read (REPEATABLE READ up), or a key in a scanned range (SNAPSHOT). Inserts then append one
folder; updates and deletes rewrite only the files that hold a changed key, found below the bounds of the changed keys, and
the state names the files of a folder that are gone. New rows meet only rows between their least and greatest key, so
the reader skips the files and row groups of a clustered table that lie elsewhere.

An index lists, for each value of its columns, the data files that hold it; a lookup reads those files alone. An entry of a
file that is gone is skipped. ANALYZE keeps what is needed to tell whether a lookup pays.
"""

from __future__ import annotations

import urllib.parse
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.catalog.store import Store
from tessera.functions import text as fts
from tessera.sql.binder import SPARK
from tessera.sql.errors import ConflictError, ConstraintError, SqlError

#: Commits whose changed keys are named in every state; a transaction that began earlier reads the older states too.
RECENT = 64
LEVELS = ("read uncommitted", "read committed", "repeatable read", "snapshot")
#: Most common tokens or values that ANALYZE keeps of an index.
COMMON = 256


def phys(column: dict) -> str:
    return f"c{column['id']}"


def literal(value, kind: str):
    return F.lit(value).cast(SPARK[kind])


def within(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """Those of `rows` between the least and greatest `key` of `by`: two plain comparisons, which reach the Parquet reader."""
    low, high = by.agg(F.min(key), F.max(key)).first()
    return rows.where(F.lit(False)) if low is None else rows.where((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))


class Table:
    """One table's part of a state: a plain dictionary with helpers."""

    def __init__(self, state: dict):
        self.state = state

    def __getitem__(self, key):
        return self.state[key]

    @property
    def columns(self) -> list[dict]:
        return self.state["columns"]

    @property
    def key(self) -> list[dict]:
        return [c for k in self.state["key"] for c in self.columns if c["id"] == k]

    def column(self, name: str) -> dict:
        for c in self.columns:
            if c["name"] == name:
                return c
        raise SqlError(f"There is no column {name}")

    def types(self) -> dict[str, str]:
        return {c["name"]: c["type"] for c in self.columns}

    def typed(self, column: int) -> str:
        return next(c["type"] for c in self.columns if c["id"] == column)


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    # states
    def version(self) -> int:
        names = [n for n in self.store.names("log") if n.endswith(".json")]
        return int(names[-1].removesuffix(".json")) if names else 0

    def state(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self.store.read(f"log/{version:012d}.json") if version else {"tables": {}, "version": 0, "changes": {}}

    def publish(self, base: dict, tables: dict, changes: dict | None = None, streams: dict | None = None) -> None:
        """The state that follows `base`; its name is taken once, so of two that follow one state the second fails."""
        version = base["version"] + 1
        recent = [*base.get("recent", []), [version, changes or {}]][-RECENT:]
        state = {"tables": tables, "version": version, "changes": changes or {}, "recent": recent, "streams": base.get("streams", {}) | (streams or {})}
        self.store.create(f"log/{version:012d}.json", state)

    def create(self) -> None:
        """An empty database."""
        self.publish(self.state(0), {})

    def changes(self, now: dict, since: int) -> dict[str, list[str]]:
        """Folders of the keys changed after version `since`, by table."""
        known, out = dict(map(tuple, now.get("recent", []))), {}
        for version in range(since + 1, now["version"] + 1):
            for name, path in (known[version] if version in known else self.state(version)["changes"]).items():
                out.setdefault(name, []).append(path)
        return out

    def table(self, name: str, state: dict | None = None) -> Table:
        tables = (state or self.state())["tables"]
        if name not in tables:
            raise SqlError(f"There is no table {name}")
        return Table(tables[name])

    # data
    def write(self, df: DataFrame, table: str) -> str:
        """Physical columns to a new folder; returns its path below the root."""
        name = f"data/{table}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.store.root}/{name}")
        return name

    def read(self, table: Table, folders: list[dict] | None = None, tagged: bool = False) -> DataFrame:
        """Physical columns of the table's folders; columns younger than a folder have their default."""
        groups: dict[tuple, list[str]] = {}
        for f in table["folders"] if folders is None else folders:
            paths = [f["path"]] if not f.get("gone") and "files" not in f else [f"{f['path']}/{n}" for n in self.files(f)]
            groups.setdefault(tuple(f["ids"]), []).extend(f"{self.store.root}/{p}" for p in paths)
        groups = {k: v for k, v in groups.items() if v}
        out = None
        for ids, paths in groups.items():
            schema = ", ".join(f"c{c['id']} {SPARK[c['type']]}" for c in table.columns if c["id"] in ids)
            df = self.spark.read.schema(schema).parquet(*paths)
            if tagged:
                df = df.withColumn("__file", F.col("_metadata.file_path"))
            have = [F.col(phys(c)) if c["id"] in ids else literal(c["default"], c["type"]).alias(phys(c)) for c in table.columns]
            df = df.select(*have, *["__file"] * tagged)
            out = df if out is None else out.unionByName(df)
        if out is None:
            schema = ", ".join(f"{phys(c)} {SPARK[c['type']]}" for c in table.columns) + ", __file STRING" * tagged
            out = self.spark.createDataFrame([], schema)
        return out

    def files(self, folder: dict) -> list[str]:
        """Live data files of a folder; `files`, where a scan has chosen some."""
        names = folder.get("files") or self.store.names(folder["path"])
        return [n for n in names if n not in folder.get("gone", ())]

    # definitions: each is a commit of its own
    def ddl(self, change) -> None:
        state = self.state()
        tables = state["tables"]
        change(tables)
        self.publish(state, tables)

    def create_table(self, name: str, columns: list[dict], key: list[str], options: dict | None = None, quiet: bool = False) -> None:
        def change(tables):
            if name in tables:
                if quiet:
                    return
                raise SqlError(f"There is a table {name} already")
            seen = [c["name"] for c in columns]
            if len(set(seen)) < len(seen):
                raise SqlError("Two columns have one name")
            if any(k not in seen for k in key):
                raise SqlError("PRIMARY KEY names an unknown column")
            if not key:
                raise SqlError("Every table needs a PRIMARY KEY")
            cols = [c | {"id": i, "null": c["null"] and c["name"] not in key} for i, c in enumerate(columns)]
            tables[name] = {
                "columns": cols, "key": [seen.index(k) for k in key], "next_id": len(cols), "folders": [], "sequences": {}, "indexes": {}, "statistics": None, "options": options or {},
            }

        self.ddl(change)

    def drop_table(self, name: str, quiet: bool = False) -> None:
        def change(tables):
            if name not in tables and not quiet:
                raise SqlError(f"There is no table {name}")
            tables.pop(name, None)

        self.ddl(change)

    def add_column(self, table: str, column: dict) -> None:
        def change(tables):
            t = tables[table] if table in tables else self.table(table)
            if any(c["name"] == column["name"] for c in t["columns"]):
                raise SqlError(f"There is a column {column['name']} already")
            if not column["null"] and column["default"] is None and t["folders"]:
                raise SqlError("A NOT NULL column added to a table with rows needs a default")
            t["columns"].append(column | {"id": t["next_id"]})
            t["next_id"] += 1

        self.ddl(change)

    def rename_column(self, table: str, old: str, new: str) -> None:
        def change(tables):
            t = Table(tables[table]) if table in tables else self.table(table)
            if any(c["name"] == new for c in t.columns):
                raise SqlError(f"There is a column {new} already")
            t.column(old)["name"] = new

        self.ddl(change)

    def drop_column(self, table: str, name: str) -> None:
        def change(tables):
            t = Table(tables[table]) if table in tables else self.table(table)
            c = t.column(name)
            if c["id"] in t["key"]:
                raise SqlError(f"{name} belongs to the key and stays")
            if any(c["id"] in i["columns"] for i in t["indexes"].values()):
                raise SqlError(f"{name} belongs to an index and stays")
            t.columns.remove(c)

        self.ddl(change)

    def create_index(self, name: str, table: str, columns: list[str], fulltext: bool = False, tokenizer: str = "simple") -> None:
        """Full-text indexes are posting folders, others folders of values with the files that hold them."""

        def change(tables):
            t = Table(tables[table]) if table in tables else self.table(table)
            if any(name in x["indexes"] for x in tables.values()):
                raise SqlError(f"There is an index {name} already")
            cols = [t.column(c) for c in columns]
            index = {"columns": [c["id"] for c in cols], "fulltext": fulltext, "tokenizer": tokenizer, "segments": []}
            if fulltext:
                if len(cols) != 1 or cols[0]["type"] != "string":
                    raise SqlError("A FULLTEXT index needs exactly one string column")
                fts.tokenizer(tokenizer)
                if t["folders"]:
                    index["segments"].append({"path": self.write(self.index_rows(t, index, self.read(t)), table), "gone": []})
            elif t["folders"]:
                index["segments"].append({"path": self.write_values(t, index, self.read(t, tagged=True)), "gone": []})
            t["indexes"][name] = index

        self.ddl(change)

    def drop_index(self, name: str) -> None:
        def change(tables):
            if not any(t["indexes"].pop(name, None) for t in tables.values()):
                raise SqlError(f"There is no index {name}")

        self.ddl(change)

    def index_rows(self, t: Table, index: dict, rows: DataFrame) -> DataFrame:
        """Postings, sorted by token in each file; nothing is shuffled."""
        key = [phys(c) for c in t.key]
        tokens = rows.select(*key, F.posexplode(fts.tokenizer(index["tokenizer"])[0](F.col(f"c{index['columns'][0]}"))).alias("pos", "token"))
        return tokens.sortWithinPartitions("token", *key)

    def write_values(self, t: Table, index: dict, rows: DataFrame) -> str:
        """A segment of an index: its columns' distinct values with the data file (folder and name), clustered by value."""
        cols = [f"c{i}" for i in index["columns"]]
        pairs = rows.select(*cols, F.regexp_extract("__file", "([^/]+/[^/]+)$", 1).alias("file")).distinct()
        return self.write(pairs.repartitionByRange(*cols).sortWithinPartitions(*cols), "index")

    def lookup(self, t: Table, index: dict, where: str) -> list[dict]:
        """The table's folders, cut down to the files that hold a value for which `where` is true. At most one row for each file is collected."""
        paths = [f"{self.store.root}/{s['path']}" for s in index["segments"]]
        found = {r.file for r in self.spark.read.parquet(*paths).where(where).select("file").distinct().collect()} if paths else set()
        out = []
        for f in t["folders"]:
            last = f["path"].rpartition("/")[2]
            files = [n for n in (x.partition("/")[2] for x in found if x.startswith(f"{last}/")) if n not in f.get("gone", ())]
            if files:
                out.append(f | {"files": sorted(files)})
        return out

    def postings(self, t: Table, index: dict) -> DataFrame | None:
        """Live postings: each segment without the keys changed after it."""
        key, out = [phys(c) for c in t.key], None
        for s in index["segments"]:
            df = self.spark.read.parquet(f"{self.store.root}/{s['path']}")
            if s["gone"]:
                df = df.join(self.spark.read.parquet(*[f"{self.store.root}/{g}" for g in s["gone"]]), key, "left_anti")
            out = df if out is None else out.unionByName(df)
        return out

    def analyze(self, name: str) -> dict:
        """Row count, and for each index its entries, distinct values and most common ones."""
        state = self.state()
        t = self.table(name, state)
        rows = self.read(t)
        stats = {"rows": rows.count(), "indexes": {}}
        for label, index in t["indexes"].items():
            if index["fulltext"]:
                posts = self.postings(t, index)
                counts = posts.select("token", *[phys(c) for c in t.key]).distinct().groupBy("token").count() if posts is not None else None
                value = F.col("token")
            else:
                cols = [f"c{i}" for i in index["columns"]]
                counts = rows.dropna(subset=cols).groupBy(*cols).count()
                value = F.concat_ws("\x1f", *[F.col(c).cast("string") for c in cols])
            if counts is None:
                stats["indexes"][label] = {"entries": 0, "distinct": 0, "common": {}}
                continue
            lead = F.col("token") if index["fulltext"] else F.col(cols[0])
            ends = [f(lead.cast("double") if not index["fulltext"] and t.typed(index["columns"][0]) in ("int", "float", "decimal") else F.lit(None)) for f in (F.min, F.max)]
            total = counts.agg(F.sum("count"), F.count("*"), *ends).first()
            top = counts.select(value.alias("v"), "count").orderBy(F.desc("count"), "v").limit(COMMON).collect()
            stats["indexes"][label] = {"entries": total[0] or 0, "distinct": total[1], "low": total[2], "high": total[3], "common": {r.v: r["count"] for r in top}}
        t.state["statistics"] = stats
        self.publish(state, state["tables"])
        return stats

    def compact(self, name: str) -> None:
        """Many small folders to one, range-clustered by key (so key lookups skip files); postings to one segment."""
        state = self.state()
        t = self.table(name, state)
        key = [phys(c) for c in t.key]
        rows = self.read(t)
        path = self.write(rows.repartitionByRange(*key).sortWithinPartitions(*key), name)
        t.state["folders"] = [{"path": path, "ids": [c["id"] for c in t.columns]}]
        for index in t["indexes"].values():
            if index["fulltext"]:
                index["segments"] = [{"path": self.write(self.index_rows(t, index, self.read(t)), name), "gone": []}]
            else:
                index["segments"] = [{"path": self.write_values(t, index, self.read(t, tagged=True)), "gone": []}]
        self.publish(state, state["tables"])

    def vacuum(self, states: int = 20, seconds: int = 3600) -> int:
        """Delete data and states that none of the last `states` states names and that are older than `seconds`; returns how many folders and files of data.

        The age protects folders of transactions that have not committed yet; a reader of an older state fails.
        """
        now, used, dead = self.version(), set(), {}
        for version in range(max(1, now - states + 1), now + 1):
            state = self.state(version)
            used.update(state["changes"].values())
            used.update(p for _, changes in state.get("recent", []) for p in changes.values())
            for t in state["tables"].values():
                for f in t["folders"]:
                    used.add(f["path"])
                    dead[f["path"]] = dead.get(f["path"], set(f.get("gone", ()))) & set(f.get("gone", ()))
                for index in t["indexes"].values():
                    for segment in index["segments"]:
                        used.update([segment["path"], *segment["gone"]])
        gone = 0
        for table in self.store.names("data"):
            for name, age in self.store.ages(f"data/{table}"):
                if f"data/{table}/{name}" not in used and age >= seconds:
                    self.store.delete(f"data/{table}/{name}")
                    gone += 1
        for folder, names in dead.items():
            ages = dict(self.store.ages(folder)) if names else {}
            for name in names & {n for n, age in ages.items() if age >= seconds}:
                self.store.delete(f"{folder}/{name}")
                gone += 1
        for name, age in self.store.ages("log"):
            if name.endswith(".json") and int(name.removesuffix(".json")) <= now - max(states, RECENT) and age >= seconds:
                self.store.delete(f"log/{name}")
        return gone

    def begin(self, level: str = "snapshot") -> Transaction:
        return Transaction(self, level)


@dataclass
class Pending:
    """A transaction's changes to one table: put rows and changed keys, as folders; None: nothing yet."""

    puts: str | None = None
    keys: str | None = None
    removes: bool = False
    sequences: dict = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)


class Transaction:
    def __init__(self, db: Database, level: str = "snapshot"):
        if level not in LEVELS:
            raise SqlError(f"There is no isolation level {level}")
        self.db, self.level = db, level
        self.base = db.state()
        self.pending: dict[str, Pending] = {}
        self.reads: dict[str, list[tuple]] = {}
        #: stream name and batch id, for a transaction that holds one batch of a stream
        self.batch: tuple[str, int] | None = None
        self.open = True

    def state(self) -> dict:
        if not self.open:
            raise SqlError("The transaction is over")
        # the two lower levels read what is committed now
        return self.db.state() if LEVELS.index(self.level) < 2 else self.base

    def table(self, name: str) -> Table:
        return self.db.table(name, self.state())

    def folder(self, path: str) -> DataFrame:
        return self.db.spark.read.parquet(f"{self.db.store.root}/{path}")

    def physical(self, name: str, tagged: bool = False) -> DataFrame:
        t, p = self.table(name), self.pending.get(name)
        df = self.db.read(t, tagged=tagged)
        if p is None or p.keys is None:
            return df
        key = [phys(c) for c in t.key]
        df = df.join(self.folder(p.keys), key, "left_anti") if p.removes else df
        if p.puts is not None:
            df = df.unionByName(self.folder(p.puts), allowMissingColumns=True)
        return df

    def frame(self, name: str, folders: list[dict] | None = None) -> DataFrame:
        """The table as this transaction sees it, own changes included, under its column names; or some of its files."""
        t = self.table(name)
        df = self.physical(name) if folders is None else self.db.read(t, folders)
        return df.select(*[F.col(phys(c)).alias(c["name"]) for c in t.columns])

    def note_read(self, name: str, low=None, high=None) -> None:
        """A scan of the first key column between bounds (None: open)."""
        self.reads.setdefault(name, []).append((low, high))

    # changes: rows and keys are physical frames
    def change(self, name: str, puts: DataFrame | None, keys: DataFrame, removes: bool) -> None:
        t, p = self.table(name), self.pending.setdefault(name, Pending())
        key = [phys(c) for c in t.key]
        if puts is not None:
            puts = puts.select(*[phys(c) for c in t.columns])
        if p.puts is not None:
            old = self.folder(p.puts)
            old = old.join(keys, key, "left_anti") if removes else old
            puts = old if puts is None else old.unionByName(puts, allowMissingColumns=True)
        if p.keys is not None:
            keys = self.folder(p.keys).unionByName(keys).distinct()
        new_puts = self.db.write(puts, name) if puts is not None else None
        p.keys = self.db.write(keys.select(*key), name)
        p.puts, p.removes, p.ids = new_puts, p.removes or removes, [c["id"] for c in t.columns]

    def next_numbers(self, name: str, column: dict, highest: int | None) -> int:
        """The next number of a sequence, after explicit values up to `highest`."""
        p = self.pending.setdefault(name, Pending())
        k = str(column["id"])
        now = p.sequences.get(k, self.table(name)["sequences"].get(k, 1))
        p.sequences[k] = max(now, (highest or 0) + 1)
        return p.sequences[k]

    def check_rows(self, name: str, rows: DataFrame, others: DataFrame) -> None:
        """NOT NULL and key uniqueness of new rows, among themselves and against `others`."""
        t = self.table(name)
        key = [phys(c) for c in t.key]
        strict = [c for c in t.columns if not c["null"]]
        if strict:
            bad = rows.agg(*[F.max(F.col(phys(c)).isNull()).alias(phys(c)) for c in strict]).first()
            for c in strict:
                if bad[phys(c)]:
                    raise ConstraintError(f"Column {c['name']} must not be NULL")
        twice = rows.groupBy(*key).count().where("count > 1").limit(1).collect()
        again = twice or rows.select(*key).join(within(others.select(*key), rows, key[0]), key, "left_semi").limit(1).collect()
        if again:
            raise ConstraintError(f"The key {[again[0][k] for k in key]} is taken")

    def insert(self, name: str, rows: DataFrame) -> int:
        """Rows with the table's column names, complete and typed."""
        t = self.table(name)
        rows = rows.select(*[F.col(c["name"]).alias(phys(c)) for c in t.columns])
        path = self.db.write(rows, name)
        rows = self.folder(path)
        self.check_rows(name, rows, self.physical(name))
        n = rows.count()
        if n:
            self.change(name, rows, rows.select(*[phys(c) for c in t.key]), False)
        return n

    def delete(self, name: str, where: str | None) -> int:
        t = self.table(name)
        df = self.frame(name).alias(name)
        gone = df if where is None else df.where(F.expr(where))
        keys = gone.select(*[F.col(c["name"]).alias(phys(c)) for c in t.key])
        path = self.db.write(keys, name)
        n = self.folder(path).count()
        if n:
            self.change(name, None, self.folder(path), True)
        return n

    def update(self, name: str, sets: dict[str, str], where: str | None) -> int:
        """sets: column name to SQL text over the old row. A changed key must not meet another row's."""
        t = self.table(name)
        df = self.frame(name).alias(name)
        hit = df if where is None else df.where(F.expr(where))
        old = [F.col(c["name"]).alias(f"old_{phys(c)}") for c in t.key]
        new = [(F.expr(sets[c["name"]]) if c["name"] in sets else F.col(c["name"])).cast(SPARK[c["type"]]).alias(phys(c)) for c in t.columns]
        path = self.db.write(hit.select(*new, *old), name)
        both = self.folder(path)
        n = both.count()
        if not n:
            return 0
        keys = both.select(*[F.col(f"old_{phys(c)}").alias(phys(c)) for c in t.key])
        rows = both.select(*[phys(c) for c in t.columns])
        if any(c["name"] in sets for c in t.key) or any(c["name"] in sets and not c["null"] for c in t.columns):
            rest = within(self.physical(name), rows, phys(t.key[0])).join(keys, [phys(c) for c in t.key], "left_anti")
            self.check_rows(name, rows, rest)
        moved = keys.unionByName(rows.select(*[phys(c) for c in t.key])).distinct()
        self.change(name, rows, moved, True)
        return n

    # the end
    def commit(self) -> None:
        self.state()
        self.open = False
        if not any(p.keys for p in self.pending.values()):
            return
        for _ in range(20):
            now = self.db.state()
            if self.batch and now.get("streams", {}).get(self.batch[0], -1) >= self.batch[1]:
                return
            self.validate(now)
            tables, changes = now["tables"], {}
            for name, p in self.pending.items():
                if p.keys is None:
                    continue
                if name not in tables:
                    raise ConflictError(f"Table {name} was dropped")
                self.apply(name, Table(tables[name]), p)
                changes[name] = p.keys
            try:
                return self.db.publish(now, tables, changes, dict([self.batch]) if self.batch else None)
            except ConflictError:
                continue
        raise ConflictError("Too many concurrent commits")

    def validate(self, now: dict) -> None:
        """One look at all keys that others changed since this began, for each table."""
        for name, paths in self.db.changes(now, self.base["version"]).items():
            p = self.pending.get(name)
            writes, reads = p is not None and p.keys is not None, LEVELS.index(self.level) >= 2 and name in self.reads
            if not writes and not reads:
                continue
            theirs = self.db.spark.read.parquet(*[f"{self.db.store.root}/{path}" for path in paths])
            key = theirs.columns
            if writes and theirs.join(self.folder(p.keys), key, "left_semi").limit(1).collect():
                raise ConflictError(f"Another transaction wrote keys of {name} that this one wrote")
            if reads:
                first = F.col(key[0])
                inside = F.lit(False)
                for low, high in self.reads[name]:
                    inside = inside | ((first >= F.lit(low) if low is not None else F.lit(True)) & (first <= F.lit(high) if high is not None else F.lit(True)))
                hit = theirs.where(inside)
                if self.level == "repeatable read":  # only keys that were there to be read
                    hit = hit.join(within(self.db.read(self.db.table(name, self.base)).select(*key), theirs, key[0]), key, "left_semi")
                if hit.limit(1).collect():
                    raise ConflictError(f"Another transaction wrote keys of {name} that this one read")

    def apply(self, name: str, t: Table, p: Pending) -> None:
        """Fold the changes into the newest state's table: rewrite the files that hold a changed key, add the rows."""
        key = [phys(c) for c in t.key]
        folders, new = t["folders"], []
        if p.removes and folders:
            keys = self.folder(p.keys)
            tagged = within(self.db.read(t, tagged=True), keys, key[0])
            hit: dict[str, list[str]] = {}
            for r in tagged.join(keys, key, "left_semi").select("__file").distinct().collect():  # at most one row for each file
                folder, _, file = r[0].rpartition("/")
                hit.setdefault(folder.rpartition("/")[2], []).append(urllib.parse.unquote(file))
            touched = [f | {"files": hit[f["path"].rpartition("/")[2]]} for f in folders if f["path"].rpartition("/")[2] in hit]
            if touched:
                kept = self.db.read(t, touched).join(keys, key, "left_anti")
                # in ranges of the key again, so that a clustered table stays one
                new.append({"path": self.db.write(kept.repartitionByRange(*key).sortWithinPartitions(*key), name), "ids": [c["id"] for c in t.columns]})
                folders = [self.without(f, hit.get(f["path"].rpartition("/")[2], [])) for f in folders]
        if p.puts is not None:
            new.append({"path": p.puts, "ids": p.ids})
        t.state["folders"] = [f for f in folders if f] + new
        t.state["sequences"] = t["sequences"] | p.sequences
        for index in t["indexes"].values():
            if index["fulltext"]:
                for s in index["segments"]:
                    s["gone"].append(p.keys)
                if p.puts is not None:
                    index["segments"].append({"path": self.db.write(self.db.index_rows(t, index, self.folder(p.puts)), name), "gone": []})
            elif new:
                index["segments"].append({"path": self.db.write_values(t, index, self.db.read(t, new, tagged=True)), "gone": []})

    def without(self, folder: dict, files: list[str]) -> dict | None:
        """A folder less some of its files; None if no file is left."""
        if not files:
            return folder
        gone = sorted({*folder.get("gone", ()), *files})
        return folder | {"gone": gone} if set(self.db.store.names(folder["path"])) - set(gone) else None

    def rollback(self) -> None:
        self.open = False
        self.pending.clear()
