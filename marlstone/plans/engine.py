"""``Engine.sql``: statements of the dialect, run on Spark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .catalog import ROW_ID, Catalog, Index, Table
from .dialect import Parser, Printer, SqlError


class Engine:
    """A database: views of other data, and tables of its own under ``root``."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark = spark
        self.catalog = Catalog(spark, root) if root else None
        self._kinds: dict[tuple[str, str], str | None] = {}
        self._name = uuid.uuid4().hex

    # Queries.
    def kind(self, printed: str, source: str) -> str | None:
        key = (printed, source)
        if key not in self._kinds:
            try:
                frame = self.spark.sql(f"SELECT {printed} AS x{f' FROM {source}' if source else ''}")
                self._kinds[key] = frame.schema[0].dataType.simpleString()
            except AnalysisException:
                self._kinds[key] = None
        return self._kinds[key]

    def sql(self, text: str) -> DataFrame:
        """Run a statement.  A query gives its rows; a change gives one row, ``Affected``."""
        try:
            kind, *args = Parser(text).parse()
            self.register()
            return getattr(self, kind)(text, *args)
        except PySparkException as e:
            raise SqlError(str(e).split("\n")[0], "LOGICAL_PLAN_ERROR") from e

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a query; ``mode`` as Spark's: simple, extended, formatted, cost, codegen."""
        df = self.sql(text)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def translate(self, text: str) -> str:
        """The Spark SQL that a query becomes."""
        kind, tree = Parser(text).parse()
        if kind != "query":
            raise SqlError("only queries have a translation")
        self.register()
        return Printer(self.kind).query(tree)

    def register(self) -> None:
        """Views of the catalog's tables, made anew if it changed or another engine used the session."""
        self._kinds.clear()
        if self.catalog is None:
            return
        owner, version, old = getattr(self.spark, "_marlstone_views", None) or (None, 0, set())
        if (owner, version) == (self._name, self.catalog.version):
            return
        views = {name: self.catalog.read(name) for name in self.catalog.tables} | self.catalog.system_tables()
        for name in old - set(views):
            self.spark.catalog.dropTempView(name)
        for name, frame in views.items():
            frame.createOrReplaceTempView(name)
        self.spark._marlstone_views = (self._name, self.catalog.version, set(views))

    def query(self, text: str, tree: tuple) -> DataFrame:
        """Spark lets a sub-query name columns of the query around it, not of one further out, and
        not from a table in FROM; so the forms of the text are tried in turn."""
        forms = dict.fromkeys(Printer(self.kind, flat=flat, split=split).query(tree) for flat, split in ((False, True), (False, False), (True, True)))
        for k, printed in enumerate(forms):
            try:
                return self.spark.sql(printed)
            except AnalysisException:
                if k + 1 == len(forms):
                    raise
        raise AssertionError

    # Definitions.
    def owned(self) -> Catalog:
        if self.catalog is None:
            raise SqlError("this engine has no root folder for tables")
        return self.catalog

    def done(self, affected: int = 0) -> DataFrame:
        return self.spark.createDataFrame([(affected,)], "Affected int")

    def create_table(self, text: str, name: str, columns: list) -> DataFrame:
        catalog = self.owned()
        if catalog.key(name) in catalog.tables:
            raise SqlError(f"table {name} exists")
        names = [c for c, _, _ in columns]
        if len({c.lower() for c in names}) < len(names):
            raise SqlError("a column name repeats")
        having = lambda rule: [c for c, _, rules in columns if rule in rules]
        table = Table([(c, k) for c, k, _ in columns], having("primary"), having("unique"), having("not_null"), ddl=text.strip())
        catalog.tables[name] = table
        if table.primary:
            catalog.indexes[f"{name}_pkey"] = Index(name, [(c, False) for c in table.primary], True, True)
        catalog.save()
        return self.done()

    def drop_table(self, text: str, name: str) -> DataFrame:
        catalog = self.owned()
        catalog.get(name)
        key = catalog.key(name)
        del catalog.tables[key]
        catalog.indexes = {k: i for k, i in catalog.indexes.items() if i.table != key}
        catalog.save()
        return self.done()

    def create_index(self, text: str, index: str, name: str, keys: list, unique: bool) -> DataFrame:
        catalog = self.owned()
        table, key = catalog.get(name), catalog.key(name)
        if index in catalog.indexes:
            raise SqlError(f"index {index} exists")
        known = {c.lower(): c for c, _ in table.columns}
        if missing := [c for c, _ in keys if c.lower() not in known]:
            raise SqlError(f"no column {missing[0]}")
        found = [(known[c.lower()], bool(desc)) for c, desc in keys]
        if unique:
            self.distinct(catalog.read(name), [c for c, _ in found], index)
        catalog.indexes[index] = Index(key, found, unique)
        if table.paths and catalog.order(name) and next(k for k, i in catalog.indexes.items() if i.table == key and not i.primary) == index:
            self.replace(name, catalog.rows(name), cluster=True)
        else:
            catalog.save()
        return self.done()

    def compact(self, name: str) -> None:
        """Write a table anew, in one folder, clustered by its index: many small INSERTs leave many folders."""
        self.replace(name, self.owned().rows(name), cluster=True)

    def drop_index(self, text: str, index: str) -> DataFrame:
        catalog = self.owned()
        if index not in catalog.indexes:
            raise SqlError(f"no index {index}")
        if catalog.indexes[index].primary:
            raise SqlError("the index of a primary key can't be dropped")
        del catalog.indexes[index]
        catalog.save()
        return self.done()

    # Changes.
    def distinct(self, rows: DataFrame, columns: list[str], rule: str) -> None:
        if not rows.groupBy(*(F.col(f"`{c}`") for c in columns)).count().where("count > 1").isEmpty():
            raise SqlError(f"{rule}: a key repeats")

    def filled(self, name: str, rows: DataFrame) -> None:
        for c in self.owned().get(name).not_null:
            if not rows.where(F.col(f"`{c}`").isNull()).isEmpty():
                raise SqlError(f"{c} can't be NULL")

    def insert(self, text: str, name: str, columns: list[str] | None, values: list | None, query: tuple | None) -> DataFrame:
        catalog = self.owned()
        table, schema = catalog.get(name), catalog.schema(name)
        printer = Printer(self.kind)
        if values is not None:
            source = " UNION ALL ".join(f"SELECT {', '.join(f'{printer.show(e)} AS c{k}' for k, e in enumerate(row))}" for row in values)
        else:
            source = printer.query(query)
        given = columns or [c for c, _ in table.columns]
        rows = self.spark.sql(source)
        at = {c.lower(): k for k, c in enumerate(given)}
        if len(rows.columns) != len(given) or len(at) != len(given) or set(at) - {c.lower() for c, _ in table.columns}:
            raise SqlError("the values don't fit the columns")
        rows = rows.toDF(*(f"c{k}" for k in range(len(given))))
        rows = rows.select(*((F.col(f"c{at[f.name.lower()]}") if f.name.lower() in at else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
        # Written first: the source is read once, and may be the table itself.
        with self.written(name, rows) as path:
            new = self.spark.read.schema(schema).parquet(f"{catalog.root}/{path}")
            self.filled(name, new)
            for rule, keys in catalog.keys_of(name):
                self.distinct(new, keys, rule)
                if table.paths:
                    a, b = new.alias("a"), catalog.read(name).alias("b")
                    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in keys]
                    if not a.join(b, same, "left_semi").isEmpty():
                        raise SqlError(f"{rule}: a key repeats")
            self.switch(name, [*table.paths, path])
        return self.done(new.count())

    @contextmanager
    def written(self, name: str, rows: DataFrame, cluster: bool = False) -> Iterator[str]:
        """A new folder with ``rows``, removed again if what is done with it fails."""
        catalog = self.owned()
        path = catalog.write(name, rows, cluster)
        try:
            yield path
        except BaseException:
            catalog.discard(path)
            raise

    def switch(self, name: str, paths: list[str]) -> None:
        """Make these folders the table, or leave it as it was."""
        catalog = self.owned()
        table = catalog.get(name)
        before, table.paths = table.paths, paths
        try:
            catalog.save()
        except BaseException:
            table.paths = before
            raise

    def matched(self, name: str, sources: list, where: tuple | None, extra: list[tuple] = ()) -> DataFrame:
        """Addresses of the target's rows that meet the condition, with printed extras."""
        catalog = self.owned()
        target = ("table", name, name)
        # The target's view shows addresses for this statement.
        self.spark._marlstone_views = (None, 0, self.spark._marlstone_views[2])
        catalog.rows(name).createOrReplaceTempView(catalog.key(name))
        printer = Printer(self.kind)
        printer.source = ", ".join(map(printer.table, [target, *sources]))
        condition = f" WHERE {printer.condition(where)}" if where is not None else ""
        shown = "".join(f", {printer.show(e)} AS v{k}" for k, e in enumerate(extra))
        return self.spark.sql(f"SELECT `{name}`.`{ROW_ID}`{shown} FROM {printer.source}{condition}")

    def replace(self, name: str, rows: DataFrame, cluster: bool = False) -> None:
        with self.written(name, rows, cluster) as path:
            self.switch(name, [path])

    def delete(self, text: str, name: str, using: list, where: tuple | None) -> DataFrame:
        catalog = self.owned()
        catalog.get(name)
        hits = self.matched(name, using, where).distinct()
        old = catalog.rows(name)
        before = old.count()
        self.replace(name, old.join(hits, ROW_ID, "left_anti").select(*old.columns))
        return self.done(before - catalog.rows(name).count())

    def update(self, text: str, name: str, changes: list, sources: list, where: tuple | None) -> DataFrame:
        catalog = self.owned()
        schema = catalog.schema(name)
        known = {f.name.lower(): f for f in schema}
        if missing := [c for c, _ in changes if c.lower() not in known]:
            raise SqlError(f"no column {missing[0]}")
        hits = self.matched(name, sources, where, [e for _, e in changes])
        if sources and not hits.groupBy(ROW_ID).count().where("count > 1").isEmpty():
            raise SqlError("a target row matches several source rows")
        old = catalog.rows(name)
        joined = old.join(hits.withColumn("__hit", F.lit(True)), ROW_ID, "left")
        new = {known[c.lower()].name: F.col(f"v{k}").cast(known[c.lower()].dataType) for k, (c, _) in enumerate(changes)}
        rows = joined.select(*(F.when(F.col("__hit"), new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in old.columns))
        with self.written(name, rows) as path:
            new_rows = self.spark.read.schema(old.schema).parquet(f"{catalog.root}/{path}")
            self.filled(name, new_rows)
            for rule, keys in catalog.keys_of(name):
                if set(keys) & set(new):
                    self.distinct(new_rows, keys, rule)
            affected = hits.count()
            self.switch(name, [path])
        return self.done(affected)
