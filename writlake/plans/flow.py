"""A relational flow that is a Spark DataFrame plan or one DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from writlake.functions.dialect import DUCKDB, SPARK, Dialect

Expr = Callable[[Dialect], str]


def spread(table: DataFrame) -> DataFrame:
    """A table whose scan has fewer tasks than there are cores (so a small one), dealt out to all of them; others stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.queryExecution().toRdd().getNumPartitions() >= cores else table.repartition(cores)


@dataclass(frozen=True)
class Flow:
    """Steps on a table; expressions are functions of a dialect."""

    spark: Callable[[SparkSession, str], DataFrame]
    duckdb: str

    @staticmethod
    def table(name: str, *columns: str) -> Flow:
        return Flow(lambda s, d: spread(s.read.parquet(f"{d}/{name}.parquet").select(*columns)), f"select {', '.join(columns)} from {name}")

    def _sql(self, head: str, tail: str = "") -> str:
        return f"{head} from ({self.duckdb}) {tail}".rstrip()

    def add(self, **columns: Expr) -> Flow:
        own = [f"{f(SPARK)} as {n}" for n, f in columns.items()]
        return replace(self, spark=lambda s, d: self.spark(s, d).selectExpr("*", *own), duckdb=self._sql("select *, " + ", ".join(f"{f(DUCKDB)} as {n}" for n, f in columns.items())))

    def select(self, *names: str, **columns: Expr) -> Flow:
        own = [*names, *(f"{f(SPARK)} as {n}" for n, f in columns.items())]
        return replace(self, spark=lambda s, d: self.spark(s, d).selectExpr(*own), duckdb=self._sql("select " + ", ".join([*names, *(f"{f(DUCKDB)} as {n}" for n, f in columns.items())])))

    def where(self, test: Expr) -> Flow:
        return replace(self, spark=lambda s, d: self.spark(s, d).where(test(SPARK)), duckdb=self._sql("select *", f"where {test(DUCKDB)}"))

    def places(self, name: str, array: Expr) -> Flow:
        """A row for each place of an array, from 1."""
        # Outer, and then without the nulls: else Spark infers a filter from the array and computes all behind it once more.
        one = f"explode_outer(transform({array(SPARK)}, (v, i) -> i + 1)) as {name}"
        more = lambda s, d: self.spark(s, d).selectExpr("*", one).where(f"{name} is not null")
        return replace(self, spark=more, duckdb=self._sql(f"select *, unnest(range(1, len({array(DUCKDB)}) + 1))::int as {name}"))

    def explode(self, name: str, array: Expr) -> Flow:
        """A row for each element of an array that holds no nulls."""
        one = f"explode_outer({array(SPARK)}) as {name}"
        more = lambda s, d: self.spark(s, d).selectExpr("*", one).where(f"{name} is not null")
        return replace(self, spark=more, duckdb=self._sql(f"select *, unnest({array(DUCKDB)}) as {name}"))

    def add_some(self, name: str, value: Expr) -> Flow:
        """The column, and only the rows that have it; it is computed once."""
        return self.explode(name, lambda d: d.filter(d.items(value(d)), "v", "v is not null"))

    def group(self, *keys: str, **columns: Expr) -> Flow:
        spark_columns = {n: f(SPARK) for n, f in columns.items()}
        body = ", ".join([*keys, *(f"{f(DUCKDB)} as {n}" for n, f in columns.items())])
        run = lambda s, d: self.spark(s, d).groupBy(*keys).agg(*(F.expr(x).alias(n) for n, x in spark_columns.items()))
        return replace(self, spark=run, duckdb=self._sql(f"select {body}", f"group by {', '.join(keys)}" if keys else ""))

    def join(self, other: Flow, *keys: str, how: str = "inner") -> Flow:
        word = {"inner": "join", "left": "left join", "full": "full join", "left_anti": "anti join", "left_semi": "semi join"}[how]
        return replace(self, spark=lambda s, d: self.spark(s, d).join(other.spark(s, d), list(keys), how), duckdb=f"select * from ({self.duckdb}) a {word} ({other.duckdb}) b using ({', '.join(keys)})")

    def union(self, other: Flow) -> Flow:
        return replace(self, spark=lambda s, d: self.spark(s, d).unionByName(other.spark(s, d)), duckdb=f"({self.duckdb}) union all by name ({other.duckdb})")
