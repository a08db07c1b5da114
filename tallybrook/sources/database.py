"""Tables of a database, read and appended through JDBC."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.config import jdbc_config
from tallybrook.operators.explain import with_explanations

PROCESSED, FLAGGED, EXPLANATIONS, BATCHES = "processed_transactions", "flagged_transactions", "transaction_explanations", "written_batches"


def ensure_columns(flags: DataFrame) -> DataFrame:
    """explanation and explained_at, null where a table does not have them yet."""
    for name, kind in (("explanation", "string"), ("explained_at", "timestamp")):
        if name not in flags.columns:
            flags = flags.withColumn(name, F.lit(None).cast(kind))
    return flags


class Database:
    """Where a JDBC URL points. Filters and columns of what is read go to the database."""

    def __init__(self, spark: SparkSession, url: str | None = None):
        self.spark = spark
        self.url, self.properties = jdbc_config(url)

    def read(self, table: str) -> DataFrame:
        return self.spark.read.jdbc(self.url, table, properties=self.properties)

    def has(self, table: str) -> bool:
        try:
            self.read(table)
        except Exception as error:  # drivers report a missing table each in their own way
            if isinstance(error, AnalysisException) or "exist" in str(error).lower() or "SQLSyntaxError" in str(error):
                return False
            raise
        return True

    def append(self, rows: DataFrame, table: str) -> None:
        rows.write.jdbc(self.url, table, mode="append", properties=self.properties)

    def processed(self) -> DataFrame:
        return self.read(PROCESSED)

    def flagged(self) -> DataFrame:
        return self.read(FLAGGED)

    def explanations(self) -> DataFrame:
        """transaction_id, explanation and explained_at; none before the first is written."""
        if self.has(EXPLANATIONS):
            return self.read(EXPLANATIONS)
        return self.spark.createDataFrame([], "transaction_id string, explanation string, explained_at timestamp")

    def explained(self) -> DataFrame:
        """Flagged rows with their newest explanation; its columns are there before any is written."""
        flags = self.flagged()
        return with_explanations(flags, self.read(EXPLANATIONS)) if self.has(EXPLANATIONS) else ensure_columns(flags)

    def account(self, account_id: str) -> DataFrame:
        """One account's processed rows; the id is a literal of the filter that the database applies."""
        return self.processed().where(F.col("account_id") == F.lit(account_id))


class BatchLog:
    """Which batches of a stream were begun and ended, so that one that is run again can be told from a new one."""

    def __init__(self, database: Database):
        self.database = database

    def states(self, batch_id: int) -> set[str]:
        if not self.database.has(BATCHES):
            return set()
        return {r.state for r in self.database.read(BATCHES).where(F.col("batch_id") == batch_id).select("state").collect()}

    def note(self, batch_id: int, state: str) -> None:
        self.database.append(self.database.spark.createDataFrame([(batch_id, state)], "batch_id long, state string"), BATCHES)
