"""Incremental ingestion: micro-batches of records merged into a corpus table, each offered safely twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomline.operators.ingest import normalise, screen, validate
from fathomline.operators.merge import changes
from fathomline.runtime import delete, listed

#: Versions between two states that are written whole.
EVERY = 16


class CorpusTable:
    """Versions of a corpus under one folder: what every batch changed, and now and then the whole state.

    A batch writes the rows it changes or adds as the version its id names, so a batch that is tried again replaces its own
    version and nothing else. A state is the last whole one before it with the later rows of every slot on top. A whole state is
    written every ``every`` versions, after which what only older states need is deleted. Rows that break a rule go to a
    table of refusals beside it, by the same versions.
    """

    def __init__(self, folder: str, empty: DataFrame, every: int = EVERY):
        self.folder, self.empty, self.every = folder.rstrip("/"), empty, every

    def _path(self, version: int, kind: str = "changed") -> str:
        return f"{self.folder}/{kind}/v{version:09d}"

    def _versions(self, kind: str) -> list[int]:
        """Versions that were written to the end."""
        spark = self.empty.sparkSession
        names = listed(spark, f"{self.folder}/{kind}")
        return sorted(int(n[1:]) for n in names if n[0] == "v" and "_SUCCESS" in listed(spark, f"{self.folder}/{kind}/{n}"))

    def before(self, version: int) -> DataFrame:
        """The corpus as it was before a version."""
        return self._state(version, version)

    def _state(self, version: int, whole: int) -> DataFrame:
        """The corpus before a version, from a whole state before version ``whole``."""
        read = self.empty.sparkSession.read.schema(self.empty.schema)
        base = max((v for v in self._versions("whole") if v < whole), default=-1)
        state = read.parquet(self._path(base, "whole")) if base >= 0 else self.empty
        later = [v for v in self._versions("changed") if base < v < version]
        if not later:
            return state
        rows = read.parquet(self._path(later[0])).withColumn("_version", F.lit(later[0]))
        for v in later[1:]:
            rows = rows.unionAll(read.parquet(self._path(v)).withColumn("_version", F.lit(v)))
        last = rows.groupBy("seq").agg(F.max_by(F.struct(*self.empty.columns), "_version").alias("r")).select("r.*")
        return state.join(last.select("seq"), "seq", "left_anti").select(*self.empty.columns).unionAll(last)

    def _whole(self, version: int) -> None:
        """Writes the state after a version; the state before it stays, so the version can be tried again."""
        spark = self.empty.sparkSession
        older = [v for v in self._versions("whole") if v < version]
        # a version that is tried again has a whole state already, which is what is written anew
        self._state(version + 1, version).write.mode("overwrite").parquet(self._path(version, "whole"))
        if older:
            for kind, most in (("whole", older[-1] - 1), ("changed", older[-1])):
                for v in self._versions(kind):
                    if v <= most:
                        delete(spark, self._path(v, kind))

    def refused(self, version: int | None = None) -> DataFrame:
        """Rows that a batch (or any) brought and that broke a rule, with their ``violations`` and ``version``."""
        schema = f"{', '.join(f'`{n}` {t}' for n, t in self.empty.dtypes)}, violations array<string>, version bigint"
        spark = self.empty.sparkSession
        try:
            rows = spark.read.schema(schema).parquet(f"{self.folder}/refused/v{version:09d}" if version is not None else f"{self.folder}/refused/*")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = spark.createDataFrame([], schema)
        return rows

    def merge(self, batch: DataFrame, version: int, bands: dict[str, float], tolerant_on: list[str]) -> None:
        good, bad = validate(screen(normalise(batch)))
        bad = bad.select(*self.empty.columns, "violations", F.lit(version).cast("bigint").alias("version"))
        bad.write.mode("overwrite").parquet(f"{self.folder}/refused/v{version:09d}")
        corpus = self.before(version)
        last = corpus.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
        # order of arrival: the batch's own order after all that came before
        numbered = good.withColumn("seq", F.col("seq") + F.lit(last + 1)).select(*corpus.columns)
        changed, _ = changes(corpus, numbered, bands, tolerant_on=tolerant_on)
        changed.select(*self.empty.columns).write.mode("overwrite").parquet(self._path(version))
        if version % self.every == self.every - 1:
            self._whole(version)


def ingest_stream(
    records: DataFrame, table: CorpusTable, checkpoint: str, bands: dict[str, float], tolerant_on: list[str] | None = None
) -> StreamingQuery:
    """Merge a stream of records (with ``seq`` giving their order) into the table, batch by batch."""

    def one(batch: DataFrame, number: int) -> None:
        table.merge(batch, number, bands, tolerant_on or [])

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
