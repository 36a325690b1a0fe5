"""Named tables: the given parquet tables, derived inputs, and staged results of the operators.

A staged table is written once per session to the shared folder (the stage
boundaries of the pipeline) and read back, so that long chains neither recompute
nor hold their lineage.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstream.config import Config
from fleetstream.operators.scan import numbered
from fleetstream.plans.fixtures import BASE_TABLES, FIXTURES, LINE_ORDER
from fleetstream.session import stage, stage_path

#: Order keys of a chunk when lines are numbered: bounds what one task sorts of a supplier, yet leaves far fewer chunks than lines.
ORDER_BLOCK = 65_536

_STAGES: dict[str, Callable[["Pipeline"], DataFrame]] = {}
_OPEN: dict[tuple[str, str], "Pipeline"] = {}


def stage_table(name: str):
    def register(fn: Callable[["Pipeline"], DataFrame]):
        _STAGES[name] = fn
        return fn

    return register


class Pipeline:
    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        # derived timelines are about ten minutes long: smaller chunks than the
        # default, so that every ordered scan crosses chunk borders here too
        self.cfg = cfg or Config(chunk_rows=240, chunk_s=240, planned_breaks="00:03-00:05,00:08-00:09")
        self._tables: dict[str, DataFrame] = {}
        self._paths: dict[str, str] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Pipeline":
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in _OPEN:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            _OPEN[key] = cls(spark, sf_dir)
        return _OPEN[key]

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def t(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name in BASE_TABLES:
                self._tables[name] = self.base(name)
            else:
                df = _STAGES[name](self) if name in _STAGES else self.fixture(name)
                self._paths[name] = stage_path(self.spark, name)
                self._tables[name] = stage(df, name, self._paths[name], "zstd")
        return self._tables[name]

    def stream(self, name: str) -> DataFrame:
        """The staged table as a file stream."""
        schema = self.t(name).schema
        return self.spark.readStream.schema(schema).parquet(self._paths[name])

    def fixture(self, name: str) -> DataFrame:
        text = FIXTURES[name]
        args = {}
        for n in set(re.findall(r"\{(\w+)\}", text)) - {"nl"}:
            args[n] = self._sequenced_lines() if n == "seqd" else self.t(n)
        text = text.replace("{nl}", "chr(10)")
        df = self.spark.sql(_spark_dialect(text), **args)
        # timestamps without zone become UTC instants
        return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if "timestamp" in f.dataType.typeName()})

    def _sequenced_lines(self) -> DataFrame:
        lines = self.base("lineitem").select(*LINE_ORDER, "l_suppkey")
        return numbered(lines.withColumn("__blk", F.expr(f"l_orderkey div {ORDER_BLOCK}")), ["l_suppkey"], "__blk", LINE_ORDER).drop("__blk")


def _spark_dialect(text: str) -> str:
    # Spark spells the unit of date_diff without quotes
    return re.sub(r"date_diff\('(\w+)',", lambda m: f"timestampdiff({m.group(1).upper()},", text)
