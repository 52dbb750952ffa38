"""Tables, their keys and indexes, and the types of the declared columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quern.operators.statistics import StatisticsPolicy
from quern.settings import is_on
from quern.sources.snapshots import SnapshotStore
from quern.sources.tables import table


@dataclass(frozen=True)
class IndexDef:
    """An ordered key over columns. Spark keeps no tree; it is a promise of how rows are looked up and sorted."""

    name: str
    columns: tuple[str, ...]
    unique: bool = False


@dataclass(frozen=True)
class TableDef:
    name: str
    primary_key: tuple[str, ...] = ()
    indexes: tuple[IndexDef, ...] = field(default=())

    def index(self, name: str) -> IndexDef:
        if name == "primary":
            return IndexDef("primary", self.primary_key, True)
        for found in self.indexes:
            if found.name == name:
                return found
        raise KeyError(f"{self.name} has no index {name}")


def capabilities(definition: TableDef) -> list[tuple[str, str, bool, bool, bool, bool]]:
    """(index, columns, unique, ordered, prefix, covering) of each way into a table: what a reader may ask of it.

    Every index gives order and ranges, in both directions; one of several columns can be asked by its leading
    ones; a table without a primary key has no unique way in. Columns that are asked for alone are read alone.
    """
    named = ([IndexDef("primary", definition.primary_key, True)] if definition.primary_key else []) + list(definition.indexes)
    return [(i.name, ",".join(i.columns), i.unique, True, len(i.columns) > 1, True) for i in named]


#: Declared key types and the Spark types that hold all their values.
KEY_TYPES: dict[str, T.DataType] = {
    "float": T.FloatType(), "double": T.DoubleType(), "int8": T.ByteType(), "int16": T.ShortType(), "uint16": T.IntegerType(),
    "int24": T.IntegerType(), "int32": T.IntegerType(), "uint24": T.LongType(), "uint32": T.LongType(), "int64": T.LongType(),
    "uint64": T.DecimalType(20, 0), "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "binary": T.BinaryType(),
    "varbinary": T.BinaryType(), "blob": T.BinaryType(), "bit": T.LongType(), "decimal": T.DecimalType(10, 2), "date": T.DateType(),
    "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "time": T.LongType(), "year": T.IntegerType(),
}


def _by(column: str) -> IndexDef:
    return IndexDef(f"by_{column}", (column,))


TABLES: dict[str, TableDef] = {
    t.name: t
    for t in (
        TableDef("region", ("r_regionkey",)),
        TableDef("nation", ("n_nationkey",), (_by("n_regionkey"),)),
        TableDef("customer", ("c_custkey",), (_by("c_nationkey"),)),
        TableDef("supplier", ("s_suppkey",), (_by("s_nationkey"),)),
        TableDef("part", ("p_partkey",)),
        TableDef("orders", ("o_orderkey",), (_by("o_custkey"), _by("o_orderdate"))),
        TableDef("lineitem", (), (IndexDef("by_order_line", ("l_orderkey", "l_linenumber")), IndexDef("by_part_supplier", ("l_partkey", "l_suppkey")), _by("l_shipdate"))),
        TableDef("events", ("event_id",), (IndexDef("by_user_time", ("user_id", "ts")),)),
    )
}


class Catalog:
    """Tables of one folder. Names are case sensitive."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def define(self, name: str) -> TableDef:
        if name not in TABLES:
            raise KeyError(f"no table {name}")
        return TABLES[name]

    def read(self, name: str) -> DataFrame:
        """The table; kept by the executors once it has been read while the setting block_read_ahead is on."""
        self.define(name)
        found = table(self.spark, self.folder, name)
        return self._keep(name, found) if is_on(self.spark, "block_read_ahead") else found

    def read_ahead(self, name: str) -> DataFrame:
        """The table, kept in memory and on disk of the executors once it has been read, until release()."""
        self.define(name)
        return self._keep(name, table(self.spark, self.folder, name))

    def _keep(self, name: str, df: DataFrame) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = df.persist()
        return self._kept[name]

    def release(self) -> None:
        """Give back what read_ahead keeps."""
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def statistics(self, store: SnapshotStore, name: str, now: float | None = None) -> dict:
        """Statistics of a stored table over its declared indexes, taken anew when due or when reset_statistics asks."""
        defined = self.define(name)
        wanted = {"primary": list(defined.primary_key)} if defined.primary_key else {}
        wanted |= {i.name: list(i.columns) for i in defined.indexes}
        policy = StatisticsPolicy(0.0, 0.0, -1.0) if is_on(self.spark, "reset_statistics") else None
        return store.statistics(name, wanted, policy, now)


def trim_padding(df: DataFrame) -> DataFrame:
    """Strings without the blanks a fixed-width column pads them with, so that = sees them as declared."""
    from pyspark.sql import functions as F

    return df.select(*(F.rtrim(c.name).alias(c.name) if isinstance(c.dataType, T.StringType) else F.col(c.name) for c in df.schema))
