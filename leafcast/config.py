"""Settings of a synopsis, and the data sets that are known by name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Edges of unbounded boxes: comparisons stay total, no null is needed.
LOW, HIGH = -1e308, 1e308


@dataclass(frozen=True)
class SynopsisConfig:
    """Defaults as on the command line of an experiment."""

    leaves: int = 64
    sample_rate: float = 0.01
    catch_up: float = 0.1
    oversample: float = 1.0
    rows_per_leaf: int = 64
    extremes: int = 10
    baselines: tuple[str, ...] = ("synopsis", "exact", "uniform")

    @property
    def partition_sample(self) -> int:
        """Rows that the partitioner sees."""
        return int(1.2 * self.rows_per_leaf * self.leaves)

    def reservoir(self, rows: int) -> int:
        return int(self.sample_rate * rows * self.oversample)

    def storage_mb(self, rows: int, row_bytes: float) -> float:
        return 1.2 * (self.sample_rate * rows * row_bytes + self.leaves * 1024) / 1e6


@dataclass(frozen=True)
class Dataset:
    """A CSV data set: the file's columns (None: as its header names them, types inferred), domain bounds, columns that are kept (all if none are named) or derived, and
    whether rows that miss a value are dropped."""

    name: str
    schema: T.StructType | None
    bounds: dict
    key: tuple[str, ...] = ()
    wanted: tuple[str, ...] = ()
    derived: dict = field(default_factory=dict)
    complete: bool = False

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames() if self.schema else []


def _doubles(names: str, strings: str = "") -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in strings.split()] + [T.StructField(n, T.DoubleType()) for n in names.split()])


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


_TRIPS = _doubles("pickup_date pickup_datetime dropoff_datetime pickup_time dropoff_date dropoff_time PULocationID DOLocationID trip_distance")
_PRICES = _doubles("pk open high low close volume idate")
_TRIP_BOUNDS = {"trip_distance": (0.0, 1000.0)}
_OHLC = ("open", "high", "low", "close", "idate", "volume")
_TRIP_COLUMNS = ("pickup_date", "pickup_time", "dropoff_date", "dropoff_time", "trip_distance", "PULocationID", "DOLocationID")
#: Fixed values, here and in the two tables below: names of data sets, their columns, bounds and workloads. Columns that loaders add, as Spark SQL over the file's columns.
_DEGREES = {"latitude": "CAST(latitude * 100000 AS INT)", "longitude": "CAST(longitude * 100000 AS INT)"}
_CROSSINGS = {"idate": "unix_timestamp(to_date(split(`Date`, ' ')[0], 'M/d/yyyy')) / 1e6", "port": "`Port Code`"}
_PURCHASES = {
    "DATE": "split(`TIME`, ' ')[0]", "AMOUNT": "`COUNT`", "idate": "CAST(replace(split(`TIME`, ' ')[0], '-', '') AS INT) - 20170100",
    "itime": "CAST(replace(split(`TIME`, ' ')[1], ':', '') AS INT)", "TIME": "split(`TIME`, ' ')[1]",
}
DATASETS = {
    d.name: d
    for d in (
        *(Dataset(n, _TRIPS, _TRIP_BOUNDS, wanted=w) for n, w in (("taxi", ("pickup_time", "trip_distance")), ("taxipdt", ("pickup_datetime", "trip_distance")), *((f"taxi{k}d", _TRIP_COLUMNS) for k in ("k", 1, 2, 3, 4, 5, 6)))),
        Dataset("etf", _PRICES, {"volume": (0.0, 1.1e9)}, ("pk",), wanted=_OHLC),
        Dataset("stock", _PRICES, {"volume": (0.0, 1.1e9)}, ("pk",), wanted=_OHLC),
        Dataset("intelwireless", _doubles("temperature humidity light voltage idate itime", "date time epoch moteid"), {"voltage": (0.5, 32000.0), "light": (0.0, 2000.0)}),
        Dataset("instacart", _doubles("order_id product_id add_to_cart_order reordered"), {}, complete=True),
        Dataset("data", None, {}, complete=True),
        Dataset("data1m", None, {}, complete=True),
        Dataset("nyab", None, {}, derived=_DEGREES, complete=True),
        Dataset("mexborder", _strings(["Port Name", "State", "Port Code", "Border", "Date", "Measure", "Value", "Location"]), {}, derived=_CROSSINGS, complete=True),
        Dataset("shopping", None, {}, derived=_PURCHASES),
        Dataset("small", _doubles("C A"), {}),
    )
}


def dataset(name: str) -> Dataset:
    """By name, whatever its case; ValueError for an unknown one."""
    found = DATASETS.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown data set {name!r}; known: {', '.join(DATASETS)}")
    return found


@dataclass(frozen=True)
class Workload:
    """A kind of random range queries over a data set, and the file that a number of them is kept in."""

    label: str
    dataset: str
    attrs: tuple[str, ...]
    target: str

    def file_name(self, n: int) -> str:
        return f"{self.label}-RangeSumQuery-{'_'.join(sorted(self.attrs))}-{self.target}-{n}.txt"


_FIVE = ("open", "high", "low", "close", "idate")
WORKLOADS = {
    "intel": Workload("IntelWireless", "intelwireless", ("itime",), "light"),
    "insta": Workload("Instacart", "instacart", ("product_id",), "reordered"),
    "taxi": Workload("Taxi", "taxi", ("pickup_time",), "trip_distance"),
    "taxipdt": Workload("TaxiPDT", "taxipdt", ("pickup_datetime",), "trip_distance"),
    "etf": Workload("ETF", "etf", _FIVE, "volume"),
    "stock": Workload("Stock", "stock", _FIVE, "volume"),
}
