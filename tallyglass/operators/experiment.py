"""Control of experiments: frozen specifications, equivalence, manifests, audits."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field
from datetime import date

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.sources.sinks import stable_json


@dataclass
class Specification:
    """What a test run is bound to before it starts. (O-165)"""

    parameters: dict[str, float]
    grids: dict[str, list[float]]
    selected: dict[str, float]
    features: list[str]
    sources: dict[str, str] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)

    def text(self) -> str:
        return stable_json(asdict(self))

    def digest(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def differences(frozen: Specification, now: Specification) -> list[str]:
    """The parts in which two specifications differ; selected values must be of the grids, required sources there. (O-166)"""
    a, b = asdict(frozen), asdict(now)
    out = [k for k in a if a[k] != b[k]]
    out += [f"sources.{k}" for k in frozen.required if k not in now.sources]
    out += [f"selected.{k}" for k, v in now.selected.items() if k in now.grids and v not in now.grids[k]]
    return out


#: The base of the polynomial and its modulus (a prime, so that products of two residues fit 38 digits).
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def fingerprint(df: DataFrame, order: list[str]) -> str:
    """A digest of rows in the order of ``order``, column names and column order. (O-169)

    ``order`` must order the rows; of equal ones the row's own hash decides. The digest is that of a polynomial:
    sum of row hash x base^position, modulo a prime. Positions come from ranges that are sorted
    apart: sizes of the ranges before one shift its polynomial, so parts merge in any partitioning, and a swap of two rows
    changes the whole. A task gives three numbers; the driver merges as many as there are ranges.
    """
    names = stable_json(df.dtypes)
    row = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)), F.lit(_PRIME))
    hashed = df.select(*(F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)), row.alias("_h"))
    keys = [f"_o{i}" for i in range(len(order))] + ["_h"]
    sorted_ = hashed.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "_h")

    def fold(batches):
        part, n, total, power = None, 0, 0, 1
        for b in batches:
            for p, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part, total, power, n = p, (total + h * power) % _PRIME, power * _BASE % _PRIME, n + 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([total], pa.int64())], names=["part", "n", "total"])

    n, total = 0, 0
    for r in sorted_.mapInArrow(fold, "part int, n long, total long").orderBy("part").collect():
        total = (total + r["total"] * pow(_BASE, n, _PRIME)) % _PRIME
        n += r["n"]
    return hashlib.sha256(f"{names}{n}:{total}".encode()).hexdigest()


def ordered_fingerprints(df: DataFrame, group: str, order: list[str], row: Column | None = None) -> DataFrame:
    """``group``, n, digest: for each group a digest of its rows in order, all in one job. (O-169)

    sum of row hash (31 bits) x position, exact in decimals, so parts merge in any partitioning: a swap of two different rows
    changes it, partitions do not. ``row`` gives the hash of a row as a long, else one of all columns is taken.
    """
    hashed = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)) if row is None else row, F.lit((1 << 31) - 1))
    rows = df.select(F.col(group), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), hashed.alias("_h"))
    at = F.row_number().over(Window.partitionBy(group).orderBy(*(f"_o{i}" for i in range(len(order))), "_h"))
    terms = rows.select(group, (F.col("_h").cast("decimal(10,0)") * at.cast("decimal(10,0)")).alias("t"))
    return terms.groupBy(group).agg(F.count("*").alias("n"), F.sum("t").cast("string").alias("digest"))


def changed(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-11) -> DataFrame:
    """The keys on which two results differ, or that one of them lacks. (O-167)"""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return joined.filter(F.col("_a").isNull() | F.col("_b").isNull() | (F.abs(F.col("_a") - F.col("_b")) > tolerance)).select(*keys)


def equal_results(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-11) -> bool:
    """Whether two results agree on every key; a zero strength must change nothing. (O-167)"""
    return changed(a, b, keys, value, tolerance).isEmpty()


class Manifest:
    """Status of a run; a failure leaves no state but failed. (O-168)"""

    def __init__(self, path: str):
        self.path, self.state = path, {"status": "new", "stages": []}

    def _write(self) -> None:
        with open(self.path, "w") as f:
            f.write(stable_json(self.state))

    def run(self, stages: dict):
        """Run the named functions in order, each with the results so far."""
        self.state = {"status": "running", "started": str(date.today()), "stages": []}
        self._write()
        results = {}
        try:
            for name, stage in stages.items():
                results[name] = stage(results)
                self.state["stages"].append(name)
                self._write()
        except BaseException as error:
            self.state = {"status": "failed", "at": name, "error": type(error).__name__}
            self._write()
            raise
        self.state["status"] = "complete"
        self._write()
        return results


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """name, n, passed for each check, a DataFrame of violating rows. (O-170)"""
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", (F.col("n") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out
