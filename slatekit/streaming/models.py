"""Scoring models kept by version in the shared storage.

A store is a folder: ``v=<n>`` holds one version (``spec``, one JSON row, and
``weights``, a Parquet table), ``pointer/<k>-<n>`` are empty files of which the
last names the version in use.  Versions are written aside and moved into place,
pointers are only added, so a reader never sees half a model and a restarted
publisher harms nothing; going back to an old version is another pointer.

The driver looks the version up (once a micro-batch); a Python worker loads the
model of (path, version) once, and again when the version moves.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from slatekit.config import ITEM_FIELDS
from slatekit.sources import shared

WEIGHTS = "field int, id bigint, weight double"


class LinearScorer:
    """pred = sigmoid(bias + sum_f w_f * (id_f mod 97) / 97) of every item
    (summed left to right, bias first), rounded to 12 decimals."""

    kind, n_dense = "linear", 0

    def __init__(self, weights=(0.8, -0.5, 0.3, 0.6, -0.2, 0.4, 0.1), bias: float = -0.3):
        self.w = np.asarray(weights, dtype=np.float64)
        self.b = float(bias)

    def spec(self) -> dict:
        return {"kind": self.kind, "weights": self.w.tolist(), "bias": self.b}

    def score(self, items: np.ndarray) -> np.ndarray:
        z = np.full(len(items), self.b)
        for f in range(items.shape[1]):
            z = z + self.w[f] * (np.mod(items[:, f], 97) / 97.0)
        return np.round(1.0 / (1.0 + np.exp(-z)), 12)


class PointwiseScorer:
    """pred = sigmoid(bias + sum_f weight(f, id_f) + dense . item's dense
    features); an id without a weight adds nothing."""

    kind = "pointwise"

    def __init__(self, bias: float, dense: list[float], ids: list[np.ndarray], weights: list[np.ndarray]):
        self.bias, self.dense = float(bias), np.asarray(dense, dtype=np.float64)
        self.ids, self.weights = ids, weights          # by field, ids ascending
        self.n_dense = len(self.dense)

    def score(self, items: np.ndarray, dense: np.ndarray | None = None) -> np.ndarray:
        z = np.full(len(items), self.bias)
        for f, (ids, weights) in enumerate(zip(self.ids, self.weights)):
            if len(ids):
                at = np.minimum(np.searchsorted(ids, items[:, f]), len(ids) - 1)
                z += np.where(ids[at] == items[:, f], weights[at], 0.0)
        if self.n_dense:
            z += dense @ self.dense
        return 1.0 / (1.0 + np.exp(-z))


@dataclass(frozen=True)
class ModelAt:
    """A version of a stored model; called in a task, it loads the scorer."""

    path: str
    version: int

    def __call__(self):
        import pyarrow.parquet as pq

        fs, base = shared.file_system(f"{self.path}/v={self.version}")
        spec = json.loads(pq.read_table(f"{base}/spec", filesystem=fs).column("spec")[0].as_py())
        if spec["kind"] == LinearScorer.kind:
            return LinearScorer(spec["weights"], spec["bias"])
        if spec["kind"] != PointwiseScorer.kind:
            raise ValueError(f"unknown kind of model {spec['kind']!r}")
        t = pq.read_table(f"{base}/weights", filesystem=fs)
        field, ids, w = (t.column(c).to_numpy() for c in ("field", "id", "weight"))
        order = np.lexsort((ids, field))
        field, ids, w = field[order], ids[order], w[order]
        cut = np.searchsorted(field, np.arange(len(ITEM_FIELDS) + 1))
        parts = list(zip(cut, cut[1:]))
        return PointwiseScorer(spec["bias"], spec["dense"], [ids[a:b] for a, b in parts], [w[a:b] for a, b in parts])


class ModelStore:
    """The versions of one model under ``path`` (a folder shared by the cluster)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in shared.names(self.spark, self.path) if n.startswith("v="))

    def version(self) -> int | None:
        """The version in use."""
        last = shared.names(self.spark, f"{self.path}/pointer")[-1:]
        return int(last[0].split("-")[1]) if last else None

    def point(self, version: int) -> None:
        """Use ``version`` from now on."""
        if version not in self.versions():
            raise ValueError(f"no version {version} in {self.path}")
        k = len(shared.names(self.spark, f"{self.path}/pointer"))
        while not shared.mark(self.spark, f"{self.path}/pointer/{k:08d}-{version}"):
            k += 1

    def publish(self, spec: dict, weights: DataFrame | None = None) -> int:
        """Write the next version and use it."""
        spark = self.spark
        tmp = shared.temporary(f"{self.path}/new")
        spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.parquet(f"{tmp}/spec")
        (weights if weights is not None else spark.createDataFrame([], WEIGHTS)).write.parquet(f"{tmp}/weights")
        version = max(self.versions(), default=0) + 1
        if not shared.publish(spark, tmp, f"{self.path}/v={version}"):
            return self.publish(spec, weights)         # another publisher took the number
        self.point(version)
        return version

    def current(self) -> ModelAt:
        version = self.version()
        if version is None:
            raise ValueError(f"no model published in {self.path}")
        return ModelAt(self.path, version)
