"""What an intake folder remembers: the ids of applied requests, the last ids given out, and how far each stream has come.

Everything is named by one small state file, which is replaced by the next version in one step. Applied ids lie in runs: each batch
adds one, sorted by id, with Parquet's row-group statistics and Bloom filters. The state has every run's range, so a batch reads
the runs its own ids can lie in, and of these the row groups that its range, or its ids where they are few, cannot rule out.
When a level has `FAN` runs they are merged into one of the next level; so there are few runs, and an id is written again only a
logarithmic number of times.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packhouse.sources.store import children, delete, publish, read_text

#: Runs of a level before they are merged.
FAN = 8
#: Ids up to which a batch asks for each of them, which Bloom filters can answer; beyond, it asks for their range.
FEW_IDS = 64
#: Ids of a row group's Bloom filter, and bytes of a row group of ids.
FILTER_IDS = 1_000_000
GROUP_BYTES = 8 << 20
FILE_IDS = 8_000_000


@dataclass(frozen=True)
class Run:
    path: str
    level: int
    rows: int
    least: int
    most: int


@dataclass(frozen=True)
class State:
    """`streams` has the number of the last applied batch of each stream; a stream's batches come in order."""

    version: int = 0
    last_order: int = 0
    last_item: int = 0
    streams: dict[str, int] = field(default_factory=dict)
    runs: tuple[Run, ...] = ()


class IntakeState:
    def __init__(self, spark: SparkSession, out_dir: str) -> None:
        self.spark, self.root = spark, out_dir.rstrip("/")

    def read(self) -> State:
        """The newest state; versions appear whole, so the highest number counts."""
        found = [int(name[1:]) for name in children(self.spark, f"{self.root}/state") if name[:1] == "v" and name[1:].isdigit()]
        if not found:
            return State()
        values = json.loads(read_text(self.spark, f"{self.root}/state/v{max(found)}"))
        return State(**{**values, "runs": tuple(Run(**r) for r in values["runs"])})

    def _publish(self, state: State) -> State:
        path = f"{self.root}/state/v{state.version}"
        if not publish(self.spark, path, json.dumps(asdict(state)) + "\n"):
            raise RuntimeError(f"{path} was written by another writer")
        for name in children(self.spark, f"{self.root}/state"):
            if name[1:].isdigit() and int(name[1:]) < state.version - 1:
                delete(self.spark, f"{self.root}/state/{name}")
        return state

    def _write_run(self, ids: DataFrame, name: str, level: int) -> Run | None:
        rows, least, most = ids.agg(F.count("request_id"), F.min("request_id"), F.max("request_id")).first()
        if not rows:
            return None
        path = f"applied/{name}"
        (ids.repartitionByRange(-(-rows // FILE_IDS), "request_id").sortWithinPartitions("request_id").write.mode("overwrite")
         .option("parquet.bloom.filter.enabled#request_id", "true")
         .option("parquet.bloom.filter.expected.ndv#request_id", FILTER_IDS)
         .option("parquet.block.size", GROUP_BYTES).parquet(f"{self.root}/{path}"))
        return Run(path, level, rows, least, most)

    def known(self, requests: DataFrame, state: State | None = None) -> DataFrame | None:
        """Applied ids that may be among those of `requests`; None if no run can have any."""
        state = state or self.read()
        ids = requests.select("request_id").where("request_id is not null")
        few = [r.request_id for r in ids.distinct().limit(FEW_IDS + 1).collect()]
        if len(few) <= FEW_IDS:
            spans = [(i, i) for i in sorted(few)]
        else:
            spans = [tuple(ids.agg(F.min("request_id"), F.max("request_id")).first())]
        paths = [f"{self.root}/{r.path}" for r in state.runs if any(low <= r.most and r.least <= high for low, high in spans)]
        if not paths:
            return None
        wanted = reduce(lambda a, b: a | b, [
            F.col("request_id") == low if low == high else F.col("request_id").between(low, high) for low, high in spans])
        return self.spark.read.schema("request_id long").parquet(*paths).where(wanted)

    def fresh(self, requests: DataFrame, state: State | None = None) -> DataFrame:
        """The rows of `requests` whose id was not applied; rows without an id are all fresh."""
        known = self.known(requests, state)
        return requests if known is None else requests.join(known, "request_id", "left_anti")

    def commit(self, state: State, stream: str, batch: int, ids: DataFrame, last_order: int, last_item: int) -> State:
        """Add a batch to `state`, the newest; then merge runs if a level is full. A crash before the new state appears leaves
        the old one, and what was written without being named is written over or left unread."""
        run = self._write_run(ids, f"{stream}-{batch}", 0)
        state = self._publish(replace(
            state, version=state.version + 1, last_order=last_order, last_item=last_item,
            streams={**state.streams, stream: batch}, runs=state.runs + ((run,) if run else ())))
        while True:
            full = next((level for level in sorted({r.level for r in state.runs})
                         if sum(r.level == level for r in state.runs) >= FAN), None)
            if full is None:
                return state
            state = self._merge(state, full)

    def _merge(self, state: State, level: int) -> State:
        old = [r for r in state.runs if r.level == level]
        ids = self.spark.read.schema("request_id long").parquet(*[f"{self.root}/{r.path}" for r in old])
        run = self._write_run(ids, f"merged-{uuid.uuid4().hex}", level + 1)
        state = self._publish(replace(
            state, version=state.version + 1, runs=tuple(r for r in state.runs if r.level != level) + (run,)))
        for r in old:
            delete(self.spark, f"{self.root}/{r.path}")
        return state
