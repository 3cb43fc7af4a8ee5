"""Two tables as tiers: the cold one is the authority, the hot one a replica that may lag or fail."""

from pyspark.sql import DataFrame

from ..operators import reads


class TieredTable:
    capabilities = {"feed", "catalog", "capture", "lag"}  # import stays with the tiers

    def __init__(self, hot, cold):
        self.hot, self.cold, self.failures = hot, cold, []

    def append(self, commands: DataFrame) -> DataFrame:
        """Cold first; the hot tier then imports the addresses' winners, as well as it can."""
        out = self.cold.append(commands)
        self._best_effort(lambda: self.hot.import_records(self.cold.latest().join(commands.select("address").distinct(), "address", "left_semi")))
        return out

    def prune(self, policy, now=None) -> int:
        version = self.cold.prune(policy, now)
        self._best_effort(lambda: self.hot.prune(policy, now))
        return version

    def latest(self, prefer_hot: bool = True) -> DataFrame:
        return reads.tiered_latest(self.hot.records(), self.cold.records(), prefer_hot)

    def repair(self) -> None:
        """The hot tier imports the heads that it lacks."""
        lacks = reads.tiered_latest(self.hot.records(), self.cold.records(), False).where("repair").drop("tier", "repair")
        self.hot.import_records(lacks)

    def lag(self) -> DataFrame:
        return reads.replication_lag(self.cold.records(), self.hot.records())

    def feed(self, cursor: int = 0, take: int | None = None) -> DataFrame:
        return self.cold.feed(cursor, take)

    def catalog(self) -> DataFrame:
        return self.cold.catalog()

    def capture(self, refs: DataFrame) -> DataFrame:
        return self.cold.capture(refs)

    def _best_effort(self, action) -> None:
        try:
            action()
        except Exception as e:  # the authority has it; the failure is kept for diagnostics
            self.failures = [*self.failures[-63:], repr(e)]
