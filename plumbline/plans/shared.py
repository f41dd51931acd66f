"""What several checks of one audit read: made at the first one's wish, kept as Parquet in the shared folder, removed at the end."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.model import Dataset, q
from plumbline.operators import census, validity
from plumbline.session import remove_folder, shared_folder

#: Checks that tell from a census or from the columns' facts; where an audit runs two of a kind, they share.
OF_ROWS = {"dup.exact", "dup.cross_split", "labels.conflict", "labels.taxonomy", "labels.imbalance"}
OF_COLUMNS = {"validity.nan_inf", "validity.constant", "validity.impossible"}


class Shared:
    """The intermediate results of an audit of ``data``; a result that isn't worth sharing, or can't be bounded, is None."""

    def __init__(self, data: Dataset, ids: set[str]) -> None:
        self.data, self.ids = data, ids
        self.folders: list[str] = []

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        folder = shared_folder(df.sparkSession, name)
        self.folders.append(folder)
        df.write.parquet(folder)
        return df.sparkSession.read.parquet(folder)

    @cached_property
    def facts(self) -> DataFrame | None:
        """``validity.facts``: one scan, a row for each column."""
        if len(self.ids & OF_COLUMNS) < 2 or not self.data.features:
            return None
        return self._kept(validity.facts(self.data.df, self.data.features, self.data.numeric), "facts").coalesce(1)

    @cached_property
    def rows(self) -> DataFrame | None:
        """``census.row_census`` by row identity, label and split: two scans, of which one reads the label only."""
        label, split = self.data.roles.label, self.data.roles.split
        keys = [c for c in self.data.identity if c != self.data.option("row_id", None)]
        if len(self.ids & OF_ROWS) < 2 or not keys:
            return None
        if label and self.data.df.agg(F.approx_count_distinct(q(label))).first()[0] > census.MOST_LABELS // 2:
            return None
        return self._kept(census.row_census(self.data.df, keys, label, split), "census")

    def close(self) -> None:
        for folder in self.folders:
            remove_folder(self.data.df.sparkSession, folder)
        self.folders.clear()
