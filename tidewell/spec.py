"""Table description passed to every operator: key, label and feature columns by name."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Spec:
    """Names of the key column, the label column and the numeric feature columns.

    Positional rules ("the label is the last column") are not carried over:
    everything is addressed by name.  ``features=None`` means "every numeric
    column except key and label", resolved against a schema by :meth:`resolve`.
    """

    id_col: str = "id"
    label_col: str = "label"
    features: tuple[str, ...] | None = None
    extra: tuple[str, ...] = field(default_factory=tuple)

    def resolve(self, df: DataFrame) -> "Spec":
        if self.features is not None:
            return self
        skip = {self.id_col, self.label_col, *self.extra}
        feats = tuple(f.name for f in df.schema.fields
                      if f.name not in skip and isinstance(f.dataType, NUMERIC_TYPES))
        return replace(self, features=feats)

    def with_features(self, features) -> "Spec":
        return replace(self, features=tuple(features))

    @property
    def feats(self) -> tuple[str, ...]:
        if self.features is None:
            raise ValueError("Spec.features unresolved; call spec.resolve(df) first")
        return self.features


def q(name: str) -> str:
    """Backtick-quote a column name (names may contain spaces and '#')."""
    return "`" + name.replace("`", "``") + "`"
