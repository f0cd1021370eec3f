"""Quantile-to-normal map as a stage of a model: fitted once, saved with it, applied to any table.

Fitting selects up to a thousand positions of every column at once and exactly:
the columns are laid under each other as (column, value) with counts of equal
values combined before the shuffle, put in order range by range, and each
value gives itself to the positions that its running count covers. Nothing
larger than the marks reaches the driver, and no task sees a whole column.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.functions.sums import amount
from patronage.operators.quantiles import apply_normal_map
from patronage.operators.selection import running_total, scalars

QUANTILES = 1000


def quantile_marks(df: DataFrame, columns: list[str], most: int = QUANTILES) -> dict[str, list[float]]:
    """Per column the linearly interpolated quantiles at equal steps from 0 to 1, as many as rows but at most ``most``.

    Nulls and NaN are left out; a column without values has no marks.
    """
    cells = df.select(*[amount(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sizes = scalars(cells, **{f"c{i}": F.count(f"c{i}") for i in range(len(columns))})
    rows = df.count()
    marks = {c: max(1, min(most, rows)) for c in columns}
    stacked = cells.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"c{i}").alias("v")) for i in range(len(columns))])))
    values = stacked.where("v is not null").groupBy("at", "v").agg(F.count("*").alias("n"))
    placed = running_total(values.select(F.struct("at", "v").alias("key"), "n"), "key", ["n"])

    # Positions of column i follow those of the columns before it; its k-th mark lies at (size - 1) * k / (marks - 1) of its own.
    before, steps = [0], [marks[c] - 1 for c in columns]
    for i in range(len(columns)):
        before.append(before[-1] + sizes[f"c{i}"])
    def per_column(numbers):
        return F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in numbers]), F.col("key.at") + 1)

    first = (F.col("n_before") - per_column(before[:-1])).alias("first")
    spans = placed.select(
        F.col("key.at").alias("at"), F.col("key.v").alias("v"), first, (first + F.col("n") - 1).alias("last"),
        per_column([sizes[f"c{i}"] - 1 for i in range(len(columns))]).alias("top"), per_column(steps).alias("steps"),
    )
    low = F.call_function("div", F.col("top") * F.col("k"), F.greatest("steps", F.lit(1)))  # the position at or before the mark
    # A value that stands from first to last may serve the marks k with first - 1 <= top * k / steps < last + 1.
    from_k = F.call_function("div", F.greatest(F.col("first") - 1, F.lit(0)) * F.col("steps"), F.greatest("top", F.lit(1)))
    to_k = F.least(F.call_function("div", (F.col("last") + 1) * F.col("steps"), F.greatest("top", F.lit(1))) + 1, F.col("steps"))
    met = spans.select("*", F.explode(F.sequence(F.least(from_k, to_k), to_k)).alias("k")).withColumn("low", low)
    met = met.where("low between first and last or least(low + 1, top) between first and last")
    found = met.groupBy("at", "k").agg(
        F.max(F.when(F.col("low").between(F.col("first"), F.col("last")), F.col("v"))).alias("a"),
        F.max(F.when(F.least(F.col("low") + 1, F.col("top")).between(F.col("first"), F.col("last")), F.col("v"))).alias("b"),
    ).collect()  # the marks: at most ``most`` a column
    out: dict[str, list[float]] = {c: [] for c in columns}
    for r in sorted(found, key=lambda r: (r.at, r.k)):
        top, step = sizes[f"c{r.at}"] - 1, max(steps[r.at], 1)
        part = top * r.k % step / step
        out[columns[r.at]].append(r.a + (r.b - r.a) * part if part else r.a)
    return out


class _NormalMapParams(HasInputCols, HasOutputCol):
    quantiles = Param(Params._dummy(), "quantiles", "most marks of a column", typeConverter=TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(quantiles=QUANTILES)


class NormalMap(Estimator, _NormalMapParams, MLReadable, MLWritable):
    """Fits the marks of ``inputCols``; the model assembles the mapped columns into the vector ``outputCol``."""

    @keyword_only
    def __init__(self, *, inputCols=None, outputCol=None, quantiles=QUANTILES):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> NormalMapModel:
        marks = quantile_marks(dataset, self.getInputCols(), self.getOrDefault(self.quantiles))
        return self._copyValues(NormalMapModel(marks))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class NormalMapModel(Model, _NormalMapParams, MLReadable, MLWritable):
    """Marks by column. A column without marks maps to 0, as do null values, which have no place among the others."""

    def __init__(self, marks: dict[str, list[float]] | None = None):
        super().__init__()
        self.marks = marks or {}

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names, out = self.getInputCols(), self.getOrDefault(self.outputCol)
        suffix = "_normal"
        while any(f"{c}{suffix}" in dataset.columns for c in names):
            suffix += "_"
        mapped = apply_normal_map(dataset, {c: m for c in names if (m := self.marks.get(c))}, suffix) if any(self.marks.values()) else dataset
        placed = {f"{c}{suffix}": F.coalesce(F.col(f"{c}{suffix}"), F.lit(0.0)) if self.marks.get(c) else F.lit(0.0) for c in names}
        inner = list(placed)
        return VectorAssembler(inputCols=inner, outputCol=out).transform(mapped.withColumns(placed)).drop(*inner)

    def write(self) -> MLWriter:
        return _MarksWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MarksReader(cls)


class _MarksWriter(MLWriter):
    def __init__(self, instance: NormalMapModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark: SparkSession = self.sparkSession
        DefaultParamsWriter.saveMetadata(self.instance, path, spark)
        rows = [(c, [float(x) for x in m]) for c, m in self.instance.marks.items()]
        spark.createDataFrame(rows, "name string, marks array<double>").coalesce(1).write.parquet(f"{path}/marks")


class _MarksReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> NormalMapModel:
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        model = NormalMapModel({r["name"]: list(r["marks"]) for r in spark.read.parquet(f"{path}/marks").collect()})
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
