"""Preprocessing: exact median imputation + standardisation, most-frequent imputation,
one-hot encoding (unseen → all zeros), feature names, standardiser statistics.

The two imputers are MLlib Estimators (persistable with the pipeline), fitted with exact
distributed statistics; categorical encoding reuses MLlib's StringIndexer/OneHotEncoder.
"""
from __future__ import annotations

from typing import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillage.functions.scalars import to_number_or_null
from tillage.operators.order import group_quantiles

STD_FLOOR = 1e-8


def _as_double(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):
        return to_number_or_null(F.col(c))
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


# A17 -----------------------------------------------------------------------------------
def standardizer_stats(df: DataFrame, features: Sequence[str], floor: float = STD_FLOOR) -> DataFrame:
    """Mean and population std per feature (text coerced to numbers); std <= floor → 1.0."""
    aggs = []
    for i, c in enumerate(features):
        v = _as_double(df, c)
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"),
                     F.when(F.col(f"s{i}") > floor, F.col(f"s{i}")).otherwise(F.lit(1.0)).alias("std"))
            for i, c in enumerate(features)]
    return wide.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")


def stats_as_param_map(stats: DataFrame) -> DataFrame:
    """The saved-parameter shape ``map<feature, struct<mean, std>>`` as one row."""
    return stats.agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("mean", "std")))).alias("scaler"))


# M6 ------------------------------------------------------------------------------------
class _ImputeScaleParams(HasInputCols, HasOutputCols):
    scale = Param(Params._dummy(), "scale", "standardise after imputing", typeConverter=TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(scale=True)


class MedianImputeScaler(Estimator, _ImputeScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    """Median imputation then (x - mean)/std (population std; 0 → 1), fitted exactly."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, scale=True):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getInputCols()
        structs = [F.struct(F.lit(c).alias("column"), _as_double(df, c).alias("v")) for c in cols]
        long = df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*")
        med = {r["column"]: r["m"] for r in
               group_quantiles(long, "v", [0.5], by=["column"], names=["m"]).collect()}
        medians = [float(med.get(c)) if med.get(c) is not None else 0.0 for c in cols]
        aggs = []
        for i, c in enumerate(cols):
            v = F.coalesce(_as_double(df, c), F.lit(medians[i]))
            aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
        row = df.agg(*aggs).first()
        means = [float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i in range(len(cols))]
        stds = [float(row[f"s{i}"]) if row[f"s{i}"] not in (None, 0.0) else 1.0 for i in range(len(cols))]
        m = MedianImputeScalerModel(inputCols=cols, outputCols=self.getOutputCols(), scale=self.getOrDefault("scale"),
                                    medians=medians, means=means, stds=stds)
        return self._copyValues(m)


class MedianImputeScalerModel(Model, _ImputeScaleParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "training medians", typeConverter=TypeConverters.toListFloat)
    means = Param(Params._dummy(), "means", "training means after imputation", typeConverter=TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "training population stds", typeConverter=TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, scale=True, medians=None, means=None, stds=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        cols, outs = self.getInputCols(), self.getOutputCols()
        med, mean, std = self.getOrDefault("medians"), self.getOrDefault("means"), self.getOrDefault("stds")
        scale = self.getOrDefault("scale")
        new = {}
        for i, c in enumerate(cols):
            v = F.coalesce(_as_double(df, c), F.lit(med[i]))
            new[outs[i]] = (v - F.lit(mean[i])) / F.lit(std[i]) if scale else v
        return df.withColumns(new)


# M7 ------------------------------------------------------------------------------------
class ModeImputer(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Most-frequent imputation for text columns (ties → smallest value)."""

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        cols = self.getInputCols()
        structs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]
        long = df.select(F.explode(F.array(*structs)).alias("_s")).select("_s.*").where(F.col("v").isNotNull())
        modes = long.groupBy("column", "v").count().groupBy("column").agg(
            F.min_by("v", F.struct((-F.col("count")).alias("n"), F.col("v").alias("v"))).alias("mode"))
        mode = {r["column"]: r["mode"] for r in modes.collect()}
        return self._copyValues(ModeImputerModel(inputCols=cols, outputCols=self.getOutputCols(),
                                                 modes=[mode.get(c) or "" for c in cols]))


class ModeImputerModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    modes = Param(Params._dummy(), "modes", "training modes", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, modes=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        modes = self.getOrDefault("modes")
        return df.withColumns({o: F.coalesce(F.col(c).cast("string"), F.lit(modes[i]))
                               for i, (c, o) in enumerate(zip(self.getInputCols(), self.getOutputCols()))})


def imputed_values(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str]) -> tuple:
    """What the two imputers fitted on ``df`` put in place of nulls: medians of the numbers, modes of the texts."""
    med = MedianImputeScaler(inputCols=list(num_cols), outputCols=list(num_cols)).fit(df).getOrDefault("medians") if num_cols else []
    modes = ModeImputer(inputCols=list(cat_cols), outputCols=list(cat_cols)).fit(df).getOrDefault("modes") if cat_cols else []
    return tuple(med), tuple(modes)


def with_imputed(df: DataFrame, num_cols: Sequence[str], cat_cols: Sequence[str], values: tuple) -> DataFrame:
    """``df`` with the nulls of these columns replaced by ``imputed_values``."""
    return df.withColumns({**{c: F.coalesce(_as_double(df, c), F.lit(v)) for c, v in zip(num_cols, values[0], strict=True)},
                           **{c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in zip(cat_cols, values[1], strict=True)}})


def preprocessing_stages(num_cols: Sequence[str], cat_cols: Sequence[str], features_col: str = "features",
                         scale: bool = True) -> list:
    """Stages: exact median impute (+ scale) for numbers; mode impute, alphabetical index
    (unseen → extra bucket) and one-hot with the extra bucket dropped for text."""
    stages = []
    num_out = [f"{c}__num" for c in num_cols]
    if num_cols:
        stages.append(MedianImputeScaler(inputCols=list(num_cols), outputCols=num_out, scale=scale))
    ohe_out = []
    if cat_cols:
        imp = [f"{c}__imp" for c in cat_cols]
        idx = [f"{c}__idx" for c in cat_cols]
        ohe_out = [f"{c}__ohe" for c in cat_cols]
        stages += [ModeImputer(inputCols=list(cat_cols), outputCols=imp),
                   StringIndexer(inputCols=imp, outputCols=idx, handleInvalid="keep",
                                 stringOrderType="alphabetAsc"),
                   # The indexer's extra slot for unseen values is the last one, which the encoder drops.
                   OneHotEncoder(inputCols=idx, outputCols=ohe_out, dropLast=True, handleInvalid="error")]
    stages.append(VectorAssembler(inputCols=num_out + ohe_out, outputCol=features_col))
    return stages


# M8 ------------------------------------------------------------------------------------
def feature_names(pipeline_model, num_cols: Sequence[str], cat_cols: Sequence[str]) -> list[str]:
    """Names after one-hot: numeric names, then ``col_value`` per known category."""
    from pyspark.ml.feature import StringIndexerModel
    names = list(num_cols)
    for st in pipeline_model.stages:
        if isinstance(st, StringIndexerModel):
            for c, labels in zip(cat_cols, st.labelsArray):
                names += [f"{c}_{v}" for v in labels]
    return names


def category_index(df: DataFrame, train: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Position of the (mode-imputed) category in the training vocabulary (alphabetical);
    null for a value unseen in training (its one-hot vector is all zeros)."""
    out_col = out_col or f"{col}__idx"
    vocab = train.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("_v")).distinct()
    mode = (train.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("_v")).count()
                 .agg(F.min_by("_v", F.struct((-F.col("count")).alias("n"), F.col("_v").alias("v")))))
    labels = vocab.agg(F.sort_array(F.collect_list("_v")).alias("_labels"))
    v = F.coalesce(F.col(col).cast("string"), mode.scalar())
    pos = F.array_position(labels.scalar(), v)
    return df.withColumn(out_col, F.when(pos > 0, pos - 1).cast("int"))
