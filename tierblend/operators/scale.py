"""Column scaling, row statistics and principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import PCA as MlPca
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _num(c: str) -> Column:
    return F.col(c).cast("double")


@dataclass(frozen=True)
class AffineModel:
    """``(x - shift) / scale`` per column, with the fitted numbers as constants of the plan."""

    shift: dict[str, float]
    scale: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.shift:
                out.append(((_num(c) - F.lit(self.shift[c])) / F.lit(self.scale[c])).alias(c))
            else:
                out.append(F.col(c))
        return df.select(*out)


def _fit_affine(df: DataFrame, columns: Sequence[str], low, width) -> AffineModel:
    """One aggregate for all columns; a zero width is replaced by 1."""
    row = df.agg(
        *[low(_num(c)).alias(f"l{i}") for i, c in enumerate(columns)],
        *[width(_num(c)).alias(f"w{i}") for i, c in enumerate(columns)],
    ).first()
    shift = {c: float(row[f"l{i}"] or 0.0) for i, c in enumerate(columns)}
    scale = {c: float(row[f"w{i}"] or 1.0) for i, c in enumerate(columns)}
    return AffineModel(shift, scale)


def fit_minmax(df: DataFrame, columns: Sequence[str]) -> AffineModel:
    return _fit_affine(df, columns, F.min, lambda x: F.max(x) - F.min(x))


def fit_standard(df: DataFrame, columns: Sequence[str]) -> AffineModel:
    """Mean and population deviation."""
    return _fit_affine(df, columns, F.avg, F.stddev_pop)


def fit_unit_norm(df: DataFrame, columns: Sequence[str]) -> AffineModel:
    """Scale every column to Euclidean norm 1."""
    return _fit_affine(df, columns, lambda x: F.lit(0.0), lambda x: F.sqrt(F.sum(x * x)))


def scale_pair(train: DataFrame, test: DataFrame, columns: Sequence[str], fit=fit_minmax, fit_on: str = "train"):
    """Scale train and test; ``fit_on='each'`` fits the test table on itself."""
    model = fit(train, columns)
    other = model if fit_on == "train" else fit(test, columns)
    return model.transform(train), other.transform(test)


def row_statistics(df: DataFrame, exclude: Sequence[str] = ("ID", "TARGET")) -> DataFrame:
    """Add mean, sample deviation, sum, maximum and minimum over the numeric columns of each row.

    Nulls and NaN are skipped as missing values.
    """
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in
               ("double", "float", "integer", "long", "short", "byte") and f.name not in exclude]
    cells = F.array(*[F.when(~F.isnan(_num(c)), _num(c)) for c in numeric])
    known = F.filter(cells, lambda x: x.isNotNull())
    # one array per row is built once and read by all five columns
    work = df.withColumn("_x", known).withColumn("_n", F.size("_x"))
    total = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x)
    work = work.withColumn("_s", total).withColumn("_m", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")))
    sq = F.aggregate("_x", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
    return work.select(
        *df.columns,
        F.col("_m").alias("mean"),
        F.when(F.col("_n") > 1, F.sqrt(sq / (F.col("_n") - 1))).alias("std"),
        F.col("_s").alias("sum_col_val"),
        F.array_max("_x").alias("max_col_val"),
        F.array_min("_x").alias("min_col_val"),
    )


@dataclass(frozen=True)
class PcaModel:
    """Principal components of centred columns; ``components[j]`` are the loadings of component j."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    components: tuple[tuple[float, ...], ...]
    explained: tuple[float, ...]

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        kept = [F.col(c) for c in df.columns if c not in self.columns]
        centred = [_num(c) - F.lit(m) for c, m in zip(self.columns, self.mean)]
        out = []
        for j, weights in enumerate(self.components):
            total = F.lit(0.0)
            for x, w in zip(centred, weights):
                total = total + x * F.lit(w)
            out.append(total.alias(f"{prefix}{j + 1}"))
        return df.select(*kept, *out)

    def transform_vector(self, df: DataFrame, vector: str, output: str = "pca") -> DataFrame:
        """Scores from a vector column, for many columns: an array of one value per component."""
        arr = vector_to_array(F.col(vector))
        centred = F.zip_with(arr, F.lit(list(self.mean)), lambda x, m: x - m)
        work = df.withColumn("_c", centred)
        scores = [
            F.aggregate(F.zip_with("_c", F.lit(list(w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
            for w in self.components
        ]
        return work.withColumn(output, F.array(*scores)).drop("_c")


def fit_pca(df: DataFrame, columns: Sequence[str], k: int) -> PcaModel:
    """The sign of each component makes its largest loading positive."""
    vectors = VectorAssembler(inputCols=list(columns), outputCol="_v").transform(
        df.select(*[_num(c).alias(c) for c in columns])
    )
    means = df.agg(*[F.avg(_num(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return _pca_model(vectors.select("_v"), "_v", tuple(columns), tuple(float(m) for m in means), k)


def fit_pca_vector(df: DataFrame, vector: str, k: int) -> PcaModel:
    from pyspark.ml.stat import Summarizer

    mean = df.select(Summarizer.mean(F.col(vector))).first()[0].toArray()
    return _pca_model(df.select(vector), vector, tuple(str(i) for i in range(len(mean))), tuple(map(float, mean)), k)


def _pca_model(df: DataFrame, vector: str, columns, mean, k: int) -> PcaModel:
    model = MlPca(k=k, inputCol=vector, outputCol="_pc").fit(df)
    loadings = model.pc.toArray().T
    signed = []
    for w in loadings:
        top = max(range(len(w)), key=lambda i: (abs(w[i]), -i))
        signed.append(tuple(float(x if w[top] >= 0 else -x) for x in w))
    return PcaModel(columns, mean, tuple(signed), tuple(float(x) for x in model.explainedVariance.toArray()))
