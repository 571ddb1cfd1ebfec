"""Table shapes of the library. Everything stays long; a column per feature is never created."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

# one row per detected peak in one injection
PEAKS = _schema(file=_S, rt=_D, mz=_D, value=_D, type=_S, replicate=_S, day=_S, batch=_S, technique=_S)
# peaks with the feature they were aligned to
ALIGNED = T.StructType(PEAKS.fields + [T.StructField("feature", _S)])
# the long sample-by-feature table most operators take
FINGERPRINT = _schema(file=_S, feature=_S, value=_D, technique=_S, source=_S, mz=_D, rt=_D)
# one row per file
LABELS = _schema(file=_S, plastic_type=_S, subcategory=_S, polymer=_S)
# reference compounds
LIBRARY = _schema(name=_S, mass=_D, function=_S, sector=_S)
# measurement quality of each isotope and gas mode
METAL_QC = _schema(name=_S, recovery=_D, uncertainty=_D)
# long form of a spectra table with repeated sample columns
SPECTRA = _schema(wavenumber=_D, sample=_S, rep=_I, value=_D)
# one test per feature and pair of classes
TESTS = _schema(feature=_S, pair=_S, p_value=_D, adjusted=_D)
# square matrices as pairs with i < j
PAIRS = _schema(i=_S, j=_S, value=_D)
# class probabilities of a classifier
PROBABILITIES = T.StructType(
    [T.StructField("sample", _S), T.StructField("actual", _S), T.StructField("class", _S), T.StructField("prob", _D)]
)

# layout of a peak-list export before it is tagged with its file name
GC_CSV = T.StructType(
    [
        T.StructField(n, _D if n in ("Start", "End", "Width", "Area", "Height", "m.z", "RT") else _S)
        for n in ("Start", "End", "Width", "Base.Peak", "Cpd", "Label", "Height", "Ions", "Area", "RT", "m.z")
    ]
)
