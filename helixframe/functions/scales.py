"""Property scales of residues, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.operators.prep import RESIDUES

# Published scales, in the order ACDEFGHIKLMNPQRSTVWY.
HYDROPATHY = (1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3)
VOLUME = (88.6, 108.5, 111.1, 138.4, 189.9, 60.1, 153.2, 166.7, 168.6, 166.7, 162.9, 114.1, 112.7, 143.8, 173.4, 89.0, 116.1, 140.0, 227.8, 193.6)
HELIX_ENERGY = (0.0, 0.68, 0.69, 0.4, 0.54, 1.0, 0.61, 0.41, 0.26, 0.21, 0.24, 0.65, 3.16, 0.39, 0.21, 0.5, 0.66, 0.61, 0.49, 0.53)
SHEET_ENERGY = (-0.35, -0.47, -0.41, -0.41, -0.55, 0.0, -0.46, -0.56, -0.41, -0.48, -0.46, -0.38, -0.23, -0.4, -0.44, -0.39, -0.48, -0.53, -0.48, -0.5)
DISORDER = (0.06, 0.02, 0.192, 0.736, -0.697, 0.166, 0.303, -0.486, 0.586, -0.326, -0.397, 0.007, 0.987, 0.318, 0.18, 0.341, 0.059, -0.121, -0.884, -0.51)
HELIX_SCORE = (1.0, 0.77, 0.69, 1.0, 0.92, 0.0, 0.69, 1.0, 0.74, 1.0, 1.0, 0.23, 0.0, 0.98, 0.79, 0.0, 0.64, 0.91, 0.92, 0.72)
SHEET_SCORE = (0.37, 1.0, 0.4, 0.26, 1.0, 0.75, 0.87, 1.0, 0.37, 0.87, 0.75, 0.37, 0.0, 0.87, 0.9, 0.75, 1.0, 1.0, 1.0, 1.0)
DISORDER_SCORE = (0.06, 0.02, 0.23, 0.22, 0.02, 0.13, 0.08, 0.01, 0.2, 0.02, 0.04, 0.21, 0.27, 0.2, 0.18, 0.18, 0.14, 0.01, 0.02, 0.05)
POLARITY = (0.0, 0.28, 0.68, 0.68, 0.28, 0.0, 0.68, 0.13, 0.65, 0.13, 0.28, 0.68, 0.28, 0.68, 0.65, 0.62, 0.62, 0.13, 0.56, 0.56)
POSITIVE, NEGATIVE = "KR", "DE"


def _flags(letters: str, others: str = "") -> tuple[float, ...]:
    return tuple(float((r in letters) - (r in others)) for r in RESIDUES)


#: Scales behind evidence tables; a residue without a value has none.
EVIDENCE = {
    "hydrophobicity": HYDROPATHY, "charge": _flags(POSITIVE, NEGATIVE), "volume": VOLUME, "aromaticity": _flags("FYW"), "helix_prop": HELIX_ENERGY, "sheet_prop": SHEET_ENERGY, "disorder_prop": DISORDER,
}
#: Scales behind figures; a residue without a value counts as 0.
FIGURES = {
    "hydrophobicity": HYDROPATHY, "charge": _flags(POSITIVE, NEGATIVE), "helix_prop": HELIX_SCORE, "sheet_prop": SHEET_SCORE, "disorder_prop": DISORDER_SCORE, "polarity": POLARITY, "volume": VOLUME,
    "aromaticity": _flags("FYWH"),
}


def scale_table(spark: SparkSession, scales: dict[str, tuple[float, ...]] = EVIDENCE) -> DataFrame:
    """residue, property, value."""
    rows = [(r, p, v) for p, values in scales.items() for r, v in zip(RESIDUES, values, strict=True)]
    return spark.createDataFrame(rows, "residue string, property string, value double")
