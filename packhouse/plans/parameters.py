"""Fixed inputs of registered queries."""

from __future__ import annotations

from packhouse.operators.model import LinearParameters
from packhouse.schemas import FRAUD_FEATURES

# Digits after the point that doubles are compared by.
DIGITS = 6

RUN_TS = "2026-01-31 00:00:00"
LATER_TS = "2026-02-01 00:00:00"
SEARCH_TEXTS = ["  CUSTOMER#00000001", "%", "_", "007 ", "9@example.edu 1", "", "nobody"]

# Rounded parameters of one training run: a stand-in for a stored model in SQL comparisons.
FRAUD_PARAMETERS = LinearParameters(
    features=tuple(FRAUD_FEATURES),
    medians=(50.0, 97.0, 200748.0, 475.2, 22.0, 11.0),
    means=(50.0, 103.9, 215784.0, 475.2, 22.3, 11.0),
    deviations=(29.2, 57.5, 119260.0, 77.8, 14.3, 3.15),
    coefficients=(4.27, -0.004, 0.012, 0.006, -0.014, -0.015),
    intercept=-4.0,
)
