"""Operators on DataFrames."""

from millrace.operators.asof import asof_join
from millrace.operators.bootstrap import bootstrap_intervals
from millrace.operators.calibration import bin_rates, brier_parts, cluster_error, line_fit
from millrace.operators.drift import drift
from millrace.operators.intervals import interval_join
from millrace.operators.isotonic import isotonic_blocks, with_curve
from millrace.operators.maintained import store_periods, stored_rates
from millrace.operators.mass import calibration_error, equal_mass_bins
from millrace.operators.ranking import exact_auc
from millrace.operators.survival import survival_curve

__all__ = [
    "asof_join",
    "bin_rates",
    "bootstrap_intervals",
    "brier_parts",
    "calibration_error",
    "cluster_error",
    "drift",
    "equal_mass_bins",
    "exact_auc",
    "interval_join",
    "isotonic_blocks",
    "line_fit",
    "store_periods",
    "stored_rates",
    "survival_curve",
    "with_curve",
]
