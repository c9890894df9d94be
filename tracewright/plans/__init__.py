"""Design synthesis, adaptation policies, calibration and sweep reducers."""
