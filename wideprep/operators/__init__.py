"""DataFrame -> DataFrame operators.

profile (D1, AGG*), quantile (AGG9), ordered (D2: fills, interpolation,
positions, running totals), impute (IM1-IM4, IM8-IM13), knn (IM7), columns
(PR8-PR12), classify (CL1-CL3), correlate (D3, ST1), posthoc (D4, ST2),
features (ML1-ML4), model (ML5-ML7, ML10), explain (ML8, ML9).
"""
