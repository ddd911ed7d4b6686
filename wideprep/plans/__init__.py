"""Small driver-side plans over metadata (one row per column or header cell):
header names (IO2, PR1-PR7) and fill decisions (IM8, IM9)."""
